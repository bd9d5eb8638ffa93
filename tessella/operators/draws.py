"""Draws by hash: of many names the one with the least wait, hashed side by side.

A wait is -log of a uniform number from the first 48 bits of the MD5 digest of
a name, so the least wait is that of the largest number, whatever the log.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: Names that are hashed side by side, and cells of a table of steps and proposals.
PAIRS, TABLE = 16_384, 4_000_000
#: Bytes of a name that fit one block of the hash.
LONGEST = 55

_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_PLACES = [(1, 0), (5, 1), (3, 5), (7, 0)]


def digests(words: list, n: int) -> np.ndarray:
    """First 48 bits of the MD5 digests of ``n`` blocks; ``words``: 16 arrays of little-endian words, or None for zeros."""
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in _BEGIN)
    x, t = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=x)
            x &= b
            x ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=x)
            x &= d
            x ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=x)
            x ^= d
        else:
            np.invert(d, out=x)
            x |= b
            x ^= c
        x += a
        x += _SINES[i]
        by, plus = _PLACES[i // 16]
        word = words[(by * i + plus) % 16]
        if word is not None:
            x += word
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(x, np.uint32(turn), out=t)
        x >>= np.uint32(32 - turn)
        x |= t
        x += b
        a, b, c, d, x = d, x, b, c, a
    a += np.uint32(_BEGIN[0])
    b += np.uint32(_BEGIN[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(16)) | (b.byteswap() >> np.uint32(16))


def _words(texts: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(texts), dtype="<u4").reshape(len(texts), 16).T)


class Tails:
    """Ends of names, laid out in words once for each place at which they begin."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.longest, self.laid = texts, max(map(len, texts), default=0), {}

    def words(self, at: int) -> list:
        """Words of the blocks of names whose heads have ``at`` bytes, those left empty; None for words without any byte."""
        if at not in self.laid:
            found = _words([(bytes(at) + x + b"\x80").ljust(56, b"\0") + (8 * (at + len(x))).to_bytes(8, "little") for x in self.texts])
            self.laid[at] = [w if w.any() else None for w in found]
        return self.laid[at]

    def numbers(self, heads: list[bytes], h: np.ndarray, t: np.ndarray) -> np.ndarray:
        """First 48 bits of the MD5 of each ``heads[h]`` with the end ``t``; heads are of one length."""
        at = len(heads[0]) if heads else 0
        if at + self.longest > LONGEST:
            found = (hashlib.md5(heads[i] + self.texts[j]).digest()[:6] for i, j in zip(h.tolist(), t.tolist()))
            return np.fromiter((int.from_bytes(x, "big") for x in found), dtype=np.uint64, count=len(h))
        back = self.words(at)
        front = [w if k <= at // 4 else None for k, w in enumerate(_words([x.ljust(64, b"\0") for x in heads]))]
        out = np.empty(len(h), dtype=np.uint64)
        for low in range(0, len(h), PAIRS):
            i, j = h[low : low + PAIRS], t[low : low + PAIRS]
            words = [f[i] | b[j] if f is not None and b is not None else f[i] if f is not None else b[j] if b is not None else None for f, b in zip(front, back)]
            out[low : low + PAIRS] = digests(words, len(i))
        return out


def numbers(heads: list[bytes], tails: list[bytes], h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """First 48 bits of the MD5 of each ``heads[h] + tails[t]``; heads are of one length."""
    return Tails(tails).numbers(heads, h, t)


def _least(by: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``by``, which is in order, and the place of the first least value of each."""
    begin = np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.empty(0, dtype=np.int64)
    if not len(begin):
        return by, begin
    least = np.repeat(np.minimum.reduceat(value, begin), np.diff(np.r_[begin, len(by)]))
    at = np.flatnonzero(value == least)
    return by[begin], at[np.searchsorted(at, begin)]


def draw(name: str, steps: np.ndarray, held: dict[str, np.ndarray], weight: dict[int, tuple[float, float]], cells: int) -> np.ndarray:
    """For each of ``steps`` (in order) the place in ``held`` of the proposal drawn for it, -1 without any.

    ``held``: node, old, new, score, first, after of proposals; ``weight``: of
    a score, as two factors. Proposals of one score and cell of nodes are a
    class: first a class is drawn, its number of proposals counted, then one
    of them. Ties go to the least score and cell, and to the least proposal.
    """
    out = np.full(len(steps), -1, dtype=np.int64)
    if not len(steps) or not len(held["node"]):
        return out
    cell = held["node"] % cells
    order = np.lexsort((held["new"], held["old"], held["node"], cell, held["score"]))
    node, old, new, score, first, after = (held[c][order] for c in ("node", "old", "new", "score", "first", "after"))
    cell = cell[order]
    begin = np.flatnonzero(np.r_[True, (score[1:] != score[:-1]) | (cell[1:] != cell[:-1])])
    end = np.r_[begin[1:], len(node)]
    there = np.stack([np.searchsorted(np.sort(first[a:b]), steps, "right") - np.searchsorted(np.sort(after[a:b]), steps, "right") for a, b in zip(begin, end)], axis=1)
    factors = np.array([weight[s] for s in score[begin].tolist()])
    weights = there * factors[:, 0] * factors[:, 1]
    heads = [f"{name}:{t}:".encode() for t in steps.tolist()]
    lengths = np.array([len(x) for x in heads])
    classes = [f"{s}:{c}".encode() for s, c in zip(score[begin].tolist(), cell[begin].tolist())]
    for length in np.unique(lengths).tolist():
        of = np.flatnonzero(lengths == length)
        few = [heads[i] for i in of.tolist()]
        h, c = np.nonzero(weights[of] > 0)
        waits = -np.log((numbers(few, classes, h, c).astype(np.float64) + 1) / float(1 << 48)) / weights[of[h], c]
        at, best = _least(h, waits)
        for k in np.unique(c[best]).tolist():
            mine = of[at[c[best] == k]]
            a, b = int(begin[k]), int(end[k])
            names = Tails([f"{x}:{y}:{z}".encode() for x, y, z in zip(node[a:b].tolist(), old[a:b].tolist(), new[a:b].tolist())])
            most = max(1, TABLE // (b - a))
            many = np.cumsum(there[mine, k])
            low = 0
            while low < len(mine):
                before = int(many[low - 1]) if low else 0
                high = min(max(low + 1, int(np.searchsorted(many, before + PAIRS, "right"))), low + most)
                asked = steps[mine[low:high]]
                near = np.flatnonzero((first[a:b] <= asked[-1]) & (after[a:b] > asked[0]))
                h, p = np.nonzero((first[a:b][near] <= asked[:, None]) & (asked[:, None] < after[a:b][near]))
                p = near[p]
                which, place = _least(h, np.uint64(1 << 48) - names.numbers([heads[i] for i in mine[low:high].tolist()], h, p))
                out[mine[low:high][which]] = order[a + p[place]]
                low = high
    return out
