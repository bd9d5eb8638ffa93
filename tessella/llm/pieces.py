"""SentencePiece encoding that keeps the place of every piece in the text, and decoding.

The model file is read here: pieces, scores and the compiled character map, a
double-array trie over UTF-8. Text is normalised by the longest key of the map
that begins at each place, and for every byte of the result the byte of the
text that it came from is kept. Pairs of symbols are then merged, best score
first, leftmost of equals, and the ends of the pieces are looked up in that
alignment: piece k covers bytes ``offsets[k]`` to ``offsets[k + 1]`` of the
text. A character without a piece becomes byte pieces, of which the last
covers the character.

Merges never join characters that stand side by side in no piece. So text is
cut where no piece goes over, above all before the mark of a word's begin, and
equal parts are encoded once. New short parts are merged side by side in numpy;
what the merges of a long one come to is found from pairs of pieces.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Kinds of pieces, kind of model and fields in the model file's format: fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
#: Parts that are remembered, and characters of one at most; characters of texts that are encoded together.
KEPT_PARTS, KEPT_LENGTH, TOGETHER = 1 << 18, 64, 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes):
    """(number, value) of a serialised message: whole numbers, or bytes."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at : at + size]
            at += size


class CharacterMap:
    """The compiled map: size of the trie, the trie's units, and replacements that end with a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size :]
        self.first = {c for c in range(1, 256) if self._child(self._below(0), c) is not None} if self.units else set()

    def _below(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _child(self, base: int, byte: int):
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int):
        """(replacement, length) of the longest key at ``at``, or None."""
        found, base = None, self._below(0)
        for k in range(at, len(data)):
            node = self._child(base, data[k])
            if node is None:
                break
            base = self._below(node)
            if self.units[node] & 256:
                found = self.units[base] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        value, size = found
        return self.replacements[value : self.replacements.index(b"\0", value)], size


class Normaliser:
    """Text to (normalised text, for each of its characters and its end the byte of the text)."""

    def __init__(self, compiled: bytes, dummy_prefix: bool = True, remove_extra: bool = True, escape: bool = True, suffix: bool = False):
        self.map, self.dummy, self.remove, self.escape, self.suffix = CharacterMap(compiled), dummy_prefix, remove_extra, escape, suffix
        stops = self.map.first | ({32} if remove_extra else set())
        #: Bytes that begin no key: such stretches stay as they are.
        self.plain = re.compile(b"[^" + b"".join(b"\\x%02x" % c for c in sorted(stops)) + b"]+", re.S) if stops else re.compile(b".+", re.S)

    def _unit(self, data: bytes, at: int) -> tuple[bytes, int]:
        """What the next key or character becomes, and how long it is."""
        if data[at] in self.map.first and (hit := self.map.longest(data, at)):
            return hit
        size = 1 + sum(data[at] >= x for x in (0xC0, 0xE0, 0xF0))
        return data[at : at + size], size

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        data, at, out, places = text.encode(), 0, [], []
        if self.remove:
            while at < len(data) and (unit := self._unit(data, at))[0] == b" ":
                at += unit[1]
        if at == len(data):
            return "", np.zeros(1, np.int64)
        space = b" "
        if self.dummy and not self.suffix:
            out.append(space)
            places.append(np.array([at]))
        after_space = self.remove
        while at < len(data):
            if run := self.plain.match(data, at):
                out.append(run.group())
                places.append(np.arange(at, run.end()))
                at, after_space = run.end(), False
                continue
            new, size = self._unit(data, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                out.append(new)
                places.append(np.full(len(new), at))
                after_space = self.remove and new.endswith(b" ")
            at += size
        made, places = b"".join(out), np.concatenate(places)
        places = places[(np.frombuffer(made, np.uint8) & 0xC0) != 0x80]
        made = made.decode()
        if self.escape:
            made = made.replace(" ", SPACE)
        if self.remove:
            kept = made.rstrip(SPACE if self.escape else " ")
            if len(kept) < len(made):
                at = int(places[len(kept)])
                made, places = kept, places[: len(kept)]
        if self.dummy and self.suffix:
            made, places = made + (SPACE if self.escape else " "), np.append(places, at)
        return made, np.append(places, at)


class _Parts(dict):
    """Parts of normalised text to their ids, as bytes; long ones are not kept, and of the others those that were met lately."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part) or array("i", self.encode(part)).tobytes()
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT_PARTS // 2:
                self.turn()
            self[part] = ids
        return ids

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()


class PieceModel:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        self.scores, self.ids, special, kinds, self.unknown = {}, {}, {}, set(), 0
        for number, raw in fields:
            if number != 1:
                continue
            piece = dict(_fields(raw))
            name, score, kind = piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)
            here = len(self.ids) + len(special)
            kinds.add(kind)
            if kind == NORMAL:
                self.ids[name], self.scores[name] = here, score
            else:
                special[name] = here
                if kind == UNKNOWN:
                    self.unknown = here
        trainer = dict(_fields(b"".join(v for n, v in fields if n == 2)))
        if trainer.get(3, 1) != BPE or kinds & {USER_DEFINED, UNUSED} or not trainer.get(35, 0):
            raise ValueError(f"{path}: models of merged pairs with byte pieces, without user-defined or unused pieces, are read")
        self.bytes = [special[f"<0x{b:02X}>"] for b in range(256)]
        spec = dict(_fields(b"".join(v for n, v in fields if n == 3)))
        self.normalise = Normaliser(spec.get(2, b""), *(bool(spec.get(n, 1)) for n in (3, 4, 5)), bool(trainer.get(24, 0)))
        #: Pairs of characters that stand side by side in a piece: merges go over no others.
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        alone = "".join(chr(c) for c in range(128) if not any(chr(c) in p for p in self.pairs))
        alone = f"[{re.escape(alone)}]|" if alone else ""
        inner = any(p[1] == SPACE and p[0] != SPACE for p in self.pairs)
        mark = re.escape(SPACE)
        rest = alone[1:-2] if alone else ""
        self.part = re.compile("(?s).+" if inner else f"{alone}{mark}+[^{mark}{rest}]*|[^{mark}{rest}]+")
        self.parts = _Parts(self._encode_part)
        #: Pieces that fit each other, halves of pieces, their order of merging, and the longest piece by its first three characters.
        self.fitting, self.split, self.reach = {}, {}, {}
        self.rank = {p: k for k, p in enumerate(sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.scores[p]))}
        often = Counter(self.scores[p] for p in self.rank)
        #: Pieces that share their score with others: there the order of merges depends on places.
        self.tied = {p for p in self.rank if often[self.scores[p]] > 1}
        for p in self.rank:
            self.reach[p[:3]] = max(len(p), self.reach.get(p[:3], 2))
        #: Characters of each piece; those of byte pieces are told from their neighbours.
        self.table = self._pairs()
        self.sizes, self.byte = np.ones(len(self.ids) + len(special), np.int64), np.full(len(self.ids) + len(special), -1)
        self.sizes[list(self.ids.values())] = [len(p) for p in self.ids]
        self.byte[self.bytes] = np.arange(256)

    def _merged(self, word: str, most: int | None = None) -> list[str]:
        """Symbols after all merges of a word, best score first, then leftmost; or before its merge number ``most``."""
        symbols, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap, scores = [], self.scores

        def offer(i, j):
            new = symbols[i] + symbols[j]
            if new in scores:
                heapq.heappush(heap, (-scores[new], i, j, new))

        for i in range(len(word) - 1):
            offer(i, i + 1)
        done = 0
        while heap:
            _, i, j, new = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != new:
                continue
            done += 1
            if done == most:
                break
            symbols[i], symbols[j] = new, ""
            after[i] = after[j]
            if after[i] < len(symbols):
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [s for s in symbols if s]

    def _halves(self, piece: str):
        """What the last merge of a piece joins; None where its merges do not lead to it."""
        if piece not in self.split:
            symbols = self._merged(piece, len(piece) - 1)
            self.split[piece] = symbols if len(symbols) == 2 and self._merged(piece) == [piece] else None
        return self.split[piece]

    def _fits(self, left: str, right: str) -> bool:
        """Whether no merge goes over the border of two pieces that stand side by side; with no left one, whether the right one is whole.

        The pieces are taken apart again, the later merge first: what stands
        at the border then must not merge earlier than what was taken apart.
        """
        if len(right) > 1 and not self._halves(right):
            return False
        if not left or left[-1] + right[0] not in self.pairs:
            return True
        if left in self.tied or right in self.tied:
            return self._merged(left + right) == [left, right]
        rank, limit = self.rank, len(self.rank)
        while True:
            if rank.get(left + right, limit) < limit:
                return False
            a, b = (rank[x] if len(x) > 1 else -1 for x in (left, right))
            if a < 0 and b < 0:
                return True
            # of equal merges the left one comes first
            if a > b:
                limit, left = a, self._halves(left)[1]
            else:
                limit, right = b + 1, self._halves(right)[0]

    def pieces_of(self, part: str) -> list[str]:
        """What the merges of a part come to, without merging it.

        It is the one sequence of pieces in which every two neighbours merge
        to themselves alone: up to its first merge over a border a longer
        sequence behaves as the two pieces at that border do. So pieces are
        laid longest first, and taken back where nothing fits on; a place that
        was left is not tried again, as no other sequence leads there.
        """
        out, at, n, dead, known, fits, reach = [], 0, len(part), set(), self.ids, self.fitting, self.reach
        size = min(n, reach.get(part[:3], 2))
        while at < n:
            left = out[-1] if out else ""
            while size:
                piece = part[at : at + size]
                if (piece in known or size == 1) and at + size not in dead:
                    key = left, piece
                    good = fits.get(key)
                    if good is None:
                        if len(fits) >= KEPT_PARTS:
                            fits.clear()
                        good = fits[key] = self._fits(left, piece)
                    if good:
                        break
                size -= 1
            if size:
                out.append(piece)
                at += size
                size = min(n - at, reach.get(part[at : at + 3], 2))
            else:
                dead.add(at)
                size = len(out.pop())
                at -= size
                size -= 1
        return out

    def _encode_part(self, part: str) -> list[int]:
        ids = []
        for piece in self.pieces_of(part):
            found = self.ids.get(piece)
            if found is None:  # one character without a piece
                ids += [self.bytes[b] for b in piece.encode()]
            else:
                ids.append(found)
        return ids

    def _pairs(self):
        """Symbols of characters and of pieces, and what two of them join to: sorted keys and the joined symbol."""
        number = {p: k for k, p in enumerate(dict.fromkeys([*(c for p in self.ids for c in p), *self.rank]))}
        joined = sorted((number[p[:k]] * len(number) + number[p[k:]], number[p]) for p in self.rank for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        rank = np.full(len(number) + 1, len(number), np.int64)  # the last is no symbol
        first: dict = {}  # pieces of one score have one rank
        for p, k in self.rank.items():
            rank[number[p]] = first.setdefault(self.scores[p], k)
        chars = np.full(0x110000, len(number), np.int64)
        for c, k in number.items():
            if len(c) == 1:
                chars[ord(c)] = k
        ids = np.array([*(self.ids.get(p, -1) for p in number), -1], np.int64)
        return len(number), np.array([k for k, _ in joined], np.int64), np.array([v for _, v in joined], np.int64), rank, chars, ids

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The symbols that pairs join to; the number of symbols for those that do not join."""
        none, keys, values = self.table[:3]
        key = np.where((a < none) & (b < none) & (a >= 0) & (b >= 0), a * none + b, -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], none)

    def learn(self, parts: list[str]) -> None:
        """Encodes parts side by side, one merge of each at a time, and keeps them."""
        none, _, _, rank, chars, ids = self.table
        codes = chars[np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        symbols = np.full((len(parts), int(lengths.max()) + 1), -1, np.int64)
        symbols[np.arange(symbols.shape[1]) < lengths[:, None]] = codes
        row, done = np.arange(len(parts)), np.full_like(symbols, -1)
        joined = self._joined(symbols[:, :-1], symbols[:, 1:])
        cols = np.arange(joined.shape[1])
        while len(row):
            order = rank[joined]
            j = order.argmin(axis=1)  # the leftmost of equal ones
            go = order[np.arange(len(row)), j] < none
            done[row[~go]] = symbols[~go]
            row, symbols, joined, j = row[go], symbols[go], joined[go], j[go]
            r = np.arange(len(row))
            new = joined[r, j]
            later = cols > j[:, None]
            symbols[:, :-1] = np.where(later, symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            symbols[r, j] = new
            joined[:, :-1] = np.where(later[:, :-1], joined[:, 1:], joined[:, :-1])
            joined[:, -1] = none
            joined[r, j] = self._joined(new, symbols[r, j + 1])
            has = np.flatnonzero(j > 0)
            joined[has, j[has] - 1] = self._joined(symbols[has, j[has] - 1], new[has])
        there = done >= 0
        found = ids[np.where(there, done, none)]
        whole = ((found >= 0) | ~there).all(axis=1)
        counts = np.where(whole, there.sum(axis=1), 0)
        ends = (4 * np.cumsum(counts)).tolist()
        raw = found[there & whole[:, None]].astype(np.int32).tobytes()
        low = 0
        for part, end, ok in zip(parts, ends, whole.tolist()):
            if ok:  # characters without a piece are left to the way of single parts
                self.parts[part] = raw[low:end]
            low = end

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, offsets) of each text; offsets are bytes of it, one more than ids."""
        made = [self.normalise(t) for t in texts]
        split = [self.part.findall(m) for m, _ in made]
        parts, known, new = self.parts, {}, []
        for p in dict.fromkeys(chain.from_iterable(split)):
            if (ids := parts.get(p) or parts.before.get(p)) is None:
                new.append(p)
            else:
                known[p] = ids
        if len(parts) + len(known) + len(new) > KEPT_PARTS // 2:
            parts.turn()
        for low, high in ((1, 8), (8, 12), (12, 20), (20, 32)):
            some = [p for p in new if low < len(p) <= high]
            for k in range(0, len(some), 1 << 13):
                self.learn(some[k : k + (1 << 13)])
        known |= {p: parts[p] for p in new}
        parts |= {p: ids for p, ids in known.items() if len(p) <= KEPT_LENGTH}
        out = []
        for (text, places), found in zip(made, split):
            ids = np.frombuffer(b"".join(map(known.__getitem__, found)), np.int32)
            sizes, byte = self.sizes[ids], self.byte[ids]
            if (byte >= 0).any():  # a character ends where no byte of its follows
                follows = np.append((byte[1:] & 0xC0) == 0x80, False) & (np.append(byte[1:], -1) >= 0)
                sizes[(byte >= 0) & follows] = 0
            out.append((ids, places[np.concatenate([[0], np.cumsum(sizes)])] if text else np.zeros(1, np.int64)))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]), kind))


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row a document: doc_id, ids, offsets.

    Piece k stands for bytes ``offsets[k]`` to ``offsets[k + 1]`` of the text
    in UTF-8; a byte piece that is not its character's last for none. Null and
    empty texts have no ids and the one offset 0. Rows that repeat each get a
    row; other columns, whatever their names, are not looked at. A text is
    encoded whole, in memory in proportion to it. ``model`` is a file of
    merged pairs with byte pieces that every executor can open.
    """
    model = model or default_model()

    def run(batches):
        known = piece_model(model)
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                texts, size, high = [], 0, low
                while high < batch.num_rows and size < TOGETHER:
                    texts.append(batch.column(1)[high].as_py() or "")
                    size, high = size + len(texts[-1]), high + 1
                ids, offsets = zip(*known.encode_many(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), _lists(ids, pa.int32()), _lists(offsets, pa.int64())], ["doc_id", "ids", "offsets"])
                low = high

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, offsets array<long>")


def decoded(ids, model: str | None = None):
    """The text of a column of ids, as the library decodes it; null for null."""
    model = model or default_model()

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        library = _library(model)
        return pd.Series([None if r is None else library.decode(r.tolist()) if len(r) else "" for r in rows], dtype=object)

    return run(ids)


def op12_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"),
    )
