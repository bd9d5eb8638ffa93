"""Suffix trees of whole-number sequences, and longest common extensions by them."""

from __future__ import annotations

import numpy as np


class SuffixTree:
    """Ukkonen's tree of ``text``, positive whole numbers; 0 ends it.

    ``walk`` goes around the tree; of the tour only the leaves are kept and
    the shallowest node between neighbours, which is their lowest common
    ancestor. Its minima over 2^k neighbours give the ancestor of any two
    leaves in constant time.
    """

    def __init__(self, text: list[int]):
        text = [*text, 0]
        n, self.sigma = len(text), max(text) + 1
        sigma = self.sigma
        first, last, link, go, leaf = [0], [0], [0], {}, [-1]
        node = edge = length = rest = suffix = 0
        for i, c in enumerate(text):
            rest += 1
            need = 0
            while rest:
                if not length:
                    edge = i
                key = node * sigma + text[edge]
                child = go.get(key)
                if child is None:
                    go[key] = len(first)
                    if need:
                        link[need] = node
                        need = 0
                else:
                    low = first[child]
                    size = (last[child] if leaf[child] < 0 else i + 1) - low
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if text[low + length] == c:
                        length += 1
                        if need:
                            link[need] = node
                        break
                    middle = len(first)
                    go[key] = middle
                    first.append(low)
                    last.append(low + length)
                    link.append(0)
                    leaf.append(-1)
                    first[child] = low + length
                    go[middle * sigma + text[low + length]] = child
                    go[middle * sigma + c] = middle + 1
                    if need:
                        link[need] = middle
                    need = middle
                first.append(i)
                last.append(n)
                link.append(0)
                leaf.append(suffix)
                suffix += 1
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        self.n, self.leaf = n - 1, leaf
        keys = np.fromiter(go.keys(), np.int64, len(go))
        self._symbol = keys % sigma
        self._parent, self._child = keys // sigma, np.fromiter(go.values(), np.int64, len(go))
        self._size = np.asarray(last, np.int64) - np.asarray(first, np.int64)

    def walk(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, common): each suffix's rank, children in order of ``weight[symbol]``; and the common prefix of neighbours in rank."""
        order = np.lexsort((-weight[self._symbol], self._parent))
        child = self._child[order].tolist()
        bounds = np.searchsorted(self._parent[order], np.arange(len(self.leaf) + 1)).tolist()
        size, leaf = self._size.tolist(), self.leaf
        leaves, common = [], []
        stack, depths, shallow = [0], [0], -1
        while stack:
            x, d = stack.pop(), depths.pop()
            if shallow < 0:
                shallow = d  # where the walk turns after a leaf
            if leaf[x] >= 0:
                leaves.append(leaf[x])
                common.append(shallow)
                shallow = -1
            else:
                below = child[bounds[x] : bounds[x + 1]]
                stack += below
                depths += [d + size[x]] * len(below)
        rank = np.empty(len(leaves), np.int64)
        rank[leaves] = np.arange(len(leaves))
        return rank, np.array(common, np.int64)


class Extensions:
    """Longest common prefixes of any two suffixes, from ``walk``."""

    def __init__(self, rank: np.ndarray, common: np.ndarray):
        self.rank, self.least = rank, [common.astype(np.int32)]
        while 2 << (len(self.least) - 1) <= len(common):
            low, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For positions ``a`` and ``b``, nowhere equal."""
        ra, rb = self.rank[a], self.rank[b]
        low, high = np.minimum(ra, rb) + 1, np.maximum(ra, rb) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(low), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            least = self.least[k]
            out[at] = np.minimum(least[low[at]], least[high[at] - (1 << int(k))])
        return out
