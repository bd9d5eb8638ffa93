"""Licence scan by patience alignment of texts with licence templates.

A template is covered to the share of its words that align, in order, with a
passage of the text. Alignment anchors on words that are unique in both,
keeps the longest increasing subsequence of anchors, and aligns the gaps
between them in the same way; a gap without unique words is aligned by its
longest common subsequence.

What tells licences apart is one word or two. So a short template must be
covered whole, and the phrases that name a licence and its version must stand
in the passage unbroken, whatever the rest is covered to.

All passages count, but only those are aligned that can win: one that is
covered enough misses few template words, so it holds one of the template's
words that are rarest in the text, it begins with a template word, and it has
as many template words in any order. A passage may be ``stretch`` times as
long as its template: words that stand between its own; a licence drawn out
further is taken for scattered words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table
from .licence_texts import PHRASES, TEMPLATES

#: Coverage of a licence at least, how many times its template's length a passage may be, and words up to which a template must be covered whole.
LEAST, STRETCH, SHORT = 0.8, 2.0, 20
_WORD = re.compile(WORD)
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: str) -> str:
    """Lower case without punctuation at the ends."""
    return _EDGES.sub("", word.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, that increases in the second."""
    tails, ends, back = [], [], []
    for n, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        if k == len(tails):
            tails.append(b)
            ends.append(n)
        else:
            tails[k], ends[k] = b, n
        back.append(ends[k - 1] if k else -1)
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, for gaps without unique words."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal words, increasing in both, by patience alignment."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = _increasing([(i, at[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in at])
        if not anchors:
            if in_a.keys() & in_b.keys():
                out += [(a0 + i, b0 + j) for i, j in _common(a[a0:a1], b[b0:b1])]
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    """A licence's words; ``phrases`` name it, and where each first stands in the template it must stand in a passage."""

    def __init__(self, name: str, text: str, least: float = LEAST, stretch: float = STRETCH, phrases: tuple = ()):
        self.name, self.words = name, _plain_words(text)
        self.counts, self.vocabulary = Counter(self.words), set(self.words)
        least = 1.0 if len(self.words) <= SHORT else least
        self.need = int(-(-len(self.words) * least // 1))
        #: Words of a passage at most.
        self.longest = int(len(self.words) * stretch)
        #: That many distinct words may be missing from a passage that is covered enough.
        self.spare = len(self.words) - self.need
        self.phrases = [self._first(_plain_words(p)) for p in phrases]

    def _first(self, phrase: list[str]) -> range:
        n = len(phrase)
        return next(range(k, k + n) for k in range(len(self.words) - n + 1) if self.words[k : k + n] == phrase)

    def possible(self, words: set[str]) -> bool:
        return len(self.vocabulary) - len(self.vocabulary & words) <= self.spare

    def named(self, pairs: list[tuple[int, int]]) -> bool:
        at = dict(pairs)
        return all(p[0] in at and all(at.get(k) == at[p[0]] + k - p[0] for k in p) for p in self.phrases)

    def aligned(self, passage: list[str]) -> list[tuple[int, int]]:
        """The aligned pairs of a passage that is covered enough and named, or none."""
        pairs = align(self.words, passage)
        return pairs if len(pairs) >= self.need and self.named(pairs) else []

    def best(self, words: list[str]):
        """(matched, first, last) of the passage with most aligned words, the first of equal ones, or None."""
        found, where = None, {}
        for p, w in enumerate(words):
            if w in self.vocabulary:
                where.setdefault(w, []).append(p)
        rare = sorted(self.vocabulary, key=lambda w: (len(where.get(w, ())), w))[: self.spare + 1]
        near = {b for w in rare for p in where.get(w, ()) for b in range(max(0, p - self.longest + 1), p + 1)}
        for start in sorted(b for b in near if words[b] in self.vocabulary):
            passage = words[start : start + self.longest]
            there = sum((Counter(passage) & self.counts).values())
            if there < self.need or (found and there <= found[0]):
                continue
            pairs = self.aligned(passage)
            if pairs and (found is None or len(pairs) > found[0]):
                found = (len(pairs), start + pairs[0][1], start + pairs[-1][1])
        return found


def _plain_words(text: str) -> list[str]:
    return [w for w in map(plain, _WORD.findall(text)) if w]


def find_licences(text: str, templates: list[Template]) -> list[tuple]:
    """(name, coverage, matched, start, end) of every template found in a text, most matched words first, then by coverage and name."""
    vocabulary = set().union(*(t.vocabulary for t in templates))
    there = vocabulary.intersection(map(plain, set(text.lower().split())))
    likely = [t for t in templates if t.possible(there)]
    if not likely:
        return []
    found = [(w, m.start(), m.end()) for m in _WORD.finditer(text) if (w := plain(m.group()))]
    words, spans = [w for w, _, _ in found], [(b, e) for _, b, e in found]
    hits = []
    for t in likely:
        if got := t.best(words):
            matched, first, last = got
            hits.append((t.name, matched / len(t.words), matched, spans[first][0], spans[last][1]))
    return sorted(hits, key=lambda h: (-h[2], -h[1], h[0]))


_HIT = [("licence", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64())]
_NAMES = [n for n, _ in _HIT]
HIT = "licence string, coverage double, matched long, span_start long, span_end long"


def known_templates(templates: dict[str, str] | None = None, least: float = LEAST, stretch: float = STRETCH, phrases: dict[str, tuple] | None = None) -> list[Template]:
    phrases = PHRASES if templates is None else (phrases or {})
    return [Template(k, v, least, stretch, phrases.get(k, ())) for k, v in (templates or TEMPLATES).items()]


def scan_licences(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, stretch: float = STRETCH, phrases: dict[str, tuple] | None = None) -> DataFrame:
    """One row a document: doc_id, licence, coverage, matched, span_start, span_end, n_licences, licences.

    ``licences`` has every template that is found, with its best passage; the
    first of them, with most matched words, is the licence. Of equal ones the
    one that is covered further comes first, then the first by name. Spans are
    in code points, their ends exclusive. ``phrases`` are those of
    ``templates`` that must stand unbroken.

    Without a template, and for null or empty texts, licence and span are
    null, the counts 0 and the list empty. Rows that repeat each get a row, an
    empty table gives none. A text is looked at whole, in memory in proportion
    to it. Other columns, whatever their names, are not looked at.
    """
    known = known_templates(templates, least, stretch, phrases)

    def run(batches):
        for batch in batches:
            found = [find_licences(t, known) if t else [] for t in batch.column(1).to_pylist()]
            first = [f[0] if f else (None, 0.0, 0, None, None) for f in found]
            columns = [pa.array([f[k] for f in first], kind) for k, (_, kind) in enumerate(_HIT)]
            hits = pa.array([[dict(zip(_NAMES, h)) for h in f] for f in found], pa.list_(pa.struct(_HIT)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([len(f) for f in found], pa.int64()), hits], ["doc_id", *_NAMES, "n_licences", "licences"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {HIT}, n_licences long, licences array<struct<{HIT.replace(' ', ': ').replace(',:', ',')}>>")


def op6_license_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))
