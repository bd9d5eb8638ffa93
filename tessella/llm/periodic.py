"""Periodic runs of words, by longest common extensions in suffix trees.

A run is a longest stretch of words with a smallest period. By the runs
theorem its period is the length of a Lyndon word that is the longest one to
begin at its place, in the order of the words or in the reverse order. So every
place gives two candidates, found from the ranks of suffixes; each is extended
to the right in Ukkonen's tree of the document and to the left in the tree of
its reversal.

Before that, places that no run can cover are left out. In a run of ``least``
words and ``repeats`` periods every stretch of ``window`` words occurs again,
one period away; windows that occur once in the document, by a hash that can
only find too many alike, are in no run.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table
from .suffix_tree import Extensions, SuffixTree

#: Words of a run, and its periods, at least; words of a window that must recur.
LEAST, REPEATS, WINDOW = 24, 3, 8
_WORD = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def recurring(words: list[str], least: int = LEAST, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches [begin, end) of ``least`` words or more, all windows of which occur twice or more.

    They cover every run of ``least`` words and three periods if least >= 3 * window: such a run is
    longer than two periods and a window, so each window in it has its like a period before or after.
    """
    n = len(words) - window + 1
    if n < least - window + 1:
        return []
    h = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed = mixed * _MIX + h[k : k + n]
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    again = np.zeros(n + 2, np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    edge = np.diff(again)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(b), int(e) + window - 1) for b, e in zip(begin, end) if e - b >= least - window + 1]


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each position the next one of a smaller rank, or the end."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank.tolist()):
        while stack and stack[-1][1] > r:
            out[stack.pop()[0]] = i
        stack.append((i, r))
    return np.array(out, np.int64)


def runs_of(words: list, least: int = LEAST, repeats: int = REPEATS, stretches: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, in order; ``stretches`` hold them all, else the whole is searched.

    ``repeats`` is 2 at least: below that the theorem does not hold.
    """
    if repeats < 2:
        raise ValueError("a run has two periods at least")
    stretches = [(0, len(words))] if stretches is None else stretches
    if not sum(b - a for a, b in stretches):
        return []
    # every stretch ends with a number of its own, below all words': nothing extends over it
    ids, cuts, text, place = {}, len(stretches), [], []
    for k, (a, b) in enumerate(stretches):
        text += [cuts + 1 + ids.setdefault(w, len(ids)) for w in words[a:b]]
        text.append(k + 1)
        place += [*range(a, b), -1]
    n, place = len(text), np.array(place, np.int64)
    tree, back = SuffixTree(text), SuffixTree(text[::-1])
    rising = np.arange(tree.sigma)
    falling = np.where(rising > cuts, cuts + tree.sigma - rising, rising)
    rank, common = tree.walk(rising)
    right, left = Extensions(rank, common), Extensions(*back.walk(rising))
    found: set = set()
    for order in (rank, tree.walk(falling)[0]):
        smaller = _next_smaller(order[:n])
        at = np.flatnonzero((place >= 0) & (smaller < n))
        at = at[place[smaller[at]] >= 0]  # one that reaches to the stretch's end cannot repeat
        nxt = smaller[at]
        period = nxt - at
        end = nxt + right(at, nxt)
        start, inner = at.copy(), np.flatnonzero(at > 0)
        # reversed, position i is n - 1 - i; the words before both
        start[inner] -= left(n - at[inner], n - nxt[inner])
        keep = end - start >= np.maximum(least, repeats * period)
        found.update(zip(place[start[keep]].tolist(), (end - start)[keep].tolist(), period[keep].tolist()))
    return sorted((s, size, p) for s, size, p in found)


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that a run contains after its first period."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    return " ".join([w for w, g in zip(words, np.cumsum(gone).tolist()) if not g])


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """One row a document: doc_id, n_words, runs (start, length and period in words, in order), collapsed.

    ``collapsed`` is the text with one period of each run left, its words
    joined by single spaces. Null and empty texts have no words, no runs and
    an empty collapsed text. Rows that repeat each get a row; other columns,
    whatever their names, are not looked at. A text is searched whole, in
    memory in proportion to it. ``repeats`` is 3 at least.
    """
    if repeats < 3 or least < 3 * WINDOW:
        raise ValueError(f"runs have 3 periods and {3 * WINDOW} words at least")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = []
                for text in part.column(1):
                    words = _WORD.findall(text.as_py() or "")
                    stretches = recurring(words, least)
                    runs = runs_of(words, least, repeats, stretches) if stretches else []
                    out.append((len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed(words, runs)))
                columns = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], RUN), pa.array(columns[2], pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _planted(doc_id: Column, text: Column) -> Column:
    """The query's text: of every tenth hash of an id, words repeat from some place on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def repeat(x: Column) -> Column:
        n = F.size(x["w"]).cast("long")
        first = x["g"] % n
        period = 1 + F.call_function("div", n - first, 3 + x["g"] % 8)
        at = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(x["w"], at(i).cast("int"))), " ")

    whole = let(F.struct(words.alias("w"), F.call_function("div", h, F.lit(10).cast("long")).alias("g")), repeat)
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(WORD)), whole).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"]) | a["period"].isNull()
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), "collapsed", F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"))
    milli = F.call_function("div", 1000 * F.col("b.length"), F.col("b.period"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", milli.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce([xor(s, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS h FROM documents),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e),
g AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM f),
x AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM g),
m AS (SELECT a.doc_id, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS part
  FROM x a JOIN x b ON b.doc_id = a.doc_id AND b.w = a.w AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
r0 AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM r0 GROUP BY doc_id, start, length),
s AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
better AS (SELECT a.*, (SELECT count(*) FROM r z WHERE z.doc_id = a.doc_id AND (z.length * a.period > a.length * z.period
    OR z.length * a.period = a.length * z.period AND (z.start < a.start OR z.start = a.start AND z.period < a.period))) AS k FROM r a),
best AS (SELECT doc_id, start, length, period FROM better WHERE k = 0),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT g.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM g LEFT JOIN s USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
