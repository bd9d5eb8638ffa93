"""Audit of how far the sources of a language differ in their words.

Terms are counted in chunks of texts with numpy. A term of up to 8 bytes is one
unsigned 64-bit word, of up to 16 bytes two: big-endian, padded with zero
bytes, which no term holds. Words are radix-sorted in digits of 16 bits and
their runs counted. Longer terms are sorted as bytes in buckets by length. Spark
adds up the runs by (lang, source, term), dealt by (lang, term).

Sources are then compared in tiles: the terms of a language are dealt to
buckets, and a bucket adds up what each pair of sources differs by in its
terms. So neither a term's sources nor a source's terms meet in one place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Documents in which a term must occur, ranks of terms, units of a share, bytes of text sorted at a time.
LEAST_DOCS, TOP, UNITS, CHUNK = 3, 200, 1_000_000_000, 8 << 20
#: Cells (sources x terms) of a tile, terms of a tile at most where sources are many, and parts of a hot source in joins.
CELLS, TILE_TERMS, SALTS = 65_536, 1024, 64

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LETTER = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)


def radix_order(keys: list[np.ndarray]) -> np.ndarray:
    """The stable order by ``keys``, the last of which weighs most; unsigned words, by digits of 16 bits."""
    order = np.arange(len(keys[0]))
    for key in keys:
        for shift in range(0, 8 * key.dtype.itemsize, 16):
            digit = ((key >> np.array(shift, key.dtype)) & np.array(0xFFFF, key.dtype)).astype(np.uint16)
            if len(digit) and digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the terms in UTF-8 bytes; no term goes from one text, bounded by ``offsets``, into another."""
    letter = _LETTER[data]
    before, after = np.roll(letter, 1), np.roll(letter, -1)
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1


def _word(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes [at, at + size) as the high bytes of one word; ``size`` is 0 to 8, ``data`` has 8 bytes to spare."""
    raw = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    drop = (8 * (8 - size)).astype(np.uint64)
    word = np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64)
    return np.where(size > 0, (word >> np.minimum(drop, np.uint64(63))) << np.minimum(drop, np.uint64(63)), np.uint64(0))


def _runs(change: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, n, docs) of the runs that begin where ``change`` is set; documents of a run are in order."""
    first = np.flatnonzero(change)
    n = np.diff(np.append(first, len(change)))
    new = change.copy()
    new[1:] |= doc[1:] != doc[:-1]
    return first, n, np.add.reduceat(new.astype(np.int64), first) if len(first) else n


def _strings(parts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Rows of bytes, of which the first ``sizes`` count, as strings."""
    keep = np.arange(parts.shape[1])[None, :] < sizes[:, None]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(parts[keep].tobytes())])


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray):
    """Yields (group, terms, counts, documents) of bytes ``data``; text k is ``offsets`` k to k + 1 and belongs to ``group[k]``."""
    begin, end = term_spans(data, offsets)
    size = end - begin
    data = np.concatenate([_LOWER[data], np.zeros(16, np.uint8)])
    doc = np.searchsorted(offsets[1:], begin, side="right")
    of = group[doc].astype(np.uint32)
    for low, high in ((0, 8), (8, 16)):  # short terms: one word, two words
        at = np.flatnonzero((size > low) & (size <= high))
        if not len(at):
            continue
        words = [_word(data, begin[at] + 8 * k, np.clip(size[at] - 8 * k, 0, 8)) for k in range(high // 8)]
        order = radix_order([*words[::-1], of[at]])
        words, sizes, docs, groups = [w[order] for w in words], size[at][order], doc[at][order], of[at][order]
        change = np.ones(len(order), bool)
        change[1:] = groups[1:] != groups[:-1]
        for w in words:
            change[1:] |= w[1:] != w[:-1]
        first, n, n_docs = _runs(change, docs)
        raw = np.concatenate([w[first].astype(">u8").view(np.uint8).reshape(-1, 8) for w in words], axis=1)
        yield groups[first], _strings(raw, sizes[first]), n, n_docs
    longest = int(size.max()) if len(size) else 0
    low = 16
    while low < longest:  # long terms: a bucket a doubling of the length
        at = np.flatnonzero((size > low) & (size <= 2 * low))
        low *= 2
        if not len(at):
            continue
        terms = np.array([data[b:e].tobytes() for b, e in zip(begin[at], end[at])], dtype=f"S{low}")
        order = np.lexsort((terms, of[at]))
        terms, docs, groups = terms[order], doc[at][order], of[at][order]
        change = np.ones(len(order), bool)
        change[1:] = (groups[1:] != groups[:-1]) | (terms[1:] != terms[:-1])
        first, n, n_docs = _runs(change, docs)
        yield groups[first], pa.array([t.decode() for t in terms[first].tolist()], pa.large_string()), n, n_docs


def _counted(batches, chunk: int):
    """Arrow batches of (lang, source, text) to batches of (lang, source, term, n, docs)."""

    def flush(held):
        if not held:
            return
        texts = pa.chunked_array([b.column(2).cast(pa.large_string()) for b in held]).combine_chunks()
        names: dict = {}
        pairs = [p for b in held for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        group = np.array([names.setdefault(p, len(names)) for p in pairs], dtype=np.int64)
        _, ends, raw = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
        langs, sources = (pa.array(x, pa.string()) for x in zip(*names))
        for of, terms, n, docs in count_terms(data, ends - ends[0], group):
            for a in range(0, len(of), 1 << 16):
                part = slice(a, a + (1 << 16))
                take = pa.array(of[part].astype(np.int64))
                term = terms.slice(a, 1 << 16)
                yield pa.RecordBatch.from_arrays([langs.take(take), sources.take(take), term.cast(pa.string()), pa.array(n[part].astype(np.int64)), pa.array(docs[part].astype(np.int64))], ["lang", "source", "term", "n", "docs"])

    held, size = [], 0
    for batch in batches:
        sizes, low = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64), 0
        while low < batch.num_rows:
            ends = size + np.cumsum(sizes[low:])
            high = low + min(int(np.searchsorted(ends, chunk)) + 1, len(ends))
            held.append(batch.slice(low, high - low))
            size, low = int(ends[high - low - 1]), high
            if size >= chunk:
                yield from flush(held)
                held, size = [], 0
    yield from flush(held)


def term_counts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with one, as many rows a term as chunks hold it.

    Null text, lang and source count as ''. A chunk is of whole texts and has ``chunk`` bytes, or one text more.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(lambda batches: _counted(batches, chunk), "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (count + 1) / (total + terms)), exact below 9e15: divided in three steps."""
    rest, of, out = count + 1, total + terms, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + _div(rest, of)
        rest = rest % of
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def _np_share(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    rest, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // of, rest % of
    return out + 1


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Kept terms and groups, stored.

    The first: (lang, source, term, n, n_lang), terms in ``least_docs``
    documents of their language. The second: (lang, source, total, total_lang,
    terms, sources), every group of the table, zeros where no term is kept.
    """
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"n_lang": F.sum("n").over(w), "docs": F.sum("docs").over(w), "lead": F.row_number().over(w.orderBy("source")) == 1})
    kept = stored(counts.where(F.col("docs") >= least_docs).drop("docs"), "terms")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    per = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("terms"))
    groups = stored(groups.join(per, ["lang", "source"], "left").fillna(0), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"), F.sum("terms").alias("terms"), F.count("*").alias("sources"))
    return kept.drop("lead"), stored(groups.drop("terms").join(langs, "lang"), "groups")


def _tile(lang: str, pdf: pd.DataFrame) -> pd.DataFrame:
    """What each pair of sources differs by in the terms of one tile."""
    marks = pdf["term"].isna()
    about = pdf[marks].sort_values("source")
    sources = about["source"].tolist()
    of = about["n"].to_numpy(np.int64) + about["terms"].to_numpy(np.int64)
    index = {s: k for k, s in enumerate(sources)}
    body = pdf[~marks]
    codes, terms = pd.factorize(body["term"])
    counts = np.zeros((len(sources), len(terms)), dtype=np.int64)
    counts[[index[s] for s in body["source"]], codes] = body["n"].to_numpy(np.int64)
    # without kept terms there is nothing to divide by
    p = _np_share(counts, np.maximum(of, 1)[:, None])
    out = []
    for k, name in enumerate(sources):
        d = p[k] - p
        out.append(pd.DataFrame({"source": name, "item": sources, "value": (d * d // p).sum(axis=1)}).drop(index=k))
    return pd.concat(out).assign(lang=lang)[["lang", "source", "item", "value"]]


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank): how sources of a language differ.

    Part ``pair`` has every other source of the language, by the summed
    divergence over all kept terms; part ``term`` the source's terms that are
    commoner there than in the whole language, ``top`` ranks. Both are in order
    of value, largest first, then of the item's bytes. All is whole numbers.

    Null text, lang and source count as ''; an empty text adds its group
    alone, and a lang without kept terms has pairs of value 0. Rows that
    repeat a doc_id are documents of their own. An empty table gives no rows.
    Other columns, whatever their names, are not looked at. A text is split
    whole, in memory in proportion to it.
    """
    kept, groups = kept_terms(docs, least_docs)
    # a source may hold a third of all terms: its rows are dealt to salts
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    about = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = kept.withColumn("salt", salt).join(about, ["lang", "source", "salt"]).drop("salt")

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    scored = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    scored = scored.select("lang", "source", "item", divergence(F.col("p"), F.col("q")).alias("value"))

    per_tile = F.greatest(_div(F.lit(cells).cast("long"), F.col("sources")), F.least(F.col("sources"), F.lit(TILE_TERMS).cast("long")))
    tiles = F.greatest(F.ceil(F.col("terms") / per_tile), F.lit(1)).cast("long")
    body = rows.where("sources > 1").select("lang", F.pmod(F.xxhash64("term", F.lit(1)), tiles).alias("tile"), "source", "term", "n", "terms")
    heads = groups.where("sources > 1").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("tile"), "source", F.lit(None).cast("string").alias("term"), F.col("total").alias("n"), "terms")
    sums = body.unionByName(heads).groupBy("lang", "tile").applyInPandas(lambda key, pdf: _tile(key[0], pdf), "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    out = ranked(pairs, "pair").unionByName(ranked(scored, "term").where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g0 AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT g0.lang, g0.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total, any_value(coalesce(v, 0)) AS v FROM g0 LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = g0.lang AND c.source = g0.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + 1000000000 * CAST(coalesce(n, 0) + 1 AS HUGEINT) // (total + v) AS p
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
q AS (SELECT c.lang, term, 1 + 1000000000 * CAST(sum(n) + 1 AS HUGEINT) // (any_value(tot) + any_value(v)) AS q FROM c JOIN v USING (lang)
  JOIN (SELECT lang, CAST(sum(n) AS HUGEINT) AS tot FROM c GROUP BY lang) USING (lang) GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s, 0) AS value FROM g0 a JOIN g0 b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN
  (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS s FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
  ON z.lang = a.lang AND z.source = a.source AND z.other = b.source),
term AS (SELECT p.lang, p.source, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
