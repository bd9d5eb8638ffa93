"""Line dedup: a suffix array over line-ID sequences, by SQL functions alone.

A line's ID is its hash; IDs in numeric order are the alphabet. Suffixes are
ranked by prefix doubling: the rank at depth 2h is the rank at depth h,
refined within its group by the rank of the suffix h lines on. A rank is the
number of smaller suffixes, summed over pre-aggregated groups and in two
steps (buckets, then within a bucket), so no group meets in one task.
Suffixes alone in their group are dropped as they arise: their longest common
prefix with any other is shorter.

Suffixes of one rank at depth h are an interval of the suffix array whose
common prefix has at least h lines. For each line start the shortest run of
``min_words`` words is looked up as such an interval, at its exact length, by
two overlapping ranks; so is the shortest run that ends with each line. The
interval's first member in document order stays. All other members are later
copies; their union is exactly the union of all maximal repeated runs of at
least ``min_words`` words that occur earlier, and these lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, let, n_words, stored, table, whole_rows

#: Buckets of the two-step running sums, as bits: one row each meets in the first step, the rows of one in the second.
BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS


def _smaller(groups: DataFrame, within: list[str], order: str, bucket: Column) -> DataFrame:
    """Adds ``smaller``: the sum of ``n`` over rows of the same ``within`` with a smaller ``order``."""
    groups = groups.withColumn("__b", bucket)
    per = groups.groupBy(*within, "__b").agg(F.sum("n").alias("__n"))
    before = Window.partitionBy(*within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*within, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__own", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return groups.join(per, [*within, "__b"]).withColumn("smaller", F.col("__base") + F.col("__own")).drop("__b", "__base", "__own")


def _lines(docs: DataFrame) -> DataFrame:
    one = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).where("text is not null")
    rows = one.select("doc_id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("doc_id", "th", "pos", F.xxhash64("line").alias("lid"), n_words(F.col("line")).alias("w"))


def _first_ranks(docs: DataFrame) -> DataFrame:
    """Lines that occur more than once: doc_id, th, pos, w and rank at depth 1."""
    lines = _lines(docs)
    # rows that repeat a document are the same document: its lines are counted once
    ids = lines.groupBy("lid").agg(F.count("*").alias("n")).where("n > 1")
    ids = ids.withColumn("all", F.lit(0))
    ranked = stored(_smaller(ids, ["all"], "lid", F.shiftright("lid", 64 - BUCKET_BITS)).select("lid", F.col("smaller").alias("rank")), "ids")
    return lines.join(ranked, "lid").select("doc_id", "th", "pos", "w", "rank").distinct()


def _long_stretches(first: DataFrame, min_words: int) -> DataFrame:
    """Rows within stretches of repeated lines that hold ``min_words`` words, with running words c."""
    doc = Window.partitionBy("doc_id", "th").orderBy("pos")
    rows = first.withColumn("seg", F.col("pos") - F.row_number().over(doc))
    seg = Window.partitionBy("doc_id", "th", "seg")
    rows = rows.withColumn("total", F.sum("w").over(seg)).where(F.col("total") >= min_words)
    c = F.sum("w").over(seg.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "th", "seg", "pos", "w", "rank", c.alias("c"))


def _windows(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, pos, n_lines): the shortest runs of ``min_words`` words from, and up to, each line."""
    seg = ["doc_id", "th", "seg"]
    e = rows.select(*seg, F.lit(1).alias("end"), "pos", F.col("c").alias("v"))
    b = rows.select(*seg, F.lit(0).alias("end"), "pos", (F.col("c") - F.col("w")).alias("v"))
    # from line i: the first end at or above its start plus min_words
    ask = b.select(*seg, F.lit(0).alias("end"), "pos", (F.col("v") + min_words).alias("v"))
    down = Window.partitionBy(*seg).orderBy(F.desc("v"), F.desc("end"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    to = F.last(F.when(F.col("end") == 1, F.col("pos")), ignorenulls=True).over(down)
    from_each = ask.unionByName(e).withColumn("to", to).where("end = 0 and to is not null")
    # up to line t: the last start at or below its end minus min_words
    ask = e.select(*seg, F.lit(1).alias("end"), "pos", (F.col("v") - min_words).alias("v"))
    up = Window.partitionBy(*seg).orderBy("v", "end", "pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("end") == 0, F.col("pos")), ignorenulls=True).over(up)
    up_to = ask.unionByName(b).withColumn("start", start).where("end = 1 and start is not null")
    n = lambda a, z: (F.col(z) - F.col(a) + 1).alias("n_lines")
    return from_each.select("doc_id", "th", "pos", n("pos", "to")).unionByName(
        up_to.select("doc_id", "th", F.col("start").alias("pos"), n("start", "pos"))
    ).distinct()


def _deeper(ranks: DataFrame, h: int, total: int) -> DataFrame:
    """Ranks at depth 2h of the suffixes that share them with others."""
    ahead = ranks.select("doc_id", "th", (F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
    pairs = _same(ranks, ahead)
    groups = pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1")
    bucket = F.expr(f"next div {max(1, total // BUCKETS)}")
    refined = _smaller(groups, ["rank"], "next", bucket).select("rank", "next", (F.col("rank") + F.col("smaller")).alias("new"))
    refined = stored(refined, "refined")
    return stored(pairs.join(refined, ["rank", "next"]).select("doc_id", "th", "pos", F.col("new").alias("rank")), "ranks")


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Joins on the position; doc_id may be null."""
    b = b.withColumnsRenamed({"doc_id": "__d", "th": "__t", "pos": "__p"})
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__t")) & (F.col("pos") == F.col("__p"))
    return a.join(b, on).drop("__d", "__t", "__p")


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, th, pos): the lines that lie in later copies of repeated runs."""
    rows = stored(_long_stretches(_first_ranks(docs), min_words), "stretches")
    windows = stored(_windows(rows, min_words), "windows")
    total, longest = rows.agg(F.max("rank")).first()[0] or 0, windows.agg(F.max("n_lines")).first()[0] or 0
    ranks, h, later = rows.select("doc_id", "th", "pos", "rank"), 1, None
    while h <= longest:
        # windows of h to 2h-1 lines: equal exactly when two overlapping ranks at depth h are
        now = windows.where((F.col("n_lines") >= h) & (F.col("n_lines") < 2 * h))
        head = _same(now, ranks)
        tail = ranks.withColumnRenamed("rank", "tail")
        both = _same(head.withColumn("start", F.col("pos")).withColumn("pos", F.col("pos") + F.col("n_lines") - h), tail)
        at = F.struct("doc_id", "th", F.col("start").alias("pos"))
        both = stored(both.select("rank", "tail", "n_lines", at.alias("at")), "members")
        firsts = stored(both.groupBy("rank", "tail", "n_lines").agg(F.min("at").alias("first")), "intervals")
        copies = both.join(firsts, ["rank", "tail", "n_lines"]).where(F.col("at") != F.col("first"))
        copies = stored(copies.select("at.doc_id", "at.th", F.col("at.pos").alias("pos"), "n_lines"), "copies")
        drop_stored(both, firsts)
        covered = copies.select("doc_id", "th", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("n_lines") - 1)).alias("pos"))
        later = covered if later is None else later.unionByName(covered)
        if 2 * h > longest:
            break
        deeper = _deeper(ranks, h, total)
        drop_stored(ranks)
        ranks, h = deeper, 2 * h
    later = stored((rows.select("doc_id", "th", "pos").limit(0) if later is None else later).distinct(), "later")
    drop_stored(rows, windows, ranks)
    return later


def _deduped(docs: DataFrame, min_words: int) -> DataFrame:
    """row, kept (the text left), n_lines, removed and empty of every row of ``docs``."""
    gone = repeated_lines(docs.select("doc_id", "text"), min_words)
    gone = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list("pos")).alias("removed"))
    gone = stored(gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th"), "removed"), "removed")
    text = F.col("row.text")
    rows = whole_rows(docs).withColumn("th", F.xxhash64("row.text"))
    # few or many lines may go: texts are joined in the same way at every size
    rows = rows.join(gone.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")

    def without(parts: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("removed"))
        return F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")

    kept = F.when(F.col("removed").isNull(), text).otherwise(let(F.split(text, "\n", -1), without))
    n_lines = F.coalesce(F.regexp_count(text, F.lit("\n")) + 1, F.lit(0)).cast("long")
    out = rows.select("row", kept.alias("kept"), n_lines.alias("n_lines"), "removed")
    return out.withColumn("empty", F.col("removed").isNotNull() & (n_words(F.col("kept")) == 0))


def dedup_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, text with later copies of repeated line runs deleted, n_lines, removed, empty.

    ``removed`` are line numbers from 0, ascending, null where nothing went;
    ``empty`` says that deletion left no word. Null text stays null and has no
    lines; an empty text has one empty line. Rows that repeat doc_id and text
    are one document and get the same result. The first copy in order of
    doc_id (null first), then of text hash and line, stays. An empty table
    gives no rows. A text is split whole, in memory in proportion to it. Other
    columns, whatever their names, are not looked at.
    """
    return _deduped(docs, min_words).select("row.doc_id", F.col("kept").alias("text"), "n_lines", "removed", "empty")


def deduped_documents(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The columns of ``docs``, whatever their names; documents that deletion left without a word go.

    Where there is a column n_chars it is set to the new length.
    """
    out = _deduped(docs, min_words).where("not empty")
    new = {c: F.col(f"row.`{c}`").alias(c) for c in docs.columns}
    new["text"] = F.col("kept").alias("text")
    if "n_chars" in new:
        length = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("removed").isNotNull(), length).otherwise(F.col("row.n_chars")).alias("n_chars")
    return out.select(*new.values())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"),
        F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, pos, ls[pos + 1] AS line,
    CAST(len(regexp_extract_all(ls[pos + 1], '[^\x20\x09-\x0D]+')) AS BIGINT) AS w
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS pos FROM d)),
f AS (SELECT *, count(*) OVER (PARTITION BY line) AS n FROM l),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM f WHERE n > 1),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, seg ORDER BY pos) AS c FROM g),
p AS (SELECT a.doc_id, a.seg, a.pos AS b, z.pos AS e, row_number() OVER (PARTITION BY a.doc_id, a.pos ORDER BY z.pos) AS fr,
    row_number() OVER (PARTITION BY a.doc_id, z.pos ORDER BY a.pos DESC) AS bk
  FROM c a JOIN c z ON a.doc_id = z.doc_id AND a.seg = z.seg AND z.pos >= a.pos AND z.c - (a.c - a.w) >= 50),
w AS (SELECT DISTINCT doc_id, b, e FROM p WHERE fr = 1 OR bk = 1),
k AS (SELECT w.doc_id, b, e, string_agg(line, chr(10) ORDER BY pos) AS body FROM w JOIN l ON l.doc_id = w.doc_id AND l.pos BETWEEN b AND e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY body, e - b ORDER BY doc_id, b) AS turn FROM k),
x AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS pos FROM r WHERE turn > 1),
t AS (SELECT l.doc_id, count(x.pos) AS n_removed, coalesce(string_agg(CAST(x.pos AS VARCHAR), ',' ORDER BY x.pos), '') AS removed_lines,
    coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (x.pos IS NULL), '') AS kept
  FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(removed_lines, '') AS removed_lines, md5(coalesce(kept, '')) AS kept_md5
FROM d LEFT JOIN t USING (doc_id)
"""
