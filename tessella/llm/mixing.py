"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash. Words are summed by source and leading
hash bits; running sums show in which bucket a source's budget ends. Only
the documents of that boundary bucket are looked at again, by the next bits,
until one hash value is left. A document is in the mix when its hash is at
most its source's threshold: a filter, without sorting documents. Thresholds
nest: a larger budget takes a superset. Rows that repeat doc_id and text share
a hash; where the budget ends among them, as many as come nearest are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, n_words, null_key, stored, table, whole_rows

HASH_BITS, STEP_BITS = 60, 10
#: Thresholds are dealt to this many salts, so a hot source never meets in one task.
SALTS = 64


def hash60(doc_id: Column, text: Column) -> Column:
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """(skey, source, size) -> (skey, source_size, target), one row a source.

    Sources by code point, null last, take the weights in turn and share all
    words; none gets above ``cap`` times its size, the excess goes to the
    others by weight. Sorted by cap over weight the full sources are a prefix,
    so one pass of running sums finds the level. There is one row a source here.
    """
    by = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", pick).withColumn("most", (F.lit(cap) * F.col("source_size")).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
    by = by.withColumn("all_weight", F.sum("weight").over(everything))
    used = F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    gone = F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    by = by.withColumn("level", (F.col("all_words") - used) / (F.col("all_weight") - gone))
    by = by.withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    open_level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * open_level["level"])
    return by.select("skey", "source_size", F.least(target, F.col("most")).alias("target"))


def thresholds(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """(skey, size, h), (skey, source_size, target) -> targets with copies, threshold, edge and edge_rows.

    Each document is taken ``copies`` times, and once more when h <= threshold;
    so are ``edge_rows`` of the rows that have the hash ``edge``, at which the
    rest of the budget runs out: as many as bring the sum nearest to the budget.
    """
    size = F.col("source_size")
    copies = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * size)
    spark = narrow.sparkSession
    known = None
    open_docs = narrow
    left = targets.select("skey", "rest")
    for low in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        bucket = F.shiftright("h", low)
        hist = open_docs.groupBy("skey", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n"), F.min("h").alias("h_min"), F.max("h").alias("h_max")
        )
        upto = F.sum("words").over(Window.partitionBy("skey").orderBy("bucket"))
        hist = hist.withColumn("upto", upto).join(left, "skey").where(F.col("upto") > F.col("rest"))
        edge = hist.groupBy("skey").agg(F.min_by(F.struct("bucket", "words", "n", "upto", "rest", "h_min", "h_max"), "bucket").alias("e"))
        edge = stored(edge.select("skey", "e.*"), "edge")
        before = F.col("upto") - F.col("words")
        one = F.col("h_min") == F.col("h_max")
        # all rows of one hash have one size
        size, under = F.col("words") / F.col("n"), F.col("rest") - before
        rows = F.floor(under / size)
        rows = rows + (((rows + 1) * size - under) < (under - rows * size)).cast("long")
        done = edge.where(one).select("skey", (F.col("h_min") - 1).alias("threshold"), F.col("h_min").alias("edge"), rows.alias("edge_rows"), (F.col("n") > 1).alias("edge_shared"))
        known = done if known is None else known.unionByName(done)
        more = edge.where(~one)
        if low == 0 or more.isEmpty():
            break
        left = more.select("skey", (F.col("rest") - before).alias("rest"))
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        keys = more.select("skey", "bucket", salt.alias("salt"))
        open_docs = open_docs.withColumn("bucket", bucket).withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int"))
        open_docs = stored(open_docs.join(keys, ["skey", "bucket", "salt"]).select("skey", "size", "h"), "boundary")
    # a budget that no bucket exceeds takes every document, an empty one none
    whole = F.when(F.col("rest") > 0, F.lit((1 << HASH_BITS) - 1)).otherwise(F.lit(-1))
    found = targets.join(known, "skey", "left").withColumn("threshold", F.coalesce("threshold", whole))
    # where all rows of the edge are taken, or none, nothing has to be counted there
    all_rows = F.coalesce(F.col("edge_rows") > 0, F.lit(False)) & ~F.coalesce("edge_shared", F.lit(False))
    found = found.withColumn("threshold", F.when(all_rows, F.col("edge")).otherwise(F.col("threshold")))
    edge = F.when(F.coalesce("edge_shared", F.lit(False)), F.col("edge")).otherwise(F.lit(-1))
    return stored(found.select("skey", "source_size", "target", "copies", "threshold", edge.alias("edge"), F.coalesce("edge_rows", F.lit(0)).alias("edge_rows")), "thresholds")


def _decide(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds times, and the limits, to rows that have skey and h."""
    salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = docs.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["skey", "salt"])
    out = out.withColumn("times", F.col("copies") + (F.col("h") <= F.col("threshold")).cast("long"))
    if limits.where("edge >= 0").isEmpty():
        return out
    at_edge = F.col("h") == F.col("edge")
    plain, shared = out.where(~at_edge), out.where(at_edge)
    # equal rows, maybe most of a source: they are numbered by partition, and partitions by running sums
    shared = stored(shared.withColumn("number", F.monotonically_increasing_id()).withColumn("part", F.shiftright("number", 33)), "edge")
    per = shared.groupBy("skey", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("skey", "part", F.coalesce(before, F.lit(0)).alias("before"))
    turn = F.row_number().over(Window.partitionBy("skey", "part").orderBy("number"))
    shared = shared.withColumn("turn", turn).join(per, ["skey", "part"])
    once_more = (F.col("before") + F.col("turn") <= F.col("edge_rows")).cast("long")
    shared = shared.withColumn("times", F.col("copies") + once_more)
    return plain.unionByName(shared.select(*plain.columns))


def _hashed(docs: DataFrame) -> DataFrame:
    """row, and skey, h and size of it."""
    rows = whole_rows(docs)
    text = F.col("row.text")
    return rows.withColumns({"skey": null_key(F.col("row.source")), "h": hash60(F.col("row.doc_id"), text), "size": n_words(text)})


def mix_plan(docs: DataFrame, weights=(1, 2, 3), cap: int = 3) -> tuple[DataFrame, DataFrame]:
    """The hashed narrow rows, stored, and each source's threshold."""
    narrow = _hashed(docs.select("doc_id", "text", "source")).select("row.doc_id", "row.source", "skey", "h", "size")
    narrow = stored(narrow, "hashed")
    targets = stored(source_targets(narrow.select("skey", "source", "size", "h"), weights, cap), "targets")
    limits = thresholds(narrow.select("skey", "size", "h"), targets)
    drop_stored(targets)
    return narrow, limits


def mix_sources(docs: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, source, times.

    Null and empty texts have size 0; null is a source of its own, the last.
    Rows that repeat doc_id and text are documents of their own: of those at a
    source's edge as many are taken as its budget asks for. An empty table
    gives no rows. Texts of any length are hashed and counted whole. Other
    columns of ``docs``, whatever their names, are not looked at.
    """
    narrow, limits = mix_plan(docs, weights, cap)
    out = _decide(narrow, limits)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "source", "times")


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: rows of ``docs`` with all columns, whatever their names, repeated as often as taken.

    Documents without words weigh nothing and are taken ``copies`` times or more
    like the others of their source; those of sources without any words stay once.
    """
    narrow, limits = mix_plan(docs, weights, cap)
    drop_stored(narrow)
    out = _decide(_hashed(docs), limits)
    times = F.when(F.col("source_size") == 0, F.lit(1)).otherwise(F.col("times")).cast("int")
    out = out.where(times > 0).select("row", F.explode(F.array_repeat(F.lit(0), times)))
    return out.select("row.*")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("source")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w,
    3.0::DOUBLE * source_size AS most FROM s0),
s2 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER o, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lvl FROM s1
  WINDOW o AS (ORDER BY most / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, most <= w * lvl AS filled FROM s2),
s4 AS (SELECT *, CASE WHEN filled THEN most ELSE w * (SELECT arg_min(lvl, most / w) FROM s3 WHERE NOT filled) END AS target FROM s3),
s5 AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS q FROM s4),
c AS (SELECT d.*, s5.source_size, s5.target, s5.q, s5.target - s5.q * s5.source_size AS rest,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h) AS BIGINT) AS upto,
    CAST(sum(size) OVER (PARTITION BY d.source, h) AS BIGINT) AS own,
    count(*) OVER (PARTITION BY d.source, h) AS same, row_number() OVER (PARTITION BY d.source, h) AS turn
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
e AS (SELECT source, min(h) AS h FROM c WHERE upto > rest GROUP BY source),
t AS (SELECT c.*, e.h AS eh, own / same AS one, rest - (upto - own) AS under FROM c LEFT JOIN e ON c.source IS NOT DISTINCT FROM e.source),
u AS (SELECT *, CASE WHEN h = eh THEN floor(under / one) END AS k FROM t),
x AS (SELECT *, q + CASE WHEN eh IS NULL THEN CASE WHEN rest > 0 THEN 1 ELSE 0 END WHEN h < eh THEN 1 WHEN h > eh THEN 0
    WHEN turn <= k + CASE WHEN (k + 1) * one - under < under - k * one THEN 1 ELSE 0 END THEN 1 ELSE 0 END AS times FROM u)
SELECT doc_id, size, source_size, target, size * times AS taken, times FROM x
"""
