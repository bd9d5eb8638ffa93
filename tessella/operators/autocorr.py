"""Autocorrelation of whole states: nodes that agree at two steps, less what chance gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut as stored


def _agreement(held: DataFrame, nodes: DataFrame, every: int, furthest: int, districts: int, distances: range, whole: bool) -> DataFrame:
    """Mean agreement at each of ``distances``, counted from samples every ``every`` steps.

    No sample is laid out: two runs of one node in one colour agree at a
    distance at as many samples as the first one has in common with the second
    one moved back by it. A run meets itself and the runs that begin less than
    ``furthest`` after its last sample, which two buckets of steps hold. So
    work grows with the runs, not with nodes times samples.
    ``whole``: only from samples that have all steps below ``furthest`` ahead.
    """
    held = stored(held.select("chain_id", "node_id", "color", "start_step", "end_step"), "runs")
    steps = held.groupBy("chain_id").agg(F.max("end_step").alias("steps"))
    stop = F.col("steps") - furthest if whole else F.col("steps")
    first = lambda c: F.ceil(c / every)
    runs = held.join(F.broadcast(steps), "chain_id").withColumn("until", F.least("end_step", stop)).where(first(F.col("start_step")) * every < F.col("until"))
    runs = runs.select("chain_id", "node_id", "color", F.col("start_step").alias("a"), "until", (F.floor((F.col("until") - 1) / every) * every).alias("last"), "end_step")
    bucket = lambda c: F.floor(c / furthest)
    ahead = held.select("chain_id", "node_id", "color", F.col("start_step").alias("b"), F.col("end_step").alias("e"), bucket(F.col("start_step")).alias("bucket"))
    if distances.step % every == 0:  # then the later step is a sample as well
        ahead = ahead.where(first(F.col("b")) * every < F.col("e"))
    pairs = runs.withColumn("bucket", F.explode(F.sequence(bucket(F.col("last")), bucket(F.col("last")) + 1))).join(ahead, ["chain_id", "node_id", "color", "bucket"])
    pairs = pairs.where((F.col("b") >= F.col("end_step")) & (F.col("b") < F.col("last") + furthest)).select("chain_id", "a", "until", "b", "e")
    pairs = pairs.unionByName(runs.select("chain_id", "a", "until", F.col("a").alias("b"), F.col("end_step").alias("e")))
    common = lambda d: F.greatest(first(F.least("until", F.col("e") - d)) - first(F.greatest("a", F.col("b") - d)), F.lit(0))
    sums = F.array(*[F.struct(F.lit(d).cast("long").alias("dist"), F.sum(common(d)).alias("agree")) for d in distances])
    per = pairs.groupBy("chain_id").agg(sums.alias("per")).select("chain_id", F.explode("per").alias("p")).select("chain_id", "p.dist", "p.agree")
    locs = first(F.col("steps") - (furthest if whole else F.col("dist"))).cast("long")
    per = per.join(steps, "chain_id").withColumn("locs", locs).where("locs > 0")
    chance = nodes.agg((F.count("*") / districts).alias("chance"))  # one row
    out = per.join(F.broadcast(chance), how="left")
    return out.select("chain_id", "dist", "locs", (F.col("agree") / F.col("locs") - F.col("chance")).alias("g"))


def at_distances(held: DataFrame, nodes: DataFrame, every: int, furthest: int, districts: int, block: int | None = None) -> DataFrame:
    """G(d) for d = 0, every, ... below ``furthest``, from every ``every``-th step that has all of them; ``block`` has no effect any more."""
    return _agreement(held, nodes, every, furthest, districts, range(0, furthest, every), True)


def from_points(held: DataFrame, nodes: DataFrame, every: int, furthest: int, districts: int) -> DataFrame:
    """G(d) for every d below ``furthest``, from every ``every``-th step that has all of them."""
    return _agreement(held, nodes, every, furthest, districts, range(furthest), True)


def all_pairs(held: DataFrame, nodes: DataFrame, every: int, furthest: int, districts: int, block: int | None = None) -> DataFrame:
    """G(d) over all pairs of sampled steps less than ``furthest`` apart; ``block`` has no effect any more."""
    return _agreement(held, nodes, every, furthest, districts, range(0, furthest, every), False)


def sample_steps(steps: DataFrame, k: int, seed: int, block: int = 65_536) -> DataFrame:
    """k steps of each chain without replacement, the same ones for the same seed; least hashes, by block and then by chain."""
    rows = steps.select("chain_id", "step").distinct().withColumn("h", F.md5(F.concat_ws(":", F.col("step").cast("string"), F.lit(str(seed)))))
    for part in (["chain_id", F.floor(F.col("step") / block)], ["chain_id"]):
        turn = F.row_number().over(Window.partitionBy(*part).orderBy("h", "step"))
        rows = rows.withColumn("turn", turn).where(F.col("turn") <= k).drop("turn")
    return rows.drop("h")
