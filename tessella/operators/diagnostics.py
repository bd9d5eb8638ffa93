"""Convergence diagnostics over traces of several chains."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import quantised
from .replay import rejected
from .scan import BLOCK, neighbour, running_sum
from .store import cut

STATES = 6


def common_steps(trace: DataFrame) -> DataFrame:
    """Steps that every chain has."""
    per = trace.groupBy("chain_id").agg(F.max("step").alias("last"))
    least = per.agg(F.min("last").alias("last"))
    return trace.join(F.broadcast(least), how="left").where("step <= last").drop("last")


def pooled_histogram(trace: DataFrame, value: str, states: int = STATES) -> DataFrame:
    """(state, share) over all chains and common steps, states without rows as 0."""
    rows = cut(trace.select("chain_id", "step", value), "trace")
    counted = _pooled(common_steps(rows), value, states)
    return counted.select(F.posexplode("pooled").alias("state", "share")).select(F.col("state").cast("long"), "share")


def _pooled(rows: DataFrame, value: str, states: int) -> DataFrame:
    """One row: the share of each state."""
    shares = [F.try_divide(F.count_if(F.col(value) == k), F.count("*")) for k in range(states)]
    return rows.agg(F.array(*shares).alias("pooled"))


def _counts(trace: DataFrame, value: str, states: int) -> DataFrame:
    """(chain_id, step, counts): how often each state has been seen so far; one window for all states."""
    names = [f"n{k}" for k in range(states)]
    out = running_sum(trace.select("chain_id", "step", value), ["chain_id"], "step", {n: (F.col(value) == k).cast("int") for k, n in enumerate(names)})
    return out.select("chain_id", "step", F.array(*names).alias("counts"))


def running_counts(trace: DataFrame, value: str, states: int = STATES) -> DataFrame:
    """(chain_id, step, state, n): rows of the state up to the step."""
    return _counts(trace, value, states).select("chain_id", "step", F.posexplode("counts").alias("state", "n"))


def running_share(trace: DataFrame, value: str, states: int = STATES) -> DataFrame:
    rows = cut(trace.select("chain_id", "step", value), "trace")
    return running_counts(rows, value, states).select("chain_id", "step", "state", (F.col("n") / (F.col("step") + 1)).alias("share"))


def running_distance(trace: DataFrame, value: str, states: int = STATES) -> DataFrame:
    """(step, phi_mean, phi_var): chains' largest distance from the pooled histogram so far."""
    rows = cut(trace.select("chain_id", "step", value), "trace")
    rows = common_steps(rows)
    so_far = _counts(rows, value, states).join(F.broadcast(_pooled(rows, value, states)), how="left")  # one row
    gap = F.zip_with("counts", "pooled", lambda n, share: F.abs(n / (F.col("step") + 1) - share))
    phi = so_far.select("step", F.array_max(gap).alias("phi"))
    # the mean does not depend on the order of its terms
    mean = F.sum(F.col("phi").cast("decimal(18,12)")).cast("double") / F.count("*")
    return phi.groupBy("step").agg(mean.alias("phi_mean"), F.var_pop("phi").alias("phi_var"))


def waits(log: DataFrame) -> DataFrame:
    """(chain_id, step, wait): steps since the rejection before; an open end is dropped."""
    rows = neighbour(rejected(log).select("chain_id", "step"), ["chain_id"], "step", {"before": F.col("step")})
    return rows.select("chain_id", "step", (F.col("step") - F.coalesce("before", F.lit(-1))).alias("wait"))


def wait_histogram(log: DataFrame) -> DataFrame:
    return waits(log).groupBy("chain_id", "wait").agg(F.count("*").alias("n"))


def rank_histogram(marginals: DataFrame) -> DataFrame:
    """(rank, key, n, share): quantised shares over all chains; nulls are left out."""
    h = marginals.where("share is not null").groupBy("rank", quantised(F.col("share")).alias("key")).agg(F.count("*").alias("n"))
    return h.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("rank")))


def rank_distances(marginals: DataFrame, thin: int) -> DataFrame:
    """(chain_id, rank, window, tv): after each full window of ``thin`` steps, the total variation
    between the chain so far and the pooled histogram."""
    marginals = cut(marginals, "marginals")
    rows = marginals.where("share is not null").select("chain_id", "rank", F.floor(F.col("step") / thin).alias("window"), quantised(F.col("share")).alias("key"))
    full = marginals.groupBy("chain_id").agg(F.floor((F.max("step") + 1) / thin).alias("windows")).where("windows > 0")
    counts = rows.groupBy("chain_id", "rank", "window", "key").agg(F.count("*").alias("n"))
    pooled = rank_histogram(marginals).select("rank", "key", F.col("share").alias("pooled"))
    chains = full.agg(F.collect_list(F.struct("chain_id", "windows")).alias("c"))
    grid = pooled.join(F.broadcast(chains), how="left").withColumn("c", F.explode("c"))
    grid = grid.select("rank", "key", "pooled", "c.chain_id", F.explode(F.sequence(F.lit(0), F.col("c.windows") - 1)).alias("window"))
    grid = grid.join(counts, ["chain_id", "rank", "window", "key"], "left")
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("chain_id", "rank", "key").orderBy("window"))
    grid = grid.withColumn("share", so_far / ((F.col("window") + 1) * thin))
    return grid.groupBy("chain_id", "rank", "window").agg((F.sum(F.abs(F.col("share") - F.col("pooled"))) / 2).alias("tv"))


def running_variation(marginals: DataFrame, thin: int) -> DataFrame:
    return rank_distances(marginals, thin).groupBy("chain_id", "window").agg(F.avg("tv").alias("tv"))


def farthest_chain(marginals: DataFrame, thin: int) -> DataFrame:
    """(rank, chain_id, tv): the chain that is farthest at its last window, ties to the lower id."""
    d = rank_distances(marginals, thin)
    last = d.groupBy("chain_id", "rank").agg(F.max_by("tv", "window").alias("tv"))
    best = last.groupBy("rank").agg(F.max(F.struct(F.round("tv", 9).alias("t"), (-F.col("chain_id")).alias("c"))).alias("m"))
    return best.select("rank", (-F.col("m.c")).alias("chain_id"), F.col("m.t").alias("tv"))


def running_spread(trace: DataFrame, value: str, states: int = STATES) -> DataFrame:
    """(step, spread): the largest difference between two chains' counts of a state, over steps."""
    rows = cut(trace.select("chain_id", "step", value), "trace")
    per = running_counts(common_steps(rows), value, states).groupBy("step", "state").agg((F.max("n") - F.min("n")).alias("d"))
    return per.groupBy("step").agg((F.max("d") / (F.first("step") + 1)).alias("spread"))


def unwrapped(trace: DataFrame, centre: DataFrame) -> DataFrame:
    """(chain_id, district_id, step, angle): angles about one centre (x, y), carried on over turns."""
    at = cut(trace.select("chain_id", "district_id", "step", "cx", "cy"), "trace").join(F.broadcast(centre), how="left")
    at = at.withColumn("theta", F.atan2(F.col("cy") - F.col("y"), F.col("cx") - F.col("x")))
    at = neighbour(at, ["chain_id", "district_id"], "step", {"before": F.col("theta")})
    before = F.col("before")
    d = F.col("theta") - before
    crossed = (F.col("theta") * before < 0) & (F.abs(d) > math.pi)
    step = F.when(crossed & (F.col("theta") > 0), d - 2 * math.pi).when(crossed, d + 2 * math.pi).otherwise(d)
    at = at.withColumn("d", F.coalesce(step, F.col("theta")))
    out = running_sum(at, ["chain_id", "district_id"], "step", {"angle": F.col("d")})
    return out.select("chain_id", "district_id", "step", "angle")


def transitions(series: DataFrame, value: str) -> DataFrame:
    """(chain_id, step, value): step 0, then every value that differs from the one kept before; nulls go."""
    series = cut(series.select("chain_id", "step", value), "series")
    kept = series.where(F.col(value).isNotNull() | (F.col("step") == 0)).select("chain_id", "step", F.coalesce(value, F.lit(-1)).alias(value))
    kept = neighbour(kept, ["chain_id"], "step", {"before": F.col(value)})
    return kept.where(F.col("before").isNull() | (F.col("before") != F.col(value))).drop("before")


def autocorrelation(trace: DataFrame, value: str, lags: int, block: int = BLOCK) -> DataFrame:
    """(chain_id, lag, acf): mean products of deviations from the chain's mean, over that of lag 0.

    A trace has a row for every step. Blocks of steps take the first ``lags``
    rows of the next one along, so all lags are leads within a block.
    """
    rows = cut(trace.select("chain_id", "step", value), "trace")
    mean = rows.groupBy("chain_id").agg(F.avg(value).alias("mean"))
    x = rows.join(mean, "chain_id").select("chain_id", "step", (F.col(value) - F.col("mean")).alias("x"), F.floor(F.col("step") / block).alias("own"))
    lent = (F.col("step") % block < lags) & (F.col("own") > 0)
    blocks = F.when(lent, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))
    x = x.withColumn("blk", F.explode(blocks))
    w = Window.partitionBy("chain_id", "blk").orderBy("step")
    leads = x.select("chain_id", "x", "own", "blk", *[F.lead("x", k).over(w).alias(f"x{k}") for k in range(lags + 1)]).where("own = blk")
    cov = leads.groupBy("chain_id").agg(F.array(*[F.avg(F.col("x") * F.col(f"x{k}")) for k in range(lags + 1)]).alias("cov"))
    out = cov.select("chain_id", F.get("cov", F.lit(0)).alias("at0"), F.posexplode("cov").alias("lag", "c")).where("c is not null")
    return out.select("chain_id", "lag", F.try_divide("c", "at0").alias("acf"))
