"""The colouring matrix (step x node) of every chain, packed: runs of colours in arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .replay import STRETCH
from .scan import latest


def packed(held: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(chain_id, node_id, part, first, after, starts, colors): a node's runs of colours that begin in a stretch of steps.

    ``held``: colour intervals. A row covers the steps from ``first`` to
    ``after``, exclusive; a stretch in which nothing happens to a node has no
    row, the one before goes on. So there is a row and a run a move at most,
    beside the start, and no array is longer than a stretch.
    """
    run = F.sort_array(F.collect_list(F.struct("start_step", F.col("color").cast("int").alias("color")))).alias("runs")
    out = held.groupBy("chain_id", "node_id", F.floor(F.col("start_step") / stretch).alias("part")).agg(run, F.max("end_step").alias("after"))
    return out.select("chain_id", "node_id", "part", F.col("runs.start_step")[0].alias("first"), "after", F.col("runs.start_step").alias("starts"), F.col("runs.color").alias("colors"))


def colour_at(step: Column) -> Column:
    """The colour of a packed row at one of its steps: that of the last run begun by then."""
    return F.get("colors", F.size(F.filter("starts", lambda s: s <= step)) - 1)


def lookup(matrix: DataFrame, asked: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``asked`` (chain_id, step, node_id, ...) with the colour then; steps that no row covers are left out.

    The row of a step is the last one of its node that begins by then, whatever the ``stretch`` of the matrix.
    """
    rows = matrix.select("chain_id", "node_id", F.col("first").alias("step"), F.struct("after", "starts", "colors").alias("__row"))
    found = latest(rows, asked, ["chain_id", "node_id"], "step", "__row").where("step < __row.after")
    return found.select(*asked.columns, "__row.*").select(*asked.columns, colour_at(F.col("step")).alias("color"))


def sampled(matrix: DataFrame, every: int) -> DataFrame:
    """(chain_id, node_id, k, color): the colours at steps k * ``every``."""
    low, high = F.ceil(F.col("first") / every), F.floor((F.col("after") - 1) / every)
    rows = matrix.where(low <= high).withColumn("k", F.explode(F.sequence(low, high)))
    return rows.select("chain_id", "node_id", "k", colour_at(F.col("k") * every).alias("color"))
