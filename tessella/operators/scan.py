"""Running sums and positions along long chains, in blocks.

One chain may hold most rows, so a window over it would run in one task.
Rows are cut into blocks by the order column; block totals are scanned and
joined back, and only a block's rows meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def running_sum(df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], after: str | None = None, block: int = BLOCK) -> DataFrame:
    """Adds the running sums ``sums`` over ``order`` within ``keys``; rows of equal order count together.

    ``after`` names a column for the order of the next row, null at the end. ``df`` is read twice.
    """
    df = df.withColumn("__blk", F.floor(F.col(order) / block))
    per = df.groupBy(*keys, "__blk").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()], F.min(order).alias("__first"))
    blocks = Window.partitionBy(*keys).orderBy("__blk")
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    offsets = [F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums]
    per = per.select(*keys, "__blk", *offsets, *([F.lead("__first").over(blocks).alias("__next")] if after else []))
    inside = Window.partitionBy(*keys, "__blk").orderBy(order)
    ahead = {after: F.lead(order).over(inside)} if after else {}
    out = df.withColumns({**{n: F.sum(c).over(inside) for n, c in sums.items()}, **ahead}).join(per, [*keys, "__blk"])
    out = out.withColumns({**{n: F.col(n) + F.col(f"__{n}") for n in sums}, **({after: F.coalesce(after, "__next")} if after else {})})
    return out.drop("__blk", "__next", *[f"__{n}" for n in sums])


def position(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds the row's position from 0 in ``order`` within ``keys``; orders are distinct."""
    out = running_sum(df, keys, order, {name: F.lit(1)})
    return out.withColumn(name, (F.col(name) - 1).cast("long"))


def neighbour(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], ahead: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds ``values`` of the row before (or ``ahead``) in ``order`` within ``keys``; null at the end.

    Only the first row of a block looks into another one: to the nearest block that has rows.
    """
    df = df.withColumns({"__blk": F.floor(F.col(order) / block), **{f"__v_{n}": c for n, c in values.items()}})
    near, far = (F.lead, F.min_by) if ahead else (F.lag, F.max_by)
    ends = df.groupBy(*keys, "__blk").agg(*[far(F.struct(f"__v_{n}"), F.col(order)).alias(f"__e_{n}") for n in values])
    blocks = Window.partitionBy(*keys).orderBy("__blk")
    ends = ends.select(*keys, "__blk", *[near(f"__e_{n}").over(blocks)[f"__v_{n}"].alias(f"__e_{n}") for n in values])
    inside = Window.partitionBy(*keys, "__blk").orderBy(order)
    out = df.withColumn("__end", near(F.lit(1)).over(inside).isNull())
    out = out.withColumns({n: near(f"__v_{n}").over(inside) for n in values}).join(ends, [*keys, "__blk"])
    out = out.withColumns({n: F.when(F.col("__end"), F.col(f"__e_{n}")).otherwise(F.col(n)) for n in values})
    return out.drop("__blk", "__end", *[f"__v_{n}" for n in values], *[f"__e_{n}" for n in values])


def latest(rows: DataFrame, asked: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """``asked`` with the struct ``name`` of the last of ``rows`` (keys, order, name) at or before it; null where there is none.

    Rows and questions are put in one order, so a row that holds for long is
    there once and not once for every stretch that it covers. ``rows`` have
    distinct orders within ``keys``.
    """
    both = rows.select(*keys, order, name, F.lit(False).alias("__asks")).unionByName(asked.withColumn("__asks", F.lit(True)), allowMissingColumns=True)
    at = Window.partitionBy(*keys).orderBy(order, "__asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(at)).where("__asks").select(*asked.columns, name)
