"""Connected components by alternating large-star and small-star steps.

The edges of a star are rewritten to point at the least node seen, so hubs
never gather their neighbours: a hub's minimum is a partial aggregate, and
the join that hands it out is one that Spark can split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _signature(edges: DataFrame) -> tuple:
    mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007)))
    return tuple(edges.agg(F.count("*"), mark).first())


def _least(edges: DataFrame) -> DataFrame:
    """For each u the least of its neighbours; stored, so the next join can be split."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def connected_components(edges: DataFrame) -> DataFrame:
    """(src, dst) longs -> (node, root): root is the least node of the component.

    Nodes without an edge to another node, and nulls, are left out.
    """
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    e = stored(e.where("src is not null and dst is not null and src <> dst").distinct(), "edges")
    before = _signature(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = _least(both)
        large = both.join(m, "u").where("v > u")
        large = stored(large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "large")
        m2 = _least(large)
        small = large.join(m2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stored(small.unionByName(m2.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _signature(new)
        for done in (e, m, large, m2):
            drop_stored(done)
        e = new
        if after == before:
            break
        before = after
    both = e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
    both._tessella_path = e._tessella_path  # goes with the edges
    return both
