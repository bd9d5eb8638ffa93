"""Generated graphs and colourings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components


def square_nodes(ids: DataFrame, n: int) -> DataFrame:
    """An n x n grid of the ids 0 to n*n-1: node i*n+j at (i, j), population and area 1."""
    x, y = F.expr(f"id div {n}"), F.col("id") % n
    ends = [(x == 0), (x == n - 1), (y == 0), (y == n - 1)]
    edge = (ends[0] | ends[1]).cast("long") + (ends[2] | ends[3]).cast("long")
    out = ids.where(F.col("id").between(0, n * n - 1)).select(F.col("id").alias("node_id"), x.alias("x"), y.alias("y"), F.lit(1).cast("long").alias("population"), F.lit(1.0).alias("area"), edge.alias("external_border"))
    return out.withColumn("boundary", F.col("external_border") > 0)


def square_edges(ids: DataFrame, n: int) -> DataFrame:
    ids = ids.where(F.col("id").between(0, n * n - 1))
    right = ids.where(F.col("id") % n < n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    down = ids.where(F.col("id") < n * (n - 1)).select(F.col("id").alias("u"), (F.col("id") + n).alias("v"))
    return right.unionByName(down).withColumn("border_length", F.lit(1).cast("long"))


def angular(nodes: DataFrame, n: int, districts: int, strict_reference: bool = True) -> DataFrame:
    """Colours by angle about the centre. An angle of exactly pi has colour ``districts``,
    or the last colour unless ``strict_reference``."""
    c = (n - 1) / 2
    turn = F.floor((F.atan2(F.col("y") - c, F.col("x") - c) + math.pi) / (2 * math.pi / districts)).cast("int")
    colour = turn if strict_reference else F.least(turn, F.lit(districts - 1))
    return nodes.select("node_id", colour.alias("district_id"))


def diagonal(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_id", (F.col("x") > F.col("y")).cast("int").alias("district_id"))


def from_cut_edges(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Districts are what connects without the removed edges, named by their least node."""
    left = edges.join(removed, ["u", "v"], "left_anti")
    return components(nodes, left).withColumnRenamed("component_id", "district_id")


def star(rim: DataFrame, between: DataFrame, n: int, points: int) -> tuple[DataFrame, DataFrame]:
    """``points`` on a circle (ids 0 to points-1), and n nodes (ids from 0) between each pair of neighbours, linked to both."""
    turn = 2 * math.pi / points
    rim = rim.where(F.col("id").between(0, points - 1)).select(F.col("id").alias("node_id"), F.sin(F.col("id") * turn).alias("x"), F.cos(F.col("id") * turn).alias("y"))
    between = between.where(F.col("id").between(0, points * n - 1)).select((F.col("id") + points).alias("node_id"), F.expr(f"id div {n}").alias("a"), (F.col("id") % n).alias("k"))
    b = (F.col("a") + 1) % points
    angle = (F.col("a") + 0.5) * turn
    radius = (F.col("k") + 1) / (n + 1)
    inner = between.select("node_id", (radius * F.sin(angle)).alias("x"), (radius * F.cos(angle)).alias("y"))
    links = between.select(F.col("a").alias("u"), F.col("node_id").alias("v")).unionByName(between.select(b.alias("u"), F.col("node_id").alias("v")))
    return rim.unionByName(inner), links
