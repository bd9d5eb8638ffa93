"""The five relations, derived from the warehouse tables.

Users are nodes of a grid ten wide, their orders are votes, and their events
are recolourings: every event type stands for a district.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import position

CHAINS, DISTRICTS, WIDTH = 4, 5, 10
TYPES = ["view", "click", "purchase", "signup", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("node_id")).distinct()
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), "c_acctbal")
    n = users.join(c, "node_id").select(
        "node_id",
        F.expr(f"node_id div {WIDTH}").alias("x"),
        (F.col("node_id") % WIDTH).alias("y"),
        (1 + F.floor(F.abs("c_acctbal"))).cast("long").alias("population"),
        F.lit(1.0).alias("area"),
    )
    widest = n.agg(F.max("x").alias("max_x"))  # one row
    n = n.join(F.broadcast(widest), how="left")
    flags = [F.col("x") == 0, F.col("x") == F.col("max_x"), F.col("y") == 0, F.col("y") == WIDTH - 1]
    border = sum((f.cast("long") for f in flags[1:]), flags[0].cast("long"))
    return n.withColumn("external_border", border).withColumn("boundary", F.col("external_border") > 0).drop("max_x")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = nodes(spark, sf_dir).select("node_id")
    right = ids.where(F.col("node_id") % WIDTH < WIDTH - 1).select(F.col("node_id").alias("u"), (F.col("node_id") + 1).alias("v"))
    down = ids.select(F.col("node_id").alias("u"), (F.col("node_id") + WIDTH).alias("v"))
    both = right.unionByName(down).join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi")
    return both.select("u", "v", (1 + (F.col("u") + F.col("v")) % 3).alias("border_length"))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("node_id", (F.col("node_id") % DISTRICTS).cast("int").alias("district_id"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("node_id"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    counted = o.groupBy("node_id").agg(F.count_if("even").alias("p1"), F.count_if(~F.col("even")).alias("p2"))
    out = nodes(spark, sf_dir).select("node_id").join(counted, "node_id", "left")
    return out.select("node_id", F.coalesce("p1", F.lit(0)).alias("p1"), F.coalesce("p2", F.lit(0)).alias("p2"))


def move_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("node_id"), "event_type")
    target = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")).cast("int") - 1
    e = e.select((F.col("event_id") % CHAINS).alias("chain_id"), "event_id", "node_id", target.alias("target"))
    e = position(e, ["chain_id"], "event_id", "step")
    w = Window.partitionBy("chain_id", "node_id").orderBy("step")
    e = e.withColumn("old", F.coalesce(F.lag("target").over(w), (F.col("node_id") % DISTRICTS).cast("int")))
    moved = F.col("old") != F.col("target")
    return e.select(
        "chain_id",
        "step",
        F.when(moved, F.col("node_id")).alias("node_id"),
        F.when(moved, F.col("old")).alias("old_color"),
        F.when(moved, F.col("target")).alias("new_color"),
    )
