"""Per-district aggregates of one assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_district(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """Population, area, node and boundary node counts, and centre of mass."""
    return nodes.join(assignment, "node_id").groupBy("district_id").agg(
        F.sum("population").alias("population"),
        F.sum("area").alias("area"),
        F.count("*").alias("n_nodes"),
        F.count_if("boundary").alias("boundary_nodes"),
        (F.sum("x") / F.count("*")).alias("cx"),
        (F.sum("y") / F.count("*")).alias("cy"),
        (F.sum(F.col("x") * F.col("population")) / F.sum("population")).alias("wx"),
        (F.sum(F.col("y") * F.col("population")) / F.sum("population")).alias("wy"),
    )


def population_deviation(districts: DataFrame) -> DataFrame:
    """Euclidean distance of the populations from their mean, and the largest relative deviation."""
    ideal = districts.agg(F.avg("population").alias("ideal"))
    off = F.col("population") - F.col("ideal")
    return districts.join(F.broadcast(ideal), how="left").agg(
        F.sqrt(F.sum(off * off)).alias("deviation"), F.max(F.abs(off) / F.col("ideal")).alias("max_relative")
    )


def perimeter(cut: DataFrame, nodes: DataFrame, assignment: DataFrame, external: bool = True) -> DataFrame:
    """Border length of each district: cut edges count for both sides."""
    sides = cut.select(F.explode(F.array("cu", "cv")).alias("district_id"), F.col("border_length").alias("length"))
    if external:
        outer = nodes.join(assignment, "node_id").select("district_id", F.col("external_border").alias("length"))
        sides = sides.unionByName(outer)
    return sides.groupBy("district_id").agg(F.sum("length").alias("perimeter"))


def compactness(perimeters: DataFrame, districts: DataFrame) -> DataFrame:
    """Sum of squared perimeter over area."""
    p = F.col("perimeter")
    return perimeters.join(districts, "district_id").agg(F.sum(p * p / F.col("area")).alias("energy"))


def global_centre(nodes: DataFrame, weight: str | None = None) -> DataFrame:
    """Weighted sums over the number of nodes (not over the weights)."""
    w = F.col(weight) if weight else F.lit(1)
    return nodes.agg((F.sum(w * F.col("x")) / F.count("*")).alias("x"), (F.sum(w * F.col("y")) / F.count("*")).alias("y"))


def cut_length(cut: DataFrame) -> DataFrame:
    return cut.agg(F.count("*").alias("n_cut"), F.coalesce(F.sum("border_length"), F.lit(0)).alias("length"))
