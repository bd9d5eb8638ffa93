"""Scores of proposed moves (node_id, old_color, new_color), as columns and as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import by_district, perimeter, population_deviation
from ..operators.graph import cut_edges, symmetric


def clamped_exp(x: Column) -> Column:
    return F.exp(F.least(x, F.lit(700.0)))


def chance(score: Column, beta: float) -> Column:
    """exp(-beta * score / 2), not above exp(700)."""
    return clamped_exp(-0.5 * beta * score)


def rotation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """How far a step from a to b turns about c: -1 to 1; null where either length is 0."""
    mx, my = (ax + bx) / 2 - cx, (ay + by) / 2 - cy
    dx, dy = bx - ax, by - ay
    size = F.sqrt(mx * mx + my * my) * F.sqrt(dx * dx + dy * dy)
    return F.try_divide(dy * mx - dx * my, size)


def quantised(x: Column) -> Column:
    """To half percent steps, halves to even."""
    return F.rint(x * 2 * 100) / 100 / 2


def pack_pair(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long"))


def moved_centre(c: Column, total: Column, x: Column, w: Column, sign: int) -> Column:
    """The centre after a node joins (1) or leaves (-1)."""
    return F.try_divide(sign * w * x + c * total, total + sign * w)


def cut_delta(moves: DataFrame, edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Change of the number of cut edges."""
    near = symmetric(edges).join(assignment.withColumnRenamed("node_id", "other"), "other").select("node_id", "district_id")
    m = moves.join(near, "node_id", "left").groupBy("node_id", "old_color", "new_color")
    return m.agg((F.count_if(F.col("district_id") == F.col("old_color")) - F.count_if(F.col("district_id") == F.col("new_color"))).alias("score"))


def compactness_delta(moves: DataFrame, nodes: DataFrame, edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Change of the sum of squared perimeter over area; null where a district would vanish."""
    near = symmetric(edges).join(assignment.withColumnRenamed("node_id", "other"), "other").select("node_id", "district_id", "border_length")
    length, d = F.col("border_length"), F.col("district_id")
    m = moves.join(near, "node_id", "left").groupBy("node_id", "old_color", "new_color").agg(
        F.coalesce(F.sum(F.when(d == F.col("old_color"), length)), F.lit(0)).alias("to_old"),
        F.coalesce(F.sum(F.when(d == F.col("new_color"), length)), F.lit(0)).alias("to_new"),
        F.coalesce(F.sum(F.when((d != F.col("old_color")) & (d != F.col("new_color")), length)), F.lit(0)).alias("to_third"),
    )
    per = by_district(nodes, assignment).join(perimeter(cut_edges(edges, assignment), nodes, assignment), "district_id")
    for side in ("old", "new"):
        m = m.join(per.select(F.col("district_id").alias(f"{side}_color"), F.col("perimeter").alias(f"p_{side}"), F.col("area").alias(f"a_{side}")), f"{side}_color")
    m = m.join(nodes.select("node_id", "area", "external_border"), "node_id")
    change = F.col("to_old") - F.col("to_new")
    outer = F.col("to_third") + F.col("external_border")
    p_old, p_new = F.col("p_old") + change - outer, F.col("p_new") + change + outer
    before = F.col("p_old") ** 2 / F.col("a_old") + F.col("p_new") ** 2 / F.col("a_new")
    after = F.try_divide(p_old**2, F.col("a_old") - F.col("area")) + p_new**2 / (F.col("a_new") + F.col("area"))
    return m.select("node_id", "old_color", "new_color", (after - before).alias("score"))


def population_delta(moves: DataFrame, nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """Change of the sum of squared population deviations."""
    pop = by_district(nodes, assignment)
    m = moves.join(nodes.select("node_id", F.col("population").alias("p")), "node_id")
    for side in ("old", "new"):
        m = m.join(pop.select(F.col("district_id").alias(f"{side}_color"), F.col("population").alias(f"p_{side}")), f"{side}_color")
    return m.select("node_id", "old_color", "new_color", (2 * F.col("p") * (F.col("p_new") - F.col("p_old") + F.col("p"))).alias("score"))


def deviation_after(moves: DataFrame, nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """The population deviation that a move leads to."""
    now = population_deviation(by_district(nodes, assignment)).select("deviation")  # one row
    m = population_delta(moves, nodes, assignment).join(F.broadcast(now), how="left")
    after = F.sqrt(F.greatest(F.col("deviation") ** 2 + F.col("score"), F.lit(0.0)))
    return m.select("node_id", "old_color", "new_color", after.alias("score"))


def weighted(moves: DataFrame, scored: list[tuple[float, DataFrame]]) -> DataFrame:
    """Sum of weight times score over several scores of the same moves; null where one is."""
    keys, total, out = ["node_id", "old_color", "new_color"], F.lit(0.0), moves.select("node_id", "old_color", "new_color")
    for k, (weight, frame) in enumerate(scored):
        out = out.join(frame.withColumnRenamed("score", f"s{k}"), keys)
        total = total + F.lit(weight) * F.col(f"s{k}")
    return out.select(*keys, total.alias("score"))


def centre_flow(moves: DataFrame, nodes: DataFrame, assignment: DataFrame, centre: tuple[float, float], involution: int = 1) -> DataFrame:
    """Turn of both districts' centres about ``centre``; moves that turn with the involution are kept,
    and so are those whose turn is undefined."""
    d = by_district(nodes, assignment).select("district_id", "cx", "cy", F.col("n_nodes").cast("double").alias("n"))
    m = moves.join(nodes.select("node_id", "x", "y"), "node_id")
    for side in ("old", "new"):
        m = m.join(d.select(F.col("district_id").alias(f"{side}_color"), *[F.col(c).alias(f"{c}_{side}") for c in ("cx", "cy", "n")]), f"{side}_color")
    turn = F.lit(0.0)
    for side, sign in (("old", -1), ("new", 1)):
        c = lambda k: F.col(f"{k}_{side}")  # noqa: B023, E731
        x2 = moved_centre(c("cx"), c("n"), F.col("x"), F.lit(1.0), sign)
        y2 = moved_centre(c("cy"), c("n"), F.col("y"), F.lit(1.0), sign)
        turn = turn + rotation(c("cx"), c("cy"), x2, y2, F.lit(centre[0]), F.lit(centre[1]))
    keep = F.coalesce(turn * involution > 0, F.lit(True))
    return m.select("node_id", "old_color", "new_color", turn.alias("turn"), keep.alias("kept"))


def orientation(edges: DataFrame, nodes: DataFrame, centre: tuple[float, float], involution: int = 1) -> DataFrame:
    """+1 where going from u to v turns about ``centre`` with the involution, else -1."""
    at = lambda side: nodes.select(F.col("node_id").alias(side), F.col("x").alias(f"x_{side}"), F.col("y").alias(f"y_{side}"))
    e = edges.join(at("u"), "u").join(at("v"), "v")
    turn = rotation(F.col("x_u"), F.col("y_u"), F.col("x_v"), F.col("y_v"), F.lit(centre[0]), F.lit(centre[1]))
    return e.select("u", "v", (F.when(F.coalesce(turn, F.lit(0.0)) >= 0, 1).otherwise(-1) * involution).alias("sign"))


def rotation_matrix(theta: Column) -> list[Column]:
    """The entries m00, m01, m10, m11 of the matrix that turns by ``theta``."""
    entries = {"m00": F.cos(theta), "m01": F.sin(theta), "m10": -F.sin(theta), "m11": F.cos(theta)}
    return [c.alias(n) for n, c in entries.items()]


def is_square(n: Column) -> Column:
    """Whether a whole number is a perfect square."""
    root = F.rint(F.sqrt(n.cast("double"))).cast("long")
    return root * root == n
