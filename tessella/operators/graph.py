"""Cut edges, neighbours, proposals and connectivity of one assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import cut, drop


def coloured(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges with the districts of both ends, cu and cv."""
    u = assignment.select(F.col("node_id").alias("u"), F.col("district_id").alias("cu"))
    v = assignment.select(F.col("node_id").alias("v"), F.col("district_id").alias("cv"))
    return edges.join(u, "u").join(v, "v")


def cut_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    found = coloured(edges, assignment).where("cu <> cv")
    low, high = F.least("u", "v"), F.greatest("u", "v")
    swap = F.col("u") > F.col("v")
    return found.select(low.alias("u"), high.alias("v"), "border_length", F.when(swap, F.col("cv")).otherwise(F.col("cu")).alias("cu"), F.when(swap, F.col("cu")).otherwise(F.col("cv")).alias("cv"))


def directed_edges(cut: DataFrame) -> DataFrame:
    """Both directions of each cut edge: (a, ca) may take over colour cb of b."""
    there = cut.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("cu").alias("ca"), F.col("cv").alias("cb"), "border_length")
    back = cut.select(F.col("v").alias("a"), F.col("u").alias("b"), F.col("cv").alias("ca"), F.col("cu").alias("cb"), "border_length")
    return there.unionByName(back)


def contested_nodes(cut: DataFrame) -> DataFrame:
    return cut.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()


def proposals(cut: DataFrame) -> DataFrame:
    return directed_edges(cut).select(F.col("a").alias("node_id"), F.col("ca").alias("old_color"), F.col("cb").alias("new_color")).distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("node_id"), F.col("v").alias("other"), "border_length").unionByName(
        edges.select(F.col("v").alias("node_id"), F.col("u").alias("other"), "border_length")
    )


def adjacency(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy("node_id").agg(F.sort_array(F.collect_list("other")).alias("neighbours"), F.count("*").alias("degree"))


def district_boundary(cut: DataFrame) -> DataFrame:
    pair = [F.least("cu", "cv").alias("c1"), F.greatest("cu", "cv").alias("c2")]
    return cut.groupBy(*pair).agg(F.count("*").alias("n_edges"), F.sum("border_length").alias("length"))


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): every node with an edge points at the least node of its component.

    Large stars, then small stars: the least neighbour of a node is a partial
    aggregate, so no hub gathers its neighbours. Each round is written to the
    shared folder, and goes when the next one is there.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, before = cut(e, "edges"), None
    mark = (F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007))))
    while (now := tuple(e.agg(*mark).first())) != before:
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = cut(large.distinct(), "large")
        centre = cut(large.groupBy("u").agg(F.min("v").alias("m")), "centre")
        small = large.join(centre, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(centre.select("u", F.col("m").alias("v"))).distinct(), "edges")
        drop(e, least, large, centre)
        e = after
    return e


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component_id): the least node that is reachable."""
    found = stars(edges.select("u", "v"))
    out = nodes.select("node_id").join(found, F.col("node_id") == F.col("u"), "left")
    return out.select("node_id", F.coalesce("v", "node_id").alias("component_id"))


def low_points(near: dict, root, seen: dict) -> set:
    """Cut vertices of the component of ``root``, depth first by low points; its nodes are added to ``seen``."""
    found, low, clock, children = set(), {root: 0}, 1, 0
    seen[root] = 0
    stack = [(root, None, iter(near.get(root, ())))]
    while stack:
        node, parent, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            if stack:
                up = stack[-1][0]
                low[up] = min(low[up], low[node])
                if up != root and low[node] >= seen[up]:
                    found.add(up)
        elif step not in seen:
            seen[step] = low[step] = clock
            clock += 1
            children += node == root
            stack.append((step, node, iter(near[step])))
        elif step != parent:
            low[node] = min(low[node], seen[step])
    if children > 1:
        found.add(root)
    return found


def population_band(total: Column, districts: int, tolerance: float) -> tuple[Column, Column]:
    """Least and most population; the tolerance is of the total."""
    return total / districts - total * tolerance / 2, total / districts + total * tolerance / 2


def step_proposals(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(chain_id, node_id, old_color, new_color, score) of every chain's moves from its ``state``: change of cut edges."""
    at = lambda node, colour: state.select("chain_id", F.col("node_id").alias(node), F.col("district_id").alias(colour))
    near = symmetric(edges).select("node_id", "other").join(at("other", "cb"), "other").join(at("node_id", "ca"), ["chain_id", "node_id"])
    counts = near.groupBy("chain_id", "node_id", "ca", "cb").agg(F.count("*").alias("n"))
    own = counts.where("ca = cb").select("chain_id", "node_id", F.col("n").alias("own"))
    moves = counts.where("ca <> cb").join(own, ["chain_id", "node_id"], "left")
    return moves.select("chain_id", "node_id", F.col("ca").alias("old_color"), F.col("cb").alias("new_color"), (F.coalesce("own", F.lit(0)) - F.col("n")).alias("score"))


def weighted_pick(moves: DataFrame, weight: Column, seed: int) -> DataFrame:
    """One move of each chain, drawn in proportion to ``weight``: the least of exponential waits that are drawn from hashes."""
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ("chain_id", "node_id", "old_color", "new_color")])
    draw = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)
    rows = moves.withColumn("wait", -F.log(draw) / weight)
    best = F.min(F.struct("wait", "node_id", "old_color", "new_color", "score")).alias("b")
    return rows.groupBy("chain_id").agg(best).select("chain_id", "b.node_id", "b.old_color", "b.new_color", "b.score")
