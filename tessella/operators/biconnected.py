"""Cut vertices of a whole graph by joins: spanning forest, Euler tour, subtree bounds, components of tree edges.

No step gathers a district or a component: every one is a join, an aggregate
or a sum in blocks over nodes, edges or arcs, all components at once, in a
number of rounds that grows with the logarithm of the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import coloured, population_band, stars
from .scan import neighbour, running_sum
from .store import cut as stored
from .store import drop


def _to_roots(up: DataFrame) -> DataFrame:
    """(c, up) with ``up`` the root of c: pointers are doubled until none changes."""
    up = stored(up, "up")
    while True:
        top = up.select(F.col("c").alias("up"), F.col("up").alias("top"))
        after = stored(up.join(top, "up").select("c", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "up")
        drop(up)
        up = after.select("c", "up")
        up._cut_path = after._cut_path
        if after.where("moved").isEmpty():
            return up


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tree edges (u, v), and (node_id, root) of all nodes with an edge; edges are distinct, u < v.

    Every part takes its least edge to another part, and parts that these
    join become one; edges are told apart by their ends, so no cycle closes.
    """
    nodes = edges.select(F.col("u").alias("node_id")).union(edges.select("v")).distinct()
    part = stored(nodes.withColumn("c", F.col("node_id")), "part")
    live = stored(edges.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")), "live")
    trees: list[DataFrame] = []
    while not live.isEmpty():
        sides = live.select(F.col("cu").alias("c"), F.col("cv").alias("to"), "u", "v").unionByName(live.select(F.col("cv").alias("c"), F.col("cu").alias("to"), "u", "v"))
        pick = stored(sides.groupBy("c").agg(F.min(F.struct("u", "v", "to")).alias("e")).select("c", "e.*"), "pick")
        trees.append(stored(pick.select("u", "v").distinct(), "tree"))
        # two parts that took the same edge: the smaller one is the root
        other = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
        up = pick.join(other, "to").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("up"))
        up = _to_roots(up)
        now = stored(part.join(up, "c").select("node_id", F.col("up").alias("c")), "part")
        ends = {s: up.select(F.col("c").alias(f"c{s}"), F.col("up").alias(f"n{s}")) for s in "uv"}
        rest = live.join(ends["u"], "cu").join(ends["v"], "cv").where("nu <> nv")
        rest = stored(rest.select("u", "v", F.col("nu").alias("cu"), F.col("nv").alias("cv")), "live")
        # parts without an edge left are done; they keep their root
        done = part.join(up, "c", "left_anti").select("node_id", "c")
        now = stored(now.unionByName(done), "part")
        drop(live, pick, up, part)
        live, part = rest, now
    tree = trees[0] if trees else edges.select("u", "v").limit(0)
    for t in trees[1:]:
        tree = tree.unionByName(t)
    return tree, part.withColumnRenamed("c", "root")


def rooted(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(node_id, root, parent, pre, size): preorder numbers from 0 in each tree and sizes of subtrees.

    The Euler tour goes on from arc (a, b) with b's next neighbour after a.
    Places in it are found by doubling: every arc knows the one 1, 2, 4 ...
    further on.
    """
    arcs = stored(tree.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(tree.select(F.col("v").alias("a"), F.col("u").alias("b"))), "arcs")
    first = arcs.groupBy("b").agg(F.min("a").alias("first"))
    tour = neighbour(arcs, ["b"], "a", {"then": F.col("a")}, ahead=True).join(first, "b")
    # the tour of a tree ends before its root's first arc comes again
    tour = tour.join(roots.select(F.col("node_id").alias("b"), "root"), "b")
    last = F.col("then").isNull() & (F.col("b") == F.col("root"))
    then = F.when(~last, F.coalesce("then", "first"))
    tour = stored(tour.select("a", "b", "root", F.when(~last, F.col("b")).alias("na"), then.alias("nb"), F.lit(1).cast("long").alias("left")), "tour")
    longest = tour.groupBy("root").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, longest - 1).bit_length()):
        ahead = tour.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("left").alias("more"))
        after = tour.join(ahead, ["na", "nb"], "left")
        after = stored(after.select("a", "b", "root", F.col("ma").alias("na"), F.col("mb").alias("nb"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "tour")
        drop(tour)
        tour = after
    arcs_of = tour.groupBy("root").agg(F.count("*").alias("arcs"))
    at = tour.join(arcs_of, "root").select("root", "a", "b", "arcs", (F.col("arcs") - F.col("left")).alias("at"))
    back = at.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("at").alias("back"))
    both = stored(at.join(back, ["a", "b"]).withColumn("down", (F.col("at") < F.col("back")).cast("long")), "places")
    numbered = running_sum(both, ["root"], "at", {"pre": F.col("down")}).where("down = 1")
    below = numbered.select(F.col("b").alias("node_id"), "root", F.col("a").alias("parent"), "pre", F.expr("(back - at + 1) div 2").alias("size"))
    tops = arcs_of.select(F.col("root").alias("node_id"), "root", F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("pre"), F.expr("arcs div 2 + 1").alias("size"))
    out = stored(below.unionByName(tops), "rooted")
    drop(arcs, tour, both)
    return out


def subtree_bounds(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """(node_id, low, high): least and largest preorder number in a subtree and one edge ``outer`` (u, v) off it.

    A subtree is an interval of preorder numbers, and an interval two
    overlapping ones whose length is a power of two.
    """
    pre = nodes.select(F.col("node_id").alias("v"), F.col("pre").alias("there"))
    both = outer.select("u", "v").unionByName(outer.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both.join(pre, "v").groupBy(F.col("u").alias("node_id")).agg(F.min("there").alias("l"), F.max("there").alias("h"))
    level = nodes.join(seen, "node_id", "left").select("root", F.col("pre").alias("at"), F.least("pre", "l").alias("low"), F.greatest("pre", "h").alias("high"))
    level = stored(level, "level")
    largest = nodes.agg(F.max("size")).first()[0] or 0
    found, held = [], [level]
    for k in range(largest.bit_length()):
        half = 1 << k
        fit = nodes.where((F.col("size") >= half) & (F.col("size") < 2 * half))
        ends = fit.select("node_id", "root", F.explode(F.array(F.col("pre"), F.col("pre") + F.col("size") - half)).alias("at"))
        found.append(ends.join(level, ["root", "at"]).groupBy("node_id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
        if 2 * half <= largest:
            ahead = level.select("root", (F.col("at") - half).alias("at"), F.col("low").alias("l"), F.col("high").alias("h"))
            level = level.join(ahead, ["root", "at"]).select("root", "at", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"))
            level = stored(level, "level")
            held.append(level)
    if not found:
        return nodes.select("node_id", F.col("pre").alias("low"), F.col("pre").alias("high"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = stored(out, "bounds")
    drop(*held)
    return out


def blocks(edges: DataFrame) -> DataFrame:
    """(node_id, parent, block): the biconnected block of each tree edge, named by a node below one; ``edges`` (u, v) in any order.

    Two tree edges are of one block if an edge joins subtrees side by side, or
    leads out of a child's subtree past the parent's.
    """
    edges = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    tree, roots = spanning_forest(edges)
    tree = stored(tree, "forest")
    nodes = rooted(tree, roots)
    outer = stored(edges.join(tree, ["u", "v"], "left_anti"), "outer")
    bounds = subtree_bounds(nodes, outer)
    about = lambda side: nodes.select(F.col("node_id").alias(side), F.col("pre").alias(f"pre_{side}"), F.col("size").alias(f"size_{side}"))
    apart = outer.join(about("u"), "u").join(about("v"), "v")
    apart = apart.where("pre_u + size_u <= pre_v or pre_v + size_v <= pre_u").select("u", "v")
    up = nodes.where("parent is not null").select(F.col("node_id").alias("u"), F.col("parent").alias("v")).join(bounds.withColumnRenamed("node_id", "u"), "u")
    past = up.join(about("v"), "v").where("low < pre_v or high >= pre_v + size_v").select("u", "v")
    found = stars(apart.unionByName(past))
    named = found.select(F.col("u").alias("node_id"), F.col("v").alias("least"))
    out = nodes.where("parent is not null").join(named, "node_id", "left").select("node_id", "parent", F.coalesce("least", "node_id").alias("block"))
    out = stored(out, "blocks")
    drop(edges, tree, roots, nodes, outer, bounds, found)
    return out


def cut_nodes(edges: DataFrame) -> DataFrame:
    """(node_id): nodes of two blocks or more, whose removal disconnects their component."""
    found = blocks(edges)
    ends = found.select("node_id", "block").unionByName(found.select(F.col("parent").alias("node_id"), "block"))
    return ends.groupBy("node_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select("node_id")


def cut_vertices(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """(district_id, node_id): nodes whose removal disconnects their part of a district."""
    found = cut_nodes(coloured(edges, assignment).where("cu = cv").select("u", "v"))
    return found.join(assignment, "node_id").select("district_id", "node_id")


def feasible(moves: DataFrame, nodes: DataFrame, assignment: DataFrame, edges: DataFrame, districts: int, tolerance: float) -> DataFrame:
    """Proposals that keep both districts within the population band and the old one connected."""
    pop = nodes.join(assignment, "node_id").groupBy("district_id").agg(F.sum("population").alias("p"))
    total = nodes.agg(F.sum("population").alias("total"))  # one row
    m = moves.join(nodes.select("node_id", "population"), "node_id")
    m = m.join(pop.select(F.col("district_id").alias("old_color"), F.col("p").alias("p_old")), "old_color")
    m = m.join(pop.select(F.col("district_id").alias("new_color"), F.col("p").alias("p_new")), "new_color")
    m = m.join(F.broadcast(total), how="left")
    least, most = population_band(F.col("total"), districts, tolerance)
    m = m.where((F.col("p_old") - F.col("population") > least) & (F.col("p_new") + F.col("population") < most))
    return m.join(cut_vertices(assignment, edges).select("node_id"), "node_id", "left_anti").select("node_id", "old_color", "new_color")
