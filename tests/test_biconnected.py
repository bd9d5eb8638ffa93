"""Cut vertices by joins against the depth-first search, on random graphs side by side."""

import random

import pytest

from tessella.operators import biconnected, graph


def _graphs():
    rnd, out, base = random.Random(4), [], 0
    for _ in range(60):
        n = rnd.randrange(2, 14)
        kind = rnd.random()
        if kind < 0.3:  # a tree, deep or broad
            pairs = {(rnd.randrange(max(0, i - 2), i) if kind < 0.15 else rnd.randrange(i), i) for i in range(1, n)}
        elif kind < 0.4:  # rings that share a node
            pairs = {(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (2, 4)}
        else:
            pairs = {tuple(sorted(rnd.sample(range(n), 2))) for _ in range(rnd.randrange(1, 2 * n))}
        out += [(base + u, base + v) for u, v in pairs]
        base += 20
    hub = [(base, base + i) for i in range(1, 80)] + [(base + 78, base + 79)]
    path = [(base + 100 + i, base + 101 + i) for i in range(70)] + [(base + 110, base + 130)]
    return out + hub + path


@pytest.fixture(scope="module")
def pairs():
    found = _graphs()
    rnd = random.Random(1)
    names = list(range(10_000))
    rnd.shuffle(names)  # ids say nothing of places
    return [(names[u], names[v]) for u, v in found]


def test_cut_nodes_equal_the_search(spark, pairs):
    near: dict = {}
    for u, v in pairs:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want, seen = set(), {}
    for root in near:
        if root not in seen:
            want |= graph.low_points(near, root, seen)
    edges = spark.createDataFrame(pairs + pairs[:5] + [(v, u) for u, v in pairs[5:9]] + [(pairs[0][0],) * 2], "u long, v long")
    got = [r["node_id"] for r in biconnected.cut_nodes(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_forest_and_numbers(spark, pairs):
    edges = spark.createDataFrame(sorted({tuple(sorted(p)) for p in pairs}), "u long, v long")
    tree, roots = biconnected.spanning_forest(edges)
    tree = [tuple(r) for r in tree.collect()]
    root = {r["node_id"]: r["root"] for r in roots.collect()}
    assert len(tree) == len(set(tree)) == len(root) - len(set(root.values())) and all(root[u] == root[v] for u, v in pairs)
    nodes = {r["node_id"]: r for r in biconnected.rooted(spark.createDataFrame(tree, "u long, v long"), roots).collect()}
    assert nodes.keys() == root.keys() and sorted(tuple(sorted((n, r["parent"]))) for n, r in nodes.items() if r["parent"] is not None) == sorted(tree)
    for n, r in nodes.items():
        inside = [x for x in nodes.values() if x["root"] == r["root"] and r["pre"] <= x["pre"] < r["pre"] + r["size"]]
        assert len(inside) == r["size"] and all(x["parent"] in {y["node_id"] for y in inside} for x in inside if x["node_id"] != n)


def test_no_edges(spark):
    assert biconnected.cut_nodes(spark.createDataFrame([], "u long, v long")).count() == 0
