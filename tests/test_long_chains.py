"""Chains far longer than what could be laid out by step: results must come from moves alone."""

import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import autocorr, matrix, proposals, replay
from tessella.plans import registry

END = 10**14
LOG = "chain_id long, step long, node_id long, old_color int, new_color int"


@pytest.fixture(scope="module")
def held(spark):
    # node 1 never moves, node 2 once
    return spark.createDataFrame([(0, 1, 0, 0, END), (0, 2, 1, 0, 500), (0, 2, 0, 500, END)], "chain_id long, node_id long, color int, start_step long, end_step long")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(1,), (2,)], "node_id long")


def test_agreement_at_distances(held, nodes):
    locs = -(-(END - 500) // 50)
    got = {r["dist"]: (r["locs"], r["g"]) for r in autocorr.at_distances(held, nodes, 50, 500, 5).collect()}
    assert got.keys() == set(range(0, 500, 50))
    assert all(n == locs and math.isclose(g, (2 * locs - d // 50) / locs - 2 / 5) for d, (n, g) in got.items())


def test_agreement_from_points(held, nodes):
    got = {r["dist"]: (r["locs"], r["g"]) for r in autocorr.from_points(held, nodes, 250, 100, 5).collect()}
    locs = -(-(END - 100) // 250)
    assert got.keys() == set(range(100)) and {n for n, _ in got.values()} == {locs}
    assert all(math.isclose(g, 2 - 2 / 5) for _, g in got.values())


def test_points_where_no_node_agrees_have_a_row(spark, nodes):
    moved = spark.createDataFrame([(0, n, c, s, e) for n in (1, 2) for c, s, e in ((0, 0, 1), (1, 1, 20))], "chain_id long, node_id long, color int, start_step long, end_step long")
    got = {r["dist"]: r["g"] for r in autocorr.from_points(moved, nodes, 100, 3, 2).collect()}
    assert got == {0: 1.0, 1: -1.0, 2: -1.0}


def test_agreement_of_all_pairs(held, nodes):
    got = {r["dist"]: (r["locs"], r["g"]) for r in autocorr.all_pairs(held, nodes, 100, 500, 5).collect()}
    assert {d: n for d, (n, _) in got.items()} == {d: END // 100 - d // 100 for d in range(0, 500, 100)}
    assert all(math.isclose(g, 2 - 2 / 5, rel_tol=1e-9) for _, g in got.values())


def test_lookup_in_rows_that_cover_long_times(spark, held):
    asked = spark.createDataFrame([(0, s, n) for n in (1, 2) for s in (0, 499, 500, END - 1, END)], "chain_id long, step long, node_id long")
    got = {(r["node_id"], r["step"]): r["color"] for r in matrix.lookup(matrix.packed(held, 512), asked, 512).collect()}
    assert got == {(1, s): 0 for s in (0, 499, 500, END - 1)} | {(2, 0): 1, (2, 499): 1, (2, 500): 0, (2, END - 1): 0}


def test_scores_of_moves_far_apart(spark):
    log = spark.createDataFrame([(0, 0, 2, 1, 0), (0, 7, None, None, None), (0, END, 2, 0, 1)], LOG)
    start = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "node_id long, district_id int")
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1)], "u long, v long, border_length long")
    got = {r["step"]: r["score"] for r in replay.move_scores(log, start, edges.where("not (u = 1 and v = 3)")).collect()}
    assert got == {0: 0, END: 0}
    assert {(r["step"], r["other"], r["color"]) for r in replay.near_moves(log, start, edges).collect()} == {(s, n, c) for s in (0, END) for n, c in ((1, 0), (3, 1))}


def test_proposals_that_hold_for_long(spark):
    log = spark.createDataFrame([(0, 0, 2, 1, 0), (0, 7, None, None, None), (0, END, 2, 0, 1)], LOG)
    start = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "node_id long, district_id int")
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "u long, v long, border_length long")
    held = proposals.proposal_intervals(log, start, edges).cache()
    got = {tuple(r) for r in held.select("node_id", "old_color", "new_color", "score", "first", "after").collect()}
    late = END + 1
    edge = {(1, 0, 1, -1), (2, 1, 0, 0)}
    assert got == {(*p, *t) for p in edge for t in ((0, 1), (late, late + 1))} | {(*p, 1, late) for p in ((2, 0, 1, 0), (3, 1, 0, -1))}
    weight = 1 + math.exp(0.5)
    scored = replay.move_scores(log, start, edges).select("chain_id", "step", "node_id", "old_color", "new_color", "score")
    sums = {r["step"]: (r["forward"], r["reverse"]) for r in proposals.normalisers(log, held, scored, 1.0).collect()}
    assert sums.keys() == {0, END} and all(math.isclose(x, weight) for s in sums.values() for x in s)
    totals = sorted((r["start_step"], r["end_step"], round(r["total"], 6)) for r in proposals.pair_totals(held, log, 1.0).collect())
    assert {x[2] for x in totals} == {round(weight, 6)} and totals[0][0] == 0 and totals[-1][1] == END + 1
    assert all(a[1] == b[0] for a, b in zip(totals, totals[1:]))


def test_states_are_no_more_than_the_moves(spark):
    log = spark.createDataFrame([(c, s, s % 100, s % 2, 1 - s % 2) for c in (0, 1) for s in range(200)], LOG)
    start = spark.createDataFrame([(n, n % 2) for n in range(100)], "node_id long, district_id int")

    def size(chain, moves, colours):
        import pandas as pd

        return pd.DataFrame({"chain_id": [chain], "moves": [len(moves)], "nodes": [len(colours)]})

    got = [tuple(r) for r in replay.replay(log, start, size, "chain_id long, moves long, nodes long", stretch=1).collect()]
    assert sorted(got) == [(0, 100, 100)] * 2 + [(1, 100, 100)] * 2


@pytest.mark.parametrize("name", ["v3_perimeter_area", "v4_population", "v7_boundary_nodes", "g10_contested_nodes"])
def test_traces_come_without_intervals_of_edges(spark, monkeypatch, name):
    def no(*_):
        raise AssertionError("intervals of every edge")

    monkeypatch.setattr(replay, "edge_intervals", no)
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_probes_are_laid_out_block_by_block(spark):
    held = spark.createDataFrame([(0, 1, 0, 0, 1000), (0, 2, 1, 0, 500), (0, 2, 0, 500, 1000), (0, 3, 1, 0, 1000)], "chain_id long, node_id long, color int, start_step long, end_step long")
    got = replay.colour_of(held, {"a": 1, "b": 2, "none": None}, block=10).withColumn("task", F.spark_partition_id()).cache()
    assert [(r["step"], r["a"], r["b"], r["none"]) for r in got.orderBy("step").collect()] == [(s, 0, int(s < 500), None) for s in range(1000)]
    assert max(r["count"] for r in got.groupBy("task").count().collect()) <= 300
