"""The packed colouring matrix against plain intervals, and agreement counted in its rows against a join of snapshots."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import autocorr, matrix, replay
from tessella.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def held(spark):
    r = registry.relations(spark, SF)
    return replay.intervals(r.log, r.start).cache(), r


@pytest.mark.parametrize("stretch", [1, 16, 4096])
def test_lookups_equal_snapshots(spark, held, stretch):
    held, r = held
    m = matrix.packed(held, stretch)
    want = {tuple(x) for x in replay.snapshots(held, 3).collect()}
    asked = replay.snapshots(held, 3).select("chain_id", "step", "node_id", F.lit("kept").alias("extra"))
    got = [(x["chain_id"], x["step"], x["node_id"], x["color"]) for x in matrix.lookup(m, asked, stretch).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {(x["chain_id"], x["k"] * 3, x["node_id"], x["color"]) for x in matrix.sampled(m, 3).collect()} == want
    # no more runs than moves and starts
    assert m.select(F.sum(F.size("starts"))).first()[0] == held.count() and m.count() <= held.count()
    assert matrix.lookup(m, asked.withColumn("step", F.col("step") + 10_000), stretch).count() == 0


@pytest.mark.parametrize(("every", "furthest", "block"), [(5, 37, 64), (7, 60, 4), (10, 10, 3), (50, 400, 2)])
def test_agreement_equals_all_pairs_of_snapshots(held, every, furthest, block):
    held, r = held
    colour = {(x["chain_id"], x["step"], x["node_id"]): x["color"] for x in replay.snapshots(held, every).collect()}
    steps = {x["chain_id"]: x["steps"] for x in held.groupBy("chain_id").agg(F.max("end_step").alias("steps")).collect()}
    chance = r.nodes.count() / 5
    for whole, f in ((True, autocorr.at_distances), (False, autocorr.all_pairs)):
        agree, locs = defaultdict(int), defaultdict(set)
        for (c, s, n), k in colour.items():
            for d in range(0, furthest, every):
                if (c, s + d, n) in colour and not (whole and s >= steps[c] - furthest):
                    agree[c, d] += colour[c, s + d, n] == k
                    locs[c, d].add(s)
        got = {(x["chain_id"], x["dist"]): (x["locs"], x["g"]) for x in f(held, r.nodes, every, furthest, 5, block).collect()}
        assert got.keys() == locs.keys()
        assert all(got[k][0] == len(locs[k]) and math.isclose(got[k][1], agree[k] / len(locs[k]) - chance, abs_tol=1e-9) for k in got)
