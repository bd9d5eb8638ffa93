import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import scores
from tessella.operators import aggregates, autocorr, biconnected, diagnostics, graph, replay, scan
from tessella.plans import registry
from tessella.sources import derived, files, lattice
from tessella.streaming import replay as streaming

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,k,sizes", [(40, 2, [800, 800]), (40, 3, [515, 570, 515]), (41, 2, [820, 841, 20]), (5, 3, [7, 9, 7, 2])])
def test_angular_sizes(spark, n, k, sizes):
    got = lattice.angular(lattice.square_nodes(spark.range(n * n), n), n, k).groupBy("district_id").count().orderBy("district_id").collect()
    assert [r["count"] for r in got] == sizes


def test_running_sum_blocks_equal_plain_window(spark):
    df = spark.range(1000).withColumns({"k": F.col("id") % 3, "v": F.col("id") * 7 % 11})
    got = scan.running_sum(df, ["k"], "id", {"s": F.col("v")}, block=64).toPandas().sort_values("id")
    want = df.toPandas().sort_values("id")
    assert (want.groupby("k")["v"].cumsum().to_numpy() == got["s"].to_numpy()).all()


def test_running_sum_tells_the_next_order_across_blocks(spark):
    df = spark.range(1000).where("id % 200 < 7").withColumns({"k": F.col("id") % 3, "v": F.lit(1)})
    got = scan.running_sum(df, ["k"], "id", {"s": F.col("v")}, after="next", block=64).toPandas().sort_values("id")
    want = df.toPandas().sort_values("id").groupby("k")["id"].shift(-1)
    assert got["next"].fillna(-1).astype(int).tolist() == want.fillna(-1).astype(int).tolist()
    assert set(got.columns) == {"id", "k", "v", "s", "next"}


def test_dwell_sums_to_steps(spark):
    r = registry.relations(spark, SF)
    per = replay.dwell(r.log, r.start).groupBy("chain_id", "node_id").agg(F.sum("dwell").alias("t")).join(replay.lengths(r.log), "chain_id")
    assert per.where("t <> steps").count() == 0


def test_probed_counts(spark):
    r = registry.relations(spark, SF)
    assert (r.nodes.count(), r.edges.count()) == (15, 18)
    accepted = {x["chain_id"]: x["accepted"] for x in registry.QUERIES["p1_accepted"](spark, SF).collect()}
    assert [accepted[i] for i in range(4)] == [199, 197, 193, 200]
    wins = {x["wins"]: x["count"] for x in registry.QUERIES["t5_districts_won"](spark, SF).groupBy("wins").count().collect()}
    assert wins == {1: 25, 2: 277, 3: 576, 4: 122}


def test_replayed_districts_equal_naive(spark):
    r = registry.relations(spark, SF)
    log = r.log.where("chain_id = 1").toPandas().sort_values("step")
    colour = {x["node_id"]: x["district_id"] for x in r.start.collect()}
    votes = {x["node_id"]: (x["p1"], x["p2"]) for x in r.votes.collect()}
    want = []
    for node, new in zip(log["node_id"], log["new_color"]):
        if not pd.isna(node):
            colour[int(node)] = int(new)
        sums = {}
        for v, c in colour.items():
            a, b = sums.get(c, (0, 0))
            sums[c] = (a + votes[v][0], b + votes[v][1])
        want.append(sum(a > b for a, b in sums.values()))
    got = replay.districts_won(r.log, r.start, r.votes).where("chain_id = 1").orderBy("step").toPandas()["wins"].tolist()
    assert got == want


def test_waits_and_open_end(spark):
    log = spark.createDataFrame([(0, 0, 1, 0, 1), (0, 1, None, None, None), (0, 2, None, None, None), (0, 3, 1, 1, 0)], "chain_id long, step long, node_id long, old_color int, new_color int")
    assert [r["wait"] for r in diagnostics.waits(log).orderBy("step").collect()] == [2, 1]


def test_cut_vertices_of_a_path_and_a_ring(spark):
    e = spark.createDataFrame([(0, 1, 1), (1, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1)], "u long, v long, border_length long")
    a = spark.createDataFrame([(i, 0 if i < 3 else 1) for i in range(6)], "node_id long, district_id int")
    assert [r["node_id"] for r in biconnected.cut_vertices(a, e).collect()] == [1]
    got = {r["node_id"]: r["component_id"] for r in graph.components(a, e).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}


def test_quantised_halves_go_to_even(spark):
    got = spark.createDataFrame([(0.205,), (0.5,)], "x double").select(scores.quantised(F.col("x")).alias("q")).collect()
    assert [r["q"] for r in got] == [round(0.41 * 100) / 100 / 2, 0.5]


def test_weighted_pick_respects_the_weights(spark):
    moves = spark.range(4000).select(F.col("id").alias("chain_id"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("node_id"), F.lit(0).alias("old_color"), F.lit(1).alias("new_color"), F.lit(0).alias("score"))
    got = graph.weighted_pick(moves, F.col("node_id") + 1.0, seed=3)
    share = {r["node_id"]: r["count"] / 4000 for r in got.groupBy("node_id").count().collect()}
    assert all(math.isclose(share[k], (k + 1) / 6, abs_tol=0.03) for k in range(3))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.weighted_pick(moves.repartition(3), F.col("node_id") + 1.0, seed=3).collect()))


def test_neighbour_over_empty_blocks(spark):
    rows = [(k, s) for k in (0, 1) for s in (0, 3, 4, 41, 42, 90)] + [(2, 7)]
    df = spark.createDataFrame(rows, "k int, s long")
    for ahead in (False, True):
        got = scan.neighbour(df, ["k"], "s", {"x": F.col("s")}, ahead=ahead, block=10).collect()
        own = [0, 3, 4, 41, 42, 90]
        near = dict(zip(own, own[1:] + [None])) if ahead else dict(zip(own, [None] + own[:-1]))
        assert {(r["k"], r["s"]): r["x"] for r in got} == {**{(k, s): near[s] for k in (0, 1) for s in own}, (2, 7): None}


def test_acf_in_blocks_equals_one_block(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("chain_id"), F.expr("id div 2").alias("step"), (F.col("id") * 37 % 11).alias("v"))
    one = {(r["chain_id"], r["lag"]): r["acf"] for r in diagnostics.autocorrelation(df, "v", 5).collect()}
    many = {(r["chain_id"], r["lag"]): r["acf"] for r in diagnostics.autocorrelation(df, "v", 5, block=16).collect()}
    assert one.keys() == many.keys() and len(one) == 12 and all(math.isclose(one[k], many[k], abs_tol=1e-9) for k in one)


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(0, 90)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    e = spark.createDataFrame(path, "u long, v long")
    n = spark.createDataFrame([(i,) for i in [*range(0, 91), *range(200, 260), 300, 301]], "node_id long")
    got = {r["node_id"]: r["component_id"] for r in graph.components(n, e).collect()}
    assert got == {**dict.fromkeys(range(91), 0), **dict.fromkeys(range(200, 260), 200), 300: 300, 301: 301}


def test_lists_make_a_state(spark):
    n, e, a = files.from_lists(spark, [(1, 0.0, 0.0, 5, 1.0), (2, 1.0, 0.0, 7, 1.0)], [(1, 2, 3.0)], {1: 0, 2: 1})
    assert aggregates.by_district(n, a).agg(F.sum("population")).first()[0] == 12
    assert [tuple(r) for r in graph.cut_edges(e, a).collect()] == [(1, 2, 3.0, 0, 1)]


def test_points_in_buckets_equal_plain_agreement(spark):
    r = registry.relations(spark, SF)
    held, nodes = replay.intervals(r.log, r.start), r.nodes
    near = {(x["chain_id"], x["dist"]): x["g"] for x in autocorr.from_points(held, nodes, 50, 37, 5).collect()}
    log, start = r.log.toPandas(), {x["node_id"]: x["district_id"] for x in r.start.collect()}
    for chain in (0, 3):
        colour, states = dict(start), []
        for _, m in log[log["chain_id"] == chain].sort_values("step").iterrows():
            if not pd.isna(m["node_id"]):
                colour[int(m["node_id"])] = int(m["new_color"])
            states.append(dict(colour))
        for dist in (0, 5, 36):
            locs = [k for k in range(0, len(states), 50) if k < len(states) - 37]
            want = sum(sum(states[k][v] == states[k + dist][v] for v in start) for k in locs) / len(locs) - len(start) / 5
            assert math.isclose(near[(chain, dist)], want, abs_tol=1e-9)


def test_folder_votes_and_catalogue(spark, tmp_path):
    (tmp_path / "A_BORDERLENGTHS.txt").write_text("-1\t1\t2.0\n1\t2\t3.0\n2\t1\t3.0\n")
    (tmp_path / "A_CENTROIDS.txt").write_text("1\t0.0\t0.0\n2\t1.0\t0.0\n")
    (tmp_path / "A_POPULATION.txt").write_text("1\t10\n2\t20\n")
    (tmp_path / "A_AREAS.txt").write_text("1\t1.5\n2\t2.5\n")
    nodes, edges = files.graph_folder(spark, str(tmp_path))
    assert {(r["node_id"], r["boundary"], r["external_border"]) for r in nodes.collect()} == {(1, True, 2.0), (2, False, 0.0)}
    assert [tuple(r) for r in edges.collect()] == [(1, 2, 3.0)]
    (tmp_path / "v.tsv").write_text("1\t3\t4\t7\t\n")
    assert tuple(files.vote_file(spark, str(tmp_path / "v.tsv")).first()) == (1, 3, 4, 7)
    old, new = spark.createDataFrame([("a",)], "filepath string"), spark.createDataFrame([("a",), ("b",)], "filepath string")
    assert sorted(r[0] for r in files.new_runs(new, old).collect()) == ["a", "b"]


def test_streamed_waits_equal_batch(spark, tmp_path):
    log = derived.move_log(spark, SF).cache()
    for low in (0, 120):
        part = log.where((F.col("step") >= low) & (F.col("step") < low + 120 + 1000 * (low > 0)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    q = streaming.waits(streaming.log_stream(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("waits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("waits").collect())) == sorted(map(tuple, diagnostics.waits(log).collect()))


def _streamed(spark, query, name, mode, tmp_path):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streamed_flips_and_dwell_equal_batch(spark, tmp_path):
    r = registry.relations(spark, SF)
    log = r.log.cache()
    for low in (0, 120):
        part = log.where((F.col("step") >= low) & (F.col("step") < low + 120 + 1000 * (low > 0)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    flips = _streamed(spark, streaming.running_flips(streaming.log_stream(spark, str(tmp_path / "log"))), "flips", "complete", tmp_path)
    assert sorted(map(tuple, flips.collect())) == sorted(map(tuple, replay.flips(log).collect()))
    sent = _streamed(spark, streaming.dwell(streaming.log_stream(spark, str(tmp_path / "log"))), "dwells", "append", tmp_path)
    # the stretch that a node is in has not ended: batch has it, the stream not yet
    got = {(x[0], x[1], x[2]): x[3] for x in sent.groupBy("chain_id", "node_id", "color").agg(F.sum("dwell")).collect() if x[3]}
    held = replay.intervals(log, r.start).join(replay.lengths(log), "chain_id").where("end_step < steps")
    want = {(x[0], x[1], x[2]): x[3] for x in held.groupBy("chain_id", "node_id", "color").agg(F.sum(F.col("end_step") - F.col("start_step"))).collect()}
    assert got == want
