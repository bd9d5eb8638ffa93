"""Saved runs as a data source."""

import glob

import pytest
from pyspark.sql import functions as F

from tessella.plans import registry
from tessella.sources import runs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def saved(spark, tmp_path):
    r = registry.relations(spark, SF)
    path = str(tmp_path / "runs")
    settings = spark.createDataFrame([(c, "flip", 0.5 * c, [1.0, 0.25], ["cut_length", "compactness"], 5, 1) for c in range(4)], "chain_id long, class string, beta double, score_weights array<double>, score_funcs array<string>, num_districts int, involution_max int")
    runs.save_runs(r.log, settings, path)
    return r, path


def test_features_come_from_the_runs(spark, saved):
    r, path = saved
    got = {x["chain_id"]: x for x in runs.runs(spark, path).collect()}
    steps = {x["chain_id"]: x["n"] for x in r.log.groupBy("chain_id").agg(F.count("*").alias("n")).collect()}
    assert {k: x["run_length"] for k, x in got.items()} == steps
    assert all((x["class"], x["beta"], x["score_weights"], x["num_districts"], x["measure_beta"]) == ("flip", 0.5 * k, [1.0, 0.25], 5, None) and x["mod_time"] > 1e9 for k, x in got.items())
    assert runs.runs(spark, path).rdd.getNumPartitions() == 4


def test_a_filter_opens_only_its_run(spark, saved):
    _, path = saved
    for k in (0, 1, 3):  # what is opened beside run 2 fails
        for f in glob.glob(f"{path}/settings/chain_id={k}/part*"):
            with open(f, "w") as broken:
                broken.write("not json")
    with pytest.raises(Exception, match="JSONDecodeError"):
        runs.runs(spark, path).collect()
    assert [x["beta"] for x in runs.runs(spark, path).where("chain_id = 2").collect()] == [1.0]
    assert [x["beta"] for x in runs.runs(spark, path).where(F.col("chain_id").isin(2, 7) & (F.col("beta") > 0)).collect()] == [1.0]
    assert [x["chain_id"] for x in runs.runs(spark, path).where(F.col("filepath") == f"{path}/log/chain_id=2").collect()] == [2]
    assert runs.runs(spark, path).where("chain_id = 9").count() == 0
