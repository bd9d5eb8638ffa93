import time

import pytest
from pyspark.sql import functions as F

from tessella.operators import replay
from tessella.plans import registry
from tessella.sources import derived
from tessella.streaming import totals
from tessella.streaming.replay import log_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def relations(spark):
    r = registry.relations(spark, SF)
    r.log = r.log.cache()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    # three keyed steps a batch: a worker for each is enough here
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield r
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _run(spark, r, path, until, seconds=150):
    """Starts the query, or goes on from its checkpoint, until the sink satisfies ``until``."""
    stretches = totals.district_totals(log_stream(spark, f"{path}/log"), r.start, r.nodes, r.edges, r.votes, derived.DISTRICTS, idle_ms=2000)
    q = stretches.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/c").start()
    try:
        end = time.time() + seconds
        while time.time() < end:
            if q.exception():
                raise q.exception()
            if q.lastProgress and until(spark.read.schema(stretches.schema).parquet(f"{path}/out")):
                break
            time.sleep(1)
        else:
            pytest.fail("the stream did not get there in time")
    finally:
        q.stop()
    return spark.read.schema(stretches.schema).parquet(f"{path}/out")


def _write(r, path, low, high):
    r.log.where((F.col("step") >= low) & (F.col("step") < high)).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_streamed_totals_equal_batch_after_a_restart(spark, relations, tmp_path):
    """Steps 120 to 159 come last, after a restart, and one file comes twice."""
    r, path = relations, str(tmp_path)
    steps = {x["chain_id"]: x["steps"] for x in replay.lengths(r.log).collect()}
    closed = lambda at: lambda out: {x["chain_id"] for x in out.groupBy("chain_id", "district_id").agg(F.max("end_step").alias("e")).groupBy("chain_id").agg(F.min("e").alias("e"), F.count("*").alias("n")).where(f"n = {derived.DISTRICTS}").collect() if x["e"] == min(at, steps[x["chain_id"]])} == set(steps)  # noqa: E731,E501
    _write(r, path, 0, 120)
    _write(r, path, 160, 10**9)
    first = _run(spark, r, path, closed(120))
    assert first.agg(F.max("end_step")).first()[0] == 120
    _write(r, path, 60, 120)
    _write(r, path, 120, 160)
    got = _run(spark, r, path, closed(10**9))
    at = totals.at_steps(got)
    assert at.count() == at.select("chain_id", "step", "district_id").distinct().count() == sum(steps.values()) * derived.DISTRICTS
    want = replay.by_step(replay.district_traces(r.log, r.start, r.nodes, r.edges).where("n > 0"))
    names = ["chain_id", "step", "district_id", "perimeter", "area", "population", "n"]
    assert _rows(at.where("n > 0"), *names) == _rows(want, *names)
    assert _rows(totals.wins(got), "chain_id", "step", "wins") == _rows(replay.districts_won(r.log, r.start, r.votes), "chain_id", "step", "wins")
