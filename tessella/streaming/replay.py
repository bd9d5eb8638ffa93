"""Replay metrics over a move log that arrives as a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

LOG = "chain_id long, step long, node_id long, old_color int, new_color int"


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a log as they appear."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def waits(stream: DataFrame) -> DataFrame:
    """(chain_id, step, wait) as rejections arrive; a chain's steps arrive in order of batches."""

    def run(key, frames, state):
        last = state.get[0] if state.exists else -1
        steps = sorted(s for f in frames for s, n in zip(f["step"], f["node_id"]) if pd.isna(n))
        out = []
        for s in steps:
            out.append((key[0], s, s - last))
            last = s
        state.update((last,))
        yield pd.DataFrame(out, columns=["chain_id", "step", "wait"])

    return stream.groupBy("chain_id").applyInPandasWithState(run, "chain_id long, step long, wait long", "last long", "append", GroupStateTimeout.NoTimeout)


def running_flips(stream: DataFrame) -> DataFrame:
    """Accepted moves by chain and node so far (complete or update mode)."""
    return stream.where("node_id is not null").groupBy("chain_id", "node_id").agg(F.count("*").alias("flips"))


def dwell(stream: DataFrame) -> DataFrame:
    """(chain_id, node_id, color, dwell): a stretch of one colour, sent when the node leaves it.

    The stretch that a node is still in is not sent, so sums lack what the
    batch operator adds for it up to the end of the log.
    """

    def run(key, frames, state):
        since = state.get[0] if state.exists else 0
        moves = sorted((int(s), int(o)) for f in frames for s, o in zip(f["step"], f["old_color"]))
        out = []
        for s, old in moves:
            out.append((key[0], key[1], old, s - since))
            since = s
        state.update((since,))
        yield pd.DataFrame(out, columns=["chain_id", "node_id", "color", "dwell"])

    accepted = stream.where("node_id is not null")
    return accepted.groupBy("chain_id", "node_id").applyInPandasWithState(run, "chain_id long, node_id long, color int, dwell long", "since long", "append", GroupStateTimeout.NoTimeout)
