"""Results written to the folder that driver and executors share, where a lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in ``spark.checkpoint.dir``; only a local process may do without that setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tessella-{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def delete_at_end(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Writes ``df`` and reads it back; deleted at the end of the application, or before by ``drop``."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._cut_path = path
    return again


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks(spark: SparkSession, groups: int) -> int:
    """Tasks for groups of rows that each take long: few groups a task, and, as a given number, not joined for their few bytes."""
    least = shuffle_partitions(spark)
    return max(least, min(16 * least, groups))


def drop(*frames: DataFrame) -> None:
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            files, where = _file_system(df.sparkSession, path)
            files.delete(where, True)
