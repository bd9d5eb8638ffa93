"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of the Arrow batches that rows go to Python in, within ``small_batches``.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one local process, as in tests,
    a temporary one is taken: executors elsewhere could not read it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessella-{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Deletes ``path`` when the application ends, if nothing has by then."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


def delete(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def stored(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there.

    It is deleted at the end of the application, or before by ``drop_stored``.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    again = df.sparkSession.read.schema(df.schema).parquet(path)
    again._tessella_path = path
    return again


def drop_stored(*frames: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_tessella_path", None)
        if path:
            delete(df.sparkSession, path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside send rows to Python in batches of ``BATCH_BYTES``, or a row more.

    Otherwise a batch has 10000 rows: as many texts stand in a task's memory, in the JVM and in Python.
    """
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH)
        else:
            spark.conf.set(BATCH, before)


def keep_small_batches(spark: SparkSession) -> None:
    """As ``small_batches``, from now on: for a result that is only written after its query returned."""
    spark.conf.set(BATCH, str(BATCH_BYTES))


def whole_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """Each row as one struct column, row, and ``more``: names of its columns cannot clash with an operator's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def let(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def null_key(value: Column) -> Column:
    """A string that tells null from every value, for joins."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def doc_key(doc_id: Column, text: Column) -> Column:
    """A key of a document: rows with equal doc_id and text are one document."""
    return F.concat_ws(":", null_key(doc_id), F.xxhash64(text).cast("string"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
