"""What the n-gram join holds and writes, whatever the size of its texts."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, ngram_join


@pytest.fixture
def tags(spark, monkeypatch):
    """(tag, bytes of a batch) of what the join stores."""
    found, store = [], ngram_join.stored

    def noted(df, tag="cut"):
        found.append((tag, spark.conf.get(common.BATCH, None)))
        return store(df, tag)

    monkeypatch.setattr(ngram_join, "stored", noted)
    return found


def _texts(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.col("id") % 40) for i in range(30)]).alias("text"))


def test_rows_go_to_python_in_bounded_batches(spark, monkeypatch, tags):
    before = spark.conf.get(common.BATCH, None)
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 14)
    docs = _texts(spark, 2000)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["size"])

    with common.small_batches(spark):
        largest = docs.select("text").mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]
    assert largest < 1 << 15
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_groups(docs).collect()}
    assert got == {i: i % 40 for i in range(2000)}
    assert {size for tag, size in tags if tag in ("scanned", "sets", "linked")} == {str(1 << 14)}
    assert spark.conf.get(common.BATCH, None) == before


def test_few_hashes_of_words_are_kept():
    cache = ngram_join._WordHashes()
    for i in range(300_000):
        cache[b"%d" % i]
    assert len(cache) <= 1 << 17


def test_rows_in_files_are_not_written_again(spark, tmp_path, tags):
    docs = _texts(spark, 400).withColumn("_metadata", F.col("doc_id") % 7)
    twice = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")))
    twice.repartition(5).write.parquet(str(tmp_path / "a b"))
    read = spark.read.parquet(str(tmp_path / "a b"))
    tags.clear()
    got = ngram_join.distinct_documents(read, in_files=True)
    assert got.columns == docs.columns and "numbered" not in [tag for tag, _ in tags]
    assert sorted((r["doc_id"], r["text"] is None) for r in got.collect()) == sorted([(i, False) for i in range(40)] + [(i, True) for i in range(2)])
    # rows without a place in a file are numbered in a copy
    assert ngram_join.distinct_documents(docs, in_files=True).count() == 40
    assert "numbered" in [tag for tag, _ in tags]


def test_the_pipeline_sends_bounded_batches_to_python(spark, monkeypatch):
    import corpus_pipeline

    before = spark.conf.get(common.BATCH, None)
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 14)
    monkeypatch.setattr(corpus_pipeline.toxicity, "clean_documents", lambda docs, labels: docs)
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: None)
    size = F.pandas_udf(lambda texts: texts.str.len().sum() + 0 * texts.str.len(), "long")
    try:
        docs = corpus_pipeline.drop_toxic(spark, _texts(spark, 2000), "")
        assert docs.select(size("text").alias("n")).agg(F.max("n")).first()[0] < 1 << 15
    finally:
        spark.conf.unset(common.BATCH) if before is None else spark.conf.set(common.BATCH, before)
