"""The training-data pipeline: documents in, packed sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import lines, mixing, ngram_join, packing, toxicity
from tessella.llm.common import drop_stored, keep_small_batches, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain predicts toxic go."""
    # workers stay on between stages with the memory that they took for batches of texts
    keep_small_batches(spark)
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; so do documents left without a word."""
    return lines.deduped_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by shingle Jaccard, the one with the smallest doc_id stays."""
    return ngram_join.distinct_documents(docs, in_files=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source are dropped or repeated to reach its target."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of tokens."""
    keep_small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("source_mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stored(stage(spark, docs, sf_dir), name)
        drop_stored(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL expresses neither the chain nor the tokenizer.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict = {}
