"""Each operator on nulls, empty and very long texts, ties, repeats, empty tables and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import licenses, lines, mixing, ngram_join, packing, secrets, toxicity, vectors, vptree, warc

rnd = random.Random(3)
#: Names that the operators use themselves, as columns of a caller.
CLASHES = (
    "row skey h size salt times threshold edge target source_size copies th removed kept empty gone_id gone_th n_lines rid key name n root bucket "
    "score id y part before offset queue ids doc_tokens base added __key __doc_id __r __th __removed spans value_hash n_owners payload record_type"
).split()
LONG = "\n".join(" ".join(f"t{rnd.randrange(5000)}" for _ in range(40)) for _ in range(12000))  # 2.7 MB
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "s1"),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "s1"),
    (2, "alpha beta gamma delta epsilon zeta eta theta", "s1"),
    (None, "alpha beta gamma delta epsilon zeta eta theta", None),
    (3, None, "s2"),
    (4, "", None),
    (5, " \n\t ", "s2"),
    (6, LONG, "s2"),
    (7, LONG, "s3"),
    (None, None, None),
    (8, "token=abcdef123456 é\U0001f600 token=abcdef123456", "s3"),
    (8, "another text of id eight", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return plain.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, None), (None, 1, 1), (8, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


def _plain(df, columns=("doc_id", "text", "source")):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_mixing(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and set(_plain(out)) <= set(ROWS)
    taken = mixing.mix_sources(docs).collect()
    assert len(taken) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in taken)
    assert {r["size"] for r in taken if r["doc_id"] == 6} == {480000}
    assert out.count() == sum(r["times"] for r in taken)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_toxicity(docs, labels):
    out = toxicity.score_documents(docs, labels)
    assert out.count() == len(ROWS) and out.where("score < 0 or score > 1 or score is null").count() == 0
    clean = toxicity.clean_documents(docs, labels)
    assert clean.columns == docs.columns and set(_plain(clean)) <= set(ROWS)
    assert toxicity.clean_documents(docs.limit(0), labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_fits_on_bounded_bytes(spark):
    rows = [(i, ("idiot " if i % 2 else "fine ") + f"w{i} " * 20) for i in range(200)]
    d = spark.createDataFrame(rows + [(1, "x " * 100_000)] * 3, "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    assert toxicity.train(d, lab, sample=50, sample_bytes=4000) is not None
    assert toxicity.train(d, lab, sample=50, sample_bytes=16) is None


@pytest.mark.parametrize("words", [1, 50])
def test_lines(docs, words):
    out = lines.deduped_documents(docs, words)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r for r in lines.dedup_lines(docs, words).collect() if r["doc_id"] in (3, 4, 5, 6, 7)}
    assert got[3]["text"] is None and got[3]["n_lines"] == 0 and got[4]["n_lines"] == 1 and got[4]["text"] == ""
    assert got[6]["text"] == LONG and got[6]["removed"] is None and got[7]["empty"] and len(got[7]["removed"]) == 12000
    assert lines.deduped_documents(docs.limit(0), words).count() == 0


def _brute_lines(texts, least):
    """Lines of later copies: every run of equal lines with ``least`` words that occurred earlier, by all pairs of starts."""
    split = [t.split("\n") for t in texts]
    at = [(d, i) for d, ls in enumerate(split) for i in range(len(ls))]
    gone = set()
    for b in range(len(at)):
        for a in range(b):
            (d, i), (e, j) = at[a], at[b]
            n, words = 0, 0
            while i + n < len(split[d]) and j + n < len(split[e]) and split[d][i + n] == split[e][j + n]:
                words += len(split[e][j + n].split())
                n += 1
            if words >= least and n:
                # the run as far as it goes: its shortest windows of enough words from and up to each line cover it
                gone |= {(e, j + k) for k in range(n)} if words >= least else set()
    return gone


@pytest.mark.parametrize("least", [1, 4])
def test_line_runs_equal_brute_force(spark, least):
    r = random.Random(least)
    pool = ["a", "b b", "c", "d d d", "e", "f f"]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.8 else f"u{r.random()}" for _ in range(r.randrange(1, 9))) for _ in range(25)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x["doc_id"], k) for x in lines.dedup_lines(frame, least).collect() for k in x["removed"] or []}
    assert got == _brute_lines(texts, least)


def test_secrets(docs):
    out = secrets.scan_secrets(docs).collect()
    assert len(out) == len(ROWS)
    eight = [r for r in out if r["n_assign"]]
    assert len(eight) == 1 and eight[0]["spans"] == "assign:0:18,assign:22:40" and eight[0]["most_repos"] == 1
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_secrets_with_many_hits_and_many_repositories(spark):
    many = " ".join(f"token=value{i:06d}" for i in range(20000))
    rows = [(0, many, "a")] + [(i, "x token=sharedvalue9", "a") for i in range(1, 31)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0]["n_assign"] == 20000 and got[0]["n_live"] == 20000 and got[0]["spans"].endswith(f"assign:{len(many) - 17}:{len(many)}")
    assert got[1]["n_live"] == 0 and got[1]["n_copied"] == 1 and got[1]["most_repos"] == 30


def test_warc(spark, tmp_path, docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), *CLASHES)
    warc.write_archives(pages, str(tmp_path / "w"))
    got = warc.read_pages(spark, str(tmp_path / "w"), str(tmp_path / "gaps")).collect()
    assert len(got) == len(ROWS) and spark.read.parquet(str(tmp_path / "gaps")).count() == 0
    assert {r["record_type"] for r in got if r["page_id"] == 2} == {"response"} and {r["refers_to"] for r in got if r["page_id"] in (1, 6)} == {2, 7}
    assert [r["payload_bytes"] for r in got if r["page_id"] == 6] == [len(LONG)]


def test_licences(docs):
    one = docs.where("doc_id = 1").withColumn("text", F.lit("Released under the MIT License. Released under the MIT License."))
    got = licenses.scan_licences(docs.unionByName(one).unionByName(one)).collect()
    assert len(got) == len(ROWS) + 2
    assert [(r["span_start"], r["span_end"], r["n_licences"]) for r in got if r["licence"]] == [(0, 31, 1)] * 2


def test_jaccard(docs):
    got = sorted((tuple(r) for r in ngram_join.jaccard_groups(docs).collect()), key=str)
    assert len(got) == len(ROWS) and (None, 4, 1) in got and (7, got[[g[0] for g in got].index(7)][1], 6) in got
    kept = ngram_join.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()), key=str) == sorted(
        [(r[0], r[1]) for r in (ROWS[0], ROWS[4], ROWS[5], ROWS[6], ROWS[7], ROWS[9], ROWS[10], ROWS[11])], key=str
    )
    assert ngram_join.distinct_documents(docs.limit(0)).count() == 0


def test_packing(docs):
    got = packing.pack(docs).toPandas()
    starts = got[got["start"] == 0]
    assert len(starts) == len(ROWS) and got["length"].sum() == starts["doc_tokens"].sum() and (starts["doc_tokens"] == 1).sum() == 3
    at = (got["sequence_id"] * 1024 + got["offset"]).sort_values()
    assert at.iloc[0] == 0 and got["length"].max() <= 1024


def test_vectors_with_clashing_columns_and_ties(spark):
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 else [0.0, 1.0, 0.0]) for i in range(60)] + [(0, [1.0, 0.0, 0.0]), (None, [0.0, 0.0, 1.0]), (None, None)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    frame = frame.select("*", *[F.lit(1).alias(c) for c in ("rid", "v", "ok", "m", "shard", "query", "rank", "root", "n_links", "pv")])
    got = vectors.range_join(frame).collect()
    assert len(got) == 63 and {r["component_id"] for r in got if r["vec_id"] == 1} == {0} and {r["n_links"] for r in got if r["vec_id"] == 1} == {40}
    near = vptree.nearest(frame, k=5).collect()
    first = sorted(r["vec_id"] for r in near if r["query_id"] == 20)
    assert first == [0, 1, 2, 4, 5]


def test_pipeline_on_edges(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard", "source_mixing", "packing"]
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns, name
            out.write.parquet(str(tmp_path / name))
            frame = spark.read.parquet(str(tmp_path / name))
    by_stage = out.select("doc_id", "start", "length", "doc_tokens")
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "doc_tokens")
    assert sorted(map(tuple, by_stage.groupBy("doc_id").sum("length").collect()), key=str) == sorted(map(tuple, whole.groupBy("doc_id").sum("length").collect()), key=str)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
