"""Secret scan with corpus-wide ownership frequency, by SQL functions alone.

Candidates are found by patterns. Offsets come from splitting a text by the
same pattern: piece and match lengths alternate, so running sums give every
start. Hashes of the candidates' values are then counted over the corpus by
distinct repositories (documents) and owners (sources): values that several
owners or many repositories hold are copied examples, values in few
repositories of one owner look live. Beside the base kinds, long mixed tokens
are added as spans where they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, let, stored, table

ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
#: Base kinds in listed order: pattern, group of the value, its least length.
BASE = {"assign": (ASSIGN, 2, 6), "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
#: What the scan itself adds: long tokens that mix letters and digits.
ADDED = {"mixed": (r"[A-Za-z0-9_-]{32,}", 0, 32)}
KINDS = [*BASE, *ADDED]
#: A value that so many owners, or so many repositories, hold is a copied example.
COPIED_OWNERS, COPIED_REPOS = 3, 20

#: A run of hex digits counts from 24 on; asking for that at once skips short runs and finds the same runs.
SEARCHED = {"hex": r"[0-9a-f]{24,}"}


def _spans(text: Column, kind: str) -> Column:
    """array<struct(kind, ord, b, e, value)> of one kind, in order of offset."""
    pattern, group, least = (BASE | ADDED)[kind]
    pattern = SEARCHED.get(kind, pattern)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    shape = "array<struct<kind:string,ord:int,b:int,e:int,value:string>>"
    none = F.array().cast(shape)
    zero = F.lit(0)

    def placed(pairs: Column) -> Column:
        """Running sums in two steps of about the root of the number of hits each: arrays grow by copying."""
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(pairs)))).cast("int")

        def chunk(k: Column) -> Column:
            return F.slice(pairs, k * size + 1, size)

        def lengths(k: Column) -> Column:
            return F.aggregate(chunk(k), zero, lambda n, m: n + F.char_length(m["piece"]) + F.char_length(m["hit"]))

        def begin(acc: Column, n: Column) -> Column:
            return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

        def step(acc: Column, m: Column) -> Column:
            b = acc["at"] + F.char_length(m["piece"])
            e = b + F.char_length(m["hit"])
            value = F.regexp_extract(m["hit"], pattern, group) if group else m["hit"]
            span = F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("ord"), b.alias("b"), e.alias("e"), value.alias("value"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        chunks = F.sequence(zero, F.ceil(F.size(pairs) / size).cast("int") - 1)
        starts = F.aggregate(F.transform(chunks, lengths), F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), begin, lambda acc: acc["out"])
        in_chunk = lambda k, at: F.aggregate(chunk(k), F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, starts, in_chunk))

    pairs = let(F.split(text, pattern, -1), lambda pieces: let(found, lambda hits: F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit"))))
    spans = F.when(F.size(found) > 0, let(pairs, placed)).otherwise(none)
    return F.filter(F.coalesce(spans, none), lambda s: F.char_length(s["value"]) >= least)


def _joined(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["b"].alias("b"), s["ord"].alias("ord"), s["e"].alias("e"), s["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["b"].cast("string"), s["e"].cast("string"))))


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, __key and the spans found, base and added ones, stored.

    A mixed token is a candidate only where no base span overlaps it.
    """
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", "source", doc_key(F.col("doc_id"), F.col("text")).alias("__key"), *[_spans(text, k).alias(f"__{k}") for k in KINDS])
    base = F.concat(*[F.col(f"__{k}") for k in BASE])
    out = out.withColumn("base", base)

    def apart(s: Column) -> Column:
        mixed = s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        return mixed & ~F.exists("base", lambda t: (t["b"] < s["e"]) & (s["b"] < t["e"]))

    return stored(out.select("doc_id", "source", "__key", "base", F.filter("__mixed", apart).alias("added")), "spans")


def ownership(candidates: DataFrame) -> DataFrame:
    """(value_hash, n_repos, n_owners) over the whole corpus.

    Distinct (hash, owner, repository) rows are counted by hash in two steps,
    so that a value which a third of all documents share is summed before it
    is shuffled. Null is an owner of its own.
    """
    every = candidates.select("__key", F.coalesce("source", F.lit("\u0000")).alias("owner"), F.explode(F.concat("base", "added")).alias("s"))
    every = every.select(F.sha2("s.value", 256).alias("value_hash"), "owner", "__key")
    by_doc = every.groupBy("value_hash", "owner", "__key").agg(F.lit(1).alias("one"))
    by_owner = by_doc.groupBy("value_hash", "owner").agg(F.count("*").alias("n_repos"))
    return by_owner.groupBy("value_hash").agg(F.sum("n_repos").alias("n_repos"), F.count("*").alias("n_owners"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row a document: its spans, how many look live or copied, and in how many repositories its widest value is.

    Null text counts as empty and has no spans. Documents with equal doc_id
    and text are one repository; each of their rows is returned. Offsets are
    code points, the end exclusive. Null sources are one owner. An empty table
    gives no rows. A text is scanned whole, in time about the number of hits
    to the power 1.5. Other columns, whatever their names, are not looked at.
    """
    found = find_candidates(docs)
    owned = stored(ownership(found), "owned")
    spans = found.select("__key", F.explode(F.concat("base", "added")).alias("s")).distinct().withColumn("value_hash", F.sha2("s.value", 256))
    # one row a value: its spans may be any share of all, and such a join can be split
    judged = spans.join(owned.hint("merge"), "value_hash")
    copied = (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS)
    live = (F.col("n_owners") == 1) & ~copied
    kept = judged.where(live | (F.col("s.ord") < len(BASE)))
    by_doc = kept.groupBy("__key").agg(
        F.collect_list("s").alias("all_spans"),
        F.count_if(live).alias("n_live"),
        F.count_if(copied).alias("n_copied"),
        F.max("n_repos").alias("most_repos"),
    )
    rows = found.withColumnRenamed("doc_id", "__doc_id")
    with_spans = rows.where(F.size(F.concat("base", "added")) > 0).join(by_doc, "__key", "left")
    none = F.array().cast(found.schema["base"].dataType)
    bare = rows.where(F.size(F.concat("base", "added")) == 0)
    bare = bare.withColumns({"all_spans": none, **{c: F.lit(0).cast("long") for c in ("n_live", "n_copied", "most_repos")}})
    out = with_spans.unionByName(bare)
    spans_of = F.coalesce("all_spans", none)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select(
        F.col("__doc_id").alias("doc_id"),
        *[count(k) for k in BASE],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(spans_of).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
        F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("most_repos", F.lit(0)).cast("long").alias("most_repos"),
    )


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def _sql() -> str:
    parts = []
    for i, (kind, (pattern, group, least)) in enumerate((BASE | ADDED).items()):
        p = pattern.replace("'", "''")
        value = f"regexp_extract(hit, '{p}', {group})"
        parts.append(f"""
  SELECT k, '{kind}' AS kind, {i} AS ord, b, b + length(hit) AS e, {value} AS value FROM (
    SELECT k, hits[i] AS hit,
      list_sum([length(x) for x in pieces[1:i]]) + coalesce(list_sum([length(x) for x in hits[1:i-1]]), 0) AS b
    FROM (SELECT k, hits, pieces, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT k, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS pieces FROM d)))
  WHERE length({value}) >= {least}""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
s AS ({" UNION ALL ".join(parts)}),
base AS (SELECT * FROM s WHERE ord < {len(BASE)}),
added AS (SELECT * FROM s WHERE ord >= {len(BASE)} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
  AND NOT EXISTS (SELECT 1 FROM base t WHERE t.k = s.k AND t.b < s.e AND s.b < t.e)),
c AS (SELECT * FROM base UNION ALL SELECT * FROM added),
own AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS n_owners,
    count(DISTINCT coalesce(source, chr(1)) || ':' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(text)) AS n_repos FROM c JOIN d USING (k) GROUP BY value),
j AS (SELECT c.*, n_repos, n_owners >= {COPIED_OWNERS} OR n_repos >= {COPIED_REPOS} AS copied, n_owners = 1 AND n_repos < {COPIED_REPOS} AS live FROM c JOIN own USING (value)),
a AS (SELECT k,
    coalesce(string_agg(kind || ':' || CAST(CAST(b AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY b, ord) FILTER (ord < {len(BASE)}), '') AS base_spans,
    string_agg(kind || ':' || CAST(CAST(b AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR), ',' ORDER BY b, ord) FILTER (ord < {len(BASE)} OR live) AS spans,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    count(*) FILTER (live) AS n_live, count(*) FILTER (copied AND ord < {len(BASE)}) AS n_copied,
    coalesce(max(n_repos) FILTER (ord < {len(BASE)} OR live), 0) AS most_repos
  FROM j GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most_repos, 0) AS most_repos
FROM d LEFT JOIN a USING (k)
"""


OP8_SQL = _sql()
