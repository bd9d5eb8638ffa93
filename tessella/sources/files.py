"""Readers and sinks of graph folders, votes, run snapshots and the run catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BORDERS = "node_id LONG, other_node LONG, border_length DOUBLE"
PATTERNS = {"BORDERLENGTHS": BORDERS, "CENTROIDS": "node_id LONG, x DOUBLE, y DOUBLE", "POPULATION": "node_id LONG, population LONG", "AREAS": "node_id LONG, area DOUBLE"}
VOTES = "node_id LONG, p1 LONG, p2 LONG, total LONG, nothing STRING"
CATALOGUE = (
    "class STRING, beta DOUBLE, measure_beta DOUBLE, filepath STRING, graph_size LONG, score_weights ARRAY<DOUBLE>, score_funcs ARRAY<STRING>,"
    " run_length LONG, num_districts INT, minimum_population DOUBLE, maximum_population DOUBLE, involution_max INT, mod_time DOUBLE,"
    " center ARRAY<DOUBLE>, starting_involution INT"
)


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def graph_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a folder's headerless files. Node -1 is the outside: its rows give a
    node's outer border, summed. Edges that stand in both directions are kept once."""
    files = {k: tsv(spark, f"{folder}/*{k}*", v) for k, v in PATTERNS.items()}
    borders = files["BORDERLENGTHS"]
    outer = borders.where("node_id = -1").groupBy(F.col("other_node").alias("node_id")).agg(F.sum("border_length").alias("external_border"))
    inner = borders.where("node_id <> -1 and other_node <> -1")
    edges = inner.groupBy(F.least("node_id", "other_node").alias("u"), F.greatest("node_id", "other_node").alias("v")).agg(F.max("border_length").alias("border_length"))
    nodes = files["CENTROIDS"].join(files["POPULATION"], "node_id").join(files["AREAS"], "node_id").join(outer, "node_id", "left")
    nodes = nodes.withColumns({"boundary": F.col("external_border").isNotNull(), "external_border": F.coalesce("external_border", F.lit(0.0))})
    return nodes, edges


def from_lists(spark: SparkSession, nodes: list, edges: list, colouring: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes as (id, x, y, population, area), edges as (u, v, length), colours by node."""
    n = spark.createDataFrame(nodes, "node_id long, x double, y double, population long, area double")
    n = n.withColumns({"boundary": F.lit(False), "external_border": F.lit(0.0)})
    return n, spark.createDataFrame(edges, "u long, v long, border_length double"), spark.createDataFrame(list(colouring.items()), "node_id long, district_id int")


def vote_file(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, VOTES).drop("nothing")


def save_log(log: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A run's move log, partitioned by chain; ``ignore`` keeps what is there."""
    log.write.mode(mode).partitionBy("chain_id").parquet(path)


def load_log(spark: SparkSession, path: str) -> DataFrame:
    """step, node_id, old_color, new_color, chain_id, with the files' metadata."""
    return spark.read.schema("step long, node_id long, old_color int, new_color int, chain_id long").parquet(path)


def save_result(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False) -> None:
    """Results are kept unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "ignore").format(fmt).save(path)


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The four headerless files of a graph folder; outer borders are edges of node -1."""
    outer = nodes.where("external_border > 0").select(F.lit(-1).cast("long").alias("a"), F.col("node_id").alias("b"), F.col("external_border").cast("double").alias("l"))
    inner = edges.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("border_length").cast("double").alias("l"))
    both = inner.unionByName(inner.select(F.col("b").alias("a"), F.col("a").alias("b"), "l"))
    parts = {"BORDERLENGTHS": outer.unionByName(both), "CENTROIDS": nodes.select("node_id", "x", "y"), "POPULATION": nodes.select("node_id", "population"), "AREAS": nodes.select("node_id", "area")}
    for name, df in parts.items():
        df.write.option("sep", "\t").csv(f"{folder}/G_{name}.txt")


def found_runs(spark: SparkSession, folder: str, nodes: DataFrame, assignment: DataFrame, settings: dict) -> DataFrame:
    """The catalogue rows of the runs saved under ``folder``: one a chain folder, listed by Spark's own file index.

    Length and modification time are of the files; size and population of
    the graph; what a log does not hold (class, beta, ...) comes from ``settings``.
    """
    log = load_log(spark, folder).select("step", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_modification_time").alias("t"))
    runs = log.groupBy(F.regexp_extract("f", "^(.*)/[^/]*$", 1).alias("filepath")).agg(F.count("*").alias("run_length"), F.max("t").cast("double").alias("mod_time"))
    graph = nodes.join(assignment, "node_id").agg(F.count("*").alias("graph_size"), F.countDistinct("district_id").cast("int").alias("num_districts"))
    runs = runs.join(F.broadcast(graph), how="left")  # one row
    kinds = {f.split()[0]: f.split()[1] for f in CATALOGUE.replace(", ", ",").split(",")}
    have = {"filepath", "run_length", "mod_time", "graph_size", "num_districts"}
    return runs.select(*[F.col(c).cast(t).alias(c) if c in have else _literal(settings.get(c), t).alias(c) for c, t in kinds.items()])


def _literal(value, kind: str):
    column = F.lit(None) if value is None else F.array(*[F.lit(x) for x in value]) if isinstance(value, (list, tuple)) else F.lit(value)
    return column.cast(kind)


def new_runs(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The catalogue with the runs found that it does not list yet."""
    return catalogue.unionByName(found.join(catalogue, "filepath", "left_anti").select(*catalogue.columns))


def to_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, one column ``json``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def from_json(text: DataFrame, schema: str) -> DataFrame:
    return text.select(F.from_json("json", schema).alias("r")).select("r.*")
