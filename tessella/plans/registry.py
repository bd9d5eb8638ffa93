"""Registered queries, and the same results as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import aggregates, autocorr, biconnected, connectivity, corners, diagnostics, graph, matrix, proposals, replay
from ..operators.store import cut, delete_at_end, shared_path
from ..sources import derived, files, lattice, runs

TOLERANCE, EVERY, THIN, LAGS, FURTHEST = 0.9, 50, 100, 20, 500
CENTRE = (4.5, 4.5)
#: Weights of cut edges, compactness and squared population deviation.
ENERGY = (1.0, 0.5, 1e-8)


class Relations(SimpleNamespace):
    @cached_property
    def stored_log(self):
        """The log, written once: for queries that read it many times."""
        return cut(self.log, "log")


def relations(spark, sf_dir) -> Relations:
    d = derived
    return Relations(
        spark=spark, dir=sf_dir, nodes=d.nodes(spark, sf_dir), edges=d.edges(spark, sf_dir), start=d.assignment(spark, sf_dir),
        votes=d.votes(spark, sf_dir), log=d.move_log(spark, sf_dir),
    )


def side(r) -> int:
    """Side of the largest square grid that the customers' keys fill."""
    n = derived.table(r.spark, r.dir, "customer").count()
    return int(n**0.5)


def ids(r, table, key):
    return derived.table(r.spark, r.dir, table).select(F.col(key).cast("long").alias("id"))


def scratch(r, tag):
    """A path in the shared folder for a query that writes and reads again; deleted at the end."""
    return shared_path(r.spark, tag)


def r6(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


_B: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function of the relations; ``sql`` continues the common WITH list."""

    def add(f):
        _B[name] = f
        if sql is not None:
            ORACLE_SQL[name] = BASE + sql
        return f

    return add


BASE = """
WITH RECURSIVE nodes0 AS (SELECT DISTINCT user_id AS node_id FROM events),
nodes1 AS (SELECT node_id, node_id // 10 AS x, node_id % 10 AS y, CAST(1 + floor(abs(c_acctbal)) AS BIGINT) AS population, 1.0::DOUBLE AS area
  FROM nodes0 JOIN customer ON c_custkey = node_id),
nodes AS (SELECT *, CAST((x = 0)::INT + (x = (SELECT max(x) FROM nodes1))::INT + (y = 0)::INT + (y = 9)::INT AS BIGINT) AS external_border FROM nodes1),
edges AS (SELECT u, v, 1 + (u + v) % 3 AS border_length FROM (
    SELECT node_id AS u, node_id + 1 AS v FROM nodes WHERE node_id % 10 < 9 UNION ALL SELECT node_id, node_id + 10 FROM nodes)
  WHERE v IN (SELECT node_id FROM nodes)),
start AS (SELECT node_id, CAST(node_id % 5 AS INT) AS district_id FROM nodes),
votes AS (SELECT n.node_id, count(*) FILTER (o_orderkey % 2 = 0) AS p1, count(*) FILTER (o_orderkey % 2 = 1) AS p2
  FROM nodes n LEFT JOIN orders ON o_custkey = n.node_id GROUP BY n.node_id),
log0 AS (SELECT event_id % 4 AS chain_id, row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS step, user_id AS node_id,
  CAST(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INT) AS target FROM events),
log1 AS (SELECT *, coalesce(lag(target) OVER (PARTITION BY chain_id, node_id ORDER BY step), CAST(node_id % 5 AS INT)) AS old FROM log0),
log AS (SELECT chain_id, step, CASE WHEN old <> target THEN node_id END AS node_id, CASE WHEN old <> target THEN old END AS old_color,
  CASE WHEN old <> target THEN target END AS new_color FROM log1),
len AS (SELECT chain_id, max(step) + 1 AS steps FROM log GROUP BY chain_id),
cut AS (SELECT e.*, a.district_id AS cu, b.district_id AS cv FROM edges e JOIN start a ON a.node_id = u JOIN start b ON b.node_id = v
  WHERE a.district_id <> b.district_id),
sym AS (SELECT u AS node_id, v AS other, border_length FROM edges UNION ALL SELECT v, u, border_length FROM edges),
moves AS (SELECT DISTINCT node_id, old_color, new_color FROM (SELECT u AS node_id, cu AS old_color, cv AS new_color FROM cut UNION ALL SELECT v, cv, cu FROM cut)),
dist AS (SELECT district_id, CAST(sum(population) AS BIGINT) AS population, sum(area) AS area, count(*) AS n_nodes,
  count(*) FILTER (external_border > 0) AS boundary_nodes, sum(x) / count(*) AS cx, sum(y) / count(*) AS cy,
  sum(x * population) / sum(population) AS wx, sum(y * population) / sum(population) AS wy
  FROM nodes JOIN start USING (node_id) GROUP BY district_id),
per AS (SELECT district_id, CAST(sum(l) AS BIGINT) AS perimeter FROM (SELECT cu AS district_id, border_length AS l FROM cut
  UNION ALL SELECT cv, border_length FROM cut UNION ALL SELECT district_id, external_border FROM nodes JOIN start USING (node_id)) GROUP BY district_id),
held0 AS (SELECT chain_id, node_id, district_id AS color, -1 AS t0 FROM start, len UNION ALL
  SELECT chain_id, node_id, new_color, step FROM log WHERE node_id IS NOT NULL),
held1 AS (SELECT chain_id, node_id, color, greatest(t0, 0) AS s, coalesce(lead(t0) OVER (PARTITION BY chain_id, node_id ORDER BY t0), steps) AS e FROM held0 JOIN len USING (chain_id)),
held AS (SELECT * FROM held1 WHERE e > s),
at_step AS (SELECT h.chain_id, l.step, h.node_id, h.color FROM held h JOIN log l ON l.chain_id = h.chain_id AND l.step >= h.s AND l.step < h.e),
full_d AS (SELECT chain_id, step, color AS district_id, CAST(sum(p1) AS BIGINT) AS p1, CAST(sum(p2) AS BIGINT) AS p2, CAST(sum(population) AS BIGINT) AS population,
    sum(x) AS sx, sum(y) AS sy, count(*) AS n
  FROM at_step JOIN nodes USING (node_id) JOIN votes USING (node_id) GROUP BY ALL),
wins AS (SELECT chain_id, step, count(*) FILTER (p1 > p2) AS wins FROM full_d GROUP BY ALL),
marg0 AS (SELECT l.chain_id, l.step, d.district_id, p1 / nullif(p1 + p2, 0) AS share FROM log l CROSS JOIN (SELECT DISTINCT district_id FROM start UNION SELECT DISTINCT new_color FROM log WHERE new_color IS NOT NULL) d
  LEFT JOIN full_d f ON f.chain_id = l.chain_id AND f.step = l.step AND f.district_id = d.district_id),
marg AS (SELECT chain_id, step, CAST(row_number() OVER (PARTITION BY chain_id, step ORDER BY share NULLS LAST, district_id) - 1 AS INT) AS rank, share FROM marg0),
pibar AS (SELECT s.state, coalesce(c, 0) / sum(coalesce(c, 0)) OVER () AS share FROM (SELECT unnest(range(6)) AS state) s LEFT JOIN
  (SELECT wins AS state, count(*) AS c FROM wins WHERE step < (SELECT min(steps) FROM len) GROUP BY wins) USING (state)),
runs AS (SELECT chain_id, step, state, CAST(sum((wins = state)::INT) OVER (PARTITION BY chain_id, state ORDER BY step) AS BIGINT) AS n
  FROM wins, (SELECT unnest(range(6)) AS state)),
wait AS (SELECT chain_id, step, step - coalesce(lag(step) OVER (PARTITION BY chain_id ORDER BY step), -1) AS wait FROM log WHERE node_id IS NULL),
quant AS (SELECT chain_id, rank, step, round_even(share * 2 * 100, 0) / 100 / 2 AS key FROM marg WHERE share IS NOT NULL),
rhist AS (SELECT rank, key, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY rank) AS share FROM quant GROUP BY rank, key),
tvw AS (SELECT chain_id, w.w AS win, rank, sum(abs((SELECT count(*) FROM quant q WHERE q.chain_id = c.chain_id AND q.rank = h.rank AND q.key = h.key AND q.step < (w.w + 1) * 100) / ((w.w + 1) * 100) - h.share)) / 2 AS tv
  FROM len c, rhist h, (SELECT unnest(range(0, (SELECT max(steps) // 100 FROM len))) AS w) w WHERE w.w < c.steps // 100 GROUP BY ALL),
com AS (SELECT l.chain_id, l.step, district_id, sx / n AS cx, sy / n AS cy FROM log l JOIN full_d f ON f.chain_id = l.chain_id AND f.step = l.step - 1
  UNION ALL SELECT chain_id, 0, district_id, cx, cy FROM dist, len),
gridn AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM customer),
grid AS (SELECT CAST(i AS BIGINT) AS node_id, i // n AS x, i % n AS y, CAST((i // n = 0 OR i // n = n - 1)::INT + (i % n = 0 OR i % n = n - 1)::INT AS BIGINT) AS external_border, n
  FROM (SELECT c_custkey AS i, n FROM customer, gridn WHERE c_custkey < n * n)),
eas AS (SELECT a.chain_id, a.step, u, v, border_length, a.color AS cu, b.color AS cv FROM edges JOIN at_step a ON a.node_id = u
  JOIN at_step b ON b.node_id = v AND b.chain_id = a.chain_id AND b.step = a.step WHERE a.color <> b.color),
pst AS (SELECT chain_id, step, district_id, CAST(sum(l) AS DOUBLE) AS perimeter FROM (SELECT chain_id, step, cu AS district_id, border_length AS l FROM eas
  UNION ALL SELECT chain_id, step, cv, border_length FROM eas UNION ALL SELECT chain_id, step, color, external_border FROM at_step JOIN nodes USING (node_id)) GROUP BY ALL),
dst AS (SELECT chain_id, step, color AS district_id, sum(area) AS area, CAST(sum(population) AS DOUBLE) AS population, count(*) FILTER (external_border > 0) AS boundary_nodes
  FROM at_step JOIN nodes USING (node_id) GROUP BY ALL),
fin AS (SELECT chain_id, node_id, color AS district_id FROM held JOIN len USING (chain_id) WHERE e = steps),
gride AS (SELECT node_id AS u, node_id + 1 AS v FROM grid WHERE y < n - 1 UNION ALL SELECT node_id, node_id + n FROM grid WHERE x < n - 1),
inner_e AS (SELECT u, v, cu FROM (SELECT e.u, e.v, a.district_id AS cu, b.district_id AS cv FROM edges e JOIN start a ON a.node_id = u JOIN start b ON b.node_id = v) WHERE cu = cv),
"""


# -- generated grids ---------------------------------------------------------
@query("s4_lattice_nodes", "z AS (SELECT 1) SELECT node_id, x, y, external_border FROM grid")
def _(r):
    return lattice.square_nodes(ids(r, "customer", "c_custkey"), side(r)).select("node_id", "x", "y", "external_border")


@query("s4_lattice_edges", "z AS (SELECT 1) SELECT u, v FROM gride")
def _(r):
    return lattice.square_edges(ids(r, "customer", "c_custkey"), side(r)).select("u", "v")


@query("s5_angular_assignment", "z AS (SELECT 1) SELECT node_id, CAST(floor((atan2(y - (n - 1) / 2, x - (n - 1) / 2) + pi()) / (2 * pi() / 3)) AS INT) AS district_id FROM grid")
def _(r):
    return lattice.angular(lattice.square_nodes(ids(r, "customer", "c_custkey"), side(r)), side(r), 3)


@query("s12_diagonal", "z AS (SELECT 1) SELECT node_id, CAST(x > y AS INT) AS district_id FROM grid")
def _(r):
    return lattice.diagonal(lattice.square_nodes(ids(r, "customer", "c_custkey"), side(r)))


STAR = """sz AS (SELECT (SELECT count(*) FROM region) AS p, (SELECT count(*) FROM supplier) // (SELECT count(*) FROM region) AS n),
mid AS (SELECT s_suppkey + p AS node_id, s_suppkey // n AS a, s_suppkey % n AS k, n, p FROM supplier, sz WHERE s_suppkey < p * n)
"""


def _star(r):
    rim, between = ids(r, "region", "r_regionkey"), ids(r, "supplier", "s_suppkey")
    points = rim.count()
    return lattice.star(rim, between, between.count() // points, points)


@query("s7_star_nodes", STAR + """SELECT CAST(r_regionkey AS BIGINT) AS node_id, round(sin(r_regionkey * 2 * pi() / p), 6) AS x, round(cos(r_regionkey * 2 * pi() / p), 6) AS y FROM region, sz
UNION ALL SELECT node_id, round((k + 1) / (n + 1) * sin((a + 0.5) * 2 * pi() / p), 6), round((k + 1) / (n + 1) * cos((a + 0.5) * 2 * pi() / p), 6) FROM mid""")
def _(r):
    return r6(_star(r)[0], "x", "y")


@query("s7_star_links", STAR + "SELECT a AS u, node_id AS v FROM mid UNION ALL SELECT (a + 1) % p, node_id FROM mid")
def _(r):
    return _star(r)[1]


# -- files: what the relations are written to is read again -------------------
def _folder(r):
    path = scratch(r, "graph")
    files.save_graph(r.nodes, r.edges, path)
    delete_at_end(r.spark, path)
    return files.graph_folder(r.spark, path)


@query("s1_graph_folder_nodes", """z AS (SELECT 1) SELECT node_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, population, area, CAST(external_border AS DOUBLE) AS external_border,
external_border > 0 AS boundary FROM nodes""")
def _(r):
    return _folder(r)[0].select("node_id", "x", "y", "population", "area", "external_border", "boundary")


@query("s2_graph_folder_edges", "z AS (SELECT 1) SELECT u, v, CAST(border_length AS DOUBLE) AS border_length FROM edges")
def _(r):
    return _folder(r)[1]


@query("s13_vote_file", "z AS (SELECT 1) SELECT node_id, p1, p2, p1 + p2 AS total FROM votes")
def _(r):
    path = scratch(r, "votes")
    r.votes.select("node_id", "p1", "p2", (F.col("p1") + F.col("p2")).alias("total"), F.lit("").alias("nothing")).write.option("sep", "\t").csv(path)
    delete_at_end(r.spark, path)
    return files.vote_file(r.spark, path)


def _saved(r):
    path = scratch(r, "runs")
    files.save_log(r.log, path)
    delete_at_end(r.spark, path)
    return path


@query("s14_restored_log", "z AS (SELECT 1) SELECT * FROM log")
def _(r):
    return files.load_log(r.spark, _saved(r)).select("chain_id", "step", "node_id", "old_color", "new_color")


@query("s17_catalogue", """z AS (SELECT 1) SELECT chain_id, CASE WHEN chain_id = 0 THEN 'listed before' ELSE 'flip' END AS class, 2.0::DOUBLE AS measure_beta, steps AS run_length,
(SELECT count(*) FROM nodes) AS graph_size, (SELECT CAST(count(DISTINCT district_id) AS INT) FROM start) AS num_districts, true AS dated FROM len""")
def _(r):
    found = files.found_runs(r.spark, _saved(r), r.nodes, r.start, {"class": "flip", "beta": 1.0, "measure_beta": 2.0, "score_weights": [1.0], "score_funcs": ["cut_length"]})
    listed = found.where("filepath like '%chain_id=0'").withColumn("class", F.lit("listed before"))
    chain = F.regexp_extract("filepath", "chain_id=(\\d+)$", 1).cast("long").alias("chain_id")
    return files.new_runs(found, listed).select(chain, "class", "measure_beta", "run_length", "graph_size", "num_districts", (F.col("mod_time") > 0).alias("dated"))


@query("s17_run_features", f"""a AS (SELECT min(population) AS low, max(population) AS high FROM dist)
SELECT chain_id, 'flip' AS class, 1.0::DOUBLE AS beta, 2.0::DOUBLE AS measure_beta, steps AS run_length, (SELECT count(*) FROM nodes) AS graph_size, (SELECT CAST(count(*) AS INT) FROM dist) AS num_districts,
  '1.0' AS score_weights, 'cut_length' AS score_funcs, CAST(low AS DOUBLE) AS minimum_population, CAST(high AS DOUBLE) AS maximum_population, 1 AS involution_max, {CENTRE[0]}::DOUBLE AS center_x, {CENTRE[1]}::DOUBLE AS center_y,
  CAST(1 - 2 * (chain_id % 2) AS INT) AS starting_involution, true AS dated FROM len, a""")
def _(r):
    path = scratch(r, "runs")
    d = aggregates.by_district(r.nodes, r.start)
    graph_of = d.agg(F.min("population").alias("minimum_population"), F.max("population").alias("maximum_population"), F.sum("n_nodes").alias("graph_size"), F.count("*").alias("num_districts"))  # one row
    settings = replay.lengths(r.log).select("chain_id", F.lit("flip").alias("class"), F.lit(1.0).alias("beta"), F.lit(2.0).alias("measure_beta"), F.array(F.lit(1.0)).alias("score_weights"), F.array(F.lit("cut_length")).alias("score_funcs"),
        F.lit(1).alias("involution_max"), F.array(*[F.lit(c) for c in CENTRE]).alias("center"), (1 - 2 * (F.col("chain_id") % 2)).alias("starting_involution"))
    runs.save_runs(r.log, settings.join(F.broadcast(graph_of.select("graph_size", "num_districts", *[F.col(c).cast("double").alias(c) for c in ("minimum_population", "maximum_population")])), how="left"), path)
    delete_at_end(r.spark, path)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return runs.runs(r.spark, path).select("chain_id", "class", "beta", "measure_beta", "run_length", "graph_size", "num_districts", text("score_weights"), text("score_funcs"), "minimum_population", "maximum_population", "involution_max",
        F.col("center")[0].alias("center_x"), F.col("center")[1].alias("center_y"), "starting_involution", (F.col("mod_time") > 0).alias("dated"))


@query("s18_json_result", "z AS (SELECT 1) SELECT district_id, population FROM dist")
def _(r):
    path = scratch(r, "result")
    files.save_result(aggregates.by_district(r.nodes, r.start).select("district_id", "population"), path, "json")
    delete_at_end(r.spark, path)
    return r.spark.read.schema("district_id int, population long").json(path)


@query("s19_kept_result", "z AS (SELECT 1) SELECT district_id, area FROM dist")
def _(r):
    path = scratch(r, "result")
    whole = aggregates.by_district(r.nodes, r.start).select("district_id", "area")
    for df in (whole, whole.limit(0)):  # what is there already stays
        files.save_result(df, path)
    delete_at_end(r.spark, path)
    return r.spark.read.parquet(path)


@query("p14_new_runs", "z AS (SELECT 1) SELECT chain_id, steps, chain_id % 2 = 0 AS listed FROM len")
def _(r):
    found = replay.lengths(r.log).select("chain_id", "steps", F.col("chain_id").cast("string").alias("filepath"), F.lit(False).alias("listed"))
    listed = found.where("chain_id % 2 = 0").withColumn("listed", F.lit(True))
    return files.new_runs(found, listed).drop("filepath")


@query("m14_json", "z AS (SELECT 1) SELECT node_id, x, y, population, area FROM nodes")
def _(r):
    return files.from_json(files.to_json(r.nodes), "node_id long, x long, y long, population long, area double")


@query("s6_cut_edge_assignment", """cc AS (SELECT node_id AS a, node_id AS b FROM nodes UNION SELECT cc.a, s.other FROM cc JOIN sym s ON s.node_id = cc.b
  WHERE (least(s.node_id, s.other), greatest(s.node_id, s.other)) NOT IN (SELECT (u, v) FROM cut))
SELECT a AS node_id, min(b) AS district_id FROM cc GROUP BY a""")
def _(r):
    return lattice.from_cut_edges(r.nodes, r.edges, graph.cut_edges(r.edges, r.start).select("u", "v"))


# -- one assignment ----------------------------------------------------------
@query("p2_cut_edges", "z AS (SELECT 1) SELECT u, v, border_length, cu, cv FROM cut")
def _(r):
    return graph.cut_edges(r.edges, r.start)


@query("p3_contested_nodes", "z AS (SELECT 1) SELECT u AS node_id FROM cut UNION SELECT v FROM cut")
def _(r):
    return graph.contested_nodes(graph.cut_edges(r.edges, r.start))


@query("j3_directed_edges", "z AS (SELECT 1) SELECT u AS a, v AS b, cu AS ca, cv AS cb, border_length FROM cut UNION ALL SELECT v, u, cv, cu, border_length FROM cut")
def _(r):
    return graph.directed_edges(graph.cut_edges(r.edges, r.start))


@query("j4_proposals", "z AS (SELECT 1) SELECT * FROM moves")
def _(r):
    return graph.proposals(graph.cut_edges(r.edges, r.start))


@query("j14_adjacency", "z AS (SELECT 1) SELECT node_id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY other) AS neighbours, count(*) AS degree FROM sym GROUP BY node_id")
def _(r):
    return graph.adjacency(r.edges).withColumn("neighbours", F.array_join(F.col("neighbours").cast("array<string>"), ","))


@query("j15_district_boundary", "z AS (SELECT 1) SELECT least(cu, cv) AS c1, greatest(cu, cv) AS c2, count(*) AS n_edges, CAST(sum(border_length) AS BIGINT) AS length FROM cut GROUP BY ALL")
def _(r):
    return graph.district_boundary(graph.cut_edges(r.edges, r.start))


@query("j9_components", """cc AS (SELECT node_id AS a, node_id AS b FROM nodes UNION SELECT cc.a, s.v FROM cc JOIN
  (SELECT u, v FROM inner_e UNION ALL SELECT v, u FROM inner_e) s ON s.u = cc.b) SELECT a AS node_id, min(b) AS component_id FROM cc GROUP BY a""")
def _(r):
    inner = graph.coloured(r.edges, r.start).where("cu = cv").select("u", "v")
    return graph.components(r.nodes, inner)


#: Districts are bands of two columns; every fourth row a band lends a node to the next one, so that it hangs together there by one node.
CUTV = """wide AS (SELECT node_id, CAST((x + (x % 2 = 1 AND y % 4 = 3)::INT) // 2 AS INT) AS district_id FROM nodes),
we AS (SELECT e.u, e.v FROM edges e JOIN wide a ON a.node_id = u JOIN wide b ON b.node_id = v WHERE a.district_id = b.district_id),
ws AS (SELECT u AS a, v AS b FROM we UNION ALL SELECT v, u FROM we),
reach AS (SELECT g.node_id AS gone, (SELECT min(s.b) FROM ws s WHERE s.a = g.node_id) AS here FROM wide g
  UNION SELECT r.gone, s.b FROM reach r JOIN ws s ON s.a = r.here WHERE s.b <> r.gone),
cutv AS (SELECT g.node_id, g.district_id FROM wide g WHERE EXISTS (SELECT 1 FROM ws WHERE ws.a = g.node_id AND NOT EXISTS (SELECT 1 FROM reach r WHERE r.gone = g.node_id AND r.here = ws.b)))
"""
NARROW = 0.03


def _bands(r):
    lent = ((F.col("x") % 2 == 1) & (F.col("y") % 4 == 3)).cast("long")
    return r.nodes.select("node_id", F.call_function("div", F.col("x") + lent, F.lit(2).cast("long")).cast("int").alias("district_id"))


@query("j8_cut_vertices", CUTV + "SELECT district_id, node_id FROM cutv")
def _(r):
    return biconnected.cut_vertices(_bands(r), r.edges)


@query("p5_feasible_proposals", CUTV + f""", wc AS (SELECT e.u, e.v, a.district_id AS cu, b.district_id AS cv FROM edges e JOIN wide a ON a.node_id = u JOIN wide b ON b.node_id = v WHERE a.district_id <> b.district_id),
wm AS (SELECT DISTINCT * FROM (SELECT u AS node_id, cu AS old_color, cv AS new_color FROM wc UNION ALL SELECT v, cv, cu FROM wc)),
wp AS (SELECT district_id, sum(population) AS p FROM nodes JOIN wide USING (node_id) GROUP BY 1), tot AS (SELECT sum(population) AS t, (SELECT count(DISTINCT district_id) FROM wide) AS k FROM nodes)
SELECT wm.* FROM wm JOIN nodes USING (node_id) JOIN wp o ON o.district_id = old_color JOIN wp n ON n.district_id = new_color, tot
WHERE o.p - population > t / k - t * {NARROW} / 2 AND n.p + population < t / k + t * {NARROW} / 2 AND node_id NOT IN (SELECT node_id FROM cutv)""")
def _(r):
    a = _bands(r)
    districts = a.select("district_id").distinct().count()
    return biconnected.feasible(graph.proposals(graph.cut_edges(r.edges, a)), r.nodes, a, r.edges, districts, NARROW)


@query("p4_population_band", """a AS (SELECT node_id % 3 AS district_id, population FROM nodes), t AS (SELECT sum(population) AS t FROM nodes)
SELECT CAST(district_id AS INT) AS district_id, CAST(sum(population) AS BIGINT) AS population, round(max(t) / 3 - max(t) * 0.01 / 2, 6) AS least, round(max(t) / 3 + max(t) * 0.01 / 2, 6) AS most,
sum(population) > max(t) / 3 - max(t) * 0.01 / 2 AND sum(population) < max(t) / 3 + max(t) * 0.01 / 2 AS inside FROM a, t GROUP BY district_id""")
def _(r):
    total = r.nodes.agg(F.sum("population").alias("total"))  # one row
    per = r.nodes.groupBy((F.col("node_id") % 3).cast("int").alias("district_id")).agg(F.sum("population").alias("population")).join(F.broadcast(total), how="left")
    least, most = graph.population_band(F.col("total"), 3, 0.01)
    per = per.withColumns({"least": least, "most": most})
    return r6(per.withColumn("inside", (F.col("population") > F.col("least")) & (F.col("population") < F.col("most"))).drop("total"), "least", "most")


@query("p13_square_guard", "z AS (SELECT 1) SELECT district_id, n_nodes, CAST(floor(sqrt(n_nodes)) * floor(sqrt(n_nodes)) = n_nodes AS BOOLEAN) AS square FROM dist UNION ALL SELECT -1, n * n, true FROM gridn")
def _(r):
    grid = lattice.square_nodes(ids(r, "customer", "c_custkey"), side(r)).agg(F.lit(-1).alias("district_id"), F.count("*").alias("n_nodes"))
    both = aggregates.by_district(r.nodes, r.start).select("district_id", "n_nodes").unionByName(grid)
    return both.withColumn("square", scores.is_square(F.col("n_nodes")))


for _name, _cols in (("g1_population", ["population"]), ("g3_area", ["area"]), ("g8_boundary_nodes", ["boundary_nodes"])):
    query(_name, f"z AS (SELECT 1) SELECT district_id, {', '.join(_cols)} FROM dist")(lambda r, c=_cols: aggregates.by_district(r.nodes, r.start).select("district_id", *c))


@query("g6_center_of_mass", "z AS (SELECT 1) SELECT district_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(wx, 6) AS wx, round(wy, 6) AS wy FROM dist")
def _(r):
    return r6(aggregates.by_district(r.nodes, r.start).select("district_id", "cx", "cy", "wx", "wy"), "cx", "cy", "wx", "wy")


@query("g2_pop_deviation", "i AS (SELECT avg(population) AS i FROM dist) SELECT round(sqrt(sum((population - i) * (population - i))), 6) AS deviation FROM dist, i")
def _(r):
    return r6(aggregates.population_deviation(aggregates.by_district(r.nodes, r.start)).select("deviation"), "deviation")


@query("g18_max_relative", "i AS (SELECT avg(population) AS i FROM dist) SELECT round(max(abs(population - i) / i), 6) AS max_relative FROM dist, i")
def _(r):
    return r6(aggregates.population_deviation(aggregates.by_district(r.nodes, r.start)).select("max_relative"), "max_relative")


@query("g4_perimeter", "z AS (SELECT 1) SELECT * FROM per")
def _(r):
    return aggregates.perimeter(graph.cut_edges(r.edges, r.start), r.nodes, r.start)


@query("g5_compactness", "z AS (SELECT 1) SELECT round(sum(perimeter * perimeter / area), 6) AS energy FROM per JOIN dist USING (district_id)")
def _(r):
    return r6(aggregates.compactness(aggregates.perimeter(graph.cut_edges(r.edges, r.start), r.nodes, r.start), aggregates.by_district(r.nodes, r.start)), "energy")


@query("g7_global_center", "z AS (SELECT 1) SELECT round(sum(x * population) / count(*), 6) AS x, round(sum(y * population) / count(*), 6) AS y FROM nodes")
def _(r):
    return r6(aggregates.global_centre(r.nodes, "population"), "x", "y")


@query("g9_cut_length", "z AS (SELECT 1) SELECT count(*) AS n_cut, CAST(coalesce(sum(border_length), 0) AS BIGINT) AS length FROM cut")
def _(r):
    return aggregates.cut_length(graph.cut_edges(r.edges, r.start))


@query("g19_districts_won_start", "z AS (SELECT 1) SELECT count(*) AS won FROM (SELECT district_id FROM start JOIN votes USING (node_id) GROUP BY 1 HAVING sum(p1) > sum(p2))")
def _(r):
    v = r.start.join(r.votes, "node_id").groupBy("district_id").agg(F.sum("p1").alias("a"), F.sum("p2").alias("b"))
    return v.agg(F.count_if(F.col("a") > F.col("b")).alias("won"))


# -- scores of moves ---------------------------------------------------------
def _moves(r):
    return graph.proposals(graph.cut_edges(r.edges, r.start))


M3 = """m3 AS (SELECT m.node_id, old_color, new_color, count(*) FILTER (district_id = old_color) - count(*) FILTER (district_id = new_color) AS score
  FROM moves m JOIN sym s ON s.node_id = m.node_id JOIN start a ON a.node_id = s.other GROUP BY ALL)
"""


@query("m3_cut_delta", M3 + "SELECT * FROM m3")
def _(r):
    return scores.cut_delta(_moves(r), r.edges, r.start)


@query("m2_acceptance_chance", M3 + "SELECT node_id, old_color, new_color, round(exp(least(-0.5 * 2 * score, 700)), 6) AS chance FROM m3")
def _(r):
    s = scores.cut_delta(_moves(r), r.edges, r.start)
    return s.select("node_id", "old_color", "new_color", F.round(scores.chance(F.col("score"), 2.0), 6).alias("chance"))


@query("m5_compactness_delta", """t AS (SELECT m.node_id, old_color, new_color, coalesce(sum(border_length) FILTER (district_id = old_color), 0) AS o, coalesce(sum(border_length) FILTER (district_id = new_color), 0) AS w,
    coalesce(sum(border_length) FILTER (district_id NOT IN (old_color, new_color)), 0) AS th
  FROM moves m JOIN sym s ON s.node_id = m.node_id JOIN start a ON a.node_id = s.other GROUP BY ALL)
SELECT t.node_id, old_color, new_color, round(pow(po.perimeter + o - w - th - external_border, 2) / nullif(do_.area - n.area, 0) + pow(pn.perimeter + o - w + th + external_border, 2) / (dn.area + n.area)
  - pow(po.perimeter, 2) / do_.area - pow(pn.perimeter, 2) / dn.area, 6) AS score
FROM t JOIN nodes n USING (node_id) JOIN per po ON po.district_id = old_color JOIN per pn ON pn.district_id = new_color
JOIN dist do_ ON do_.district_id = old_color JOIN dist dn ON dn.district_id = new_color""")
def _(r):
    return r6(scores.compactness_delta(_moves(r), r.nodes, r.edges, r.start), "score")


@query("m6_pop_delta", """z AS (SELECT 1) SELECT m.node_id, old_color, new_color, 2 * n.population * (b.population - a.population + n.population) AS score
FROM moves m JOIN nodes n USING (node_id) JOIN dist a ON a.district_id = old_color JOIN dist b ON b.district_id = new_color""")
def _(r):
    return scores.population_delta(_moves(r), r.nodes, r.start)


M5 = """t AS (SELECT m.node_id, old_color, new_color, coalesce(sum(border_length) FILTER (district_id = old_color), 0) AS o, coalesce(sum(border_length) FILTER (district_id = new_color), 0) AS w,
    coalesce(sum(border_length) FILTER (district_id NOT IN (old_color, new_color)), 0) AS th
  FROM moves m JOIN sym s ON s.node_id = m.node_id JOIN start a ON a.node_id = s.other GROUP BY ALL),
m5 AS (SELECT t.node_id, old_color, new_color, pow(po.perimeter + o - w - th - external_border, 2) / nullif(do_.area - n.area, 0) + pow(pn.perimeter + o - w + th + external_border, 2) / (dn.area + n.area)
  - pow(po.perimeter, 2) / do_.area - pow(pn.perimeter, 2) / dn.area AS score
FROM t JOIN nodes n USING (node_id) JOIN per po ON po.district_id = old_color JOIN per pn ON pn.district_id = new_color
JOIN dist do_ ON do_.district_id = old_color JOIN dist dn ON dn.district_id = new_color),
m6 AS (SELECT m.node_id, old_color, new_color, 2 * n.population * (b.population - a.population + n.population) AS score
FROM moves m JOIN nodes n USING (node_id) JOIN dist a ON a.district_id = old_color JOIN dist b ON b.district_id = new_color)
"""


@query("m7_deviation_after_move", M5 + """, i AS (SELECT avg(population) AS i FROM dist), d AS (SELECT sum((population - i) * (population - i)) AS d FROM dist, i)
SELECT node_id, old_color, new_color, round(sqrt(greatest(d + score, 0)), 3) AS score FROM m6, d""")
def _(r):
    out = scores.deviation_after(_moves(r), r.nodes, r.start)
    return out.withColumn("score", F.round("score", 3))


@query("m9_weighted_score", M3.rstrip() + ", " + M5 + f"""SELECT node_id, old_color, new_color, round({ENERGY[0]} * m3.score + {ENERGY[1]} * m5.score + {ENERGY[2]} * m6.score, 6) AS score
FROM m3 JOIN m5 USING (node_id, old_color, new_color) JOIN m6 USING (node_id, old_color, new_color)""")
def _(r):
    m = _moves(r)
    parts = [scores.cut_delta(m, r.edges, r.start), scores.compactness_delta(m, r.nodes, r.edges, r.start), scores.population_delta(m, r.nodes, r.start)]
    return r6(scores.weighted(m, list(zip(ENERGY, parts))), "score")


_turn = "(node_id % 8 + 0.5) * pi() / 4"


@query("m12_rotation", f"z AS (SELECT 1) SELECT node_id, round(cos({_turn}), 6) AS m00, round(sin({_turn}), 6) AS m01, round(-sin({_turn}), 6) AS m10, round(cos({_turn}), 6) AS m11 FROM nodes")
def _(r):
    theta = (F.col("node_id") % 8 + 0.5) * F.pi() / 4
    return r6(r.nodes.select("node_id", *scores.rotation_matrix(theta)), "m00", "m01", "m10", "m11")


FLOW = """f AS (SELECT m.*, n.x, n.y, a.cx AS ax, a.cy AS ay, a.n_nodes AS an, b.cx AS bx, b.cy AS by_, b.n_nodes AS bn FROM moves m JOIN nodes n USING (node_id)
  JOIN dist a ON a.district_id = old_color JOIN dist b ON b.district_id = new_color),
g AS (SELECT *, (ax * an - x) / nullif(an - 1, 0) AS ax2, (ay * an - y) / nullif(an - 1, 0) AS ay2, (bx * bn + x) / (bn + 1) AS bx2, (by_ * bn + y) / (bn + 1) AS by2 FROM f),
h AS (SELECT node_id, old_color, new_color,
    ((ay2 - ay) * ((ax + ax2) / 2 - 4.5) - (ax2 - ax) * ((ay + ay2) / 2 - 4.5)) / nullif(sqrt(pow((ax + ax2) / 2 - 4.5, 2) + pow((ay + ay2) / 2 - 4.5, 2)) * sqrt(pow(ax2 - ax, 2) + pow(ay2 - ay, 2)), 0)
    + ((by2 - by_) * ((bx + bx2) / 2 - 4.5) - (bx2 - bx) * ((by_ + by2) / 2 - 4.5)) / nullif(sqrt(pow((bx + bx2) / 2 - 4.5, 2) + pow((by_ + by2) / 2 - 4.5, 2)) * sqrt(pow(bx2 - bx, 2) + pow(by2 - by_, 2)), 0) AS turn FROM g)
SELECT node_id, old_color, new_color, round(turn, 6) AS turn, coalesce(turn > 0, true) AS kept FROM h"""


@query("p7_centre_flow", FLOW)
def _(r):
    return r6(scores.centre_flow(_moves(r), r.nodes, r.start, CENTRE), "turn")


@query("p9_edge_orientation", """z AS (SELECT 1) SELECT u, v, CASE WHEN (b.y - a.y) * ((a.x + b.x) / 2 - 4.5) - (b.x - a.x) * ((a.y + b.y) / 2 - 4.5) >= 0 THEN 1 ELSE -1 END AS sign
FROM edges JOIN nodes a ON a.node_id = u JOIN nodes b ON b.node_id = v""")
def _(r):
    return scores.orientation(r.edges, r.nodes, CENTRE)


@query("m13_edge_keys", "z AS (SELECT 1) SELECT u, v, u * 4294967296 + v AS key FROM edges")
def _(r):
    return r.edges.select("u", "v", scores.pack_pair(F.col("u"), F.col("v")).alias("key"))


# -- replay ------------------------------------------------------------------
@query("move_log", "z AS (SELECT 1) SELECT * FROM log")
def _(r):
    return r.log


@query("p1_accepted", "z AS (SELECT 1) SELECT chain_id, count(node_id) AS accepted, count(*) - count(node_id) AS rejected FROM log GROUP BY 1")
def _(r):
    return r.log.groupBy("chain_id").agg(F.count("node_id").alias("accepted"), F.count_if(F.col("node_id").isNull()).alias("rejected"))


@query("p11_truncated", "z AS (SELECT 1) SELECT chain_id, count(*) AS n FROM log WHERE step < 100 GROUP BY 1")
def _(r):
    return replay.truncated(r.log, 100).groupBy("chain_id").agg(F.count("*").alias("n"))


@query("p12_burn_in", "z AS (SELECT 1) SELECT chain_id, count(*) AS n FROM log WHERE step >= 100 GROUP BY 1")
def _(r):
    return replay.after_burn_in(r.log, 100).groupBy("chain_id").agg(F.count("*").alias("n"))


@query("j6_intervals", "z AS (SELECT 1) SELECT chain_id, node_id, color, s AS start_step, e AS end_step FROM held")
def _(r):
    return replay.intervals(r.log, r.start)


@query("g11_dwell_time", "z AS (SELECT 1) SELECT chain_id, node_id, color, CAST(sum(e - s) AS BIGINT) AS dwell FROM held GROUP BY ALL")
def _(r):
    return replay.dwell(r.log, r.start)


@query("g12_flip_counts", "z AS (SELECT 1) SELECT chain_id, node_id, count(*) AS flips FROM log WHERE node_id IS NOT NULL GROUP BY ALL")
def _(r):
    return replay.flips(r.log)


@query("t3_snapshot_every_k", "z AS (SELECT 1) SELECT chain_id, step, node_id, color FROM at_step WHERE step % 50 = 0")
def _(r):
    return replay.snapshots(replay.intervals(r.log, r.start), EVERY, r.start.count())


@query("t2_colour_counts", "z AS (SELECT 1) SELECT chain_id, color, count(*) AS node_steps FROM at_step GROUP BY ALL")
def _(r):
    held = replay.intervals(r.log, r.start)
    return held.groupBy("chain_id", "color").agg(F.sum(F.col("end_step") - F.col("start_step")).alias("node_steps"))


@query("t2_colour_matrix", """g AS (SELECT chain_id, node_id, s // 512 AS part, min(s) AS first, max(e) AS after, count(*) AS n_runs, string_agg(s || ':' || color, ',' ORDER BY s) AS runs FROM held GROUP BY ALL)
SELECT chain_id, node_id, first, after, n_runs, runs FROM g""")
def _(r):
    m = matrix.packed(replay.intervals(r.log, r.start), 512)
    runs = F.array_join(F.zip_with("starts", "colors", lambda s, c: F.concat_ws(":", s, c)), ",")
    return m.select("chain_id", "node_id", "first", "after", F.size("starts").cast("long").alias("n_runs"), runs.alias("runs"))


@query("t2_colour_lookup", "z AS (SELECT 1) SELECT a.chain_id, a.step, a.node_id, a.color FROM log l JOIN sym s ON s.node_id = l.node_id JOIN at_step a ON a.chain_id = l.chain_id AND a.step = l.step AND a.node_id = s.other")
def _(r):
    asked = replay.accepted(r.stored_log).join(graph.symmetric(r.edges), "node_id").select("chain_id", "step", F.col("other").alias("node_id"))
    return matrix.lookup(matrix.packed(replay.intervals(r.stored_log, r.start), 512), asked, 512)


@query("t4_contested_edges", """z AS (SELECT 1) SELECT a.chain_id, u, v, count(*) AS contested FROM edges JOIN at_step a ON a.node_id = u JOIN at_step b ON b.node_id = v AND b.chain_id = a.chain_id AND b.step = a.step
WHERE a.color <> b.color GROUP BY ALL""")
def _(r):
    return replay.contested_edges(r.stored_log, r.start, r.edges)


CONTESTED = """con AS (SELECT a.chain_id, s.node_id, count(DISTINCT a.step) AS contested FROM sym s JOIN at_step a ON a.node_id = s.node_id JOIN at_step b ON b.node_id = s.other AND b.chain_id = a.chain_id AND b.step = a.step
  WHERE a.color <> b.color GROUP BY ALL)
"""


@query("g10_contested_nodes", CONTESTED + "SELECT * FROM con")
def _(r):
    return replay.contested_nodes(r.stored_log, r.start, r.edges)


@query("g13_heatmap", CONTESTED + """, fl AS (SELECT chain_id, node_id, count(*) AS f FROM log WHERE node_id IS NOT NULL GROUP BY ALL),
dw AS (SELECT chain_id, node_id, sum(e - s) AS d FROM held WHERE color = 1 GROUP BY ALL)
SELECT chain_id, node_id, x, y, round(coalesce(f / (SELECT sum(f) FROM fl g WHERE g.chain_id = len.chain_id), 0), 6) AS flip_share, round(coalesce(d, 0) / steps, 6) AS colour_share, coalesce(contested, 0) AS contested
FROM nodes CROSS JOIN len LEFT JOIN fl USING (chain_id, node_id) LEFT JOIN dw USING (chain_id, node_id) LEFT JOIN con USING (chain_id, node_id)""")
def _(r):
    return r6(replay.heat_map(r.stored_log, r.start, r.edges, r.nodes), "flip_share", "colour_share")


@query("t5_districts_won", "z AS (SELECT 1) SELECT * FROM wins")
def _(r):
    return replay.districts_won(r.stored_log, r.start, r.votes)


@query("t6_marginals", "z AS (SELECT 1) SELECT chain_id, step, rank, round(share, 6) AS share FROM marg")
def _(r):
    return r6(replay.marginals(r.stored_log, r.start, r.votes), "share")


@query("t7_apd_trace", "i AS (SELECT sum(population) / 5 AS i FROM nodes) SELECT chain_id, step, round(max(abs(population - i) / i), 6) AS apd FROM full_d, i GROUP BY ALL")
def _(r):
    return r6(replay.deviation_trace(r.stored_log, r.start, r.nodes, derived.DISTRICTS), "apd")


@query("t9_com_trace", "z AS (SELECT 1) SELECT chain_id, step, district_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM com")
def _(r):
    return r6(replay.centre_trace(r.stored_log, r.start, r.nodes), "cx", "cy")


@query("t15_energy_trace", f"""tot AS (SELECT CAST(sum(population) AS DOUBLE) AS t FROM nodes),
nc AS (SELECT chain_id, step, count(*) AS n_cut FROM eas GROUP BY ALL),
en AS (SELECT chain_id, step, sum(perimeter * perimeter / area) AS compactness, sum(population * population) - max(t) * max(t) / 5 AS population_sq FROM dst JOIN pst USING (chain_id, step, district_id), tot GROUP BY ALL)
SELECT chain_id, step, coalesce(n_cut, 0) AS n_cut, round(compactness, 6) AS compactness, round(population_sq, 1) AS population_sq,
  round({ENERGY[0]} * coalesce(n_cut, 0) + {ENERGY[1]} * compactness + {ENERGY[2]} * population_sq, 6) AS energy FROM en LEFT JOIN nc USING (chain_id, step)""")
def _(r):
    out = replay.energy_trace(r.stored_log, r.start, r.nodes, r.edges, derived.DISTRICTS, ENERGY)
    return r6(out, "compactness", "energy").withColumn("population_sq", F.round("population_sq", 1))


def _of_nodes(r, name, value):
    """Sums over a district's nodes by step; they need no edges."""
    at = replay.by_step(replay.district_intervals(r.stored_log, r.start, r.nodes.select("node_id", value.alias(name))).where("n > 0"))
    return at.select("chain_id", "step", "district_id", name)


@query("v3_perimeter_area", "z AS (SELECT 1) SELECT chain_id, step, district_id, perimeter, area FROM dst JOIN pst USING (chain_id, step, district_id)")
def _(r):
    at = replay.by_step(replay.district_traces(r.stored_log, r.start, r.nodes, r.edges).where("n > 0"))
    return at.select("chain_id", "step", "district_id", "perimeter", "area")


@query("v4_population", "z AS (SELECT 1) SELECT chain_id, step, district_id, CAST(population AS BIGINT) AS population FROM dst")
def _(r):
    return _of_nodes(r, "population", F.col("population"))


@query("v7_boundary_nodes", "z AS (SELECT 1) SELECT chain_id, step, district_id, boundary_nodes FROM dst")
def _(r):
    return _of_nodes(r, "boundary_nodes", F.col("boundary").cast("long"))


@query("v6_district_boundary", "z AS (SELECT 1) SELECT chain_id, step, least(cu, cv) AS c1, greatest(cu, cv) AS c2, count(*) AS n_edges, CAST(sum(border_length) AS BIGINT) AS length FROM eas GROUP BY ALL")
def _(r):
    return replay.by_step(replay.boundary_traces(r.stored_log, r.start, r.edges))


@query("t14_acceptance_replay", """sc AS (SELECT l.chain_id, l.step, l.node_id, old_color, new_color, count(*) FILTER (a.color = old_color) - count(*) FILTER (a.color = new_color) AS score
  FROM log l JOIN sym s ON s.node_id = l.node_id JOIN at_step a ON a.node_id = s.other AND a.chain_id = l.chain_id AND a.step = l.step WHERE l.node_id IS NOT NULL GROUP BY ALL)
SELECT *, round(exp(least(-0.5 * 2 * score, 700)), 6) AS chance FROM sc""")
def _(r):
    return r6(replay.move_scores(r.stored_log, r.start, r.edges).withColumn("chance", scores.chance(F.col("score"), 2.0)), "chance")


def _colours(chain, moves, colour):
    """(chain_id, step, zeros, colours): nodes of colour 0 and colours in use after each step."""
    import pandas as pd

    held, out = {}, []
    for c in colour.values():
        held[c] = held.get(c, 0) + 1
    for step, node, new in zip(moves["step"].tolist(), moves["node_id"].tolist(), moves["new_color"].tolist()):
        if node == node and node is not None:
            held[colour[int(node)]] -= 1
            colour[int(node)] = int(new)
            held[int(new)] = held.get(int(new), 0) + 1
        out.append((chain, int(step), held.get(0, 0), sum(n > 0 for n in held.values())))
    return pd.DataFrame(out, columns=["chain_id", "step", "zeros", "colours"])


@query("t1_generic_replay", "z AS (SELECT 1) SELECT chain_id, step, count(*) FILTER (color = 0) AS zeros, count(DISTINCT color) AS colours FROM at_step GROUP BY ALL")
def _(r):
    return replay.replay(r.stored_log, r.start, _colours, "chain_id long, step long, zeros long, colours long", stretch=512)


@query("x5_sample_steps", "o AS (SELECT chain_id, step, row_number() OVER (PARTITION BY chain_id ORDER BY md5(step || ':7'), step) AS k FROM log) SELECT chain_id, step FROM o WHERE k <= 20")
def _(r):
    return autocorr.sample_steps(r.log, 20, 7, block=1000)


# -- one step of a sampler, for all chains at once -----------------------------
PROPOSED = """pn AS (SELECT a.chain_id, a.node_id, a.district_id AS old_color, b.district_id AS other FROM fin a JOIN sym s ON s.node_id = a.node_id JOIN fin b ON b.node_id = s.other AND b.chain_id = a.chain_id),
pr AS (SELECT chain_id, node_id, old_color, other AS new_color, count(*) AS n FROM pn WHERE other <> old_color GROUP BY ALL),
ow AS (SELECT chain_id, node_id, count(*) AS own FROM pn WHERE other = old_color GROUP BY ALL),
ps AS (SELECT pr.chain_id, pr.node_id, old_color, new_color, coalesce(own, 0) - n AS score FROM pr LEFT JOIN ow USING (chain_id, node_id))
"""


@query("k1_step_proposals", PROPOSED + "SELECT chain_id, node_id, old_color, new_color, score, round(exp(least(-0.5 * score, 700)), 6) AS weight FROM ps")
def _(r):
    moves = graph.step_proposals(replay.state_at_end(r.stored_log, r.start), r.edges)
    return r6(moves.withColumn("weight", scores.chance(F.col("score"), 1.0)), "weight")


@query("k3_weighted_pick", PROPOSED + """, wt AS (SELECT *, -ln((CAST('0x' || substr(md5('7:' || chain_id || ':' || node_id || ':' || old_color || ':' || new_color), 1, 12) AS BIGINT) + 1) / 281474976710656) / exp(least(-0.5 * score, 700)) AS w FROM ps),
bk AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY w, node_id, old_color, new_color) AS k FROM wt)
SELECT chain_id, node_id, old_color, new_color, score, round(exp(least(-0.5 * 2 * score, 700)), 6) AS chance FROM bk WHERE k = 1""")
def _(r):
    moves = graph.step_proposals(replay.state_at_end(r.stored_log, r.start), r.edges)
    picked = graph.weighted_pick(moves, scores.chance(F.col("score"), 1.0), seed=7)
    return r6(picked.withColumn("chance", scores.chance(F.col("score"), 2.0)), "chance")


# -- diagnostics -------------------------------------------------------------
def _wins(r):
    return replay.districts_won(r.stored_log, r.start, r.votes)


def _marginals(r):
    return replay.marginals(r.stored_log, r.start, r.votes)


@query("g14_pibar", "z AS (SELECT 1) SELECT state, round(share, 6) AS share FROM pibar")
def _(r):
    return r6(diagnostics.pooled_histogram(_wins(r), "wins"), "share")


@query("w1_running_share", "z AS (SELECT 1) SELECT chain_id, step, state, round(n / (step + 1), 6) AS share FROM runs")
def _(r):
    return r6(diagnostics.running_share(_wins(r), "wins"), "share")


@query("w2_phi", """f AS (SELECT chain_id, step, max(abs(n / (step + 1) - share)) AS phi FROM runs JOIN pibar USING (state) WHERE step < (SELECT min(steps) FROM len) GROUP BY ALL)
SELECT step, round(CAST(sum(CAST(phi AS DECIMAL(18,12))) AS DOUBLE) / count(*), 6) AS phi_mean, round(var_pop(phi), 6) AS phi_var FROM f GROUP BY step""")
def _(r):
    return r6(diagnostics.running_distance(_wins(r), "wins"), "phi_mean", "phi_var")


@query("w3_waits", "z AS (SELECT 1) SELECT * FROM wait")
def _(r):
    return diagnostics.waits(r.stored_log)


@query("g15_wait_hist", "z AS (SELECT 1) SELECT chain_id, wait, count(*) AS n FROM wait GROUP BY ALL")
def _(r):
    return diagnostics.wait_histogram(r.stored_log)


@query("g16_rank_histogram", "z AS (SELECT 1) SELECT rank, round(key, 6) AS key, n, round(share, 6) AS share FROM rhist")
def _(r):
    return r6(diagnostics.rank_histogram(_marginals(r)), "key", "share")


@query("w4_running_tv", "z AS (SELECT 1) SELECT chain_id, win, round(avg(tv), 6) AS tv FROM tvw GROUP BY ALL")
def _(r):
    return r6(diagnostics.running_variation(_marginals(r), THIN).withColumnRenamed("window", "win"), "tv")


@query("g17_farthest_chain", "l AS (SELECT chain_id, rank, arg_max(tv, win) AS tv FROM tvw GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY round(tv, 9) DESC, chain_id) AS k FROM l) SELECT rank, chain_id, round(tv, 6) AS tv FROM m WHERE k = 1")
def _(r):
    return r6(diagnostics.farthest_chain(_marginals(r), THIN), "tv")


@query("w5_running_sup", "f AS (SELECT step, state, max(n) - min(n) AS d FROM runs WHERE step < (SELECT min(steps) FROM len) GROUP BY ALL) SELECT step, round(max(d) / (step + 1), 6) AS spread FROM f GROUP BY step")
def _(r):
    return r6(diagnostics.running_spread(_wins(r), "wins"), "spread")


@query("w6_unwrap", """c AS (SELECT avg(x) AS gx, avg(y) AS gy FROM nodes), a AS (SELECT chain_id, district_id, step, atan2(cy - gy, cx - gx) AS th FROM com, c),
b AS (SELECT *, lag(th) OVER (PARTITION BY chain_id, district_id ORDER BY step) AS p FROM a),
d AS (SELECT *, CASE WHEN p IS NULL THEN th WHEN th * p < 0 AND abs(th - p) > pi() THEN CASE WHEN th > 0 THEN th - p - 2 * pi() ELSE th - p + 2 * pi() END ELSE th - p END AS d FROM b)
SELECT chain_id, district_id, step, CASE WHEN abs(sum(d) OVER w) < 5e-7 THEN 0 ELSE round(sum(d) OVER w, 6) END AS angle FROM d
WINDOW w AS (PARTITION BY chain_id, district_id ORDER BY step)""")
def _(r):
    out = r6(diagnostics.unwrapped(replay.centre_trace(r.stored_log, r.start, r.nodes), aggregates.global_centre(r.nodes)), "angle")
    return out.withColumn("angle", F.when(F.col("angle") == 0, 0.0).otherwise(F.col("angle")))  # no negative zero


@query("w7_rank_marginals", "z AS (SELECT 1) SELECT rank, count(share) AS n, round(avg(share), 6) AS mean FROM marg GROUP BY rank")
def _(r):
    return r6(_marginals(r).groupBy("rank").agg(F.count("share").alias("n"), F.avg("share").alias("mean")), "mean")


@query("w8_transitions", "w AS (SELECT chain_id, step, wins, lag(wins) OVER (PARTITION BY chain_id ORDER BY step) AS p FROM wins) SELECT chain_id, step, wins FROM w WHERE p IS NULL OR p <> wins")
def _(r):
    return diagnostics.transitions(_wins(r), "wins")


@query("g20_acf", """x AS (SELECT chain_id, step, wins - avg(wins) OVER (PARTITION BY chain_id) AS x FROM wins),
c AS (SELECT a.chain_id, b.step - a.step AS lag, avg(a.x * b.x) AS cov FROM x a JOIN x b ON a.chain_id = b.chain_id AND b.step BETWEEN a.step AND a.step + 20 GROUP BY ALL)
SELECT chain_id, lag, round(cov / (SELECT cov FROM c z WHERE z.chain_id = c.chain_id AND z.lag = 0), 6) AS acf FROM c""")
def _(r):
    return r6(diagnostics.autocorrelation(_wins(r), "wins", LAGS), "acf")


# -- long range and sides ----------------------------------------------------
G = """s AS (SELECT * FROM at_step WHERE step % {m} = 0), p AS (SELECT a.chain_id, b.step - a.step AS dist, a.step AS loc, count(*) FILTER (a.color = b.color) AS agree
  FROM s a JOIN len USING (chain_id) JOIN {b} b ON b.chain_id = a.chain_id AND b.node_id = a.node_id AND b.step >= a.step AND b.step < a.step + {far} {cond} GROUP BY ALL)
SELECT chain_id, dist, count(*) AS locs, round(avg(agree) - (SELECT count(*) / 5 FROM nodes), 6) AS g FROM p GROUP BY ALL"""


@query("t10_autocorr_agreement", G.format(m=50, b="s", far=500, cond="WHERE a.step < steps - 500"))
def _(r):
    return r6(autocorr.at_distances(replay.intervals(r.stored_log, r.start), r.nodes, EVERY, FURTHEST, derived.DISTRICTS), "g")


@query("t11_autocorr_points", G.format(m=250, b="at_step", far=100, cond="WHERE a.step < steps - 100"))
def _(r):
    return r6(autocorr.from_points(replay.intervals(r.stored_log, r.start), r.nodes, 250, 100, derived.DISTRICTS), "g")


@query("t12_autocorr_pairs", G.format(m=100, b="s", far=500, cond=""))
def _(r):
    return r6(autocorr.all_pairs(replay.intervals(r.stored_log, r.start), r.nodes, 100, FURTHEST, derived.DISTRICTS), "g")


SIDES = """e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM nodes),
o AS (SELECT chain_id, step, {flags} FROM at_step JOIN nodes USING (node_id), e GROUP BY ALL)
"""
_corner = {"sw": "x = x0 AND y = y0", "nw": "x = x0 AND y = y1", "se": "x = x1 AND y = y0", "ne": "x = x1 AND y = y1"}


@query("t8_corner_ownership", SIDES.format(flags=", ".join(f"coalesce(max((color = 0)::INT) FILTER ({c}), 0) AS {k}" for k, c in _corner.items())) + """
SELECT chain_id, step, CASE WHEN sw = nw THEN CASE WHEN se = ne THEN 2 * sw END WHEN sw = se AND nw = ne THEN 1 + 2 * sw END AS side FROM o""")
def _(r):
    return corners.corner_ownership(replay.intervals(r.stored_log, r.start), corners.corner_ids(r.nodes))


def _probe(across, end, axis, high):
    on = f"m.{across} = {across}{end} AND "
    if high:
        return f"{axis} = (SELECT min({axis}) FROM nodes m, e WHERE {on} m.{axis} < {axis}1 AND m.{axis} > ({axis}0 + {axis}1) / 2 + ({axis}1 - {axis}0) * 0.25) AND {across} = {across}{end}"
    return f"{axis} = (SELECT max({axis}) FROM nodes m, e WHERE {on} m.{axis} > {axis}0 AND m.{axis} < ({axis}0 + {axis}1) / 2 - ({axis}1 - {axis}0) * 0.25) AND {across} = {across}{end}"


_probes = {"sw_h": _probe("x", 0, "y", False), "nw_h": _probe("x", 0, "y", True), "se_h": _probe("x", 1, "y", False), "ne_h": _probe("x", 1, "y", True),
           "sw_v": _probe("y", 0, "x", False), "se_v": _probe("y", 0, "x", True), "nw_v": _probe("y", 1, "x", False), "ne_v": _probe("y", 1, "x", True)}


@query("t13_coreset", SIDES.format(flags=", ".join(f"coalesce(max((color = 0)::INT) FILTER ({c}), 0) AS {k}" for k, c in _probes.items())) + """
SELECT chain_id, step, CASE WHEN sw_h <> nw_h AND se_h <> ne_h THEN 2 * sw_h WHEN sw_v <> se_v AND ne_v <> nw_v THEN 1 + 2 * sw_v END AS core FROM o""")
def _(r):
    return corners.core_sets(replay.intervals(r.stored_log, r.start), corners.probe_ids(r.nodes, strict_reference=False))


# -- connectivity along the log ----------------------------------------------
@query("j10_reconnection", """acc AS (SELECT * FROM log WHERE node_id IS NOT NULL),
ask AS (SELECT l.chain_id, l.step, l.old_color, s.other FROM acc l JOIN sym s ON s.node_id = l.node_id
  JOIN at_step a ON a.chain_id = l.chain_id AND a.step = l.step AND a.node_id = s.other AND a.color = l.old_color),
reach AS (SELECT chain_id, step, old_color, min(other) AS here FROM ask GROUP BY ALL
  UNION SELECT r.chain_id, r.step, r.old_color, s.other FROM reach r JOIN sym s ON s.node_id = r.here
  JOIN at_step a ON a.chain_id = r.chain_id AND a.step = r.step AND a.node_id = s.other AND a.color = r.old_color),
got AS (SELECT q.chain_id, q.step, bool_and(r.here IS NOT NULL) AS ok FROM ask q LEFT JOIN reach r ON r.chain_id = q.chain_id AND r.step = q.step AND r.here = q.other GROUP BY ALL)
SELECT chain_id, step, coalesce(ok, false) AS still_connected FROM acc LEFT JOIN got USING (chain_id, step)""")
def _(r):
    return connectivity.reconnection(r.stored_log, r.start, r.edges)


@query("v8_cut_vertices", """touch AS (SELECT chain_id, district_id, 0 AS step FROM start, len UNION SELECT chain_id, old_color, step FROM log WHERE node_id IS NOT NULL
  UNION SELECT chain_id, new_color, step FROM log WHERE node_id IS NOT NULL),
ver AS (SELECT chain_id, district_id, step, coalesce(lead(step) OVER (PARTITION BY chain_id, district_id ORDER BY step), steps) AS end_step FROM touch JOIN len USING (chain_id)),
vn AS MATERIALIZED (SELECT v.chain_id, v.district_id, v.step, a.node_id FROM ver v JOIN at_step a ON a.chain_id = v.chain_id AND a.step = v.step AND a.color = v.district_id),
ve AS MATERIALIZED (SELECT x.chain_id, x.district_id, x.step, x.node_id AS a, y.node_id AS b FROM vn x JOIN sym s ON s.node_id = x.node_id
  JOIN vn y ON y.chain_id = x.chain_id AND y.district_id = x.district_id AND y.step = x.step AND y.node_id = s.other),
cand AS MATERIALIZED (SELECT chain_id, district_id, step, a AS gone, min(b) AS here FROM ve GROUP BY ALL HAVING count(*) > 1),
reach AS (SELECT * FROM cand UNION SELECT r.chain_id, r.district_id, r.step, r.gone, e.b FROM reach r
  JOIN ve e ON e.chain_id = r.chain_id AND e.district_id = r.district_id AND e.step = r.step AND e.a = r.here WHERE e.b <> r.gone),
lost AS (SELECT DISTINCT e.chain_id, e.district_id, e.step, e.a FROM cand c JOIN ve e ON e.chain_id = c.chain_id AND e.district_id = c.district_id AND e.step = c.step AND e.a = c.gone
  LEFT JOIN reach r ON r.chain_id = e.chain_id AND r.district_id = e.district_id AND r.step = e.step AND r.gone = e.a AND r.here = e.b WHERE r.here IS NULL)
SELECT chain_id, district_id, step AS start_step, end_step, a AS node_id FROM lost JOIN ver USING (chain_id, district_id, step)""")
def _(r):
    return connectivity.cut_vertex_versions(r.stored_log, r.start, r.edges)


# -- proposals along the log --------------------------------------------------
#: Time t is the state before step t. All proposals of every time, by brute force.
TIMES = """bst AS MATERIALIZED (SELECT chain_id, 0 AS t, node_id, CAST(district_id AS INT) AS color FROM start, len UNION ALL SELECT chain_id, step + 1, node_id, color FROM at_step),
bn AS (SELECT a.chain_id, a.t, a.node_id, a.color AS old_color, b.color AS c, count(*) AS n FROM bst a JOIN sym s ON s.node_id = a.node_id
  JOIN bst b ON b.chain_id = a.chain_id AND b.t = a.t AND b.node_id = s.other GROUP BY ALL),
bp AS MATERIALIZED (SELECT x.chain_id, x.t, x.node_id, x.old_color, x.c AS new_color, coalesce(o.n, 0) - x.n AS score FROM bn x
  LEFT JOIN bn o ON o.chain_id = x.chain_id AND o.t = x.t AND o.node_id = x.node_id AND o.c = x.old_color WHERE x.c <> x.old_color),
"""


def _proposals(r):
    return proposals.proposal_intervals(r.stored_log, r.start, r.edges)


@query("k3_normalisers", TIMES + """z AS (SELECT chain_id, t, sum(exp(-0.5 * score)) AS w FROM bp GROUP BY ALL),
sc AS (SELECT l.*, (SELECT count(*) FILTER (a.color = old_color) - count(*) FILTER (a.color = new_color) FROM sym s JOIN at_step a ON a.node_id = s.other WHERE s.node_id = l.node_id AND a.chain_id = l.chain_id AND a.step = l.step) AS score
  FROM log l WHERE node_id IS NOT NULL)
SELECT l.chain_id, l.step, round(f.w, 6) AS forward, round(g.w, 6) AS reverse,
  round(CASE WHEN p.node_id IS NOT NULL THEN CASE WHEN q.node_id IS NULL THEN 0 ELSE exp(0.5 * l.score) / g.w / (exp(-0.5 * l.score) / f.w) END END, 6) AS ratio
FROM sc l JOIN z f ON f.chain_id = l.chain_id AND f.t = l.step JOIN z g ON g.chain_id = l.chain_id AND g.t = l.step + 1
LEFT JOIN bp p ON p.chain_id = l.chain_id AND p.t = l.step AND p.node_id = l.node_id AND p.old_color = l.old_color AND p.new_color = l.new_color
LEFT JOIN bp q ON q.chain_id = l.chain_id AND q.t = l.step + 1 AND q.node_id = l.node_id AND q.old_color = l.new_color AND q.new_color = l.old_color""")
def _(r):
    scored = replay.move_scores(r.stored_log, r.start, r.edges).select("chain_id", "step", "node_id", "old_color", "new_color", "score")
    return r6(proposals.normalisers(r.stored_log, cut(_proposals(r), "proposals"), scored, 1.0), "forward", "reverse", "ratio")


@query("v9_pair_totals", TIMES + """h AS (SELECT chain_id, least(old_color, new_color) AS c1, greatest(old_color, new_color) AS c2, t, score, count(*) AS n FROM bp GROUP BY ALL),
g AS (SELECT chain_id, c1, c2, t, string_agg(score || ':' || n, ',' ORDER BY score) AS sig, sum(n * exp(-0.5 * score)) AS total FROM h GROUP BY ALL),
m AS (SELECT *, lag(sig) OVER w IS DISTINCT FROM sig OR lag(t) OVER w < t - 1 AS new FROM g WINDOW w AS (PARTITION BY chain_id, c1, c2 ORDER BY t)),
k AS (SELECT *, sum(new::INT) OVER (PARTITION BY chain_id, c1, c2 ORDER BY t) AS part FROM m)
SELECT chain_id, c1, c2, min(t) AS start_step, least(max(t) + 1, any_value(steps)) AS end_step, round(max(total), 6) AS total FROM k JOIN len USING (chain_id) GROUP BY chain_id, c1, c2, part HAVING min(t) < any_value(steps)""")
def _(r):
    return r6(proposals.pair_totals(_proposals(r), r.stored_log, 1.0), "total")


@query("t14_rejected_draws", TIMES + """rej AS (SELECT chain_id, step FROM log WHERE node_id IS NULL),
rp AS (SELECT r.chain_id, r.step, p.node_id, old_color, new_color, score, p.node_id % 16 AS cell FROM rej r JOIN bp p ON p.chain_id = r.chain_id AND p.t = r.step WHERE score > 0),
rc AS (SELECT chain_id, step, score, cell, -ln((CAST('0x' || substr(md5('11:' || chain_id || ':' || step || ':' || score || ':' || cell), 1, 12) AS BIGINT) + 1) / 281474976710656)
  / (count(*) * exp(-0.5 * score) * (1 - exp(-0.5 * 2 * score))) AS w FROM rp GROUP BY chain_id, step, score, cell),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, step ORDER BY w, score, cell) AS k FROM rc) WHERE k = 1),
cand AS (SELECT p.*, -ln((CAST('0x' || substr(md5('11:' || p.chain_id || ':' || p.step || ':' || node_id || ':' || old_color || ':' || new_color), 1, 12) AS BIGINT) + 1) / 281474976710656) AS w
  FROM best b JOIN rp p ON p.chain_id = b.chain_id AND p.step = b.step AND p.score = b.score AND p.cell = b.cell),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, step ORDER BY w, node_id, old_color, new_color) AS k FROM cand) WHERE k = 1)
SELECT r.chain_id, r.step, node_id, old_color, new_color, score, round(exp(-0.5 * 2 * score), 6) AS chance FROM rej r LEFT JOIN one USING (chain_id, step)""")
def _(r):
    return r6(proposals.rejected_draws(r.stored_log, _proposals(r), 1.0, 2.0, seed=11), "chance")


@query("k2_flow_signs", f"""sg AS (SELECT chain_id, step, node_id, old_color, new_color, 1 - 2 * (sum((node_id IS NULL)::INT) OVER (PARTITION BY chain_id ORDER BY step) % 2) AS sign FROM log),
cb AS MATERIALIZED (SELECT chain_id, step + 1 AS step, color AS d, sum(x) AS sx, sum(y) AS sy, count(*) AS n FROM at_step JOIN nodes USING (node_id) GROUP BY ALL
  UNION ALL SELECT chain_id, 0, district_id, sum(x), sum(y), count(*) FROM start JOIN nodes USING (node_id), len GROUP BY ALL),
e AS (SELECT s.chain_id, s.step, s.sign, o.sx / o.n AS ax, o.sy / o.n AS ay, (o.sx - x) / nullif(o.n - 1, 0) AS bx, (o.sy - y) / nullif(o.n - 1, 0) AS byy,
  w.sx / w.n AS cx, w.sy / w.n AS cy, (w.sx + x) / (w.n + 1) AS dx, (w.sy + y) / (w.n + 1) AS dy
  FROM sg s JOIN nodes USING (node_id) LEFT JOIN cb o ON o.chain_id = s.chain_id AND o.step = s.step AND o.d = old_color LEFT JOIN cb w ON w.chain_id = s.chain_id AND w.step = s.step AND w.d = new_color),
f AS (SELECT chain_id, step, sign, round(((byy - ay) * ((ax + bx) / 2 - {CENTRE[0]}) - (bx - ax) * ((ay + byy) / 2 - {CENTRE[1]})) / nullif(sqrt(pow((ax + bx) / 2 - {CENTRE[0]}, 2) + pow((ay + byy) / 2 - {CENTRE[1]}, 2)) * sqrt(pow(bx - ax, 2) + pow(byy - ay, 2)), 0)
  + ((dy - cy) * ((cx + dx) / 2 - {CENTRE[0]}) - (dx - cx) * ((cy + dy) / 2 - {CENTRE[1]})) / nullif(sqrt(pow((cx + dx) / 2 - {CENTRE[0]}, 2) + pow((cy + dy) / 2 - {CENTRE[1]}, 2)) * sqrt(pow(dx - cx, 2) + pow(dy - cy, 2)), 0), 6) AS turn FROM e)
SELECT chain_id, step, turn, CAST(sign AS INT) AS sign, coalesce(turn * sign > 0, true) AS agrees FROM f""")
def _(r):
    out = r6(proposals.flow_signs(r.stored_log, r.start, r.nodes, CENTRE), "turn")
    # compared as rounded, so that both sides round before they take the direction
    return out.withColumn("agrees", F.coalesce(F.col("turn") * F.col("sign") > 0, F.lit(True)))


QUERIES = {name: (lambda spark, sf_dir, f=f: f(relations(spark, sf_dir))) for name, f in _B.items()}
