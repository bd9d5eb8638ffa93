"""Approximate nearest neighbours by largest inner product: vantage-point trees.

Inner products become Euclidean distances by one more component: with
(x, sqrt(M^2 - |x|^2)) and (q, 0) the nearest point has the largest product.
Candidates are dealt to shards at random, a partition each; a task builds the
tree of its shard once and sends the queries down it in batches as they pass
by. Of a few drawn rows the one with the widest spread of distances becomes
the vantage point. A subtree is skipped for a query when the triangle
inequality puts it beyond the query's k-th distance. That test is relaxed by a
factor: one is the exact search, more skips more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .vectors import numbered

#: Rows of a shard while there are cores to spare, bytes of one at most, and rows of a tree's leaf.
SHARD, SHARD_BYTES, LEAF = 128, 32 << 20, 256
#: Rows drawn as possible vantage points, and rows that their distances are spread over.
DRAWN, SPREAD = 16, 128
EVERY = 20


class VPTree:
    """A tree over rows of ``x`` (distinct points)."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF, seed: int = 0):
        self.x, self.leaf, self.draw = x, leaf, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return at
        vantage = self._vantage(at)
        d = self._distances(vantage, at)
        near = np.zeros(len(at), bool)
        near[np.argsort(d, kind="stable")[: len(at) // 2]] = True
        children = [(d[m].min(), d[m].max(), self._build(at[m])) for m in (near, ~near)]
        return vantage, children

    def _distances(self, row: int, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, ((self.x[at] - self.x[row]) ** 2).sum(axis=1)))

    def _vantage(self, at: np.ndarray) -> int:
        drawn, over = (self.draw.choice(at, min(n, len(at)), replace=False) for n in (DRAWN, SPREAD))
        return int(max(drawn, key=lambda row: self._distances(row, over).std()))


class _Best:
    """The k best candidates of each query so far, by score and then by order."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.at = np.full((n, k), -1, dtype=np.int64)

    def add(self, rows, scores, at, rank):
        k = self.score.shape[1]
        s = np.concatenate((self.score[rows], scores), axis=1)
        a = np.concatenate((self.at[rows], np.broadcast_to(at, scores.shape)), axis=1)
        order = np.lexsort((np.where(a >= 0, rank[a], np.iinfo(np.int64).max), -s), axis=1)[:, :k]
        self.score[rows], self.at[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(a, order, 1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order whatever else is in the block."""
    out = np.empty((len(q), len(x)))
    for i in range(len(q)):
        out[i] = (x * q[i]).sum(axis=1)
    return out


class Shard:
    """The candidates of one shard in order of id, and the tree over their distinct vectors; built once."""

    def __init__(self, candidates: pd.DataFrame, k: int, leaf: int = LEAF):
        #: products computed so far, those with vantage points included
        self.computed = 0
        last = np.iinfo(np.int64).max
        c = candidates.assign(order_id=candidates["vec_id"].fillna(last).astype("int64")).sort_values(["order_id", "rid"])
        x = np.stack(c["v"])
        _, first, which = np.unique(x, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        # equal vectors tie: of each, the k + 1 smallest ids hold all that can be asked for
        turn = pd.Series(which).groupby(which).cumcount().to_numpy()
        self.members = [[] for _ in first]
        for pos in np.flatnonzero(turn <= k):
            self.members[which[pos]].append(pos)
        self.ids, self.rids, self.k = c["vec_id"].to_numpy(), c["rid"].to_numpy(), k
        self.x, self.rank = x[first], first
        norms = (self.x * self.x).sum(axis=1)
        self.bound = norms.max()
        self.tree = VPTree(np.concatenate((self.x, np.sqrt(np.maximum(0, self.bound - norms))[:, None]), axis=1), leaf)

    def search(self, q: np.ndarray, k: int, factor: float = 1.0):
        """(scores, rows) of the k best distinct vectors for each query; ties by ``rank``."""
        x, best, q_norms = self.x, _Best(len(q), k), (q * q).sum(axis=1)

        def distance(rows):
            """To the k-th best so far; products and distances go opposite ways."""
            return np.sqrt(np.maximum(0, q_norms[rows] + self.bound - 2 * best.score[rows, -1]))

        def visit(node, rows):
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                self.computed += len(rows) * len(node)
                fast = q[rows] @ x[node].T
                # rows that may enter: the exact sums are taken for these alone
                some = (fast >= best.score[rows, -1][:, None] - 1e-9 * (1 + np.abs(fast))).any(axis=0)
                if some.any():
                    best.add(rows, products(q[rows], x[node[some]]), node[some], self.rank)
                return
            vantage, children = node
            self.computed += len(rows)
            d = np.sqrt(np.maximum(0, q_norms[rows] + self.bound - 2 * (q[rows] @ x[vantage])))
            gaps = [np.maximum(0, np.maximum(low - d, d - high)) for low, high, _ in children]
            first = gaps[0] <= gaps[1]
            for turn in (0, 1):
                for side in (0, 1):
                    own = first if (side == 0) == (turn == 0) else ~first
                    mine = rows[own]
                    near = gaps[side][own] * factor <= distance(mine) * (1 + 1e-9) + 1e-9
                    visit(children[side][2], mine[near])

        visit(self.tree.root, np.arange(len(q)))
        return best.score, best.at

    def answers(self, queries: pd.DataFrame, factor: float) -> list[tuple]:
        """(query_id, query_rid, vec_id, score) of the k nearest rows but the query's own."""
        out = []
        scores, at = self.search(np.stack(queries["v"]), min(self.k + 1, len(self.x)), factor)
        for qid, qrid, s, a in zip(queries["vec_id"].to_numpy(), queries["rid"].to_numpy(), scores, at):
            got = [(v, m) for v, u in zip(s, a) if u >= 0 for m in self.members[u] if self.rids[m] != qrid]
            got.sort(key=lambda t: (-t[0], t[1]))
            out += [(qid, qrid, self.ids[m], v) for v, m in got[: self.k]]
        return out


def nearest(embeddings: DataFrame, k: int = 20, factor: float = 1.0, every: int = EVERY, leaf: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query.

    Queries are the usable vectors whose vec_id is divisible by ``every``;
    candidates are all usable vectors but the query's own row. Null, empty or
    zero vectors and those with null or non-finite components take no part,
    nor do pairs of different dimensions. Ties go to the smaller vec_id, null
    last. Rows that repeat a vec_id are candidates, and queries, of their own.
    An empty table gives no rows. Long vectors make shards of fewer rows.
    Other columns, whatever their names, are not looked at. With ``factor``
    1 the search is exact; a larger one skips more and may miss neighbours.
    Smaller leaves (``leaf`` rows) skip more for the same recall, but take
    more steps a query.
    """
    leaf = leaf or LEAF
    vectors = numbered(embeddings).where("ok").select("vec_id", "rid", "v")
    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, length = vectors.agg(F.count("*"), F.sum(F.size("v"))).first()
    at_once = embeddings.sparkSession.sparkContext.defaultParallelism
    # a shard for each core while shards are not small, and none above its bytes
    shards = max(1, min(at_once, n // SHARD), -(-8 * (length or 0) // SHARD_BYTES))
    candidates = vectors.select("*", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"))
    asked = vectors.where(is_query).select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"))
    # a shard's candidates come before its queries, which then pass by in batches
    dealt = candidates.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "query", "rid")
    names = ["query_id", "query_rid", "vec_id", "score"]

    def run(batches):
        shard, held, trees = None, [], None
        for batch in batches:
            for number, part in batch.groupby("shard", sort=False):
                if number != shard:
                    shard, held, trees = number, [], None
                held.append(part[~part["query"]])
                queries = part[part["query"]]
                if not len(queries):
                    continue
                if trees is None:
                    own = pd.concat(held)
                    trees, held = {d: Shard(c, k, leaf) for d, c in own.groupby(own["v"].map(len))}, []
                out = []
                for d, q in queries.groupby(queries["v"].map(len)):
                    if d in trees:
                        out += trees[d].answers(q, factor)
                f = pd.DataFrame(out, columns=names)
                yield f.astype({"query_id": "Int64", "query_rid": "int64", "vec_id": "Int64", "score": "float64"})

    found = dealt.mapInPandas(run, "query_id long, query_rid long, vec_id long, score double")
    order = Window.partitionBy("query_rid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op7_vptree_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
