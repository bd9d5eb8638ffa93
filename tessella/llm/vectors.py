"""Vectors: packed rows, and an exact metric range join.

Unit vectors at cosine c lie at Euclidean distance sqrt(2 - 2c). Pivots from a
bounded sample part the vectors into cells. A vector may have partners in
another cell only if the border between the two pivots is within that
distance, which the triangle inequality tells from the distances to the
pivots; only then it is copied there, and only to cells before its own, so
that every pair meets once. Equal vectors are one point with a count from the
start. Cells are split into blocks of bounded bytes, and a block's visitors
into parts; both are made only where a first pass has counted rows for them.
Blocks join independently; each sends counts and the edges of a forest, never
its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored, table
from .components import connected_components

#: Pivots: at least, at most, rows for one more, and vectors that they are chosen from.
MIN_PIVOTS, MAX_PIVOTS, CELL, SAMPLE = 8, 4096, 8192, 8192
#: Bytes of a block's own rows; its visitors come in parts of four times that.
BLOCK_BYTES = 4 << 20
#: Distances to pivots that are computed at a time, and bytes of copies that a task deals at a time.
DISTANCES, DEAL_BYTES = 1 << 20, 32 << 20
#: Similarities this close to the threshold are computed again, in double precision.
NEAR = 1e-4


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def numbered(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) and ok, with a row number rid; stored."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.select("vec_id", "v", usable(F.col("v")).alias("ok"), F.monotonically_increasing_id().alias("rid"))
    return stored(rows, "vectors")


def units(v) -> np.ndarray:
    x = np.stack(v)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, n: int) -> np.ndarray:
    """Far apart vectors of a sample of at most ``SAMPLE`` rows, n of them at most."""
    rows = vectors.select("v", F.xxhash64("rid").alias("h")).orderBy("h").limit(SAMPLE).collect()
    if not rows:
        return np.empty((0, 0))
    dims = [len(r["v"]) for r in rows]
    most = max(set(dims), key=dims.count)
    x = units([r["v"] for r in rows if len(r["v"]) == most])
    picked, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(picked) < min(n, len(x)):
        picked.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[picked[-1]], axis=1))
    return x[picked]


def to_pivots(x: np.ndarray, pivots: np.ndarray, reach: float):
    """Each row's nearest pivot, and which earlier cells it may have partners in."""
    d2 = np.maximum(0, 2 - 2 * (x @ pivots.T))
    home = d2.argmin(axis=1)
    between = np.sqrt(np.maximum(1e-18, 2 - 2 * (pivots @ pivots.T)))[home]
    border = (d2 - d2[np.arange(len(x)), home][:, None]) / (2 * between)
    visits = (border <= reach + 1e-6) & (np.arange(len(pivots)) < home[:, None])
    return home, visits


class Cells:
    """Where a batch of vectors belongs: its cells, their blocks, and the cells visited."""

    def __init__(self, pivots: np.ndarray, reach: float):
        self.pivots, self.reach, self.n = pivots, reach, len(pivots)

    def place(self, x: np.ndarray):
        if self.n and self.pivots.shape[1] == x.shape[1]:
            home, visits = to_pivots(x, self.pivots, self.reach)
            return home, *np.nonzero(visits)
        # other dimensions: a cell of their own behind the others
        return np.full(len(x), self.n), np.empty(0, int), np.empty(0, int)

    def slices(self, rows: int) -> list[slice]:
        """Rows that are placed at a time: their distances to all pivots are held at once."""
        size = max(1, DISTANCES // max(1, self.n))
        return [slice(low, low + size) for low in range(0, rows, size)]

    def count(self, points: DataFrame) -> dict[int, tuple[int, int, int]]:
        """(rows, visitors, dimensions) of each cell; there are MAX_PIVOTS + 1 cells at most."""

        def run(batches):
            for b in batches:
                dims, rows = b["v"].map(len).to_numpy(), []
                for dim in np.unique(dims):
                    x = units(b["v"][dims == dim])
                    own, guests = np.zeros(self.n + 1, np.int64), np.zeros(self.n + 1, np.int64)
                    for some in self.slices(len(x)):
                        home, _, to = self.place(x[some])
                        own += np.bincount(home, minlength=self.n + 1)
                        guests += np.bincount(to, minlength=self.n + 1)
                    rows += [(c, int(own[c]), int(guests[c]), int(dim)) for c in np.flatnonzero(own + guests)]
                yield pd.DataFrame(rows, columns=["cell", "rows", "guests", "dim"])

        per = points.select("v").mapInPandas(run, "cell int, rows long, guests long, dim int")
        got = per.groupBy("cell").agg(F.sum("rows").alias("r"), F.sum("guests").alias("g"), F.max("dim").alias("d")).collect()
        return {x["cell"]: (x["r"], x["g"], x["d"]) for x in got}


def layout(counted: dict[int, tuple[int, int, int]], block_bytes: int) -> tuple[dict[int, int], dict[int, int]]:
    """Blocks of each cell, and parts of each block's visitors, from what was counted."""
    blocks, parts = {}, {}
    for cell, (rows, guests, dim) in counted.items():
        fit = max(64, block_bytes // (8 * dim))
        blocks[cell] = -(-rows // fit)
        # rows of later blocks of the cell visit as well
        parts[cell] = max(1, -(-(guests + (rows if blocks[cell] > 1 else 0)) // (4 * fit)))
    return blocks, parts


PACKED = "cell int, block int, part int, home boolean, ids binary, counts binary, vecs binary, dim int"


def deal(points: DataFrame, cells: Cells, blocks: dict[int, int], parts: dict[int, int]) -> DataFrame:
    """Packed rows for every cell block: its own vectors in each part, and each visitor in one."""
    n_blocks = np.array([blocks.get(c, 0) for c in range(cells.n + 1)])
    n_parts = np.array([parts.get(c, 1) for c in range(cells.n + 1)])

    def bounded(x, rid):
        """Slices of rows whose copies are ``DEAL_BYTES`` together; one row may have more."""
        for some in cells.slices(len(x)):
            home, row, to = cells.place(x[some])
            mixed = rid[some].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            copies = n_parts[home] + (mixed % n_blocks[home].astype(np.uint64)).astype(int)
            copies += np.bincount(row, weights=n_blocks[to], minlength=len(home)).astype(int)
            group = np.cumsum(copies) * 8 * x.shape[1] // DEAL_BYTES
            ends = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(home)]
            yield from (slice(some.start + low, some.start + high) for low, high in zip(ends, ends[1:]))

    def dealt(x, rid, weight, dim):
        home, row, to = cells.place(x)
        mixed = rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        mine = (mixed % n_blocks[home].astype(np.uint64)).astype(int)
        some = mixed.astype(np.int64) >> 7
        at = np.arange(len(x))
        # own rows: a copy for each part of their block
        copies = n_parts[home]
        own_row = np.repeat(at, copies)
        own_part = np.arange(len(own_row)) - np.repeat(np.cumsum(copies) - copies, copies)
        # visitors: one for each block of the cells visited, and for each earlier block of their own cell
        row, to = np.concatenate((row, at)), np.concatenate((to, home))
        times = np.concatenate((n_blocks[to[: len(to) - len(at)]], mine))
        guest, cell = np.repeat(row, times), np.repeat(to, times)
        block = np.arange(len(guest)) - np.repeat(np.cumsum(times) - times, times)
        who = np.concatenate((own_row, guest))
        key = np.stack((
            np.concatenate((home[own_row], cell)),
            np.concatenate((mine[own_row], block)),
            np.concatenate((own_part, some[guest] % n_parts[cell])),
            np.concatenate((np.ones(len(own_row), int), np.zeros(len(guest), int))),
        ))
        order = np.lexsort(key[::-1])
        key, who = key[:, order], who[order]
        cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        rows = []
        for low, high in zip([0, *cut], [*cut, len(who)]):
            if high > low:
                c, k, p, is_home = key[:, low].tolist()
                w = who[low:high]
                rows.append((c, k, p, bool(is_home), rid[w].tobytes(), weight[w].tobytes(), x[w].tobytes(), int(dim)))
        return pd.DataFrame(rows, columns=["cell", "block", "part", "home", "ids", "counts", "vecs", "dim"])

    def run(batches):
        for b in batches:
            dims = b["v"].map(len).to_numpy()
            for dim in np.unique(dims):
                own = b[dims == dim]
                x, rid, weight = units(own["v"]), own["rid"].to_numpy(), own["m"].to_numpy()
                for some in bounded(x, rid):
                    yield dealt(x[some], rid[some], weight[some], dim)

    return points.select("rid", "m", "v").mapInPandas(run, PACKED)


def _unpacked(pdf: pd.DataFrame, dim: int):
    ids = np.frombuffer(b"".join(pdf["ids"]), dtype=np.int64)
    counts = np.frombuffer(b"".join(pdf["counts"]), dtype=np.int64)
    return ids, counts, np.frombuffer(b"".join(pdf["vecs"]), dtype=np.float64).reshape(len(ids), dim)


def _linked(a: np.ndarray, a32: np.ndarray, b: np.ndarray, b32: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have cosine >= least: in single precision, near the threshold in double."""
    sims = a32 @ b32.T
    links = sims >= least
    i, j = np.nonzero(np.abs(sims - np.float32(least)) < NEAR)
    if len(i):
        links[i, j] = np.einsum("ij,ij->i", a[i], b[j]) >= least
    return links


def join_block(ids_h, m_h, home, ids_f, m_f, guests, with_home: bool, least: float):
    """(rid, links, root) of the rows that have links in this block; each pair is looked at once.

    ``m_h`` and ``m_f`` say how many rows a point stands for. A point's links are to other points.
    """
    ids, weight = np.concatenate((ids_h, ids_f)), np.concatenate((m_h, m_f))
    whole = np.concatenate((home, guests)) if len(ids_f) else home
    whole32 = whole.astype(np.float32)
    count, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
    for low in range(0, len(ids_h), 256):
        high = min(low + 256, len(ids_h))
        # home rows meet home rows after them, and all visitors
        first = low if with_home else len(ids_h)
        links = _linked(whole[low:high], whole32[low:high], whole[first:], whole32[first:], least)
        if with_home:
            own = np.arange(high - low)
            links[:, : high - low] &= own[:, None] < own[None, :]
        for r in np.flatnonzero(links.any(axis=1)):
            to = np.flatnonzero(links[r]) + first
            count[low + r] += weight[to].sum()
            count[to] += weight[low + r]
            joined = np.unique(np.append(root[to], root[low + r]))
            if len(joined) > 1:
                root[np.isin(root, joined)] = joined[0]
    keep = count > 0
    return ids[keep], count[keep], ids[root[keep]]


def range_join(embeddings: DataFrame, least: float = 0.9) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; so do vectors of different dimensions. Rows that
    repeat a vec_id are vectors of their own, and link with each other;
    equal vectors link whatever their number. A component is named by its
    least vec_id that is not null; a vector without links by its own. An
    empty table gives no rows. Long vectors make blocks of fewer rows. Other
    columns, whatever their names, are not looked at.
    """
    vectors = numbered(embeddings)
    equal = vectors.where("ok").groupBy("v").agg(F.min("rid").alias("rid"), F.count("*").alias("m"))
    points = stored(equal, "points")
    n = points.count()
    pivots = choose_pivots(points, min(MAX_PIVOTS, max(MIN_PIVOTS, -(-n // CELL))))
    cells = Cells(pivots, math.sqrt(max(0.0, 2 - 2 * least)))
    dealt = deal(points, cells, *layout(cells.count(points), BLOCK_BYTES))

    def join(pdf):
        out = []
        for dim, own in pdf.groupby("dim"):
            home, guests = own[own["home"]], own[~own["home"]]
            if not len(home):
                continue
            h = _unpacked(home, int(dim))
            f = _unpacked(guests, int(dim)) if len(guests) else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, int(dim))))
            out.append(pd.DataFrame(dict(zip(("rid", "n", "root"), join_block(*h, *f, int(pdf["part"].iloc[0]) == 0, least)))))
        return pd.concat(out) if out else pd.DataFrame({"rid": [], "n": [], "root": []}).astype("int64")

    found = stored(dealt.groupBy("cell", "block", "part").applyInPandas(join, "rid long, n long, root long"), "links")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    roots = connected_components(found.select(F.col("rid").alias("src"), F.col("root").alias("dst")))
    about = points.select(F.col("rid").alias("point"), "m", F.col("v").alias("pv"))
    about = about.join(roots, F.col("point") == F.col("node"), "left").join(counts, F.col("point") == F.col("rid"), "left")
    about = about.select("pv", (F.col("m") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("root", "point").alias("root"))
    # one row a point: copies of one vector may be any share of the rows, and such a join can be split
    about = stored(about, "about")
    marked = vectors.join(about.hint("merge"), vectors["ok"] & (vectors["v"] == about["pv"]), "left").select("vec_id", "n_links", "root")
    marked = stored(marked, "marked")
    least_id = stored(marked.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("component_id")), "least")
    drop_stored(vectors, points, found, about)
    out = marked.join(least_id, "root", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op3_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_join(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM l GROUP BY x)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""
