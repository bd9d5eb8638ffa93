"""Totals by district over a move log that arrives as a stream.

Three keyed steps follow each other in one query. The first, by chain, puts
rows in step order: what comes early is held until the gap before it is
filled. The second, by node or edge, tells what a move changes: an edge
remembers the colours of its ends. The third, by chain and district, keeps
running totals and sends each stretch once it has ended. A chain that has been
silent for a while has its open stretches closed by a timer; should more rows
come, they go on from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.graph import symmetric

OPEN, MOVE, END = 0, 1, 2
VALUES = ["perimeter", "area", "population", "p1", "p2", "n"]
TYPES = "perimeter double, area double, population long, p1 long, p2 long, n long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Frontier(StatefulProcessor):
    """Accepted moves of a chain in step order, with an opening and a closing row a district."""

    def __init__(self, districts: int, idle_ms: int):
        self.districts, self.idle_ms = districts, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.following = handle.getValueState("following", "step long")
        self.early = handle.getMapState("early", "step long", "node_id long, old_color int, new_color int")

    def _marks(self, kind: int, step: int) -> list[tuple]:
        return [(kind, step, None, d, d) for d in range(self.districts)]

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(out, columns=["kind", "step", "node_id", "old_color", "new_color"])
        f.insert(0, "chain_id", key[0])
        return f.astype({"kind": "int32", "step": "int64", "node_id": "Int64", "old_color": "Int32", "new_color": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        if self.following.exists():
            at = self.following.get()[0]
        else:
            at, out = 0, self._marks(OPEN, -1)
        came = pd.concat(list(rows)).sort_values("step", kind="stable").drop_duplicates("step")
        # steps before the frontier were seen already: files may come twice
        for row in came[came["step"] >= at][["step", "node_id", "old_color", "new_color"]].itertuples(index=False):
            step, *move = (None if pd.isna(v) else int(v) for v in row)
            while at < step and self.early.containsKey((at,)):
                at = self._release(at, out)
            if step > at:
                self.early.updateValue((step,), tuple(move))
            elif step == at:
                at = self._passed(at, tuple(move), out)
        while self.early.containsKey((at,)):
            at = self._release(at, out)
        self.following.update((at,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(key, out)

    def _release(self, at: int, out: list[tuple]) -> int:
        held = self.early.getValue((at,))
        self.early.removeKey((at,))
        return self._passed(at, held, out)

    def _passed(self, at: int, move: tuple, out: list[tuple]) -> int:
        if move[0] is not None:
            out.append((MOVE, at, *move))
        if self.early.containsKey((at,)):
            self.early.removeKey((at,))
        return at + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(key, self._marks(END, self.following.get()[0]))


class Changes(StatefulProcessor):
    """What the moves of one node do to districts, through the node itself (u = v) or one of its edges."""

    def init(self, handle) -> None:
        self.colours = handle.getValueState("colours", "cu int, cv int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, u, v = key
        f = pd.concat(list(rows)).sort_values("step", kind="stable")
        if u == v:
            # marks have no node; their rows, like a node's, say all themselves
            marks, moves = f[f["kind"] != MOVE], f[f["kind"] == MOVE]
            left = moves.assign(district_id=moves["old_color"], **{c: -moves[c] for c in VALUES})
            out = pd.concat([marks.assign(district_id=marks["new_color"]), left, moves.assign(district_id=moves["new_color"])])
            yield out[["chain_id", "district_id", "step", "kind", *VALUES]]
            return
        cu, cv = self.colours.get() if self.colours.exists() else (int(f["at_u"].iloc[0]), int(f["at_v"].iloc[0]))
        out = []
        for step, node, colour, length in zip(f["step"], f["node_id"], f["new_color"], f["perimeter"]):
            if cu != cv:
                out += [(cu, step, -length), (cv, step, -length)]
            cu, cv = (int(colour), cv) if node == u else (cu, int(colour))
            if cu != cv:
                out += [(cu, step, length), (cv, step, length)]
        self.colours.update((cu, cv))
        sent = pd.DataFrame(out, columns=["district_id", "step", "perimeter"]).groupby(["district_id", "step"], as_index=False).sum()
        sent = sent.assign(chain_id=key[0], kind=MOVE, area=0.0, population=0, p1=0, p2=0, n=0)
        yield sent[["chain_id", "district_id", "step", "kind", *VALUES]].astype({"district_id": "int32", "step": "int64", "perimeter": "float64"})


class Totals(StatefulProcessor):
    """Stretches of one district with its totals, each sent when the next begins."""

    def init(self, handle) -> None:
        self.current = handle.getValueState("current", f"start_step long, {TYPES}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).groupby("step", as_index=False)[VALUES].sum().sort_values("step")
        start, *now = self.current.get() if self.current.exists() else (-1, 0.0, 0.0, 0, 0, 0, 0)
        out = []
        for step, *change in f[["step", *VALUES]].itertuples(index=False):
            if step > start:
                out.append((start, step, *now))
            start, now = int(step), [a + b for a, b in zip(now, change)]
        self.current.update((start, float(now[0]), float(now[1]), *map(int, now[2:])))
        sent = pd.DataFrame(out, columns=["start_step", "end_step", *VALUES])
        sent.insert(0, "district_id", key[1])
        sent.insert(0, "chain_id", key[0])
        yield sent.astype({"perimeter": "float64", "area": "float64", **{c: "int64" for c in ["start_step", "end_step", *VALUES[2:]]}})


def _static(assignment: DataFrame, nodes: DataFrame, edges: DataFrame, votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, parts): a node and its edges as a move meets them; (district_id, VALUES): totals at the start."""
    zero = {"area": F.lit(0.0), **{c: F.lit(0).cast("long") for c in VALUES[2:]}}
    colour = assignment.select("node_id", F.col("district_id").cast("int").alias("colour"))
    own = nodes.join(votes.select("node_id", "p1", "p2"), "node_id", "left").join(colour, "node_id")
    own = own.select(
        "node_id", "colour", F.col("external_border").cast("double").alias("perimeter"), F.col("area").cast("double").alias("area"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("population", "p1", "p2")], F.lit(1).cast("long").alias("n"),
    )
    sides = symmetric(edges).join(colour, "node_id").join(colour.select(F.col("node_id").alias("other"), F.col("colour").alias("beyond")), "other")
    sides = sides.withColumn("perimeter", F.col("border_length").cast("double")).withColumns(zero)
    first = F.col("node_id") < F.col("other")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    part = sides.select("node_id", pick("node_id", "other").alias("u"), pick("other", "node_id").alias("v"), pick("colour", "beyond").alias("at_u"), pick("beyond", "colour").alias("at_v"), *VALUES)
    itself = own.select("node_id", F.col("node_id").alias("u"), F.col("node_id").alias("v"), F.col("colour").alias("at_u"), F.col("colour").alias("at_v"), *VALUES)
    parts = itself.unionByName(part).groupBy("node_id").agg(F.collect_list(F.struct("u", "v", "at_u", "at_v", *VALUES)).alias("parts"))
    start = own.select("colour", *VALUES).unionByName(sides.where("colour <> beyond").select("colour", *VALUES))
    return parts, start.groupBy(F.col("colour").alias("new_color")).agg(*[F.sum(c).alias(c) for c in VALUES])


def district_totals(stream: DataFrame, assignment: DataFrame, nodes: DataFrame, edges: DataFrame, votes: DataFrame, districts: int, idle_ms: int = 60_000) -> DataFrame:
    """(chain_id, district_id, start_step, end_step, perimeter, area, population, p1, p2, n), appended as stretches end.

    A chain's steps are 0, 1, 2, ...; they may come in any order and more than
    once, but a gap holds back all after it, in the state. After ``idle_ms``
    without rows of a chain its open stretches end at its next step; a stretch
    may therefore be sent in pieces, which say the same of every step.
    Colours are 0 to ``districts`` - 1. The start's colours must not change
    between restarts: edges take them from there at their first move.
    """
    rocks_db(stream.sparkSession)
    parts, start = _static(assignment, nodes, edges, votes)
    log = stream.select("chain_id", "step", "node_id", "old_color", "new_color")
    ordered = log.groupBy("chain_id").transformWithStateInPandas(Frontier(districts, idle_ms), "chain_id long, kind int, step long, node_id long, old_color int, new_color int", "append", "processingTime")
    met = ordered.join(parts, "node_id", "left").join(start.withColumn("kind", F.lit(OPEN)), ["kind", "new_color"], "left")
    # a mark's part is its district's totals at the start, or nothing, under a name no node has
    mark = -1 - F.col("new_color").cast("long")
    totals = [F.coalesce(F.col(c), F.lit(0)).cast("double" if c in VALUES[:2] else "long").alias(c) for c in VALUES]
    bare = F.array(F.struct(mark.alias("u"), mark.alias("v"), F.col("new_color").alias("at_u"), F.col("new_color").alias("at_v"), *totals))
    part = met.select("chain_id", "kind", "step", "node_id", "old_color", "new_color", F.explode(F.when(F.col("kind") == MOVE, F.col("parts")).otherwise(bare)).alias("p"))
    part = part.select("chain_id", "kind", "step", "node_id", "old_color", "new_color", "p.*")
    changes = part.groupBy("chain_id", "u", "v").transformWithStateInPandas(Changes(), f"chain_id long, district_id int, step long, kind int, {TYPES}", "append", "processingTime")
    return changes.groupBy("chain_id", "district_id").transformWithStateInPandas(Totals(), f"chain_id long, district_id int, start_step long, end_step long, {TYPES}", "append", "processingTime")


def at_steps(stretches: DataFrame) -> DataFrame:
    """One row a step of each stretch sent: chain_id, step, district_id, totals."""
    some = stretches.where("end_step > greatest(start_step, 0)")
    return some.select("chain_id", F.explode(F.sequence(F.greatest("start_step", F.lit(0)), F.col("end_step") - 1)).alias("step"), "district_id", *VALUES)


def wins(stretches: DataFrame) -> DataFrame:
    """(chain_id, step, wins): districts in which p1 is ahead, of stretches sent."""
    return at_steps(stretches).groupBy("chain_id", "step").agg(F.count_if(F.col("p1") > F.col("p2")).cast("int").alias("wins"))


def rocks_db(spark: SparkSession) -> None:
    """Keyed state with timers needs this store; it is set for the session unless another is."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, PROVIDER)
