"""Which side of a grid a colour holds: corner ownership and core sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .replay import colour_of


def corner_ids(nodes: DataFrame) -> dict[str, int]:
    """The nodes at the four extreme places."""
    e = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    places = {"sw": ("x0", "y0"), "nw": ("x0", "y1"), "se": ("x1", "y0"), "ne": ("x1", "y1")}
    at = nodes.join(F.broadcast(e), how="left")
    picked = [F.min(F.when((F.col("x") == F.col(a)) & (F.col("y") == F.col(b)), F.col("node_id"))).alias(k) for k, (a, b) in places.items()]
    return at.agg(*picked).first().asDict()


def corner_ownership(held: DataFrame, corners: dict[str, int]) -> DataFrame:
    """(chain_id, step, side): 0 to 3 where colour 0 parts the corners straight, else null."""
    c = colour_of(held, corners)
    f = {k: F.coalesce((F.col(k) == 0).cast("int"), F.lit(0)) for k in corners}
    side = (
        F.when(f["sw"] == f["nw"], F.when(f["se"] == f["ne"], 2 * f["sw"]))
        .when((f["sw"] == f["se"]) & (f["nw"] == f["ne"]), 1 + 2 * f["sw"])
    )
    return c.select("chain_id", "step", side.cast("int").alias("side"))


def probe_ids(nodes: DataFrame, interval: float = 0.5, strict_reference: bool = True) -> dict[str, int]:
    """Eight border nodes just inside the outer parts of each side (strictly).

    A grid too small for one raises; unless ``strict_reference``, the missing probe is None and counts as not held.
    """
    e = nodes.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    n = nodes.join(F.broadcast(e), how="left")
    picked = []
    for axis, across, names in (("y", "x", (("w", "sw_h", "nw_h"), ("e", "se_h", "ne_h"))), ("x", "y", (("s", "sw_v", "se_v"), ("n", "nw_v", "ne_v")))):
        a, lo, hi = F.col(axis), F.col(f"{axis}0"), F.col(f"{axis}1")
        middle, half = (lo + hi) / 2, (hi - lo) * interval / 2
        for k, (_, low, high) in enumerate(names):
            on = F.col(across) == F.col(f"{across}{k}")
            picked.append(F.max_by("node_id", F.when(on & (a > lo) & (a < middle - half), a)).alias(low))
            picked.append(F.min_by("node_id", F.when(on & (a < hi) & (a > middle + half), a)).alias(high))
    found = n.agg(*picked).first().asDict()
    missing = [k for k, v in found.items() if v is None]
    if missing and strict_reference:
        raise ValueError(f"no probe node for {missing}")
    return found


def core_sets(held: DataFrame, probes: dict[str, int]) -> DataFrame:
    """(chain_id, step, core): 0 to 3 where colour 0 parts the grid across or along, else null."""
    c = colour_of(held, probes)
    f = {k: F.coalesce((F.col(k) == 0).cast("int"), F.lit(0)) for k in probes}
    across = (f["sw_h"] != f["nw_h"]) & (f["se_h"] != f["ne_h"])
    along = (f["sw_v"] != f["se_v"]) & (f["ne_v"] != f["nw_v"])
    core = F.when(across, 2 * f["sw_h"]).when(along, 1 + 2 * f["sw_v"])
    return c.select("chain_id", "step", core.cast("int").alias("core"))
