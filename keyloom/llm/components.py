"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shared import drop, keep, meet


def _least(edges: DataFrame, label: str) -> DataFrame:
    """The smallest neighbour ``m`` of each node, and how many it has."""
    return keep(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), f"{label}-least")


def _large_star(edges: DataFrame, n: int, label: str) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both, label)
    out = keep(meet(both, least, "u", 2 * n, counted=True).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), f"{label}-large")
    drop(least)
    return out


def _small_star(edges: DataFrame, n: int, label: str) -> DataFrame:
    """Every node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, label)
    moved = meet(down, least, "u", n, counted=True).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = keep(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), label)
    drop(least)
    return out


def _settled(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``(node, component)`` for every node with an edge: the smallest node that edges ``(u, v)`` reach from it.

    Each round is written to the shared folder, which keeps lineage short.  A hub's minimum is combined before the shuffle and
    broadcast to its edges, which stay where they are.  An empty table gives an empty result.
    """
    tidy = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = keep(tidy.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    state = _settled(now)
    while state[0]:
        large = _large_star(now, state[0], label)
        after = _small_star(large, state[0], label)
        drop(now), drop(large)
        now, before, state = after, state, _settled(after)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
