"""Sets: distinct ``(key, member)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _of(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key).select("member")


def union(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where(F.col("key").isin(keys)).select("member").distinct()


def intersect(rows: DataFrame, keys: list[str], skip_missing: bool = False) -> DataFrame:
    """Members of all the sets: one count by member, whatever the number of sets.  A missing set makes the result
    empty, or is left out with ``skip_missing``."""
    keys = sorted(set(keys))
    chosen = rows.where(F.col("key").isin(keys))
    counts = chosen.groupBy("member").agg(F.count(F.lit(1)).alias("_n"))
    if not skip_missing:
        return counts.where(F.col("_n") == len(keys)).select("member")
    present = chosen.select("key").distinct().agg(F.count(F.lit(1)).alias("_sets"))
    return counts.join(F.broadcast(present), F.col("_n") == F.col("_sets")).select("member")


def difference(rows: DataFrame, first: str, others: list[str]) -> DataFrame:
    """Members of the first set and none of the others."""
    return _of(rows, first).join(rows.where(F.col("key").isin(others)).select("member"), "member", "left_anti")


def store(members: DataFrame, key: str) -> DataFrame:
    return members.select(F.lit(key).alias("key"), "member")


def add(rows: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets with new members, and how many of those each key did not have."""
    fresh = new.select("key", "member").distinct().join(rows, ["key", "member"], "left_anti")
    return rows.unionByName(fresh), fresh.groupBy("key").agg(F.count(F.lit(1)).alias("added"))


def smallest(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` members of each set by their bytes."""
    order = Window.partitionBy("key").orderBy("member")
    return rows.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= n).drop("_i")


def sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` members of each set, chosen by a seeded hash: reruns agree.  A negative ``n`` draws as many members one by one, so that
    one may be drawn again: ``(key, draw, member)``."""
    if n < 0:
        draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(-n))))
        drawn = F.min_by("member", F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), "key", "member")), "member"))
        return draws.groupBy("key", "draw").agg(drawn.alias("member"))
    order = Window.partitionBy("key").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "key", "member")), "member")
    return rows.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= n).drop("_i")


def move(rows: DataFrame, moves: DataFrame, pieces: int | None = None) -> DataFrame:
    """Moves ``moves(source, target, member)`` where the source holds the member: one join, and one shuffle that makes members of the
    target distinct, over ``pieces`` tasks if given."""
    found = rows.join(moves.select(F.col("source").alias("key"), "member", F.struct("target").alias("_to")), ["key", "member"], "left")
    moved = found.select(F.when(F.col("_to").isNull(), F.col("key")).otherwise(F.col("_to.target")).alias("key"), "member")
    return (moved.repartition(pieces, "key", "member") if pieces else moved).distinct()
