"""Sorted sets: ``(key, member, score)``.

The order within a key is by score, then by the bytes of the member.  Ranks are row numbers, so
equal scores never share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.ranking import in_pieces


def _order(reverse: bool) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if reverse else [F.col("score"), F.col("member")]


def ranked(zset: DataFrame, reverse: bool = False, large: bool = False) -> DataFrame:
    """Adds ``rank`` from 0.  Each key is sorted in one task, or for ``large`` keys in many."""
    if large:
        return in_pieces(zset, _order(reverse))
    return zset.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*_order(reverse))) - 1)


def sized(zset: DataFrame) -> DataFrame:
    """Adds ``n``, the number of members of the key."""
    return zset.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))


def within(position: Column, n: Column, start: int, stop: int) -> Column:
    """Whether a 0-based position lies in an inclusive range in which negative ends count from the back."""
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = F.lit(stop) if stop >= 0 else n + stop
    return (position >= low) & (position <= high)


def zrange(zset: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members by rank.  Ends of the same sign need one ordered pass only: a range from the back is a
    range from the front of the reverse order, and a range from the front is a top-k that Spark limits
    within each group before the shuffle."""
    if start >= 0 and stop >= 0:
        return ranked(zset, reverse).where(F.col("rank").between(start, stop))
    if start < 0 and stop < 0:
        back = ranked(zset, not reverse).where(F.col("rank").between(-1 - stop, -1 - start))
        return back.drop("rank")
    return sized(ranked(zset, reverse)).where(within(F.col("rank"), F.col("n"), start, stop)).drop("n")


def in_scores(low: float | None = None, high: float | None = None, low_open: bool = False, high_open: bool = False) -> Column:
    """Score range; ``None`` is unbounded."""
    test = F.lit(True)
    if low is not None:
        test = test & (F.col("score") > low if low_open else F.col("score") >= low)
    if high is not None:
        test = test & (F.col("score") < high if high_open else F.col("score") <= high)
    return test


def in_members(low: str | None = None, high: str | None = None, low_open: bool = False, high_open: bool = False) -> Column:
    """Range of member bytes; ``None`` is unbounded, so no member can be mistaken for a bound."""
    test = F.lit(True)
    if low is not None:
        test = test & (F.col("member") > low if low_open else F.col("member") >= low)
    if high is not None:
        test = test & (F.col("member") < high if high_open else F.col("member") <= high)
    return test


def range_by(zset: DataFrame, test: Column, reverse: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """Members that pass a test, each key's own offset and limit applied; a negative limit takes all."""
    rows = zset.where(test)
    if offset == 0 and limit < 0:
        return rows
    rows = ranked(rows, reverse).where(F.col("rank") >= offset)
    return (rows if limit < 0 else rows.where(F.col("rank") < offset + limit)).drop("rank")


def upsert(zset: DataFrame, new: DataFrame, mode: str = "") -> tuple[DataFrame, DataFrame]:
    """Adds ``new(key, member, score, seq)``: the last score of a member wins.  ``nx`` only adds, ``xx`` only changes,
    ``incr`` adds scores up.  NaN scores are refused.  Also returns, by key, how many members were added and changed."""
    new = new.where(~F.isnan("score"))
    pick = {"nx": F.min_by("score", "seq"), "incr": F.sum("score")}.get(mode, F.max_by("score", "seq"))
    new = new.groupBy("key", "member").agg(pick.alias("_new"))
    both = zset.select("key", "member", "score").join(new, ["key", "member"], "full")
    old, value = F.col("score"), F.col("_new")
    result = {
        "nx": F.coalesce(old, value),
        "xx": F.when(old.isNotNull(), F.coalesce(value, old)),
        "incr": F.when(value.isNull(), old).otherwise(F.coalesce(old, F.lit(0.0)) + value),
    }.get(mode, F.coalesce(value, old))
    done = both.withColumn("_result", result)
    counts = done.groupBy("key").agg(
        F.count_if(old.isNull() & F.col("_result").isNotNull()).alias("added"), F.count_if(old.isNotNull() & (F.col("_result") != old)).alias("changed")
    )
    return done.where("_result IS NOT NULL").select("key", "member", F.col("_result").alias("score")), counts


def combine(zset: DataFrame, weights: dict[str, float], how: str = "sum", all_keys: bool = False) -> DataFrame:
    """Weighted union of sorted sets, or with ``all_keys`` their intersection: ``(member, score)``.

    One shuffle by member, combined before it.  Infinities that cancel give 0."""
    keys = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
    scored = zset.where(F.col("key").isin(list(weights))).withColumn("_s", F.nanvl(F.col("score") * F.element_at(keys, F.col("key")), F.lit(0.0)))
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]("_s")
    out = scored.groupBy("member").agg(F.nanvl(fold, F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("_n"))
    return (out.where(F.col("_n") == len(weights)) if all_keys else out).drop("_n")
