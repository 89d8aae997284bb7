"""Lists in long form: ``(key, idx, value)``.  ``idx`` orders the elements and may have gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.ranking import in_pieces
from keyloom.operators.zsets import within


def _order(reverse: bool = False) -> Window:
    return Window.partitionBy("key").orderBy(F.col("idx").desc() if reverse else F.col("idx"))


def positioned(rows: DataFrame, large: bool = False) -> DataFrame:
    """Adds ``pos`` from 0.  Each list is sorted in one task, or for ``large`` lists, whose ``idx`` must differ, in many."""
    if large:
        return in_pieces(rows, [F.col("idx")], "pos")
    return rows.withColumn("pos", F.row_number().over(_order()) - 1)


def sized(rows: DataFrame) -> DataFrame:
    """Adds ``pos`` and ``n``, the length of the key's list."""
    return positioned(rows).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))


def lrange(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """Elements by position; positions of one sign are a top-k from one end."""
    if start >= 0 and stop >= 0:
        return positioned(rows).where(F.col("pos").between(start, stop))
    if start < 0 and stop < 0:
        back = rows.withColumn("_b", F.row_number().over(_order(reverse=True)))
        return back.where(F.col("_b").between(-stop, -start)).drop("_b")
    return sized(rows).where(within(F.col("pos"), F.col("n"), start, stop)).drop("n")


def pop(rows: DataFrame, n: int = 1, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """The ``n`` elements taken from one end, and the rest."""
    numbered = rows.withColumn("_i", F.row_number().over(_order(reverse=right)))
    return numbered.where(F.col("_i") <= n).drop("_i"), numbered.where(F.col("_i") > n).drop("_i")


def push(rows: DataFrame, new: DataFrame, left: bool = False, only_present: bool = False) -> DataFrame:
    """Adds ``new(key, seq, value)`` one by one at one end."""
    end = (F.min if left else F.max)("idx").alias("_end")
    ends = rows.groupBy("key").agg(end)
    step = F.row_number().over(Window.partitionBy("key").orderBy("seq"))
    at = F.coalesce("_end", F.lit(0.0)) + (-step if left else step)
    new = new.join(ends, "key", "inner" if only_present else "left").select("key", at.cast("double").alias("idx"), "value")
    return rows.select("key", "idx", "value").unionByName(new)


def remove_equal(rows: DataFrame, value: str, count: int) -> DataFrame:
    """Without the first (or, for a negative count, last) ``count`` elements equal to ``value``; 0 removes all."""
    if count == 0:
        return rows.where(F.col("value") != value)
    order = Window.partitionBy("key", "value").orderBy(F.col("idx").desc() if count < 0 else F.col("idx"))
    nth = F.row_number().over(order)
    return rows.withColumn("_i", nth).where((F.col("value") != value) | (F.col("_i") > abs(count))).drop("_i")


def insert(rows: DataFrame, pivot: str, value: str, after: bool = False) -> DataFrame:
    """Inserts before or after the first element equal to ``pivot``; lists without it stay as they are."""
    places = rows.where(F.col("value") == pivot).groupBy("key").agg(F.min("idx").alias("_at"))
    # half way to the neighbour on that side
    beside = rows.join(places, "key").where("idx > _at" if after else "idx < _at").groupBy("key").agg((F.min if after else F.max)("idx").alias("_next"))
    gap = F.coalesce("_next", F.col("_at") + (1 if after else -1))
    new = places.join(beside, "key", "left").select("key", ((F.col("_at") + gap) / 2).alias("idx"), F.lit(value).alias("value"))
    return rows.select("key", "idx", "value").unionByName(new)


def replace_at(rows: DataFrame, position: int, value: str) -> DataFrame:
    """Sets the element at a position, which may count from the back; lists too short stay as they are."""
    if position >= 0:
        hit = F.row_number().over(_order()) == position + 1
    else:
        hit = F.row_number().over(_order(reverse=True)) == -position
    return rows.withColumn("value", F.when(hit, F.lit(value)).otherwise(F.col("value")))


def move_last(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Moves the last element of ``source`` to the head of ``target``, for ``pairs(source, target)`` with each key once
    on either side; the same key on both sides turns its list."""
    last, rest = pop(rows, right=True)
    moving = last.join(pairs.withColumnRenamed("source", "key"), "key")
    staying = last.join(pairs.withColumnRenamed("source", "key"), "key", "left_anti").select("key", "idx", "value")
    kept = rest.select("key", "idx", "value").unionByName(staying)
    heads = kept.groupBy(F.col("key").alias("target")).agg(F.min("idx").alias("_head"))
    moved = moving.join(heads, "target", "left").select(F.col("target").alias("key"), (F.coalesce("_head", F.lit(0.0)) - 1).alias("idx"), "value")
    return kept.unionByName(moved)
