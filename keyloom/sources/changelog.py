"""Change logs: ``(seq, ts_ms, key, op, value)``, applied in order of ``seq``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply(state: DataFrame, log: DataFrame, applied: int = -1) -> DataFrame:
    """``state(key, value)`` after the log; entries up to ``applied`` were applied before and are refused."""
    last = log.where(F.col("seq") > applied).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("_last"))
    kept = state.join(last.select("key"), "key", "left_anti").select("key", "value")
    return kept.unionByName(last.where("_last.op = 'set'").select("key", F.col("_last.value").alias("value")))


def replay(log: DataFrame, upto: int) -> DataFrame:
    """The state right after entry ``upto``."""
    last = log.where(F.col("seq") <= upto).groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("_last"))
    return last.where("_last.op = 'set'").select("key", F.col("_last.value").alias("value"))


def changed_keys(log: DataFrame, first: int, last: int) -> DataFrame:
    """Keys changed by entries ``first`` to ``last``, with the last operation and its number."""
    return log.where(F.col("seq").between(first, last)).groupBy("key").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))


def bounds(log: DataFrame) -> DataFrame:
    """Lowest and highest entry and the time of the highest."""
    return log.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by("ts_ms", "seq").alias("ts_ms"))


def watermarks(log: DataFrame, source: str) -> DataFrame:
    """Position and time of each source, and the position all of them have passed."""
    marks = log.groupBy(source).agg(F.max("seq").alias("seq"), F.max("ts_ms").alias("ts_ms"))
    return marks.unionByName(marks.agg(F.lit("all").alias(source), F.min("seq").alias("seq"), F.min("ts_ms").alias("ts_ms")))
