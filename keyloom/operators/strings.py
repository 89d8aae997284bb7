"""Strings and counters: ``(key, value)`` columns, and command logs ``(key, seq, ...)`` that are folded by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strlen(value: Column) -> Column:
    """Length in bytes; 0 for a missing value."""
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def byte_range(value: Column, start: int, stop: int) -> Column:
    """Bytes from ``start`` to ``stop``, both included, as a byte string; negative positions count from the end."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    low = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    high = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.when(high >= low, F.substring(raw, low + 1, high - low + 1)).otherwise(F.lit(bytearray()))


def set_range(value: Column, offset: int, patch: str | bytes) -> Column:
    """The byte string with bytes overwritten from an offset, padded with zero bytes.  An empty patch changes nothing."""
    raw = F.coalesce(value.cast("binary"), F.lit(bytearray()))
    patch = bytearray(patch.encode() if isinstance(patch, str) else patch)
    if not patch:
        return raw
    pad = F.repeat(F.lit("\0"), F.greatest(F.lit(offset) - F.octet_length(raw), F.lit(0))).cast("binary")
    return F.concat(F.substring(raw, 1, offset), pad, F.lit(patch), F.substring(raw, offset + len(patch) + 1, 1 << 30))


def last_write(log: DataFrame, *columns: str) -> DataFrame:
    """The columns of the last row by ``seq`` of each key."""
    return log.groupBy("key").agg(*[F.max_by(c, "seq").alias(c) for c in columns])


def first_write(log: DataFrame, *columns: str) -> DataFrame:
    """The columns of the first row by ``seq`` of each key: writes that need the key absent."""
    return log.groupBy("key").agg(*[F.min_by(c, "seq").alias(c) for c in columns])


def set_if_absent(state: DataFrame, new: DataFrame) -> DataFrame:
    """New rows ``(key, seq, value)`` that may be written: the first of each key that ``state`` lacks."""
    return first_write(new.join(state.select("key"), "key", "left_anti"), "value")


def previous(log: DataFrame, column: str) -> DataFrame:
    """Adds ``old``, what the key held before each write."""
    return log.withColumn("old", F.lag(column).over(Window.partitionBy("key").orderBy("seq")))


def append(log: DataFrame) -> DataFrame:
    """Values of each key joined in order of ``seq``, with the byte length.  A key's values meet in one row, as the
    result does."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    joined = F.array_join(F.transform(parts, lambda x: x["value"]), "")
    return log.groupBy("key").agg(joined.alias("value")).withColumn("n_bytes", F.octet_length("value").cast("long"))


def count_up(log: DataFrame, delta: Column) -> DataFrame:
    """Running counter of each key after every command."""
    order = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("counter", F.sum(delta).over(order))


def totals(log: DataFrame, delta: Column) -> DataFrame:
    """Final counter of each key; sums are taken before the shuffle."""
    return log.groupBy("key").agg(F.sum(delta).alias("counter"))


def fixed_window_counter(log: DataFrame, window_ms: int) -> DataFrame:
    """Counters whose window starts with the first command after the last window's end: ``(key, opened_ms, counter)``.

    Order decides, so a key's commands are read one after the other in order of time; only the open window is held, however
    many commands the key has."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, opened, counter = None, None, 0
        for batch in batches:
            closed = []
            for key, ts in zip(batch["key"].tolist(), batch["ts_ms"].tolist(), strict=True):
                if opened is not None and key == now and ts < opened + window_ms:
                    counter += 1
                    continue
                if opened is not None:
                    closed.append((now, opened, counter))
                now, opened, counter = key, ts, 1
            yield pd.DataFrame(closed, columns=["key", "opened_ms", "counter"])
        if opened is not None:
            yield pd.DataFrame([(now, opened, counter)], columns=["key", "opened_ms", "counter"])

    timed = log.select("key", F.col("ts_ms").cast("long").alias("ts_ms")).where("ts_ms IS NOT NULL")
    return timed.repartition("key").sortWithinPartitions("key", "ts_ms").mapInPandas(fold, "key string, opened_ms long, counter long")


def compare_and_set(log: DataFrame) -> DataFrame:
    """Folds ``(key, seq, version, value)``: a write succeeds if its version is the stored one, or the key is new or was
    never versioned (-1); the stored version becomes the write's plus one.  Returns key, version, value, accepted."""
    writes = F.array_sort(F.collect_list(F.struct("seq", "version", "value")))
    start = F.struct(F.lit(-1).cast("bigint").alias("version"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("accepted"))

    def step(state: Column, w: Column) -> Column:
        ok = (state["version"] == -1) | (state["version"] == w["version"])
        new = F.struct((w["version"] + 1).alias("version"), w["value"].alias("value"), (state["accepted"] + 1).alias("accepted"))
        return F.when(ok, new).otherwise(state)

    return log.groupBy("key").agg(F.aggregate(writes, start, step).alias("s")).select("key", "s.version", "s.value", "s.accepted")


def set_if_present(log: DataFrame) -> DataFrame:
    """Folds ``(key, seq, kind, value)`` where ``kind`` is ``nx`` (write if absent), ``xx`` (write if present), ``set`` or ``del``."""
    writes = F.array_sort(F.collect_list(F.struct("seq", "kind", "value")))

    def step(value: Column, w: Column) -> Column:
        blocked = (w["kind"].eqNullSafe("nx") & value.isNotNull()) | (w["kind"].eqNullSafe("xx") & value.isNull())
        return F.when(blocked, value).when(w["kind"] == "del", F.lit(None).cast("string")).otherwise(w["value"])

    return log.groupBy("key").agg(F.aggregate(writes, F.lit(None).cast("string"), step).alias("value")).where("value IS NOT NULL")
