"""Keyed structures seen in the test tables: a DataFrame and the same relation in SQL for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.plans.base import Tables

NOW_MS = 1705276800000  # 2024-01-15 00:00:00 UTC
WEEK_MS = 7 * 86_400_000


def ms(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def part_names(t: Tables) -> DataFrame:
    return t.part.select(F.concat(F.lit("part:"), "p_partkey").alias("key"), F.col("p_name").alias("value"), "p_partkey")


PART_NAMES = "(SELECT 'part:' || p_partkey AS key, p_name AS value, p_partkey FROM part)"


def writes(t: Tables) -> DataFrame:
    """A command log: one write per event."""
    return t.events.select(
        F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").alias("seq"), ms("ts").alias("ts_ms"), F.col("event_type").alias("value"),
        F.round(F.col("value") * 100).cast("long").alias("cents"), "user_id",
    )


WRITES = "(SELECT 'user:' || user_id AS key, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, event_type AS value, CAST(round(value * 100) AS BIGINT) AS cents, user_id FROM events)"


def deadlines(t: Tables) -> DataFrame:
    """Keys with an expiry, a week after their last event; those of odd users never expire."""
    last = F.max(ms("ts")) + WEEK_MS
    at = F.when(F.first("user_id") % 2 == 1, F.lit(0)).otherwise(last)
    return t.events.where(ms("ts") < NOW_MS).groupBy(F.concat_ws(":", F.lit("user"), F.col("user_id").cast("string"), "event_type").alias("key")).agg(at.cast("long").alias("expire_at_ms"))


DEADLINES = (
    "(SELECT 'user:' || user_id || ':' || event_type AS key, CASE WHEN user_id % 2 = 1 THEN 0 ELSE max(epoch_us(ts) // 1000) + 604800000 END AS expire_at_ms "
    f"FROM events WHERE epoch_us(ts) // 1000 < {NOW_MS} GROUP BY user_id, event_type)"
)


def customer_hash(t: Tables) -> DataFrame:
    """A hash per customer in long form: ``(key, field, value)``."""
    wide = t.customer.select(
        F.concat(F.lit("cust:"), "c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"),
        F.round(F.col("c_acctbal") * 100).cast("long").cast("string").alias("cents"), F.col("c_mktsegment").alias("segment"),
    )
    return wide.unpivot("key", ["name", "nation", "cents", "segment"], "field", "value")


CUSTOMER_HASH = (
    "(SELECT 'cust:' || c_custkey AS key, unnest(['name', 'nation', 'cents', 'segment']) AS field, "
    "unnest([c_name, CAST(c_nationkey AS VARCHAR), CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR), c_mktsegment]) AS value FROM customer)"
)


def user_list(t: Tables) -> DataFrame:
    """A list per user: ``(key, idx, value)``, in order of time; ``idx`` orders and need not be dense."""
    return t.events.select(F.concat(F.lit("user:"), "user_id").alias("key"), F.col("event_id").cast("double").alias("idx"), F.col("event_type").alias("value"))


USER_LIST = "(SELECT 'user:' || user_id AS key, CAST(event_id AS DOUBLE) AS idx, event_type AS value FROM events)"


def pieces(rows: DataFrame) -> int:
    """Tasks among which a shuffle deals a table's rows: 16 for each split that is read, so that a task's share does not grow with the
    table.  Adaptive execution leaves partitions that are given by number as they are, and would else merge them to one a core."""
    return 16 * rows.rdd.getNumPartitions()


def supplier_sets(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.concat(F.lit("sup:"), "l_suppkey").alias("key"), F.col("l_partkey").cast("string").alias("member"))
    return rows.repartition(pieces(t.lineitem), "key", "member").distinct()


SUPPLIER_SETS = "(SELECT DISTINCT 'sup:' || l_suppkey AS key, CAST(l_partkey AS VARCHAR) AS member FROM lineitem)"


def nation_zset(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("nation:"), "c_nationkey").alias("key"), F.col("c_custkey").cast("string").alias("member"), F.col("c_acctbal").alias("score"))


NATION_ZSET = "(SELECT 'nation:' || c_nationkey AS key, CAST(c_custkey AS VARCHAR) AS member, c_acctbal AS score FROM customer)"


def size_zset(t: Tables) -> DataFrame:
    """One sorted set with many equal scores."""
    return t.part.select(F.lit("size").alias("key"), F.col("p_partkey").cast("string").alias("member"), F.col("p_size").cast("double").alias("score"))


SIZE_ZSET = "(SELECT 'size' AS key, CAST(p_partkey AS VARCHAR) AS member, CAST(p_size AS DOUBLE) AS score FROM part)"


def minute(ts) -> Column:
    """Minute of the year, a position that stays sparse over all events."""
    return ((F.dayofyear(ts) - 1) * 1440 + F.hour(ts) * 60 + F.minute(ts)).cast("long")


def event_bits(t: Tables) -> DataFrame:
    """A bitmap per event type: ``(key, pos)`` of the bits that are set, the minutes with such an event."""
    return t.events.select(F.concat(F.lit("act:"), "event_type").alias("key"), minute("ts").alias("pos")).distinct()


MINUTE = "CAST((dayofyear(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts) AS BIGINT)"
EVENT_BITS = f"(SELECT DISTINCT 'act:' || event_type AS key, {MINUTE} AS pos FROM events)"
