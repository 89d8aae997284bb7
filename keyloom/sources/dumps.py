"""Dumps: one self-contained row a key, with a checksum; and the commands that would rebuild a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns of an element, and the command that writes one, for each type.
SCHEMAS = {"string": "value string", "hash": "field string, value string", "list": "idx double, value string", "set": "member string", "zset": "member string, score double", "bitmap": "pos bigint"}
VERBS = {"string": "SET", "hash": "HSET", "list": "RPUSH", "set": "SADD", "zset": "ZADD"}


def _columns(kind: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[kind].split(", ")]


def _sum(kind: Column, payload: Column) -> Column:
    return F.crc32(F.concat_ws(":", kind, payload).cast("binary"))


def dump(rows: DataFrame, kind: str = "hash") -> DataFrame:
    """``(key, kind, payload, crc)`` of structures in long form; the payload is JSON in order of the elements.  A dump is one value,
    so a key's elements meet in one row."""
    entries = F.array_sort(F.collect_list(F.struct(*_columns(kind))))
    dumps = rows.groupBy("key").agg(F.lit(kind).alias("kind"), F.to_json(entries).alias("payload"))
    return dumps.withColumn("crc", _sum(F.col("kind"), F.col("payload")))


def dump_live(dumps: DataFrame, deadlines: DataFrame, now_ms: int) -> DataFrame:
    """Dumps of any types with ``ttl_ms``, 0 for keys that ``deadlines(key, expire_at_ms)`` lack or that never expire; expired keys have none."""
    at = F.coalesce("expire_at_ms", F.lit(0))
    found = dumps.join(deadlines.select("key", "expire_at_ms"), "key", "left").where((at == 0) | (at > now_ms))
    return found.select("key", "kind", "payload", "crc", F.when(at == 0, 0).otherwise(at - now_ms).cast("long").alias("ttl_ms"))


def restore(dumps: DataFrame, kind: str = "hash") -> DataFrame:
    """Rows of all dumps of a type whose checksum holds."""
    sound = dumps.where((F.col("kind") == kind) & (_sum(F.col("kind"), F.col("payload")) == F.col("crc")))
    return sound.select("key", F.inline(F.from_json("payload", f"array<struct<{SCHEMAS[kind].replace(' ', ':').replace(',:', ',')}>>")))


def restorable(dumps: DataFrame, present: DataFrame, now_ms: int, replace: bool = False) -> DataFrame:
    """The dumps that may be restored, with ``expire_at_ms``: those of keys that ``present`` lacks, or of all with ``replace``."""
    free = dumps if replace else dumps.join(present.select("key"), "key", "left_anti")
    return free.withColumn("expire_at_ms", F.when(F.col("ttl_ms") == 0, 0).otherwise(F.col("ttl_ms") + now_ms).cast("long"))


def rebuild(rows: DataFrame, kind: str) -> DataFrame:
    """The commands that write the elements of a type; ``n`` orders those of one list."""
    columns = {"list": ["value"], "zset": ["score", "member"]}.get(kind, _columns(kind))
    n = F.col("idx") if kind == "list" else F.lit(0.0)
    return rebuild_commands(rows.withColumn("n", n), VERBS[kind], *columns)


def rebuild_commands(rows: DataFrame, verb: str, *columns: str) -> DataFrame:
    """One command line for each element, such as ``ZADD key score member``."""
    return rows.select("key", F.concat_ws(" ", F.lit(verb), "key", *[F.col(c).cast("string") for c in columns]).alias("command"), *[c for c in ("n",) if c in rows.columns])


def flag_big(keys: DataFrame, max_elements: int, max_bytes: int) -> DataFrame:
    """Marks keys with more elements or bytes than given."""
    return keys.withColumn("big", ((F.col("n") >= max_elements) | (F.col("n_bytes") >= max_bytes)).cast("int"))
