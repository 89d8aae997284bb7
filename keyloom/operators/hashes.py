"""Hashes in long form: ``(key, field, value)``; one row a field, so no hash has to fit in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_map(rows: DataFrame) -> DataFrame:
    """One map a key, in order of the fields' bytes."""
    return rows.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def get_many(rows: DataFrame, fields: list[str]) -> DataFrame:
    """A column for each field, null where it is missing; one shuffle, combined before it."""
    picks = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    return rows.where(F.col("field").isin(fields)).groupBy("key").agg(*picks)


def put(rows: DataFrame, new: DataFrame, only_absent: bool = False) -> DataFrame:
    """Upserts ``new(key, field, value, seq)``; the last write of a field wins, or the first if only absent fields are set."""
    pick = F.min_by if only_absent else F.max_by
    new = new.groupBy("key", "field").agg(pick("value", "seq").alias("value"))
    if only_absent:
        return rows.unionByName(new.join(rows.select("key", "field"), ["key", "field"], "left_anti"))
    return rows.join(new.select("key", "field"), ["key", "field"], "left_anti").select("key", "field", "value").unionByName(new)


def remove(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the named fields; a key without fields is gone by itself."""
    return rows.join(gone.select("key", "field"), ["key", "field"], "left_anti")


def add(log: DataFrame, delta: Column) -> DataFrame:
    """Sums of each field."""
    return log.groupBy("key", "field").agg(F.sum(delta).alias("value"))


def byte_size(rows: DataFrame, *columns: str) -> DataFrame:
    """Number of elements and bytes of each key."""
    size = sum((F.octet_length(c) for c in columns), F.lit(0))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("n_bytes"))


def compare_and_set(log: DataFrame, explicit: bool = False) -> DataFrame:
    """Folds ``(key, seq, version, field, op, value)`` into versioned hashes.

    A command is carried out if its version is the stored one or the key has none (-1).  ``op`` 0 sets a field to the
    number ``value``, 1 adds.  The version goes up by one, or with ``explicit`` to ``new_version``, if that is higher.
    Returns ``(key, cas, field, value)``.  Order decides, so the commands of one key are folded in one row."""
    columns = ["seq", "version", "field", "op", "value", *(["new_version"] if explicit else [])]
    commands = F.array_sort(F.collect_list(F.struct(*columns)))
    start = F.struct(F.lit(-1).cast("long").alias("cas"), F.create_map().cast("map<string,bigint>").alias("fields"))

    def step(state: Column, c: Column) -> Column:
        ok = (state["cas"] == -1) | (state["cas"] == c["version"])
        if explicit:
            ok = ok & (c["new_version"] > state["cas"])
        old = F.coalesce(F.try_element_at(state["fields"], c["field"]), F.lit(0).cast("long"))
        value = F.when(c["op"] == 1, old + c["value"]).otherwise(c["value"])
        others = F.map_filter(state["fields"], lambda k, _: k != c["field"])
        fields = F.map_concat(others, F.map_from_arrays(F.array(c["field"]), F.array(value)))
        return F.when(ok, F.struct((c["new_version"] if explicit else c["version"] + 1).alias("cas"), fields.alias("fields"))).otherwise(state)

    return log.groupBy("key").agg(F.aggregate(commands, start, step).alias("s")).select("key", "s.cas", F.explode("s.fields").alias("field", "value"))


def page(rows: DataFrame, after: str, n: int) -> DataFrame:
    """The next ``n`` fields of every key after a field."""
    order = Window.partitionBy("key").orderBy("field")
    return rows.where(F.col("field") > after).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= n).drop("_i")
