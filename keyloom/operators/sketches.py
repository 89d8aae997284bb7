"""Distinct counts by HyperLogLog sketches, one binary value a key: ``(key, sketch)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 14
REGISTERS = 1 << BITS


def sketched(rows: DataFrame, element: str) -> DataFrame:
    """A sketch of the elements of each key; partial sketches are merged, so a key may have any number of rows."""
    return rows.groupBy("key").agg(F.hll_sketch_agg(element, BITS).alias("sketch"))


def add(sketches: DataFrame, rows: DataFrame, element: str) -> DataFrame:
    """The sketches after adding rows ``(key, element)``."""
    return sketches.unionByName(sketched(rows, element)).groupBy("key").agg(F.hll_union_agg("sketch").alias("sketch"))


def merge(sketches: DataFrame, key: str) -> DataFrame:
    """The sketch of the union of all keys."""
    return sketches.agg(F.hll_union_agg("sketch").alias("sketch")).select(F.lit(key).alias("key"), "sketch")


def estimate(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("n"))


def registers(rows: DataFrame, element: str) -> DataFrame:
    """What registers of such a sketch look like, ``(key, reg, rho)``, to see how even the hashes are."""
    h = F.xxhash64(element)
    # the hash's other bits, with a stop bit; rho is the position of the lowest one
    rest = F.shiftrightunsigned(h, BITS).bitwiseOR(F.lit(1 << (64 - BITS)))
    rho = F.round(F.log2(rest.bitwiseAND(-rest).cast("double"))).cast("int") + 1
    return rows.select("key", h.bitwiseAND(F.lit(REGISTERS - 1)).cast("int").alias("reg"), rho.alias("rho")).groupBy("key", "reg").agg(F.max("rho").alias("rho"))
