"""Positions in an order, for keys that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.streaming.base import scratch


def in_pieces(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's position from 0 within its ``key``; ``order`` must tell a key's rows apart.

    Rows are cut by ranges of the whole order, so a large key falls into many pieces.  A piece is counted and numbered by itself;
    the sizes of the pieces before it, of which there are few, are added.  The cut is written to the shared folder, as a second
    sampling of the ranges could cut elsewhere."""
    path = scratch(rows.sparkSession, "pieces")
    rows.repartitionByRange("key", *order).withColumn("_piece", F.spark_partition_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path)
    before = Window.partitionBy("key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("key", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("key", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("key", "_piece").orderBy(*order)) - 1
    return placed.withColumn("_i", local).join(offsets, ["key", "_piece"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_i", "_before", "_piece")
