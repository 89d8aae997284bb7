"""Snapshots of element tables as Parquet, by slot, so that a slot range reads only its folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.keyspace import SLOTS, key_slot

FOLDERS = 16


def backup(rows: DataFrame, path: str) -> None:
    """Writes a new snapshot; an existing one is an error."""
    folder = F.floor(F.col("slot") * FOLDERS / SLOTS).cast("int")
    placed = rows.withColumn("slot", key_slot(F.col("key"))).withColumn("slots", folder)
    placed.write.mode("errorifexists").partitionBy("slots").parquet(path)


def restore_backup(spark: SparkSession, path: str, first_slot: int = 0, last_slot: int = SLOTS - 1) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("slot").between(first_slot, last_slot))
    return rows.where(F.col("slots").between(first_slot * FOLDERS // SLOTS, last_slot * FOLDERS // SLOTS)).drop("slot", "slots")
