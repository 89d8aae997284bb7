"""Registered operators: one query over the test tables each, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyloom.plans import ALL, FAMILIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.name: q.run for q in ALL}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in ALL if q.sql}


def describe(spark: SparkSession) -> DataFrame:
    """The catalogue as a table: ``(name, family, has_sql)``."""
    rows = [(q.name, family, q.sql is not None) for family, module in FAMILIES.items() for q in module.QUERIES]
    return spark.createDataFrame(rows, "name string, family string, has_sql boolean")
