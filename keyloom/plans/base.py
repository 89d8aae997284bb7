"""A registered query: how Spark runs it and which SQL gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The test tables of one folder, opened on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


class Query(NamedTuple):
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def query(name: str, plan: Callable[[Tables], DataFrame], sql: str | None = None) -> Query:
    return Query(name, lambda spark, folder: plan(Tables(spark, folder)), sql)
