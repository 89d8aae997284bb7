"""Sorting collections by looked-up weights, and fetching looked-up columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sort_by(rows: DataFrame, weights: DataFrame | None = None, fetch: DataFrame | None = None, descending: bool = False, alpha: bool = False, offset: int = 0, limit: int = -1) -> DataFrame:
    """Ranks the elements of every key: ``(key, element, rank, ...)``.

    ``weights(element, weight)`` replaces the element in the comparison; a missing weight counts 0.  Without weights the
    element itself is compared, as a number unless ``alpha``.  ``fetch(element, ...)`` adds its columns, null where it
    has no row.  Ties go by the element, in the same direction.  Only one page of each key is fetched for."""
    if weights is not None:
        rows = rows.join(weights, "element", "left")
        by = F.coalesce("weight", F.lit("") if alpha else F.lit(0.0))
    else:
        by = F.col("element") if alpha else F.col("element").cast("double")
    order = [by.desc(), F.col("element").desc()] if descending else [by, F.col("element")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).where(F.col("rank") >= offset)
    if limit >= 0:
        ranked = ranked.where(F.col("rank") < offset + limit)
    ranked = ranked.select("key", "element", F.col("rank").cast("long").alias("rank"))
    return ranked if fetch is None else ranked.join(fetch, "element", "left")


def store(ranked: DataFrame, target: Column) -> DataFrame:
    """Sorted elements as lists ``(key, idx, value)`` under ``target``, which replace what the keys held."""
    return ranked.select(target.alias("key"), F.col("rank").cast("double").alias("idx"), F.col("element").alias("value"))
