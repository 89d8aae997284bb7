"""Spark sessions for this library."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "keyloom", **conf: str) -> SparkSession:
    """A session with the settings the operators expect: UTC, ANSI arithmetic, adaptive execution."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for operators that run Python there."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="keyloom-"), "keyloom")
        context.addPyFile(shutil.make_archive(target, "zip", os.path.dirname(here), os.path.basename(here)))
        _shipped.add(context.applicationId)
