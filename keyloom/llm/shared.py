"""Tables kept in the folder that driver and executors share.

Writing an intermediate result there cuts its lineage: an executor that is lost later takes
nothing with it, and the parts behind the table are never computed again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_KEYS = 20_000
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only a local session may go without: it gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := "file://" + tempfile.mkdtemp(prefix="keyloom-"))
    return made


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the table that reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``keep`` that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if "/keyloom/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes the shuffle files of each query that has ended, so only tables that are kept hold disk."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, facts: DataFrame, key: str, n_keys: int, salt: Column) -> DataFrame:
    """Left join one row of facts a key to many rows; null keys match each other.

    A key may own a third of all rows.  With few keys, by count, the facts are broadcast and the rows stay in
    place; otherwise both sides are salted.
    """
    facts = facts.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if n_keys <= MAX_BROADCAST_KEYS:
        return rows.join(F.broadcast(facts), same, "left").drop("_key")
    facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_row_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return rows.join(facts, same & (F.col("_row_salt") == F.col("_salt")), "left").drop("_key", "_salt", "_row_salt")


def meet(rows: DataFrame, facts: DataFrame, key: str, total: int, count: str = "_n", counted: bool = False) -> DataFrame:
    """Inner join of ``rows`` with one row of facts a key, whose ``count`` says how many of the ``total`` rows have the key.

    Keys with many rows are few: their facts are broadcast, at most ``MAX_BROADCAST_KEYS`` of them, and their rows stay
    in place.  The others meet their facts by a shuffle.  If ``facts`` is ``counted`` cheaply, because it is a table, the
    broadcast is left out where it would be empty."""
    many = F.col(count) > max(64, total // MAX_BROADCAST_KEYS)
    if counted and facts.where(many).isEmpty():
        return rows.join(facts, key).drop(count)
    hot = F.broadcast(facts.where(many))
    rest = rows.join(hot.select(key), key, "left_anti").join(facts.where(~many), key)
    return rows.join(hot, key).unionByName(rest).drop(count)


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not among those of ``gone``, with their columns; null keys are equal."""
    name = "_gone"
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return docs.join(gone.select(F.col(key).alias(name)), docs[key].eqNullSafe(F.col(name)), "left_anti")


def list_slices(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that work arrays stay small: each ends with the row that brings its first list column to
    ``most`` elements."""
    for batch in batches:
        lists = next(c for c in batch.columns if pa.types.is_list(c.type))
        upto, start = np.diff(lists.offsets.to_numpy()).cumsum(), 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most)) + 1
            yield batch.slice(start, stop - start)
            start = stop


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of ``rows`` rows at most: each ends with the row that brings its texts to ``most`` bytes."""
    upto = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)).cumsum()
    start = 0
    while start < batch.num_rows:
        stop = min(int(np.searchsorted(upto, (upto[start - 1] if start else 0) + most)) + 1, start + rows)
        yield batch.slice(start, stop - start)
        start = stop
