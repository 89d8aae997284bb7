"""Running a stream over a folder of Parquet files into a Parquet table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared one.  Only a local session may go without that."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="keyloom-")
    return f"{base.rstrip('/')}/keyloom/{label}-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{folder}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def run_to_end(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Writes the stream's rows; in other modes than append the last version of the whole result."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession, label)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
