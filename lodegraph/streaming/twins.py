"""Structured Streaming twins of batch queries: bounded streams over a table's files, drained with AvailableNow."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.tables import shared_folder


def _stream(spark: SparkSession, path: str, at_once: int | None = 16) -> DataFrame:
    """The files of a parquet table as a stream, at_once files a micro-batch; of a table that is one file, its folder is read and others passed over.

    at_once None takes all that is there as one batch: for states that follow from the order of rows, as the files of a
    table come in no order.
    """
    schema = spark.read.parquet(path).schema
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        rows = spark.readStream.schema(schema)
        return (rows.option("maxFilesPerTrigger", at_once) if at_once else rows).parquet(path)
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drained(spark: SparkSession, rows: DataFrame, mode: str) -> str:
    """Run a stream until its source is empty; the folder that holds the last result, or of update and append modes every batch's."""
    base = f"{shared_folder(spark)}/lodegraph-stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    stream = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    stream.awaitTermination()
    return out


def daily_buckets(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, event_type, n, total): tumbling days in event time, late events within two days still counted."""
    events = _stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    days = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    out = spark.read.parquet(drained(spark, days, "complete"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("total", 4).alias("total"))


def user_totals(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, events, total): keyed running totals, the last state of each user."""
    totals = _stream(spark, path).groupBy("user_id").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    out = spark.read.parquet(drained(spark, totals, "complete"))
    return out.select("user_id", "events", F.round("total", 4).alias("total"))
