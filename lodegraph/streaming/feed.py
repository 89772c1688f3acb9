"""Points from a change feed that delivers at least once: repeats are dropped by the watermark, batches counted by their number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.sources.tables import scratch_path

# fixed values: points of a state that a document is seen in
POINTS = {"approved": 50, "uploaded": 10, "processing": 10}


def worth(status: Column) -> Column:
    """The points of a status; 0 for any other."""
    found = F.lit(0)
    for name, points in POINTS.items():
        found = F.when(status == name, points).otherwise(found)
    return found


class BatchTotals:
    """Points by user under path, a folder for each batch of the feed.

    A batch that is delivered again, after a restart from a checkpoint, overwrites its own folder, so it counts once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __call__(self, batch: DataFrame, number: int) -> None:
        scored = batch.withColumn("points", worth(F.col("status"))).where("points > 0 AND user IS NOT NULL AND user <> 'unknown'")
        sums = scored.groupBy("user").agg(F.sum("points").cast("long").alias("points"), F.count("*").alias("actions"))
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def totals(self) -> DataFrame:
        """(user, points, actions) over all batches."""
        at, schema = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path), "user string, points long, actions long, batch int"
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)  # no rows, no batch
        rows = self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)
        return rows.groupBy("user").agg(F.sum("points").alias("points"), F.sum("actions").alias("actions"))


def fed(feed: DataFrame, keys: list[str], late: str, path: str, checkpoint: str) -> BatchTotals:
    """Run a feed (status, user, ts and keys) until its source is empty, or on from its checkpoint.

    Rows that agree in keys are one action if they come within late of each other by ts; a row that is later than that
    behind the watermark is dropped, as it may repeat one that is forgotten.
    """
    once = feed.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
    sink = BatchTotals(feed.sparkSession, path)
    query = once.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sink


def points_of(feed: DataFrame, keys: list[str], late: str = "30 days") -> DataFrame:
    """(user, points, actions) of a bounded feed."""
    spark = feed.sparkSession
    return fed(feed, keys, late, scratch_path(spark), scratch_path(spark)).totals()
