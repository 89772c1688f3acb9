"""Reading the driver tables, and scratch tables that every executor can see."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under sf_dir, read by Spark alone so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the one that the cluster names in spark.checkpoint.dir, or in the warehouse where it is unset.

    A warehouse on a machine's own disk is taken only where the master is local: elsewhere it raises. The folder is
    deleted when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        named = spark.conf.get("spark.checkpoint.dir", None)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{named or spark.conf.get('spark.sql.warehouse.dir')}/lodegraph-{uuid.uuid4().hex}")
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not named and files.getScheme() == "file" and not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share: the warehouse is a local one")
        files.mkdirs(path)
        files.deleteOnExit(path)
        _FOLDERS[app] = path.toString()
    return _FOLDERS[app]


def forget(spark: SparkSession) -> None:
    """Delete all scratch tables of this application so far; DataFrames that read them can't be used after it."""
    if folder := _FOLDERS.pop(spark.sparkContext.applicationId, None):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def drop(frame: DataFrame) -> None:
    """Delete the files of a scratch table whose last reader is done; other files are left alone."""
    spark = frame.sparkSession
    for name in {f.rpartition("/")[0] for f in frame.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        if "/lodegraph-" in name:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted as soon as it is done, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(frame: DataFrame, partitions: int | None = None) -> DataFrame:
    """frame written once to the shared folder and read back: lineage ends there and lost executors cost nothing."""
    spark = frame.sparkSession
    path = scratch_path(spark)
    with _shuffles_freed(spark):
        (frame.coalesce(partitions) if partitions else frame).write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def bucketed(frame: DataFrame, key: str) -> DataFrame:
    """frame written once to the shared folder in buckets of key, so that none of many joins by key shuffles or sorts it again.

    There are as many buckets as the session has shuffle partitions; the table's name is forgotten with the session.
    """
    spark = frame.sparkSession
    name, buckets = f"lodegraph_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _shuffles_freed(spark):
        frame.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark)).saveAsTable(name)
    return spark.table(name)
