"""Delta syncs of sources into a table, with their offsets: a run either counts whole, rows and offsets together, or not at all.

A run reads what lies beyond the offsets of the last committed version, writes rows and new offsets as tables of their
own, and commits a version that names both. Readers follow the log alone, so what a killed run has written is never
seen, and the next run reads the same items again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodegraph.sources.commits import CommitLog

_STATES = "source string, offset long, last_sync timestamp, found long, added long, modified long, deleted long, runs long"


class DeltaTable:
    """The rows of all sources under path, as committed runs have left them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, CommitLog(spark, f"{path}/commits")

    def states(self, version: int | None = None) -> DataFrame:
        """(source, offset, last_sync, found, added, modified, deleted, runs) of every source, as of a version."""
        found = version if version is not None else self.log.latest()[0]
        if not found:
            return self.spark.createDataFrame([], _STATES)
        return self.spark.read.schema(_STATES).parquet(f"{self.path}/{self.log.read(found)['states']}")

    def sync(self, items: DataFrame, full: bool = False) -> int:
        """Take up what is new in items and commit it; the version, or that of the run before where nothing is new.

        items has source, id, seq (the source's offset, ascending), created and modified (timestamps), gone and folder
        (booleans), and columns to keep. Of an item's changes since the last run the last counts, ties by nothing else.
        A change is deleted, or added where the source is new or the item was created after its last sync, and else
        modified; folders are passed over, though their offsets count. With full, offsets are forgotten and every
        item is read again. Null sources, ids and offsets are left out.
        """
        before, content = self.log.latest()
        known = self.states(before).select("source", F.col("offset").alias("_offset"), F.col("last_sync").alias("_last"))
        known = known.limit(0) if full else known
        fresh = items.where("source IS NOT NULL AND id IS NOT NULL AND seq IS NOT NULL").join(known, "source", "left").where(F.col("_offset").isNull() | (F.col("seq") > F.col("_offset")))
        kept = [c for c in items.columns if c not in ("source", "id", "seq", "folder")]
        last = fresh.where(~F.coalesce("folder", F.lit(False))).groupBy("source", "id").agg(F.max(F.struct("seq", "_last", *kept)).alias("r")).select("source", "id", "r.*")
        change = F.when(F.coalesce("gone", F.lit(False)), "deleted").when(F.col("_last").isNull() | (F.col("created") > F.col("_last")), "added").otherwise("modified")
        run = uuid.uuid4().hex
        kind = "full" if full else "delta"
        last.withColumn("change", change).drop("_last").withColumns({"version": F.lit(before + 1), "kind": F.lit(kind)}).write.parquet(f"{self.path}/rows/{run}")
        rows = self.spark.read.parquet(f"{self.path}/rows/{run}")
        count = lambda kind: F.count_if(F.col("change") == kind).alias(kind)
        counts = rows.groupBy("source").agg(count("added"), count("modified"), count("deleted"))
        moved = fresh.groupBy("source").agg(F.max("seq").alias("_seq"), F.max("modified").alias("_time"), F.count("*").alias("_found")).join(counts, "source", "left")
        zero = lambda *c: reduce(lambda x, y: x + y, [F.coalesce(v, F.lit(0)) for v in c]).cast("long")
        old = self.states(before).withColumnsRenamed({c: f"o_{c}" for c in ("offset", "last_sync", "found", "added", "modified", "deleted", "runs")})
        states = old.join(moved, "source", "full").select(
            "source", F.coalesce("_seq", "o_offset").alias("offset"), F.greatest("_time", "o_last_sync").alias("last_sync"), zero("o_found", "_found").alias("found"), zero("o_added", "added").alias("added"),
            zero("o_modified", "modified").alias("modified"), zero("o_deleted", "deleted").alias("deleted"), (zero("o_runs") + F.col("_seq").isNotNull().cast("long")).alias("runs"),
        )
        if not moved.take(1):
            return before
        states.write.parquet(f"{self.path}/states/{run}")
        self.log.commit(before + 1, {"rows": f"rows/{run}", "states": f"states/{run}", "kind": kind})
        return before + 1

    def changes(self, since: int = 0, until: int | None = None) -> DataFrame | None:
        """All rows of the versions after since up to until, with version and kind; None where there are none."""
        paths = [self.log.read(v)["rows"] for v in self.log.versions() if v > since and (until is None or v <= until)]
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{p}" for p in paths]) if paths else None

    def current(self, until: int | None = None) -> DataFrame | None:
        """The last row of each item that is not deleted, as of a version; a full run stands for all before it of its sources."""
        rows = self.changes(0, until)
        if rows is None:
            return None
        full = rows.where("kind = 'full'").groupBy("source").agg(F.max("version").alias("_full"))
        live = rows.join(full, "source", "left").where(F.col("version") >= F.coalesce("_full", F.lit(0)))
        w = Window.partitionBy("source", "id").orderBy(F.desc("version"))
        return live.withColumn("_k", F.row_number().over(w)).where("_k = 1 AND change <> 'deleted'").drop("_k", "_full", "kind")

    def reprocess(self, ids: DataFrame, again) -> int:
        """Replace the rows of ids (source, id) by again(their current rows), in one version; offsets stay."""
        before, content = self.log.latest()
        rows = self.current()
        if rows is None:
            return before
        run = uuid.uuid4().hex
        made = again(rows.join(ids.select("source", "id").distinct(), ["source", "id"], "left_semi").drop("version"))
        made.withColumns({"change": F.lit("modified"), "version": F.lit(before + 1), "kind": F.lit("reprocess")}).write.parquet(f"{self.path}/rows/{run}")
        self.log.commit(before + 1, {"rows": f"rows/{run}", "states": content["states"], "kind": "reprocess"})
        return before + 1
