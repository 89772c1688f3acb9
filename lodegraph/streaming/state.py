"""Streams with state of their own for each key: sync sessions, deletions with grace, sliding alerts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodegraph.streaming.twins import _stream, drained


def _latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The last row that a stream put out for each key."""
    rows = spark.read.parquet(path)
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_batch"), F.desc("_part")))).where("_k = 1").drop("_k", "_batch", "_part")


def sync_sessions(spark: SparkSession, path: str, key: str, failed_above: float, block: int = 4_096) -> DataFrame:
    """(key, processed, failed, checkpoint, mean_value, changes): each connector's session after a stream of its rows.

    changes is how often a session turned from good to bad or back by event_id. Rows come in no order, so the state is
    kept for each block of event ids: counters and, as a list of no more than its ids, which of them were bad. Turns are
    counted inside blocks first and between them at the end, so no task holds a connector.
    """
    bad = F.coalesce(F.col("value") > failed_above, F.lit(False))
    rows = _stream(spark, path).select(key, "event_id", "value", bad.alias("bad"), F.floor(F.col("event_id") / block).cast("long").alias("block"))
    held = rows.groupBy(key, "block").agg(
        F.count("*").alias("processed"), F.count_if("bad").alias("failed"), F.max("event_id").alias("checkpoint"), F.sum("value").alias("total"), F.count("value").alias("valued"), F.collect_list(F.struct("event_id", "bad")).alias("seen")
    )
    blocks = spark.read.parquet(drained(spark, held, "complete")).withColumn("seen", F.transform(F.array_sort("seen"), lambda r: r["bad"].cast("int")))
    inside = F.aggregate("seen", F.struct(F.lit(0).cast("long").alias("turns"), F.get("seen", F.lit(0)).alias("last")), lambda s, b: F.struct((s["turns"] + F.abs(b - s["last"])).alias("turns"), b.alias("last")))
    blocks = blocks.select(key, "block", "processed", "failed", "checkpoint", "total", "valued", F.get("seen", F.lit(0)).alias("first"), inside.alias("run"))
    before = F.coalesce(F.lag("run.last").over(Window.partitionBy(key).orderBy("block")), F.lit(0))  # a row a block
    sums = blocks.withColumn("turns", F.col("run.turns") + F.abs(F.col("first") - before)).groupBy(key)
    return sums.agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.max("checkpoint").alias("checkpoint"), (F.sum("total") / F.sum("valued")).alias("mean_value"), F.sum("turns").alias("changes"))


def deletions(spark: SparkSession, path: str, key: str, kind: str, mark: str, recover: str, grace: int) -> DataFrame:
    """(key, state, since) as rules.deletions has it, kept up by a stream: pending since when, or deleted when.

    What is there at the start is one micro-batch, so that its files may be in any order of time; a key's marks and
    recoveries of a batch are sorted together.
    """
    out = f"{key} long, pending long, gone long, seen long, _part long"

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, gone, seen, part = state.get if state.exists else (-1, -1, -1, 0)
        steps: list[tuple[int, bool]] = []
        for rows in batches:
            seen = max([seen, *rows["t"].tolist()])
            kept = rows[rows[kind].isin([mark, recover])]
            steps.extend(zip(kept["t"].tolist(), (kept[kind] == mark).tolist(), strict=True))
        part += 1
        for t, marked in sorted(steps):
            if gone < 0 <= pending and t > pending + grace * 1_000_000:
                gone = pending + grace * 1_000_000
            if gone < 0 and marked and pending < 0:
                pending = t
            elif gone < 0 and not marked:
                pending = -1
        state.update((pending, gone, seen, part))
        yield pd.DataFrame({key: [int(name[0])], "pending": [pending], "gone": [gone], "seen": [seen], "_part": [part]})

    rows = _stream(spark, path, None).select(key, kind, F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    held = rows.groupBy(key).applyInPandasWithState(update, out, "pending long, gone long, seen long, part long", "update", GroupStateTimeout.NoTimeout)
    final = _latest(spark, drained(spark, held, "update"), key)
    last = final.agg(F.max("seen").alias("last"))
    due = F.col("pending") + grace * 1_000_000
    gone = F.when(F.col("gone") >= 0, F.col("gone")).when((F.col("pending") >= 0) & (due <= F.col("last")), due)
    state = F.when(gone.isNotNull(), "deleted").when(F.col("pending") >= 0, "pending").otherwise("active")
    return final.join(F.broadcast(last)).select(key, state.alias("state"), F.timestamp_micros(F.coalesce(gone, F.when(F.col("pending") >= 0, F.col("pending")))).alias("since"))


def alerts(spark: SparkSession, path: str, user: str, kinds: list[str], least: int, window: str, late: str = "2 days") -> DataFrame:
    """(user, started, n): windows in which a user did something of kinds at least so often; a window is put out once it can't change."""
    rows = _stream(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).where(F.col("event_type").isin(kinds))
    counts = rows.groupBy(user, F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    found = spark.read.parquet(drained(spark, counts, "complete"))
    return found.select(user, F.col("w.start").alias("started"), "n")
