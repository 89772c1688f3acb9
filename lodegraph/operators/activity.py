"""Event-time activity: sliding thresholds, cooldowns, tumbling buckets, budgets and streaks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(events: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """events with in_window: events of the same key in (ts - seconds, ts], later ones at the same instant included."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(*key).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("in_window", F.count("*").over(w))


def cooled(alerts: DataFrame, key: list[str], ts: str, seconds: int) -> DataFrame:
    """Alerts that are not within seconds of the last one kept for their key.

    A gap of seconds or more always starts anew, so a key falls into runs that are folded apart; a task streams through
    its sorted runs and remembers the last instant that it kept.
    """
    micros = seconds * 1_000_000
    rows = alerts.select(*key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"))
    w = Window.partitionBy(*key).orderBy("_at")
    fresh = F.coalesce(F.col("_at") - F.lag("_at").over(w) >= micros, F.lit(True))
    runs = rows.withColumn("_fresh", fresh.cast("long")).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")
    runs = runs.withColumn("_name", F.xxhash64(*key, "_run")).repartition("_name").sortWithinPartitions("_name", "_run", *key, "_at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = None, 0
        for batch in batches:
            keep = []
            for run, at in zip(zip(*[batch.column(c).to_pylist() for c in (*key, "_run")], strict=True), batch.column("_at").to_pylist(), strict=True):
                kept = run != name or at - last >= micros
                if kept:
                    name, last = run, at
                keep.append(kept)
            yield batch.filter(pa.array(keep, type=pa.bool_())).select([*key, "_at"])

    schema = runs.select(*key, "_at").schema
    return runs.mapInArrow(fold, schema).select(*key, F.timestamp_micros("_at").alias(ts))


def severity(value: Column, budget: Column, warning: float = 0.7, critical: float = 0.9) -> Column:
    """breach above the budget, critical or warning from their share of it on, else ok."""
    ratio = value / budget
    return F.when(ratio > 1.0, "breach").when(ratio >= critical, "critical").when(ratio >= warning, "warning").otherwise("ok")


def off_hours(ts: Column, first: int = 6, last: int = 22) -> Column:
    """Saturday, Sunday, or an hour outside [first, last) in the session time zone."""
    return F.dayofweek(ts).isin(1, 7) | (F.hour(ts) < first) | (F.hour(ts) >= last)


def streaks(events: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, started, ended, days): runs of consecutive days with an event."""
    days = events.select(key, F.to_date(ts).alias("day")).distinct()
    w = Window.partitionBy(key).orderBy("day")
    days = days.withColumn("island", F.date_sub("day", F.row_number().over(w)))
    return days.groupBy(key, "island").agg(F.min("day").alias("started"), F.max("day").alias("ended"), F.count("*").alias("days")).drop("island")
