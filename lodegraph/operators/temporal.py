"""Valid-time rows: status, points in time, version chains and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status(valid_from: Column, valid_to: Column, superseded_by: Column, at: Column) -> Column:
    """superseded, else pending, else expired, else current."""
    return F.when(superseded_by.isNotNull(), "superseded").when(valid_from > at, "pending").when(valid_to < at, "expired").otherwise("current")


def valid_closed(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Whether at is in [from, to]; a missing end is open."""
    return (F.coalesce(valid_from <= at, F.lit(True))) & (F.coalesce(valid_to >= at, F.lit(True)))


def valid_half_open(valid_from: Column, valid_to: Column, at: Column) -> Column:
    """Whether at is in [from, to); a missing end is open."""
    return (F.coalesce(valid_from <= at, F.lit(True))) & (F.coalesce(valid_to > at, F.lit(True)))


def versions(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows as a chain for each key: version_sequence, valid_from, valid_to, supersedes and superseded_by.

    order starts with the instant; its last column names a version.
    """
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select(
        "*", F.row_number().over(w).alias("version_sequence"), F.col(order[0]).alias("valid_from"), F.lead(order[0]).over(w).alias("valid_to"),
        F.lag(order[-1]).over(w).alias("supersedes"), F.lead(order[-1]).over(w).alias("superseded_by"),
    )


def chain_faults(chains: DataFrame, key: str, ident: str, sequence: str = "version_sequence") -> DataFrame:
    """(key, versions, bad_sequence, bad_link, bad_time, open_before_last): faults of neighbours in each chain.

    Rows follow each other by version_sequence; sequence is the column that should grow.
    """
    w = Window.partitionBy(key).orderBy("version_sequence")
    prior = {c: F.lag(c).over(w) for c in {sequence, ident, "valid_from", "valid_to"}}
    rows = chains.select(
        key, (prior[sequence] >= F.col(sequence)).alias("s"), (prior[ident] != F.col("supersedes")).alias("l"),
        (prior["valid_from"] > F.col("valid_from")).alias("t"), (prior[sequence].isNotNull() & prior["valid_to"].isNull()).alias("o"),
    )
    return rows.groupBy(key).agg(F.count("*").alias("versions"), *[F.count_if(c).alias(n) for c, n in (("s", "bad_sequence"), ("l", "bad_link"), ("t", "bad_time"), ("o", "open_before_last"))])


def compare(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or persisted between two snapshots."""
    a, b = one.select(key).distinct().withColumn("_a", F.lit(True)), other.select(key).distinct().withColumn("_b", F.lit(True))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("persisted")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def detect_changes(source: DataFrame, existing: DataFrame, key: str, checks: list[tuple[str, str]]) -> DataFrame:
    """(key, change, reason) of source against existing: added, deleted, modified with the first check that differs, unchanged.

    checks: (column, reason) in the order in which they are asked.
    """
    cols = [c for c, _ in checks]
    a = source.select(key, *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_s"))
    b = existing.select(key, *[F.col(c).alias(f"_e_{c}") for c in cols], F.lit(True).alias("_e"))
    reason = F.when(F.col("_e").isNull(), "new").when(F.col("_s").isNull(), "missing")
    for c, name in checks:
        reason = reason.when(~F.col(f"_s_{c}").eqNullSafe(F.col(f"_e_{c}")), name)
    both = a.join(b, key, "full_outer").withColumn("reason", reason.otherwise("same"))
    change = F.when(F.col("reason") == "new", "added").when(F.col("reason") == "missing", "deleted").when(F.col("reason") == "same", "unchanged").otherwise("modified")
    return both.select(key, change.alias("change"), "reason")
