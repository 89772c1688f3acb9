"""Keyed tables: listing, merging, staged changes, retention, latest rows and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """base with updates laid over it by key: values that an update has win, keys that are new become rows.

    updates may have some of base's columns. Keys are unique on either side; a null value in an update changes nothing.
    """
    fresh = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in updates.columns if c != key])
    value = lambda c: F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in updates.columns else F.col(c)
    return base.join(fresh, key, "full_outer").select(key, *[value(c) for c in base.columns if c != key])


def without(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of base whose key is not among gone."""
    return base.join(gone.select(key).distinct(), key, "left_anti").select(*base.columns)


def committed(base: DataFrame, added: DataFrame, modified: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """base after a staged change set: deletions first, then modifications of what is left, then additions of unknown keys."""
    left = without(base, deleted, key)
    changed = modified.join(left.select(key), key, "left_semi")
    return merged(left, changed, key).unionByName(without(added, left, key))


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key by order, with their place."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def matching(rows: DataFrame, equal: dict | None = None, one_of: dict | None = None, since: tuple | None = None, until: tuple | None = None) -> DataFrame:
    """Rows that pass every filter given: equal values, values of a list, and a column from one instant on and before another."""
    tests = [F.col(c) == v for c, v in (equal or {}).items()] + [F.col(c).isin(list(v)) for c, v in (one_of or {}).items()]
    tests += [F.col(since[0]) >= F.lit(since[1])] if since else []
    tests += [F.col(until[0]) < F.lit(until[1])] if until else []
    return rows.where(reduce(Column.__and__, tests)) if tests else rows


def swept(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """rows with archive: whether they are older than days before the latest row; what a sweep writes away and drops."""
    last = rows.agg(F.max(ts).alias("_last"))
    return rows.join(F.broadcast(last)).withColumn("archive", F.col(ts) < F.col("_last") - F.expr(f"INTERVAL {days} DAYS")).drop("_last")


def append(rows: DataFrame, path: str, partition: str) -> None:
    """Add rows to a table of files, one folder for each value of partition; a retried task writes nothing twice."""
    rows.write.mode("append").partitionBy(partition).parquet(path)


def page(rows: DataFrame, order: list[Column], size: int = 20, number: int = 1) -> DataFrame:
    """Page number of rows in order, sizes clamped to 1..100. Spark's offset reads what it skips; deep pages want `after`."""
    size, number = min(100, max(1, size)), max(1, number)
    return rows.orderBy(*order).offset(size * (number - 1)).limit(size)


def after(rows: DataFrame, sort: str, ident: str, cursor: tuple | None, size: int = 20) -> DataFrame:
    """The size rows after a cursor (value of sort, ident), greatest first, and one more that tells whether there are more."""
    if cursor is not None:
        value, last = F.lit(cursor[0]), F.lit(cursor[1])
        rows = rows.where((F.col(sort) < value) | ((F.col(sort) == value) & (F.col(ident) < last)))
    return rows.orderBy(F.desc(sort), F.desc(ident)).limit(min(100, max(1, size)) + 1)


def envelope(rows: DataFrame, size: int = 20) -> DataFrame:
    """One row: total, pages."""
    return rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / F.lit(size)))


def archived(rows: DataFrame, ts: str, days: int, archive: str, survivors: str, dry: bool = False) -> tuple[int, int]:
    """(archived, kept): write rows older than days before the last one to archive, a folder of JSON lines a day, and the others to survivors.

    Nothing is deleted here: a table is read, two are written, and whoever reads goes on with survivors once both are
    there. A run that is repeated writes the same. Rows without a time survive. dry counts alone.
    """
    marked = swept(rows, ts, days).withColumn("archive", F.coalesce("archive", F.lit(False)))
    counts = {r.archive: r["count"] for r in marked.groupBy("archive").count().collect()}
    if not dry:
        old = marked.where("archive").drop("archive").withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
        old.repartition("day", F.pmod(F.xxhash64(F.struct(*rows.columns)), F.lit(16))).write.mode("overwrite").partitionBy("day").json(archive)  # a busy day is several files
        marked.where("NOT archive").drop("archive").write.mode("overwrite").parquet(survivors)
    return counts.get(True, 0), counts.get(False, 0)
