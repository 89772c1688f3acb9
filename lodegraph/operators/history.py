"""Graphs and entities at a point in time, new versions, and checks of temporal fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.ranking import best_of
from lodegraph.operators.temporal import valid_closed


def snapshot(entities: DataFrame, edges: DataFrame, at: Column, ident: str = "id") -> tuple[DataFrame, DataFrame]:
    """Entities valid at an instant, and the edges made until then that lead from one of them to another, one for each src, type, dst."""
    alive = entities.where(valid_closed(F.col("valid_from"), F.col("valid_to"), at))
    ids = alive.select(ident).distinct()
    known = edges.where(F.coalesce(F.col("created_at") <= at, F.lit(True)))
    known = known.join(ids.withColumnRenamed(ident, "src"), "src", "left_semi").join(ids.withColumnRenamed(ident, "dst"), "dst", "left_semi")
    return alive, known.dropDuplicates(["src", "type", "dst"])


def neighbours_at(edges: DataFrame, at: Column, most: int = 20) -> DataFrame:
    """(id, way, neighbour, place): the most recent neighbours of every vertex along edges valid at an instant, most for either way."""
    alive = edges.where(valid_closed(F.col("valid_from"), F.col("valid_to"), at))
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit("out").alias("way"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("id"), F.lit("in").alias("way"), F.col("src").alias("neighbour")))
    both = alive.select("valid_from", F.explode(ends).alias("x")).select("x.*", "valid_from")
    return best_of(both, ["id", "way"], most, [F.desc("valid_from"), F.col("neighbour")], F.struct("neighbour", "valid_from")).drop("valid_from")


def with_new_versions(rows: DataFrame, updates: DataFrame, key: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, edges) after a new version of each updated entity: the open one is closed at the instant, the new one opened.

    rows: key, version_id, version_sequence, valid_from, valid_to, supersedes, superseded_by and further columns, which
    updates may replace. An entity without an open version starts at 1. edges: (src, dst, type) SUPERSEDED_BY.
    """
    open_ = rows.where("valid_to IS NULL")
    values = [c for c in updates.columns if c not in (key, "version_id")]
    fresh = updates.select(key, F.col("version_id").alias("_new"), *[F.col(c).alias(f"_{c}") for c in values])
    made = fresh.join(open_, key, "left").select(
        key, F.col("_new").alias("version_id"), (F.coalesce("version_sequence", F.lit(0)) + 1).alias("version_sequence"), at.alias("valid_from"), F.lit(None).cast(dict(rows.dtypes)["valid_to"]).alias("valid_to"),
        F.col("version_id").alias("supersedes"), F.lit(None).cast(dict(rows.dtypes)["superseded_by"]).alias("superseded_by"), *[F.coalesce(f"_{c}", c).alias(c) for c in values],
        *[c for c in rows.columns if c not in (key, "version_id", "version_sequence", "valid_from", "valid_to", "supersedes", "superseded_by", *values)],
    )
    closed = rows.join(fresh.select(key, "_new"), key, "left")
    hit = F.col("_new").isNotNull() & F.col("valid_to").isNull()
    closed = closed.withColumns({"valid_to": F.when(hit, at).otherwise(F.col("valid_to")), "superseded_by": F.when(hit, F.col("_new")).otherwise(F.col("superseded_by"))}).drop("_new")
    edges = made.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("src"), F.col("version_id").alias("dst"), F.lit("SUPERSEDED_BY").alias("type"))
    return closed.select(*rows.columns).unionByName(made.select(*rows.columns)), edges


# fixed values: what a temporal status may be
STATUSES = ("current", "expired", "pending", "superseded")
_ISO = "^\\d{4}-\\d{2}-\\d{2}(T\\d{2}:\\d{2}(:\\d{2}(\\.\\d+)?)?(Z|[+-]\\d{2}:?\\d{2})?)?$"


def field_errors(valid_from: Column, valid_to: Column, status: Column, sequence: Column) -> Column:
    """What is wrong with temporal fields given as texts: array of codes; missing ones are right."""
    a, b = F.try_to_timestamp(valid_from), F.try_to_timestamp(valid_to)
    bad = lambda text, at: text.isNotNull() & (~text.rlike(_ISO) | at.isNull())
    tests = {"valid_from": bad(valid_from, a), "valid_to": bad(valid_to, b), "order": F.coalesce(a >= b, F.lit(False)), "status": status.isNotNull() & ~status.isin(*STATUSES), "sequence": F.coalesce(sequence < 1, F.lit(False))}
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def duration(valid_from: Column, valid_to: Column) -> Column:
    """struct(ms, days, open): how long a validity lasts, in whole days too; open without an end."""
    ms = F.unix_millis(valid_to.cast("timestamp")) - F.unix_millis(valid_from.cast("timestamp"))
    return F.struct(ms.alias("ms"), F.floor(ms / 86_400_000).alias("days"), valid_to.isNull().alias("open"))


def change(source: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, change, reason): a later mtime, then another hash, size or version makes a row modified; missing values tell nothing.

    Both have key, mtime, hash, size and version.
    """
    cols = ("mtime", "hash", "size", "version")
    a = source.select(key, *[F.col(c).alias(f"s_{c}") for c in cols], F.lit(True).alias("s_"))
    b = existing.select(key, *[F.col(c).alias(f"e_{c}") for c in cols], F.lit(True).alias("e_"))
    reason = F.when(F.col("e_").isNull(), "new").when(F.col("s_").isNull(), "missing").when(F.col("s_mtime") > F.col("e_mtime"), "mtime")
    for c in cols[1:]:
        reason = reason.when(F.col(f"s_{c}") != F.col(f"e_{c}"), c)
    both = a.join(b, key, "full_outer").select(key, reason.otherwise("same").alias("reason"))
    what = F.when(F.col("reason") == "new", "added").when(F.col("reason") == "missing", "deleted").when(F.col("reason") == "same", "unchanged").otherwise("modified")
    return both.withColumn("change", what)
