"""Many instants at once: every probe with the version that is valid at it, by buckets of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.sources.tables import written


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def as_of(probes: DataFrame, versions: DataFrame, key: str, at: str, valid_from: str, valid_to: str, order: str, bucket_seconds: int = 30 * 86_400) -> DataFrame:
    """probes with the columns of versions that are valid at them, nulls where none is.

    A version is valid from its start up to its end, exclusive; a null end is open, a null start is never reached. Of
    versions that have started the last counts, ties by order, and it has to be valid still. Time is cut into buckets:
    a version goes to the bucket that it starts in, and the last one of all buckets before goes to the start of each
    bucket of its key that has probes, so that a key of any size is as many groups as it has buckets, and a version that
    lasts is not copied into all of them. Columns that both tables have, but for the key, are to be renamed before.
    Probes with a null key or time get nulls.
    """
    width = bucket_seconds * 1_000_000
    own = [c for c in versions.columns if c != key]
    started = versions.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).select(key, _micros(valid_from).alias("_t"), F.struct(*own).alias("_v"), F.col(order).alias("_o"))
    started = started.withColumn("_b", F.floor(F.col("_t") / width))
    asked = probes.withColumn("_t", _micros(at)).withColumn("_b", F.floor(F.col("_t") / width))
    # the last version of each bucket, handed on to the buckets after it that have probes
    lasts = started.groupBy(key, "_b").agg(F.max(F.struct("_t", "_o", "_v")).alias("_last"))
    wanted = asked.where(F.col(key).isNotNull() & F.col("_b").isNotNull()).select(key, "_b").distinct()
    chain = lasts.join(wanted.withColumn("_asked", F.lit(True)), [key, "_b"], "full")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = chain.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).where("_asked AND _before IS NOT NULL")
    rows = started.select(key, "_b", "_t", "_o", "_v").unionByName(carried.select(key, "_b", F.col("_before._t").alias("_t"), F.col("_before._o").alias("_o"), F.col("_before._v").alias("_v")))
    kind = F.lit(0).alias("_kind")
    every = rows.select(key, "_b", "_t", kind, "_o", "_v", F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_p"))
    mine = asked.select(key, "_b", "_t", F.lit(1).alias("_kind"), F.lit(None).cast(started.schema["_o"].dataType).alias("_o"), F.lit(None).cast(started.schema["_v"].dataType).alias("_v"), F.struct(*probes.columns).alias("_p"))
    known = every.unionByName(mine.where(F.col(key).isNotNull() & F.col("_t").isNotNull()))
    w = Window.partitionBy(key, "_b").orderBy("_t", "_kind", "_o")  # a version that starts at the instant is valid at it
    found = known.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_kind = 1")
    still = F.col(f"_found.{valid_to}").isNull() | (F.unix_micros(F.col(f"_found.{valid_to}").cast("timestamp")) > F.col("_t"))
    names = [F.when(still, F.col(f"_found.{c}")).alias(c) for c in own]
    out = found.select("_p.*", *names)
    missed = asked.where(F.col(key).isNull() | F.col("_t").isNull()).select(*probes.columns, *[F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in own])
    return out.unionByName(missed)


def valid_at(versions: DataFrame, instants: DataFrame, key: str, valid_from: str, valid_to: str) -> DataFrame:
    """(at, valid, started, ended): of every instant (at), how many versions are valid at it, and have started and ended by then.

    Starts and ends are counted by instant before the shuffle, and instants look up sums of both, so that nothing is
    joined by a range. Null starts count from ever, null ends never; repeated instants are one.
    """
    starts = versions.groupBy(_micros(valid_from).alias("t")).agg(F.count("*").alias("s")).select("t", "s", F.lit(0).cast("long").alias("e"))
    ends = versions.where(F.col(valid_to).isNotNull()).groupBy(_micros(valid_to).alias("t")).agg(F.count("*").alias("e")).select("t", F.lit(0).cast("long").alias("s"), "e")
    moves = starts.unionByName(ends).groupBy("t").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    asked = instants.select("at").where("at IS NOT NULL").distinct().withColumn("t", _micros("at"))
    day = 86_400_000_000
    rows = written(moves.select("t", "s", "e", F.lit(None).cast(asked.schema["at"].dataType).alias("at")).unionByName(asked.select("t", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"), "at")).withColumn("_d", F.coalesce(F.floor(F.col("t") / day), F.lit(-(2**62)))))
    days = rows.groupBy("_d").agg(F.sum("s").alias("_s"), F.sum("e").alias("_e"))
    past = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # a row for each day
    base = days.select("_d", F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_s"), F.coalesce(F.sum("_e").over(past), F.lit(0)).alias("_e"))
    w = Window.partitionBy("_d").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({"_in": F.sum("s").over(w), "_out": F.sum("e").over(w)}).where("at IS NOT NULL").join(base, "_d")
    return summed.select("at", (F.col("_s") + F.col("_in") - F.col("_e") - F.col("_out")).alias("valid"), (F.col("_s") + F.col("_in")).alias("started"), (F.col("_e") + F.col("_out")).alias("ended"))
