"""Percentiles over sliding windows from sketches that merge, and exact ones beside them.

A bucket of a key (a minute, say) keeps one KLL sketch and counters, whatever the number of its values; a window is a
merge of its buckets' sketches. With k = 200 the rank of an answer is within about 1.7 % of what was asked, with 99 %
confidence, and exact where a window has at most k values or so, as nothing is compacted then.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketches' size: values that a level keeps.
K = 200
#: Error of a rank with k = 200, as a share of the window's values, that holds with 99 % confidence.
RANK_ERROR = 0.017


def bucketed(rows: DataFrame, key: str, ts: str, value: str, seconds: int, budget: Column | None = None, k: int = K) -> DataFrame:
    """(key, bucket, sketch, n, breaches): one row for each key and bucket of seconds; null values and times are left out.

    bucket is the second at which it begins. breaches counts the values above budget. Rows of a bucket are combined
    before the shuffle, so a hot key costs a sketch a task.
    """
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 / seconds).cast("long") * seconds
    kept = rows.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    over = F.count_if(F.col(value) > budget) if budget is not None else F.lit(0).cast("long")
    return kept.groupBy(key, at.alias("bucket")).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count("*").alias("n"), over.alias("breaches"))


def sliding(buckets: DataFrame, key: str, seconds: int, window: int, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(key, ends, n, breaches, breach_rate, p50, p95, ...): every window of so many buckets that holds a value, by the second where it ends."""
    ends = F.explode(F.sequence(F.col("bucket") + seconds, F.col("bucket") + window * seconds, F.lit(seconds)))
    spread = buckets.select(key, ends.alias("ends"), "sketch", "n", "breaches")
    merged = spread.groupBy(key, "ends").agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.sum("breaches").alias("breaches"))
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(f"p{p * 100:g}".replace(".", "_")) for p in shares]
    return merged.select(key, "ends", "n", "breaches", (F.col("breaches") / F.col("n")).alias("breach_rate"), *named)


def counted(rows: DataFrame, key: str, ts: str, value: str, seconds: int) -> DataFrame:
    """(key, bucket, v, c): how often each value comes in each bucket; null values and times are left out, equal values combined before the shuffle."""
    at = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 / seconds).cast("long") * seconds
    kept = rows.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    return kept.groupBy(key, at.alias("bucket"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))


def sliding_counted(counts: DataFrame, key: str, seconds: int, window: int, shares: tuple[float, ...] = (0.5, 0.95, 0.99), budget: float = float("inf")) -> DataFrame:
    """(key, ends, n, breaches, breach_rate, p50, p95, ...) by nearest rank: every window of so many buckets that holds a value, of rows as counted has them.

    The values of a window are sorted and added up by a window function, which spills, so none is gathered in one row.
    Ranks are decimals: no share is rounded.
    """
    spread = counts.select(key, F.explode(F.sequence(F.col("bucket") + seconds, F.col("bucket") + window * seconds, F.lit(seconds))).alias("ends"), "v", "c")
    own = Window.partitionBy(key, "ends")
    seen = spread.groupBy(key, "ends", "v").agg(F.sum("c").alias("c"))
    seen = seen.withColumn("n", F.sum("c").over(own)).withColumn("seen", F.sum("c").over(own.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    at_rank = [F.min(F.when(F.col("seen") >= F.ceil(F.col("n") * F.lit(Decimal(str(p)))), F.col("v"))).alias(f"p{p * 100:g}".replace(".", "_")) for p in shares]
    found = seen.groupBy(key, "ends").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("v") > budget, F.col("c")).otherwise(0)).alias("breaches"), *at_rank)
    return found.withColumn("breach_rate", F.col("breaches") / F.col("n"))


def sliding_exact(rows: DataFrame, key: str, ts: str, value: str, seconds: int, window: int, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """(key, ends, n, p50, p95, ...) by nearest rank over the values themselves: the path for keys that need no error."""
    return sliding_counted(counted(rows, key, ts, value, seconds), key, seconds, window, shares).drop("breaches", "breach_rate")
