"""Retrieval, extraction and scoring metrics over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_k(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query, hits, precision, recall, f1, reciprocal, average, ndcg): metrics of the first k of each query.

    ranked has query, item, position (1 is first); judged has query, item of the relevant ones. Precision divides by k
    even if fewer were retrieved. Queries without relevant items have recall, average and ndcg 0.
    """
    relevant = judged.select("query", "item").distinct().withColumn("good", F.lit(1))
    totals = relevant.groupBy("query").agg(F.count("*").alias("total"))
    return _at_k(ranked.where(F.col("position") <= k).join(relevant, ["query", "item"], "left").withColumn("good", F.coalesce("good", F.lit(0))), totals, k)


def at_k_by_label(ranked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """at_k where items (item, label) of one label are relevant for each other, a null label for none: labels are counted, no pair of items is formed."""
    known = items.where("label IS NOT NULL").select("item", "label").distinct()
    top = ranked.where(F.col("position") <= k)
    own = top.select("query").distinct().join(known.select(F.col("item").alias("query"), F.col("label").alias("own")), "query", "left")
    rows = top.join(own, "query").join(known, "item", "left").withColumn("good", F.coalesce((F.col("own") == F.col("label")).cast("int"), F.lit(0)))
    totals = own.join(known.groupBy(F.col("label").alias("own")).agg((F.count("*") - 1).alias("total")), "own").select("query", "total")
    return _at_k(rows.select(*ranked.columns, "good"), totals, k)


def _at_k(rows: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    so_far = F.sum("good").over(Window.partitionBy("query").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far)
    each = rows.groupBy("query").agg(
        F.sum("good").alias("hits"),
        F.coalesce(F.max(F.when(F.col("good") == 1, 1.0 / F.col("position"))), F.lit(0.0)).alias("reciprocal"),
        F.sum(F.when(F.col("good") == 1, F.col("so_far") / F.col("position")).otherwise(0.0)).alias("gained"),
        F.sum(F.when(F.col("good") == 1, 1.0 / F.log2(F.col("position") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    each = each.join(totals, "query", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    ideal = F.aggregate(F.when(F.col("total") > 0, F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    precision, recall = F.col("hits") / F.lit(float(k)), safe_ratio(F.col("hits"), F.col("total"))
    return each.select("query", "hits", precision.alias("precision"), recall.alias("recall"), safe_ratio(2 * precision * recall, precision + recall).alias("f1"), "reciprocal", safe_ratio(F.col("gained"), F.col("total")).alias("average"), safe_ratio(F.col("dcg"), ideal).alias("ndcg"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(rows: DataFrame, by: list[str], expected: Column, detected: Column) -> DataFrame:
    """Confusion counts and accuracy, precision, recall, f1, specificity of each group; empty ratios are 0."""
    e, d = F.coalesce(expected, F.lit(False)), F.coalesce(detected, F.lit(False))
    counts = rows.groupBy(*by).agg(F.count_if(e & d).alias("tp"), F.count_if(~e & d).alias("fp"), F.count_if(e & ~d).alias("fn"), F.count_if(~e & ~d).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return counts.select(*by, "tp", "fp", "fn", "tn", safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), safe_ratio(2 * precision * recall, precision + recall).alias("f1"), safe_ratio(tn, tn + fp).alias("specificity"))


def min_max(value: Column, window) -> Column:
    """Scaled to 0 to 1 over the window; 0.5 where all values agree."""
    low, high = F.min(value).over(window), F.max(value).over(window)
    return F.when(high == low, F.lit(0.5)).otherwise((value - low) / (high - low))


def nearest_rank(values: Column, p: float) -> Column:
    """The ceil(p n)-th smallest of a sorted array."""
    return F.element_at(values, F.greatest(F.lit(1), F.ceil(F.size(values) * p).cast("int")))
