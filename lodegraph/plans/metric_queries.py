"""Queries that compute retrieval, extraction and trend metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.operators import metrics as M
from lodegraph.plans.registry import query
from lodegraph.plans.vector_queries import _TOP, neighbours
from lodegraph.sources.tables import table


def _measured(spark, sf_dir):
    """Relevant items of a query are the vectors that share its label, without itself."""
    items = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item"), "label")
    return M.at_k_by_label(neighbours(spark, sf_dir), items, 10)


_METRICS = f"""WITH {_TOP}, g AS (SELECT query, count(*) FILTER (same) AS total FROM p GROUP BY query), h AS (SELECT query, item, position, same, sum(same::INT) OVER (PARTITION BY query ORDER BY position) AS so_far FROM t WHERE position <= 10),
  m AS (SELECT query, sum(same::INT)::BIGINT AS hits, coalesce(max(1.0 / position) FILTER (same), 0) AS reciprocal, coalesce(sum(so_far::DOUBLE / position) FILTER (same), 0) AS gained, coalesce(sum(1.0 / log2(position + 1)) FILTER (same), 0) AS dcg FROM h GROUP BY query)"""


@query(f"{_METRICS} SELECT query, hits, round(hits / 10.0, 6) AS precision, round(CASE WHEN total > 0 THEN hits::DOUBLE / total ELSE 0 END, 6) AS recall FROM m JOIN g USING (query)")
def precision_recall_at_k(spark, sf_dir):
    got = _measured(spark, sf_dir)
    return got.select("query", "hits", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"{_METRICS} SELECT round(avg(reciprocal), 6) AS mrr, round(avg(CASE WHEN total > 0 THEN gained / total ELSE 0 END), 6) AS map FROM m JOIN g USING (query)")
def mrr_map(spark, sf_dir):
    got = _measured(spark, sf_dir)
    return got.agg(F.round(F.avg("reciprocal"), 6).alias("mrr"), F.round(F.avg("average"), 6).alias("map"))


@query(f"{_METRICS} SELECT query, round(CASE WHEN total > 0 THEN dcg / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1.0 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM m JOIN g USING (query)")
def ndcg_at_k(spark, sf_dir):
    return _measured(spark, sf_dir).select("query", F.round("ndcg", 6).alias("ndcg"))


@query(
    """WITH x AS (SELECT lang, toxic = 1 AS e, text ILIKE '%idiot%' OR text ILIKE '%scum%' OR text ILIKE '%moron%' AS d FROM documents JOIN labels USING (doc_id)),
    c AS (SELECT lang, count(*) FILTER (e AND d) AS tp, count(*) FILTER (NOT e AND d) AS fp, count(*) FILTER (e AND NOT d) AS fn, count(*) FILTER (NOT e AND NOT d) AS tn FROM x GROUP BY lang)
    SELECT lang, tp, fp, fn, tn, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END, 6) AS recall,
    round(CASE WHEN 2 * tp + fp + fn > 0 AND tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END, 6) AS specificity FROM c"""
)
def micro_macro_f1(spark, sf_dir):
    """Confusion of a word-list detector against labels, for each language."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    got = M.confusion(rows, ["lang"], F.col("toxic") == 1, F.lower("text").rlike("idiot|scum|moron"))
    return got.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "specificity")})


@query("SELECT o_orderpriority, round(avg(w), 6) AS score, round(sum(w * c) / sum(c), 6) AS weighted, count(*) AS n FROM (SELECT o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.5 ELSE 0.0 END AS w, (o_orderkey % 10 + 1) / 10.0 AS c FROM orders) GROUP BY 1")
def score_weighted_mean(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.5).otherwise(0.0)
    rows = o.select("o_orderpriority", w.alias("w"), ((F.col("o_orderkey") % 10 + 1) / 10.0).alias("c"))
    return rows.groupBy("o_orderpriority").agg(F.round(F.avg("w"), 6).alias("score"), F.round(F.sum(F.col("w") * F.col("c")) / F.sum("c"), 6).alias("weighted"), F.count("*").alias("n"))


_DAILY = "d AS (SELECT event_type, ts::DATE AS day, avg(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS back FROM d)"


@query(
    f"""WITH {_DAILY}, s AS (SELECT event_type, avg(v) FILTER (back <= 3) AS recent, avg(v) FILTER (back BETWEEN 4 AND 6) AS prior, stddev_pop(v) AS sd, count(*) AS days FROM r GROUP BY 1)
    SELECT event_type, days, round(recent - prior, 4) AS diff, CASE WHEN days < 6 THEN 'insufficient' WHEN recent - prior > 0.5 * sd THEN 'improving' WHEN recent - prior < -0.5 * sd THEN 'degrading' ELSE 'stable' END AS trend FROM s"""
)
def metric_trend(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    r = e.withColumn("back", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day"))))
    s = r.groupBy("event_type").agg(F.avg(F.when(F.col("back") <= 3, F.col("v"))).alias("recent"), F.avg(F.when(F.col("back").between(4, 6), F.col("v"))).alias("prior"), F.stddev_pop("v").alias("sd"), F.count("*").alias("days"))
    diff = F.col("recent") - F.col("prior")
    trend = F.when(F.col("days") < 6, "insufficient").when(diff > 0.5 * F.col("sd"), "improving").when(diff < -0.5 * F.col("sd"), "degrading").otherwise("stable")
    return s.select("event_type", "days", F.round(diff, 4).alias("diff"), trend.alias("trend"))


@query(
    """WITH a AS (SELECT l_returnflag AS metric, avg(l_discount) AS v FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_returnflag AS metric, avg(l_discount) AS v FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
    SELECT metric, round(b.v - a.v, 6) AS diff, CASE WHEN b.v - a.v > 0.05 THEN 'improved' WHEN b.v - a.v < -0.05 THEN 'regressed' ELSE 'unchanged' END AS verdict FROM a JOIN b USING (metric)"""
)
def compare_runs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.avg(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount"))).alias("a"), F.avg(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_discount"))).alias("b"))
    diff = F.col("b") - F.col("a")
    return rows.where("a IS NOT NULL AND b IS NOT NULL").select("metric", F.round(diff, 6).alias("diff"), F.when(diff > 0.05, "improved").when(diff < -0.05, "regressed").otherwise("unchanged").alias("verdict"))
