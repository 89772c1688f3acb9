"""Queries on events: sliding rules, latency, streaks and growth, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.operators import activity as A
from lodegraph.operators.metrics import min_max, nearest_rank
from lodegraph.operators.rules import variant
from lodegraph.plans.registry import query
from lodegraph.sources.tables import table
from lodegraph.streaming import twins


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _latency(spark, sf_dir):
    return events(spark, sf_dir).select("event_type", "ts", (F.col("value") * 10).alias("ms"))


@query("SELECT user_id, event_type, max(c) AS most, count(*) FILTER (c >= 3) AS alerts FROM (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS c FROM events) GROUP BY user_id, event_type")
def sliding_denials(spark, sf_dir):
    e = A.sliding_counts(events(spark, sf_dir), ["user_id", "event_type"], "ts", 86_400)
    return e.groupBy("user_id", "event_type").agg(F.max("in_window").alias("most"), F.count_if(F.col("in_window") >= 3).alias("alerts"))


@query(
    """WITH RECURSIVE a AS (SELECT user_id, event_type, ts FROM (SELECT user_id, event_type, ts, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND CURRENT ROW) AS c FROM events) WHERE c >= 3),
    k(user_id, event_type, ts) AS (SELECT user_id, event_type, min(ts) FROM a GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, ts FROM (SELECT k.user_id, k.event_type, min(a.ts) AS ts FROM k JOIN a ON a.user_id = k.user_id AND a.event_type = k.event_type AND a.ts >= k.ts + INTERVAL 1 DAY GROUP BY 1, 2))
    SELECT user_id, event_type, ts FROM k"""
)
def cooled_alerts(spark, sf_dir):
    """Alerts of the sliding rule, at most one a day for each user and type."""
    e = A.sliding_counts(events(spark, sf_dir), ["user_id", "event_type"], "ts", 86_400)
    return A.cooled(e.where("in_window >= 3"), ["user_id", "event_type"], "ts", 86_400).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_type, quantile_disc(value * 10, 0.5) AS p50, quantile_disc(value * 10, 0.95) AS p95, quantile_disc(value * 10, 0.99) AS p99, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    # a percentile aggregate counts equal values before the shuffle, so no list of all samples is built
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY ms)")
    return _latency(spark, sf_dir).groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.count("*").alias("n"))


@query("SELECT event_type, CASE WHEN value * 10 / 1500 > 1 THEN 'breach' WHEN value * 10 / 1500 >= 0.9 THEN 'critical' WHEN value * 10 / 1500 >= 0.7 THEN 'warning' ELSE 'ok' END AS severity, count(*) AS n FROM events GROUP BY 1, 2")
def latency_breaches(spark, sf_dir):
    return _latency(spark, sf_dir).groupBy("event_type", A.severity(F.col("ms"), F.lit(1500)).alias("severity")).agg(F.count("*").alias("n"))


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2")
def tumbling_buckets(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
    return e.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT user_id, count(*) AS n FROM events WHERE dayofweek(ts) IN (0, 6) OR hour(ts) < 6 OR hour(ts) >= 22 GROUP BY user_id")
def off_hours(spark, sf_dir):
    return events(spark, sf_dir).where(A.off_hours(F.col("ts"))).groupBy("user_id").agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM d) SELECT user_id, min(day)::VARCHAR AS started, max(day)::VARCHAR AS ended, count(*) AS days FROM i GROUP BY user_id, island")
def streaks(spark, sf_dir):
    found = A.streaks(events(spark, sf_dir), "user_id", "ts")
    return found.withColumns({c: F.col(c).cast("string") for c in ("started", "ended")})


@query("WITH p AS (SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 50 WHEN 'signup' THEN 25 ELSE 10 END)::BIGINT AS points FROM events GROUP BY user_id) SELECT user_id, points, rank() OVER (ORDER BY points DESC) AS rank FROM p ORDER BY points DESC, user_id LIMIT 10")
def leaderboard(spark, sf_dir):
    worth = F.when(F.col("event_type") == "purchase", 50).when(F.col("event_type") == "signup", 25).otherwise(10)
    top = events(spark, sf_dir).groupBy("user_id").agg(F.sum(worth).alias("points")).orderBy(F.desc("points"), "user_id").limit(10)
    return top.withColumn("rank", F.rank().over(Window.orderBy(F.desc("points"))).cast("long"))  # ten rows


@query("WITH d AS (SELECT ts::DATE AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT day::VARCHAR AS day, n, users, (sum(n) OVER (ORDER BY day))::BIGINT AS total FROM d")
def growth_daily(spark, sf_dir):
    d = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))
    return d.withColumn("total", F.sum("n").over(Window.orderBy("day"))).withColumn("day", F.col("day").cast("string"))  # a row a day


@query("WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 5 THEN '2-5' WHEN n <= 10 THEN '6-10' WHEN n <= 25 THEN '11-25' WHEN n <= 50 THEN '26-50' ELSE '50+' END AS bin, count(*) AS parts, sum(n)::BIGINT AS mentions FROM c GROUP BY 1")
def mention_histogram(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    n = F.col("n")
    band = F.when(n == 1, "1").when(n <= 5, "2-5").when(n <= 10, "6-10").when(n <= 25, "11-25").when(n <= 50, "26-50").otherwise("50+")
    return c.groupBy(band.alias("bin")).agg(F.count("*").alias("parts"), F.sum("n").alias("mentions"))


@query("SELECT c_custkey, c_mktsegment, round(CASE WHEN max(c_acctbal) OVER w = min(c_acctbal) OVER w THEN 0.5 ELSE (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) END, 6) AS scaled FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def minmax_normalize(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    ends = c.groupBy("c_mktsegment").agg(F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), 0.5).otherwise((F.col("c_acctbal") - F.col("low")) / (F.col("high") - F.col("low")))
    return c.join(ends, "c_mktsegment").select("c_custkey", "c_mktsegment", F.round(scaled, 6).alias("scaled"))


@query("SELECT CASE WHEN abs(h) % 100 < 70 THEN 'control' ELSE 'treatment' END AS variant, count(*) AS documents FROM (SELECT list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT) AS h FROM documents) GROUP BY 1")
def ab_bucket_counts(spark, sf_dir):
    """Documents in the two variants of an experiment split 70 to 30 by a stable hash."""
    d = table(spark, sf_dir, "documents").select(variant(F.col("doc_id").cast("string"), {"control": 70, "treatment": 30}).alias("variant"))
    return d.groupBy("variant").agg(F.count("*").alias("documents"))


@query("SELECT date_trunc('day', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_buckets(spark, sf_dir):
    """Daily buckets from a stream over the events table that runs until it has read all."""
    return twins.daily_buckets(spark, f"{sf_dir}/events.parquet")


@query("SELECT user_id, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def streamed_totals(spark, sf_dir):
    """Each user's running totals at the end of a stream over the events table."""
    return twins.user_totals(spark, f"{sf_dir}/events.parquet")


__all__ = ["min_max", "nearest_rank"]
