"""Queries that apply activity rules, award points and summarise health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.operators import breaker as B
from lodegraph.operators import rules as R
from lodegraph.plans.activity_queries import events
from lodegraph.plans.registry import query
from lodegraph.sources.tables import table
from lodegraph.streaming import state as T
from lodegraph.streaming.breakers import breakers

#: The events table has hours where a server log has minutes, so windows are so many times as long, and other kinds.
_STRETCH = 1_440
_KINDS = {"denied": "error", "query": "view", "document": "click", "auth_failure": "signup", "rate_violation": "purchase"}
RULES = tuple(R.Rule(r.name, tuple(_KINDS[k] for k in r.kinds), r.threshold if r.amount is None else 500, r.seconds * _STRETCH, None if r.amount is None else "value") for r in R.RULES)


def _rule_sql(rule: R.Rule) -> str:
    what = "count(*)" if rule.amount is None else f"sum({rule.amount})"
    kinds = " WHERE event_type IN (" + ", ".join(f"'{k}'" for k in rule.kinds) + ")" if rule.kinds else ""
    frame = f"OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN to_microseconds({rule.seconds * 1_000_000 - 1}) PRECEDING AND CURRENT ROW)"
    return f"SELECT user_id, '{rule.name}' AS rule, round(max(n)::DOUBLE, 4) AS most, count(*) FILTER (n >= {rule.threshold}) AS alerts FROM (SELECT user_id, {what} {frame} AS n FROM events{kinds}) GROUP BY user_id"


@query(" UNION ALL ".join(map(_rule_sql, RULES)))
def activity_rules(spark, sf_dir):
    """Every user under every rule."""
    return R.broken(events(spark, sf_dir), RULES, "user_id", "event_type", "ts").withColumn("most", F.round("most", 4))


@query(
    """WITH r AS (SELECT user_id, count(*) AS denials FROM events, (SELECT max(ts) AS last FROM events WHERE event_type = 'error') WHERE event_type = 'error' AND ts >= last - INTERVAL 480 HOUR GROUP BY user_id HAVING count(*) >= 2)
    SELECT user_id, denials, CASE WHEN denials >= 25 THEN 'critical' WHEN denials >= 15 THEN 'high' ELSE 'medium' END AS severity FROM r"""
)
def repeat_offenders(spark, sf_dir):
    return R.repeat_offenders(events(spark, sf_dir).where("event_type = 'error'"), "user_id", "ts", 480, 2)


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS opened, count(*) AS calls, count(*) FILTER (value > 60) AS failures FROM events GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) FILTER (value > 60) >= 0.5 * count(*)")
def breaker_openings(spark, sf_dir):
    """Six-hour windows in which half of a type's calls took too long."""
    found = R.breaker(events(spark, sf_dir), "event_type", "ts", F.col("value") > 60, 6 * 3600, 3)
    return found.withColumn("opened", F.col("opened").cast("timestamp_ntz"))


@query(
    """SELECT date_trunc('hour', ts) AS bucket, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) / 3600.0, 9) AS per_second,
    CASE WHEN count(*) FILTER (event_type = 'error') >= 0.2 * count(*) THEN 'unhealthy' WHEN count(*) FILTER (event_type = 'error') >= 0.05 * count(*) THEN 'degraded' ELSE 'healthy' END AS health FROM events GROUP BY 1"""
)
def throughput(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return e.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "requests", "errors", F.round(F.col("requests") / 3600.0, 9).alias("per_second"), R.health(F.col("errors"), F.col("requests")).alias("health"))


@query(
    """SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, strftime(max(CASE WHEN event_type = 'error' THEN ts END), '%Y-%m-%d %H:%M:%S') AS last_error,
    CASE WHEN count(*) FILTER (event_type = 'error') >= 0.2 * count(*) THEN 'unhealthy' WHEN count(*) FILTER (event_type = 'error') >= 0.05 * count(*) THEN 'degraded' ELSE 'healthy' END AS status FROM events GROUP BY user_id"""
)
def error_patterns(spark, sf_dir):
    bad = F.col("event_type") == "error"
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(bad).alias("errors"), F.max(F.when(bad, F.col("ts"))).alias("last"))
    return e.select("user_id", "calls", "errors", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_error"), R.health(F.col("errors"), F.col("calls")).alias("status"))


_POINTS = """d AS (SELECT user_id, ts::DATE AS day, sum(CASE event_type WHEN 'purchase' THEN 50 WHEN 'signup' THEN 25 ELSE 10 END)::BIGINT AS base, count(*) FILTER (event_type = 'click') AS uploads, count(*) FILTER (event_type = 'view') AS reviews FROM events GROUP BY 1, 2),
  i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS island FROM d),
  s AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY day) AS streak FROM i),
  p AS (SELECT *, base + CASE WHEN k = 1 OR streak > 1 THEN 5 ELSE 0 END + CASE WHEN streak % 7 = 0 THEN 25 ELSE 0 END AS awarded FROM s)"""


def _points(spark, sf_dir):
    worth = F.when(F.col("event_type") == "purchase", 50).when(F.col("event_type") == "signup", 25).otherwise(10)
    return R.points(events(spark, sf_dir), "user_id", "ts", worth)


@query(f"WITH {_POINTS} SELECT user_id, day::VARCHAR AS day, base, streak::INT AS streak, awarded FROM p")
def points_awarded(spark, sf_dir):
    return _points(spark, sf_dir).withColumn("day", F.col("day").cast("string"))


@query(
    f"""WITH {_POINTS}, x AS (SELECT user_id, sum(awarded)::BIGINT AS xp FROM p GROUP BY 1) SELECT user_id, xp,
    CASE WHEN xp >= 5000 THEN 'Knowledge Master' WHEN xp >= 1500 THEN 'Expert' WHEN xp >= 500 THEN 'Analyst' WHEN xp >= 100 THEN 'Explorer' ELSE 'Novice' END AS level,
    round(CASE WHEN xp >= 5000 THEN 100.0 WHEN xp >= 1500 THEN (xp - 1500) * 100.0 / 3500 WHEN xp >= 500 THEN (xp - 500) * 100.0 / 1000 WHEN xp >= 100 THEN (xp - 100) * 100.0 / 400 ELSE xp * 1.0 END, 4)::DOUBLE AS progress FROM x"""
)
def user_levels(spark, sf_dir):
    x = _points(spark, sf_dir).groupBy("user_id").agg(F.sum("awarded").alias("xp")).withColumn("l", R.level(F.col("xp")))
    return x.select("user_id", "xp", F.col("l.name").alias("level"), F.round("l.progress", 4).alias("progress"))


_BADGES = " UNION ALL ".join(f"SELECT user_id, '{c}' AS counter, {t} AS threshold, {c} AS v FROM c" for c, t in R.BADGES)


@query(
    f"""WITH {_POINTS}, c AS (SELECT user_id, sum(uploads)::BIGINT AS uploads_count, sum(reviews)::BIGINT AS reviews_count, max(streak)::BIGINT AS streak_days, sum(awarded)::BIGINT AS total_points FROM p GROUP BY 1), b AS ({_BADGES})
    SELECT user_id, counter, threshold, round(least(100.0, v * 100.0 / threshold), 4)::DOUBLE AS progress, v >= threshold AS earned FROM b"""
)
def user_badges(spark, sf_dir):
    p = _points(spark, sf_dir).groupBy("user_id").agg(F.max("streak").alias("streak_days"), F.sum("awarded").alias("total_points"))
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("uploads_count"), F.count_if(F.col("event_type") == "view").alias("reviews_count"))
    return R.badges(p.join(e, "user_id"), "user_id").withColumn("progress", F.round("progress", 4))


@query("SELECT user_id, ts::DATE::VARCHAR AS day, count(*) FILTER (event_type = 'click') AS done, round(least(1.0, count(*) FILTER (event_type = 'click') / 3.0), 6) AS progress FROM events GROUP BY 1, 2")
def challenge_progress(spark, sf_dir):
    """How far each user is with three clicks a day."""
    e = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count_if(F.col("event_type") == "click").alias("done"))
    return e.withColumn("progress", F.round(F.least(F.lit(1.0), F.col("done") / 3.0), 6))


@query("SELECT user_id, count(*) AS hits, count(*) FILTER (value > 100) AS blocked FROM events GROUP BY user_id ORDER BY blocked DESC, user_id LIMIT 10")
def most_blocked(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("hits"), F.count_if(F.col("value") > 100).alias("blocked"))
    return e.orderBy(F.desc("blocked"), "user_id").limit(10)


@query(
    """WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, min(n) OVER w AS low, max(n) OVER w AS high FROM d WINDOW w AS (PARTITION BY event_type))
    SELECT event_type, string_agg(['▁','▂','▃','▄','▅','▆','▇','█'][CASE WHEN high = low THEN 4 ELSE least(8, floor((n - low) / (high - low)::DOUBLE * 8)::INT + 1) END], '' ORDER BY day) AS line FROM m GROUP BY 1"""
)
def daily_sparklines(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    lists = d.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("s"))  # a number a day
    return lists.select("event_type", R.sparkline(F.transform("s", lambda x: x["n"]), 60).alias("line"))


_HASH = "list_reduce(list_transform(list_filter(string_split(k, ''), lambda c: c <> ''), lambda c: ascii(c)::BIGINT), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648, 0::BIGINT)"


@query(f"SELECT CASE WHEN abs(h) % 100 < 70 THEN 'control' WHEN abs(h) % 100 < 85 THEN 'first' ELSE 'second' END AS variant, count(*) AS documents FROM (SELECT {_HASH} AS h FROM (SELECT 'doc-' || doc_id AS k FROM documents)) GROUP BY 1")
def experiment_variants(spark, sf_dir):
    """Documents in the variants of an experiment by the 31-hash of their name."""
    d = table(spark, sf_dir, "documents").select(R.variant(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), {"control": 70, "first": 15, "second": 15}).alias("variant"))
    return d.groupBy("variant").agg(F.count("*").alias("documents"))


@query(
    f"""WITH v AS (SELECT event_id, value, CASE WHEN abs(h) % 100 < 50 THEN 'a' ELSE 'b' END AS variant FROM (SELECT event_id, value, {_HASH} AS h FROM (SELECT event_id, value, 'event-' || event_id AS k FROM events))),
    m AS (SELECT variant, count(*) AS runs, avg(value) AS mean FROM v GROUP BY 1) SELECT variant, runs, round(mean, 6) AS mean, mean = max(mean) OVER () AS best FROM m"""
)
def experiment_analysis(spark, sf_dir):
    """The mean of a metric for each variant and which is best."""
    e = events(spark, sf_dir).select("value", R.variant(F.concat(F.lit("event-"), F.col("event_id").cast("string")), {"a": 50, "b": 50}).alias("variant"))
    m = e.groupBy("variant").agg(F.count("*").alias("runs"), F.avg("value").alias("mean"))
    return m.withColumn("best", F.col("mean") == F.max("mean").over(Window.partitionBy())).withColumn("mean", F.round("mean", 6))  # a row a variant


@query("SELECT c_custkey, floor(100 * CASE c_mktsegment WHEN 'MACHINERY' THEN 3.0 WHEN 'BUILDING' THEN 2.0 WHEN 'FURNITURE' THEN 1.5 ELSE 1.0 END)::BIGINT AS most FROM customer")
def effective_limits(spark, sf_dir):
    """How much each customer may ask for, by the highest of their roles."""
    roles = F.when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("reviewer"), F.lit("admin"))).when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("contributor"), F.lit("reviewer"))).when(F.col("c_mktsegment") == "FURNITURE", F.array(F.lit("contributor"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", R.effective_limit(F.lit(100), roles).alias("most"))


@query("SELECT o_orderpriority AS action, CASE o_orderpriority WHEN '1-URGENT' THEN 'review' WHEN '2-HIGH' THEN 'upload' ELSE 'activity' END AS kind, count(*) AS n FROM orders GROUP BY 1, 2")
def activity_types(spark, sf_dir):
    action = F.when(F.col("o_orderpriority") == "1-URGENT", "approval").when(F.col("o_orderpriority") == "2-HIGH", "upload").otherwise("other")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("action"), R.activity_type(action).alias("kind")).agg(F.count("*").alias("n"))


_DELETIONS = """r AS (SELECT user_id, ts, event_type = 'error' AS mark FROM events WHERE event_type IN ('error', 'signup')), l AS (SELECT max(ts) AS last FROM events),
  s AS (SELECT *, mark AND NOT coalesce(lag(mark) OVER w, false) AS start, min(CASE WHEN NOT mark THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, mark ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, mark)),
  g AS (SELECT user_id, CASE WHEN (back IS NULL OR back > ts + INTERVAL 10 DAY) AND ts + INTERVAL 10 DAY <= last THEN ts + INTERVAL 10 DAY END AS gone, CASE WHEN back IS NULL THEN ts END AS open FROM s, l WHERE start),
  e AS (SELECT user_id, min(gone) AS gone, max(open) AS open FROM g GROUP BY 1)
  SELECT user_id, CASE WHEN gone IS NOT NULL THEN 'deleted' WHEN open IS NOT NULL THEN 'pending' ELSE 'active' END AS state, coalesce(strftime(coalesce(gone, open), '%Y-%m-%d %H:%M:%S'), '') AS since FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN e USING (user_id)"""


def _since(found):
    return found.withColumn("since", F.coalesce(F.date_format("since", "yyyy-MM-dd HH:mm:ss"), F.lit("")))


@query(f"WITH {_DELETIONS}")
def deletion_states(spark, sf_dir):
    """Users marked by an error and recovered by a signup, deleted after ten days of grace."""
    kind = F.col("event_type")
    return _since(R.deletions(events(spark, sf_dir), "user_id", "ts", kind == "error", kind == "signup", 10 * 86_400))


@query(f"WITH {_DELETIONS}")
def streamed_deletions(spark, sf_dir):
    """The same states, kept up by a stream."""
    return _since(T.deletions(spark, f"{sf_dir}/events.parquet", "user_id", "event_type", "error", "signup", 10 * 86_400))


@query(
    """WITH c AS (SELECT event_type, count(*) FILTER (f <> coalesce(p, false)) AS changes FROM (SELECT event_type, value > 100 AS f, lag(value > 100) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) GROUP BY 1)
    SELECT e.event_type, count(*) AS processed, count(*) FILTER (value > 100) AS failed, max(event_id) AS checkpoint, round(avg(value), 6) AS mean_value, any_value(changes) AS changes FROM events e JOIN c USING (event_type) GROUP BY 1"""
)
def sync_sessions(spark, sf_dir):
    """A connector's session for each event type, from a stream."""
    return T.sync_sessions(spark, f"{sf_dir}/events.parquet", "event_type", 100.0).withColumn("mean_value", F.round("mean_value", 6))


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS started, count(*) AS n FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2 HAVING count(*) >= 2")
def streamed_alerts(spark, sf_dir):
    """Days on which a user had two errors or views, from a stream."""
    found = T.alerts(spark, f"{sf_dir}/events.parquet", "user_id", ["error", "view"], 2, "1 day")
    return found.withColumn("started", F.col("started").cast("timestamp_ntz"))


# six calls or more of a user in five days, half of them too slow: open for a day
_RULE = B.Rule(window=5 * 86_400_000_000, reset=86_400_000_000, volume=6, threshold=0.5)
_BREAKERS = """WITH RECURSIVE c AS (SELECT user_id, epoch_us(ts) AS t, value > 60 AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT DISTINCT user_id, 0 AS k, 'closed' AS state, -1::BIGINT AS since, 0::BIGINT AS calls, 0::BIGINT AS failures, 0::BIGINT AS rejected, 0::BIGINT AS opened, []::STRUCT(t BIGINT, bad BOOLEAN)[] AS recent FROM c
  UNION ALL SELECT user_id, nk, CASE WHEN now = 'open' THEN 'open' WHEN now = 'half-open' THEN CASE WHEN bad THEN 'open' ELSE 'closed' END WHEN trips THEN 'open' ELSE 'closed' END, CASE WHEN now = 'half-open' OR now = 'closed' AND trips THEN t ELSE since END,
    calls + (now <> 'open')::INT, failures + (now <> 'open' AND bad)::INT, rejected + (now = 'open')::INT, opened + (now = 'half-open' AND bad OR now = 'closed' AND trips)::INT, CASE WHEN now <> 'closed' OR trips THEN [] ELSE held END
  FROM (SELECT *, bad AND len(held) >= 6 AND len(list_filter(held, lambda z: z.bad)) >= 0.5 * len(held) AS trips FROM (SELECT r.*, c.* EXCLUDE (user_id, k), c.k AS nk,
    CASE WHEN state = 'open' AND c.t >= since + 86400000000 THEN 'half-open' ELSE state END AS now, list_append(list_filter(recent, lambda z: z.t > c.t - 5 * 86400000000), {'t': c.t, 'bad': c.bad}) AS held FROM r JOIN c ON c.user_id = r.user_id AND c.k = r.k + 1) x) y),
z AS (SELECT *, state = 'open' AND since + 86400000000 <= (SELECT max(t) FROM c) AS over FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1)
SELECT user_id::VARCHAR AS service, CASE WHEN over THEN 'half-open' ELSE state END AS state, strftime(make_timestamp(nullif(CASE WHEN over THEN since + 86400000000 ELSE since END, -1)), '%Y-%m-%d %H:%M:%S') AS since, calls, failures, rejected, opened FROM z"""


def _told(found):
    return found.withColumn("since", F.date_format("since", "yyyy-MM-dd HH:mm:ss"))


@query(_BREAKERS)
def breaker_states(spark, sf_dir):
    """Every user's circuit breaker after all calls, replayed one by one."""
    return _told(B.replayed(table(spark, sf_dir, "events"), "user_id", "ts", F.col("value") > 60, "event_id", _RULE))


@query(_BREAKERS)
def streamed_breakers(spark, sf_dir):
    """The same as keyed state with timers, of a stream of the calls."""
    return _told(breakers(spark, f"{sf_dir}/events.parquet", "user_id", "ts", F.col("value") > 60, "event_id", _RULE))
