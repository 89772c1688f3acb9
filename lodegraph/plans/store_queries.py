"""Queries that list, merge, stage, sweep and page keyed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodegraph.operators import store as S
from lodegraph.plans.registry import query
from lodegraph.sources.tables import scratch_path, shared_folder, table

_STATUS = "st AS (SELECT d.doc_id, source, lang, n_chars, CASE WHEN l.quality = 1 THEN 'completed' WHEN l.quality = 0 THEN 'rejected' ELSE 'pending_review' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))"


def statuses(spark, sf_dir):
    """(doc_id, source, lang, n_chars, status): documents with the review status that their label gives them."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    state = F.when(F.col("quality") == 1, "completed").when(F.col("quality") == 0, "rejected").otherwise("pending_review")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "lang", "n_chars", state.alias("status"))


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS place FROM documents ORDER BY place LIMIT 50")
def document_listing(spark, sf_dir):
    """The fifty documents that a listing, largest first, begins with."""
    from pyspark.sql import Window

    top = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    return top.select("doc_id", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")).alias("place"))  # fifty rows


@query(f"WITH {_STATUS} SELECT doc_id, n_chars FROM st WHERE status = 'pending_review' AND (n_chars < 3000 OR (n_chars = 3000 AND doc_id < 500)) ORDER BY n_chars DESC, doc_id DESC LIMIT 21")
def status_page(spark, sf_dir):
    """A keyset page of the documents under review."""
    return S.after(S.matching(statuses(spark, sf_dir), equal={"status": "pending_review"}), "n_chars", "doc_id", (3000, 500)).select("doc_id", "n_chars")


@query(f"WITH {_STATUS} SELECT CASE status WHEN 'pending_review' THEN 'completed' ELSE status END AS shown, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM st GROUP BY 1, 2")
def status_dashboard(spark, sf_dir):
    """Documents by the status that is shown: those under review count as completed."""
    shown = F.when(F.col("status") == "pending_review", "completed").otherwise(F.col("status"))
    return statuses(spark, sf_dir).groupBy(shown.alias("shown"), "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@query("SELECT l.doc_id, d.source, d.n_chars FROM labels l LEFT JOIN documents d USING (doc_id)")
def document_lookup(spark, sf_dir):
    """The document of every label, by its key."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").select("doc_id").join(d, "doc_id", "left")


@query("SELECT source, count(*) AS documents FROM documents WHERE n_chars >= 1500 AND lang = 'en' GROUP BY source")
def parameterised_sql(spark, sf_dir):
    """A query given as text with named parameters."""
    return spark.sql("SELECT source, count(*) AS documents FROM {docs} WHERE n_chars >= :least AND lang = :lang GROUP BY source", args={"least": 1500, "lang": "en"}, docs=table(spark, sf_dir, "documents"))


@query(
    """SELECT coalesce(d.doc_id, u.doc_id) AS doc_id, coalesce(u.source, d.source) AS source, d.lang, coalesce(u.n_chars, d.n_chars) AS n_chars
    FROM documents d FULL JOIN (SELECT doc_id, 'reviewed' AS source, NULL::BIGINT AS n_chars FROM labels UNION ALL SELECT 1000000000 + item_id, 'benchmark', length(text) FROM benchmark) u ON d.doc_id = u.doc_id"""
)
def documents_merged(spark, sf_dir):
    """Documents with the labelled ones' source replaced and the benchmark's items inserted."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit("reviewed").alias("source"), F.lit(None).cast("long").alias("n_chars"))
    new = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.lit("benchmark").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return S.merged(d, known.unionByName(new), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def documents_without_deleted(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1")
    return S.without(table(spark, sf_dir, "documents").select("doc_id", "source"), gone, "doc_id")


@query(
    """WITH l AS (SELECT d.doc_id, coalesce(CASE WHEN x.quality = 0 THEN 'low' END, d.source) AS source, d.n_chars FROM documents d LEFT JOIN labels x USING (doc_id) WHERE x.toxic IS NULL OR x.toxic = 0)
    SELECT * FROM l UNION ALL SELECT item_id + 1000000000, 'staged', length(text) FROM benchmark"""
)
def staged_commit(spark, sf_dir):
    """A staged change set applied: toxic documents deleted, poor ones marked, benchmark items added."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), table(spark, sf_dir, "labels")
    added = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.lit("staged").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return S.committed(d, added, l.where("quality = 0").select("doc_id", F.lit("low").alias("source")), l.where("toxic = 1"), "doc_id")


@query("SELECT CASE WHEN toxic = 1 THEN 'delete' WHEN quality = 0 THEN 'modify' ELSE 'keep' END AS change, count(*) AS documents FROM labels GROUP BY 1 UNION ALL SELECT 'add', count(*) FROM benchmark")
def staged_preview(spark, sf_dir):
    """How many rows each kind of staged change concerns."""
    change = F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 0, "modify").otherwise("keep")
    kept = table(spark, sf_dir, "labels").groupBy(change.alias("change")).agg(F.count("*").alias("documents"))
    return kept.unionByName(table(spark, sf_dir, "benchmark").agg(F.count("*").alias("documents")).withColumn("change", F.lit("add")))


@query("SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'active' ELSE 'closed' END AS state FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1")
def session_states(spark, sf_dir):
    """The latest turn of each session; a session is active while its user waits for an answer."""
    last = S.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")])
    return last.select("conv_id", "turn", "role", F.when(F.col("role") == "user", "active").otherwise("closed").alias("state"))


@query("SELECT event_type, count(*) FILTER (ts < last - INTERVAL 7 DAY) AS archived, count(*) FILTER (ts >= last - INTERVAL 7 DAY) AS kept FROM events, (SELECT max(ts) AS last FROM events) GROUP BY event_type")
def retention_sweep(spark, sf_dir):
    e = S.swept(table(spark, sf_dir, "events"), "ts", 7)
    return e.groupBy("event_type").agg(F.count_if("archive").alias("archived"), F.count_if(~F.col("archive")).alias("kept"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def audit_partitions(spark, sf_dir):
    """Events appended to a table with a folder for each type, then read back."""
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    S.append(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, "event_type")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, event_type, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3")
def recent_history(spark, sf_dir):
    """The last three events of each user and type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return S.latest(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_type", "event_id", "place")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'")
def log_search(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    stamp = lambda day: F.lit(day).cast("timestamp")
    return S.matching(e, one_of={"event_type": ["error", "purchase"]}, since=("ts", stamp("2024-01-08")), until=("ts", stamp("2024-01-22"))).select("event_id", "user_id", "event_type")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS at FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def activity_feed(spark, sf_dir):
    """The third page of the feed, latest first."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.page(e, [F.desc("ts"), F.desc("event_id")], 25, 3).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"))


@query("SELECT count(*) AS total, ceil(count(*) / 25.0)::BIGINT AS pages FROM events")
def page_envelope(spark, sf_dir):
    return S.envelope(table(spark, sf_dir, "events"), 25)


@query(
    """WITH x AS (SELECT o_orderkey AS id, o_orderdate AS created, max(l_shipdate) AS updated FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
    s AS (SELECT count(*) AS entities, count(*) FILTER (created >= TIMESTAMP '1998-06-01') AS new, count(*) FILTER (created < TIMESTAMP '1998-06-01' AND updated >= TIMESTAMP '1998-06-01') AS modified,
      max(greatest(created, coalesce(updated, created)))::DATE::VARCHAR AS latest FROM x)
    SELECT entities, new, modified, round((new + modified)::DOUBLE / entities, 6) AS ratio, CASE WHEN (new + modified)::DOUBLE / entities < 0.2 THEN 'incremental' ELSE 'full' END AS recommended, latest FROM s"""
)
def change_summary(spark, sf_dir):
    """Orders made or shipped since a day, and whether so few that an incremental run is enough."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    x = o.join(l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("updated")), "o_orderkey", "left").select(F.col("o_orderdate").alias("created"), "updated")
    since = F.lit("1998-06-01").cast("timestamp_ntz")
    new, modified = F.col("created") >= since, (F.col("created") < since) & (F.col("updated") >= since)
    s = x.agg(F.count("*").alias("entities"), F.count_if(new).alias("new"), F.count_if(modified).alias("modified"), F.max(F.greatest("created", "updated")).cast("date").cast("string").alias("latest"))
    ratio = (F.col("new") + F.col("modified")) / F.col("entities")
    return s.select("entities", "new", "modified", F.round(ratio, 6).alias("ratio"), F.when(ratio < 0.2, "incremental").otherwise("full").alias("recommended"), "latest")


@query(
    """SELECT strftime(ts, '%Y-%m-%d') AS run, event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1, 2"""
)
def run_metrics(spark, sf_dir):
    """Runs stored as a map of metrics a day, read back as rows."""
    e = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run"), "event_type").agg(F.avg("value").alias("value"))
    runs = e.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("metrics"))
    return runs.select("run", F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 6))


@query("WITH l AS (SELECT max(ts) AS last FROM events) SELECT 'archived' AS place, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events, l WHERE ts < last - INTERVAL 7 DAY GROUP BY ALL UNION ALL SELECT 'kept', strftime(ts, '%Y-%m-%d'), count(*) FROM events, l WHERE ts >= last - INTERVAL 7 DAY GROUP BY ALL")
def archived_days(spark, sf_dir):
    """Events by day in the archive and among those that a retention sweep has left, both read back."""
    old, new = scratch_path(spark), scratch_path(spark)
    S.archived(table(spark, sf_dir, "events"), "ts", 7, old, new)
    far = spark.read.schema("event_id long, day string").json(old).groupBy("day").agg(F.count("*").alias("n")).select(F.lit("archived").alias("place"), F.col("day").cast("string").alias("day"), "n")
    near = spark.read.parquet(new).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).select(F.lit("kept").alias("place"), "day", "n")
    return far.unionByName(near)
