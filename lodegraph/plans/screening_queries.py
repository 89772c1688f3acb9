"""Queries that screen, export, merge and summarise."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodegraph.functions import names as N
from lodegraph.operators import screening as S
from lodegraph.operators import vectors as V
from lodegraph.plans.registry import query
from lodegraph.plans.views import GRAPH, VERTICES, edges, vertices
from lodegraph.sources.tables import table

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FAMILIES = ", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), {_quoted('(?i)' + '|'.join(f'(?:{p})' for p in patterns))}) THEN '{n}' END" for n, (_, patterns) in S.ATTACKS.items())
_SUSPICION = " + ".join([f"CASE WHEN regexp_matches(coalesce(text, ''), {_quoted('(?i)' + p)}) THEN {w} ELSE 0.0 END::DOUBLE" for p, w in S.HINTS] + [
    f"CASE WHEN len(regexp_extract_all(coalesce(text, ''), {_quoted(p)})) >= {n} THEN {w} * least(len(regexp_extract_all(coalesce(text, ''), {_quoted(p)}))::DOUBLE / {n}, 2.0) ELSE 0.0 END::DOUBLE" for p, w, n in S.COUNTED])
_ODD = f"""list_filter([CASE WHEN length(coalesce(text, '')) > 10000 THEN 'long' END, CASE WHEN len(regexp_split_to_array(coalesce(text, ''), '\\s+')) > 50 AND list_max(map_values(list_histogram(regexp_split_to_array(coalesce(text, ''), '\\s+')))) > 50
  AND list_max(map_values(list_histogram(regexp_split_to_array(coalesce(text, ''), '\\s+')))) > len(regexp_split_to_array(coalesce(text, ''), '\\s+')) * 0.2 THEN 'repetitive' END,
  CASE WHEN regexp_matches(coalesce(text, ''), '{S._HIDDEN}') THEN 'hidden' END, CASE WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9+/]{{50,}}={{0,2}}') THEN 'encoded' END], lambda x: x IS NOT NULL)"""
_LEVEL = "CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(0, " + ", ".join(f"CASE WHEN list_contains(f, '{n}') THEN {S.SEVERITIES.index(s)} ELSE 0 END" for n, (s, _) in S.ATTACKS.items()) + (
    ", CASE WHEN s >= 0.8 THEN 3 WHEN s >= 0.6 THEN 2 WHEN s >= 0.5 THEN 1 ELSE 0 END, CASE WHEN list_contains(o, 'hidden') THEN 2 WHEN len(o) > 0 THEN 1 ELSE 0 END) END")


@query(
    f"""WITH a AS (SELECT doc_id, text, list_filter([{_FAMILIES}], lambda x: x IS NOT NULL) AS f, least(1.0, round({_SUSPICION}, 9)) AS s, {_ODD} AS o FROM documents), l AS (SELECT doc_id, f, s, o, {_LEVEL} AS level FROM a)
    SELECT doc_id, array_to_string(f, ',') AS families, round(s, 6)::DOUBLE AS suspicion, array_to_string(o, ',') AS odd, ['none','low','medium','high','critical'][level + 1] AS severity, ['allow','warn','warn','block','block'][level + 1] AS action FROM l"""
)
def injection_scan(spark, sf_dir):
    """Every document's attempts to steer a model, its suspicious words and its structure."""
    found = S.analysed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.array_join("families", ",").alias("families"), F.round("suspicion", 6).alias("suspicion"), F.array_join("odd", ",").alias("odd"), S.level_name(F.col("level")).alias("severity"), S.action(F.col("level")).alias("action"))


@query(
    f"""WITH m AS (SELECT conv_id, turn, role, text FROM conversations), j AS (SELECT conv_id, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS text FROM m WHERE role = 'user' GROUP BY 1 HAVING count(*) >= 3),
    a AS (SELECT conv_id, role, text, list_filter([{_FAMILIES}], lambda x: x IS NOT NULL) AS f, least(1.0, round({_SUSPICION}, 9)) AS s, {_ODD} AS o FROM (SELECT conv_id, role, text FROM m UNION ALL SELECT conv_id, 'all', text FROM j)),
    l AS (SELECT conv_id, role, {_LEVEL} AS level FROM a), g AS (SELECT conv_id, max(level) FILTER (role <> 'all') AS single, coalesce(max(level) FILTER (role = 'user'), 0) AS u, coalesce(max(level) FILTER (role = 'all'), 0) AS t FROM l GROUP BY 1)
    SELECT conv_id, t >= 3 AND t > u AS crossed, ['none','low','medium','high','critical'][CASE WHEN t >= 3 AND t > u THEN greatest(single, 2) ELSE single END + 1] AS severity FROM g"""
)
def conversation_scan(spark, sf_dir):
    """The severity of every conversation, its user messages taken together too."""
    found = S.conversations(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return found.select("conv_id", "crossed", S.level_name(F.col("level")).alias("severity"))


@query()
def redacted_documents(spark, sf_dir):
    """Documents with personal data of the twelve classes, redacted, and what was found."""
    found = S.redacted(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.where(F.size("spans") > 0).select("doc_id", F.md5("clean").alias("hash"), F.size("spans").alias("found"), F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["class"], s["position"], s["length"])), ",").alias("spans"))


@query()
def personal_data_summary(spark, sf_dir):
    """How much personal data of each category and severity the documents hold, without changing them."""
    found = S.redacted(table(spark, sf_dir, "documents"), "doc_id", "text", audit=True).select("doc_id", F.explode("spans").alias("s"))
    return found.groupBy("s.category", "s.severity", "s.class").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))


@query("SELECT event_id, concat_ws(',', event_id, event_type, CASE WHEN regexp_matches(props, '[,\"\\r\\n]') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END) AS line FROM events")
def audit_rows(spark, sf_dir):
    """Whole rows of the log as CSV."""
    return table(spark, sf_dir, "events").select("event_id", S.csv_row([F.col("event_id"), F.col("event_type"), F.col("props")]).alias("line"))


@query("SELECT event_id, CASE WHEN regexp_matches(props, '[,\"\\r\\n]') THEN '\"' || replace(props, '\"', '\"\"') || '\"' ELSE props END AS field FROM events")
def audit_csv(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.csv_field(F.col("props")).alias("field"))


@query(f"SELECT key, count(*) AS entities, min(id) AS canonical FROM (SELECT id, type || '/' || trim(regexp_replace(lower(name), '[0-9#]+', '', 'g')) AS key FROM ({VERTICES})) GROUP BY key")
def merge_entities(spark, sf_dir):
    """Vertices that agree in type and name without numbers, under their least id."""
    v = vertices(spark, sf_dir).select("id", F.concat("type", F.lit("/"), F.trim(F.regexp_replace(F.lower("name"), "[0-9#]+", ""))).alias("key"))
    return v.groupBy("key").agg(F.count("*").alias("entities"), F.min("id").alias("canonical"))


@query("SELECT n_regionkey, 'comm_' || left(md5(string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR)), 12) AS community FROM nation GROUP BY 1")
def community_id_hash(spark, sf_dir):
    members = F.array_join(F.array_sort(F.collect_list(F.col("n_nationkey").cast("string"))), ",")
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("comm_"), F.left(F.md5(members), F.lit(12))).alias("community"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most, round(stddev_pop(value), 4) AS deviation, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM events GROUP BY 1")
def batch_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.stddev_pop("value"), 4).alias("deviation"),
        F.round(F.avg(F.when(F.col("value") >= 50, 1.0).otherwise(0.0)), 6).alias("pass_rate"),
    )


@query(
    """WITH d AS (SELECT label, vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS d FROM embeddings),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM d WHERE d IS NOT NULL), t AS (SELECT label, d AS threshold FROM r WHERE k = floor(0.9 * (n - 1)) + 1)
    SELECT d.label, vec_id, round(d, 6) AS distance FROM d JOIN t ON d.label = t.label AND d.d > threshold"""
)
def breakpoints(spark, sf_dir):
    """Places where consecutive vectors of a label are further apart than nine tenths of them."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, sf_dir, "embeddings").withColumn("next", F.lead("embedding").over(w)).where("next IS NOT NULL")
    d = e.select("label", "vec_id", (1 - V.cosine(F.col("embedding"), F.col("next"))).alias("d"))
    ranked = d.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("d", "vec_id"))).join(d.groupBy("label").agg(F.count("*").alias("n")), "label")
    t = ranked.where(F.col("k") == F.floor(0.9 * (F.col("n") - 1)) + 1).select("label", F.col("d").alias("threshold"))
    return d.join(t, "label").where("d > threshold").select("label", "vec_id", F.round("d", 6).alias("distance"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>'))::INT AS headings, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs, len(regexp_extract_all(html, '<a [^>]*href'))::INT AS links FROM pages")
def page_outline(spark, sf_dir):
    count = lambda p: F.coalesce(F.regexp_count("html", F.lit(p)), F.lit(0)).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", count("<h[1-6][^>]*>").alias("headings"), count("<p[ >]").alias("paragraphs"), count("<a [^>]*href").alias("links"))


@query("SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def weekly_review(spark, sf_dir):
    day = lambda unit: F.date_format(F.date_trunc(unit, F.col("ts").cast("timestamp")), "yyyy-MM-dd")
    return table(spark, sf_dir, "events").groupBy(day("week").alias("week"), day("month").alias("month")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


_ASKED = "lower(trim(regexp_extract(text, '^[^ ]+ [^ .,]+')))"


@query(f"SELECT {_ASKED} AS asked, count(*) AS n FROM conversations WHERE role = 'user' AND {_ASKED} <> '' GROUP BY 1 ORDER BY n DESC, asked LIMIT 10")
def popular_queries(spark, sf_dir):
    """The ten most frequent openings (two words) of what users ask."""
    asked = F.lower(F.trim(F.regexp_extract("text", "^[^ ]+ [^ .,]+", 0)))
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select(asked.alias("asked")).where("asked <> ''")
    return c.groupBy("asked").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "asked").limit(10)


@query(
    f"""{GRAPH}, x AS (SELECT type, dst, count(*) AS n FROM e GROUP BY type, dst), m AS (SELECT type, max(n) AS most FROM x GROUP BY type) SELECT x.type, dst, round(n::DOUBLE / most, 6) AS importance FROM x JOIN m USING (type) WHERE n::DOUBLE / most >= 0.9"""
)
def important_targets(spark, sf_dir):
    """Vertices whose in-degree of a type is within a tenth of the greatest."""
    n = edges(spark, sf_dir).groupBy("type", "dst").agg(F.count("*").alias("n"))
    m = n.groupBy("type").agg(F.max("n").alias("most"))
    return n.join(m, "type").where("n / most >= 0.9").select("type", "dst", F.round(F.col("n") / F.col("most"), 6).alias("importance"))


@query("SELECT o_orderkey, to_base64(('{\"s\":' || (o_orderkey * 3) || ',\"i\":' || o_custkey || '}')::BLOB) AS cursor FROM orders")
def keyset_cursors(spark, sf_dir):
    """The cursor after each order: base64 of the JSON of its sort value and id."""
    cursor = F.base64(F.to_json(F.struct((F.col("o_orderkey") * 3).alias("s"), F.col("o_custkey").alias("i"))).cast("binary"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cursor.alias("cursor"))


@query("SELECT event_type AS session, count(*) FILTER (value <= 150) AS processed, count(*) FILTER (value > 150) AS failed, max(event_id) AS checkpoint FROM events GROUP BY 1")
def sync_counters(spark, sf_dir):
    """Counters and the last checkpoint of a sync session for each event type, in which large values fail."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("session"))
    return e.agg(F.count_if(F.col("value") <= 150).alias("processed"), F.count_if(F.col("value") > 150).alias("failed"), F.max("event_id").alias("checkpoint"))
