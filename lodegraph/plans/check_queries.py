"""Queries that check, summarise and compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import checks as C
from lodegraph.operators import graph as G
from lodegraph.operators import metrics as M
from lodegraph.plans.registry import query
from lodegraph.plans.vector_queries import _TOP, neighbours
from lodegraph.plans.views import GRAPH, edges, vertices
from lodegraph.sources.tables import table, written


@query(
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT coalesce(length(text) >= 200, false) THEN 'text' END, CASE WHEN NOT coalesce(lang IN ('en', 'de', 'fr'), false) THEN 'lang' END, CASE WHEN NOT coalesce(regexp_matches(source, '^src[0-9]$'), false) THEN 'source' END,
    CASE WHEN NOT coalesce(n_chars BETWEEN 1 AND 20000, false) THEN 'n_chars' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents"""
)
def dataset_errors(spark, sf_dir):
    """Constraints that documents break."""
    tests = {"text": F.length("text") >= 200, "lang": F.col("lang").isin("en", "de", "fr"), "source": F.col("source").rlike("^src[0-9]$"), "n_chars": F.col("n_chars").between(1, 20_000)}
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(C.errors(tests), ",").alias("errors"))


@query(
    """WITH t AS (SELECT 'q' || quality AS category, 't' || toxic AS severity, (n_chars > 1000)::INT AS p FROM labels JOIN documents USING (doc_id)), u AS (SELECT '' AS category, '' AS severity, count(*) AS tests, sum(p)::BIGINT AS passed FROM t UNION ALL SELECT category, '', count(*), sum(p)::BIGINT FROM t GROUP BY 1 UNION ALL SELECT '', severity, count(*), sum(p)::BIGINT FROM t GROUP BY 2)
    SELECT category, severity, tests, passed, round(passed * 100.0 / tests, 6)::DOUBLE AS rate FROM u"""
)
def run_summary(spark, sf_dir):
    """Labelled documents as tests that long ones pass, by quality and toxicity."""
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.concat(F.lit("q"), "quality").alias("category"), F.concat(F.lit("t"), "toxic").alias("severity"), "n_chars")
    return C.run_summary(t, F.col("n_chars") > 1000, ["category", "severity"]).fillna("", ["category", "severity"]).withColumn("rate", F.round("rate", 6))


@query(
    """WITH a AS (SELECT user_id, avg(value) AS a FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, avg(value) AS b FROM events WHERE event_type = 'click' GROUP BY 1), p AS (SELECT *, abs(a - b) <= 0.05 * greatest(a, b) AS near FROM a JOIN b USING (user_id))
    SELECT count(*) AS pairs, count(*) FILTER (NOT near AND a < b) AS first, count(*) FILTER (NOT near AND a > b) AS second, count(*) FILTER (near) AS ties, round((avg(a) - avg(b)) / avg(b) * 100, 6) AS difference FROM p"""
)
def strategy_comparison(spark, sf_dir):
    """Views against clicks of each user by their mean."""
    mean = lambda kind: table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("value"))
    return C.paired(mean("view"), mean("click"), "user_id").withColumn("difference", F.round("difference", 6))


_ALL = " UNION ALL ".join(
    f"SELECT {k} AS k, round(avg(h / {k}.0), 6)::DOUBLE AS precision, round(avg(h::DOUBLE / n), 6) AS recall, round(avg((h > 0)::INT), 6)::DOUBLE AS hit_rate FROM (SELECT t.query, count(*) FILTER (same AND position <= {k}) AS h, any_value(n) AS n FROM t JOIN g USING (query) GROUP BY 1)" for k in (1, 3, 5, 10)
)


@query(f"WITH {_TOP}, g AS (SELECT query, count(*) FILTER (same) AS n FROM p GROUP BY 1) {_ALL}")
def all_metrics(spark, sf_dir):
    """Mean precision, recall and hit rate at 1, 3, 5 and 10 of the vector search, vectors of one label being relevant."""
    v = table(spark, sf_dir, "embeddings")
    ranked = written(neighbours(spark, sf_dir, 10))  # one search for all k
    items = v.select(F.col("vec_id").alias("item"), "label")
    each = [M.at_k_by_label(ranked, items, k).agg(F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("hit_rate")).withColumn("k", F.lit(k)) for k in (1, 3, 5, 10)]
    return reduce(DataFrame.unionByName, each)


@query("SELECT o_orderkey, o_custkey AS i, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders")
def decoded_cursors(spark, sf_dir):
    """Cursors of all orders, read back."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", C.cursor(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_custkey")).alias("c"))
    return o.select("o_orderkey", C.decoded(F.col("c"), "s string, i long").alias("d")).select("o_orderkey", "d.i", "d.s")


@query(f"{GRAPH}, d AS (SELECT DISTINCT unnest([src, dst]) AS id FROM e WHERE type <> 'DEPENDS_ON') SELECT type, CASE WHEN d.id IS NULL THEN 'isolated' ELSE 'connected' END AS state, count(*) AS vertices FROM v LEFT JOIN d USING (id) GROUP BY 1, 2")
def connectivity(spark, sf_dir):
    """Vertices by type and whether an edge that isn't a dependency meets them."""
    v, e = vertices(spark, sf_dir), edges(spark, sf_dir).where("type <> 'DEPENDS_ON'")
    met = v.join(G.endpoints(e).distinct().withColumn("_m", F.lit(True)), "id", "left")
    return met.groupBy("type", F.when(F.col("_m"), "connected").otherwise("isolated").alias("state")).agg(F.count("*").alias("vertices"))
