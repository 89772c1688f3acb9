"""Queries on vectors: search, fusion, resolution and coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import vector_index as I
from lodegraph.operators import vectors as V
from lodegraph.plans.registry import query
from lodegraph.sources.tables import scratch_path, table

_ASKED = "vec_id % 50 = 0"
_TOP = """p AS (SELECT q.vec_id AS query, v.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s, q.label = v.label AS same FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
  t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, item) AS position FROM p)"""


def neighbours(spark, sf_dir, k: int = 10):
    """The k nearest of every vector whose id is divisible by 50, among all vectors."""
    v = table(spark, sf_dir, "embeddings")
    return V.nearest(v, v.where(_ASKED), k)


@query(f"WITH {_TOP} SELECT query, item, round(s, 6) AS score, position::INT AS position FROM t WHERE position <= 10")
def vector_topk(spark, sf_dir):
    return neighbours(spark, sf_dir).select("query", "item", F.round("score", 6).alias("score"), "position")


@query(f"WITH {_TOP} SELECT query, item, CASE WHEN s >= 0.45 THEN 'merge' WHEN s >= 0.40 THEN 'same_as' WHEN s >= 0.35 THEN 'similar_to' ELSE 'related' END AS action FROM t WHERE position <= 20 AND s >= 0.30")
def resolution_actions(spark, sf_dir):
    """What becomes of each query's candidates on a ladder of thresholds that fits these vectors."""
    s = F.col("score")
    action = F.when(s >= 0.45, "merge").when(s >= 0.40, "same_as").when(s >= 0.35, "similar_to").otherwise("related")
    return neighbours(spark, sf_dir, 20).where(s >= 0.30).select("query", "item", action.alias("action"))


@query(
    f"""WITH {_TOP}, b AS (SELECT query, item, row_number() OVER (PARTITION BY query ORDER BY item) AS position FROM t WHERE position <= 20),
    u AS (SELECT query, item, 0.7 / (60 + position) AS x FROM t WHERE position <= 20 UNION ALL SELECT query, item, 0.3 / (60 + position) FROM b) SELECT query, item, round(sum(x), 9) AS score FROM u GROUP BY query, item"""
)
def rrf_fusion(spark, sf_dir):
    """Rank fusion of the similarity ranking with a ranking of the same items by id."""
    from pyspark.sql import Window

    one = neighbours(spark, sf_dir, 20)
    other = one.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("item")))
    return V.fuse(one, other).withColumn("score", F.round("score", 9))


@query(
    """WITH x AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS place FROM embeddings), c AS (SELECT label, list(x ORDER BY place) AS centroid FROM (SELECT label, place, avg(x) AS x FROM x GROUP BY label, place) GROUP BY label)
    SELECT e.label, count(*) AS n, round(avg(list_cosine_similarity(e.embedding::DOUBLE[], c.centroid)), 6) AS coherence FROM embeddings e JOIN c USING (label) GROUP BY e.label"""
)
def centroid_coherence(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = e.join(V.centroids(e, "label"), "label").select("label", V.cosine(F.col("embedding"), F.col("centroid")).alias("s"))
    return near.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("coherence"))


def _index(spark, sf_dir):
    """All vectors in cells, with their label and the documents that they come from (two of ten)."""
    v = table(spark, sf_dir, "embeddings").withColumn("docs", F.array(F.col("vec_id") % 10, F.col("vec_id") % 7))
    return v, I.build(v, scratch_path(spark), keep=("label", "docs"))


@query(f"WITH {_TOP} SELECT query, item, round(s, 6) AS score, position::INT AS position FROM t WHERE position <= 10")
def indexed_topk(spark, sf_dir):
    """The same ten by the index: probed cells first, then those that may hold a better one."""
    v, index = _index(spark, sf_dir)
    return I.search(index, v.where(_ASKED), 10).select("query", "item", F.round("score", 6).alias("score"), "position")


@query(
    """WITH v AS (SELECT *, [vec_id % 10, vec_id % 7] AS docs FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id AND q.label IS NOT DISTINCT FROM v.label AND NOT list_has_any(q.docs, v.docs) WHERE q.vec_id % 50 = 0 AND v.vec_id % 3 > 0)
    SELECT query, item, round(s, 6) AS score, (row_number() OVER (PARTITION BY query ORDER BY s DESC, item))::INT AS position FROM p QUALIFY position <= 5"""
)
def similar_entities(spark, sf_dir):
    """The five nearest of the same label that share no document, among the rows that a filter leaves."""
    v, index = _index(spark, sf_dir)
    found = I.search(index, v.where(_ASKED), 5, same="label", without="docs", where=F.col("vec_id") % 3 > 0)
    return found.select("query", "item", F.round("score", 6).alias("score"), "position")
