"""Queries on entities that are one."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import resolution as R
from lodegraph.operators import vectors as V
from lodegraph.plans.registry import query
from lodegraph.plans.vector_queries import _ASKED, _TOP
from lodegraph.sources.tables import table

_UNITS = "sup AS (SELECT 'Unit ' || s_suppkey AS name, 'supplier' AS type, round(s_acctbal / 10000, 6) AS confidence, CASE WHEN s_nationkey > 12 THEN s_name END AS description FROM supplier), cus AS (SELECT ' unit  ' || c_custkey AS name, 'customer' AS type, round(c_acctbal / 10000, 6) AS confidence, c_name AS description FROM customer)"


def _units(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    sup = s.select(F.concat(F.lit("Unit "), F.col("s_suppkey")).alias("name"), F.lit("supplier").alias("type"), F.round(F.col("s_acctbal") / 10000, 6).alias("confidence"), F.when(F.col("s_nationkey") > 12, F.col("s_name")).alias("description"))
    return sup, c.select(F.concat(F.lit(" unit  "), F.col("c_custkey")).alias("name"), F.lit("customer").alias("type"), F.round(F.col("c_acctbal") / 10000, 6).alias("confidence"), F.col("c_name").alias("description"))


@query(
    f"""WITH {_UNITS}, a AS (SELECT trim(regexp_replace(lower(name), ' +', ' ', 'g')) AS key, * FROM sup), b AS (SELECT trim(regexp_replace(lower(name), ' +', ' ', 'g')) AS key, * FROM cus)
    SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL OR b.confidence > a.confidence THEN b.type ELSE a.type END AS type, CASE WHEN a.key IS NULL OR b.confidence > a.confidence THEN b.confidence ELSE a.confidence END AS confidence, coalesce(a.description, b.description) AS description
    FROM a FULL JOIN b ON a.key = b.key"""
)
def upserted_entities(spark, sf_dir):
    """Suppliers as known and customers as incoming entities, by normalised name."""
    return R.upserted(*_units(spark, sf_dir)).select("key", "type", "confidence", "description")


@query("SELECT p_brand AS doc, trim(regexp_replace(lower(p_type), ' +', ' ', 'g')) AS key, count(*) AS mentions, max(p_retailprice) AS confidence FROM part GROUP BY 1, 2")
def document_entities(spark, sf_dir):
    """Part types as mentions in brands, one for each name."""
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc"), F.col("p_type").alias("name"), F.col("p_retailprice").alias("confidence"))
    return R.in_document(e).select("doc", "key", "mentions", "confidence")


@query("SELECT c_custkey, s_suppkey AS id FROM customer LEFT JOIN supplier ON trim(regexp_replace(lower(' Supplier#' || right(c_name, 9)), ' +', ' ', 'g')) = lower(s_name)".replace("s_suppkey AS id", "coalesce(s_suppkey, -1) AS id"))
def entities_by_name(spark, sf_dir):
    """The supplier that each customer's number names, white space and case aside."""
    wanted = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit(" SUPPLIER#"), F.substring("c_name", -9, 9)).alias("name"))
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return R.by_name(wanted, known).select("c_custkey", F.coalesce("id", F.lit(-1)).alias("id"))


@query(
    """WITH n AS (SELECT 'o' || o_custkey % 50 AS f, o_orderpriority AS t, (o_orderkey % 100) / 100.0 AS confidence FROM orders), e AS (SELECT c_custkey AS id, 'o' || c_custkey % 50 AS name FROM customer), p AS (SELECT DISTINCT o_orderpriority AS name, 1000000 + ascii(o_orderpriority) AS id FROM orders)
    SELECT e.id AS src, p.id AS dst, round(max(confidence), 6)::DOUBLE AS confidence FROM n JOIN e ON e.name = f JOIN p ON p.name = t GROUP BY 1, 2"""
)
def edges_by_name(spark, sf_dir):
    """Edges given by names that several entities share, fanned out to all of them."""
    o = table(spark, sf_dir, "orders")
    named = o.select(F.concat(F.lit("O"), F.col("o_custkey") % 50).alias("from"), F.col("o_orderpriority").alias("to"), F.lit("uses").alias("type"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("o"), F.col("c_custkey") % 50).alias("name"))
    kinds = o.select((F.ascii("o_orderpriority") + 1_000_000).cast("long").alias("id"), F.col("o_orderpriority").alias("name")).distinct()
    return R.edges_by_name(named, people.unionByName(kinds)).select("src", "dst", F.round("confidence", 6).alias("confidence"))


@query(
    """WITH w AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type FROM lineitem), e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, l_returnflag AS type FROM lineitem WHERE l_quantity < 20)
    SELECT CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.src = w.src AND e.dst = w.dst AND e.type = w.type) THEN 'exact' WHEN EXISTS (SELECT 1 FROM e WHERE e.src = w.dst AND e.dst = w.src AND e.type = w.type) THEN 'reversed'
      WHEN EXISTS (SELECT 1 FROM e WHERE e.src = w.src AND e.dst = w.dst) THEN 'other_type' ELSE 'none' END AS found, count(*) AS edges FROM w GROUP BY 1"""
)
def edge_lookups(spark, sf_dir):
    """Part and supplier pairs looked up among those of small lines."""
    of = lambda rows: rows.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("type"))
    l = table(spark, sf_dir, "lineitem")
    got = R.find_edges(of(l).distinct(), of(l.where("l_quantity < 20")))
    return got.groupBy(F.coalesce("found", F.lit("none")).alias("found")).agg(F.count("*").alias("edges"))


_LADDER = (0.50, 0.45, 0.40, 0.35)


@query(
    f"""WITH {_TOP}, c AS (SELECT query, item, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, item) AS k FROM p WHERE NOT same)
    SELECT query, item, round(s, 6) AS similarity, CASE WHEN s >= 0.50 THEN 'matched' WHEN s >= 0.45 THEN 'merged' WHEN s >= 0.40 THEN 'linked_same' WHEN s >= 0.35 THEN 'linked_similar' ELSE 'created' END AS action FROM c WHERE k = 1"""
)
def cross_document_resolution(spark, sf_dir):
    """Each asked vector's nearest one of another document (label), and what becomes of it; the ladder fits these vectors."""
    v = table(spark, sf_dir, "embeddings")
    best = V.nearest(v, v.where(_ASKED), 1, other="label")
    return best.select("query", "item", F.round("score", 6).alias("similarity"), R.action(F.col("score"), _LADDER).alias("action"))


@query(
    f"""WITH RECURSIVE {_TOP}, l AS (SELECT query AS a, item AS b FROM t WHERE position <= 5 AND s >= 0.35), b AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r(id, c) AS (SELECT a, a FROM b UNION SELECT r.id, b.b FROM r JOIN b ON b.a = r.c)
    SELECT vec_id AS id, coalesce(least(vec_id, c), vec_id) AS canonical FROM embeddings LEFT JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) ON id = vec_id"""
)
def canonical_entities(spark, sf_dir):
    """Vectors under their canonical ids, which links from the asked ones make."""
    v = table(spark, sf_dir, "embeddings")
    near = V.nearest(v, v.where(_ASKED), 5, least=0.35)
    return R.canonical(near.select(F.col("query").alias("a"), F.col("item").alias("b")), v.select(F.col("vec_id").alias("id")))


@query(
    """WITH x AS (SELECT p_brand AS canonical, p_partkey AS id, p_name AS name, p_type AS description, p_size AS doc, p_retailprice AS confidence FROM part)
    SELECT canonical, arg_min(name, id) AS name, arg_max(description, (length(description), id)) AS description, array_to_string(list_sort(list_distinct(list(doc))), ',') AS docs, round(avg(confidence), 4) AS confidence, count(*) AS mentions FROM x GROUP BY 1"""
)
def merged_entities(spark, sf_dir):
    """Parts merged into their brands."""
    x = table(spark, sf_dir, "part").select(F.col("p_brand").alias("canonical"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.col("p_size").alias("doc"), F.col("p_retailprice").alias("confidence"), F.lit(1).alias("mentions"))
    return R.merged(x).select("canonical", "name", "description", F.array_join("docs", ",").alias("docs"), F.round("confidence", 4).alias("confidence"), "mentions")


@query(
    f"""WITH {_TOP}, l AS (SELECT query AS a, item AS b, CASE WHEN s >= 0.40 THEN 'SAME_AS' ELSE 'SIMILAR_TO' END AS type, s FROM t WHERE position <= 20 AND s >= 0.35), o AS (SELECT id, other, type, max(s) AS s FROM (SELECT a AS id, b AS other, type, s FROM l UNION ALL SELECT b, a, type, s FROM l) GROUP BY 1, 2, 3)
    SELECT id, other, type, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id, type ORDER BY round(s, 9) DESC, other) AS place FROM o) WHERE place <= 20"""
)
def related_entities(spark, sf_dir):
    """What each entity is linked with as the same or as similar."""
    v = table(spark, sf_dir, "embeddings")
    near = V.nearest(v, v.where(_ASKED), 20, least=0.35)
    links = near.select(F.col("query").alias("src"), F.col("item").alias("dst"), F.when(F.col("score") >= 0.40, "SAME_AS").otherwise("SIMILAR_TO").alias("type"), F.round("score", 9).alias("confidence"))
    return R.related(links, similar=True).select("id", "other", "type", "place")


@query()
def near_pairs(spark, sf_dir):
    """Pairs of similar vectors of different labels, by bands of signs."""
    return R.near_pairs(table(spark, sf_dir, "embeddings"), 0.45, 6, 60, group="label").withColumn("similarity", F.round("similarity", 6))
