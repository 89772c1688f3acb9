"""Views that stand for the library's data model on the driver tables, in Spark and as SQL for DuckDB."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.sources.tables import table

_NODES = (("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name"))
_EDGES = (
    ("nation", "n", "n_nationkey", "r", "n_regionkey", "PART_OF"), ("customer", "c", "c_custkey", "n", "c_nationkey", "PART_OF"), ("supplier", "s", "s_suppkey", "n", "s_nationkey", "PART_OF"),
    ("orders", "o", "o_orderkey", "c", "o_custkey", "DEPENDS_ON"), ("lineitem", "o", "l_orderkey", "p", "l_partkey", "USES"), ("lineitem", "p", "l_partkey", "s", "l_suppkey", "REQUIRES"),
)


def vertices(spark, sf_dir: str) -> DataFrame:
    """(id, name, type) of regions, nations, customers, suppliers, parts and orders."""
    made = [table(spark, sf_dir, t).select(F.concat(F.lit(f"{p}:"), F.col(k).cast("string")).alias("id"), F.col(n).alias("name"), F.lit(t).alias("type")) for t, p, k, n in _NODES]
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("name"), F.lit("orders").alias("type"))
    return reduce(DataFrame.unionByName, [*made, orders])


def edges(spark, sf_dir: str) -> DataFrame:
    """(src, dst, type, confidence): confidence follows from the keys; lineitem gives parallel edges."""
    made = []
    for t, p, k, q, other, kind in _EDGES:
        confidence = F.pmod(F.col(k).cast("long") * 7 + F.col(other).cast("long") * 13, F.lit(50)) / 100.0 + 0.5
        made.append(table(spark, sf_dir, t).select(F.concat(F.lit(f"{p}:"), F.col(k).cast("string")).alias("src"), F.concat(F.lit(f"{q}:"), F.col(other).cast("string")).alias("dst"), F.lit(kind).alias("type"), confidence.alias("confidence")))
    return reduce(DataFrame.unionByName, made)


VERTICES = " UNION ALL ".join([f"SELECT '{p}:' || {k} AS id, {n} AS name, '{t}' AS type FROM {t}" for t, p, k, n in _NODES] + ["SELECT 'o:' || o_orderkey, 'Order ' || o_orderkey, 'orders' FROM orders"])
EDGES = " UNION ALL ".join(f"SELECT '{p}:' || {k} AS src, '{q}:' || {o} AS dst, '{kind}' AS type, (({k}::BIGINT * 7 + {o}::BIGINT * 13) % 50) / 100.0 + 0.5 AS confidence FROM {t}" for t, p, k, q, o, kind in _EDGES)
GRAPH = f"WITH RECURSIVE v AS ({VERTICES}), e AS ({EDGES})"


def versions(spark, sf_dir: str) -> DataFrame:
    """Each customer's orders as a chain of versions of the customer."""
    from lodegraph.operators.temporal import versions as chain

    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderkey").alias("version_id"))
    return chain(orders, "entity", ["at", "version_id"])


VERSIONS = """vs AS (SELECT o_custkey AS entity, o_orderkey AS version_id, row_number() OVER w AS version_sequence, o_orderdate AS valid_from,
  lead(o_orderdate) OVER w AS valid_to, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def secured(spark, sf_dir: str) -> DataFrame:
    """Documents with classification, groups, owner, viewers and department that follow from their columns."""
    d = table(spark, sf_dir, "documents")
    level = F.element_at(F.array(*[F.lit(x) for x in ("public", "internal", "confidential", "restricted")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    groups = F.when(F.pmod("doc_id", F.lit(5)) == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("g"), F.pmod("doc_id", F.lit(5)).cast("string"))))
    return d.select(
        "doc_id", "source", "n_chars", level.alias("classification"), groups.alias("allowed_groups"), F.when(F.pmod("doc_id", F.lit(6)) == 0, F.lit("u1")).alias("owner"),
        F.when(F.pmod("doc_id", F.lit(12)) == 0, F.array(F.lit("u2"))).alias("viewers"), F.when(F.pmod("doc_id", F.lit(7)) == 0, F.col("source")).alias("department"),
    )


SECURED = """sd AS (SELECT doc_id, source, n_chars, ['public','internal','confidential','restricted'][doc_id % 4 + 1] AS classification,
  CASE WHEN doc_id % 5 = 0 THEN [] ELSE ['g' || (doc_id % 5)] END AS allowed_groups, CASE WHEN doc_id % 6 = 0 THEN 'u1' END AS owner,
  CASE WHEN doc_id % 12 = 0 THEN ['u2'] END AS viewers, CASE WHEN doc_id % 7 = 0 THEN source END AS department FROM documents)"""
DECIDED = """dd AS (SELECT *, CASE WHEN classification IN ('confidential', 'restricted') THEN 'classification_denied'
  WHEN len(allowed_groups) > 0 AND NOT list_has_any(allowed_groups, ['g1','g2']) THEN 'group_denied'
  WHEN owner IS NOT NULL AND owner <> 'u2' AND viewers IS NOT NULL AND NOT list_contains(viewers, 'u2') THEN 'ownership_denied'
  WHEN department IS NOT NULL AND department <> 'src3' THEN 'department_denied' ELSE 'granted' END AS reason FROM sd)"""
