"""Queries on versions, points in time and change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import temporal as T
from lodegraph.plans.registry import query
from lodegraph.plans.views import VERSIONS, versions
from lodegraph.sources.tables import table

_AT = "1996-01-01"


def _now():
    return F.lit(_AT).cast("timestamp")


@query(f"WITH {VERSIONS} SELECT CASE WHEN superseded_by IS NOT NULL THEN 'superseded' WHEN valid_from > TIMESTAMP '{_AT}' THEN 'pending' WHEN valid_to < TIMESTAMP '{_AT}' THEN 'expired' ELSE 'current' END AS status, count(*) AS versions FROM vs GROUP BY 1")
def temporal_status(spark, sf_dir):
    v = versions(spark, sf_dir)
    return v.groupBy(T.status(F.col("valid_from"), F.col("valid_to"), F.col("superseded_by"), _now()).alias("status")).agg(F.count("*").alias("versions"))


@query(f"WITH {VERSIONS} SELECT entity, version_id FROM vs WHERE valid_from <= TIMESTAMP '{_AT}' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{_AT}')")
def valid_at_closed(spark, sf_dir):
    return versions(spark, sf_dir).where(T.valid_closed(F.col("valid_from"), F.col("valid_to"), _now())).select("entity", "version_id")


@query(f"WITH {VERSIONS} SELECT entity, version_id FROM vs WHERE valid_from <= TIMESTAMP '{_AT}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_AT}')")
def valid_at_halfopen(spark, sf_dir):
    return versions(spark, sf_dir).where(T.valid_half_open(F.col("valid_from"), F.col("valid_to"), _now())).select("entity", "version_id")


@query(f"WITH {VERSIONS} SELECT max(version_sequence) AS longest, round(avg(version_sequence), 6) AS mean_sequence, count(superseded_by) AS superseded, count(*) AS versions FROM vs")
def temporal_summary(spark, sf_dir):
    v = versions(spark, sf_dir)
    return v.agg(F.max("version_sequence").cast("long").alias("longest"), F.round(F.avg("version_sequence"), 6).alias("mean_sequence"), F.count("superseded_by").alias("superseded"), F.count("*").alias("versions"))


@query(f"WITH {VERSIONS} SELECT entity, count(*) AS versions, 0::BIGINT AS bad_sequence, 0::BIGINT AS bad_link, 0::BIGINT AS bad_time, 0::BIGINT AS open_before_last FROM vs GROUP BY entity")
def version_chain_check(spark, sf_dir):
    return T.chain_faults(versions(spark, sf_dir), "entity", "version_id")


@query(
    f"""WITH {VERSIONS}, a AS (SELECT DISTINCT entity FROM vs WHERE valid_from <= TIMESTAMP '1995-01-01'), b AS (SELECT DISTINCT entity FROM vs WHERE valid_from > TIMESTAMP '1995-01-01' AND valid_from <= TIMESTAMP '1998-01-01')
    SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN a.entity IS NULL THEN 'added' WHEN b.entity IS NULL THEN 'removed' ELSE 'persisted' END AS change FROM a FULL JOIN b ON a.entity = b.entity"""
)
def snapshot_compare(spark, sf_dir):
    v = versions(spark, sf_dir)
    return T.compare(v.where("valid_from <= '1995-01-01'"), v.where("valid_from > '1995-01-01' AND valid_from <= '1998-01-01'"), "entity")


@query(
    """WITH s AS (SELECT doc_id, n_chars, md5(coalesce(text, '')) AS hash FROM documents WHERE doc_id % 7 <> 0), x AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS n_chars, md5(coalesce(text, '') || CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE '' END) AS hash FROM documents WHERE doc_id % 10 <> 0)
    SELECT coalesce(s.doc_id, x.doc_id) AS doc_id, CASE WHEN x.doc_id IS NULL THEN 'added' WHEN s.doc_id IS NULL THEN 'deleted' WHEN s.hash <> x.hash OR s.n_chars <> x.n_chars THEN 'modified' ELSE 'unchanged' END AS change,
    CASE WHEN x.doc_id IS NULL THEN 'new' WHEN s.doc_id IS NULL THEN 'missing' WHEN s.hash <> x.hash THEN 'content_hash' WHEN s.n_chars <> x.n_chars THEN 'size' ELSE 'same' END AS reason FROM s FULL JOIN x ON s.doc_id = x.doc_id"""
)
def change_detection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    source = d.where("doc_id % 7 <> 0").select("doc_id", "n_chars", F.md5(text).alias("hash"))
    existing = d.where("doc_id % 10 <> 0").select("doc_id", (F.col("n_chars") + F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)).alias("n_chars"), F.md5(F.concat(text, F.when(F.col("doc_id") % 11 == 0, "x").otherwise(""))).alias("hash"))
    return T.detect_changes(source, existing, "doc_id", [("hash", "content_hash"), ("n_chars", "size")])


@query("SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 AND doc_id % 7 = 0")
def deleted_docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.where("doc_id % 10 <> 0").join(d.where("doc_id % 7 <> 0"), "doc_id", "left_anti")
