"""Queries on the graph at a point in time, on new versions and on temporal fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import graph as G
from lodegraph.operators import history as H
from lodegraph.operators import temporal as T
from lodegraph.plans.registry import query
from lodegraph.plans.views import VERSIONS, versions
from lodegraph.sources.tables import table

_AT = "1996-01-01"


def _now():
    return F.lit(_AT).cast("timestamp")


def _order_edges(spark, sf_dir):
    """Customer to order edges that hold from the order until its last shipment."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("valid_to"))
    return o.join(l, "o_orderkey", "left").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("PLACED").alias("type"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.col("valid_to").cast("timestamp").alias("valid_to"))


_EDGES = "oe AS (SELECT o_custkey AS src, o_orderkey AS dst, o_orderdate AS valid_from, valid_to FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS valid_to FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"
_ALIVE = f"valid_from <= TIMESTAMP '{_AT}' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{_AT}')"


@query(
    f"""WITH {VERSIONS}, a AS (SELECT version_id AS id FROM vs WHERE {_ALIVE}), x AS (SELECT DISTINCT supersedes AS src, version_id AS dst FROM vs WHERE supersedes IS NOT NULL AND valid_from <= TIMESTAMP '{_AT}'
    UNION SELECT version_id, version_id FROM vs WHERE valid_from <= TIMESTAMP '{_AT}') SELECT (SELECT count(*) FROM a) AS entities, (SELECT count(*) FROM x WHERE src IN (SELECT id FROM a) AND dst IN (SELECT id FROM a)) AS edges"""
)
def snapshot_size(spark, sf_dir):
    """Versions that are valid at an instant and the edges between them."""
    v = versions(spark, sf_dir).withColumn("id", F.col("version_id"))
    links = F.array(F.struct(F.col("supersedes").alias("src"), F.col("id").alias("dst"), F.lit("FOLLOWS").alias("type")), F.struct(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("IS").alias("type")))
    e = v.select(F.explode(links).alias("x"), F.col("valid_from").alias("created_at")).select("x.*", "created_at").where("src IS NOT NULL")
    alive, known = H.snapshot(v, e, _now())
    return alive.agg(F.count("*").alias("entities")).join(known.agg(F.count("*").alias("edges")))  # two rows


@query(
    f"""WITH {_EDGES}, b AS (SELECT src AS id, 'out' AS way, dst AS neighbour, valid_from FROM oe WHERE {_ALIVE} UNION ALL SELECT dst, 'in', src, valid_from FROM oe WHERE {_ALIVE})
    SELECT id, way, neighbour, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id, way ORDER BY valid_from DESC, neighbour) AS place FROM b) WHERE place <= 20"""
)
def neighbours_at(spark, sf_dir):
    return H.neighbours_at(_order_edges(spark, sf_dir), _now())


@query(
    f"""WITH RECURSIVE {_EDGES}, l AS (SELECT 'n:' || c_nationkey AS a, 'c:' || c_custkey AS b FROM customer UNION SELECT 'c:' || src, 'o:' || dst FROM oe WHERE {_ALIVE}),
    r(seed, id, hops) AS (SELECT 'n:' || n_nationkey, 'n:' || n_nationkey, 0 FROM nation UNION SELECT r.seed, l.b, r.hops + 1 FROM r JOIN l ON l.a = r.id WHERE r.hops < 2) SELECT seed, hops, count(*) AS reached FROM r WHERE hops > 0 GROUP BY 1, 2"""
)
def traversal_at(spark, sf_dir):
    """What each nation reaches over its customers' orders that are open at an instant."""
    alive = _order_edges(spark, sf_dir).where(T.valid_closed(F.col("valid_from"), F.col("valid_to"), _now()))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, sf_dir, "customer").select(name("n:", "c_nationkey").alias("src"), name("c:", "c_custkey").alias("dst")).union(alive.select(name("c:", "src"), name("o:", "dst"))).withColumn("type", F.lit("HAS"))
    got = G.reach(e, table(spark, sf_dir, "nation").select(name("n:", "n_nationkey").alias("id")), 2)
    return got.groupBy("seed", "hops").agg(F.count("*").alias("reached"))


@query(
    f"""WITH {VERSIONS}, u AS (SELECT c_custkey AS entity, 1000000000 + c_custkey AS new FROM customer WHERE c_acctbal < 0), c AS (SELECT vs.entity, version_id, version_sequence, CASE WHEN new IS NOT NULL AND valid_to IS NULL THEN new ELSE superseded_by END AS superseded_by,
      (CASE WHEN new IS NOT NULL AND valid_to IS NULL THEN TIMESTAMP '2000-01-01' ELSE valid_to END) AS valid_to FROM vs LEFT JOIN u USING (entity)),
    n AS (SELECT u.entity, new AS version_id, coalesce(o.version_sequence, 0) + 1 AS version_sequence, NULL::BIGINT AS superseded_by, NULL::TIMESTAMP AS valid_to FROM u LEFT JOIN (SELECT * FROM vs WHERE valid_to IS NULL) o USING (entity))
    SELECT entity, version_id, version_sequence::INT AS version_sequence, coalesce(superseded_by, 0) AS superseded_by, strftime(valid_to, '%Y-%m-%d') AS ends FROM (SELECT * FROM c UNION ALL SELECT * FROM n)"""
)
def new_versions(spark, sf_dir):
    """A new version of every customer in debt, opened at one instant."""
    v = versions(spark, sf_dir).select("entity", "version_id", "version_sequence", "valid_from", "valid_to", "supersedes", "superseded_by")
    u = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("entity"), (F.col("c_custkey") + 1_000_000_000).alias("version_id"))
    rows, _ = H.with_new_versions(v, u, "entity", F.lit("2000-01-01").cast("timestamp"))
    return rows.select("entity", "version_id", "version_sequence", F.coalesce("superseded_by", F.lit(0)).alias("superseded_by"), F.date_format("valid_to", "yyyy-MM-dd").alias("ends"))


@query(
    """WITH x AS (SELECT l_orderkey AS entity, l_linenumber, l_shipdate, lag(l_shipdate) OVER w AS prior, lag(l_linenumber) OVER w AS pl, lag(l_suppkey) OVER w AS ps, l_partkey, lag(l_partkey) OVER w AS pp, l_suppkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
    SELECT entity, count(*) AS versions, count(*) FILTER (pl >= l_linenumber) AS bad_sequence, count(*) FILTER (pp <> l_suppkey) AS bad_link, count(*) FILTER (prior > l_shipdate) AS bad_time, count(*) FILTER (pl IS NOT NULL AND prior < TIMESTAMP '1995-01-01') AS open_before_last FROM x GROUP BY entity"""
)
def shipment_chain_faults(spark, sf_dir):
    """An order's lines taken as a chain of versions: lines out of order in time, wrong links and open ends are faults."""
    l = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("entity"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("version_sequence"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("version_id"), F.col("l_suppkey").alias("supersedes"),
        F.col("l_shipdate").cast("timestamp").alias("valid_from"), F.when(F.col("l_shipdate").cast("timestamp") >= F.lit("1995-01-01").cast("timestamp"), F.col("l_shipdate").cast("timestamp")).alias("valid_to"),
    )
    return T.chain_faults(l, "entity", "version_id", "line")


@query(
    """SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'valid_from' END, CASE WHEN l_quantity <= 45 AND l_shipdate::DATE >= o_orderdate::DATE + 60 THEN 'order' END, CASE WHEN l_returnflag = 'N' THEN 'status' END, CASE WHEN l_linenumber - 2 < 1 THEN 'sequence' END], lambda x: x IS NOT NULL), ',') AS errors
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
)
def temporal_field_errors(spark, sf_dir):
    """Lines as entities with temporal fields, of which some are malformed."""
    x = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    start = F.when(F.col("l_quantity") > 45, F.date_format("l_shipdate", "dd/MM/yyyy")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    state = F.when(F.col("l_returnflag") == "N", "unknown").otherwise("current")
    errors = H.field_errors(start, F.date_format(F.date_add(F.to_date("o_orderdate"), 60), "yyyy-MM-dd"), state, F.col("l_linenumber") - 2)
    return x.select("l_orderkey", "l_linenumber", F.array_join(errors, ",").alias("errors"))


@query(f"WITH {VERSIONS} SELECT version_id, coalesce(floor(epoch_ms(valid_to - valid_from) / 86400000.0)::BIGINT, -1) AS days, valid_to IS NULL AS open FROM (SELECT version_id, valid_from, valid_to FROM vs)".replace("epoch_ms(valid_to - valid_from)", "(epoch_ms(valid_to) - epoch_ms(valid_from))"))
def validity_durations(spark, sf_dir):
    d = versions(spark, sf_dir).select("version_id", H.duration(F.col("valid_from"), F.col("valid_to")).alias("d"))
    return d.select("version_id", F.coalesce("d.days", F.lit(-1)).alias("days"), "d.open")


@query(
    """WITH s AS (SELECT l_orderkey AS id, max(l_shipdate) AS m, md5(min(l_returnflag)) AS h, count(*) AS z, min(l_linestatus) AS v FROM lineitem GROUP BY 1), x AS (SELECT l_orderkey AS id, max(l_shipdate) AS m, md5(min(l_returnflag)) AS h, count(*) AS z, min(l_linestatus) AS v FROM lineitem WHERE l_quantity < 47 GROUP BY 1)
    SELECT id, reason, CASE reason WHEN 'new' THEN 'added' WHEN 'missing' THEN 'deleted' WHEN 'same' THEN 'unchanged' ELSE 'modified' END AS change FROM (SELECT coalesce(s.id, x.id) AS id,
      CASE WHEN x.id IS NULL THEN 'new' WHEN s.id IS NULL THEN 'missing' WHEN s.m > x.m THEN 'mtime' WHEN s.h <> x.h THEN 'hash' WHEN s.z <> x.z THEN 'size' WHEN s.v <> x.v THEN 'version' ELSE 'same' END AS reason FROM s FULL JOIN x ON s.id = x.id)"""
)
def source_changes(spark, sf_dir):
    """Orders as their source has them now against a copy that lacks their largest lines."""
    of = lambda rows: rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_shipdate").alias("mtime"), F.md5(F.min("l_returnflag")).alias("hash"), F.count("*").alias("size"), F.min("l_linestatus").alias("version"))
    l = table(spark, sf_dir, "lineitem")
    return H.change(of(l), of(l.where("l_quantity < 47")), "id")
