"""Queries on delta syncs, change feeds and stored runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators.delta import DeltaTable
from lodegraph.operators.run_store import RunStore, compared
from lodegraph.plans.registry import query
from lodegraph.sources.tables import scratch_path, table
from lodegraph.streaming.feed import points_of
from lodegraph.streaming.twins import _stream

# events stand for changes of items: their type is the source, their user the item; three runs each see what has come by then
_CUTS = (0.5, 0.8, 1.0)


def _synced(spark, sf_dir) -> DeltaTable:
    e = table(spark, sf_dir, "events")
    items = e.select(
        F.col("event_type").alias("source"), F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.timestamp_micros(F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp")))).alias("created"),
        F.col("ts").cast("timestamp").alias("modified"), (F.col("value") > 80).alias("gone"), (F.col("value") < 5).alias("folder"), F.col("value").alias("value"),
    )
    last = e.agg(F.max("event_id")).first()[0] or 0
    made = DeltaTable(spark, scratch_path(spark))
    for cut in _CUTS:
        made.sync(items.where(F.col("seq") <= int(last * cut)))
    return made


_RUNS = """m AS (SELECT max(event_id) AS last FROM events), e AS (SELECT event_type AS source, user_id AS id, event_id AS seq, date_trunc('day', ts) AS created, ts AS modified, value > 80 AS gone, value < 5 AS folder, value,
  CASE WHEN event_id <= floor(last * 0.5) THEN 1 WHEN event_id <= floor(last * 0.8) THEN 2 ELSE 3 END AS run FROM events, m),
l AS (SELECT source, run, max(seq) AS seq, max(modified) AS last, count(*) AS found FROM e GROUP BY ALL), s AS (SELECT source, run, max(last) OVER (PARTITION BY source ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
c AS (SELECT e.*, before FROM e JOIN s USING (source, run) WHERE NOT folder QUALIFY row_number() OVER (PARTITION BY source, run, id ORDER BY seq DESC) = 1),
r AS (SELECT *, CASE WHEN gone THEN 'deleted' WHEN before IS NULL OR created > before THEN 'added' ELSE 'modified' END AS change FROM c)"""


@query(
    f"""WITH {_RUNS}, k AS (SELECT source, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted FROM r GROUP BY 1)
    SELECT source, max(seq) AS "offset", strftime(max(last), '%Y-%m-%d %H:%M:%S') AS last_sync, sum(found)::BIGINT AS found, any_value(added) AS added, any_value(modified) AS modified, any_value(deleted) AS deleted, count(*) AS runs FROM l JOIN k USING (source) GROUP BY 1"""
)
def delta_states(spark, sf_dir):
    """Offsets and counts of every source after three delta syncs."""
    return _synced(spark, sf_dir).states().withColumn("last_sync", F.date_format("last_sync", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {_RUNS} SELECT source, id, seq, value, run AS version, change FROM r QUALIFY row_number() OVER (PARTITION BY source, id ORDER BY run DESC) = 1 AND change <> 'deleted'")
def delta_current(spark, sf_dir):
    """The items that are there after three delta syncs."""
    return _synced(spark, sf_dir).current().select("source", "id", "seq", "value", "version", "change")


@query(
    """WITH f AS (SELECT DISTINCT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'approved' WHEN 'N' THEN 'uploaded' ELSE 'archived' END AS status, CASE WHEN l_suppkey % 4 = 0 THEN 'unknown' ELSE 'u' || l_suppkey END AS who FROM lineitem)
    SELECT who AS "user", sum(CASE status WHEN 'approved' THEN 50 ELSE 10 END)::BIGINT AS points, count(*) AS actions FROM f WHERE who <> 'unknown' AND status <> 'archived' GROUP BY 1"""
)
def feed_points(spark, sf_dir):
    """Points of suppliers from a feed of order lines, of which many repeat an order, a status and a supplier, in no order of time."""
    path = f"{sf_dir}/lineitem.parquet"
    status = F.when(F.col("l_returnflag") == "A", "approved").when(F.col("l_returnflag") == "N", "uploaded").otherwise("archived")
    who = F.when(F.col("l_suppkey") % 4 == 0, "unknown").otherwise(F.concat(F.lit("u"), F.col("l_suppkey")))
    feed = _stream(spark, path).select("l_orderkey", status.alias("status"), who.alias("user"), F.col("l_shipdate").cast("timestamp").alias("ts"))
    return points_of(feed, ["l_orderkey", "status", "user"], "10000 days")


# two runs: customers by nation, and with some nations split, two merged, two renamed, one taken apart and a few members moved
_OLD = "'n' || c_nationkey"
_NEW = "CASE WHEN c_nationkey = 3 THEN CASE WHEN c_custkey % 3 = 0 THEN 'x3' ELSE 'n3' END WHEN c_nationkey = 5 THEN 'n4' WHEN c_nationkey IN (7, 8) THEN 'm' || c_nationkey WHEN c_nationkey = 9 THEN 'n' || (10 + c_custkey % 7) WHEN c_nationkey > 20 AND c_custkey % 9 = 0 THEN 'y' || c_custkey % 2 ELSE 'n' || c_nationkey END"


def _stored(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    store = RunStore(spark, scratch_path(spark))
    for name, created, to in (("r0", "2024-01-01", "'all'"), ("r1", "2024-02-01", _OLD), ("r2", "2024-03-01", _NEW)):
        store.store(name, created, c.selectExpr("c_custkey AS id", f"{to} AS community"))
    store.retain(2)
    return store


@query(
    f"""WITH RECURSIVE a AS (SELECT c_custkey AS id, {_OLD} AS old, {_NEW} AS new FROM customer), so AS (SELECT old, count(*) AS old_size FROM a GROUP BY 1), sn AS (SELECT new, count(*) AS new_size FROM a GROUP BY 1),
    p AS (SELECT *, row_number() OVER (ORDER BY common DESC, old, new) AS k FROM (SELECT old, new, count(*) AS common FROM a GROUP BY ALL) JOIN so USING (old) JOIN sn USING (new)),
    g AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS olds, []::VARCHAR[] AS news UNION ALL SELECT p.k, CASE WHEN free THEN list_append(olds, old) ELSE olds END, CASE WHEN free THEN list_append(news, new) ELSE news END
      FROM (SELECT p.*, olds, news, NOT list_contains(olds, old) AND NOT list_contains(news, new) AS free FROM g JOIN p ON p.k = g.k + 1) p),
    z AS (SELECT * FROM g ORDER BY k DESC LIMIT 1), mt AS (SELECT unnest(olds) AS old, unnest(news) AS new FROM z),
    f AS (SELECT old, new, CASE WHEN common = old_size AND common = new_size THEN CASE WHEN old = new THEN 'same' ELSE 'renamed' END ELSE 'changed' END AS change FROM mt JOIN p USING (old, new)),
    n AS (SELECT new, CASE WHEN common >= 0.3 * new_size THEN old END AS old FROM p WHERE new NOT IN (SELECT new FROM mt) QUALIFY row_number() OVER (PARTITION BY new ORDER BY common DESC, old) = 1),
    o AS (SELECT old, CASE WHEN common >= 0.3 * old_size THEN new END AS new FROM p WHERE old NOT IN (SELECT old FROM mt) QUALIFY row_number() OVER (PARTITION BY old ORDER BY common DESC, new) = 1)
    SELECT * FROM f UNION ALL SELECT old, new, CASE WHEN old IS NULL THEN 'new' ELSE 'split' END FROM n UNION ALL SELECT old, new, CASE WHEN new IS NULL THEN 'gone' ELSE 'merged' END FROM o"""
)
def community_changes(spark, sf_dir):
    """What became of the communities of a stored run in the next one."""
    store = _stored(spark, sf_dir)
    return compared(store.members("r1"), store.members())


@query(f"SELECT 'r2' AS run_id, {_NEW} AS community, count(*) AS size FROM customer GROUP BY ALL HAVING count(*) >= 3")
def latest_communities(spark, sf_dir):
    """The communities of the run stored last with three members or more."""
    return _stored(spark, sf_dir).communities(least=3)


@query(f"SELECT 'r' || k AS run_id, count(DISTINCT c) AS communities, count(*) AS nodes FROM (SELECT 1 AS k, {_OLD} AS c FROM customer UNION ALL SELECT 2, {_NEW} FROM customer) GROUP BY k")
def stored_runs(spark, sf_dir):
    """The runs that retention has left."""
    return _stored(spark, sf_dir).snapshots().select("run_id", "communities", "nodes")
