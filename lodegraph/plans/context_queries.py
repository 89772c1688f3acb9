"""Queries on contexts of graph sections, relations against true ones, exports and removals."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import exports as X
from lodegraph.operators import graph as G
from lodegraph.operators import graph_context as C
from lodegraph.operators import relation_eval as R
from lodegraph.operators.ranking import best_of
from lodegraph.plans.registry import query
from lodegraph.plans.views import EDGES, VERTICES, edges, vertices
from lodegraph.sources.tables import scratch_path, table, written

# a nation is a query: its suppliers and customers are its entities, documents are dealt to nations by their id
_PEOPLE = "pe AS (SELECT s_nationkey AS query, s_name AS name, 'supplier' AS type, NULL AS description, round(greatest(s_acctbal, 0) / 10000, 4) AS importance FROM supplier UNION ALL SELECT c_nationkey, c_name, 'customer', c_mktsegment, round(greatest(c_acctbal, 0) / 10000, 4) FROM customer)"
_CONTEXT = f"""WITH {_PEOPLE}, el AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY importance DESC, name) AS place, '**' || name || '** (' || type || ')' || CASE WHEN importance > 0.7 THEN ' [Key Entity]' WHEN importance > 0.5 THEN ' [Important]' ELSE '' END || coalesce(' : ' || description, '') AS line FROM pe),
rl AS (SELECT s_nationkey AS query, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place, '- ' || s_name || ' --[PART_OF]--> ' || n_name AS line FROM supplier JOIN nation ON n_nationkey = s_nationkey),
pl AS (SELECT doc_id % 25 AS query, row_number() OVER (PARTITION BY doc_id % 25 ORDER BY n_chars DESC, doc_id) AS place, coalesce(source, 'Unknown') || CASE WHEN doc_id % 3 > 0 THEN ' (Page ' || doc_id % 3 || ')' ELSE '' END || chr(10) || left(coalesce(text, ''), 40) AS t FROM documents),
ke AS (SELECT DISTINCT s_suppkey % 7 AS community, lower(s_name) AS name FROM supplier), ks AS (SELECT community, count(*) AS n FROM ke GROUP BY 1), cs AS (SELECT query, community, count(*) / any_value(n) AS relevance FROM (SELECT DISTINCT query, lower(name) AS name FROM pe) JOIN ke USING (name) JOIN ks USING (community) GROUP BY ALL),
cl AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, community) AS place, '### Group ' || community || ' (' || n || ' entities)' || chr(10) || 'Suppliers of rest ' || community AS line FROM cs JOIN ks USING (community)),
se AS (SELECT query, 0 AS i, '## Relevant Entities' || chr(10) || string_agg(line, chr(10) ORDER BY place) AS t FROM el WHERE place <= 10 GROUP BY 1 UNION ALL SELECT query, 1, '## Relationships' || chr(10) || string_agg(line, chr(10) ORDER BY place) FROM rl WHERE place <= 30 GROUP BY 1
  UNION ALL SELECT query, 2, '## Source Documents' || chr(10) || string_agg('### Source ' || place || ': ' || t, chr(10) || chr(10) ORDER BY place) FROM pl WHERE place <= 2 GROUP BY 1 UNION ALL SELECT query, 3, '## Knowledge Community Insights' || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY place) FROM cl WHERE place <= 3 GROUP BY 1)
SELECT query::BIGINT AS query, md5(string_agg(t, chr(10) || chr(10) ORDER BY i)) AS context FROM se GROUP BY 1"""


@query(_CONTEXT)
def graph_contexts(spark, sf_dir):
    """What a model is given for each nation: its entities, their relations, documents and the communities that they are of."""
    s, c, n, d = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation", "documents"))
    worth = lambda x: F.round(F.greatest(F.col(x), F.lit(0.0)) / 10000, 4).alias("importance")
    people = s.select(F.col("s_nationkey").alias("query"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.lit(None).cast("string").alias("description"), worth("s_acctbal"))
    people = people.unionByName(c.select(F.col("c_nationkey").alias("query"), F.col("c_name").alias("name"), F.lit("customer").alias("type"), F.col("c_mktsegment").alias("description"), worth("c_acctbal")))
    relations = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("query"), F.col("s_suppkey").alias("place"), F.col("s_name").alias("src"), F.lit("PART_OF").alias("type"), F.col("n_name").alias("dst"))
    texts = d.select((F.col("doc_id") % 25).cast("int").alias("query"), "doc_id", "n_chars", "source", (F.col("doc_id") % 3).alias("page"), F.substring("text", 1, 40).alias("content"))
    passages = best_of(texts, ["query"], 2, [F.desc("n_chars"), F.col("doc_id")], F.col("doc_id"))
    groups = s.select((F.col("s_suppkey") % 7).alias("community"), F.col("s_name").alias("name"))
    known = groups.groupBy("community").agg(F.count("*").alias("size")).select("community", F.concat(F.lit("Group "), "community").alias("title"), "size", F.concat(F.lit("Suppliers of rest "), "community").alias("summary"))
    return C.graph_context(people, relations, passages, known, groups).select(F.col("query").cast("long").alias("query"), F.md5("context").alias("context"))


# lines are relations of an order: extracted ones lack small quantities and are turned round or of another type at times
_LINES = """l AS (SELECT DISTINCT l_orderkey AS item, 'Part ' || l_partkey AS p, 'Firm ' || l_suppkey AS s, l_returnflag AS type FROM lineitem), t AS (SELECT item, p AS src, s AS dst, type, item * 1000 + row_number() OVER (PARTITION BY item ORDER BY p, s, type) AS j FROM l),
x AS (SELECT item, CASE WHEN j % 5 = 0 THEN dst ELSE src END AS src, CASE WHEN j % 5 = 0 THEN src ELSE dst END AS dst, CASE WHEN j % 7 = 0 THEN 'Z' ELSE type END AS type, j AS i, j % 5 = 0 AS turned FROM t WHERE j % 3 > 0)"""


def _relations(spark, sf_dir):
    from pyspark.sql import Window

    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit("Part "), "l_partkey").alias("p"), F.concat(F.lit("Firm "), "l_suppkey").alias("s"), F.col("l_returnflag").alias("type")).distinct()
    j = F.col("item") * 1000 + F.row_number().over(Window.partitionBy("item").orderBy("p", "s", "type"))
    t = written(l.select("item", F.col("p").alias("src"), F.col("s").alias("dst"), "type", j.alias("j")))
    turned = F.col("j") % 5 == 0
    x = t.where(F.col("j") % 3 > 0).select("item", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"), F.when(F.col("j") % 7 == 0, "Z").otherwise(F.col("type")).alias("type"), F.col("j").alias("i"))
    return x, t


_RATIOS = "CASE WHEN n > 0 THEN tp / n ELSE 0 END AS p, CASE WHEN t > 0 THEN tp / t ELSE 0 END AS r"


@query(
    f"""WITH {_LINES}, m AS (SELECT x.type, count(*) AS tp, count(*) FILTER (NOT turned) AS good FROM x JOIN t ON t.j = x.i AND t.type = x.type GROUP BY 1), a AS (SELECT type, count(*) AS n FROM x GROUP BY 1), b AS (SELECT type, count(*) AS t FROM t GROUP BY 1),
    s AS (SELECT *, {_RATIOS} FROM (SELECT coalesce(a.type, b.type) AS type, coalesce(n, 0) AS n, coalesce(t, 0) AS t, coalesce(tp, 0) AS tp, coalesce(good, 0) AS good FROM a FULL JOIN b ON a.type = b.type LEFT JOIN m ON m.type = coalesce(a.type, b.type)))
    SELECT type, tp, n - tp AS fp, t - tp AS fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(CASE WHEN tp > 0 THEN good / tp ELSE 0 END, 6) AS direction_accuracy FROM s"""
)
def relation_scores(spark, sf_dir):
    """Relations of order lines by type, matched whichever way round they are."""
    x, t = _relations(spark, sf_dir)
    got = R.scores(x, t, R.matches(x, t, "direction_agnostic", 0.999), ["type"])
    return got.select("type", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "direction_accuracy")])


@query(
    f"""WITH {_LINES}, m AS (SELECT item, count(*) AS tp FROM x JOIN t USING (item, src, dst, type) GROUP BY 1), a AS (SELECT item, count(*) AS n FROM x GROUP BY 1), b AS (SELECT item, count(*) AS t FROM t GROUP BY 1),
    s AS (SELECT *, {_RATIOS} FROM (SELECT item, coalesce(n, 0) AS n, t, coalesce(tp, 0) AS tp FROM b LEFT JOIN a USING (item) LEFT JOIN m USING (item))), z AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM s)
    SELECT count(*) AS items, round(sum(tp) / sum(n), 6) AS micro_precision, round(sum(tp) / sum(t), 6) AS micro_recall, round(2 * sum(tp) / (sum(n) + sum(t)), 6) AS micro_f1, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1 FROM z"""
)
def relation_batch(spark, sf_dir):
    """The same strictly, over all orders: micro and macro means."""
    x, t = _relations(spark, sf_dir)
    got = R.batch(R.scores(x, t, R.matches(x, t, "strict"), ["item"]))
    return got.select("items", *[F.round(c, 6).alias(c) for c in got.columns if c != "items"])


@query(f"SELECT id, name AS label, type, CASE WHEN type = 'part' THEN 'a \"' || name || '\", of parts' END AS description FROM ({VERTICES})")
def exported_nodes(spark, sf_dir):
    """The graph's nodes, written as CSV and read back."""
    told = F.when(F.col("type") == "part", F.concat(F.lit('a "'), "name", F.lit('", of parts')))
    nodes = vertices(spark, sf_dir).select("id", F.col("name").alias("label"), "type", told.alias("description"))
    links = edges(spark, sf_dir).select(F.concat_ws(">", "src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("label"))
    X.write_graph(nodes, links, path := scratch_path(spark), "csv")
    return X.read_graph(spark, path)[0].select("id", "label", "type", "description")


@query(f"SELECT src AS source, dst AS target, type AS label, count(*) AS edges FROM ({EDGES}) GROUP BY ALL")
def exported_edges(spark, sf_dir):
    """The graph's edges, written as JSON lines, read back and counted by their ends."""
    links = edges(spark, sf_dir).select(F.concat_ws(">", "src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("type").alias("label"))
    X.write_graph(vertices(spark, sf_dir).select("id", F.col("name").alias("label"), "type"), links, path := scratch_path(spark), "json")
    return X.read_graph(spark, path)[1].groupBy("source", "target", "label").agg(F.count("*").alias("edges"))


@query("SELECT event_id, json_object('event_id', event_id, 'event_type', event_type, 'props', CASE WHEN event_id % 4 > 0 THEN props END)::VARCHAR AS line FROM events")
def audit_json_lines(spark, sf_dir):
    """The log as lines of JSON, nulls kept."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("props"))
    return e.select("event_id", X.json_line(["event_id", "event_type", "props"]).alias("line"))


@query(
    f"""WITH e AS ({EDGES}), u AS (SELECT DISTINCT src, dst, type FROM e), b AS (SELECT dst AS seed, type, src AS other FROM u WHERE type = 'PART_OF' UNION ALL SELECT src, type, dst FROM u WHERE type = 'PART_OF'),
    d AS (SELECT dst AS seed, count(DISTINCT src) AS direct FROM u WHERE type = 'PART_OF' GROUP BY 1), k AS (SELECT seed, count(*) AS broken FROM b GROUP BY 1)
    SELECT seed, broken, coalesce(direct, 0) AS direct, CASE WHEN coalesce(direct, 0) > 10 THEN 'notice' WHEN coalesce(direct, 0) > 0 THEN 'info' ELSE 'ok' END AS advice FROM k LEFT JOIN d USING (seed)"""
)
def removal_advice(spark, sf_dir):
    """How many edges the removal of each member of the hierarchy breaks, and what is advised."""
    e = edges(spark, sf_dir).where("type = 'PART_OF'")
    broken = G.broken_edges(e).groupBy("id").agg(F.count("*").alias("broken"))
    direct = e.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("direct"))
    both = broken.join(direct, "id", "left").withColumn("direct", F.coalesce("direct", F.lit(0)).cast("long"))
    return both.select(F.col("id").alias("seed"), "broken", "direct", G.advice(F.col("direct"), F.lit(0)).alias("advice"))
