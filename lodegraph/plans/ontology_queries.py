"""Queries on types, relations and their constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import ontology as O
from lodegraph.plans.registry import query
from lodegraph.plans.views import GRAPH, VERSIONS, VERTICES, edges, versions, vertices
from lodegraph.sources.tables import table

#: Classes that stand for the tables, and relations for the edges between them.
_TYPES = {"region": "Department", "nation": "Department", "customer": "Stakeholder", "supplier": "Role", "part": "System", "orders": "Document"}
_RELATIONS = {"PART_OF": "REPORTS_TO", "DEPENDS_ON": "OWNS", "USES": "USES", "REQUIRES": "INTEGRATES_WITH"}
_case = lambda column, names: "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
_map = lambda column, names: F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col(column))
_PARENTS = "pa(type, parent) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in O.PARENTS.items()) + ")"
_CLOSED = f"{_PARENTS}, cl(type, ancestor, depth) AS (SELECT type, type, 0 FROM (SELECT type FROM pa UNION SELECT parent FROM pa) UNION ALL SELECT cl.type, pa.parent, cl.depth + 1 FROM cl JOIN pa ON pa.type = cl.ancestor)"


def typed(spark, sf_dir):
    return vertices(spark, sf_dir).select("id", _map("type", _TYPES).alias("type"))


@query(f"{GRAPH}, {_CLOSED}, t AS (SELECT id, {_case('type', _TYPES)} AS type FROM v) SELECT ancestor, depth::INT AS depth, count(*) AS vertices FROM t JOIN cl USING (type) GROUP BY 1, 2")
def vertices_by_class(spark, sf_dir):
    """Vertices of each class, those of its subclasses included."""
    closed = O.closure(O.classes(spark))
    return typed(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n")).join(F.broadcast(closed), "type").groupBy("ancestor", "depth").agg(F.sum("n").alias("vertices"))


@query(
    f"""{GRAPH}, {_CLOSED}, rel(relation, domain, range) AS (VALUES {", ".join(f"('{k}', '{a}', '{b}')" for k, (a, b) in O.RELATIONS.items())}), t AS (SELECT id, {_case('type', _TYPES)} AS type FROM v),
    x AS (SELECT {_case('e.type', _RELATIONS)} AS type, e.confidence, s.type AS st, d.type AS dt FROM e JOIN t s ON s.id = e.src JOIN t d ON d.id = e.dst),
    y AS (SELECT x.*, NOT EXISTS (SELECT 1 FROM cl WHERE cl.type = st AND ancestor = domain) AS dom, NOT EXISTS (SELECT 1 FROM cl WHERE cl.type = dt AND ancestor = range) AS ran FROM x JOIN rel ON rel.relation = x.type)
    SELECT type, CASE WHEN dom AND ran THEN 'DOMAIN_VIOLATION,RANGE_VIOLATION' WHEN dom THEN 'DOMAIN_VIOLATION' WHEN ran THEN 'RANGE_VIOLATION' ELSE '' END AS warnings, count(*) AS edges,
      round(avg(confidence * CASE WHEN dom AND ran THEN 0.7 WHEN dom OR ran THEN 0.85 ELSE 1.0 END), 6) AS adjusted FROM y GROUP BY 1, 2"""
)
def relation_validation(spark, sf_dir):
    """Edges against the constraints of their relations: warnings and the confidence that is left."""
    e = edges(spark, sf_dir).withColumn("type", _map("type", _RELATIONS))
    found = O.validated(e, typed(spark, sf_dir), O.relations(spark), O.closure(O.classes(spark)))
    return found.groupBy("type", F.array_join("warnings", ",").alias("warnings")).agg(F.count("*").alias("edges"), F.round(F.avg("adjusted"), 6).alias("adjusted"))


@query(f"WITH {_PARENTS}, n AS (SELECT DISTINCT c_mktsegment AS name FROM customer) SELECT name, type AS suggestion, levenshtein(lower(name), lower(type))::INT AS distance FROM n JOIN pa ON levenshtein(lower(name), lower(type)) <= 7")
def type_suggestions(spark, sf_dir):
    """Classes whose names are near those of the market segments."""
    return O.suggestions(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")), O.classes(spark), 7)


@query(
    f"""WITH RECURSIVE {VERSIONS}, r AS (SELECT version_id AS t, superseded_by AS n FROM vs WHERE superseded_by IS NOT NULL), c(type, final, steps) AS (SELECT t, n, 1 FROM r UNION ALL SELECT c.type, r.n, c.steps + 1 FROM c JOIN r ON r.t = c.final WHERE c.steps < 5)
    SELECT type, final, steps, false AS cyclic FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY steps DESC) AS k FROM c) WHERE k = 1"""
)
def replacement_chains(spark, sf_dir):
    """What each superseded version has been replaced by in the end, five steps on at most."""
    replaced = versions(spark, sf_dir).where("superseded_by IS NOT NULL").select(F.col("version_id").alias("type"), F.col("superseded_by").alias("replacement"))
    return O.replacement_chains(replaced)


@query("SELECT page_id, regexp_extract(url, '([^#/:]*)$', 1) AS name FROM pages")
def url_local_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", O.local_name(F.col("url")).alias("name"))


@query(f"WITH RECURSIVE {_CLOSED} SELECT t.ancestor AS root, t.type, t.depth::INT AS depth, t.type NOT IN (SELECT parent FROM pa) AS leaf, count(v.id) AS vertices FROM cl t LEFT JOIN (SELECT id, {_case('type', _TYPES)} AS type FROM ({VERTICES})) v ON v.type = t.type GROUP BY 1, 2, 3, 4")
def subtype_members(spark, sf_dir):
    """Every class with the classes below it, and how many vertices each of those has."""
    tree = O.subtypes(O.closure(O.classes(spark)))
    counts = typed(spark, sf_dir).groupBy("type").agg(F.count("*").alias("vertices"))
    return tree.join(counts, "type", "left").select("root", "type", "depth", "leaf", F.coalesce("vertices", F.lit(0)).cast("long").alias("vertices"))


@query("WITH s AS (SELECT DISTINCT s_nationkey AS n, s_suppkey AS s FROM supplier), c AS (SELECT n, string_agg('s' || s, ', ' ORDER BY 's' || s) AS t FROM s GROUP BY 1), m AS (SELECT n_regionkey AS r, CASE WHEN t IS NULL THEN 'n' || n_nationkey ELSE 'n' || n_nationkey || '(' || t || ')' END AS t, 'n' || n_nationkey AS k FROM nation LEFT JOIN c ON n = n_nationkey) SELECT 'r' || r AS type, md5('r' || r || '(' || string_agg(t, ', ' ORDER BY k) || ')') AS tree FROM m GROUP BY r")
def place_trees(spark, sf_dir):
    """Regions with their nations and suppliers as nested trees, built from the leaves up."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    up = n.select(F.concat(F.lit("n"), "n_nationkey").alias("type"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    up = up.unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("type"), F.concat(F.lit("n"), "s_nationkey").alias("parent")))
    return O.tree(up).select("type", F.md5("tree").alias("tree"))
