"""Queries on listings, permissions, page structure, chunks and coherence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import chunking as K
from lodegraph.operators import connectors as C
from lodegraph.operators import vectors as V
from lodegraph.plans.registry import query
from lodegraph.sources.tables import table

_PATH = "regexp_replace(url, '^[a-z]+://[^/]+', '')"


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]+", "").alias("path"))


@query(f"SELECT page_id, string_split(p, '/')[-1] AS name, lower(regexp_extract(string_split(p, '/')[-1], '\\.([^.]+)$', 1)) AS extension FROM (SELECT page_id, {_PATH} AS p FROM pages)")
def path_parts(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", C.file_name(F.col("path")).alias("name"), C.extension(F.col("path")).alias("extension"))


@query(f"SELECT page_id FROM (SELECT page_id, {_PATH} AS p FROM pages) WHERE NOT (starts_with(p, '/de/') OR regexp_matches(p, '^.*page=2.*$')) AND NOT contains(lower(p), '/es/')")
def included_pages(spark, sf_dir):
    """Pages whose paths no rule leaves out."""
    path = F.col("path")
    return _paths(spark, sf_dir).where(~C.excluded(path, ("/de/", "*page=2*")) & C.included(path, without=("/es/",))).select("page_id")


_ACL = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'user::rwx,user:u' || (c_custkey % 7) || ':r-x,group::' || CASE WHEN c_custkey % 2 = 0 THEN 'r--' ELSE '---' END || ',mask::r-x,bad,default:user:d:rwx,other::' || CASE WHEN c_custkey % 5 = 0 THEN 'r--' ELSE '---' END END"
_GROUPS = f"""ac AS (SELECT c_custkey, {_ACL} AS acl, CASE WHEN c_custkey % 3 = 0 THEN [] ELSE list_sort(list_filter(['group:' || c_mktsegment, 'public', 'user:' || c_name, 'user:u' || (c_custkey % 7)], lambda g: CASE WHEN g = 'public' THEN c_custkey % 5 = 0 WHEN starts_with(g, 'group:') THEN c_custkey % 2 = 0 ELSE true END)) END AS g FROM customer)"""


def _acls(spark, sf_dir):
    k = F.col("c_custkey")
    right = lambda test: F.when(test, "r--").otherwise("---")
    acl = F.when(k % 3 != 0, F.concat(F.lit("user::rwx,user:u"), k % 7, F.lit(":r-x,group::"), right(k % 2 == 0), F.lit(",mask::r-x,bad,default:user:d:rwx,other::"), right(k % 5 == 0)))
    return table(spark, sf_dir, "customer").select("c_custkey", acl.alias("acl"), C.allowed_groups(acl, F.col("c_name"), F.col("c_mktsegment")).alias("groups"))


@query(f"WITH {_GROUPS} SELECT c_custkey, array_to_string(g, ',') AS groups FROM ac")
def acl_groups(spark, sf_dir):
    """Who may read each customer's file by its ACL."""
    return _acls(spark, sf_dir).select("c_custkey", F.array_join("groups", ",").alias("groups"))


@query(f"WITH {_GROUPS} SELECT count(acl) AS with_acl, count(*) - count(acl) AS without, count(*) FILTER (list_contains(g, 'public')) AS public, (SELECT count(DISTINCT x) FROM (SELECT unnest(g) AS x FROM ac)) AS groups FROM ac")
def acl_stats(spark, sf_dir):
    return C.acl_stats(_acls(spark, sf_dir), "acl", "groups")


@query(
    """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN o_orderkey % 4 <> 0 THEN 'g' || (o_custkey % 9) END, CASE WHEN o_orderstatus = 'F' THEN 'user:' || o_custkey END, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'organization' END], lambda x: x IS NOT NULL))), ',') AS groups FROM orders"""
)
def permission_groups(spark, sf_dir):
    """Who shared permissions let in, inherited ones left out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    one = F.struct((k % 4 == 0).alias("inherited"), F.array(F.lit("read")).alias("roles"), F.lit(None).cast("string").alias("user"), F.concat(F.lit("g"), c % 9).alias("group"), F.lit("users").alias("scope"))
    two = F.struct(F.lit(False).alias("inherited"), F.array(F.when(F.col("o_orderstatus") == "F", "read").otherwise("none")).alias("roles"), c.cast("string").alias("user"), F.lit(None).cast("string").alias("group"), F.when(k % 2 == 0, "organization").otherwise("users").alias("scope"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(C.permission_groups(F.array(one, two), inherited=False, roles=("read",)), ",").alias("groups"))


_BLOCKS = "bl AS (SELECT page_id, generate_subscripts(b, 1) AS place, unnest(b) AS x FROM (SELECT page_id, regexp_extract_all(html, '<(?:h[1-6]|p)[ >][^<]*') AS b FROM pages)), sx AS (SELECT page_id, place, starts_with(x, '<h') AS h, regexp_replace(x, '^<[^>]*>', '') AS t FROM bl), se AS (SELECT *, sum(h::INT) OVER (PARTITION BY page_id ORDER BY place) AS section FROM sx)"


@query(f"WITH {_BLOCKS} SELECT page_id, section::BIGINT AS section, md5(coalesce(max(t) FILTER (h), 'Introduction')) AS title, md5(coalesce(string_agg(t, chr(10) ORDER BY place) FILTER (NOT h), '')) AS body FROM se GROUP BY 1, 2")
def page_sections(spark, sf_dir):
    """Pages by headings."""
    b = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<(?:h[1-6]|p)[ >][^<]*"), F.lit(0))).alias("place", "x"))
    got = C.sections(b, "page_id", "place", F.col("x").startswith("<h"), F.regexp_replace("x", "^<[^>]*>", ""))
    return got.select("page_id", "section", F.md5("title").alias("title"), F.md5("body").alias("body"))


@query(
    """WITH c AS (SELECT l_orderkey AS id, l_linenumber AS r, l_linenumber || ' | ' || l_returnflag || ' | ' || l_quantity::INT AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity))
    SELECT id, md5(string_agg('| ' || line || ' |' || CASE WHEN k = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END, chr(10) ORDER BY r)) AS hash FROM c GROUP BY 1"""
)
def order_tables(spark, sf_dir):
    """Each order's lines as a table in text."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")).alias("m"))
    cells = F.array(*[F.struct(F.lit(i).alias("column"), c.alias("content")) for i, c in enumerate((F.col("l_linenumber").cast("string"), F.col("m.l_returnflag"), F.col("m.l_quantity").cast("int").cast("string")))])
    return C.table_text(l.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("row"), F.explode(cells).alias("c")).select("id", "row", "c.*"), "id").select("id", F.md5("markdown").alias("hash"))


@query("SELECT doc_id, name, count(*) AS mentions FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS w FROM documents) JOIN (SELECT DISTINCT lang AS name FROM documents WHERE lang IS NOT NULL) ON lower(name) = w GROUP BY 1, 2")
def entity_mentions(spark, sf_dir):
    """How often documents hold the names of the languages as words."""
    d = table(spark, sf_dir, "documents")
    return C.mentions(d, d.where("lang IS NOT NULL").select(F.col("lang").alias("name")).distinct(), "doc_id", "text")


@query()
def semantic_chunks(spark, sf_dir):
    """Documents cut where their topic changes."""
    got = K.chunks(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.select("doc_id", "index", "strategy", F.md5("content").alias("hash"))


@query(
    """WITH x AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT label, place, avg(v) AS v FROM (SELECT label, unnest(e) AS v, generate_subscripts(e, 1) AS place FROM x) GROUP BY 1, 2), c AS (SELECT label, list(v ORDER BY place) AS c FROM p GROUP BY 1),
    s AS (SELECT label, list_cosine_similarity(e, c) AS s FROM x JOIN c USING (label)), a AS (SELECT label, count(*) AS n, avg(s) AS centroid, exp(-10 * var_pop(1 - s)) AS variance FROM s GROUP BY 1), w AS (SELECT a.label, avg(list_cosine_similarity(a.e, b.e)) AS pairwise FROM x a JOIN x b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
    SELECT label, n, round(centroid, 6) AS centroid, round(pairwise, 6) AS pairwise, round(variance, 6) AS variance, round(0.5 * centroid + 0.3 * pairwise + 0.2 * variance, 6)::DOUBLE AS score FROM a JOIN w USING (label)"""
)
def group_coherence(spark, sf_dir):
    """How much each label's vectors belong together."""
    got = V.coherence(table(spark, sf_dir, "embeddings"), "label")
    return got.select("label", "n", *[F.round(c, 6).alias(c) for c in ("centroid", "pairwise", "variance", "score")])
