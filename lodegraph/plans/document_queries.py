"""Queries on documents: dashboards, names, chunks, overlap, security and paging."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import names as N
from lodegraph.operators import chunking, security
from lodegraph.operators.overlap import overlaps
from lodegraph.plans.registry import query
from lodegraph.plans.views import DECIDED, EDGES, SECURED, VERTICES, edges, secured, vertices
from lodegraph.sources.tables import table

_USER = security.User("reader", ("g1", "g2"), "src3", "u2")
_WORDS = "list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[ \\t\\n\\r]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query("SELECT source, lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest FROM documents GROUP BY source, lang")
def doc_status_dashboard(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))


@query(f"SELECT id, trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(name), '[ \\t\\n\\r]+', ' ', 'g')), '^(the|a|an) ', ''), '[^a-z0-9_ ]', '', 'g')) AS key FROM ({VERTICES})")
def name_normalize(spark, sf_dir):
    return vertices(spark, sf_dir).select("id", N.bare_name(F.col("name")).alias("key"))


@query("SELECT event_type, coalesce(regexp_replace(upper(trim(event_type)), '[ \\t\\n\\r-]+', '_', 'g'), 'RELATED_TO') AS kind, count(*) AS events FROM events GROUP BY event_type")
def rel_type_normalize(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events")).select("event_type", N.relation_type(F.col("event_type")).alias("kind"), "events")


@query("SELECT p_partkey, p_brand, p_type, round(1 - levenshtein(lower(p_brand), lower(p_type))::DOUBLE / greatest(length(p_brand), length(p_type)), 6) AS similarity FROM part")
def levenshtein_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.round(N.similarity(F.lower("p_brand"), F.lower("p_type")), 6).alias("similarity"))


_VERSION = "(o_orderkey % 7) || '.' || (o_custkey % 11) || '.' || (o_orderkey % 13) || CASE WHEN o_orderkey % 3 = 0 THEN '-rc.' || (o_orderkey % 4) WHEN o_orderkey % 5 = 0 THEN '-beta' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN '+b' || o_custkey ELSE '' END"
_PARTS = "'^([0-9]+)\\.([0-9]+)\\.([0-9]+)(?:-([0-9A-Za-z.-]+))?(?:\\+([0-9A-Za-z.-]+))?$'"


def _version_text():
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pre = F.when(k % 3 == 0, F.concat(F.lit("-rc."), k % 4)).when(k % 5 == 0, F.lit("-beta")).otherwise("")
    return F.concat(F.concat_ws(".", k % 7, c % 11, k % 13), pre, F.when(k % 4 == 0, F.concat(F.lit("+b"), c)).otherwise(""))


@query(
    f"SELECT o_orderkey, {', '.join(f'regexp_extract(t, {_PARTS}, {i})::BIGINT AS {n}' for i, n in ((1, 'major'), (2, 'minor'), (3, 'patch')))}, regexp_extract(t, {_PARTS}, 4) AS pre, regexp_extract(t, {_PARTS}, 5) AS build FROM (SELECT o_orderkey, {_VERSION} AS t FROM orders)"
)
def semver_parse(spark, sf_dir):
    v = table(spark, sf_dir, "orders").select("o_orderkey", N.semver(_version_text()).alias("v"))
    return v.select("o_orderkey", *[F.col(f"v.{c}").cast("long").alias(c) for c in ("major", "minor", "patch")], "v.pre", "v.build")


@query(
    f"""WITH t AS (SELECT o_orderkey, {_VERSION} AS t FROM orders), p AS (SELECT o_orderkey, regexp_extract(t, {_PARTS}, 1)::INT AS a, regexp_extract(t, {_PARTS}, 2)::INT AS b, regexp_extract(t, {_PARTS}, 3)::INT AS c, regexp_extract(t, {_PARTS}, 4) AS pre FROM t)
    SELECT o_orderkey, CASE WHEN (a, b, c) > (3, 5, 6) THEN 1 WHEN (a, b, c) < (3, 5, 6) THEN -1 WHEN pre = '' THEN 1 WHEN pre = 'rc.2' THEN 0 WHEN pre = 'beta' THEN -1 WHEN pre > 'rc.2' THEN 1 ELSE -1 END AS against,
      a = 3 AND ((a, b, c) > (3, 5, 6) OR ((a, b, c) = (3, 5, 6) AND (pre = '' OR (pre >= 'rc.2' AND pre <> 'beta')))) AS fits FROM p"""
)
def version_comparison(spark, sf_dir):
    """Each order's version against 3.5.6-rc.2."""
    other = F.lit("3.5.6-rc.2")
    return table(spark, sf_dir, "orders").select("o_orderkey", N.compare_versions(_version_text(), other).alias("against"), N.compatible(_version_text(), other).alias("fits"))


@query(f"WITH e AS ({EDGES}) SELECT CASE type WHEN 'DEPENDS_ON' THEN 'REQUIRES' ELSE type END AS kind, count(*) AS edges FROM e GROUP BY 1")
def relation_synonyms(spark, sf_dir):
    """Edges by the relation that their type is another word for."""
    return edges(spark, sf_dir).groupBy(N.relation_type(F.col("type")).alias("kind")).agg(F.count("*").alias("edges"))


@query("SELECT page_id, left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '[ \\t\\n\\r]+', '_', 'g'), '[^a-z0-9_=-]', '', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 100) AS key FROM pages")
def search_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.search_key(F.col("url")).alias("key"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS title, least(n_name, r_name) || '|' || greatest(n_name, r_name) AS pair FROM nation JOIN region ON r_regionkey = n_regionkey")
def display_names(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return n.select("n_nationkey", N.title_name(F.col("n_name")).alias("title"), N.pair_key(F.col("n_name"), F.col("r_name")).alias("pair"))


@query("SELECT event_id, props::JSON ->> '$.k' AS k FROM events")
def json_payloads(spark, sf_dir):
    """A number out of JSON that stands in a code fence."""
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(N.json_payload(fenced), "$.k").alias("k"))


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), c AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, ceil((len(w) - 50) / 450.0))::INT END AS n FROM w),
    x AS (SELECT doc_id, w, unnest(range(0, n))::INT AS index FROM c)
    SELECT doc_id, index, (index * 450)::INT AS start, len(w[index * 450 + 1 : index * 450 + 500])::INT AS words, md5(array_to_string(w[index * 450 + 1 : index * 450 + 500], ' ')) AS hash FROM x"""
)
def fixed_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", N.words(F.col("text")).alias("w"))
    made = d.select("doc_id", F.explode(chunking.windows(F.col("w"))).alias("c"))
    return made.select("doc_id", "c.index", "c.start", F.size(F.split("c.text", " ")).alias("words"), F.md5("c.text").alias("hash"))


@query(
    f"""WITH w AS (SELECT doc_id, len({_WORDS}) AS n FROM documents) SELECT count(*) FILTER (n > 0) AS documents, sum(CASE WHEN n > 0 THEN greatest(1, ceil((n - 50) / 450.0))::BIGINT ELSE 0 END)::BIGINT AS chunks, max(n)::INT AS longest FROM w"""
)
def chunk_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", N.words(F.col("text")).alias("w")).withColumn("c", chunking.windows(F.col("w")))
    return d.agg(F.count_if(F.size("w") > 0).alias("documents"), F.sum(F.size("c")).alias("chunks"), F.max(F.size("w")).alias("longest"))


@query()
def sentence_split(spark, sf_dir):
    """Sentences of every document with their place."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("place", "sentence"))


def _gram_sql(n: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {j + 1}]" for j in range(n))
    return f"CASE WHEN len(w) >= {n} THEN list_distinct(list_transform(range(0, len(w) - {n - 1}), lambda i: {joined})) ELSE [] END"


@query(
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), dg AS (SELECT doc_id, unnest({_gram_sql(3)}) AS g FROM d), bg AS (SELECT item_id, unnest({_gram_sql(3)}) AS g FROM b),
    dn AS (SELECT doc_id, count(*) AS n FROM dg GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1), c AS (SELECT doc_id, item_id, count(*) AS k FROM dg JOIN bg USING (g) GROUP BY 1, 2)
    SELECT doc_id, item_id, round(k::DOUBLE / (dn.n + bn.n - k), 6) AS overlap FROM c JOIN dn USING (doc_id) JOIN bn USING (item_id)"""
)
def ngram_overlaps(spark, sf_dir):
    """Three-word overlap of all documents with all benchmark items; pairs without a common run have 0 and no row."""
    d = table(spark, sf_dir, "documents").select("doc_id", N.words(F.col("text")).alias("w")).select("doc_id", N.ngrams(F.col("w")).alias("terms"))
    b = table(spark, sf_dir, "benchmark").select("item_id", N.words(F.col("text")).alias("w")).select("item_id", N.ngrams(F.col("w")).alias("terms"))
    return overlaps(d, b).select("doc_id", "item_id", F.round(F.col("common") / (F.col("n_doc") + F.col("n_item") - F.col("common")), 6).alias("overlap"))


@query(
    f"""WITH d AS (SELECT doc_id, unnest(list_distinct({_WORDS})) AS w FROM documents), b AS (SELECT item_id, unnest(list_filter(list_distinct({_WORDS}), lambda x: length(x) > 2)) AS w FROM benchmark), n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
    SELECT doc_id, item_id, round(count(*)::DOUBLE / any_value(n), 6) AS contained FROM d JOIN b USING (w) JOIN n USING (item_id) GROUP BY 1, 2"""
)
def keyword_overlaps(spark, sf_dir):
    """Share of every benchmark item's longer words that each document has; pairs without a common word have 0 and no row."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(N.words(F.col("text"))).alias("terms"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.filter(F.array_distinct(N.words(F.col("text"))), lambda x: F.length(x) > 2).alias("terms"))
    return overlaps(d, b).select("doc_id", "item_id", F.round(F.col("common") / F.col("n_item"), 6).alias("contained"))


@query(f"WITH {SECURED}, {DECIDED} SELECT doc_id, reason FROM dd WHERE reason = 'granted'")
def row_security(spark, sf_dir):
    return _decided(spark, sf_dir).where("reason = 'granted'").select("doc_id", "reason")


@query(f"WITH {SECURED}, {DECIDED} SELECT reason, count(*) AS documents FROM dd GROUP BY reason")
def denial_reasons(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("documents"))


@query(f"WITH {SECURED} SELECT 'reader' AS role, doc_id, classification, '' AS owner, n_chars FROM sd UNION ALL SELECT 'reviewer', doc_id, classification, coalesce(owner, ''), n_chars FROM sd")
def column_mask(spark, sf_dir):
    """What a reader and a reviewer see of each document: only the latter the owner."""
    seen = None
    for role in ("reader", "reviewer"):
        rows = security.masked(secured(spark, sf_dir), security.User(role), {"owner": "confidential", "n_chars": "internal"})
        rows = rows.select(F.lit(role).alias("role"), "doc_id", "classification", F.coalesce("owner", F.lit("")).alias("owner"), "n_chars")
        seen = rows if seen is None else seen.unionByName(rows)
    return seen


def _decided(spark, sf_dir):
    reason = security.decision(_USER, *[F.col(c) for c in ("classification", "allowed_groups", "owner", "viewers", "department")])
    return secured(spark, sf_dir).withColumn("reason", reason)


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars < 2000 OR (n_chars = 2000 AND doc_id < 100) ORDER BY n_chars DESC, doc_id DESC LIMIT 21")
def keyset_page(spark, sf_dir):
    """The page after (2000, 100), largest first; one row more than the page tells whether there is another."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return d.where("n_chars < 2000 OR (n_chars = 2000 AND doc_id < 100)").orderBy(F.desc("n_chars"), F.desc("doc_id")).limit(21)


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host, length(url) AS url_chars FROM pages")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:]+)", 1).alias("host"), F.length("url").cast("long").alias("url_chars"))


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, md5(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user')) AS user_hash FROM conversations GROUP BY conv_id")
def cross_messages(spark, sf_dir):
    """Each conversation's user messages as one text, as a scan across messages sees them."""
    c = table(spark, sf_dir, "conversations")
    said = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda m: m["text"])
    got = c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), said.alias("said"))
    return got.select("conv_id", "turns", "user_turns", F.when(F.size("said") > 0, F.md5(F.array_join("said", "\n"))).alias("user_hash"))
