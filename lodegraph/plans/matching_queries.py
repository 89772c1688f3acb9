"""Queries on names in texts and names that are alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.operators import fuzzy, mentions as M
from lodegraph.plans.registry import query
from lodegraph.sources.tables import table

# names of one to three words: the first words of each item, and the words before the first stop of each
_NAMES = "nm AS (SELECT DISTINCT unnest([w[1] || ' ' || w[2], w[1] || ' ' || w[2] || ' ' || w[3], w[2], w[2] || ' ' || w[3]]) AS name FROM (SELECT regexp_extract_all(text, '[^ .,\\n]+') AS w FROM benchmark))"
_FOUND = f"WITH {_NAMES}, k AS (SELECT name, lower(name) AS key FROM nm WHERE name IS NOT NULL AND trim(name) <> ''), f AS (SELECT doc_id, key, len(regexp_extract_all(lower(text), '\\b' || regexp_escape(key) || '\\b')) AS mentions FROM documents, (SELECT DISTINCT key FROM k) WHERE contains(lower(text), key)), m AS (SELECT doc_id, name, sum(mentions)::BIGINT AS mentions FROM f JOIN k USING (key) WHERE mentions > 0 GROUP BY ALL)"


def names(spark, sf_dir):
    """Names of one to three words that open the benchmark's items."""
    w = F.regexp_extract_all("text", F.lit("[^ .,\\n]+"), F.lit(0))
    words = table(spark, sf_dir, "benchmark").select(w.alias("w"))
    at = lambda i: F.get("w", F.lit(i))
    return words.select(F.explode(F.array(F.concat_ws(" ", at(0), at(1)), F.concat_ws(" ", at(0), at(1), at(2)), at(1), F.concat_ws(" ", at(1), at(2)))).alias("name")).distinct()


@query(f"{_FOUND} SELECT * FROM m")
def name_mentions(spark, sf_dir):
    """How often every document holds each name of one to three words, by word bounds."""
    return M.mentions(table(spark, sf_dir, "documents"), names(spark, sf_dir), "doc_id", "text")


@query(f"{_FOUND} SELECT name, sum(mentions)::BIGINT AS mention_count, count(DISTINCT doc_id) AS document_count FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_mentioned_names(spark, sf_dir):
    """The fifty names with most mentions."""
    found = M.mentions(table(spark, sf_dir, "documents"), names(spark, sf_dir), "doc_id", "text")
    known = names(spark, sf_dir).withColumn("mention_count", F.lit(0).cast("long"))
    return M.top_mentioned(M.updated_counts(known, found, "doc_id").where("outcome = 'updated'")).select("name", "mention_count", "document_count")


@query(
    f"""WITH {_NAMES}, c AS (SELECT conv_id * 1000 + turn AS chunk, text FROM conversations), h AS (SELECT chunk, name FROM c JOIN nm ON contains(lower(text), lower(name)) WHERE trim(name) <> '')
    SELECT chunk, string_agg(DISTINCT name, '|' ORDER BY name) AS entities FROM h GROUP BY 1"""
)
def turn_entities(spark, sf_dir):
    """The names that each turn of a conversation contains anywhere."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk"), "text")
    return M.entities_of_chunks(c, names(spark, sf_dir), "chunk", "text").select("chunk", F.array_join("entities", "|").alias("entities"))


_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS name FROM benchmark), t AS (SELECT DISTINCT unnest(regexp_extract_all(html, '<title>([A-Za-z]+)', 1)) AS name FROM pages)"


def _words(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name")).distinct()
    return w, table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<title>([A-Za-z]+)"), F.lit(1))).alias("name")).distinct()


@query(f"WITH {_WORDS} SELECT a.name, b.name AS match, levenshtein(lower(a.name), lower(b.name))::INT AS distance FROM t a JOIN w b ON a.name <> b.name AND levenshtein(lower(a.name), lower(b.name)) <= 3")
def near_words(spark, sf_dir):
    """The words of the benchmark within three edits of a word that opens a page's title."""
    w, t = _words(spark, sf_dir)
    return fuzzy.near_names(t, w)


@query(f"WITH {_WORDS}, d AS (SELECT a.name, b.name AS match, levenshtein(lower(a.name), lower(b.name))::INT AS distance FROM t a JOIN w b ON a.name <> b.name AND levenshtein(lower(a.name), lower(b.name)) <= 2) SELECT name, match, distance, (row_number() OVER (PARTITION BY name ORDER BY distance, match))::INT AS place FROM d QUALIFY place <= 3")
def nearest_words(spark, sf_dir):
    """The three nearest of them, within two edits."""
    w, t = _words(spark, sf_dir)
    return fuzzy.nearest_names(t, w, 2)


@query(f"WITH {_WORDS} SELECT DISTINCT a.name, b.name AS part FROM w a JOIN t b ON contains(lower(a.name), lower(b.name))")
def words_containing(spark, sf_dir):
    """The benchmark's words that contain a word that opens a page's title."""
    w, t = _words(spark, sf_dir)
    return fuzzy.containing(w, t)


@query(
    f"""WITH {_WORDS}, n AS (SELECT name, upper(name[1]) || lower(name[2:]) AS normal FROM t), l AS (SELECT lower(name) AS low, min(name) AS other FROM w GROUP BY 1)
    SELECT n.name, CASE WHEN a.name IS NOT NULL THEN n.name WHEN b.name IS NOT NULL THEN normal ELSE coalesce(other, normal) END AS resolved,
    CASE WHEN a.name IS NOT NULL THEN 'exact' WHEN b.name IS NOT NULL THEN 'normal' WHEN other IS NOT NULL THEN 'case' WHEN EXISTS (SELECT 1 FROM w x WHERE contains(lower(x.name), lower(normal)) OR contains(lower(normal), lower(x.name))) THEN 'contained' ELSE 'new' END AS how
    FROM n LEFT JOIN w a ON a.name = n.name LEFT JOIN w b ON b.name = normal LEFT JOIN l ON low = lower(normal) WHERE lower(n.name) NOT IN ('the', 'a', 'an')"""
)
def resolved_words(spark, sf_dir):
    """The benchmark's word that each title's first word stands for."""
    w, t = _words(spark, sf_dir)
    return fuzzy.resolved_names(t.where("lower(name) NOT IN ('the', 'a', 'an')"), w)


@query(
    """WITH e AS (SELECT 'Unit ' || s_suppkey % 40 AS name, round(s_acctbal / 10000, 6) AS confidence, s_name AS description, -1 AS place FROM (SELECT DISTINCT ON (s_suppkey % 40) * FROM supplier ORDER BY s_suppkey % 40, s_suppkey)
      UNION ALL SELECT upper('unit ' || c_custkey % 60), round(c_acctbal / 10000, 6), CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, c_custkey FROM customer),
    g AS (SELECT lower(name) AS key, arg_min(name, place) AS name, max(confidence) AS confidence, count(*) > 1 AS merged FROM e GROUP BY 1), d AS (SELECT lower(name) AS key, description, min(place) AS place FROM e WHERE description IS NOT NULL GROUP BY 1, 2)
    SELECT g.name, g.confidence, coalesce((SELECT string_agg(description, '; ' ORDER BY place, description) FROM d WHERE d.key = g.key), '') AS description, merged FROM g"""
)
def merged_units(spark, sf_dir):
    """Suppliers as known entities and customers as new ones, merged by name with all their descriptions."""
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier")
    first = s.withColumn("r", F.row_number().over(Window.partitionBy(F.col("s_suppkey") % 40).orderBy("s_suppkey"))).where("r = 1")
    known = first.select(F.concat(F.lit("Unit "), F.col("s_suppkey") % 40).alias("name"), F.round(F.col("s_acctbal") / 10000, 6).alias("confidence"), F.col("s_name").alias("description"))
    c = table(spark, sf_dir, "customer")
    new = c.select(F.concat(F.lit("UNIT "), F.col("c_custkey") % 60).alias("name"), F.round(F.col("c_acctbal") / 10000, 6).alias("confidence"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("description"), F.col("c_custkey").alias("place"))
    return fuzzy.merged_entities(new, known)
