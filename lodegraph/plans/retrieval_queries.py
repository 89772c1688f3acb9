"""Queries that search, filter, cite and score."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodegraph.functions import names as N
from lodegraph.operators import evaluation as E
from lodegraph.operators import graph as G
from lodegraph.operators import retrieval as R
from lodegraph.operators import text_index as T
from lodegraph.operators import vectors as V
from lodegraph.operators.security import User
from lodegraph.plans.document_queries import _WORDS
from lodegraph.plans.ontology_queries import _TYPES, _case, typed
from lodegraph.plans.registry import query
from lodegraph.plans.store_queries import _STATUS, statuses
from lodegraph.plans.views import GRAPH, SECURED, edges, secured
from lodegraph.sources.tables import scratch_path, table, written

_USER = User("reader", ("g1", "g2"), "src3", "u2")
_BM25 = f"""dw AS (SELECT doc_id AS item, {_WORDS} AS w FROM documents), qw AS (SELECT item_id AS query, unnest(list_distinct({_WORDS})) AS term FROM benchmark), sp AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dw),
  tf AS (SELECT item, l, term, count(*) AS tf FROM (SELECT item, len(w) AS l, unnest(w) AS term FROM dw) WHERE term IN (SELECT term FROM qw) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  sc AS (SELECT query, item, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / mean))) AS score FROM tf JOIN df USING (term) JOIN qw USING (term), sp GROUP BY 1, 2)"""
_BEST = "bt AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS position FROM sc)"


def _texts(spark, sf_dir, k, allowed=None):
    d = table(spark, sf_dir, "documents")
    d = d if allowed is None else d.join(allowed, "doc_id", "left_semi")
    words = d.select(F.col("doc_id").alias("item"), N.words(F.col("text")).alias("words"))
    return R.bm25(words, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), N.words(F.col("text")).alias("words")), k)


@query(f"WITH {_BM25}, {_BEST} SELECT query, item, round(score, 6) AS score, position::INT AS position FROM bt WHERE position <= 10")
def text_search(spark, sf_dir):
    """The ten best documents of every benchmark item by BM25."""
    return _texts(spark, sf_dir, 10).select("query", "item", F.round("score", 6).alias("score"), "position")


@query(f"WITH {_BM25}, {_BEST} SELECT query, item, round(score, 6) AS score, position::INT AS position FROM bt WHERE position <= 10")
def indexed_text_search(spark, sf_dir):
    """The same by a posting table whose blocks are read where they can matter alone."""
    words = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), N.words(F.col("text")).alias("words"))
    index = T.build(words, scratch_path(spark))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), N.words(F.col("text")).alias("words"))
    return T.search(index, asked, 10).select("query", "item", F.round("score", 6).alias("score"), "position")


_ALLOWED = "classification IN ('public', 'internal') AND (len(allowed_groups) = 0 OR list_has_any(allowed_groups, ['g1', 'g2'])) AND (department IS NULL OR department = 'src3')"


@query(f"WITH {SECURED} SELECT doc_id FROM sd WHERE {_ALLOWED}")
def search_filter(spark, sf_dir):
    """The documents that a reader's search is confined to."""
    return secured(spark, sf_dir).where(R.search_filter(_USER)).select("doc_id")


@query(
    f"""WITH {SECURED}, al AS (SELECT doc_id FROM sd WHERE {_ALLOWED}), {_BM25.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT doc_id FROM al))")}, {_BEST},
    vs AS (SELECT q.vec_id AS query, v.vec_id AS item, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND v.vec_id IN (SELECT doc_id FROM al)),
    vt AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, item) AS position FROM vs), u AS (SELECT query, item, 0.7 / (60 + position) AS x FROM vt WHERE position <= 20 UNION ALL SELECT query, item, 0.3 / (60 + position) FROM bt WHERE position <= 20)
    SELECT query, item, round(sum(x), 9) AS score FROM u GROUP BY 1, 2"""
)
def hybrid_search(spark, sf_dir):
    """Secured search: the reader's documents ranked by text and by vector, both rankings fused."""
    allowed = secured(spark, sf_dir).where(R.search_filter(_USER)).select("doc_id")
    v = table(spark, sf_dir, "embeddings")
    asked = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    near = V.nearest(v.join(allowed.withColumnRenamed("doc_id", "vec_id"), "vec_id", "left_semi"), asked, 20)
    return V.fuse(near, _texts(spark, sf_dir, 20, allowed)).withColumn("score", F.round("score", 9))


@query(
    f"""WITH {_BM25}, {_BEST}, h AS (SELECT query, item, position, text FROM bt JOIN documents ON doc_id = item WHERE position <= 5)
    SELECT query, position::INT AS number, item, md5(left(coalesce(text, ''), 200)) AS passage FROM h"""
)
def citation_list(spark, sf_dir):
    """The documents that an answer to each benchmark item cites."""
    hits = written(_texts(spark, sf_dir, 5)).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "text"), "item")
    return R.citations(hits).select("query", "number", "item", F.md5(F.coalesce("passage", F.lit(""))).alias("passage"))


@query(
    f"""WITH {_BM25}, {_BEST}, l AS (SELECT query, string_agg('[' || position || '] document ' || item, chr(10) ORDER BY position) AS t FROM bt WHERE position <= 3 GROUP BY 1),
    g AS (SELECT query, string_agg('- ' || source, chr(10) ORDER BY source) AS t FROM (SELECT DISTINCT query, source FROM bt JOIN documents ON doc_id = item WHERE position <= 3 AND source IS NOT NULL) GROUP BY 1)
    SELECT l.query, '## Passages' || chr(10) || l.t || coalesce(chr(10) || chr(10) || '## Sources' || chr(10) || g.t, '') AS context FROM l LEFT JOIN g USING (query)"""
)
def assembled_context(spark, sf_dir):
    """What a model is given for each benchmark item: its best documents and their sources."""
    hits = written(_texts(spark, sf_dir, 3))  # few rows: what is joined with them isn't shuffled
    lines = hits.select("query", F.col("position").alias("place"), F.concat(F.lit("["), F.col("position"), F.lit("] document "), F.col("item")).alias("line"))
    from pyspark.sql import Window

    s = hits.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), "source"), "item").where("source IS NOT NULL").select("query", "source").distinct()
    s = s.select("query", F.row_number().over(Window.partitionBy("query").orderBy("source")).alias("place"), F.concat(F.lit("- "), F.col("source")).alias("line"))
    return R.context([("Passages", lines), ("Sources", s)])


@query(
    f"""WITH {_BM25}, {_BEST}, h AS (SELECT query, item, position, d.text AS s, list_filter(string_split_regex(lower(b.text), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 3) AS w FROM bt JOIN documents d ON doc_id = item JOIN benchmark b ON item_id = query WHERE position <= 5),
    r AS (SELECT query, position, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(lower(coalesce(s, '')), x)))::DOUBLE / len(w) ELSE 0 END AS r FROM h)
    SELECT query, round(avg(r), 6) AS relevance, round(least(1.0, 0.6 * avg(r) + 0.4 * least(count(*) / 3.0, 1.0)), 6)::DOUBLE AS confidence FROM r GROUP BY 1"""
)
def answer_confidence(spark, sf_dir):
    """How much of each question its best documents contain, and the confidence that follows."""
    d, b = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), F.col("text").alias("s")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("q"))
    r = written(_texts(spark, sf_dir, 5)).join(d, "item").join(b, "query").select("query", R.word_share(F.col("q"), F.col("s")).alias("r"))
    return r.groupBy("query").agg(F.round(F.avg("r"), 6).alias("relevance"), F.round(R.confidence(F.collect_list("r")), 6).alias("confidence"))


@query(f"WITH {_STATUS} SELECT CASE WHEN status IN ('pending_review', 'rejected') THEN 'status_restricted' WHEN source = 'src1' THEN 'role_required' ELSE 'granted' END AS reason, count(*) AS documents FROM st GROUP BY 1")
def entity_decisions(spark, sf_dir):
    """Why a reader does or doesn't see entities by their review status and the role they require."""
    s = statuses(spark, sf_dir).withColumn("required", F.when(F.col("source") == "src1", "reviewer"))
    return s.groupBy(R.entity_decision(_USER, F.col("status"), F.col("required")).alias("reason")).agg(F.count("*").alias("documents"))


_DEGREE = f"{GRAPH}, t AS (SELECT id, {_case('type', _TYPES)} AS type FROM v), d AS (SELECT id, count(*) AS n FROM (SELECT unnest([src, dst]) AS id FROM e) GROUP BY 1), i AS (SELECT t.id, t.type, n::DOUBLE / max(n) OVER () AS importance FROM t JOIN d USING (id)), p AS (SELECT *, " + (
    "0.4::DOUBLE * CASE type WHEN 'Department' THEN 0.7 WHEN 'Stakeholder' THEN 0.8 WHEN 'Role' THEN 0.9 WHEN 'System' THEN 0.6 WHEN 'Document' THEN 0.8 END + 0.3::DOUBLE * importance + 0.15::DOUBLE AS relevance FROM i)")


def _for_operations(spark, sf_dir, least=0.45):
    d = G.degrees(edges(spark, sf_dir))
    most = d.agg(F.max("degree").alias("most"))
    rows = typed(spark, sf_dir).join(d, "id").join(F.broadcast(most)).select("id", "type", (F.col("degree") / F.col("most")).alias("importance"), F.lit(None).cast("double").alias("similarity"))
    from dataclasses import replace

    persona = replace(R.OPERATIONS, least=least)
    return persona, R.for_persona(persona, rows)


@query(f"{_DEGREE} SELECT type, CASE WHEN relevance < 0.45 THEN 'low_relevance' ELSE 'shown' END AS outcome, count(*) AS entities, round(avg(relevance), 6) AS relevance FROM p GROUP BY 1, 2")
def persona_entities(spark, sf_dir):
    """What operations sees of the graph's entities, and what is left out."""
    _, seen = _for_operations(spark, sf_dir)
    return seen.groupBy("type", F.coalesce("removed", F.lit("shown")).alias("outcome")).agg(F.count("*").alias("entities"), F.round(F.avg("relevance"), 6).alias("relevance"))


@query(f"{_DEGREE}, s AS (SELECT id FROM p WHERE relevance >= 0.45) SELECT type, count(*) AS edges FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s) GROUP BY 1")
def persona_relations(spark, sf_dir):
    """Edges between what operations sees."""
    persona, seen = _for_operations(spark, sf_dir)
    return R.relations_for_persona(persona, edges(spark, sf_dir), seen.where("removed IS NULL")).groupBy("type").agg(F.count("*").alias("edges"))


@query(f"WITH {', '.join(['v AS (SELECT DISTINCT n_name AS name FROM nation)', 'q AS (SELECT DISTINCT left(r_name, 2) AS prefix FROM region)'])} SELECT prefix, name, place::INT AS place FROM (SELECT prefix, name, row_number() OVER (PARTITION BY prefix ORDER BY (NOT starts_with(lower(name), lower(prefix)))::INT, name) AS place FROM v JOIN q ON contains(lower(name), lower(prefix))) WHERE place <= 5")
def name_suggestions(spark, sf_dir):
    """Nations whose names contain how the regions begin."""
    return R.suggestions(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), table(spark, sf_dir, "region").select(F.substring("r_name", 1, 2).alias("prefix")))


_STOP = ", ".join(f"'{w}'" for w in E.STOP_WORDS)
_PLAIN = "string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z0-9_ \\t\\n\\r\\f\\v]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r\\f\\v]+')"
_KEYS = f"list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-zA-Z0-9_ \\t\\n\\r\\f\\v]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP}))"
_SOURCES = f"""gd AS (SELECT doc_id, {_PLAIN} AS w FROM documents), gb AS (SELECT item_id, {_PLAIN} AS w FROM benchmark), dg AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(0, len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) ELSE [] END) AS g FROM gd),
  bg AS (SELECT item_id, unnest(CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(0, len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) ELSE [] END) AS g FROM gb), dn AS (SELECT doc_id, count(*) AS n FROM dg GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM bg GROUP BY 1),
  ng AS (SELECT doc_id, item_id, k::DOUBLE / (dn.n + bn.n - k) AS ngram FROM (SELECT doc_id, item_id, count(*) AS k FROM dg JOIN bg USING (g) GROUP BY 1, 2) JOIN dn USING (doc_id) JOIN bn USING (item_id)),
  kd AS (SELECT doc_id, unnest(list_distinct({_KEYS})) AS w FROM documents), kb AS (SELECT item_id, unnest({_KEYS}) AS w FROM benchmark), kn AS (SELECT item_id, count(*) AS n FROM kb GROUP BY 1),
  kw AS (SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) AS keyword FROM kd JOIN kb USING (w) JOIN kn USING (item_id) GROUP BY 1, 2), co AS (SELECT doc_id, item_id, coalesce(ngram, 0) AS ngram, coalesce(keyword, 0) AS keyword, 0.6::DOUBLE * coalesce(ngram, 0) + 0.4::DOUBLE * coalesce(keyword, 0) AS combined FROM ng FULL JOIN kw USING (doc_id, item_id))"""


def _sources(spark, sf_dir):
    return E.sources(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


def _best_sql(score: str) -> str:
    return f"WITH {_SOURCES} SELECT item_id, doc_id, round({score}, 6) AS {score} FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round({score}, 9) DESC, doc_id) AS k FROM co) WHERE k = 1"


@query(_best_sql("ngram"))
def ngram_jaccard(spark, sf_dir):
    """The document that shares most runs of three words with each benchmark item."""
    return E.best_source(_sources(spark, sf_dir), "ngram").select("item_id", "doc_id", F.round("ngram", 6).alias("ngram"))


@query(_best_sql("keyword"))
def keyword_overlap(spark, sf_dir):
    """The document that contains most of each benchmark item's keywords."""
    return E.best_source(_sources(spark, sf_dir), "keyword").select("item_id", "doc_id", F.round("keyword", 6).alias("keyword"))


@query(_best_sql("combined"))
def best_sources(spark, sf_dir):
    """The best source of each benchmark item by both overlaps."""
    return E.best_source(_sources(spark, sf_dir)).select("item_id", "doc_id", F.round("combined", 6).alias("combined"))


@query()
def text_citations(spark, sf_dir):
    """Citations in all documents by kind."""
    return E.citations(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text").groupBy("kind").agg(F.count("*").alias("citations"), F.countDistinct("doc_id").alias("documents"))


_REFUSED = " OR ".join("contains(lower(coalesce(text, '')), '" + p.replace("'", "''") + "')" for p in E.REFUSALS)


@query(f"SELECT CASE WHEN contains(lower(coalesce(text, '')), 'license') THEN 'hallucination' WHEN {_REFUSED} THEN 'correct_refusal' ELSE 'qualified_response' END AS kind, count(*) AS documents FROM documents GROUP BY 1")
def response_classes(spark, sf_dir):
    """Documents taken as answers: made up where they speak of a licence, refusing, or in need of a judge."""
    r = table(spark, sf_dir, "documents").select(E.response_class(F.col("text"), unacceptable=F.array(F.lit("license"))).alias("r"))
    return r.groupBy(F.col("r.kind").alias("kind")).agg(F.count("*").alias("documents"))


@query()
def extraction_scores(spark, sf_dir):
    """Customers as extracted and suppliers as true entities of a nation: partial matches, one to one, scored by nation."""
    digits = lambda c: F.concat(F.lit("Unit "), F.substring(c, -3, 3))
    x = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("i"), digits("c_name").alias("name"))
    t = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("j"), digits("s_name").alias("true_name"))
    _, alike = E.entities_match("partial", F.col("name"), F.lit("t"), F.col("true_name"), F.lit("t"), 0.75)
    matched = E.named_matching(x, t, alike, 0.75)
    s = E.extraction_scores(x, t, matched, ["group"])
    return s.select("group", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH d AS (SELECT l.quality, l.toxic, regexp_matches(coalesce(text, ''), '[!]{2}') AS hit, CASE WHEN toxic = 1 THEN 'critical' ELSE 'medium' END AS severity FROM labels l JOIN documents USING (doc_id)), x AS (SELECT quality = 0 AS e, hit AS d, severity FROM d)
    SELECT round(count(*) FILTER (e AND d)::DOUBLE / greatest(count(*) FILTER (e), 1), 6) AS detected, round(CASE WHEN count(*) FILTER (e AND severity = 'critical') > 0 THEN count(*) FILTER (e AND d AND severity = 'critical')::DOUBLE / count(*) FILTER (e AND severity = 'critical') ELSE 1 END, 6) AS critical,
      round(CASE WHEN count(*) FILTER (e AND severity IN ('high', 'critical')) > 0 THEN count(*) FILTER (e AND d AND severity IN ('high', 'critical'))::DOUBLE / count(*) FILTER (e AND severity IN ('high', 'critical')) ELSE 1 END, 6) AS high, round(count(*) FILTER (NOT e AND d)::DOUBLE / greatest(count(*) FILTER (NOT e), 1), 6) AS false_positive FROM x"""
)
def detection_rates(spark, sf_dir):
    """How many poor documents repeated exclamation marks tell, by severity."""
    x = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    got = E.detection_rates(x, F.col("quality") == 0, F.coalesce(F.col("text").rlike("[!]{2}"), F.lit(False)), F.when(F.col("toxic") == 1, "critical").otherwise("medium"))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


