"""Scoring extractions, citations, refusals and detections."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions import names as N
from lodegraph.operators.metrics import safe_ratio
from lodegraph.operators.overlap import overlaps
from lodegraph.sources.tables import written


def entities_match(mode: str, name: Column, kind: Column, true_name: Column, true_kind: Column, threshold: float = 0.85) -> tuple[Column, Column]:
    """(whether they match, similarity): strict (same bare name and type), partial (similar name, same type), type_only (some similarity)."""
    alike = N.similarity(N.bare_name(name), N.bare_name(true_name))
    same = kind == true_kind
    if mode == "strict":
        return same & (N.bare_name(name) == N.bare_name(true_name)), alike
    return same & (alike >= threshold if mode == "partial" else alike > 0.5), alike


def relations_match(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], directed: bool = True) -> Column:
    """Whether (from, to, type) agree; undirected, either way round."""
    end = lambda x, y: N.bare_name(x) == N.bare_name(y)
    ahead = end(a[0], b[0]) & end(a[1], b[1])
    ends = ahead if directed else ahead | (end(a[0], b[1]) & end(a[1], b[0]))
    return ends & (N.relation_type(a[2]) == N.relation_type(b[2]))


def greedy_matching(candidates: DataFrame, group: str = "group") -> DataFrame:
    """(group, i, j, similarity): pairs taken greedily by similarity, ties by i and j, each i and j of a group once.

    candidates: group, i, j, similarity. A pair that is best for both its ends is what greedy taking comes to before any
    other pair of either, so all such pairs are taken at once, and again from what is left.
    """
    left = written(candidates.select(group, "i", "j", "similarity"))
    # a pair that is the only one of both its ends needs no rounds, which are for the few that compete
    alone = left.withColumn("_a", F.count("*").over(Window.partitionBy(group, "i"))).withColumn("_b", F.count("*").over(Window.partitionBy(group, "j")))
    alone = written(alone.withColumn("_alone", (F.col("_a") == 1) & (F.col("_b") == 1)).drop("_a", "_b"))
    found, left = alone.where("_alone").drop("_alone"), alone.where("NOT _alone").drop("_alone")
    order = (F.desc("similarity"), "i", "j")
    while True:
        ranked = left.withColumn("_a", F.row_number().over(Window.partitionBy(group, "i").orderBy(*order))).withColumn("_b", F.row_number().over(Window.partitionBy(group, "j").orderBy(*order)))
        taken = written(ranked.where("_a = 1 AND _b = 1").select(group, "i", "j", "similarity"))
        found = found.unionByName(taken)
        if not taken.take(1):
            return found
        left = written(left.join(taken.select(group, "i"), [group, "i"], "left_anti").join(taken.select(group, "j"), [group, "j"], "left_anti"))


def named_matching(extracted: DataFrame, truth: DataFrame, alike: Column, least: float) -> DataFrame:
    """(group, i, j, similarity): greedy_matching of all pairs of a group that are at least least alike, for names that many share.

    extracted: group, i, name; truth: group, j, true_name; alike is 1 for equal names alone. Equal names come first, and
    in order of i and j the k-th of either side meet; of what that leaves over of one side names are compared, each once,
    and a group's rows are folded by one task, as each pair depends on those before. i and j are of one type.
    """
    place = lambda name, by: F.row_number().over(Window.partitionBy("group", name).orderBy(by))
    a = written(extracted.select("group", "i", "name").withColumn("k", place("name", "i")))
    b = written(truth.select("group", "j", "true_name").withColumn("k", place("true_name", "j")))
    many = lambda rows, name, n: rows.groupBy("group", F.col(name).alias("name")).agg(F.max("k").alias(n))
    equal = a.join(b.withColumnRenamed("true_name", "name"), ["group", "name", "k"]).select("group", "i", "j", F.lit(1.0).alias("similarity"))
    rest_a = a.join(many(b, "true_name", "n"), ["group", "name"], "left").where("n IS NULL OR k > n").select("group", "i", "name")
    rest_b = written(b.withColumnRenamed("true_name", "name").join(many(a, "name", "n"), ["group", "name"], "left").where("n IS NULL OR k > n").select("group", "j", F.col("name").alias("true_name")))
    pairs = rest_a.select("group", "name").distinct().join(rest_b.select("group", "true_name").distinct(), "group").withColumn("similarity", alike).where(F.col("similarity") >= least)
    kind = lambda rows, c: dict(rows.dtypes)[c]
    ends = rest_a.select("group", F.col("i").alias("id"), "name", F.lit(True).alias("mine")).unionByName(rest_b.select("group", F.col("j").alias("id"), F.col("true_name").alias("name"), F.lit(False).alias("mine")))
    few = written(pairs)
    ends = ends.join(few.select("group", "name", F.lit(True).alias("mine")).union(few.select("group", "true_name", F.lit(False))).distinct(), ["group", "name", "mine"], "left_semi")
    schema = f"group {kind(extracted, 'group')}, i {kind(extracted, 'i')}, j {kind(truth, 'j')}, similarity double"
    return equal.unionByName(ends.groupBy("group").cogroup(few.groupBy("group")).applyInArrow(_greedy_by_name, schema))


def _greedy_by_name(ends: pa.Table, pairs: pa.Table) -> pa.Table:
    """A group's greedy matching of ids by name: from the most alike names on, each i in order takes the least j left of them."""
    free: dict[str, deque[int]] = {}
    mine: list[tuple[int, str]] = []
    for own, name, left in sorted(zip(*(ends.column(c).to_pylist() for c in ("id", "name", "mine")), strict=True)):
        if left:
            mine.append((own, name))
        else:
            free.setdefault(name, deque()).append(own)
    levels: dict[float, dict[str, list[str]]] = {}
    for name, other, alike in zip(*(pairs.column(c).to_pylist() for c in ("name", "true_name", "similarity")), strict=True):
        levels.setdefault(alike, {}).setdefault(name, []).append(other)
    taken: list[tuple[int, int, float]] = []
    for alike in sorted(levels, reverse=True):
        near, rest = levels[alike], []
        for own, name in mine:
            near[name] = [x for x in near.get(name, ()) if free.get(x)]
            if near[name]:
                taken.append((own, free[min(near[name], key=lambda x: free[x][0])].popleft(), alike))
            else:
                rest.append((own, name))
        mine = rest
    i, j, alike = zip(*taken, strict=True) if taken else ((), (), ())
    group = pa.array([(ends if len(ends) else pairs).column("group")[0].as_py()] * len(taken), ends.schema.field("group").type)
    return pa.table({"group": group, "i": pa.array(i, ends.schema.field("id").type), "j": pa.array(j, ends.schema.field("id").type), "similarity": pa.array(alike, pa.float64())})


def extraction_scores(extracted: DataFrame, truth: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) of matches among extracted and true rows, counted by the columns of by."""
    count = lambda rows, name: rows.groupBy(*by).agg(F.count("*").alias(name))
    both = count(extracted, "n").join(count(truth, "t"), by, "full_outer").join(count(matches, "tp"), by, "left").fillna(0, ["n", "t", "tp"])
    p, r = safe_ratio(F.col("tp"), F.col("n")), safe_ratio(F.col("tp"), F.col("t"))
    return both.select(*by, "tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("t") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), safe_ratio(2 * p * r, p + r).alias("f1"))


# fixed values: words that are no keywords
STOP_WORDS = tuple(
    "the and for are but not you all can had her was one our out has have been were they this that with from will would there their what about which when make like time just know take into year your some them than then could other".split()
)
# fixed values: how citations look, from the most to the least specific, and the name of each kind
CITATIONS = (
    ("bracketed_number", r"\[(\d+(?:[-,]\s*\d+)*)\]", 0), ("parenthetical_source", r"\((?:Source:\s*)?([^)]+?\.(?:pdf|docx?|txt|md|html?)[^)]*)\)", re.I),
    ("according_to", r"""(?:according to|as (?:stated|mentioned|described) in|per|from)\s+[“”"]?([^“”"\n,]+(?:\.[a-z]{2,4})?)[“”"]?""", re.I),
    ("page_reference", r"\((?:p\.?|page|section|sec\.?)\s*([\d.]+)\)", re.I), ("footnote", r"[¹²³⁴⁵⁶⁷⁸⁹⁰]+", 0), ("quote_attribution", r'"([^"]+)"\s*[-–—]\s*([^,\n]+)', 0),
)
_PATTERNS = tuple((name, re.compile(p, flags)) for name, p, flags in CITATIONS)


def cited(text: str | None) -> list[tuple[int, str, str, str, str]]:
    """(position, kind, text, reference, cited content) of the citations in a text, one at a position, by position."""
    found: dict[int, tuple] = {}
    for kind, pattern in _PATTERNS:
        for m in pattern.finditer(text or ""):
            before = text[max(0, m.start() - 200) : m.start()].strip()
            content = re.split(r"(?<=[.!?])\s+", before)[-1].strip()
            found.setdefault(m.start(), (m.start(), kind, m.group(), m.group(1) if m.groups() and m.group(1) else m.group(), content))
    return [found[at] for at in sorted(found)]


def citations(rows: DataFrame, ident: list[str], text: str) -> DataFrame:
    """(ident, position, kind, citation, reference, content): a row for every citation in the texts."""
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in ident) + ", position int, kind string, citation string, reference string, content string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, value in enumerate(batch.column(text).to_pylist()):
                for c in cited(value):
                    at.append(i)
                    out.append(c)
            take = pa.array(at, type=pa.int64())
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ident], pa.array(list(columns[0]), type=pa.int32()), *[pa.array(list(c), type=pa.string()) for c in columns[1:]]], names=[*ident, "position", "kind", "citation", "reference", "content"])

    return rows.select(*ident, text).mapInArrow(run, schema)


def keywords(text: Column) -> Column:
    """Words of more than two letters that aren't stop words, in order, repeats kept."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\w\\s]", " "), "\\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def plain_words(text: Column) -> Column:
    """Words of a text in lower case without punctuation."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\w\\s]", "")), "\\s+")


def sources(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, ngram, keyword, combined): .6 of the n-gram and .4 of the keyword overlap of all pairs that share any.

    items has item_id and text, docs doc_id and text. keyword is the share of the item's keywords, repeats counted.
    """
    # words are a column before their runs are taken, else every run would split the text again
    of = lambda rows, key: rows.select(key, plain_words(F.col("text")).alias("w")).select(key, N.ngrams(F.col("w")).alias("terms"))
    grams = overlaps(of(docs, "doc_id"), of(items, "item_id"))
    grams = grams.select("doc_id", "item_id", (F.col("common") / (F.col("n_doc") + F.col("n_item") - F.col("common"))).alias("ngram"))
    wanted = items.select("item_id", keywords(F.col("text")).alias("k")).where(F.size("k") > 0).select("item_id", F.size("k").alias("n"), F.explode("k").alias("word")).groupBy("item_id", "n", "word").agg(F.count("*").alias("times"))
    had = docs.select("doc_id", F.explode(F.array_distinct(keywords(F.col("text")))).alias("word"))
    words = had.join(F.broadcast(wanted) if wanted.count() <= 1_000_000 else wanted, "word").groupBy("doc_id", "item_id", "n").agg(F.sum("times").alias("hit")).select("doc_id", "item_id", (F.col("hit") / F.col("n")).alias("keyword"))
    both = grams.join(words, ["doc_id", "item_id"], "full_outer").fillna(0.0, ["ngram", "keyword"])
    return both.withColumn("combined", 0.6 * F.col("ngram") + 0.4 * F.col("keyword"))


def best_source(scored: DataFrame, score: str = "combined") -> DataFrame:
    """The row of greatest score for each item_id, ties by doc_id."""
    w = Window.partitionBy("item_id").orderBy(F.desc(F.round(score, 9)), "doc_id")
    return scored.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


# fixed values: phrases by which an answer refuses
REFUSALS = (
    "insufficient information", "not found", "no information available", "cannot find", "does not exist", "outside scope", "not documented", "not available", "no records", "unable to determine", "no such", "not applicable",
    "cannot provide", "hypothetical", "did not occur", "no evidence", "don't have information", "do not have information", "i don't have", "i do not have", "no data", "not in the knowledge base", "not in my knowledge",
    "cannot answer", "unable to answer",
)


def response_class(response: Column, acceptable: Column | None = None, unacceptable: Column | None = None) -> Column:
    """struct(kind, confidence): hallucination for an unacceptable pattern, correct_refusal for a refusing phrase, else qualified_response."""
    low = F.lower(F.coalesce(response, F.lit("")))
    refusal = low.rlike("|".join(re.escape(p) for p in REFUSALS))
    shows = lambda patterns: F.coalesce(F.exists(patterns, lambda p: low.contains(F.lower(p))), F.lit(False))
    refusal = refusal | shows(acceptable) if acceptable is not None else refusal
    made_up = shows(unacceptable) if unacceptable is not None else F.lit(False)
    kind = lambda name, c: F.struct(F.lit(name).alias("kind"), F.lit(c).alias("confidence"))
    return F.when(made_up, kind("hallucination", 0.8)).when(refusal, kind("correct_refusal", 0.9)).otherwise(kind("qualified_response", 0.5))


SEVERITY = {"none": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}


def severity_meets(detected: Column, expected: Column) -> Column:
    """Whether a detected severity is at least the expected one; unknown ones count as none."""
    value = lambda c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in SEVERITY.items()], F.lit(0))
    return value(detected) >= value(expected)


def detection_rates(rows: DataFrame, expected: Column, detected: Column, severity: Column) -> DataFrame:
    """One row: the share of expected cases that were detected, of all, of critical, and of high or critical ones; 1 of none."""
    of = lambda test: F.when(F.count_if(expected & test) > 0, F.count_if(expected & detected & test) / F.count_if(expected & test)).otherwise(1.0)
    return rows.agg(of(F.lit(True)).alias("detected"), of(severity == "critical").alias("critical"), of(severity.isin("high", "critical")).alias("high"), F.when(F.count_if(~expected) > 0, F.count_if(~expected & detected) / F.count_if(~expected)).otherwise(0.0).alias("false_positive"))
