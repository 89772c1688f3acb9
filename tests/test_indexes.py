"""Mentions, fuzzy names, vector and text indexes against plain versions."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import fuzzy, mentions, resolution, retrieval, text_index, vector_index, vectors
from lodegraph.sources.tables import scratch_path


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_mentions_count_like_patterns(spark):
    rng = random.Random(3)
    words = ["ann", "Ann Lee", "lee", "an", "C++", "c", "na", "nana", "x_y", "the end", "end", "é", "İx", "na na"]
    texts = ["".join(rng.choice([w, w.upper(), w + "s"]) + rng.choice([" ", ", ", "-", "", "\n"]) for w in rng.choices(words, k=rng.randint(0, 40))) for _ in range(60)]
    rows = [*enumerate(texts), (60, None), (61, ""), (5, texts[6])]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    names = spark.createDataFrame([(w,) for w in [*words, "ANN", None, "", "  "]], "name string")
    for shard in (10, 1_000_000):
        got = {(r.id, r.name): r.mentions for r in mentions.mentions(docs, names, "id", "text", shard_chars=shard).collect()}
        want = collections.Counter()
        for i, text in rows:
            for w in {*words, "ANN"}:
                n = len(re.findall(rf"\b{re.escape(w.lower())}\b", (text or "").lower(), re.ASCII))
                if n:
                    want[i, w] += n
        assert got == dict(want)
    assert mentions.mentions(docs, names.limit(0), "id", "text").count() == 0
    anywhere = {r.id: r.entities for r in mentions.entities_of_chunks(docs.where("id < 5"), names, "id", "text").collect()}
    assert anywhere == {i: e for i, t in rows[:5] if (e := sorted(w for w in {*words, "ANN"} if w.lower() in t.lower()))}


def test_mention_counts_are_added_up(spark):
    known = spark.createDataFrame([("a", 3), ("b", None), ("c", 1)], "name string, mention_count long")
    found = spark.createDataFrame([(1, "a", 2), (2, "a", 5), (1, "b", 1), (1, "z", 4)], "doc long, name string, mentions long")
    got = mentions.updated_counts(known, found, "doc")
    assert {tuple(r) for r in got.collect()} == {("a", 10, 2, "updated"), ("b", 1, 1, "updated"), ("c", 1, 0, "kept"), ("z", 4, 1, "not_found")}
    assert [r.name for r in mentions.top_mentioned(got, 2).collect()] == ["a", "z"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_names_are_all_within_the_distance(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(60)]
    changed = []
    for w in base:
        for _ in range(3):
            x = list(w)
            for _ in range(rng.randint(0, edits + 1)):
                at = rng.randint(0, len(x))
                x[at : at + rng.randint(0, 1)] = rng.choices("abcX", k=rng.randint(0, 1))
            changed.append("".join(x))
    one, other = spark.createDataFrame([(w,) for w in [*base, None]], "name string"), spark.createDataFrame([(w,) for w in [*changed, None]], "name string")
    found = fuzzy.near_names(one, other, edits)
    want = {(a, b, d) for a in set(base) for b in set(changed) if a != b and (d := distance(a.lower(), b.lower())) <= edits}
    assert {tuple(r) for r in found.collect()} == want
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_containment_by_rare_grams(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("abcd ", k=rng.randint(1, 15))) for _ in range(200)]
    parts = [n[i : i + rng.randint(1, 6)].upper() for n in names[:80] for i in (rng.randint(0, len(n)),)] + ["zzz", "a", "", None]
    found = fuzzy.containing(spark.createDataFrame([(n,) for n in [*names, None]], "name string"), spark.createDataFrame([(p,) for p in parts], "name string"))
    assert {tuple(r) for r in found.collect()} == {(n, p) for n in names for p in parts if p and p.lower() in n.lower()}
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_names_are_resolved_in_steps(spark):
    known = spark.createDataFrame([(w,) for w in ("Data Flow", "IBM", "Ann", "order book", "the Xyz")], "name string")
    asked = spark.createDataFrame([(w,) for w in ("IBM", "the data  flow", "ORDER book", "an Ann", "Anna", "Unknown", "a ibm", None)], "name string")
    got = {r.name: (r.resolved, r.how) for r in fuzzy.resolved_names(asked, known).collect()}
    assert got == {"IBM": ("IBM", "exact"), "the data  flow": ("Data Flow", "normal"), "ORDER book": ("order book", "case"), "an Ann": ("Ann", "normal"), "Anna": ("Anna", "contained"), "Unknown": ("Unknown", "new"), "a ibm": ("IBM", "case")}
    new = spark.createDataFrame([("ANN", 0.9, "two", 1), ("ann", 0.2, "one", 2), ("Bob", 0.5, None, 3), ("bob", 0.1, "x", 4)], "name string, confidence double, description string, place long")
    old = spark.createDataFrame([("Ann", 0.3, "one")], "name string, confidence double, description string")
    assert {tuple(r) for r in fuzzy.merged_entities(new, old).collect()} == {("Ann", 0.9, "one; two", True), ("Bob", 0.5, "x", True)}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24))
    rows = [(int(i), [float(v) for v in np.float32(centres[i % 40] + rng.normal(size=24) * 0.35)], int(i % 3) if i % 11 else None, [int(i % 10), int(i % 7)]) for i in range(4_000)]
    return spark.createDataFrame([*rows, (4_000, None, 1, [])], "vec_id long, embedding array<float>, label int, docs array<int>").repartition(5).cache()


def test_index_recall_and_completion(spark, clustered):
    index = vector_index.build(clustered, scratch_path(spark), keep=("label", "docs"), cells=64)
    assert index.counts.sum() == 4_000
    asked = clustered.where("vec_id % 50 = 0 AND embedding IS NOT NULL")
    exact = {(r["query"], r["item"], r.position) for r in vectors.nearest(clustered.where("embedding IS NOT NULL"), asked, 10).collect()}
    log = []
    fast = {(r["query"], r["item"]) for r in vector_index.search(index, asked.where("vec_id < 200"), 10, probes=4, complete=False, log=log).collect()}
    mine = {(q, i) for q, i, _ in exact if q < 200}
    assert len(fast & mine) >= 0.9 * len(mine) and log[0] < 0.5
    whole = vector_index.search(index, asked, 10, probes=2, log=log)
    assert {(r["query"], r["item"], r.position) for r in whole.collect()} == exact
    again = vector_index.load(spark, index.path)
    assert {(r["query"], r["item"], r.position) for r in vector_index.search(again, asked.where("vec_id = 50"), 10).collect()} == {e for e in exact if e[0] == 50}


def test_index_filters_like_a_scan(spark, clustered):
    index = vector_index.build(clustered, scratch_path(spark), keep=("label", "docs"), cells=64)
    asked = clustered.where("vec_id % 100 = 0 AND embedding IS NOT NULL")
    found = vector_index.search(index, asked, 5, same="label", without="docs", where=F.col("vec_id") % 3 > 0)
    rows = {r.vec_id: r for r in clustered.where("embedding IS NOT NULL").collect()}
    unit = {i: np.array(r.embedding, dtype=np.float64) / np.linalg.norm(np.array(r.embedding, dtype=np.float64)) for i, r in rows.items()}
    want = set()
    for q in (i for i in rows if i % 100 == 0):
        fits = [i for i, r in rows.items() if i != q and r.label == rows[q].label and not set(r.docs) & set(rows[q].docs) and i % 3]
        best = sorted(fits, key=lambda i: (-float(unit[q] @ unit[i]), i))[:5]
        want |= {(q, i, k) for k, i in enumerate(best, 1)}
    assert {(r["query"], r["item"], r.position) for r in found.collect()} == want
    other = {(r["query"], r["item"]) for r in vectors.nearest(clustered.where("embedding IS NOT NULL"), asked.where("vec_id = 100"), 1, other="label").collect()}
    best = max((i for i, r in rows.items() if r.label != rows[100].label), key=lambda i: (float(unit[100] @ unit[i]), -i))
    assert other == {(100, best)}
    assert vector_index.search(index, asked.limit(0), 5).count() == 0


def test_text_index_gives_the_same_ten_for_less(spark):
    rng = random.Random(4)
    common, rare = [f"w{i}" for i in range(30)], [f"r{i}" for i in range(2_000)]
    rows = [(i, rng.choices(common, k=rng.randint(0, 40)) + [rare[i % 75 * 3 + j] for j in range(3)]) for i in range(1_500)] + [(2_000, []), (2_001, None)]
    docs = spark.createDataFrame(rows, "item long, words array<string>").repartition(4)
    asked = spark.createDataFrame([(q, rng.choices(common, k=2) + rows[q * 7][1][-3:]) for q in range(25)] + [(99, ["nowhere"]), (98, [])], "query long, words array<string>")
    index = text_index.build(docs, scratch_path(spark), block=16)
    log = []
    got = text_index.search(index, asked, 10, log=log).collect()
    want = retrieval.bm25(docs.where("words IS NOT NULL").union(spark.createDataFrame([(2_001, [])], "item long, words array<string>")), asked, 10).collect()
    assert {(r["query"], r["item"], r.position, round(r.score, 8)) for r in got} == {(r["query"], r["item"], r.position, round(r.score, 8)) for r in want}
    assert log[0] < 0.6
    assert text_index.search(text_index.load(spark, index.path), asked.where("query = 3"), 10).count() == len([r for r in want if r["query"] == 3])


def test_suggestions_begin_with_what_was_typed(spark):
    names = spark.createDataFrame([(n,) for n in ("Alpha", "beta alp", "ALPINE", "x", None, *[f"zalp{i:03}" for i in range(300)])], "name string")
    got = retrieval.suggestions(names, spark.createDataFrame([("alp",), ("q",), ("",)], "prefix string"), 4).orderBy("place").collect()
    assert [r.name for r in got] == ["ALPINE", "Alpha", "beta alp", "zalp000"]


def test_near_pairs_in_blocks_are_the_same(spark, clustered, monkeypatch):
    some = clustered.where("vec_id < 600 AND embedding IS NOT NULL")
    want = {(r.a, r.b) for r in resolution.near_pairs(some, 0.6, 3, 8, group="label").collect()}
    monkeypatch.setattr(resolution, "BUCKET", 20)
    assert {(r.a, r.b) for r in resolution.near_pairs(some, 0.6, 3, 8, group="label").collect()} == want and len(want) > 100


def test_documents_are_shuffled_once_for_the_text_index(spark, tmp_path):
    from test_shuffled_rows import crossed

    r = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, [f"w{j}" for j in r.integers(0, 90, 40)]) for i in range(400)], "item long, words array<string>")
    index, rows = crossed(spark, lambda: text_index.build(docs, str(tmp_path / "index"), block=20))
    assert index.n == 400 and index.mean == 40
    assert index.table("postings").selectExpr("sum(size(found)) AS n").first().n == docs.selectExpr("sum(size(array_distinct(words))) AS n").first().n
    assert rows < 4_000  # documents and terms; with a row for each document and term some 28,000
