"""Chunks, citations, matching, near pairs and versions against plain versions and literal cases."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.functions import names as N
from lodegraph.operators import chunking as K
from lodegraph.operators import connectors as C
from lodegraph.operators import evaluation as E
from lodegraph.operators import metrics as M
from lodegraph.operators import resolution as R
from lodegraph.operators import vectors as V


def test_breaks_follow_the_floor_rule():
    gaps = np.array([0.1, 0.9, 0.2, 0.3, 0.8, 0.25, 0.15, 0.12, 0.11, 0.4, 0.5, 0.6])
    assert K.breaks(gaps, 90).tolist() == [1, 4] and K.breaks(np.zeros(0)).tolist() == [] and K.breaks(np.ones(5), 95).tolist() == []
    assert K.distances(np.array([[1.0, 0], [0, 1], [0, 2], [0, 0]])).tolist() == [1.0, 0.0, 1.0]


def test_short_stretches_are_joined_and_long_ones_marked():
    assert K.assembled([10, 10, 60, 5], [1, 2], 50, 800) == [(0, 2, "semantic_merged"), (3, 3, "semantic")]
    assert K.assembled([60, 900, 60], [0, 1], 50, 800) == [(0, 0, "semantic"), (1, 1, "large"), (2, 2, "semantic")]
    assert K.assembled([5], [], 50, 800) == [(0, 0, "semantic")]


def test_semantic_chunks(spark):
    topics = ["alpha beta gamma delta", "river stone water fish"]
    text = " ".join(f"The {topics[i // 6 % 2]} number{i} {' '.join(topics[i // 6 % 2].split() * 3)}." for i in range(24))
    docs = spark.createDataFrame([(1, text), (2, "One. Two."), (3, None), (4, ""), (5, "word " * 2000 + ". Next one here. And a third.")], "doc_id long, text string")
    rows = K.semantic_chunks(docs, "doc_id", "text", percentile=80, least=20).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == {1, 2, 5} and [r.method for r in by[2]] == ["single"] and max(r.words for r in by[5]) == 800
    firsts = [r.first_sentence for r in sorted(by[1], key=lambda r: r['index'])]
    assert firsts[0] == 0 and len({round(f / 6) * 6 for f in firsts} & {0, 6, 12, 18}) == 4 and all(abs(f - round(f / 6) * 6) <= 1 for f in firsts)
    assert " ".join(r.content for r in sorted(by[1], key=lambda r: r['index'])) == text
    one = spark.createDataFrame([(["a", "b", "c", "d", "e"],)], "x array<string>").select(K.sampled(F.col("x"), 2).alias("s"), K.sampled(F.col("x"), 9).alias("t"), K.key_coverage(F.lit("The Big Dog"), F.array(F.lit("dog"), F.lit("cat"))).alias("c")).first()
    assert one.s == ["a", "c"] and len(one.t) == 5 and one.c == 0.5


def test_coherence_without_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(g, [float(x) for x in rng.normal(g, 1, 6)]) for g in (0, 3) for _ in range(7)] + [(9, [1.0] * 6)]
    got = {r.label: r for r in V.coherence(spark.createDataFrame(rows, "label int, embedding array<double>"), "label").collect()}
    for g in (0, 3):
        v = np.array([x for k, x in rows if k == g])
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        pairs = [u[i] @ u[j] for i in range(7) for j in range(i)]
        c = v.mean(axis=0)
        s = u @ c / np.linalg.norm(c)
        assert got[g].pairwise == pytest.approx(np.mean(pairs)) and got[g].centroid == pytest.approx(s.mean())
        assert got[g].score == pytest.approx(0.5 * s.mean() + 0.3 * np.mean(pairs) + 0.2 * np.exp(-10 * np.var(1 - s)))
    assert got[9].score == 1.0


def test_citations_in_every_form(spark):
    text = 'Costs rose. They fell later [1, 2]. See (Source: plan.pdf, p. 5) and (p. 12). According to the annual report, all is well¹. "Be brief" - Anna Lee'
    found = E.cited(text)
    assert [(k, r) for _, k, _, r, _ in found] == [("bracketed_number", "1, 2"), ("parenthetical_source", "plan.pdf, p. 5"), ("page_reference", "12"), ("according_to", "the annual report"), ("footnote", "¹"), ("quote_attribution", "Be brief")]
    assert found[0][4] == "They fell later" and E.cited(None) == [] == E.cited("nothing")
    rows = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "id long, text string")
    assert E.citations(rows, ["id"], "text").count() == 6


def test_greedy_matching_against_a_plain_version(spark):
    rng = np.random.default_rng(7)
    rows = [(g, i, j, round(float(rng.random()), 1)) for g in range(6) for i in range(int(rng.integers(1, 9))) for j in range(5) if rng.random() < 0.7]
    want = set()
    for g in range(6):
        used_i, used_j = set(), set()
        for s, i, j in sorted(((-s, i, j) for k, i, j, s in rows if k == g)):
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                want.add((g, i, j, -s))
    got = E.greedy_matching(spark.createDataFrame(rows, "group int, i int, j int, similarity double"))
    assert {tuple(r) for r in got.collect()} == want
    assert E.greedy_matching(spark.createDataFrame([], "group int, i int, j int, similarity double")).count() == 0


def test_named_matching_is_greedy_matching_of_all_pairs(spark):
    rng = np.random.default_rng(9)
    name = lambda: f"Unit {rng.integers(100, 130)}"
    a = spark.createDataFrame([(int(rng.integers(0, 3)), i, name()) for i in range(150)], "group int, i long, name string")
    b = spark.createDataFrame([(int(rng.integers(0, 4)), 1000 + j, name()) for j in range(120)], "group int, j long, true_name string")
    ok, alike = E.entities_match("partial", F.col("name"), F.lit("t"), F.col("true_name"), F.lit("t"), 0.75)
    want = E.greedy_matching(a.join(b, "group").where(ok).select("group", "i", "j", alike.alias("similarity")))
    got = E.named_matching(a, b, alike, 0.75)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert E.named_matching(a.limit(0), b, alike, 0.75).count() == 0


def test_matching_takes_equal_names_in_few_rounds(spark, monkeypatch):
    seen, keep = [], E.written
    monkeypatch.setattr(E, "written", lambda rows: seen.append(1) or keep(rows))
    a = spark.range(300).selectExpr("1 as group", "id as i", "'Unit 7' as name")
    b = spark.range(300).selectExpr("1 as group", "id as j", "'Unit 7' as true_name")
    _, alike = E.entities_match("partial", F.col("name"), F.lit("t"), F.col("true_name"), F.lit("t"), 0.75)
    assert E.named_matching(a, b, alike, 0.75).where("i = j").count() == 300 and len(seen) < 10


def test_bare_names(spark):
    told = {"The Big  Corp": "big corp", "a b": "b", "theory x_1": "theory x_1", " Part 7 ": "part 7", "x\n": "x", "A-B c": "ab c", "the the x": "the x", "": "", "the": "the", "Ä x": "x"}
    rows = spark.createDataFrame(list(told.items()) + [(None, None)], "name string, bare string").withColumn("got", N.bare_name(F.col("name")))
    assert rows.where("NOT (bare <=> got)").collect() == []


def test_entities_relations_and_responses(spark):
    row = spark.range(1).select(
        E.entities_match("strict", F.lit("The Big Corp"), F.lit("t"), F.lit("big corp"), F.lit("t"))[0].alias("strict"), E.entities_match("partial", F.lit("Big Corp"), F.lit("t"), F.lit("Big Corpo"), F.lit("t"))[0].alias("partial"),
        E.entities_match("type_only", F.lit("Big Corp"), F.lit("t"), F.lit("Big Dogs"), F.lit("u"))[0].alias("kind"),
        E.relations_match((F.lit("a"), F.lit("b"), F.lit("supervises")), (F.lit("B"), F.lit("A"), F.lit("MANAGES")), directed=False).alias("either"), E.relations_match((F.lit("a"), F.lit("b"), F.lit("x")), (F.lit("b"), F.lit("a"), F.lit("x"))).alias("one_way"),
        E.response_class(F.lit("I do not have that"))["kind"].alias("refusal"), E.response_class(F.lit("It is 7"), unacceptable=F.array(F.lit("IT IS")))["kind"].alias("made_up"), E.response_class(F.lit(None).cast("string"))["kind"].alias("none"),
        E.severity_meets(F.lit("high"), F.lit("medium")).alias("meets"), E.severity_meets(F.lit("?"), F.lit("low")).alias("less"),
    ).first()
    assert tuple(row) == (True, True, False, True, False, "correct_refusal", "hallucination", "qualified_response", True, False)


def test_near_pairs_recall(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (150, 32))
    every = np.vstack([base, base + rng.normal(0, 0.6, base.shape), rng.normal(0, 1, (300, 32))])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    want = {(i, j) for i in range(len(unit)) for j in range(i + 1, len(unit)) if unit[i] @ unit[j] >= 0.75}
    got = R.near_pairs(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(every)], "vec_id long, embedding array<double>"), 0.75, 9, 40)
    found = {(r.a, r.b) for r in got.collect()}
    assert found <= want and len(found) / len(want) >= 0.95 and len(want) > 100


def test_versions_names_and_acls(spark):
    pairs = [("1.2.3", "1.2.3", 0), ("1.2.3", "1.10.0", -1), ("1.0.0-alpha", "1.0.0", -1), ("1.0.0-alpha.1", "1.0.0-alpha", 1), ("1.0.0-rc.2", "1.0.0-rc.10", -1), ("1.0.0-1", "1.0.0-a", -1), ("1.0.0+b1", "1.0.0+b2", 0), ("v1.0.0", "0.0.1", -1)]
    rows = spark.createDataFrame(pairs, "a string, b string, w int").select("w", N.compare_versions(F.col("a"), F.col("b")).alias("g"), N.compatible(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.g for r in rows] == [p[2] for p in pairs] and [r.c for r in rows] == [True, False, False, True, False, False, True, False]
    row = spark.range(1).select(
        N.entity_key(F.lit(" “A”  – ‘b’ ")).alias("k"), N.relation_type(F.lit("works for")).alias("r"), N.title_name(F.lit("the  big dog")).alias("t"), N.search_key(F.lit(" A b__c!/d ")).alias("s"),
        N.json_payload(F.lit('```json\n{"a": 1}\n```')).alias("j"), N.percent_change(F.lit(2.0), F.lit(3.0)).alias("p"), N.percent_change(F.lit(0.0), F.lit(3.0)).alias("q"),
    ).first()
    assert tuple(row) == ("\"a\" - 'b'", "REPORTS_TO", "Big Dog", "a_b_cd", '{"a": 1}', "+50.0%", "n/a")
    acl = spark.range(1).select(C.allowed_groups(F.lit("user::rwx,user:bob:r--,group::r-x,mask::r--,other::r--,bad"), F.lit("ann"), F.lit("ops")).alias("g"), C.allowed_groups(F.lit(None).cast("string"), F.lit("ann"), F.lit("ops")).alias("n")).first()
    assert acl.g == ["group:ops", "public", "user:ann", "user:bob"] and acl.n == []


def test_listing_of_files(spark, tmp_path):
    for name, size in (("a/x.PDF", 3), ("a/b/y.txt", 50), ("skip/z.txt", 1), ("n.bin", 1)):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"1" * size)
    got = C.listing(spark, str(tmp_path), ("pdf", ".txt"), 40, ("/skip/",)).collect()
    assert [(r.name, r.extension, r.media, r.bytes) for r in got] == [("x.PDF", "pdf", "application/pdf", 3)]
    assert C.listing(spark, str(tmp_path)).count() == 4


def test_edges_by_name_are_merged_before_they_fan_out(spark):
    named = spark.range(40).selectExpr("'O1' as from", "'top' as to", "'uses' as type", "(id % 7) / 10.0D as confidence")
    entities = spark.range(50).selectExpr("id", "IF(id = 0, 'Top', 'o1') as name")
    got = R.edges_by_name(named, entities)
    assert {(r.src, r.dst, round(r.confidence, 6)) for r in got.collect()} == {(i, 0, 0.6) for i in range(1, 50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") > plan.index("Join")


def test_nearest_over_many_blocks_and_metrics_by_label(spark):
    rng = np.random.default_rng(5)
    n = V.ITEM_BLOCK * 2 + 77
    every = rng.integers(-2, 3, (n, 6)).astype(float)  # many ties, and vectors of no length
    rows = spark.createDataFrame([(i, every[i].tolist(), int(i % 4) if i % 9 else None) for i in range(n)], "vec_id long, embedding array<double>, label int").coalesce(1)
    size = np.linalg.norm(every, axis=1, keepdims=True)
    unit = every / np.where(size > 0, size, 1)
    got = V.nearest(rows, rows.where("vec_id % 50 = 0"), 7)
    best = np.sort(np.delete(unit @ unit[50], 50))[::-1][:7]
    assert np.allclose([r.score for r in got.where("query = 50").orderBy("position").collect()], best)
    items = rows.select(F.col("vec_id").alias("item"), "label")
    judged = items.withColumnRenamed("item", "query").join(items, "label").where("query <> item").select("query", "item")
    got.cache()
    assert sorted(map(tuple, M.at_k_by_label(got, items, 5).collect())) == sorted(map(tuple, M.at_k(got, judged, 5).collect()))
