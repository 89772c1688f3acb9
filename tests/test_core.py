"""Operators of the library on small literal tables."""

import collections

import pytest
from pyspark.sql import functions as F

from lodegraph.functions import names as N
from lodegraph.operators import activity, chunking, graph, metrics, security, temporal, vectors
from lodegraph.operators.components import connected_components


def values(frame, *cols):
    return sorted(tuple(r) for r in frame.select(*(cols or frame.columns)).collect())


@pytest.fixture(scope="module")
def chain(spark):
    v = spark.createDataFrame([(x, x, "t") for x in "abcdx"], "id string, name string, type string")
    e = spark.createDataFrame([("a", "b", "USES", 0.5), ("b", "c", "USES", 0.6), ("c", "d", "USES", 0.9), ("a", "b", "USES", 0.8), ("d", "d", "USES", 0.1)], "src string, dst string, type string, confidence double")
    return v, e


def test_degrees_and_isolated(chain):
    v, e = chain
    assert values(graph.degrees(e)) == [("a", 2), ("b", 3), ("c", 2), ("d", 3)]
    assert values(graph.isolated(v, e), "id") == [("x",)]
    assert values(graph.best_edges(e), "src", "dst", "confidence", "copies")[0] == ("a", "b", 0.8, 2)


def test_reach_paths_and_impact(spark, chain):
    v, e = chain
    seeds = spark.createDataFrame([("a",)], "id string")
    assert values(graph.reach(e, seeds, 2), "id", "hops") == [("b", 1), ("c", 2)]
    assert values(graph.reach(e, spark.createDataFrame([("d",)], "id string"), 9, reverse=True), "id", "hops") == [("a", 3), ("b", 2), ("c", 1)]
    assert [r.path for r in graph.paths(e, seeds, 2).collect()] == [["a", "b", "c"]]
    got = spark.range(1).select(graph.impact_score(F.lit(1), F.lit(1.0)).alias("s"), graph.risk_level(F.lit(6), F.lit(0)).alias("r")).first()
    assert got.s == pytest.approx(0.82) and got.r == "medium"


def test_pagerank_keeps_or_drops_dangling_rank(spark):
    v = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    dropped = dict(values(graph.pagerank(v, e, iterations=30)))
    assert dropped["a"] == pytest.approx(0.075) and dropped["b"] == pytest.approx(0.075 + 0.85 * 0.075)
    assert sum(dict(values(graph.pagerank(v, e, iterations=60, keep_dangling=True))).values()) == pytest.approx(1.0, abs=1e-4)
    assert graph.pagerank(v.limit(0), e).count() == 0


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "a long, b long")
    got = dict(values(connected_components(e)))
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and got[200] == 200 and len(got) == 43
    assert connected_components(e.limit(0)).count() == 0


def test_label_propagation_splits_cliques(spark):
    cliques = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)]
    e = spark.createDataFrame(cliques + [("a0", "b0")], "src string, dst string")
    v = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    got = dict(values(graph.label_propagation(v, e)))
    assert len({got[f"a{i}"] for i in range(1, 4)}) == 1 and got["a1"] != got["b1"]


def test_temporal_rules(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    row = spark.range(1).select(
        temporal.status(t("2020-01-01"), t(None), F.lit(None), t("2021-01-01")).alias("a"), temporal.status(t("2020-01-01"), t("2020-06-01"), F.lit(None), t("2021-01-01")).alias("b"),
        temporal.status(t("2022-01-01"), t(None), F.lit(None), t("2021-01-01")).alias("c"), temporal.status(t("2022-01-01"), t(None), F.lit("x"), t("2021-01-01")).alias("d"),
        temporal.valid_closed(t("2020-01-01"), t("2021-01-01"), t("2021-01-01")).alias("e"), temporal.valid_half_open(t("2020-01-01"), t("2021-01-01"), t("2021-01-01")).alias("f"),
    ).first()
    assert tuple(row) == ("current", "expired", "pending", "superseded", True, False)


def test_change_detection(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 2), (3, None, 3), (4, "n", 1)], "id long, hash string, size long")
    b = spark.createDataFrame([(1, "x", 1), (2, "z", 2), (3, None, 4), (9, "q", 1)], "id long, hash string, size long")
    got = values(temporal.detect_changes(a, b, "id", [("hash", "content_hash"), ("size", "size")]))
    assert got == [(1, "unchanged", "same"), (2, "modified", "content_hash"), (3, "modified", "size"), (4, "added", "new"), (9, "deleted", "missing")]


def test_security_decisions(spark):
    rows = spark.createDataFrame(
        [(1, "restricted", [], None, None, None), (2, "nonsense", [], None, None, None), (3, None, ["g9"], None, None, None), (4, "public", ["g1"], "boss", ["me"], None), (5, "public", None, "boss", ["you"], None), (6, "public", None, None, None, "other")],
        "id long, c string, g array<string>, o string, v array<string>, d string",
    )
    user = security.User("reader", ("g1",), "mine", "me")
    got = values(rows.select("id", security.decision(user, F.col("c"), F.col("g"), F.col("o"), F.col("v"), F.col("d")).alias("r")))
    assert [r for _, r in got] == ["classification_denied", "classification_denied", "group_denied", "granted", "ownership_denied", "department_denied"]


def test_metrics_at_k(spark):
    ranked = spark.createDataFrame([("q", x, i) for i, x in enumerate("abcd", 1)] + [("z", "a", 1)], "query string, item string, position int")
    judged = spark.createDataFrame([("q", "b"), ("q", "d"), ("q", "x")], "query string, item string")
    got = {r.query: r for r in metrics.at_k(ranked, judged, 4).collect()}
    assert got["q"].precision == 0.5 and got["q"].recall == pytest.approx(2 / 3) and got["q"].reciprocal == 0.5 and got["q"].average == pytest.approx((1 / 2 + 2 / 4) / 3)
    assert got["z"].recall == 0 and got["z"].ndcg == 0


def test_activity(spark):
    e = spark.createDataFrame([("u", f"2024-01-0{d} 0{h}:00:00") for d, h in ((1, 1), (1, 2), (2, 1), (4, 5))], "user string, t string").withColumn("ts", F.to_timestamp("t"))
    assert [n for *_, n in sorted(values(activity.sliding_counts(e, ["user"], "ts", 86_400), "ts", "in_window"))] == [1, 2, 2, 1]
    assert activity.cooled(e, ["user"], "ts", 86_400).count() == 3
    assert [d for *_, d in values(activity.streaks(e, "user", "ts"))] == [2, 1]


def test_text_functions(spark):
    row = spark.range(1).select(
        N.bare_name(F.lit("  The  Big-Corp, Inc ")).alias("a"), N.relation_type(F.lit(None).cast("string")).alias("b"), N.semver(F.lit("1.2.3-rc.1")).alias("c"),
        N.similarity(F.lit("kitten"), F.lit("sitting")).alias("d"), chunking.sentences(F.lit("Dr. Who came. He left! no")).alias("e"), chunking.windows(N.words(F.lit("a b c d e")), 3, 1).alias("f"), N.jaccard(N.ngrams(N.words(F.lit("a b c d"))), N.ngrams(N.words(F.lit("b c d e")))).alias("g"),
    ).first()
    assert row.a == "bigcorp inc" and row.b == "RELATED_TO" and tuple(row.c) == (1, 2, 3, "rc.1", "", True) and row.d == pytest.approx(1 - 3 / 7)
    assert row.e == ["Dr. Who came.", "He left! no"] and [c.text for c in row.f] == ["a b c", "c d e"] and row.g == pytest.approx(1 / 3)


def test_nearest_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 5))
    rows = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = values(vectors.nearest(rows, rows.where("vec_id % 20 = 0"), 3), "query", "position", "item")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = unit @ unit[q]
        s[q] = -9
        assert [i for a, _, i in got if a == q] == list(np.argsort(-s)[:3])


def test_betweenness_matches_brandes_on_small_graphs(spark):
    import itertools
    import random

    random.seed(3)
    pairs = [p for p in itertools.combinations(range(7), 2) if random.random() < 0.4] + [(7, 8)]
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(10)}
    want = dict.fromkeys(range(10), 0.0)
    for s in range(10):
        dist, sigma, order = {s: 0}, collections.Counter({s: 1}), [s]
        for u in order:
            for w in near[u]:
                if w not in dist:
                    dist[w] = dist[u] + 1
                    order.append(w)
                if dist[w] == dist[u] + 1:
                    sigma[w] += sigma[u]
        delta = collections.Counter()
        for w in reversed(order):
            for u in near[w]:
                if dist.get(u, -9) == dist[w] - 1:
                    delta[u] += sigma[u] / sigma[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w] / 2
    v = spark.range(10)
    got = dict(values(graph.betweenness(v, spark.createDataFrame(pairs, "src long, dst long"), v)))
    assert {k: round(x, 6) for k, x in got.items()} == {k: round(x, 6) for k, x in want.items()}


def test_csv_fields(spark):
    from lodegraph.operators import screening

    row = spark.range(1).select(screening.csv_field(F.lit('x,"y')).alias("d"), screening.csv_field(F.lit(None)).alias("e"), screening.csv_row([F.lit(1), F.lit("a\nb"), F.lit("c")]).alias("f")).first()
    assert tuple(row) == ('"x,""y"', "", '1,"a\nb",c')



def test_overlaps_cover_every_pair(spark, tmp_path):
    from lodegraph.plans import catalogue

    items = [f"item{i} asks about thing{i} of the common words in place{i} now" for i in range(50)] + [None, "", "a bb"]
    docs = [(7, items[7]), (8, f"before it {items[45]} and after"), (47, f"{items[3]} {items[49]}"), (47, items[49]), (None, items[0]), (3, None), (4, "of the common")]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = lambda t: (t or "").lower().split()
    runs = lambda t: {tuple(words(t)[i : i + 3]) for i in range(len(words(t)) - 2)}
    jaccard, contained = [], []
    for d, text in docs:
        for i, item in enumerate(items):
            if both := runs(text) & runs(item):
                jaccard.append((d, i, round(len(both) / len(runs(text) | runs(item)), 6)))
            keys = {w for w in words(item) if len(w) > 2}
            if both := keys & set(words(text)):
                contained.append((d, i, round(len(both) / len(keys), 6)))
    for name, score, want in (("ngram_overlaps", "overlap", jaccard), ("keyword_overlaps", "contained", contained)):
        got = [(r.doc_id, r.item_id, r[score]) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
        assert collections.Counter(got) == collections.Counter(want)
    assert (7, 7, 1.0) in jaccard and any(x[:2] == (8, 45) for x in jaccard)
