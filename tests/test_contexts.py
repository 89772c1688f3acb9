"""Contexts, relations against true ones, exports, ranks and advice."""

import random

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import communities, exports, graph, graph_context, ontology, ranking, relation_eval, store
from lodegraph.sources.tables import scratch_path


def test_context_has_four_sections_in_order(spark):
    entities = spark.createDataFrame([(1, "B", "role", None, 0.8), (1, "A", "", "does", 0.6), (1, "C", None, "", None), *[(1, f"x{i:02}", "t", None, 0.1) for i in range(20)], (2, "Z", "t", None, 0.5)], "query long, name string, type string, description string, importance double")
    relations = spark.createDataFrame([(1, i, f"s{i}", "USES", "d") for i in range(40)], "query long, place long, src string, type string, dst string")
    passages = spark.createDataFrame([(1, 2, None, 0, "second"), (1, 1, "f.pdf", 3, "first")], "query long, place int, source string, page int, content string")
    known = spark.createDataFrame([("c1", "Two", 5, "both"), ("c2", None, None, "half"), ("c3", "None", 1, "none")], "community string, title string, size long, summary string")
    keys = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c2", "C"), ("c2", "q"), ("c3", "w")], "community string, name string")
    got = {r["query"]: r.context for r in graph_context.graph_context(entities, relations, passages, known, keys).collect()}
    parts = got[1].split("\n\n## ")
    assert [p.split("\n")[0].removeprefix("## ") for p in parts] == list(graph_context.TITLES)
    assert parts[0].split("\n")[1:4] == ["**B** (role) [Key Entity]", "**A** [Important] : does", "**x00** (t)"] and len(parts[0].split("\n")) == 11
    assert parts[1].split("\n")[1] == "- s0 --[USES]--> d" and len(parts[1].split("\n")) == 31
    assert parts[2] == "Source Documents\n### Source 1: f.pdf (Page 3)\nfirst\n\n### Source 2: Unknown\nsecond"
    assert parts[3] == "Knowledge Community Insights\n### Two (5 entities)\nboth\n\n### Knowledge Community (N/A entities)\nhalf"
    assert got[2] == "## Relevant Entities\n**Z** (t)"


RELATION = "item long, i long, src string, dst string, type string"


@pytest.mark.parametrize("mode", relation_eval.MODES)
def test_relations_are_matched_one_to_one(spark, mode):
    truth = [(1, 1, "The Order Service", "Billing", "USES"), (1, 2, "Billing", "Ledger", "USES"), (1, 3, "Ann", "Team", "PART_OF"), (2, 4, "Only", "Here", "USES"), (3, 5, "a", "b", "T")]
    found = [(1, 1, "order service", "billing", "USES"), (1, 2, "Ledger", "Billing", "USES"), (1, 3, "Anne", "Team", "PART_OF"), (1, 4, "order servise", "Billing", "USES"), (1, 5, "Ann", "Team", "USES"), (2, 6, "Something", "Else", "USES")]
    x, t = spark.createDataFrame(found, RELATION), spark.createDataFrame([(i, j, *r) for i, j, *r in truth], RELATION.replace(" i ", " j ").replace("item long, i", "item long, j"))
    got = {(r.i, r.j): r.direction for r in relation_eval.matches(x, t, mode).collect()}
    want = {"strict": {(1, 1): True}, "partial": {(1, 1): True}, "direction_agnostic": {(1, 1): True, (2, 2): False}}
    if mode == "type_only":
        assert got[1, 1] and got[2, 2] is False and got[3, 3] and len({i for i, _ in got}) == len(got) == len({j for _, j in got})
    else:
        assert got == want[mode]
        per = relation_eval.scores(x, t, relation_eval.matches(x, t, mode), ["item"])
        one = {r["item"]: r for r in per.collect()}
        n = len(want[mode])
        assert (one[1].tp, one[1].fp, one[1].fn, one[2].tp, one[2].fp, one[3].fn) == (n, 5 - n, 3 - n, 0, 1, 1) and one[1].direction_accuracy == 1 / n
        whole = relation_eval.batch(per).first()
        assert whole["items"] == 3 and whole.micro_recall == n / 5 and whole.macro_precision == pytest.approx(n / 5 / 3)


@pytest.mark.parametrize("form", ["csv", "json"])
def test_graphs_come_back_as_they_were(spark, form):
    nodes = [("1", 'say "x", y', "a\nb", None, 0.5), ("2", "", "t", "é", None), ("3", None, None, 'end"', 1.0)]
    edges = [("e", "1", "2", "a,b"), ("f", "2", "3", None)]
    path = scratch_path(spark)
    exports.write_graph(spark.createDataFrame(nodes, "id string, label string, type string, description string, confidence double"), spark.createDataFrame(edges, "id string, source string, target string, label string"), path, form)
    back = exports.read_graph(spark, path)
    nodes = [(*n[:1], *(None if form == "csv" and x == "" else x for x in n[1:])) for n in nodes]  # CSV does not tell an empty text from a null
    assert sorted(map(tuple, back[0].collect())) == sorted(nodes) and sorted(map(tuple, back[1].collect())) == sorted(edges)
    assert spark.read.json(f"{path}/metadata").first().node_count == 3


def test_log_forms_hold_the_same_rows(spark):
    rows = spark.createDataFrame([(1, 'a "b"', None), (2, "c,d", "x")], "id long, what string, more string")
    assert {r.l for r in rows.select(exports.json_line(["id", "what", "more"]).alias("l")).collect()} == {'{"id":1,"what":"a \\"b\\"","more":null}', '{"id":2,"what":"c,d","more":"x"}'}
    exports.write_log(rows, path := scratch_path(spark), "ndjson", ["id", "more"])
    assert {tuple(r) for r in spark.read.schema("id long, more string").json(path).collect()} == {(1, None), (2, "x")}
    with pytest.raises(ValueError):
        exports.write_log(rows, path, "xml", ["id"])


def test_places_over_ranges_and_parts(spark):
    rng = random.Random(2)
    rows = [(i, 0.0 if i % 3 else rng.random(), i % 4) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "id long, score double, g long").repartition(6)
    want = {i: k for k, (i, s, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    got = communities.ranked(frame, F.col("score"))
    assert {r.id: r["rank"] for r in got.collect()} == want and got.where("id = 0").first().percentile == pytest.approx((3_000 - want[0]) / 30)
    best = ranking.best_of(frame, ["g"], 5, [F.desc("score"), F.col("id")], F.col("id")).collect()
    for g in range(4):
        assert [r.id for r in sorted((r for r in best if r.g == g), key=lambda r: r.place)] == [i for i, s, k in sorted(rows, key=lambda r: (-r[1], r[0])) if k == g][:5]
    assert communities.ranked(frame.limit(0), F.col("score")).count() == 0


def test_removals_break_edges_and_are_advised(spark):
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "b", "T"), ("b", "c", "T"), ("c", "c", "T")], "src string, dst string, type string")
    assert sorted(r.id for r in graph.broken_edges(edges).collect()) == ["a", "b", "b", "c", "c"]
    assert graph.broken_edges(edges, spark.createDataFrame([("a",)], "id string")).count() == 1
    told = spark.createDataFrame([(0, 0), (3, 0), (11, 0), (2, 1), (2, 6)], "d long, c long").select(graph.advice(F.col("d"), F.col("c")).alias("a")).collect()
    assert [r.a for r in told] == ["ok", "info", "notice", "warning", "caution"]


def test_trees_subtypes_and_look_ups(spark):
    parents = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "c"), ("e", "c"), ("x", "y"), ("y", "x"), ("z", "r")], "type string, parent string")
    assert {r.type: r.tree for r in ontology.tree(parents).collect()} == {"a": "a(b, c(d, e))", "r": "r(z)"}
    got = {(r.root, r.type): (r.depth, r.leaf) for r in ontology.subtypes(ontology.closure(parents), spark.createDataFrame([("a",)], "type string")).collect()}
    assert got == {("a", "a"): (0, False), ("a", "b"): (1, True), ("a", "c"): (1, False), ("a", "d"): (2, True), ("a", "e"): (2, True)}
    table = spark.createDataFrame([("USES", "A", "B"), ("OWNS", "C", "D")], "relation string, domain string, range string")
    told = {tuple(r) for r in ontology.ends_of(table, spark.createDataFrame([("OWNS", "OWNED_BY")], "relation string, inverse string")).collect()}
    assert told == {("USES", "A", "B", None), ("OWNS", "C", "D", "OWNED_BY")}


def test_sweeps_write_what_they_take_away(spark):
    rows = spark.range(100).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400).alias("ts")).union(spark.createDataFrame([(500, None)], "id long, ts timestamp"))
    old, new = scratch_path(spark), scratch_path(spark)
    assert store.archived(rows, "ts", 30, old, new, dry=True) == (69, 32)
    for _ in range(2):
        assert store.archived(rows, "ts", 30, old, new) == (69, 32)
    assert {r.id for r in spark.read.json(old).collect()} == set(range(69)) and {r.id for r in spark.read.parquet(new).collect()} == {*range(69, 100), 500}


def test_samples_bridges_and_parts_of_graphs(spark):
    v = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")], "src string, dst string")
    exact = graph.betweenness(v, e, v)
    assert {r.id for r in graph.bridges(exact, 7, 0.3).collect()} == {"c", "d"}
    some = graph.sampled(v, 4)
    assert some.count() == 4 and sorted(r.id for r in some.collect()) == sorted(r.id for r in graph.sampled(v, 4).collect()) and graph.sampled(v, 99).count() == 7
    kept, links = graph.part(v, e, spark.createDataFrame([("d",), ("e",), ("f",), ("a",), ("q",)], "id string"))
    assert sorted(r.id for r in kept.collect()) == ["a", "d", "e", "f"] and links.count() == 3
    found = {r.id: r.community for r in communities.louvain(kept, links).collect()}
    assert found == {"a": "a", "d": "d", "e": "d", "f": "d"}
