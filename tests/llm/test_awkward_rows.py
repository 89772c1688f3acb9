"""Every operator and every stage on nulls in any column, empty and very long texts, ties, repeated rows, no rows, and columns with clashing names."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from lodegraph.llm import entry

EXTRA = (
    "_copies", "_id", "_leak", "_hash", "score", "text_score", "meta_score", "_score", "node", "token", "shard", "slot", "size", "k1", "k2", "k3", "_k1", "_b", "_h", "_s", "_block", "key", "other", "label", "keep", "copies", "target",
    "taken", "placements", "component", "component_id", "n_links", "spans", "found", "own", "next_text", "c0_", "row", "words", "window", "law", "_doc", "_text", "_at", "_part",
)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def sentence(rng, n):
    return " ".join("".join(rng.choice(list("aeioustrnl"), size=rng.integers(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(77)
    plain = [(i, sentence(rng, int(rng.integers(3, 80))), "en", f"s{i % 3}", 100) for i in range(40)]
    odd = [
        (None, None, None, None, None), (None, "", None, "s1", None), (None, plain[3][1], "en", None, 5), (100, None, "en", "s1", 7), (101, "", "", "", 0), (102, "  \n\t ", "de", "s2", -1), (103, sentence(rng, 20_000), "en", "s0", 9),
        (104, "same " * 1_500, "en", "s0", 9), (105, "x" * 100_000, "en", "s0", 9), (106, "\U0001f600 é̂ \u0000 ok", "en", "s0", 9), plain[5], plain[5], (5, "another text under the same id", None, None, None), (107, plain[7][1], "en", "s9", 3),
        (2**62, plain[7][1], "en", "s9", 3), (-5, "token=" + "A" * 5_000 + " 1" * 3_000, "en", "s9", 3),
    ]
    return plain + odd


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).write.parquet(f"{out}/documents.parquet")
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(None, 1, 0), (5, None, None), (7, 1, 1), (7, 0, 1), (999, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    vectors = [(i, [float(i % 7), -float(i % 5), 0.25] * 3, i % 3) for i in range(40)] + [(None, None, None), (3, [0.0] * 9, None), (3, [0.0] * 9, None), (4, [float("nan")] * 9, 1), (5, [None], 2), (6, [], 2)]
    spark.createDataFrame([(*v, "x", "y") for v in vectors], "vec_id long, embedding array<float>, label int, code string, entry string").write.parquet(f"{out}/embeddings.parquet")
    items = [(0, rows[9][1]), (1, None), (2, ""), (3, rows[9][1]), (4, "same " * 300), (None, "an item without an id")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{out}/{name}.parquet")
    return out


EACH_ROW = {"op1_toxicity", "op2_sharding", "op3_mixing", "op5_ngram_join", "op6_pii", "op7_fingerprint", "op8_quality", "op10_secrets", "op12_token_ids", "op13_merkle"}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_operator(spark, folder, empty, rows, name):
    got = entry.queries()[name](spark, folder).collect()
    if name in EACH_ROW:
        count = lambda ids: collections.Counter(ids)
        assert count(r.doc_id for r in got) == count(r[0] for r in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.vec_id if name == "op11_codes" else r.doc_id].append(r)
    if name == "op1_toxicity":
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got) and len({r.score for r in got}) > 20
    elif name == "op2_sharding":
        slots = collections.defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r.size for r in by[100]} == {16}
    elif name == "op3_mixing":
        assert all(r.taken <= 2 * r.size for r in got) and {r.size for r in by[101]} == {0}
    elif name == "op4_decontamination":
        assert {(r.doc_id, r.item_id) for r in got} >= {(9, 0), (104, 4)} and {r.item_copies for r in by[9]} == {2}
    elif name == "op5_ngram_join":
        assert {r.component_id for r in by[7]} == {7} == {r.component_id for r in by[107]} == {r.component_id for r in by[2**62]} and {r.n_links for r in by[7]} == {2}
        assert sorted(r.n_links for r in by[5]) == [0, 2, 2, 2]
        assert {r.n_shingles for r in by[104]} == {1} and {r.n_shingles for r in by[102]} == {0}
    elif name == "op7_fingerprint":
        assert len({r.fingerprint for r in by[5]}) == 2 and {r.n_chars for r in by[105]} == {100_000}
    elif name == "op9_passages":
        assert all(r.doc_id is not None and r.end_word - r.start_word >= 50 for r in got)
    elif name == "op11_codes":
        assert len(got) == 43 and len(by[3]) == 3 and len(by[4]) == 1 and {len(r.code) for r in got} == {16}
    elif name == "op12_token_ids":
        assert {r.n_tokens for r in by[100]} == {1} and len({r.start for r in got}) == len(rows)
    elif name == "op13_merkle":
        assert len({r.root for r in got}) == 1 and {r.verified for r in by[100]} == {True}
    elif name == "op10_secrets":
        assert by[-5][0].n_assign == 1
    assert entry.queries()[name](spark, empty).count() == 0


def test_stages_one_after_another(spark, folder, empty):
    for path in (folder, empty):
        docs = spark.read.parquet(f"{path}/documents.parquet")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, path)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns, name
                docs.write.mode("overwrite").parquet(f"{path}/{name.replace(' ', '_')}")
                docs = spark.read.parquet(f"{path}/{name.replace(' ', '_')}")
        left = docs.collect()
        assert bool(left) == (path == folder) and all(r.slot >= 0 and 0 <= r.shard < 40 for r in left)
    kept = spark.read.parquet(f"{folder}/n-gram_Jaccard_join").select("doc_id", "text").collect()
    assert collections.Counter(r.doc_id for r in kept)[107] == 0
    assert 9 not in {r.doc_id for r in spark.read.parquet(f"{folder}/benchmark_decontamination").collect()}


def test_each_stage_keeps_what_it_must(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda frame: collections.Counter(r.doc_id for r in frame.select("doc_id").collect())
    every, one = ids(docs), ids(stages["n-gram Jaccard join"](spark, docs, folder))
    assert one[7] == 1 and one[107] == 0 == one[2**62] and one[104] == 1 and one[5] == 2 and one[100] == one[101] == one[102] == 1
    clean = ids(stages["benchmark decontamination"](spark, docs, folder))
    assert every - clean == collections.Counter({9: 1, 104: 1})
