"""Each stage of the pipeline against a plain version of it on a small table."""

import collections

import numpy as np
import pytest

import corpus_pipeline
from lodegraph.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeioustrnl"), size=rng.integers(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [text(30) for _ in range(3)]
    rows, labels = [], []
    for i in range(300):
        t = text(40)
        if junk := i % 5 == 2:
            t = t.upper().replace(" ", "!! ")
        if i % 50 == 1:
            t = t + " " + items[i % 3]
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        labels.append((i, int(not junk), 0))
    rows += [(300 + i, rows[i * 5][1], "en", "s1", 1) for i in range(10)]
    out = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, folder)
    ids = sorted(r.doc_id for r in good.collect())
    assert good.columns == docs.columns and len(set(ids) & {i for i in range(300) if i % 5 == 2}) <= 2 and len(ids) >= 248
    one = stages[1](spark, good, folder)
    kept = sorted(r.doc_id for r in one.collect())
    assert kept == [i for i in ids if i < 300] and one.columns == docs.columns
    clean = stages[2](spark, one, folder)
    left = sorted(r.doc_id for r in clean.collect())
    assert left == [i for i in kept if i % 50 != 1] and clean.columns == docs.columns
    mixed = stages[3](spark, clean, folder)
    counts = collections.Counter(r.doc_id for r in mixed.collect())
    want = {r.doc_id: r.copies for r in mixing.op3_mixing(spark, "", clean).collect() if r.copies}
    assert counts == want and mixed.columns == docs.columns
    last = stages[4](spark, mixed, folder).collect()
    assert collections.Counter(r.doc_id for r in last) == counts and {r.shard for r in last} == set(range(40))
