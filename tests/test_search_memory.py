"""What a task of the vector search allocates doesn't grow with the queries."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodegraph.operators import vectors as V


def test_a_task_holds_no_matrix_of_all_queries(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(8).tolist(), i % 7) for i in range(3_000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    inside, plain = [], type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, f, schema: (inside.append(f), plain(self, f, schema))[1])
    got = V.nearest(v, v, 5, other="label")
    table = v.select("vec_id", "embedding", F.xxhash64("label").alias("_group")).toArrow()
    tracemalloc.start()
    found = pa.Table.from_batches(list(inside[0](iter(table.combine_chunks().to_batches()))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == 15_000 and peak < 16_000_000
    unit = np.array([x[1] for x in rows], dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = unit @ unit.T
    scores[np.equal.outer(np.arange(3_000) % 7, np.arange(3_000) % 7)] = -2
    best = np.argsort(-scores, axis=1)[:, :5]
    mine = {(x.query, x.position): x.item for x in got.collect()}
    assert all(mine[q, p + 1] == best[q, p] for q in range(0, 3_000, 37) for p in range(5))
