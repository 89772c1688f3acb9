"""Components of graphs with hubs, whose rows are not joined by node."""

import os

import numpy as np
import pytest

from lodegraph.operators import components as K


def _expected(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(K, "HUB", 20)
    r = np.random.default_rng(2)
    pairs = [(500, i) for i in range(100)] + [(0, 500 + i) for i in range(60)] + [(700 + i, 701 + i) for i in range(30)] + [(900, 900)]
    pairs += [(int(a), int(b)) for a, b in r.integers(1000, 1200, (150, 2))]
    e = spark.createDataFrame(pairs, "a long, b long")
    got = {x.node: x.component for x in K.connected_components(e, hubs=True).collect()}
    assert got == _expected(pairs)


def test_rows_of_hubs_stay_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(K, "HUB", 20)
    rows = spark.createDataFrame([(0, i) for i in range(1, 50)] + [(1, 0)], "u long, v long")
    got = K._with_least(rows, True)
    assert sorted((x.u, x.v, x.m) for x in got.collect()) == sorted([(0, i, 0) for i in range(1, 50)] + [(1, 0, 0)])
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("hubs", [False, True])
def test_tables_of_a_round_are_deleted(spark, monkeypatch, hubs):
    """Of all tables that rounds write, those that the result reads remain."""
    write, folders = K.written, set()

    def noted(frame, *rest):
        out = write(frame, *rest)
        folders.update(f.rpartition("/")[0].removeprefix("file:").replace("///", "/") for f in out.inputFiles())
        return out

    monkeypatch.setattr(K, "written", noted)
    links = [(i, i + 1) for i in range(60) if i != 30] + [(70, 70)]
    got = {tuple(x) for x in K.connected_components(spark.createDataFrame(links, "a long, b long"), hubs=hubs).collect()}
    assert got == {(i, 0 if i <= 30 else 31) for i in range(61)} | {(70, 70)}
    assert len(folders) > 6 and sum(map(os.path.isdir, folders)) <= 2
