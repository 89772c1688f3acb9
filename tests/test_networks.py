"""Communities, importance, paths and expansion against plain versions on small graphs."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegraph.operators import communities as C
from lodegraph.operators import graph as G
from lodegraph.operators import importance as I
from lodegraph.operators import paths as P


def table(spark, edges):
    e = spark.createDataFrame([(a, b, "USES", 0.5) for a, b in edges], "src string, dst string, type string, confidence double")
    return e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("type", F.when(F.col("id").startswith("a"), "A").otherwise("B")), e


@pytest.fixture(scope="module")
def ring(spark):
    """Four cliques of five in a ring, one edge between neighbours."""
    cliques = [[f"{g}{i}" for i in range(5)] for g in "abcd"]
    edges = [p for c in cliques for p in itertools.combinations(c, 2)] + [(cliques[k][0], cliques[(k + 1) % 4][1]) for k in range(4)]
    return table(spark, edges)


def test_louvain_finds_cliques(spark, ring):
    v, e = ring
    got = {r.id: r.community for r in C.louvain(v, e).collect()}
    assert got == {f"{g}{i}": f"{g}0" for g in "abcd" for i in range(5)}
    assert C.louvain(v, e.limit(0)).where("id = community").count() == 20 and C.louvain(v.limit(0), e).count() == 0
    listed = {r.community: (r.size, r.dominant) for r in C.listing(v, C.louvain(v, e)).collect()}
    assert listed["a0"] == (5, "A") and listed["d0"] == (5, "B")
    inner = C.inner_edges(e, C.louvain(v, e))
    assert inner.count() == 40


def test_louvain_is_near_the_best_partition(spark):
    rng = np.random.default_rng(3)
    edges = [(f"n{a}", f"n{b}") for a, b in itertools.combinations(range(24), 2) if rng.random() < (0.6 if a // 8 == b // 8 else 0.05)]
    v, e = table(spark, edges)
    got = C.louvain(v, e)
    planted = v.select("id", F.floor(F.substring("id", 2, 9).cast("int") / 8).alias("community"))
    value = lambda of: G.modularity(e, of).first().modularity
    assert value(got) >= value(planted) - 0.01


def test_incremental_communities(spark, ring):
    v, e = ring
    before = C.louvain(v, e)
    more = e.union(spark.createDataFrame([("z", "a0", "USES", 1.0), ("z", "a1", "USES", 1.0), ("z", "a2", "USES", 1.0)], e.schema))
    v2 = v.union(spark.createDataFrame([("z", "B")], v.schema))
    after, way = C.louvain_incremental(v2, more, before, spark.createDataFrame([("z",)], "id string"))
    got = {r.id: r.community for r in after.collect()}
    assert way == "incremental" and got["z"] == "a0" and got["b3"] == "b0"
    assert {r.community: r.change for r in C.changes(before, after).collect()} == {"a0": "changed", "b0": "same", "c0": "same", "d0": "same"}
    assert C.louvain_incremental(v, e, None, v.select("id"))[1] == "full" and C.louvain_incremental(v, e, before, v.select("id"))[1] == "full"


def brandes(nodes, edges):
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, sigma, order = {s: 0}, collections.Counter({s: 1}), [s]
        for x in order:
            for y in near[x]:
                if y not in dist:
                    dist[y] = dist[x] + 1
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    sigma[y] += sigma[x]
        delta = dict.fromkeys(order, 0.0)
        for y in reversed(order):
            for x in near[y]:
                if dist[x] == dist[y] - 1:
                    delta[x] += sigma[x] / sigma[y] * (1 + delta[y])
            if y != s:
                score[y] += delta[y] / 2
    return score


def test_importance_against_a_plain_version(spark):
    rng = np.random.default_rng(4)
    edges = list({(f"n{rng.integers(14)}", f"n{rng.integers(14)}") for _ in range(40)})
    v, e = table(spark, edges)
    nodes = sorted(r.id for r in v.collect())
    n = len(nodes)
    out = collections.Counter(a for a, _ in edges)
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(100):
        fresh = {x: 0.15 / n + 0.85 * sum(rank[a] / out[a] for a, b in edges if b == x) for x in nodes}
        done = max(abs(fresh[x] - rank[x]) for x in nodes) < 1e-6
        rank = fresh
        if done:
            break
    pr = G.pagerank(v, e, iterations=100)
    assert {r.id: r.rank for r in pr.collect()} == pytest.approx(rank, abs=1e-5)
    bc = I.normalised(G.betweenness(v, e, v.select("id")), n)
    plain = {x: s / ((n - 1) * (n - 2) / 2) for x, s in brandes(nodes, edges).items()}
    assert {r.id: r.score for r in bc.collect()} == pytest.approx(plain)
    scale = lambda m: {x: 0.5 if max(m.values()) == min(m.values()) else (m[x] - min(m.values())) / (max(m.values()) - min(m.values())) for x in m}
    mentions = {x: i % 4 for i, x in enumerate(nodes)}
    a, b, c = scale(rank), scale(plain), scale({x: k or 1 for x, k in mentions.items()})
    want = scale({x: 0.4 * a[x] + 0.35 * b[x] + 0.25 * c[x] for x in nodes})
    got = I.composite(pr, bc, spark.createDataFrame(list(mentions.items()), "id string, mentions long")).collect()
    assert {r.id: r.importance for r in got} == pytest.approx(want, abs=1e-4)
    assert sorted(r["rank"] for r in got) == list(range(1, n + 1)) and max(got, key=lambda r: r.importance)["rank"] == 1
    assert all(r.percentile == pytest.approx((n - r["rank"]) / n * 100) for r in got)
    both = {x: (rank[x] / max(rank.values()) + plain[x] / max(plain.values())) / 2 for x in nodes}
    assert {r.id: r.score for r in I.combined(pr, bc).collect()} == pytest.approx(both, abs=1e-3)


def test_paths_between_against_all_walks(spark):
    rng = np.random.default_rng(5)
    edges = list({(f"n{rng.integers(9)}", f"n{rng.integers(9)}") for _ in range(16)})
    v, e = table(spark, edges)
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    pairs = [("n0", "n1"), ("n2", "n3"), ("n0", "n8"), ("n4", "n4"), ("n0", "none")]

    def walks(path, goal):
        if len(path) > 1 and path[-1] == goal:
            yield path
        elif len(path) < 5:
            for x in near[path[-1]] - set(path):
                yield from walks([*path, x], goal)

    got = collections.defaultdict(list)
    for r in sorted(P.between(e, spark.createDataFrame(pairs, "a string, b string"), 4, 1000).collect(), key=lambda r: r.place):
        got[r.a, r.b].append(list(r.path))
    for a, b in pairs:
        want = sorted((w for w in walks([a], b) if a != b), key=lambda w: (len(w), ">".join(w)))
        assert got[a, b] == want
    ids, steps = P.parts(P.between(e, spark.createDataFrame(pairs, "a string, b string"), 4, 1000))
    every = [w for ws in got.values() for w in ws]
    assert {r.id for r in ids.collect()} == {x for w in every for x in w} and {(r.src, r.dst) for r in steps.collect()} == {s for w in every for s in zip(w, w[1:], strict=False)}


def test_expansion_by_priority_against_a_queue(spark):
    rng = np.random.default_rng(6)
    edges = list({(f"n{rng.integers(20)}", f"n{rng.integers(20)}") for _ in range(45)})
    v, e = table(spark, edges)
    score = {r.id: float(rng.random()) for r in v.collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for seed, most, depth in (("n0", 6, 2), ("n1", 9, 3), ("n2", 30, 2)):
        seen, queue, done = {seed: 0}, {seed: 1e9}, set()
        while len(seen) < most and (open_ := [x for x in queue if x not in done and seen[x] < depth]):
            top = max(open_, key=lambda x: queue[x])
            done.add(top)
            for x in sorted(near[top] - set(seen), key=lambda x: -score[x]):
                if len(seen) < most:
                    seen[x], queue[x] = seen[top] + 1, score[x] * 1.5 * (0.5 + 0.8)
        got = P.expanded(e, spark.createDataFrame(list(score.items()), "id string, importance double"), spark.createDataFrame([(seed,)], "id string"), most, depth, {"USES": 0.8})
        assert {r.id: r.hops for r in got.collect()} == seen
