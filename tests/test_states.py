"""Breakers, delta syncs, change feeds, sketches, heavy hitters, as-of joins, chains and stored runs."""

import collections
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodegraph.operators import asof, breaker, chains, heavy, run_store, sketches
from lodegraph.operators.delta import DeltaTable
from lodegraph.sources.commits import CommitLog, Conflict
from lodegraph.sources.tables import scratch_path
from lodegraph.streaming import breakers as streamed
from lodegraph.streaming import feed as F_

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_a_breaker_opens_tries_again_and_closes():
    b = breaker.Breaker(breaker.Rule(window=10, reset=30, volume=4, threshold=0.5))
    for t, bad in ((0, True), (1, True), (2, False)):
        b.call(t, bad)
    assert b.state == "closed"  # too few calls
    b.call(3, True)
    assert b.told() == ("open", 3, 4, 3, 0, 1)
    b.call(20, False)
    assert b.rejected == 1 and b.at(32) == "open" and b.at(33) == "half-open"
    b.call(40, True)
    assert b.state == "open" and b.since == 40 and b.opened == 2
    b.call(71, False)
    assert b.state == "closed" and not b.recent
    for t in (80, 95, 110, 125, 140):
        b.call(t, True)
    assert b.state == "closed"  # never enough in a window


def test_streamed_breakers_equal_the_fold(spark, tmp_path):
    rng = random.Random(1)
    calls = [(i, f"s{rng.randint(0, 4)}" if i % 50 else None, at(i * 7 + rng.randint(0, 3)), rng.random() < (0.8 if i // 60 % 2 else 0.1) if i % 13 else None) for i in range(600)]
    schema = "k long, service string, ts timestamp, bad boolean"
    for part in range(6):
        spark.createDataFrame(calls[part * 100 : part * 100 + 100], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
    rule = breaker.Rule(window=200_000_000, reset=300_000_000, volume=5)
    whole = spark.read.parquet(str(tmp_path / "calls"))
    fold = {r.service: tuple(r) for r in breaker.replayed(whole, "service", "ts", F.col("bad"), "k", rule).collect()}
    plain, last = {}, 0
    for k, s, t, bad in sorted(calls, key=lambda c: (c[2], c[0])):
        if s:
            micros = int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
            last = max(last, micros)
            plain.setdefault(s, breaker.Breaker(rule)).call(micros, bool(bad))
    for b in plain.values():
        b.at(last)
    assert {s: (v[1], *v[3:]) for s, v in fold.items()} == {s: (b.state, b.calls, b.failures, b.rejected, b.opened) for s, b in plain.items()}
    assert any(v[6] > 1 for v in fold.values())
    assert {r.service: tuple(r) for r in streamed.breakers(spark, str(tmp_path / "calls"), "service", "ts", F.col("bad"), "k", rule).collect()} == fold
    assert breaker.replayed(whole.limit(0), "service", "ts", F.col("bad"), "k", rule).count() == 0


ITEMS = "source string, id string, seq long, created timestamp, modified timestamp, gone boolean, folder boolean, body string"


def items(spark, rows):
    return spark.createDataFrame([(s, i, q, at(c), at(m), g, f, b) for s, i, q, c, m, g, f, b in rows], ITEMS)


FIRST = [("a", "1", 1, 0, 0, False, False, "x"), ("a", "2", 2, 1, 1, False, False, "y"), ("b", "1", 1, 0, 5, False, False, "z"), ("a", "dir", 3, 0, 2, False, True, None)]
THEN = [*FIRST, ("a", "1", 4, 0, 10, False, False, "x2"), ("a", "3", 5, 9, 9, False, False, "n"), ("a", "2", 6, 1, 11, True, False, None), ("a", "3", 7, 9, 12, False, False, "n2")]


def test_delta_sync_counts_and_rows(spark):
    made = DeltaTable(spark, scratch_path(spark))
    assert made.current() is None and made.states().count() == 0
    assert made.sync(items(spark, FIRST)) == 1 and made.sync(items(spark, THEN)) == 2
    assert made.sync(items(spark, THEN)) == 2  # nothing new, no version
    told = {r.source: (r.offset, r.found, r.added, r.modified, r.deleted, r.runs) for r in made.states().collect()}
    assert told == {"a": (7, 7, 3, 1, 1, 2), "b": (1, 1, 1, 0, 0, 1)}
    assert {(r.source, r.id, r.body, r.change) for r in made.current().collect()} == {("a", "1", "x2", "modified"), ("a", "3", "n2", "added"), ("b", "1", "z", "added")}
    assert {r.id for r in made.current(until=1).where("source = 'a'").collect()} == {"1", "2"}
    assert made.reprocess(spark.createDataFrame([("a", "1")], "source string, id string"), lambda rows: rows.withColumn("body", F.upper("body"))) == 3
    assert {(r.id, r.body) for r in made.current().where("source = 'a'").collect()} == {("1", "X2"), ("3", "n2")}
    assert made.states().where("source = 'a'").first().offset == 7
    assert made.sync(items(spark, THEN[:3]), full=True) == 4
    assert {(r.source, r.id, r.body) for r in made.current().collect()} == {("a", "1", "x"), ("a", "2", "y"), ("b", "1", "z")}


def test_a_killed_sync_neither_loses_nor_repeats(spark, monkeypatch):
    path = scratch_path(spark)
    made = DeltaTable(spark, path)
    made.sync(items(spark, FIRST))
    before = sorted(map(tuple, made.current().drop("version").collect()))

    def killed(self, version, content):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            made.sync(items(spark, THEN))
    again = DeltaTable(spark, path)  # rows and offsets of the killed run lie in the folder, and nobody sees them
    assert sorted(map(tuple, again.current().drop("version").collect())) == before and again.states().where("source = 'a'").first().offset == 3
    assert again.sync(items(spark, THEN)) == 2
    whole = DeltaTable(spark, scratch_path(spark))
    whole.sync(items(spark, FIRST))
    whole.sync(items(spark, THEN))
    assert sorted(map(str, again.current().collect())) == sorted(map(str, whole.current().collect()))
    assert sorted(map(tuple, again.states().collect())) == sorted(map(tuple, whole.states().collect()))


def test_two_writers_of_a_version_conflict(spark):
    one, other = (CommitLog(spark, p) for p in [scratch_path(spark)] * 2)
    one.commit(1, {"a": "é"})
    with pytest.raises(Conflict):
        other.commit(1, {"b": 2})
    assert other.latest() == (1, {"a": "é"})
    with pytest.raises(Conflict):
        other.commit(3, {})
    other._fs, versions = other._fs, other.versions
    other.versions = lambda: []  # a writer that has looked before the other one committed
    with pytest.raises(Conflict):
        other.commit(1, {"b": 2})
    assert versions() == [1]


def test_feed_counts_repeats_once_and_batches_once(spark, tmp_path):
    rng = random.Random(8)
    states = ["approved", "uploaded", "processing", "archived"]
    once = [(f"d{i}", rng.choice(states), rng.choice(["u1", "u2", "u3", "unknown", None]), at(i * 60)) for i in range(200)]
    rows = [(*r[:3], r[3] + timedelta(seconds=rng.randint(0, 600))) for r in once for _ in range(rng.randint(1, 4))]
    rng.shuffle(rows)
    for part in range(4):
        spark.createDataFrame(rows[part::4], "id string, status string, user string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    stream = lambda: spark.readStream.schema("id string, status string, user string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "state")
    sink = F_.fed(stream(), ["id", "status"], "1 day", out, checkpoint)
    want = collections.Counter()
    for _, status, user, _ in once:
        if user not in ("unknown", None) and F_.POINTS.get(status):
            want[user] += F_.POINTS[status]
    assert {r.user: r.points for r in sink.totals().collect()} == dict(want)
    assert {r.user: r.points for r in F_.fed(stream(), ["id", "status"], "1 day", out, checkpoint).totals().collect()} == dict(want)  # on from the checkpoint
    some = spark.createDataFrame([("d", "approved", "u9", at(0))], "id string, status string, user string, ts timestamp")
    for _ in range(2):  # a batch that is delivered again
        sink(some, 77)
    assert {r.user: r.points for r in sink.totals().collect()}["u9"] == 50
    assert F_.points_of(stream().where("id = 'nobody'"), ["id"]).count() == 0


def test_sketches_keep_their_rank_error(spark):
    rows = spark.range(200_000).select((F.col("id") % 2).alias("key"), F.timestamp_seconds(1_700_000_000 + F.col("id") % 36_000).alias("ts"), (F.pow(F.rand(3), 4) * 1e6).alias("v"))
    rows.write.parquet(path := scratch_path(spark))
    rows = spark.read.parquet(path)
    buckets = sketches.bucketed(rows, "key", "ts", "v", 600, F.lit(5e5))
    found = sketches.sliding(buckets, "key", 600, 6).where("n > 10000").collect()
    exact = {(r.key, r.ends): r for r in sketches.sliding_exact(rows, "key", "ts", "v", 600, 6, (0.5, 0.95, 0.99)).collect()}
    values = collections.defaultdict(list)
    for r in rows.select("key", F.unix_seconds("ts").alias("t"), "v").collect():
        values[r.key].append((r.t, r.v))
    assert len(found) > 50
    for r in found[::10]:
        own = sorted(v for t, v in values[r.key] if r.ends - 3_600 <= t // 600 * 600 < r.ends)
        assert len(own) == r.n == exact[r.key, r.ends].n and r.breaches == sum(v > 5e5 for v in own) and r.breach_rate == r.breaches / r.n
        for p, got in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            assert abs(sum(v <= got for v in own) / len(own) - p) <= 2 * sketches.RANK_ERROR
            assert getattr(exact[r.key, r.ends], f"p{p * 100:g}") == own[-(-int(len(own) * p * 10_000) // 10_000) - 1]


def test_summary_holds_every_heavy_item():
    rng = random.Random(5)
    items = [f"h{i % 5}" for i in range(6_000)] + [f"x{rng.randint(0, 50_000)}" for _ in range(30_000)]
    rng.shuffle(items)
    true, summary = collections.Counter(items), heavy.Summary(200)
    for x in items:
        summary.add(x)
    assert len(summary.counts) == 200 and all(true[x] <= c and c - summary.errors[x] <= true[x] for x, c in summary.counts.items())
    assert {x for x, n in true.items() if n > len(items) / 200} <= set(summary.counts)


def test_heavy_hitters_of_a_stream(spark, tmp_path):
    rng = random.Random(6)
    words = [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randint(0, 20_000)}" for _ in range(20_000)] + [None]
    for part in range(3):
        spark.createDataFrame([(w,) for w in words[part::3]], "w string").coalesce(1).write.mode("append").parquet(str(tmp_path / "words"))
    stream = spark.readStream.schema("w string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "words"))
    stored = spark.read.parquet(str(tmp_path / "words"))
    true = collections.Counter(w for w in words if w)
    told = heavy.streamed_summary(stream, "w", counters=50, shards=4).collect()
    assert all(true[r["item"]] <= r["count"] and r["count"] - r.error <= true[r["item"]] for r in told) and len(told) == 200
    assert {r["item"]: r.n for r in heavy.frequent(spark, stream, stored, "w", 0.02, counters=50, shards=4).collect()} == {w: n for w, n in true.items() if n > 0.02 * 20_000}
    with pytest.raises(ValueError):
        heavy.frequent(spark, stream, stored, "w", 0.001, counters=50)


def test_as_of_against_all_versions(spark):
    rng = random.Random(7)
    versions = []
    for e in range(6):
        t = 0
        for k in range(200 if e == 0 else 8):
            start, t = t, t + rng.randint(0, 400)
            versions.append((e, f"{e}-{k:03}", at(start), None if rng.random() < 0.05 else at(t - rng.randint(0, 1) * min(50, t - start))))
    versions += [(None, "n", at(0), None), (1, "never", None, None)]
    probes = [(i, rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 9, None]), at(rng.randint(-50, 3_500)) if i % 40 else None) for i in range(500)] + [(900, 0, v[2]) for v in versions[:20]]
    v = spark.createDataFrame(versions, "e long, name string, since timestamp, until timestamp")
    p = spark.createDataFrame(probes, "i long, e long, t timestamp").repartition(4)
    found = asof.as_of(p, v, "e", "t", "since", "until", "name", bucket_seconds=300)

    def plain(e, t):
        own = [x for x in versions if x[0] == e and e is not None and t is not None and x[2] is not None and x[2] <= t]
        last = max(own, key=lambda x: (x[2], x[1]), default=None)
        return last[1] if last and (last[3] is None or last[3] > t) else None

    assert collections.Counter((r.i, r.name) for r in found.collect()) == collections.Counter((i, plain(e, t)) for i, e, t in probes)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
    instants = spark.createDataFrame([(at(s),) for s in (-100, 0, 5, 777, 10**6)] + [(None,)], "at timestamp")
    have = [x for x in versions if x[2] is not None or True]
    for r in asof.valid_at(v, instants, "e", "since", "until").collect():
        started, ended = sum(x[2] is None or x[2] <= r["at"] for x in have), sum(x[3] is not None and x[3] <= r["at"] for x in have)
        assert (r.started, r.ended, r.valid) == (started, ended, started - ended)


def test_chains_of_any_length_and_cycles(spark):
    links = [(i, i - 1 if i else None) for i in range(1_000)] + [(2_000, 999), (2_001, 999), (3_000, 5_555), (4_000, 4_001), (4_001, 4_002), (4_002, 4_000), (4_003, 4_000), (6_000, 6_000), (None, 3), (7, 6)]
    got = {r.id: (r.root, r.position, r.cyclic) for r in chains.ranked(spark.createDataFrame(links, "id long, before long"), "id", "before").collect()}
    assert all(got[i] == (0, i, False) for i in range(1_000)) and got[2_000] == got[2_001] == (0, 1_000, False) and got[3_000] == (3_000, 0, False)
    assert all(got[i] == (None, None, True) for i in (4_000, 4_001, 4_002, 4_003, 6_000)) and None not in got
    types = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "type string, now string")
    assert {r.type: (r.end, r.steps, r.cyclic) for r in chains.ends(types, "type", "now").collect()} == {"a": ("c", 2, False), "b": ("c", 1, False), "c": ("c", 0, False), "x": (None, None, True), "y": (None, None, True)}
    assert chains.ranked(spark.createDataFrame([], "id long, before long"), "id", "before").count() == 0


def test_stored_runs_and_matching(spark):
    store = run_store.RunStore(spark, scratch_path(spark))
    assert store.latest() is None and store.members().count() == 0 and store.summaries().count() == 0
    old = [(i, "a") for i in range(10)] + [(i, "b") for i in range(10, 16)] + [(i, "c") for i in range(16, 20)] + [(i, "d") for i in range(20, 24)] + [(30, "gone")]
    new = [(i, "a") for i in range(6)] + [(i, "a2") for i in range(6, 10)] + [(i, "B") for i in range(10, 16)] + [(i, "c") for i in range(16, 24)] + [(31, "fresh")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, community string")
    store.store("r1", "2024-01-01", frame(old))
    store.store("r2", "2024-01-02", frame([*new, (31, "zz"), (None, "n")]))
    with pytest.raises(ValueError):
        store.store("r2", "2024-01-03", frame(new))
    assert store.latest()["run_id"] == "r2" and store.members().count() == 25 and store.communities("r1", 5).count() == 2
    got = {(r.old, r.new, r.change) for r in run_store.compared(store.members("r1"), store.members()).collect()}
    assert got == {("a", "a", "changed"), ("a", "a2", "split"), ("b", "B", "renamed"), ("c", "c", "changed"), ("d", "c", "merged"), ("gone", None, "gone"), (None, "fresh", "new")}
    store.summarise(spark.createDataFrame([("r2", "a", "t", "one"), ("r2", "c", "t", "two"), ("r1", "a", "t", "old")], "run_id string, community string, title string, summary string"))
    store.summarise(spark.createDataFrame([("r2", "a", "t", "newer")], "run_id string, community string, title string, summary string"))
    store.delete_summary("c")
    assert {(r.community, r.summary) for r in store.summaries().collect()} == {("a", "newer")} and {r.summary for r in store.summaries(run_id="r1").collect()} == {"old"}
    assert {r.kind: r.n for r in store.stats().collect()} == {"run": 2, "community": 10, "member": 50, "summary": 2}
    assert store.retain(1) == ["r1"] and [r.run_id for r in store.snapshots().collect()] == ["r2"] and store.members("r1").count() == 0


def test_matching_is_greedy(spark):
    rng = random.Random(11)
    pairs = [(f"o{a}", f"n{b}", rng.randint(1, 6)) for a in range(25) for b in range(25) if rng.random() < 0.3]
    used, want = set(), set()
    for a, b, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b, n))
    assert {tuple(r) for r in run_store.matched(spark.createDataFrame(pairs, "old string, new string, common long")).collect()} == want
