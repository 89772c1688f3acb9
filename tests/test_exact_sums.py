"""Sums of a rule's amounts that are just its threshold, in whatever order the rows come, and amounts that no decimal holds."""

import itertools

from lodegraph.operators.rules import Rule, broken

VOLUME = (Rule("volume", (), 0.6, 600, "value"),)


def test_a_sum_that_is_just_the_threshold_reaches_it(spark):
    rows = [(i, "view", f"2024-01-01 00:00:0{k}", x) for i, xs in enumerate(itertools.permutations([0.1, 0.2, 0.3])) for k, x in enumerate(xs)]
    rows += [(10, "view", "2024-01-01 00:00:00", float("nan")), (11, "view", "2024-01-01 00:00:00", 1e300), (12, "view", "2024-01-01 00:00:00", None)]
    e = spark.createDataFrame(rows, "user_id int, kind string, ts string, value double").selectExpr("user_id", "kind", "cast(ts as timestamp) as ts", "value")
    got = {r.user_id: (r.most, r.alerts) for r in broken(e, VOLUME, "user_id", "kind", "ts").collect()}
    assert all(got[i] == (0.6, 1) for i in range(6))
    assert got[10][0] != got[10][0] and got[10][1] == 1 and got[11] == (1e300, 1) and got[12] == (None, 0)
