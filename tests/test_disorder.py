"""Queries on an events table of many files in no order, with many rows of a key and an hour, against their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodegraph.plans import catalogue
from test_oracles import plain


@pytest.fixture(scope="module")
def disordered(tmp_path_factory):
    """6,000 events of 3 types and 7 users within four weeks, by id and time dealt over 24 files at random."""
    r, n = np.random.default_rng(3), 6_000
    ts = np.sort(r.integers(0, 28 * 86_400_000_000, n)) + pd.Timestamp("2024-01-01").value // 1000
    ts[:3_000] = np.sort(r.integers(0, 3_600_000_000, 3_000)) + pd.Timestamp("2024-01-01").value // 1000  # an hour with many
    kinds = r.choice(["error", "signup", "view"], n, p=[0.02, 0.03, 0.95])
    kinds[-1_000:] = "error"
    rows = pd.DataFrame({"event_id": np.arange(n), "ts": ts.astype("datetime64[us]"), "user_id": r.integers(0, 7, n), "event_type": kinds, "value": np.round(r.exponential(50, n), 2), "props": "{}"})
    at = tmp_path_factory.mktemp("disordered")
    (at / "events.parquet").mkdir()
    for i, part in rows.sample(frac=1, random_state=1).groupby(r.integers(0, 24, n)):
        part.to_parquet(at / "events.parquet" / f"{i:02d}.parquet", coerce_timestamps="us", index=False)
    return str(at)


@pytest.mark.parametrize("name", ["sliding_percentiles", "streamed_percentiles", "streamed_breakers", "streamed_deletions", "sync_sessions"])
def test_rows_in_no_order(spark, disordered, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{disordered}/events.parquet/*.parquet'")
    mine, theirs = catalogue.QUERIES[name](spark, disordered).toPandas(), con.sql(catalogue.ORACLES[name]).df()
    assert len(theirs) > 0 and plain(mine) == plain(theirs)
