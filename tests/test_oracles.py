"""Every registered query of the library against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodegraph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "~" if v is None or v is pd.NA or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)
    return sorted([cell(x) for x in row] for row in frame.astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, duck, name):
    mine = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    if name not in catalogue.ORACLES:
        assert len(mine) > 0
        return
    theirs = duck.sql(catalogue.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert plain(mine) == plain(theirs)


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "True", done.stderr
