"""Every registered query with SQL gives DuckDB's rows."""

import os

import duckdb
import pandas as pd
import pytest

from kbengine.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return bool(v)
    return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v


def rows(frame, columns):
    return sorted(str([plain(x) for x in r]) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, name):
    got, want = registry.QUERIES[name](spark, DIR).toPandas(), con.sql(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() >= 0
