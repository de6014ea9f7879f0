"""Every query with SQL is held against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tideframe.plans import catalog, feature_queries, inference_queries, kernel_queries, market_queries, panel_queries, rolling_queries, scoring_queries  # noqa: E402, F401


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def rows(df):
    def value(x):
        if x is None or x is pd.NA or x != x:
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, float, np.integer, np.floating)):
            return round(float(x), 5) + 0.0
        return str(x)

    names = sorted(df.columns)
    return sorted((tuple(value(x) for x in r) for r in df[names].astype(object).itertuples(index=False)), key=str), names


def near(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(x))) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got, names = rows(catalog.QUERIES[name](spark, sf).toPandas())
    want, other = rows(duck.execute(catalog.ORACLE[name]).df())
    assert names == other
    assert len(got) == len(want)
    assert all(map(near, got, want))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).columns
