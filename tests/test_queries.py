"""Every query against its SQL in DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from eventloom.plans import data_queries, tokenizer_queries, tokenizer_sql

FOLDER = "/root/testdata/sf0.001"
QUERIES = tokenizer_queries.queries() | data_queries.queries()
SQL = tokenizer_sql.oracle_sql() | data_queries.oracle_sql()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        null = lambda v: v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v))
        df[c] = [None if null(v) else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or df[c].dtype.kind in "iuf" else str(v) for v in df[c]]
    return df.fillna("null").sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
    return c


def test_names():
    assert set(SQL) <= set(QUERIES) and len(SQL) >= 35


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, con, name):
    got, want = normal(QUERIES[name](spark, FOLDER).toPandas()), normal(con.sql(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.count() >= 0 and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
