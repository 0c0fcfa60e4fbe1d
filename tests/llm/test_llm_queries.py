import os

import duckdb
import pandas as pd
import pytest
from test_queries import normal

from eventloom.llm import oracle, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, FOLDER)
    if name in oracle.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(FOLDER):
            con.execute(f"create view {f[:-8]} as select * from '{FOLDER}/{f}'")
        pd.testing.assert_frame_equal(normal(got.toPandas()), normal(con.sql(oracle.oracle_sql()[name]).df()), check_dtype=False)
    else:
        assert got.count() >= 0
