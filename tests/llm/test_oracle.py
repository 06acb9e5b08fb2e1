"""Queries with SQL, on whole small tables."""

import glob
import os

import duckdb
import pytest

from faultlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(want.columns)
    got = queries.queries()[name](spark, SF).select(*names)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.select(*names).fetchall()))
