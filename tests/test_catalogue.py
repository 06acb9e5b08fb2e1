import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from faultlens.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    want = con.sql(catalogue.SQL[name])
    names = sorted(want.columns)
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.select(*(f'"{n}"' for n in names)).fetchall()))


def test_every_query_has_sql_and_the_entry_runs(spark):
    assert set(catalogue.QUERIES) == set(catalogue.SQL) and set(catalogue.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(("name", "cuts"), [("metrics_row", (" WHERE p_partkey <= 60", " WHERE p_partkey <= 40", " WHERE doc_id < 50")), ("existing_artifacts", (" WHERE n_nationkey < 5",))])
def test_no_subset_of_ids(spark, con, name, cuts):
    """The query's SQL without its filters on ids: every part, document and nation."""
    sql = catalogue.SQL[name]
    for cut in cuts:
        sql = sql.replace(cut, "")
    want = con.sql(sql)
    names = sorted(want.columns)
    got = sorted(map(repr, map(tuple, catalogue.QUERIES[name](spark, SF).select(*names).collect())))
    assert got == sorted(map(repr, want.select(*(f'"{n}"' for n in names)).fetchall()))
    if name == "metrics_row":
        assert len(got) == con.sql("SELECT count(*) FROM part").fetchall()[0][0]


def test_fenced_block_reads_the_fences_of_turns(spark, tmp_path):
    rows = [(1, 0, "see\n```python\nx = 1\n```\nend"), (1, 1, " plain "), (2, 0, "```\nls\n```\n```python\ny\n```")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, catalogue.QUERIES["fenced_block"](spark, str(tmp_path)).select("conv_id", "turn", "code").collect()))
    assert got == [(1, 0, "x = 1"), (1, 1, "plain"), (2, 0, "y")]
