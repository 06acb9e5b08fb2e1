import __spark_entry__ as entry
import duckdb
import pytest


@pytest.mark.parametrize("name", ["hex_and_format", "confidence_pct", "rounded_seconds"])
def test_rounding_is_that_of_sql(spark, tmp_path, name):
    """Halves of either neighbour in doubles, signs of zero, values that aren't finite, and null."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT row_number() OVER () AS o_orderkey, p AS o_totalprice, CASE WHEN p IS NOT NULL THEN '1-URGENT' END AS o_orderpriority FROM (
        SELECT i * 500::DOUBLE AS p FROM range(-2000, 2000) t(i) UNION ALL SELECT i * 7 / 1000 FROM range(1, 20000) t(i)
        UNION ALL SELECT unnest([NULL, 'nan'::DOUBLE, 'inf'::DOUBLE, '-inf'::DOUBLE, -0.0::DOUBLE, -400.0, 1e15]))) TO '{tmp_path}/orders.parquet'""")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = con.sql(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and sorted(map(repr, got)) == sorted(map(repr, want))
