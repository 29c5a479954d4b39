"""The queries of this subpackage against their SQL in DuckDB, at the smallest size."""

import duckdb
import pytest

from speechlake.llm.queries import QUERIES, SQL
from tests.test_queries import SF, TABLES, rows


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
