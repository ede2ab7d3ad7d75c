"""The corpus operators that have SQL give DuckDB's rows on the small tables."""

import os

import pytest

from foliant.llm import queries, sql
from tests.test_catalog import SF, plain

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF}/{file}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    want = con.sql(sql.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)
