"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import datetime
import decimal
import os

import pytest

from foliant.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert rows
        return
    want = db.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)


def test_names_agree():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def cut_pages(spark, folder):
    """Pages whose heading and first paragraph end inside a reference or after one."""
    cuts = ["&quot", "&quo", "&lt", "&nbsp", "&copy", "&#39", "&amp", "&am", "&", "&amp;quot", "&amp;lt", "&quot;", "&lt;", "&#39;", "&amp;"]
    words = "a paragraph of rather more than forty characters in all "
    page = f"<html><head></head><body><article><h1>token = {{0}}</h1><p>{words}{{0}}</p><p>{words * 5}</p></article></body></html>"
    rows = [(k, f"https://h.example/{k}", page.format(cuts[k % len(cuts)])) for k in range(20 * len(cuts))]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return con


def test_article_ladders_of_cut_references(spark, tmp_path):
    con = cut_pages(spark, tmp_path)
    df = catalog.QUERIES["article_ladders"](spark, str(tmp_path))
    want = con.sql(catalog.ORACLES["article_ladders"]).select(*df.columns).fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_release_pages_of_cut_references(spark, tmp_path):
    con = cut_pages(spark, tmp_path)
    df = catalog.QUERIES["release_pages"](spark, str(tmp_path))
    want = con.sql(catalog.ORACLES["release_pages"]).select(*df.columns).fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
