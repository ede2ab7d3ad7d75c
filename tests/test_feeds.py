"""Written feeds: files that parse, their limits, and folders that are pruned."""

import hashlib
import json
import os
import xml.etree.ElementTree as ET

import pytest

from foliant.operators import feeds
from foliant.sources import texts

ATOM, MAP = "{http://www.w3.org/2005/Atom}", "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def written(spark, files, folder):
    got = {r.name: r for r in texts.write_texts(files, folder).collect()}
    root = folder.removeprefix("file://")
    out = {name: open(f"{root}/{name}", encoding="utf-8").read() for name in got}
    assert all(r.n_bytes == len(out[n].encode()) and r.sha256 == hashlib.sha256(out[n].encode()).hexdigest() for n, r in got.items())
    return out


def test_sitemaps(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"a/{k}?x=1&y=<{k}>") for k in range(25)][::-1], "id long, loc string").repartition(4)
    out = written(spark, feeds.sitemap_files(pages, "https://s.example/", per_file=10), str(tmp_path))
    assert set(out) == {"sitemap.xml", "sitemap-1.xml", "sitemap-2.xml", "sitemap-3.xml"}
    locs = [e.text for k in (1, 2, 3) for e in ET.fromstring(out[f"sitemap-{k}.xml"]).iter(f"{MAP}loc")]
    assert locs == [f"https://s.example/a/{k}?x=1&y=<{k}>" for k in range(25)]
    assert [e.text for e in ET.fromstring(out["sitemap.xml"]).iter(f"{MAP}loc")] == [f"https://s.example/sitemap-{k}.xml" for k in (1, 2, 3)]
    none = written(spark, feeds.sitemap_files(pages.limit(0), "https://s.example/"), f"file://{tmp_path}/none")
    assert set(none) == {"sitemap.xml"} and not list(ET.fromstring(none["sitemap.xml"]))


def test_atom(spark):
    schema = "date string, title string, dek string, author_name string, published_date string"
    rows = [("2026-05-02", "Old & <new>", "dek", None, ""), ("2026-05-09", None, "  ", "Me", "2026-05-10"), ("", "undated", "x", "", ""), (None, "undated", "x", "", "")]
    feed = ET.fromstring(feeds.atom_feed(spark.createDataFrame(rows, schema), "https://w", "W & Co", "sub", "Desk").first().text)
    entries = feed.findall(f"{ATOM}entry")
    assert feed.find(f"{ATOM}updated").text == "2026-05-09T00:00:00Z" and feed.find(f"{ATOM}title").text == "W & Co" and len(entries) == 2
    assert [(e.find(f"{ATOM}title").text, e.find(f"{ATOM}updated").text, e.find(f"{ATOM}author/{ATOM}name").text) for e in entries] == [("W & Co", "2026-05-10T00:00:00Z", "Me"), ("Old & <new>", "2026-05-02T00:00:00Z", "Desk")]
    assert entries[0].find(f"{ATOM}summary") is None and entries[1].find(f"{ATOM}summary").text == "dek"
    empty = ET.fromstring(feeds.atom_feed(spark.createDataFrame([], schema), "https://w", "W", "s", "D").first().text)
    assert empty.find(f"{ATOM}updated").text == "1970-01-01T00:00:00Z" and not empty.findall(f"{ATOM}entry")
    assert len(ET.fromstring(feeds.atom_feed(spark.createDataFrame(rows, schema), "https://w", "W", "s", "D", newest=1).first().text).findall(f"{ATOM}entry")) == 1


def test_archive(spark, tmp_path):
    schema = "id long, title_english string, title_original string, summary_english string, published_date date, source_name string, source_slug string, is_significant boolean, significance_reasoning string, relevance_score double, url string"
    rows = spark.createDataFrame([(k, f"T{k}", None, None, None, None, "s", k == 3, None, 0.123 if k else None, "u") for k in range(12)], schema)
    rows = rows.withColumn("published_date", rows["published_date"]).selectExpr("* except (published_date)", "case when id % 4 > 0 then date_add(date '2026-01-01', cast(id as int)) end as published_date")
    links = spark.createDataFrame([(3, "b"), (3, "a"), (3, "b"), (99, "x")], "article_id long, category string")
    found = feeds.archive(rows, links, {"a": "Label A"})
    assert len(found.columns) == 16 and found.filter("title_zh = '' and summary = '' and source = ''").count() == 12
    out = written(spark, feeds.archive_files(found, per_file=5, latest=3), str(tmp_path))
    parts = [json.loads(out[f"data/articles-{k}.json"]) for k in (1, 2, 3)]
    assert [r["id"] for p in parts for r in p] == list(range(12)) and [len(p) for p in parts] == [5, 5, 2]
    three = parts[0][3]
    assert (three["categories"], three["category_labels"], three["date_fmt"], three["relevance_score"], three["is_significant"]) == (["a", "b"], ["Label A", "b"], "4 January 2026", 0.12, True)
    assert parts[0][0]["date"] == "" and parts[0][0]["relevance_score"] == 0.0
    assert [r["id"] for r in json.loads(out["data/latest.json"])] == [11, 10, 9]
    assert json.loads(feeds.archive_files(found.limit(0)).first().text) == []


def test_health(spark):
    results = spark.createDataFrame([(1, "b", "OK", False, 2), (1, "a", "LISTING_FAILURE", True, 0), (1, "c", "OK_ALL_DUPLICATES", False, None)], "scrape_run_id long, source_slug string, status string, is_failure boolean, new_documents long")
    statuses = spark.createDataFrame([(1, "degraded"), (2, "failed")], "scrape_run_id long, status string")
    got = {r.name: json.loads(r.text) for r in feeds.health_reports(results, statuses, ["status", "is_failure", "new_documents"]).collect()}
    assert got["health/run-1.json"] == {
        "run_id": 1, "aggregate_status": "degraded", "source_count": 3, "failed_sources": ["a"], "empty_sources": ["c"],
        "sources": [{"source_slug": "a", "status": "LISTING_FAILURE", "is_failure": True, "new_documents": 0}, {"source_slug": "b", "status": "OK", "is_failure": False, "new_documents": 2}, {"source_slug": "c", "status": "OK_ALL_DUPLICATES", "is_failure": False, "new_documents": None}],
    }
    assert got["health/run-2.json"] == {"run_id": 2, "aggregate_status": "failed", "source_count": 0, "failed_sources": [], "empty_sources": [], "sources": []}


def test_files_are_replaced_and_pruned(spark, tmp_path):
    folder = f"file://{tmp_path}/site"
    df = spark.createDataFrame([(f"article/{k}.html", f"page {k}") for k in range(6)] + [("index.html", None)], "name string, text string")
    assert texts.listed(spark, folder).count() == 0
    assert written(spark, df, folder)["index.html"] == ""
    assert written(spark, df.limit(1).selectExpr("name", "'new' as text"), folder) == {"article/0.html": "new"}
    assert sorted(r.name for r in texts.listed(spark, folder).collect()) == sorted(r.name for r in df.collect())
    gone = texts.prune_texts(df.filter("name <> 'index.html'").limit(4), folder, r"article/\d+\.html").collect()
    assert sorted(r.name for r in gone) == ["article/4.html", "article/5.html"]
    assert sorted(os.listdir(tmp_path / "site" / "article")) == ["0.html", "1.html", "2.html", "3.html"] and (tmp_path / "site" / "index.html").exists()
    with pytest.raises(Exception, match="without a name"):
        texts.write_texts(spark.createDataFrame([(None, "x")], "name string, text string"), folder).collect()
