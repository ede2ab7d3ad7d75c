"""Captures as a data source, and decoding against Python's codecs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import runs
from foliant.sources import landing

PAGE = "<html><head><title>标题 é</title></head><body>正文“引用”…</body></html>"


@pytest.mark.parametrize(
    "content, header, want",
    [
        (PAGE.encode("gbk", "ignore"), "text/html; charset=GBK", "gbk"),
        (PAGE.encode("gb18030"), 'text/html; charset="gb18030"', "gb18030"),
        (b"<meta charset='gb2312'>" + "中文".encode("gb2312"), "text/html", "gb2312"),
        (b'<meta http-equiv="Content-Type" content="text/html; charset=iso-8859-1">caf\xe9', None, "iso-8859-1"),
        (PAGE.encode(), None, "utf-8"),
        (b"broken \xff\xfe \xe4\xb8 end", None, "utf-8"),
        (PAGE.encode(), "text/html; charset=no-such-thing", "utf-8"),
        (PAGE.encode(), "text/html; charset=base64", "utf-8"),
        (b"<meta charset=gbk>" + PAGE.encode(), "text/html; charset=utf-8", "utf-8"),
        (b" " * 2048 + b"<meta charset=gbk>" + PAGE.encode(), None, "utf-8"),
        (b"<meta charset=gbk>" + b"\x81", None, "gbk"),
        (b"", None, "utf-8"),
    ],
)
def test_decoding(spark, content, header, want):
    assert landing.decoded(content, header) == (content.decode(want, "replace"), want)
    df = spark.createDataFrame([(1, bytearray(content), header, "old"), (2, None, header, "old")], "id int, content binary, kind string, text string")
    rows = landing.with_text(df, "content", "kind").orderBy("id").collect()
    assert (rows[0].text, rows[0].charset, rows[1].text, rows[1].charset) == (content.decode(want, "replace"), want, None, None)


@pytest.fixture()
def folder(tmp_path):
    def put(source, day, name, content=None, **about):
        at = tmp_path / source / day
        at.mkdir(parents=True, exist_ok=True)
        if content is not None:
            (at / name).write_bytes(content)
        if about:
            (at / f"{name}.json").write_text(json.dumps(about))

    put("a", "2026-05-01", "1.html", PAGE.encode("gbk", "ignore"), url="http://a/1", http_status=200, content_type="text/html; charset=gbk")
    put("a", "2026-05-01", "2.html", b"x" * 101, url="http://a/2", http_status=200)
    put("a", "2026-05-01", "3.html", b"no", url="http://a/3", http_status=403)
    put("a", "2026-05-02", "4.html", None, url="http://a/4", error="timed out")
    put("a", "2026-05-02", "5.html", b"gone", url="http://a/5", http_status=404)
    put("b", "2026-05-01", "bare.html", b"plain")
    put("c", "2026-05-01", "run", None, status="LISTING_FAILURE", error="503 three times")
    put("d", "2026-05-01", "odd.html", b"odd")
    (tmp_path / "d" / "2026-05-01" / "odd.html.json").write_text("{broken")
    (tmp_path / "d" / "not-a-day").mkdir()
    (tmp_path / "loose.txt").write_text("x")
    return tmp_path


def test_every_status_is_a_row(spark, folder):
    landing.register(spark)
    df = spark.read.format("captures").option("path", str(folder)).option("ceiling", "100").load()
    rows = {(r.source, r.name): r for r in df.collect()}
    assert {k: r.status for k, r in rows.items()} == {
        ("a", "1.html"): "OK", ("a", "2.html"): "OVERSIZED", ("a", "3.html"): "AUTH_FAILURE", ("a", "4.html"): "FETCH_FAILURE", ("a", "5.html"): "FETCH_FAILURE",
        ("b", "bare.html"): "OK", ("c", None): "LISTING_FAILURE", ("d", "odd.html"): "OK",
    }
    first = rows["a", "1.html"]
    raw = PAGE.encode("gbk", "ignore")
    assert (first.body, first.charset, first.n_bytes, first.sha256) == (raw.decode("gbk"), "gbk", len(raw), hashlib.sha256(raw).hexdigest())
    assert rows["a", "4.html"].error == "timed out" and rows["a", "5.html"].error == "HTTP 404" and rows["c", None].error == "503 three times"
    assert rows["b", "bare.html"].url is None and "odd.html.json" in rows["d", "odd.html"].error and rows["a", "2.html"].n_bytes == 101
    assert df.rdd.getNumPartitions() == 5


def test_tests_of_the_source_choose_folders(spark, folder):
    landing.register(spark)
    df = spark.read.format("captures").option("path", f"file://{folder}").load()
    one = df.filter("source = 'b' and status = 'OK'")
    assert one.rdd.getNumPartitions() == 1 and [r.body for r in one.collect()] == ["plain"]
    two = df.filter(F.col("source").isin("b", "c")).filter("day >= '2026-05-01'")
    assert two.rdd.getNumPartitions() == 2 and two.count() == 2
    assert df.filter("source = 'a' and source = 'b'").count() == 0 and df.filter("source = 'none'").count() == 0


def test_collection_of_sources(spark, folder):
    landing.register(spark)
    df = spark.read.format("captures").option("path", str(folder)).option("ceiling", "100").load()
    registry = spark.createDataFrame([(s, s != "off", s != "stub") for s in ("a", "b", "c", "off", "stub", "quiet")], "source string, enabled boolean, implemented boolean")
    more = [("e", "OK", "http://e/1"), ("e", "OK", "http://e/2"), ("e", "OK", "http://e/2"), ("e", "FETCH_FAILURE", "http://e/3"), ("f", "OK", "u")]
    captures = df.select("source", "status", "url").union(spark.createDataFrame(more, "source string, status string, url string"))
    registry = registry.union(spark.createDataFrame([("e", True, True), ("f", True, True)], registry.schema))
    extracted = spark.createDataFrame([("a", "http://a/1"), ("e", "http://e/2"), ("e", "http://e/2"), ("a", "http://a/3")], "source string, url string")
    rows = {r.source: tuple(r)[1:] for r in runs.collected(captures, extracted, registry).collect()}
    assert rows == {
        "a": ("OK", 5, 1, 1, 4, None), "b": ("OK_NO_PUBLICATIONS", 0, 0, 0, 0, None), "c": ("LISTING_FAILURE", 0, 0, 0, 0, None), "off": ("SKIPPED_DISABLED", 0, 0, 0, 0, None),
        "stub": ("NOT_IMPLEMENTED", 0, 0, 0, 0, None), "quiet": ("OK_NO_PUBLICATIONS", 0, 0, 0, 0, None), "e": ("OK", 3, 2, 1, 1, "1 of 2 items failed extraction"), "f": ("EXTRACTION_FAILURE", 1, 1, 0, 0, None),
    }
