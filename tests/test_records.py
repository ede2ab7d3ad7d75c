"""Records into the store, releases and pictures of pages, model answers and lint."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F


from foliant.operators import records
from foliant.sources.markup import trees


def test_normal_form(spark):
    rows = [(" a　 b\n", "x\x1cy", " 2026-05-01T10:00"), (None, None, None), ("t", "", "May 2026")]
    got = records.normalized(spark.createDataFrame(rows, "title_original string, text_original string, published_date string").withColumn("content_hash", F.lit("old"))).collect()
    sha = lambda a, b: hashlib.sha256(f"{a}\n{b}".encode()).hexdigest()
    assert [tuple(r) for r in got] == [("a b", "x y", "2026-05-01", sha("a b", "x y")), ("", "", "", sha("", "")), ("t", "", "", sha("t", ""))]


def test_insertion(spark):
    store = spark.createDataFrame([(7, "u0"), (3, "u1")], "id long, url string")
    sources = spark.createDataFrame([(1, "s"), (2, "t")], "id long, slug string")
    df = lambda *x: spark.createDataFrame(x, "position long, url string, source_slug string, title string")
    got = records.inserted(store, df((5, "u3", "t", "late"), (2, "u3", "s", "first"), (1, "u1", "s", "known"), (9, "u2", "t", "x")), sources).orderBy("id").collect()
    assert [(r.id, r.url, r.source_id, r.title) for r in got] == [(8, "u3", 1, "first"), (9, "u2", 2, "x")]
    assert records.inserted(store.limit(0), df((1, "a", "s", "")), sources).first().id == 1
    assert records.inserted(store, df(), sources).count() == 0
    for bad, told in (((1, "u9", "nobody", ""), "unknown source: nobody"), ((1, "u1", None, ""), "unknown source: null"), ((4, None, "s", ""), "without a URL at: 4")):
        with pytest.raises(Exception, match=told):
            records.inserted(store, df(bad), sources).collect()


def test_releases(spark):
    long = "body text " * 25
    pages = [
        (f'<meta property="og:title" content=" Declared "><p>menu</p><h1>Head</h1><p>{long}</p><script>no</script>', "2026-01-01"),
        (f"<p>menu</p><h1> <b>He</b>ad </h1><p>{long}</p><h1>second</h1>", "2026-01-01"),
        (f"<p>{long}</p>", "2026-01-01"), (f"<h1>T</h1><p>{long}</p>", ""), ("<h1>T</h1><p>short</p>", "2026-01-01"), (f"<p>{long}</p><h1>T</h1>", "2026-01-01"), (None, None),
    ]
    df = spark.createDataFrame([(k, "u", h, d) for k, (h, d) in enumerate(pages)], "id int, url string, html string, day string")
    r = records.releases(trees(df), F.col("day")).orderBy("id").collect()
    body = long.strip()
    assert [(x.title, x.body, x.refusal) for x in r] == [("Declared", body, None), ("Head", f"{body} second", None), (None, None, "no title"), (None, None, "no date"), (None, None, "short body"), ("T", f"{body} T", None), (None, None, "no title")]


def test_pictures(spark):
    html = '<meta content="/a/og.jpg" property="og:image"><meta name="twitter:image" content="t.jpg"><img src=" b.jpg "><img src="//c.example/x.png?y=.gif"><img src="data:1"><img src="/img/logo-1.png"><img src="x.SVG?v=1"><img><img src="http://d.example/static.jpg"><img src="/static/e.jpg">'
    df = spark.createDataFrame([("https://h.example/p/q.html?z=/1", html), ("https://h.example", '<meta name="twitter:image" content="t.jpg">'), ("https://h.example/", None)], "url string, html string")
    r = {x.url: x for x in records.pictures(trees(df), F.col("url")).collect()}
    first = r["https://h.example/p/q.html?z=/1"]
    assert first.declared == "https://h.example/a/og.jpg" and first.images == ["https://h.example/p/b.jpg", "https://c.example/x.png?y=.gif", "http://d.example/static.jpg"]
    assert r["https://h.example/"].declared is None and r["https://h.example/"].images == []


@pytest.mark.parametrize(
    "text, want",
    [("a <strong>b</strong> <em>c</em>", "a <strong>b</strong> <em>c</em>"), ('<strong class="x">', "&lt;strong class=&quot;x&quot;&gt;"), ("<script>'&", "&lt;script&gt;&#39;&amp;"), (None, "")],
)
def test_inline_markup(spark, text, want):
    assert spark.createDataFrame([(text,)], "x string").select(records.inline_markup(F.col("x"))).first()[0] == want


@pytest.mark.parametrize(
    "raw, want",
    [('{"a": 1}', 1), ('```json\n{"a": 2}\n```', 2), ('``` {"a": 3}```  ', 3), ('Here it is: {"a": 4} done', 4), ('```json\nSure\n{"a": {"b": 5}}\n', {"b": 5}), ("no json", None), ("[1]", None), ('{"a": ', None), (None, None), ("{} {", None)],
)
def test_model_answers(spark, raw, want):
    doc = records.model_answer(F.col("x"))
    row = spark.createDataFrame([(raw,)], "x string").select(F.to_json(F.try_variant_get(doc, "$.a", "variant")).alias("a"), doc.isNotNull().alias("there")).first()
    assert (json.loads(row.a) if row.a else None) == want and row.there == (want is not None)



def test_lint(spark):
    title = "One two three four five six seven eight"
    cases = [
        ("  ", ["empty summary"]), (None, ["empty summary"]), ("A fine summary.", []),
        ("This article says it. It is worth noting.", ["opener: this article", "phrase: worth noting"]),
        ("A. B! C? D. E.", ["5 sentences"]), ("word " * 91, ["91 words", "first sentence of 454 characters"]),
        ("One, two; three four five six seven EIGHT and more.", ["repeats the headline"]),
    ]
    df = spark.createDataFrame([(k, title, s) for k, (s, _) in enumerate(cases)], "id int, t string, s string")
    lint = records.summary_lint(F.col("t"), F.col("s"), ["this article", "the piece"], ["worth noting"])
    assert [r.f for r in df.select("id", lint.alias("f")).orderBy("id").collect()] == [w for _, w in cases]
