"""Corpus operators: total orders, partitions, idempotence, tampering, inputs unchanged."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import dedup, extraction, filters, gates, queue, lineage, reconcile, runs, store, views
from foliant.sources import snapshots


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def test_text_functions(spark):
    check = lambda f, cases, kind="string": [one(spark, a, f, kind) for a, _ in cases] == [b for _, b in cases]
    assert check(fx.collapse, [(" a　  b\n", "a b"), ("a\x1cb", "a b"), (None, None)])
    assert check(fx.strip_tags, [("【x】[y] 【z】title", "title"), ("title 【x】", "title 【x】"), ("【x】", ""), (None, "")])
    assert check(fx.title_hash, [("  ", ""), (None, "")]) and one(spark, "【x】a", fx.title_hash) == one(spark, "a", fx.title_hash)
    assert check(fx.date_stamp, [("2026-13-45 x", "2026-13-45"), ("x 2026-01-01", ""), (None, "")])
    assert [one(spark, x, fx.calendar_date) is None for x in ("2026-13-45", "2026-02-28", "")] == [True, False, True]
    assert check(fx.url_host, [("HTTPS://WWW.Example.org:80/a", "www.example.org"), ("no url", ""), (None, "")])
    assert check(fx.url_key, [("http://www.a.b/c/", "a.b/c/"), ("https://a.b/c//", "a.b/c"), (" HTTPS://Example.org/A \n", "example.org/a"), ("Http://WWW.a.b/", "a.b/"), (None, "")])
    assert check(fx.url_canonical, [("https://a.b/c?x=1#y", "https://a.b/c/"), ("http://a.b/c", None)])
    assert str(one(spark, "2026-08-16", lambda x: fx.saturday_ending(x.cast("date")))) == "2026-08-15"  # a Sunday
    assert str(one(spark, "2026-08-15", lambda x: fx.saturday_ending(x.cast("date")))) == "2026-08-15"
    assert check(lambda x: fx.excerpt(x, 10), [("short", "short"), ("one two three four", "one two...")])
    assert check(fx.language_subtag, [("zh-Hans", "zh"), ("x", None), ("english-GB", None)])
    assert str(one(spark, "15aug26-mindef", fx.slug_date)) == "2026-08-15" and one(spark, "nothing", fx.slug_date) is None
    assert check(fx.plain_text, [("<b>a</b>&amp;lt; <i>x</i>\n y", "a &lt; x y")])
    assert check(fx.leading_ideographs, [("军事新闻 x", "军事"), ("x军", "")])


ROWS = [
    (1, "t", "src5", "http://a.x/s/1"), (2, "t", "src1", "http://b.x/longer/2"), (3, "t", "src1", "http://b.x/s/3"), (4, "u", "zzz", "http://c.x/4"),
    (5, "u", "yyy", "http://c.x/5"), (6, "", "src1", "http://d.x/6"), (7, None, "src1", "http://d.x/7"), (8, "v", "src2", "http://e.x/8"),
]
TIERS = {"src1": "A", "src2": "B", "src5": "D"}


def test_canonical_choice_ignores_the_order_of_rows(spark):
    key = dedup.canonical_key(TIERS, {"s": 100})
    seen = set()
    for rows in itertools.islice(itertools.permutations(ROWS), 0, 40320, 9000):
        df = spark.createDataFrame(rows, "id int, title string, source string, url string").withColumn("title_hash", fx.title_hash(F.col("title")))
        seen.add(tuple(sorted(r.id for r in dedup.canonical(df.repartition(3), key).collect())))
    assert seen == {(3, 4, 6, 7, 8)}
    ranks = {r.id: r["rank"] for r in dedup.ranked(df, key).collect()}
    assert ranks == {3: 1, 2: 2, 1: 3, 4: 1, 5: 2, 8: 1}
    assert {r.reason for r in dedup.refused_groups(df, TIERS).collect()} == {"ungoverned source"}


def greedy(rows):
    a, b, out = set(), set(), []
    for p, x, y in sorted(rows):
        if x not in a and y not in b:
            a.add(x), b.add(y), out.append(p)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_dedup_is_the_sequential_one(spark, seed):
    rng = random.Random(seed)
    rows = [(p, f"u{rng.randrange(12)}", f"h{rng.randrange(12)}") for p in range(60)]
    df = spark.createDataFrame(rows, "p int, x string, y string")
    got = dedup.greedy_unique(df, "p", "x", "y")
    assert sorted(r.p for r in got.collect()) == greedy(rows)
    assert dedup.greedy_unique(got, "p", "x", "y").count() == got.count()


def test_store_dedup(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, url string")
    store = spark.createDataFrame([("a",), (None,)], "url string")
    assert sorted(r.id for r in dedup.unseen(batch, store, ["url"]).collect()) == [2, 3]


def test_splits_are_partitions(spark):
    df = spark.createDataFrame([(1, "Missile test", "x", 0.6), (2, "none", "a.b", None), (3, None, "海军 drill", 0.59)], "id int, title string, text string, score double")
    passed, rejected = filters.keyword_split(df, ["海军"], ["MISSILE"])
    assert sorted(r.id for r in passed.collect()) == [1, 3] and [r.id for r in rejected.collect()] == [2]
    assert filters.keyword_split(df, [], ["a+b"])[0].count() == 0
    passed, rejected = filters.relevance_split(df)
    assert [r.id for r in passed.collect()] == [1] and rejected.count() == 2
    assert [r.id for r in filters.search(df, "NONE").collect()] == [2]


@pytest.mark.parametrize("new, old, cap, want", [(3, 0, 5, (3, 0)), (10, 10, 10, (7, 3)), (1, 10, 10, (1, 9)), (10, 1, 10, (9, 1)), (10, 10, 55, (10, 10)), (4, 4, 0, (0, 0)), (60, 60, 55, (39, 16))])
def test_queue(spark, new, old, cap, want):
    fresh, backlog = spark.range(new), spark.range(1000, 1000 + old)
    got = queue.analysis_queue(fresh, backlog, [F.asc("id")], [F.asc("id")], cap).groupBy("part").count().collect()
    n = {r.part: r["count"] for r in got}
    assert (n.get("fresh", 0), n.get("backlog", 0)) == want


def test_run_status_ladder(spark):
    rows = [(1, "OK", False), (1, "LISTING_FAILURE", True), (2, "LISTING_FAILURE", True), (2, "NOT_IMPLEMENTED", False), (3, "OK", False), (4, "SKIPPED_DISABLED", False)]
    every = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5)], "run_id int")
    got = runs.run_status(spark.createDataFrame(rows, "run_id int, status string, is_failure boolean"), every).collect()
    assert {r.run_id: r.status for r in got} == {1: "degraded", 2: "failed", 3: "completed", 4: "degraded", 5: "failed"}


def test_upsert_keeps_what_it_must_and_is_idempotent(spark):
    schema = "run int, slug string, started string, status string"
    old, new = spark.createDataFrame([(1, "a", "s0", "x"), (1, "b", None, "x")], schema), spark.createDataFrame([(1, "a", "s1", "y"), (1, "b", "s9", "y"), (2, "a", "s2", "z")], schema)
    once = runs.upsert_results(old, new, ["run", "slug"], ["started"])
    assert sorted(map(tuple, once.collect()), key=repr) == [(1, "a", "s0", "y"), (1, "b", None, "y"), (2, "a", "s2", "z")]
    assert sorted(map(tuple, runs.upsert_results(once, new, ["run", "slug"], ["started"]).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)


def test_reconcile_and_tampering(spark):
    schema, fields = "id long, url string, source string, passed_relevance boolean, analyzed_at string", ["passed_relevance", "analyzed_at"]
    origin = spark.createDataFrame([(1, "a", "s", None, None), (2, "b", "s", True, "d"), (9, "c", "s", False, None)], schema)
    local = spark.createDataFrame([(1, "a", "s", True, "d1"), (2, "x", "t", None, None), (3, "b", "s", False, "d9"), (5, "a", "s", False, "later"), (7, "y", "t", True, None)], schema)
    merged = reconcile.reconcile_articles(origin, local, fields=fields)
    assert sorted(map(tuple, merged.collect())) == [(1, "a", "s", True, "d1"), (2, "b", "s", True, "d"), (9, "c", "s", False, None), (10, "x", "t", None, None), (11, "y", "t", True, None)]
    gates_of = lambda m: {r.name for r in reconcile.gates(origin, origin, local, m, source="source").filter("violations > 0").collect()}
    assert gates_of(merged) == set()
    assert gates_of(merged.filter("url <> 'y'").withColumn("id", F.lit(1))) == {"local_url_lost", "duplicate_id", "id_drift"}
    undecided = F.when(F.col("url") != "y", F.col("passed_relevance"))
    assert gates_of(merged.withColumn("passed_relevance", undecided)) == {"local_decision_lost"}
    assert gates_of(merged.withColumn("source", F.when(F.col("url") == "c", "t").otherwise(F.col("source")))) == {"origin_source_changed"}
    with pytest.raises(ValueError, match="relevance_score"):
        reconcile.reconcile_articles(origin, local)
    assert tuple(reconcile.accounting(origin, merged, ["url"], ["passed_relevance"]).first()) == (0, 2, 1)
    pairs = lineage.nth_match(origin.select("id", "source"), local.select("id", "source"), ["source"], "id").collect()
    assert {(r.left_id, r.right_id) for r in pairs} == {(1, 1), (2, 3), (9, 5)}


def test_canonical_sections_and_hosts(spark):
    """Only the hosts that have sections rank by them, and a blank source takes the one of its host."""
    rows = [
        (1, "g", "p", "http://www.own.example/minor/a.html"), (2, "g", "p", "http://www.own.example/top/a-longer-address.html"), (3, "g", "p", "http://other.example/top/a.html"),
        (4, "h", " ", "http://www.own.example/x.html"), (5, "h", "q", "http://q.example/top/x.html"), (6, "", "p", "http://www.own.example/top/z.html"),
    ]
    df = spark.createDataFrame(rows, "id int, title_hash string, source string, url string")
    key = dedup.canonical_key({"p": "A", "q": "B"}, {"top": 100}, section_hosts=("www.own.example",), hosts={"www.own.example": "p"})
    assert {r.id for r in dedup.canonical(df, key).collect()} == {2, 4, 6}
    ranks = {r.id: r["rank"] for r in dedup.ranked(df, key).collect()}
    assert ranks == {2: 1, 1: 2, 3: 3, 4: 1, 5: 2}


def test_reconcile_preflight_and_publishing(spark):
    a = spark.createDataFrame([(1, 5), (1, 6)], "id long, source_id long")
    s = spark.createDataFrame([(5, "x")], "id long, slug string")
    found = reconcile.preflight({"base": {"articles": a}, "local": {"articles": a, "sources": s}}, {"articles": ["id", "url"], "sources": ["id"]}, [("articles", "source_id", "sources")])
    assert {(r.snapshot, r.problem, r.n) for r in found.collect()} == {
        ("base", "no table sources", 1), ("base", "no column articles.url", 1), ("local", "no column articles.url", 1),
        ("base", "repeated articles.id", 1), ("local", "repeated articles.id", 1), ("local", "articles.source_id without sources", 1),
    }


def test_synced_registry(spark):
    current = spark.createDataFrame([("a", "A", 1, True), ("b", "B", 2, False)], "slug string, name string, desk int, active boolean")
    declared = spark.createDataFrame([("a", "A2", 1), ("c", "C", 1)], "slug string, name string, desk int")
    got = store.synced(current, declared, "slug", "desk")
    assert sorted(map(tuple, got.collect())) == [("a", "A2", 1, True), ("b", "B", 2, False), ("c", "C", 1, None)]
    with pytest.raises(Exception, match="two owners"):
        store.synced(current, spark.createDataFrame([("b", "B", 1)], "slug string, name string, desk int"), "slug", "desk").collect()


def test_texts_that_may_not_lack_a_value(spark):
    df = spark.createDataFrame([("A", "T", "2026-05-07", "u")], "author string, title string, day string, url string")
    cite = fx.citation(F.col("author"), F.col("title"), F.col("day").cast("date"), F.col("url"))
    assert df.select(cite).first()[0] == "A, “T,” 7 May 2026, u."
    with pytest.raises(Exception, match="missing title"):
        df.withColumn("title", F.lit(" ")).select(cite).collect()
    said = spark.createDataFrame([('He said \\"so: yes\\", :then',)], "v string").select(F.to_json(F.struct("v", F.lit(1).alias("n"))).alias("j"))
    assert said.select(fx.json_strings(F.col("j"))).first()[0] == ['He said \\"so: yes\\", :then']
    x = F.lit("One two. Three? Four!")
    assert spark.range(1).select(fx.sentences(x), fx.n_words(x), fx.repeats_headline(x, F.lit("ONE two."))).first()[:] == (["One two.", "Three?", "Four!"], 4, True)


def test_captures_and_sitemaps(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<meta charset='GB2312'>" + b"x" * 50)
    (tmp_path / "b.html").write_bytes(b"y" * 200)
    got = {r.path.rpartition("/")[2]: r for r in snapshots.captures(spark, str(tmp_path / "*.html"), ceiling=100).collect()}
    assert (got["a.html"].charset, got["a.html"].status, got["b.html"].charset, got["b.html"].status) == ("gb2312", "OK", "utf-8", "OVERSIZED")
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://x/1</loc><lastmod>2026-01-02</lastmod></url><url><loc>http://x/2</loc></url></urlset>")
    assert sorted(map(tuple, snapshots.sitemap(spark, str(tmp_path / "s.xml")).collect()), key=repr) == [("http://x/1", "2026-01-02"), ("http://x/2", None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "2.json").write_text('{"date": "2026-01-09"}')
    (tmp_path / "d" / "1.json").write_text("{broken")
    cards = {r.file_name: (r.date, r.corrupt is None) for r in snapshots.sidecars(spark, str(tmp_path / "d"), "date string").collect()}
    assert cards == {"2.json": ("2026-01-09", True), "1.json": (None, False)}


def test_views(spark):
    days = spark.createDataFrame([("2026-01-01",), ("2026-01-02",), ("2026-01-06",), (None,)], "day string")
    assert [tuple(map(str, r)) for r in views.collection_gaps(days.select(F.col("day").cast("date"))).collect()] == [("2026-01-03", "2026-01-05", "3")]
    counts = views.state_counts(spark.createDataFrame([("analyzed",)], "state string")).orderBy("position").collect()
    assert [r.n for r in counts] == [1, 0, 0, 0]
    rows = spark.createDataFrame([(k, "g", 400) for k in range(60)], "id int, g string, size int")
    paged = views.budgeted_pages(rows, [F.asc("id")], "g", F.col("size"), budget=10_000)
    assert paged.agg(F.max("per_page"), F.max("page")).first()[:] == (25, 3)
    trail = views.source_trail(spark.createDataFrame([(k, "g", k == 20, float(k)) for k in range(30)], "id int, g string, significant boolean, score double"), "g")
    assert [r.id for r in trail.orderBy("place").collect()] == [20, *range(29, 20, -1), 19, 18, 17] and trail.filter("truncated").count() == 13


def test_extraction_and_gates(spark):
    page = "<html><head><meta property='og:title' content='T'><title>x</title></head><body><script>var a='<p>no</p>'</script><p>" + "long text " * 30 + "<p>short<a href='/l'>the <b>link</b></a></body>"
    df = spark.createDataFrame([(1, page), (2, None)], "page_id int, html string")
    good, none = extraction.article(df).orderBy("page_id").collect()
    assert good.title == "T" and good.refusal is None and none.refusal == "no title"
    assert [tuple(r) for r in extraction.links(df).collect()] == [(1, "/l", "the link")]
    counts = gates.rule_counts(spark.createDataFrame([("2026-13-01", " ", "x"), (None, "t", "")], "published_date string, title string, text string"), gates.article_rules())
    assert {r.rule: r.violations for r in counts.collect()} == {"blank_date": 1, "malformed_date": 1, "blank_title": 1, "blank_text": 1}


def test_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "id long, v string")
    a = snapshots.fingerprint(df).first()
    assert a == snapshots.fingerprint(df.repartition(5)).first() != snapshots.fingerprint(df.filter("id > 0")).first()
    assert a != snapshots.fingerprint(df.withColumn("v", F.when(F.col("id") > 0, F.col("v")))).first()
    open_gate = spark.createDataFrame([("g", 1)], "name string, violations long")
    with pytest.raises(ValueError, match="g"):
        snapshots.publish({"t": df}, str(tmp_path), open_gate)
    folder = snapshots.publish({"t": df}, str(tmp_path), open_gate.withColumn("violations", F.lit(0)))
    assert snapshots.table(spark, folder, "t").count() == 50
    assert snapshots.with_columns_of(df, "id int, w double").dtypes == [("id", "int"), ("w", "double"), ("v", "string")]


def test_streaming_intake_and_windows(spark, tmp_path):
    from foliant.streaming import intake

    land, store, mark = (str(tmp_path / x) for x in ("land", "store", "mark"))
    for part in ([("a", 1), ("b", 2), ("a", 3)], [("b", 4), ("c", 5)]):
        spark.createDataFrame(part, "url string, v int").coalesce(1).write.mode("append").parquet(land)
        intake.append_unseen(intake.read_new(spark, land, "url string, v int"), store, mark, "url").awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(store).collect()) == ["a", "b", "c"]
    events = spark.createDataFrame([("2024-01-01 10:00:00", "x"), ("2024-01-01 23:00:00", "x"), ("2024-01-02 00:00:00", "y")], "ts string, event_type string")
    events = events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    batch = sorted(map(tuple, intake.event_windows(events).collect()))
    events.write.parquet(str(tmp_path / "events"))
    stream = intake.event_windows(intake.read_new(spark, str(tmp_path / "events"), "ts timestamp_ntz, event_type string"))
    stream.writeStream.format("memory").queryName("twin").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("twin").collect())) == batch
