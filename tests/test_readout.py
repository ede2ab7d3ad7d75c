"""The three branches of a day's readout, its order of articles and its texts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.operators import readout
from foliant.plans.site_queries import _WORDING

D = dt.date(2026, 5, 7)
BAD = "The body does not match the headline."
SCHEMA = "id long, published_date date, summary_english string, is_significant boolean, relevance_score double, source_slug string, title_english string, title_original string"
PRIORITY = {"first": 1, "second": 2}


def day(spark, rows, links):
    """rows: (id, summary, flag, score, source)."""
    articles = [(k, D, s, f, x, src, f"T{k}", None) for k, s, f, x, src in rows]
    return readout.readout(spark.createDataFrame(articles, SCHEMA), spark.createDataFrame(links, "article_id long, category string"), PRIORITY)


def told(spark, parts):
    return tuple(readout.texts(parts, _WORDING, {"first": "First"}, {"first": "Watch it."}).first())[1:]


def test_no_clean_day(spark):
    parts = day(spark, [(1, BAD, True, 0.9, "s"), (2, BAD, None, None, "s")], [(1, "first")])
    r = parts.first()
    assert (r.branch, r.n_clean, r.n_flagged, r.lead, r.lead_category, r.only_source, r.mattered, r.dominant) == ("no_clean", 0, 0, None, None, None, [], [])
    assert told(spark, parts) == ("No clean text.", "Nothing.", "Unknown.", "Watch for repeats.")


def test_flagged_day(spark):
    """Flagged before score, priority before score, flagged articles without a usable text not at all."""
    rows = [(1, "ok", False, 1.0, "s"), (2, "ok", True, 0.1, "s"), (3, "ok", True, 0.9, "s"), (4, "ok", True, 0.5, "s"), (5, BAD, True, 1.0, "t")]
    links = [(2, "second"), (2, "first"), (3, "other"), (4, "second"), (4, "other"), (1, "x"), (5, "first")]
    parts = day(spark, rows, links)
    r = parts.first()
    assert (r.branch, r.n_clean, r.n_flagged, r.lead, r.lead_category, r.only_source) == ("flagged", 4, 3, 2, "first", "s")
    assert r.mattered == ["T2", "T4"] and r.flagged_categories == ["other", "second", "first"] and r.routine_categories == ["x"] and r.dominant == ["other", "second", "first"]
    assert told(spark, parts) == ("3 flagged items on other, second, First. All from s.", "T2; T4", "The rest: x.", "Watch it.")


def test_routine_days(spark):
    parts = day(spark, [(1, "ok", None, 0.2, "s"), (2, "ok", False, 0.3, "t")], [(1, "second"), (2, "other")])
    r = parts.first()
    assert (r.branch, r.lead, r.lead_category, r.only_source) == ("routine", 1, "second", None)
    assert told(spark, parts) == ("Nothing flagged; mostly other, second.", "T1 (second).", "Mostly other, second.", "Watch for repeats.")
    bare = day(spark, [(1, None, None, None, "")], [])
    assert bare.first().only_source is None and told(spark, bare) == ("Nothing flagged; mostly the usual.", "T1.", "Mostly the usual.", "Watch for repeats.")


@pytest.mark.parametrize("n", [1, 5])
def test_many_days_and_none(spark, n):
    articles = [(k, D + dt.timedelta(days=k % 3) if k % 7 else None, "ok", k % 2 == 0, 0.5, f"s{k % 3}", f"T{k}", None) for k in range(60)]
    df = spark.createDataFrame(articles, SCHEMA).repartition(n)
    links = spark.createDataFrame([(k, f"c{k % 4}") for k in range(60)], "article_id long, category string")
    got = {r.day: r for r in readout.readout(df, links, {}).collect()}
    assert set(got) == {D, D + dt.timedelta(days=1), D + dt.timedelta(days=2), None}
    for when, r in got.items():
        own = [a for a in articles if a[1] == when]
        flagged = [a for a in own if a[3]]
        assert (r.n_clean, r.n_flagged, r.lead) == (len(own), len(flagged), min(a[0] for a in flagged))
        assert r.mattered == [a[6] for a in flagged[:2]]
    empty = df.limit(0)
    assert readout.readout(empty, links, {}).count() == 0
    configured = spark.createDataFrame([("s0", "A", "none"), ("zz", "Z", "quiet")], "slug string, name string, fallback string")
    assert readout.brief(empty, links, {}, configured).count() == 0
    b = readout.brief(df, links, {}, configured).first()
    newest = [a for a in articles if a[1] == D + dt.timedelta(days=2)]
    assert b.n == len(newest) and b.ids == [a[0] for a in sorted(newest, key=lambda a: (not a[3], a[0]))]
    count = sum(a[5] == "s0" for a in newest)
    assert [tuple(s) for s in b.statuses] == [("A", "articles collected" if count else "none", count), ("Z", "quiet", 0)]
    assert b.recent_signals == [a[0] for a in newest if a[3]][:3]


def test_wording_is_complete(spark):
    parts = day(spark, [(1, "ok", True, 0.5, "s")], [])
    assert told(spark, parts)[0] == "1 flagged item on no theme. All from s."
    with pytest.raises(KeyError):
        readout.texts(parts, {}, {}, {})
    assert readout.texts(parts, _WORDING, {}, {}).select(F.col("what_to_watch")).first()[0] == "Watch for repeats."
