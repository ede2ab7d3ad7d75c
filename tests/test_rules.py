"""Rules as the documents they come from state them."""

import datetime as dt

from pyspark.sql import functions as F

from foliant.operators import runs, site


def test_outcomes_in_their_order(spark):
    cases = [
        # enabled, implemented, listed, references, fetched, extracted, failed
        ((False, True, False, 0, 0, 0, 3), "SKIPPED_DISABLED"),
        ((True, False, False, 5, 5, 5, 0), "LISTING_FAILURE"),
        ((True, False, True, 0, 0, 0, 2), "LISTING_FAILURE"),
        ((True, False, True, 0, 0, 0, 0), "NOT_IMPLEMENTED"),
        ((True, False, True, 3, 2, 1, 1), "OK"),
        ((True, True, True, 0, 0, 0, 0), "OK_NO_PUBLICATIONS"),
        ((True, True, True, 3, 0, 0, 3), "FETCH_FAILURE"),
        ((True, True, True, 3, 2, 0, 1), "EXTRACTION_FAILURE"),
        ((True, True, True, 3, 2, 1, 1), "OK"),
    ]
    names = ["enabled", "implemented", "listed", "refs", "fetched", "extracted", "failed"]
    df = spark.createDataFrame([(*c, want) for c, want in cases], ", ".join([*[f"{n} {'boolean' if k < 3 else 'int'}" for k, n in enumerate(names)], "want string"]))
    assert df.filter(runs.outcome(*[F.col(n) for n in names]) != F.col("want")).count() == 0


def test_day_clock(spark):
    t = dt.datetime(2026, 1, 1, 23)
    h = lambda n: t + dt.timedelta(hours=n)
    rows = [(1, h(-5), False), (2, h(0), True), (3, h(2), True), (4, h(23.9), True), (5, h(24), True), (6, h(50), False), (7, h(80), None)]
    got = runs.day_clock(spark.createDataFrame(rows, "id int, finished_at timestamp, ok boolean")).orderBy("id").collect()
    assert [(r.day_zero, r.day) for r in got] == [(None, None), (t, 0), (t, 0), (t, 0), (t, 1), (t, None), (t, None)]


def test_distinct_values_at_one_position(spark):
    rows = [("g", v, 1) for v in ["b", "a", "C", "A "]] + [("g", "d", 0), ("g", " ", 0), ("h", None, 0)]
    df = spark.createDataFrame(rows, "g string, v string, position int")
    for n in (1, 3):
        got = site.distinct_in_order(df.repartition(n), "g", "v", cap=3).orderBy("place").collect()
        assert [r.v.lower() for r in got] == ["d", "a", "b"]
