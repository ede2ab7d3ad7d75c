"""Lineage, proofs, gates and fingerprints against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.operators import lineage, reconcile
from foliant.sources.snapshots import fingerprint

ROW = "id long, s string, n int"


@pytest.fixture(params=[20, 4])
def spans(request, monkeypatch):
    """Spans of the usual size, and of sixteen ids, so that frequent payloads are many groups."""
    monkeypatch.setattr(lineage, "SPAN_BITS", request.param)


def rows(seed, ids):
    rng = random.Random(seed)
    return [(k, rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([1, None])) for k in ids]


def pairs(left, right):
    by = defaultdict(list)
    for k, *p in sorted(right):
        by[tuple(p)].append(k)
    return {k: by[tuple(p)].pop(0) for k, *p in sorted(left) if by[tuple(p)]}


def test_nth_to_nth(spark, spans):
    left, right = rows(1, range(-40, 400)), rows(2, range(300, 600))
    got = lineage.nth_match(spark.createDataFrame(left, ROW).repartition(5), spark.createDataFrame(right, ROW), ["s", "n"]).collect()
    assert {r.left_id: r.right_id for r in got} == pairs(left, right) and len(got) == len(pairs(left, right))
    empty = spark.createDataFrame([], ROW)
    assert lineage.nth_match(empty, empty, ["s"]).count() == 0


def test_numbers(spark, spans):
    ids = random.Random(3).sample(range(-500, 5000), 700)
    df = spark.createDataFrame([(k,) for k in ids], "id long").repartition(6)
    assert [r.n for r in lineage.numbered(df).orderBy("id").collect()] == list(range(1, 701))
    top = spark.createDataFrame([(10_000,)], "id long")
    assert [r.new_id for r in reconcile.renumbered(df, top).orderBy("id").collect()] == list(range(10_001, 10_701))
    assert [r.new_id for r in reconcile.renumbered(df.limit(1), top.limit(0)).collect()] == [1]
    same = spark.createDataFrame([(None,), (None,), (5,), (5,)], "id long")
    assert sorted((r.id is None, r.n) for r in lineage.numbered(same).collect()) == [(False, 3), (False, 4), (True, 1), (True, 2)]


def merge(seed=4):
    """Base, origin, local and a right merge: local's own runs above origin's ids, payloads all but alike."""
    base = rows(seed, range(1, 60))
    origin, local = base + rows(seed + 1, range(60, 110)), base + rows(seed + 2, range(60, 140))
    merged = origin + [(110 + k, *p) for k, (_, *p) in enumerate(r for r in local if r[0] >= 60)]
    return base, origin, local, merged


def test_recovered_and_proven(spark, spans):
    sides = merge()
    got = lineage.proven(*[spark.createDataFrame(x, ROW) for x in sides], ["s", "n"]).collect()
    want = {k: (k, "inherited") for k in range(1, 60)}
    new = [r for r in sides[3] if r[0] >= 110]
    want |= {k: (m, "matched") for k, m in pairs([r for r in sides[2] if r[0] >= 60], new).items()}
    assert {r.local_id: (r.merged_id, r.how) for r in got} == want and len(got) == len(sides[2])


@pytest.mark.parametrize(
    "tamper, broken",
    [
        (lambda m: [r for r in m if r[0] != 115], "local_unproven (1)"),
        (lambda m: [(k, "new", n) if k == 115 else (k, s, n) for k, s, n in m], "local_unproven (1), merged_unexplained (1)"),
        (lambda m: m + [(999, "hot", 1)], "merged_unexplained (1)"),
        (lambda m: [r for r in m if r[0] != 70], "origin_lost (1)"),
        (lambda m: [(k, "new", n) if k == 70 else (k, s, n) for k, s, n in m], "origin_altered (1)"),
        (lambda m: m + m[:2], "repeated_id (2)"),
    ],
)
def test_tampered_merges_are_refused(spark, tamper, broken):
    base, origin, local, merged = merge()
    with pytest.raises(lineage.Refused) as told:
        lineage.proven(*[spark.createDataFrame(x, ROW) for x in (base, origin, local, tamper(merged))], ["s", "n"])
    assert str(told.value) == f"lineage is unproven: {broken}"


def test_a_run_that_origin_dropped(spark):
    """Origin lacks run 5 of the base; local's own state of it is what the merge must have."""
    base, origin, local, merged = merge()
    without = [r for r in origin if r[0] != 5]
    five = next(r for r in local if r[0] == 5)
    df = lambda x: spark.createDataFrame(x, ROW)
    assert lineage.explained(df(base), df(without), df(local), df(merged), ["s", "n"]).filter("violations > 0").count() == 0
    altered = [(5, "else", None) if r[0] == 5 else r for r in merged]
    assert five[1] != "else"
    got = lineage.explained(df(base), df(without), df(local), df(altered), ["s", "n"]).filter("violations > 0").collect()
    assert [tuple(r) for r in got] == [("inherited_altered", 1)]


def test_fingerprints_without_a_new_scan(spark):
    rng = random.Random(6)
    now = rows(7, range(200)) + rows(7, range(50))
    fp = fingerprint(spark.createDataFrame(now, ROW))
    for step in range(4):
        gone, new = rng.sample(now, 30 if step else 0), rows(20 + step, range(1000 * step, 1000 * step + 40 * (step % 2)))
        now = list((Counter(now) - Counter(gone)).elements()) + new
        fp = lineage.updated(fp, spark.createDataFrame(new, ROW), spark.createDataFrame(gone, ROW))
        fp = spark.createDataFrame(fp.collect(), fp.schema)
        assert fp.first() == fingerprint(spark.createDataFrame(now, ROW)).first()
    parts = lineage.partition_fingerprints(spark.createDataFrame(now, ROW), F.col("id") % 7)
    assert tuple(lineage.combined(parts).first()) == tuple(fp.first()) and parts.count() == 7
    none = spark.createDataFrame([], ROW)
    assert tuple(lineage.combined(lineage.partition_fingerprints(none, F.col("id"))).first()) == tuple(fingerprint(none).first())
    assert tuple(lineage.updated(fp, none, spark.createDataFrame(now, ROW)).first()) == tuple(fingerprint(none).first())


def test_the_published_side(spark):
    _, origin, local, merged = merge()
    a, b, c = (spark.createDataFrame(x, ROW) for x in (origin, local, merged))
    shuffled = fingerprint(a.repartition(3))
    assert lineage.published_side({"ours": a, "theirs": b}, shuffled) == "ours"
    assert lineage.published_side({"ours": b, "theirs": a}, shuffled) == "theirs"
    with pytest.raises(lineage.Refused):
        lineage.published_side({"ours": b, "theirs": c}, shuffled)


def test_gates_of_articles_one_by_one(spark):
    schema = "id long, url string, passed_relevance boolean, source_slug string"
    df = lambda x: spark.createDataFrame(x, schema)
    base = [(1, "a", True, "s"), (2, "b", None, "s")]
    origin = [*base, (3, "c", None, None)]
    local = [*base, (3, "d", False, "t")]
    right = [*origin, (4, "d", False, "t")]
    tampered = {
        None: right,
        "duplicate_url": [*right, (9, "d", False, "t")],
        "duplicate_id": [*right[:3], (3, "d", False, "t")],
        "id_drift": [(8, "a", True, "s"), *right[1:]],
        "origin_decision_lost": [(1, "a", None, "s"), *right[1:]],
        "local_decision_lost": [*right[:3], (4, "d", None, "t")],
        "origin_source_changed": [*right[:2], (3, "c", None, "u"), right[3]],
        "local_source_changed": [*right[:3], (4, "d", False, None)],
        "local_url_lost": right[:3],
        "origin_url_lost": [*right[:2], right[3]],
    }
    for name, merged in tampered.items():
        got = {r.name: r.violations for r in reconcile.gates(df(base), df(origin), df(local), df(merged)).filter("violations > 0").collect()}
        both = {"origin_decision_lost": 1, "local_decision_lost": 1} if name == "origin_decision_lost" else {name: 1} if name else {}
        assert got == both, name
    conflict = reconcile.gates(df(base), df(origin), df([(1, "a", True, "x"), *local[1:]]), df(right)).filter("violations > 0").collect()
    assert [tuple(r) for r in conflict] == [("source_conflict", 1)]
    nothing = df([])
    assert reconcile.gates(nothing, nothing, nothing, nothing).filter("violations > 0").count() == 0


def test_gates_of_the_whole(spark):
    runs = spark.createDataFrame([("completed",), ("degraded",), (None,)], "status string")
    ledger = spark.createDataFrame([("0001",), ("0002",)], "version string")
    got = reconcile.schema_gates({"articles": runs}, ["articles", "sources"], ledger, ["0001", "0002", "0003"], ["completed", "failed"], [runs, runs])
    assert sorted(tuple(r) for r in got.collect()) == [("migration_missing", 1), ("status_not_accepted", 1), ("table_missing", 1)]
