"""Clocks and silence: the batch forms against a plain walk, the stream against the batch forms."""

import datetime as dt
import json
import random

import pytest

from foliant.streaming import clock

T0 = dt.datetime(2026, 1, 1)
RUNS = "source string, run_id long, at timestamp, ok boolean"


def runs(seed, n=120):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "b", "c"]), k, T0 + dt.timedelta(seconds=rng.randrange(0, 60 * 86400)), rng.random() < 0.3) for k in range(n)]
    # a source that never succeeds, one that succeeds once, runs at one moment
    return rows + [("never", 1000 + k, T0 + dt.timedelta(days=k), False) for k in range(3)] + [("once", 2000, T0 + dt.timedelta(days=2, hours=5), True), ("once", 2001, T0 + dt.timedelta(days=4, hours=4), False), ("b", 3001, T0, True), ("b", 3000, T0, False)]  # at one moment, the success first


def walk(rows, threshold, until):
    out = []
    for source in sorted({r[0] for r in rows}):
        zero = last = None
        for _, run, at, ok in sorted((r for r in rows if r[0] == source), key=lambda r: (r[2], not r[3], r[1])):
            due = last and last + dt.timedelta(days=threshold)
            if due and due < at and due <= until:
                out.append((source, "overdue", None, due, False, zero, (due - zero).days))
                last = None
            if ok:
                zero, last = zero or at, at
            out.append((source, "run", run, at, ok, zero, (at - zero).days if ok else None))
        due = last and last + dt.timedelta(days=threshold)
        if due and due <= until:
            out.append((source, "overdue", None, due, False, zero, (due - zero).days))
    return sorted(out, key=repr)


def of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch(spark, seed):
    rows, until = runs(seed), T0 + dt.timedelta(days=55)
    df = spark.createDataFrame(rows, RUNS).repartition(7)
    got = of(clock.day_rows(df).unionByName(clock.overdue_rows(df, 4, until)))
    assert got == walk(rows, 4, until)
    assert {r[1] for r in got} == {"run", "overdue"} and len(got) > len(rows)


def test_batch_of_odd_rows(spark):
    rows = [("a", 1, None, True), ("a", 2, T0, None), (None, 3, T0, True), ("a", 4, T0 + dt.timedelta(hours=1), True), ("a", 4, T0 + dt.timedelta(hours=1), True)]
    got = of(clock.day_rows(spark.createDataFrame(rows, RUNS)))
    zero = T0 + dt.timedelta(hours=1)
    assert [(r[0], r[2], r[5], r[6]) for r in got] == [("a", 1, None, None), ("a", 2, None, None), ("a", 4, zero, 0), ("a", 4, zero, 0), (None, 3, None, None)]
    empty = spark.createDataFrame([], RUNS)
    assert clock.day_rows(empty).count() == clock.overdue_rows(empty, 4, T0).count() == 0


def test_stream_is_the_batch_and_restarts(spark, tmp_path):
    """Files in an order of their own, two stops between them; within six days of lateness nothing changes."""
    for key, value in clock.STATE_STORE.items():
        spark.conf.set(key, value)
    rows = sorted(runs(3, 60), key=lambda r: r[2])
    rng, threshold = random.Random(5), 4
    # arrival: by time with up to five days of disorder
    rows = [r for _, r in sorted((r[2].timestamp() + rng.random() * 5 * 86400, r) for r in rows)]
    end = T0 + dt.timedelta(days=90)
    parts = [rows[:20], rows[20:45], [*rows[45:], ("end", 9999, end, False)], [("end", 10000, end + dt.timedelta(days=1), False)]]
    land, store, mark = (str(tmp_path / x) for x in ("land", "store", "mark"))
    (tmp_path / "land").mkdir()
    for k, part in enumerate(parts):
        text = "\n".join(json.dumps({"source": s, "run_id": r, "at": at.isoformat(), "ok": ok}) for s, r, at, ok in part)
        (tmp_path / "land" / f"{k}.json").write_text(text)
        stream = clock.clock_stream(spark.readStream.schema(RUNS).json(land), threshold)
        stream.writeStream.format("parquet").option("path", store).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    seen = sorted(r for r in map(tuple, spark.read.parquet(store).collect()) if r[0] != "end")
    want = [r for r in walk(rows, threshold, end - dt.timedelta(days=6))]
    assert sorted(seen, key=repr) == want
    spark.conf.unset(next(iter(clock.STATE_STORE)))
