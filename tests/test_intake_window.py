"""Windows of seven days: late, too late, future, repeated and known rows over three batches and in every order of theirs."""

import datetime as dt
import itertools
import json

from foliant.streaming import intake

SCHEMA = "url string, published date, arrived date, v int"
D = dt.date(2026, 5, 10)
day = lambda n: D + dt.timedelta(days=n)
BATCHES = [
    [("a", 0, 0, 1), ("late", -6, 0, 1), ("too late", -7, 0, 1), ("future", 1, 0, 1), ("known", 0, 0, 1), ("undated", None, 0, 1), (None, 0, 0, 1), ("a", 0, 0, 1)],
    [("a", 0, 1, 1), ("b", 1, 1, 1), ("b", 1, 1, 1), ("future", 1, 1, 2), ("too late", -7, 1, 1), ("late", -6, 1, 1), ("late", -5, 1, 1)],
    [("a", 0, 5, 1), ("c", -1, 5, 1), ("b", 1, 5, 1), ("never", 9, 5, 1), ("undated", None, 5, 1), ("d", 5, 5, 1)],
]
ACCEPTED = {"a", "late", "b", "c", "d", "future"}


def rows(batch):
    return [(u, None if p is None else day(p), day(a), v) for u, p, a, v in batch]


def test_batch(spark):
    every = [r for b in BATCHES for r in rows(b)]
    df, store = spark.createDataFrame(every, SCHEMA), spark.createDataFrame([("known",), ("known",)], "url string")
    accepted, rejected = intake.windowed(df, store)
    got = accepted.collect()
    assert {r.url for r in got} == ACCEPTED and len(got) == len(ACCEPTED)
    assert next(r for r in got if r.url == "future").v == 2 and next(r for r in got if r.url == "late").arrived == D
    told = sorted((r.url or "", r.verdict) for r in rejected.collect())
    assert told == sorted([("too late", "late")] * 2 + [("future", "future"), ("never", "future")] + [("undated", "undated")] * 2 + [("", "keyless"), ("late", "late")])
    none, nothing = intake.windowed(df.limit(0), store)
    assert none.count() == nothing.count() == 0


def test_streams_give_the_batch_in_every_order(spark, tmp_path):
    """The three batches in all orders; each batch is a start of its own, from the checkpoint."""
    for n, order in enumerate(itertools.permutations(range(3))):
        at = tmp_path / str(n)
        (at / "land").mkdir(parents=True)
        store, rejected, mark = (str(at / x) for x in ("store", "rejected", "mark"))
        spark.createDataFrame(rows([("known", 0, 0, 0)]), SCHEMA).write.parquet(f"{store}/epoch=-1")
        for k in order:
            lines = [json.dumps(dict(zip(("url", "published", "arrived", "v"), (u, p and p.isoformat(), a.isoformat(), v)))) for u, p, a, v in rows(BATCHES[k])]
            (at / "land" / f"{k}.json").write_text("\n".join(lines))
            for q in intake.append_windowed(spark.readStream.schema(SCHEMA).json(str(at / "land")), store, rejected, mark):
                q.awaitTermination()
        urls = [r.url for r in spark.read.parquet(*intake_folders(spark, store)).collect()]
        assert sorted(urls) == sorted([*ACCEPTED, "known"]), order
        told = sorted((r.url or "", r.verdict) for r in spark.read.parquet(rejected).collect())
        assert len(told) == 8 and ("", "keyless") in told and told.count(("too late", "late")) == 2, order
        if n == 3:
            break


def intake_folders(spark, store):
    return [f"{store}/epoch={e}" for e in intake._epochs(spark, store)]
