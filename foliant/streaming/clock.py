"""Day clocks and silence by source as state: day zero from the first success, overdue by timer.

The batch forms and the stream give the same rows: the stream holds runs until
the watermark has passed them and then takes them in the order of their end,
so that the order of arrival within the allowed lateness changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

CLOCK = "source string, kind string, run_id long, at timestamp, ok boolean, day_zero timestamp, day long"
DAY = 86400


def day_rows(runs: DataFrame) -> DataFrame:
    """Runs (source, run_id, at, ok) as rows of CLOCK: day_zero is the source's first success, day the whole days since.

    A failed run has no day and, before the first success, no day_zero. A null
    ok is a failure; runs without a time or source have neither. Each row is
    kept, repeated ones too.
    """
    zero = runs.filter("ok and at is not null").groupBy("source").agg(F.min("at").alias("zero"))
    rows = runs.join(zero, "source", "left")
    ok = F.coalesce("ok", F.lit(False))
    day_zero = F.when(F.col("at") >= F.col("zero"), F.col("zero"))
    day = F.when(ok, F.floor((F.unix_micros("at") - F.unix_micros("zero")) / (DAY * 1_000_000)))
    return rows.select("source", F.lit("run").alias("kind"), "run_id", "at", ok.alias("ok"), day_zero.alias("day_zero"), day.alias("day"))


def overdue_rows(runs: DataFrame, threshold_days: int, until: datetime) -> DataFrame:
    """One row of CLOCK, kind overdue, for each success that none follows in threshold_days, if that time is over at until.

    at is the moment the threshold passes, day the days since day zero then.
    Successes are first folded by source and spans of the threshold's length,
    inside which no silence can be that long, so that a source with very many
    runs is few rows before they are put in order.
    """
    span = threshold_days * DAY
    ok = runs.filter("ok and at is not null").withColumn("bin", F.floor(F.unix_timestamp("at") / span))
    folded = ok.groupBy("source", "bin").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    w = Window.partitionBy("source").orderBy("bin")
    gaps = folded.select("source", "last", F.lead("first").over(w).alias("next"), F.min("first").over(w).alias("zero"))
    at = F.col("last") + F.expr(f"interval {threshold_days} days")
    found = gaps.withColumn("due", at).filter((F.col("next").isNull() | (F.col("next") > F.col("due"))) & (F.col("due") <= F.lit(until)))
    day = F.floor((F.unix_micros("due") - F.unix_micros("zero")) / (DAY * 1_000_000))
    return found.select("source", F.lit("overdue").alias("kind"), F.lit(None).cast("long").alias("run_id"), F.col("due").alias("at"), F.lit(False).alias("ok"), F.col("zero").alias("day_zero"), day.alias("day"))


class SourceClock(StatefulProcessor):
    """By source: day zero (written once), the last success, and the runs that the watermark hasn't passed. Times are microseconds."""

    def __init__(self, threshold_days: int):
        self.threshold = threshold_days * DAY * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.zero = handle.getValueState("zero", "at long")
        self.last = handle.getValueState("last", "at long")
        self.waiting = handle.getListState("waiting", "run_id long, at long, ok boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for row in rows:
            self.waiting.appendValue((row["run_id"], row["micros"], bool(row["ok"])))
            self.handle.registerTimer(_millis(row["micros"]))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [tuple(r) for r in self.waiting.get()]
        due = sorted((r for r in held if _millis(r[1]) <= now), key=lambda r: (r[1], not r[2], r[0] is not None, r[0]))
        if due:
            self.waiting.clear()
            rest = [r for r in held if _millis(r[1]) > now]
            if rest:
                self.waiting.put(rest)
        out = []
        for run_id, at, ok in due:
            out += self._silence(key, before=at)
            if ok:
                if not self.zero.exists():
                    self.zero.update((at,))
                self.last.update((at,))
                self.handle.registerTimer(_millis(at + self.threshold))
            zero = self.zero.get()[0] if self.zero.exists() else None
            out.append(self._row(key, "run", run_id, at, ok, zero, ok))
        return iter([*out, *self._silence(key, by=now)])

    def _row(self, key: tuple, kind: str, run_id: int | None, at: int, ok: bool, zero: int | None, counted: bool) -> Row:
        return Row(source=key[0], kind=kind, run_id=run_id, at=at, ok=ok, day_zero=zero, day=(at - zero) // (DAY * 1_000_000) if counted else None)

    def _silence(self, key: tuple, before: int | None = None, by: int | None = None) -> list[Row]:
        """The overdue row of the last success, once, if its threshold lies before the next run (microseconds) or by now (milliseconds)."""
        if not self.last.exists():
            return []
        due = self.last.get()[0] + self.threshold
        if (before is not None and due >= before) or (by is not None and _millis(due) > by):
            return []
        self.last.clear()  # told; the next success starts anew
        return [self._row(key, "overdue", None, due, False, self.zero.get()[0], True)]

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """Milliseconds, rounded up, as timers and watermarks count."""
    return -(-micros // 1000)


def clock_stream(runs: DataFrame, threshold_days: int, late: str = "6 days") -> DataFrame:
    """Rows of CLOCK from a stream of runs (source, run_id, at, ok); needs the RocksDB state store.

    Runs that come later than the watermark allows are dropped by it, as are
    runs without a time. A run is told when the watermark has passed it, a
    silence when it has passed the threshold's end.
    """
    rows = runs.filter("at is not null").withColumn("micros", F.unix_micros("at")).withWatermark("at", late)
    plain = CLOCK.replace("timestamp", "long")
    told = rows.groupBy("source").transformWithState(SourceClock(threshold_days), plain, "append", "eventTime")
    return told.withColumns({c: F.timestamp_micros(c) for c in ("at", "day_zero")})


STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
