"""Structured Streaming twins of the batch behaviour: resumable intake, upserts, event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_new(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files of a landing folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def append_unseen(stream: DataFrame, store: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append to the store the rows whose key it lacks, each key once, for all files there are now.

    The store is what decides (an anti-join against all of it, however old),
    and each batch writes its own folder, so a repeated batch overwrites itself.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        known = [p for p in _epochs(spark, store) if p != epoch]
        if known:
            old = spark.read.schema(batch.schema).parquet(*[f"{store}/epoch={p}" for p in known])
            fresh = fresh.join(old.select(key), key, "left_anti").select(batch.columns)
        fresh.write.mode("overwrite").parquet(f"{store}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Days before a row's arrival in which its publication counts, the day of arrival included (fixed value).
WINDOW_DAYS = 7


def judged(rows: DataFrame, published: str = "published", arrived: str = "arrived") -> DataFrame:
    """rows with verdict: undated, future (published after the day of arrival), late (more than six days before it) or fresh.

    Each row is judged by its own arrival, so that batches, their borders and
    their order change nothing; a row without an arrival is undated.
    """
    days = F.datediff(F.col(arrived).cast("date"), F.col(published).cast("date"))
    verdict = F.when(days.isNull(), "undated").when(days < 0, "future").when(days >= WINDOW_DAYS, "late").otherwise("fresh")
    return rows.withColumn("verdict", verdict)


def windowed(rows: DataFrame, store: DataFrame, key: str = "url", published: str = "published", arrived: str = "arrived") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the fresh rows whose key the store lacks, the first arrival of each key; and all that aren't fresh.

    Of rows of one key and arrival the least by their other columns is taken.
    Fresh rows without a key are rejected as 'keyless'. A repeated key is in
    neither result, nor is one that the store has.
    """
    told = judged(rows, published, arrived).withColumn("verdict", F.when((F.col("verdict") == "fresh") & F.col(key).isNull(), "keyless").otherwise(F.col("verdict")))
    columns = [c for c in rows.columns if c not in (key, arrived)]
    fresh = told.filter("verdict = 'fresh'").groupBy(key).agg(F.min(F.struct(arrived, *columns)).alias("first"))
    fresh = fresh.select(*[F.col(key) if c == key else F.col(f"first.{c}").alias(c) for c in rows.columns])
    return fresh.join(store.select(key).distinct(), key, "left_anti").select(rows.columns), told.filter("verdict <> 'fresh'")


def append_windowed(
    stream: DataFrame, store: str, rejected: str, checkpoint: str, key: str = "url", published: str = "published", arrived: str = "arrived"
) -> tuple[StreamingQuery, StreamingQuery]:
    """windowed() as two streams for all files there are now: one appends to the store, the other writes what it rejects.

    A publication is found again on each of the seven days of its window, so
    that keys are remembered as state for six days of arrivals and asked of
    the store only then. Rows that arrive more than six days after the latest
    arrival of earlier batches are dropped by the watermark: bring those in by
    windowed(), as a batch with bounds of its own. Rejected rows keep no
    state and pass in whatever order they come.
    """
    told = judged(stream, published, arrived)
    told = told.withColumn("verdict", F.when((F.col("verdict") == "fresh") & F.col(key).isNull(), "keyless").otherwise(F.col("verdict")))
    out = told.filter("verdict <> 'fresh'").writeStream.format("parquet").option("path", rejected).option("checkpointLocation", f"{checkpoint}/rejected").trigger(availableNow=True).start()
    once = told.filter("verdict = 'fresh'").drop("verdict").withColumn("at_", F.col(arrived).cast("timestamp")).withWatermark("at_", f"{WINDOW_DAYS - 1} days").dropDuplicatesWithinWatermark([key]).drop("at_")
    return append_unseen(once, store, f"{checkpoint}/accepted", key), out


def _epochs(spark: SparkSession, store: str) -> list[int]:
    """The batches in a store, by its folder names as Spark's own file source lists their files (it hides _SUCCESS)."""
    try:
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(store).select("path").collect()
    except Exception as error:  # the store isn't there before the first batch
        if "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error):
            return []
        raise
    return sorted({int(r["path"].rpartition("/")[0].rpartition("epoch=")[2]) for r in names})


def event_windows(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "6 days") -> DataFrame:
    """(start, event_type, n) by window; on a stream, rows later than the watermark are dropped."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    window = F.window("at", size, slide) if slide else F.window("at", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "6 days") -> DataFrame:
    """(user_id, start, n) of sessions without a pause longer than gap."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("at", late)
    return rows.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
