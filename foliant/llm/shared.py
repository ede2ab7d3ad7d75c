"""Intermediate tables in the folder that all executors share, and a bounded prefilter for id joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the id prefilter: 2^25 bits are 4 MB, whatever the size of the corpus.
PREFILTER_BITS = 1 << 25
_BUCKET = 32768


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; a local folder only in local mode where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (found or f"{tempfile.gettempdir()}/checkpoints").rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: the lineage ends there.

    A lost executor costs its own tasks alone, since the written files stay
    until release() or, for what the result still reads, until the cluster
    purges the folder, which is named after the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_to = path
    return found


def release(*tables: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more."""
    for df in tables:
        session = df.sparkSession
        path = session.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of df."""
    out = []
    for name in names:
        while name in df.columns:
            name = f"_{name}"
        out.append(name)
    return out


def possible_ids(df: DataFrame, key: str, ids: DataFrame, mark: str | None = None) -> DataFrame:
    """The rows of df whose key may be among ids (all that are, and some that aren't); with mark, all rows and that column.

    ids (one column named as key) are folded into a bitmap of PREFILTER_BITS
    bits, which is broadcast: its size doesn't depend on the data. With very
    many ids more rows pass, and the exact join that follows drops them. It
    saves the shuffle of long texts which that join doesn't need.
    """
    bucket, part = free(df, "_bucket", "_bits")
    slot = F.pmod(F.xxhash64(key), F.lit(PREFILTER_BITS))
    bits = (
        ids.select(slot.alias("slot"))
        .groupBy((F.col("slot") / _BUCKET).cast("int").alias(bucket))
        .agg(F.bitmap_construct_agg((F.col("slot") % _BUCKET).cast("int")).alias(part))
    )
    at = (slot % _BUCKET).cast("int")
    byte = F.conv(F.hex(F.substring(part, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = df.withColumn(bucket, (slot / _BUCKET).cast("int")).join(F.broadcast(bits), bucket, "left")
    test = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    if mark:
        return kept.withColumn(mark, test).drop(bucket, part)
    return kept.filter(test).drop(bucket, part)


def bitmap(hashes: DataFrame, key: str) -> bytes:
    """Which of the PREFILTER_BITS values of their last bits the hashes take: PREFILTER_BITS / 8 bytes, however many there are."""
    last = F.col(key).bitwiseAND(F.lit(PREFILTER_BITS - 1))
    parts = hashes.select((last / _BUCKET).cast("int").alias("bucket"), (last % _BUCKET).cast("int").alias("at"))
    out = bytearray(PREFILTER_BITS // 8)
    size = _BUCKET // 8
    for row in parts.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).collect():  # at most PREFILTER_BITS / _BUCKET rows
        out[row["bucket"] * size : (row["bucket"] + 1) * size] = row["bits"]
    return bytes(out)
