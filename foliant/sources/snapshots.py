"""Immutable Parquet snapshots: reading, publishing behind gates, and cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["articles", "sources", "categories", "article_categories", "scrape_runs", "source_run_results"]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by a hash of the keys into as many tasks as the session shuffles into.

    A small file may hold a million narrow rows; as it is read it is one task
    or two, whatever each row costs. Keys should differ from row to row.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the session's shared folder; a local one only in local mode where none is set."""
    context = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()):
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(f"{tempfile.gettempdir()}/checkpoints")
    return df.checkpoint()


def with_columns_of(df: DataFrame, schema: str) -> DataFrame:
    """df in a schema (DDL): columns that it lacks are null, others are cast, further ones stay."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    cast = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    return df.select(*cast, *[c for c in df.columns if c not in wanted.names])


def sidecars(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents (one a file) with their file name; unreadable ones have corrupt set and nulls else."""
    read = spark.read.schema(f"{schema}, corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt")
    return read.json(path).withColumn("file_name", F.col("_metadata.file_name"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of the url entries of sitemap files."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


def captures(spark: SparkSession, path: str, ceiling: int = 4_000_000) -> DataFrame:
    """Fetched files with size, digest, declared character set and status (OVERSIZED beyond the ceiling)."""
    files = spark.read.format("binaryFile").load(path)
    head = F.decode(F.substring("content", 1, 2048), "ISO-8859-1")
    charset = F.coalesce(F.nullif(F.lower(F.regexp_extract(head, "(?i)<meta[^>]+charset=[\"']?([\\w-]+)", 1)), F.lit("")), F.lit("utf-8"))
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), charset.alias("charset"), F.when(F.col("length") > ceiling, "OVERSIZED").otherwise("OK").alias("status"), "content")


def publish(tables: dict[str, DataFrame], root: str, gates: DataFrame | None = None) -> str:
    """A new snapshot folder below root with the tables, refused if a gate has violations; the folder's path.

    gates: (name, violations). The snapshots before it stay as they are.
    """
    if gates is not None and (broken := gates.filter("violations > 0").orderBy("name").limit(20).collect()):
        raise ValueError("gates are open: " + ", ".join(f"{r['name']} ({r['violations']})" for r in broken))
    folder = f"{root}/snapshot-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def fingerprint_words(df: DataFrame) -> DataFrame:
    """df with h0..h3: the first four words of 48 bits of each row's SHA-256, of its values by column name, U+001F between them and U+0000 for null."""
    row = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(df.columns)]), 256)
    return df.withColumns({f"h{k}": F.conv(F.substring(row, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)") for k in range(4)})


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, h0, h1, h2, h3) that depends on the rows of df alone, all columns of them, not on their order or partitions.

    The words of the rows are summed, modulo 2^48 each, which combines before
    the shuffle: 192 bits in all.
    """
    sums = [F.coalesce((F.sum(f"h{k}") % F.lit(1 << 48)).cast("long"), F.lit(0)).alias(f"h{k}") for k in range(4)]
    return fingerprint_words(df).agg(F.count("*").alias("n"), *sums)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
