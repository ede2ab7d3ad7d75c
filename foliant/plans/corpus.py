"""The test tables in the roles of the corpus: records, runs, results, editions, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators.filters import processing_state
from foliant.sources.snapshots import table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels as records: title, state, flag, score, dates."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    rows = docs.join(labels, "doc_id", "left")
    passed, analyzed = F.col("quality") == 1, F.col("doc_id") % 3 != 0
    state = processing_state(passed, analyzed)
    return rows.select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("lang").alias("language"),
        F.concat(F.lit("http://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        F.element_at(F.split("text", "\n"), 1).alias("title"),
        "text",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 120).cast("int")).alias("published_date"),
        passed.alias("passed"),
        state.alias("state"),
        F.when(state == "analyzed", F.col("toxic") == 1).alias("significant"),
        ((F.col("doc_id") * 37 % 100) / 100).alias("score"),
    )


#: The same as a DuckDB table expression.
RECORDS = """records AS (
  SELECT d.doc_id AS id, d.source, d.lang AS language, 'http://' || d.source || '.example/' || d.doc_id AS url,
    split_part(d.text, chr(10), 1) AS title, d.text, DATE '2024-01-01' + CAST(d.doc_id % 120 AS INTEGER) AS published_date,
    l.quality = 1 AS passed,
    CASE WHEN l.quality IS NULL THEN 'awaiting_screening' WHEN l.quality <> 1 THEN 'not_selected'
         WHEN d.doc_id % 3 <> 0 THEN 'analyzed' ELSE 'analysis_incomplete' END AS state,
    CASE WHEN l.quality = 1 AND d.doc_id % 3 <> 0 THEN l.toxic = 1 END AS significant,
    (d.doc_id * 37 % 100) / 100.0 AS score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as per-source results: the day is the run, the user the source, an error a failure."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("result_id"),
        F.col("ts").cast("date").alias("run_id"),
        F.col("user_id").cast("string").alias("source"),
        F.when(F.col("event_type") == "error", "LISTING_FAILURE").when(F.col("event_type") == "view", "OK_NO_PUBLICATIONS").otherwise("OK").alias("status"),
        (F.col("event_type") == "error").alias("is_failure"),
        F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("new_documents"),
        F.col("ts").alias("completed_at"),
    )


RESULTS = """results AS (
  SELECT event_id AS result_id, CAST(ts AS DATE) AS run_id, CAST(user_id AS VARCHAR) AS source,
    CASE event_type WHEN 'error' THEN 'LISTING_FAILURE' WHEN 'view' THEN 'OK_NO_PUBLICATIONS' ELSE 'OK' END AS status,
    event_type = 'error' AS is_failure, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS new_documents, ts AS completed_at
  FROM events)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders as two diverged snapshots (origin, local): overlapping URLs, decisions that only one has."""
    orders = table(spark, sf_dir, "orders")
    base = orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string")).alias("source"),
        F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False).alias("passed_relevance"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date")).alias("analyzed_at"),
        F.col("o_totalprice").alias("relevance_score"),
    )
    pending = {c: F.when(F.col("id") % 5 != 0, F.col(c)) for c in ("passed_relevance", "analyzed_at")}
    origin = base.filter("id % 4 <> 1").withColumns(pending)
    local = base.filter("id % 4 <> 2")
    return origin, local


SNAPSHOTS = """base AS (
  SELECT o_orderkey AS id, 'u' || o_orderkey AS url, 'c' || (o_custkey % 7) AS source,
    CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS passed_relevance,
    CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) END AS analyzed_at, o_totalprice AS relevance_score FROM orders),
origin AS (SELECT id, url, source, CASE WHEN id % 5 <> 0 THEN passed_relevance END AS passed_relevance, CASE WHEN id % 5 <> 0 THEN analyzed_at END AS analyzed_at, relevance_score FROM base WHERE id % 4 <> 1),
loc AS (SELECT * FROM base WHERE id % 4 <> 2),
merged AS (
  SELECT o.id, o.url, o.source,
    CASE WHEN t THEN l.passed_relevance ELSE o.passed_relevance END AS passed_relevance, CASE WHEN t THEN l.analyzed_at ELSE o.analyzed_at END AS analyzed_at, CASE WHEN t THEN l.relevance_score ELSE o.relevance_score END AS relevance_score
  FROM origin o LEFT JOIN loc l ON o.url = l.url
  CROSS JOIN LATERAL (SELECT coalesce((o.analyzed_at IS NULL AND l.analyzed_at IS NOT NULL) OR (o.passed_relevance IS NULL AND l.passed_relevance IS NOT NULL), false) AS t)
  UNION ALL
  SELECT (SELECT max(id) FROM origin) + row_number() OVER (ORDER BY id), url, source, passed_relevance, analyzed_at, relevance_score FROM loc WHERE url NOT IN (SELECT url FROM origin))"""


def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by week as editions: all weeks of the table."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").groupBy(fx.saturday_ending(day).alias("date")).agg(F.count("*").alias("n_articles"))


#: A Monday's orders and those to the Saturday after belong together; a Sunday's belong to the day before.
EDITIONS = """editions AS (
  SELECT CAST(date_trunc('week', o_orderdate) AS DATE) + 5 AS date, count(*) AS n_articles FROM orders GROUP BY 1)"""
