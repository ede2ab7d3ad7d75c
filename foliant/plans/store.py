"""The test tables in the roles of the store: desks, institutions, sources, runs, results, articles, categories.

Each function has its DuckDB table expression of the same name in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.snapshots import table


def desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("desk_id"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as sources: some without desk, institution, tag or an explicit switch."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.concat(F.lit("s"), key.cast("string")).alias("slug"),
        F.col("c_name").alias("display_name"),
        F.when(key % 5 == 0, "").when(key % 5 == 1, "zh-Hans").when(key % 5 == 2, "en").alias("language_tag"),
        F.when(key % 3 == 0, "ZH").otherwise("EN").alias("language"),
        F.when(key % 9 != 0, nation % 5).alias("desk_id"),
        F.when(key % 7 != 0, nation).alias("institution_id"),
        F.when(key % 4 != 0, F.col("c_acctbal") > 1000).alias("enabled"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each day of events."""
    day = F.dayofmonth("ts").cast("long").alias("id")
    return table(spark, sf_dir, "events").groupBy(day).agg(F.min("ts").alias("started_at"), F.max("ts").alias("completed_at"), F.count_if(F.col("event_type") == "purchase").alias("articles_new"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as per-source results: the day is the run, the user the source."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.dayofmonth("ts").cast("long").alias("scrape_run_id"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("source_slug"),
        F.when(kind == "error", "LISTING_FAILURE").when(kind == "view", "OK_NO_PUBLICATIONS").when(kind == "signup", "SKIPPED_DISABLED").otherwise("OK").alias("status"),
        (kind == "error").alias("is_failure"),
        F.when(kind == "purchase", 1).otherwise(0).alias("new_documents"),
        F.col("ts").alias("completed_at"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as articles: status F has passed, P is rejected, O is pending; two thirds of those passed are analyzed."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    passed = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "P", False)
    analyzed = (F.col("o_orderstatus") == "F") & (key % 3 != 0)
    return table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.concat(F.lit("http://s"), (key % 50).cast("string"), F.lit(".example/n"), key.cast("string")).alias("url"),
        F.col("o_custkey").alias("source_id"),
        (key % 30 + 1).alias("scrape_run_id"),
        F.concat(F.lit("Report "), (key % 997).cast("string")).alias("title_original"),
        F.repeat(F.lit("x"), (key % 200).cast("int")).alias("text_original"),
        day.alias("published_date"),
        day.alias("scraped_on"),
        (key % 100 / 100).alias("relevance_score"),
        passed.alias("passed_relevance"),
        F.when(key % 11 == 0, "").when(key % 13 != 0, F.concat(F.lit("Title "), key.cast("string"))).alias("title_english"),
        F.when(key % 17 == 0, " ").when(analyzed, F.concat(F.lit("Summary. "), F.when(key % 19 == 0, "The body does not match the headline. ").otherwise(""), F.col("o_orderpriority"))).alias("summary_english"),
        F.when(analyzed, day).alias("analyzed_at"),
        F.when(analyzed, F.col("o_orderpriority") == "1-URGENT").alias("is_significant"),
    )


def article_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("article_id"), F.col("p_brand").alias("category")).distinct()


SQL = {
    "desks": "desks AS (SELECT r_regionkey AS id, r_name AS name FROM region)",
    "institutions": "institutions AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS desk_id FROM nation)",
    "sources": """sources AS (SELECT c_custkey AS id, 's' || c_custkey AS slug, c_name AS display_name,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'zh-Hans' WHEN 2 THEN 'en' END AS language_tag, CASE WHEN c_custkey % 3 = 0 THEN 'ZH' ELSE 'EN' END AS language,
  CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey % 5 END AS desk_id, CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END AS institution_id,
  CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal > 1000 END AS enabled, c_acctbal >= 0 AS is_active FROM customer)""",
    "runs": "runs AS (SELECT CAST(day(ts) AS BIGINT) AS id, min(ts) AS started_at, max(ts) AS completed_at, count(*) FILTER (event_type = 'purchase') AS articles_new FROM events GROUP BY 1)",
    "results": """results AS (SELECT event_id AS id, CAST(day(ts) AS BIGINT) AS scrape_run_id, 's' || user_id AS source_slug,
  CASE event_type WHEN 'error' THEN 'LISTING_FAILURE' WHEN 'view' THEN 'OK_NO_PUBLICATIONS' WHEN 'signup' THEN 'SKIPPED_DISABLED' ELSE 'OK' END AS status,
  event_type = 'error' AS is_failure, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS new_documents, ts AS completed_at FROM events)""",
    "articles": """articles AS (SELECT id, url, source_id, scrape_run_id, title_original, text_original, published_date, scraped_on, relevance_score, passed_relevance, title_english,
  CASE WHEN id % 17 = 0 THEN ' ' WHEN done THEN 'Summary. ' || CASE WHEN id % 19 = 0 THEN 'The body does not match the headline. ' ELSE '' END || priority END AS summary_english,
  CASE WHEN done THEN published_date END AS analyzed_at, CASE WHEN done THEN priority = '1-URGENT' END AS is_significant
  FROM (SELECT o_orderkey AS id, 'http://s' || (o_orderkey % 50) || '.example/n' || o_orderkey AS url, o_custkey AS source_id, o_orderkey % 30 + 1 AS scrape_run_id,
    'Report ' || (o_orderkey % 997) AS title_original, repeat('x', CAST(o_orderkey % 200 AS INTEGER)) AS text_original, CAST(o_orderdate AS DATE) AS published_date, CAST(o_orderdate AS DATE) AS scraped_on,
    (o_orderkey % 100) / 100 AS relevance_score, CASE o_orderstatus WHEN 'F' THEN true WHEN 'P' THEN false END AS passed_relevance,
    CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 <> 0 THEN 'Title ' || o_orderkey END AS title_english, o_orderpriority AS priority, o_orderstatus = 'F' AND o_orderkey % 3 <> 0 AS done FROM orders))""",
    "article_categories": "article_categories AS (SELECT DISTINCT l_orderkey AS article_id, p_brand AS category FROM lineitem JOIN part ON l_partkey = p_partkey)",
}


def with_tables(*names: str) -> str:
    """The WITH clause of the named tables."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
