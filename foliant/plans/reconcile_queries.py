"""The three-way reconcile on snapshots made of the store's tables, each query with its SQL.

base holds the articles with id % 4 in (0, 3) and the runs to 20. origin and
local have both grown since, with colliding ids of articles and runs and, on
the local side, other source ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import reconcile as ops
from foliant.plans import store as t
from foliant.plans.registry import query
from foliant.plans.store import with_tables

#: The analysis columns that the stand-in articles have.
FIELDS = ["relevance_score", "passed_relevance", "title_english", "summary_english", "analyzed_at", "is_significant"]
SHIFT = 1_000_000


def snapshots(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, DataFrame]]:
    key = F.col("id")
    rows, sources, links = t.articles(spark, sf_dir), t.sources(spark, sf_dir), t.article_categories(spark, sf_dir)
    runs = t.runs(spark, sf_dir).select("id", "articles_new")
    results = t.results(spark, sf_dir).groupBy("scrape_run_id", "source_slug").agg(F.max("status").alias("status"), F.sum("new_documents").alias("new_documents"))
    open_ = lambda k: {c: F.when(key % k != 0, F.col(c)) for c in ("passed_relevance", "analyzed_at", "is_significant")}
    base = rows.filter("id % 4 in (0, 3)").withColumns(open_(3)).withColumn("scrape_run_id", key % 20 + 1)
    origin = rows.filter("id % 4 <> 1").withColumns(open_(5)).withColumn("scrape_run_id", key % 20 + 1)
    own = key % 4 == 1
    local = rows.filter("id % 4 <> 2").withColumns(
        {"id": F.when(own, key + 1).otherwise(key), "scrape_run_id": F.when(own, key % 8 + 21).otherwise(key % 20 + 1), "source_id": F.col("source_id") + SHIFT}
    )
    moved = sources.withColumn("id", F.col("id") + SHIFT)
    on_local = links.filter("article_id % 4 <> 2").withColumn("article_id", F.when(F.col("article_id") % 4 == 1, F.col("article_id") + 1).otherwise(F.col("article_id")))
    return {
        "base": {"articles": base, "runs": runs.filter("id <= 20")},
        "origin": {"articles": origin, "runs": runs.filter("id <= 25"), "sources": sources, "links": links.filter("article_id % 4 <> 1"), "results": results.filter("scrape_run_id <= 25")},
        "local": {"articles": local, "runs": runs.filter("id <= 28"), "sources": moved, "links": on_local, "results": results.filter("scrape_run_id <= 28 and scrape_run_id % 3 <> 0")},
    }


def _articles(snaps: dict[str, dict[str, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(origin, local in origin's terms, run map)."""
    o, loc = snaps["origin"], snaps["local"]
    runs = ops.run_map(snaps["base"]["runs"], o["runs"], loc["runs"])
    return o["articles"], ops.in_terms_of(loc["articles"], runs, loc["sources"], o["sources"]), runs


SNAPS = with_tables("articles", "sources", "runs", "results", "article_categories") + """,
base AS (SELECT * REPLACE (CASE WHEN id % 3 <> 0 THEN passed_relevance END AS passed_relevance, CASE WHEN id % 3 <> 0 THEN analyzed_at END AS analyzed_at, id % 20 + 1 AS scrape_run_id) FROM articles WHERE id % 4 IN (0, 3)),
origin AS (SELECT * REPLACE (CASE WHEN id % 5 <> 0 THEN passed_relevance END AS passed_relevance, CASE WHEN id % 5 <> 0 THEN analyzed_at END AS analyzed_at, CASE WHEN id % 5 <> 0 THEN is_significant END AS is_significant, id % 20 + 1 AS scrape_run_id) FROM articles WHERE id % 4 <> 1),
loc AS (SELECT * REPLACE (CASE WHEN id % 4 = 1 THEN id + 1 ELSE id END AS id, CASE WHEN id % 4 = 1 THEN id % 8 + 21 ELSE id % 20 + 1 END AS scrape_run_id, source_id + 1000000 AS source_id) FROM articles WHERE id % 4 <> 2),
run_map AS (SELECT id AS scrape_run_id, 25 + row_number() OVER (ORDER BY id) AS new_run FROM runs WHERE id BETWEEN 21 AND 28),
one_result AS (SELECT scrape_run_id, source_slug, max(status) AS status, CAST(sum(new_documents) AS BIGINT) AS new_documents FROM results GROUP BY 1, 2),
merged AS (
  SELECT o.id, o.url, o.source_id, o.scrape_run_id, CASE WHEN t THEN l.passed_relevance ELSE o.passed_relevance END AS passed_relevance, CASE WHEN t THEN l.analyzed_at ELSE o.analyzed_at END AS analyzed_at, t AS backfilled
  FROM origin o LEFT JOIN loc l ON o.url = l.url CROSS JOIN LATERAL (SELECT coalesce((o.analyzed_at IS NULL AND l.analyzed_at IS NOT NULL) OR (o.passed_relevance IS NULL AND l.passed_relevance IS NOT NULL), false) AS t)
  UNION ALL SELECT (SELECT max(id) FROM origin) + row_number() OVER (ORDER BY l.id), url, source_id - 1000000, coalesce(new_run, l.scrape_run_id), passed_relevance, analyzed_at, true FROM loc l LEFT JOIN run_map r ON l.scrape_run_id = r.scrape_run_id WHERE url NOT IN (SELECT url FROM origin))"""


@query(f"{SNAPS} SELECT scrape_run_id, new_run FROM run_map")
def reconcile_run_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshots(spark, sf_dir)
    return ops.run_map(snaps["base"]["runs"], snaps["origin"]["runs"], snaps["local"]["runs"])


@query(f"{SNAPS} SELECT id, url, source_id, scrape_run_id, passed_relevance, analyzed_at FROM merged")
def reconcile_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin, local, _ = _articles(snapshots(spark, sf_dir))
    merged = ops.reconcile_articles(origin, local, fields=FIELDS)
    return merged.select("id", "url", "source_id", "scrape_run_id", "passed_relevance", "analyzed_at")


@query(f"{SNAPS} SELECT url, 's' || (source_id - 1000000) AS source_slug FROM loc WHERE source_id - 1000000 NOT IN (SELECT id FROM sources WHERE id % 50 <> 0)")
def reconcile_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshots(spark, sf_dir)
    runs = ops.run_map(snaps["base"]["runs"], snaps["origin"]["runs"], snaps["local"]["runs"])
    known = snaps["origin"]["sources"].filter("id % 50 <> 0")
    return ops.unresolved(ops.in_terms_of(snaps["local"]["articles"], runs, snaps["local"]["sources"], known))


@query(f"""{SNAPS} SELECT article_id, category FROM article_categories WHERE article_id % 4 <> 1
UNION SELECT m.id, category FROM article_categories c JOIN articles a ON c.article_id = a.id JOIN merged m ON a.url = m.url WHERE m.backfilled AND a.id % 4 <> 2""")
def reconcile_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshots(spark, sf_dir)
    origin, local, _ = _articles(snaps)
    merged = ops.reconcile_articles(origin, local, fields=FIELDS)
    return ops.merged_links(snaps["origin"]["links"], snaps["local"]["links"], local, origin, merged)


@query(f"""{SNAPS} SELECT scrape_run_id, source_slug, status, new_documents FROM one_result WHERE scrape_run_id <= 25
UNION ALL SELECT new_run, source_slug, status, new_documents FROM one_result JOIN run_map USING (scrape_run_id) WHERE scrape_run_id % 3 <> 0""")
def reconcile_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshots(spark, sf_dir)
    runs = ops.run_map(snaps["base"]["runs"], snaps["origin"]["runs"], snaps["local"]["runs"])
    placed = ops.placed_results(snaps["local"]["results"], snaps["base"]["runs"], snaps["local"]["runs"], runs)
    return ops.merged_results(snaps["origin"]["results"], placed)


_GATES = ["duplicate_url", "duplicate_id", "id_drift", "origin_url_lost", "local_url_lost", "origin_decision_lost", "local_decision_lost", "source_conflict", "origin_source_changed", "local_source_changed"]
_RESULT_GATES = ["origin_result_lost", "origin_result_altered", "local_result_unproven", "local_result_lost", "local_result_altered", "result_of_neither", "duplicate_result", "result_without_run"]


@query(f"""{SNAPS}, bad AS (SELECT * REPLACE (CASE WHEN id % 40 = 0 THEN id + 1 ELSE id END AS id, CASE WHEN id % 24 = 0 THEN NULL ELSE passed_relevance END AS passed_relevance) FROM merged WHERE url NOT LIKE '%7')
SELECT 'duplicate_url' AS name, count(*) AS violations FROM (SELECT url FROM bad GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM bad GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'id_drift', count(*) FROM base b JOIN bad m USING (url) WHERE b.id <> m.id
UNION ALL SELECT 'origin_url_lost', count(*) FROM origin WHERE url NOT IN (SELECT url FROM bad)
UNION ALL SELECT 'local_url_lost', count(*) FROM loc WHERE url NOT IN (SELECT url FROM bad)
UNION ALL SELECT 'origin_decision_lost', count(*) FROM origin o JOIN bad m USING (url) WHERE o.passed_relevance IS NOT NULL AND m.passed_relevance IS NULL
UNION ALL SELECT 'local_decision_lost', count(*) FROM loc o JOIN bad m USING (url) WHERE o.passed_relevance IS NOT NULL AND m.passed_relevance IS NULL
UNION ALL SELECT 'source_conflict', count(*) FROM origin o JOIN loc l USING (url) WHERE o.source_id <> l.source_id - 1000000
UNION ALL SELECT 'origin_source_changed', count(*) FROM origin o JOIN bad m USING (url) WHERE o.source_id <> m.source_id
UNION ALL SELECT 'local_source_changed', count(*) FROM loc o JOIN bad m USING (url) WHERE o.source_id - 1000000 <> m.source_id AND url NOT IN (SELECT url FROM origin)""")
def reconcile_article_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates on a merge that was tampered with: lost, moved and undecided rows must show."""
    snaps = snapshots(spark, sf_dir)
    origin, local, _ = _articles(snaps)
    sources = snaps["origin"]["sources"]
    slugs = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"))
    named = lambda df: df.join(slugs, "source_id", "left")
    merged = named(ops.reconcile_articles(origin, local, fields=FIELDS))
    key = F.col("id")
    bad = merged.filter("url not like '%7'").withColumns({"id": F.when(key % 40 == 0, key + 1).otherwise(key), "passed_relevance": F.when(key % 24 != 0, F.col("passed_relevance"))})
    return ops.gates(snaps["base"]["articles"], named(origin), local, bad)


@query(f"""{SNAPS}, o AS (SELECT * FROM one_result WHERE scrape_run_id <= 25), l AS (SELECT r.*, coalesce(new_run, CASE WHEN r.scrape_run_id <= 20 THEN r.scrape_run_id END) AS mapped FROM one_result r LEFT JOIN run_map USING (scrape_run_id) WHERE r.scrape_run_id <= 28 AND r.scrape_run_id % 3 <> 0),
m AS (SELECT scrape_run_id, source_slug, CASE WHEN source_slug = 's9' THEN 'LOST' ELSE status END AS status FROM (SELECT * FROM o UNION ALL SELECT mapped, source_slug, status, new_documents FROM l WHERE mapped > 25) WHERE source_slug <> 's4')
SELECT 'origin_result_lost' AS name, count(*) AS violations FROM o WHERE source_slug = 's4'
UNION ALL SELECT 'origin_result_altered', count(*) FROM o JOIN m USING (scrape_run_id, source_slug) WHERE o.status <> m.status
UNION ALL SELECT 'local_result_unproven', count(*) FROM l WHERE mapped IS NULL
UNION ALL SELECT 'local_result_lost', count(*) FROM l WHERE (mapped, source_slug) NOT IN (SELECT (scrape_run_id, source_slug) FROM m)
UNION ALL SELECT 'local_result_altered', count(*) FROM l JOIN m ON l.mapped = m.scrape_run_id AND l.source_slug = m.source_slug WHERE l.status <> m.status AND mapped > 25
UNION ALL SELECT 'result_of_neither', 0 UNION ALL SELECT 'duplicate_result', 0
UNION ALL SELECT 'result_without_run', count(*) FROM m WHERE scrape_run_id > 30""")
def reconcile_result_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshots(spark, sf_dir)
    o, loc, base = snaps["origin"], snaps["local"], snaps["base"]
    runs = ops.run_map(base["runs"], o["runs"], loc["runs"])
    placed = ops.placed_results(loc["results"], base["runs"], loc["runs"], runs)
    merged = ops.merged_results(o["results"], placed).filter("source_slug <> 's4'").withColumn("status", F.when(F.col("source_slug") == "s9", "LOST").otherwise(F.col("status")))
    return ops.result_gates(o["results"], placed, merged, t.runs(spark, sf_dir), ["status"])


@query(f"""{SNAPS} SELECT 'base' AS snapshot, 'no table sources' AS problem, 1 AS n UNION ALL SELECT 'local', 'no column runs.started_at', 1 UNION ALL SELECT 'origin', 'no column runs.started_at', 1 UNION ALL SELECT 'base', 'no column runs.started_at', 1
UNION ALL SELECT 'origin', 'articles.source_id without sources', count(*) FROM origin WHERE source_id NOT IN (SELECT id FROM sources) HAVING count(*) > 0
UNION ALL SELECT 'origin', 'articles.scrape_run_id without runs', count(*) FROM origin WHERE scrape_run_id NOT IN (SELECT id FROM runs WHERE id <= 25) HAVING count(*) > 0""")
def reconcile_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = snapshots(spark, sf_dir)
    required = {"articles": ["id", "url", "source_id"], "runs": ["id", "started_at"], "sources": ["id", "slug"]}
    return ops.preflight(snaps, required, [("articles", "source_id", "sources"), ("articles", "scrape_run_id", "runs")])
