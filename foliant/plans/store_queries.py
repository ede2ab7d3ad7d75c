"""Queries over the store, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import store as ops
from foliant.plans import store as t
from foliant.plans.registry import query
from foliant.plans.store import with_tables as w
from foliant.sources.snapshots import table


@query(f"{w('sources')} SELECT id FROM sources WHERE slug = 's7'")
def source_by_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.id_of(t.sources(spark, sf_dir), "s7")


@query(f"{w('articles')} SELECT a.id, b.url IS NOT NULL AS known FROM articles a LEFT JOIN (SELECT url FROM articles WHERE id % 3 = 0) b ON a.url = b.url WHERE a.id % 2 = 0")
def store_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir).select("id", "url")
    return ops.stored(rows.filter("id % 2 = 0"), rows.filter("id % 3 = 0"), ["url"]).select("id", "known")


@query(f"{w('articles')} SELECT id FROM articles WHERE passed_relevance AND analyzed_at IS NULL ORDER BY id")
def pending_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pending_analysis(t.articles(spark, sf_dir)).select("id")


@query(f"{w('articles')} SELECT id, published_date FROM articles WHERE passed_relevance IS NULL ORDER BY id")
def unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unscored(t.articles(spark, sf_dir)).select("id", "published_date")


@query(f"{w('articles')} SELECT id FROM articles WHERE passed_relevance IS NULL AND published_date >= DATE '1998-01-01' AND published_date <= DATE '1999-06-30' ORDER BY id LIMIT 200")
def unscored_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill's next batch of at most 200: the limit is the operator's own."""
    return ops.unscored(t.articles(spark, sf_dir), "1998-01-01", "1999-06-30", 200).select("id")


@query(f"{w('articles', 'sources', 'article_categories')} SELECT a.id, source_id, slug AS source_slug, coalesce(categories, '') AS categories, published_date, is_significant FROM articles a JOIN sources s ON a.source_id = s.id LEFT JOIN (SELECT article_id, string_agg(category, ',' ORDER BY category) AS categories FROM article_categories GROUP BY 1) c ON a.id = c.article_id WHERE analyzed_at IS NOT NULL ORDER BY published_date DESC, is_significant DESC, relevance_score DESC")
def analyzed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.analyzed(t.articles(spark, sf_dir), t.sources(spark, sf_dir), t.article_categories(spark, sf_dir))
    return rows.select("id", "source_id", "source_slug", "categories", "published_date", "is_significant")


@query(f"{w('articles', 'sources')} SELECT a.id, slug AS source_slug, is_significant, relevance_score FROM articles a JOIN sources s ON source_id = s.id WHERE analyzed_at IS NOT NULL AND published_date = DATE '1996-05-04'")
def day_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.of_day(t.articles(spark, sf_dir), t.sources(spark, sf_dir), "1996-05-04").select("id", "source_slug", "is_significant", "relevance_score")


@query(f"{w('article_categories')} SELECT category FROM article_categories WHERE article_id = 32 ORDER BY 1")
def article_categories_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.article_categories(spark, sf_dir).filter("article_id = 32").select("category").orderBy("category")


@query(f"{w('articles', 'article_categories')} SELECT a.id, coalesce(string_agg(category, ',' ORDER BY category), '') AS categories FROM articles a LEFT JOIN article_categories ON id = article_id WHERE analyzed_at IS NOT NULL AND published_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31' GROUP BY 1")
def range_with_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("published_date")
    rows = t.articles(spark, sf_dir).filter(F.col("analyzed_at").isNotNull() & day.between(F.lit("1996-03-01").cast("date"), F.lit("1996-03-31").cast("date")))
    folded = ops.folded_categories(t.article_categories(spark, sf_dir).join(rows.select(F.col("id").alias("article_id")), "article_id", "left_semi"))
    return rows.join(folded, rows["id"] == folded["article_id"], "left").select("id", F.coalesce("categories", F.lit("")).alias("categories"))


@query(f"{w('sources')} SELECT slug, coalesce(nullif(language_tag, ''), CASE language WHEN 'ZH' THEN 'zh-Hans' WHEN 'EN' THEN 'en' ELSE language END) AS tag, coalesce(enabled, is_active) AS on FROM sources")
def source_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.source_state(t.sources(spark, sf_dir))
    return rows.select("slug", ops.language_tag(F.col("language_tag"), F.col("language")).alias("tag"), "on")


@query(f"{w('sources', 'desks', 'institutions')} SELECT s.id, slug, d.name AS desk, i.name AS institution FROM sources s LEFT JOIN desks d ON s.desk_id = d.id LEFT JOIN institutions i ON s.institution_id = i.id ORDER BY s.id")
def sources_with_desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ops.named_sources(t.sources(spark, sf_dir), t.desks(spark, sf_dir), t.institutions(spark, sf_dir))
    return rows.select("id", "slug", "desk", "institution").orderBy("id")


@query(f"{w('results')} SELECT id, source_slug, status FROM results WHERE scrape_run_id = 12 ORDER BY source_slug")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.results_of(t.results(spark, sf_dir), 12).select("id", "source_slug", "status")


@query(f"{w('runs')} SELECT id, started_at, articles_new FROM runs ORDER BY id DESC LIMIT 1")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_run(t.runs(spark, sf_dir)).select("id", "started_at", "articles_new")


@query(f"{w('results', 'sources')} SELECT DISTINCT scrape_run_id, desk_id FROM results JOIN sources ON source_slug = slug WHERE status NOT IN ('SKIPPED_DISABLED', 'NOT_IMPLEMENTED') AND desk_id IS NOT NULL")
def collecting_desks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.collecting_desks(t.results(spark, sf_dir), t.sources(spark, sf_dir))


@query(f"{w('results', 'sources')} SELECT r.id, source_slug FROM results r LEFT JOIN sources ON source_slug = slug WHERE status NOT IN ('SKIPPED_DISABLED', 'NOT_IMPLEMENTED') AND desk_id IS NULL")
def unmapped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unmapped_results(t.results(spark, sf_dir), t.sources(spark, sf_dir)).select("id", "source_slug")


@query(f"""{w('results', 'sources')} SELECT scrape_run_id, count(*) FILTER (ran) AS n_executed, count(*) FILTER (ran AND is_failure) AS n_failed, count(*) FILTER (status = 'NOT_IMPLEMENTED') AS n_unimplemented, count(*) FILTER (status = 'SKIPPED_DISABLED') AS n_disabled,
CASE WHEN count(*) FILTER (ran AND desk_id IS NULL) = 0 THEN count(DISTINCT desk_id) FILTER (ran) END AS n_desks FROM (SELECT *, status NOT IN ('SKIPPED_DISABLED', 'NOT_IMPLEMENTED') AS ran FROM results LEFT JOIN sources ON source_slug = slug) GROUP BY 1""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.run_summary(t.results(spark, sf_dir), t.sources(spark, sf_dir))


@query(f"{w('sources', 'institutions')} SELECT count(DISTINCT institution_id) AS n FROM sources")
def institution_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.sources(spark, sf_dir).agg(F.count_distinct("institution_id").alias("n"))


@query(f"{w('articles', 'sources', 'runs')} SELECT (SELECT count(*) FROM articles) AS n_articles, (SELECT count(*) FROM articles WHERE analyzed_at IS NOT NULL) AS n_analyzed, (SELECT count(*) FROM sources) AS n_sources, (SELECT count(DISTINCT institution_id) FROM sources) AS n_institutions, (SELECT count(*) FROM runs) AS n_runs")
def store_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.totals(t.articles(spark, sf_dir), t.sources(spark, sf_dir), t.runs(spark, sf_dir))


@query(f"{w('articles', 'sources')} SELECT a.id, slug AS source_slug FROM (SELECT * FROM articles WHERE analyzed_at IS NOT NULL ORDER BY published_date DESC, id DESC LIMIT 60) a LEFT JOIN sources s ON source_id = s.id")
def recent_analyzed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recent_analyzed(t.articles(spark, sf_dir), t.sources(spark, sf_dir)).select("id", "source_slug")


@query(f"{w('articles')} SELECT id, length(text_original) AS n_chars FROM articles WHERE passed_relevance AND trim(coalesce(title_english, '')) = '' ORDER BY 2 DESC, 1")
def stuck_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stuck_translations(t.articles(spark, sf_dir)).select("id", F.col("n_chars").cast("long").alias("n_chars"))


@query(f"{w('articles')} SELECT count(*) AS n, count(passed_relevance) AS n_decided, count(*) FILTER (passed_relevance) AS n_passed, count(*) FILTER (is_significant) AS n_flagged, round(count(*) FILTER (passed_relevance) * 100 / nullif(count(passed_relevance), 0), 1) AS rate FROM articles")
def screening_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.screening_summary(t.articles(spark, sf_dir))


@query(f"{w('articles')} SELECT url, title_english AS title FROM articles WHERE trim(coalesce(title_english, '')) <> ''")
def title_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.titles(t.articles(spark, sf_dir))


@query(f"{w('articles', 'sources')} SELECT url, slug AS source_slug FROM articles LEFT JOIN sources s ON source_id = s.id")
def article_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.attribution(t.articles(spark, sf_dir), t.sources(spark, sf_dir))


@query(f"{w('articles')} SELECT id, 'not_rendered' AS side FROM articles WHERE analyzed_at IS NOT NULL AND passed_relevance AND id % 7 = 0 UNION ALL SELECT id, 'not_publishable' FROM articles WHERE (analyzed_at IS NULL OR passed_relevance IS NOT TRUE) AND id % 7 <> 0")
def rendered_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir)
    return ops.rendered_difference(rows, rows.filter("id % 7 <> 0").select("id"))


@query(f"{w('articles')} SELECT min(published_date) AS first_date, max(published_date) AS last_date, count(*) AS n FROM articles")
def store_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.span(t.articles(spark, sf_dir))


@query(f"""{w('articles', 'sources', 'results')} SELECT slug AS source_slug, run, status, last_new, last_ok, coalesce(n_articles, 0) AS n_articles, coalesce(n_analyzed, 0) AS n_analyzed FROM sources s
LEFT JOIN (SELECT source_slug, arg_max(scrape_run_id, (scrape_run_id, id)) AS run, arg_max(status, (scrape_run_id, id)) AS status, max(completed_at) FILTER (new_documents > 0) AS last_new, max(completed_at) FILTER (NOT is_failure) AS last_ok FROM results GROUP BY 1) r ON s.slug = r.source_slug
LEFT JOIN (SELECT source_id, count(*) AS n_articles, count(analyzed_at) AS n_analyzed FROM articles GROUP BY 1) a ON s.id = a.source_id""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.latest_results(t.results(spark, sf_dir), t.articles(spark, sf_dir), t.sources(spark, sf_dir))


@query(f"""{w('articles', 'sources', 'runs', 'results', 'institutions', 'desks')}, v AS (
SELECT 'articles.count' AS "check", count(*) AS value FROM articles UNION ALL SELECT 'articles.distinct', count(DISTINCT id) FROM articles UNION ALL SELECT 'articles.max', max(id) FROM articles
UNION ALL SELECT 'sources.count', count(*) FROM sources UNION ALL SELECT 'sources.distinct', count(DISTINCT id) FROM sources UNION ALL SELECT 'sources.max', max(id) FROM sources
UNION ALL SELECT 'runs.count', count(*) FROM runs UNION ALL SELECT 'runs.distinct', count(DISTINCT id) FROM runs UNION ALL SELECT 'runs.max', max(id) FROM runs
UNION ALL SELECT 'results.count', count(*) FROM results UNION ALL SELECT 'results.distinct', count(DISTINCT id) FROM results UNION ALL SELECT 'results.max', max(id) FROM results
UNION ALL SELECT 'institutions.count', count(*) FROM institutions UNION ALL SELECT 'institutions.distinct', count(DISTINCT id) FROM institutions UNION ALL SELECT 'institutions.max', max(id) FROM institutions
UNION ALL SELECT 'articles.source_id orphans', count(*) FROM articles WHERE source_id NOT IN (SELECT id FROM sources)
UNION ALL SELECT 'articles.scrape_run_id orphans', count(*) FROM articles WHERE scrape_run_id NOT IN (SELECT id FROM runs)
UNION ALL SELECT 'results.scrape_run_id orphans', count(*) FROM results WHERE scrape_run_id NOT IN (SELECT id FROM runs)
UNION ALL SELECT 'sources.institution_id orphans', count(*) FROM sources WHERE institution_id IS NOT NULL AND institution_id NOT IN (SELECT id FROM institutions)
UNION ALL SELECT 'sources.desk_id null', count(*) FROM sources WHERE desk_id IS NULL) SELECT * FROM v""")
def store_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"articles": t.articles, "sources": t.sources, "runs": t.runs, "results": t.results, "institutions": t.institutions}
    references = [("articles", "source_id", "sources", "id"), ("articles", "scrape_run_id", "runs", "id"), ("results", "scrape_run_id", "runs", "id"), ("sources", "institution_id", "institutions", "id")]
    return ops.structure({k: f(spark, sf_dir) for k, f in tables.items()}, references, [("sources", "desk_id")])


@query(f"""{w('articles')}, s AS (SELECT id, CASE WHEN id % 10 = 0 THEN NULL ELSE (id % 150 - 20) / 100 END AS score, CASE WHEN id % 10 = 0 THEN 'no answer' END AS error FROM articles WHERE passed_relevance IS NULL)
SELECT a.id, CASE WHEN s.id IS NULL THEN relevance_score WHEN error IS NOT NULL THEN 0.0 ELSE greatest(0.0, least(1.0, score)) END AS relevance_score,
CASE WHEN s.id IS NULL THEN passed_relevance ELSE error IS NULL AND greatest(0.0, least(1.0, score)) >= 0.6 END AS passed_relevance FROM articles a LEFT JOIN s ON a.id = s.id""")
def relevance_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir)
    failed = F.col("id") % 10 == 0
    scores = rows.filter("passed_relevance is null").select(
        "id", F.when(~failed, (F.col("id") % 150 - 20) / 100).alias("score"), F.lit("by title").alias("reasoning"), F.when(failed, "no answer").alias("error")
    )
    return ops.with_relevance(rows, scores).select("id", "relevance_score", "passed_relevance")


@query(f"""{w('articles', 'article_categories')}, g AS (SELECT id AS article_id, unnest(['Brand#11', 'Brand#' || (id % 60), 'Brand#11']) AS category FROM articles WHERE analyzed_at IS NOT NULL),
k AS (SELECT DISTINCT p_brand AS category FROM part) SELECT article_id, category, true AS known FROM (SELECT * FROM article_categories UNION SELECT * FROM g WHERE category IN (FROM k))
UNION ALL SELECT DISTINCT article_id, category, false FROM g WHERE category NOT IN (FROM k)""")
def category_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = t.articles(spark, sf_dir).filter("analyzed_at is not null")
    given = done.select(F.col("id").alias("article_id"), F.array(F.lit("Brand#11"), F.concat(F.lit("Brand#"), (F.col("id") % 60).cast("string")), F.lit("Brand#11")).alias("slugs"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("slug")).distinct()
    links, unknown = ops.linked_categories(t.article_categories(spark, sf_dir), given, brands)
    return links.withColumn("known", F.lit(True)).union(unknown.withColumn("known", F.lit(False)))


@query(f"{w('articles', 'article_categories')} SELECT id, n FROM articles a JOIN (SELECT article_id, count(*) AS n FROM article_categories GROUP BY 1) l ON a.id = l.article_id WHERE id NOT IN (SELECT id FROM articles WHERE id % 8 = 3)")
def cascade_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir)
    left, links = ops.without(rows, t.article_categories(spark, sf_dir), rows.filter("id % 8 = 3"))
    return left.select("id").join(links.groupBy(F.col("article_id").alias("id")).agg(F.count("*").alias("n")), "id")


@query(f"{w('sources')} SELECT slug, coalesce(CASE WHEN id % 2 = 0 THEN 'renamed ' || slug END, display_name) AS display_name, desk_id, is_active FROM sources WHERE desk_id = 2 UNION ALL SELECT slug, display_name, desk_id, is_active FROM sources WHERE desk_id IS DISTINCT FROM 2 UNION ALL SELECT 'new', 'renamed new', 2, NULL")
def config_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = t.sources(spark, sf_dir).select("slug", "display_name", "desk_id", "is_active")
    ids = t.sources(spark, sf_dir).filter("desk_id = 2 and id % 2 = 0").select("slug").union(spark.range(1).select(F.lit("new").alias("slug")))
    declared = ids.select("slug", F.concat(F.lit("renamed "), "slug").alias("display_name"), F.lit(2).alias("desk_id"))
    return ops.synced(current, declared, "slug", "desk_id")
