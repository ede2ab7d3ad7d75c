"""Queries of what is published: feeds, archives, reports; and of the gates before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import feeds, findings, runs, views
from foliant.operators.lineage import numbered
from foliant.plans import store as t
from foliant.plans.corpus import EDITIONS, editions
from foliant.plans.registry import query
from foliant.plans.site_queries import _ISSUE
from foliant.plans.store import with_tables as w
from foliant.sources.snapshots import spread, table

_URLS = "u AS (SELECT id, row_number() OVER (ORDER BY id) AS n, replace('https://site.example/article/' || id || '.html?a=1&b=2', '&', '&amp;') AS loc FROM articles WHERE analyzed_at IS NOT NULL)"


@query(f"""{w('articles')}, {_URLS}, f AS (SELECT (n - 1) // 700 + 1 AS k, string_agg('  <url>' || chr(10) || '    <loc>' || loc || '</loc>' || chr(10) || '  </url>', chr(10) ORDER BY n) AS body FROM u GROUP BY 1)
SELECT 'sitemap-' || k || '.xml' AS name, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || body || chr(10) || '</urlset>' || chr(10) AS text FROM f
UNION ALL SELECT 'sitemap.xml', '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || chr(10) || string_agg('  <sitemap>' || chr(10) || '    <loc>https://site.example/sitemap-' || k || '.xml</loc>' || chr(10) || '  </sitemap>', chr(10) ORDER BY k) || chr(10) || '</sitemapindex>' || chr(10) FROM f""")
def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir).filter("analyzed_at is not null")
    pages = rows.select("id", F.concat(F.lit("article/"), F.col("id").cast("string"), F.lit(".html?a=1&b=2")).alias("loc"))
    return feeds.sitemap_files(pages, "https://site.example/", per_file=700)


@query(f"""WITH {EDITIONS}, e AS (SELECT date, CASE WHEN n_articles % 4 = 0 THEN 'The Weekly' ELSE 'Week of ' || n_articles || ' &lt;new&gt;' END AS title, CASE WHEN n_articles % 3 <> 0 THEN 'A &amp; B' END AS dek, CASE WHEN n_articles % 5 = 0 THEN 'Desk' ELSE 'Author' END AS author, CASE WHEN n_articles % 2 = 0 THEN date + 1 ELSE date END AS stamp FROM editions ORDER BY date DESC LIMIT 100),
x AS (SELECT max(date) AS last, string_agg('  <entry>' || chr(10) || '    <title>' || title || '</title>' || chr(10) || '    <link href="https://w.example/posts/' || date || '.html" rel="alternate" type="text/html"/>' || chr(10) || '    <id>https://w.example/posts/' || date || '.html</id>' || chr(10) || '    <updated>' || stamp || 'T00:00:00Z</updated>' || chr(10) || '    <published>' || stamp || 'T00:00:00Z</published>' || chr(10)
  || '    <author><name>' || author || '</name></author>' || chr(10) || CASE WHEN dek IS NOT NULL THEN '    <summary>' || dek || '</summary>' || chr(10) ELSE '' END || '  </entry>', chr(10) ORDER BY date DESC) AS body FROM e)
SELECT 'feed.xml' AS name, array_to_string(['<?xml version="1.0" encoding="utf-8"?>', '<feed xmlns="http://www.w3.org/2005/Atom">', '  <title>The Weekly</title>', '  <subtitle>Signals &amp; noise</subtitle>', '  <link href="https://w.example/feed.xml" rel="self" type="application/atom+xml"/>', '  <link href="https://w.example/" rel="alternate" type="text/html"/>', '  <id>https://w.example/</id>', '  <updated>' || last || 'T00:00:00Z</updated>', body, '</feed>'], chr(10)) || chr(10) AS text FROM x""")
def atom_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_articles")
    rows = editions(spark, sf_dir).select(
        "date",
        F.when(n % 4 != 0, F.concat(F.lit("Week of "), n.cast("string"), F.lit(" <new>"))).alias("title"),
        F.when(n % 3 != 0, " A & B ").otherwise(" ").alias("dek"),
        F.when(n % 5 == 0, "Desk").otherwise("").alias("author_name"),
        F.when(n % 2 == 0, F.date_add("date", 1)).alias("published_date"),
    )
    return feeds.atom_feed(rows, "https://w.example", "The Weekly", "Signals & noise", "Author")


_ARCHIVE = f"""{w('articles', 'sources', 'article_categories')}, k AS (SELECT article_id, list(category ORDER BY category) AS cats FROM article_categories GROUP BY 1),
archive AS (SELECT a.id, coalesce(title_english, '') AS title_en, title_original AS title_zh, coalesce(summary_english, '') AS summary, CAST(published_date AS VARCHAR) AS date, strftime(published_date, '%-d %B %Y') AS date_fmt, coalesce(display_name, '') AS source, coalesce(slug, '') AS source_slug, coalesce(cats, []) AS categories,
  list_transform(coalesce(cats, []), lambda c: CASE c WHEN 'Brand#11' THEN 'Eleven' ELSE c END) AS category_labels, coalesce(is_significant, false) AS is_significant, CASE WHEN is_significant THEN 'because ' || a.id ELSE '' END AS significance_reason, round(relevance_score, 2) AS relevance_score, url, 'article/' || a.id || '.html' AS article_path, {_ISSUE} AS extraction_issue
  FROM articles a LEFT JOIN sources s ON a.source_id = s.id LEFT JOIN k ON a.id = article_id WHERE analyzed_at IS NOT NULL)"""


def _archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = t.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"), F.col("display_name").alias("source_name"))
    rows = t.articles(spark, sf_dir).filter("analyzed_at is not null").join(sources, "source_id", "left")
    reasoned = rows.withColumn("significance_reasoning", F.when(F.col("is_significant"), F.concat(F.lit("because "), F.col("id").cast("string"))))
    return feeds.archive(reasoned, t.article_categories(spark, sf_dir), {"Brand#11": "Eleven"})


@query(f"{_ARCHIVE} SELECT * FROM archive")
def archive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archive(spark, sf_dir)


@query(f"""{_ARCHIVE}, n AS (SELECT *, row_number() OVER (ORDER BY id) AS n, row_number() OVER (ORDER BY date DESC, id) AS k FROM archive)
SELECT 'data/articles-' || ((n - 1) // 300 + 1) || '.json' AS name, count(*) AS n_rows, min(id) AS first_id, max(id) AS last_id FROM n GROUP BY 1 UNION ALL SELECT 'data/latest.json', 100, arg_min(id, k), arg_max(id, k) FROM n WHERE k <= 100""")
def archive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive's JSON files, parsed again for what is in them."""
    files = feeds.archive_files(_archive(spark, sf_dir), per_file=300)
    rows = F.from_json("text", "array<struct<id:long>>")
    return files.select("name", F.size(rows).cast("long").alias("n_rows"), F.get(rows, 0)["id"].alias("first_id"), F.element_at(rows, -1)["id"].alias("last_id"))


@query(f"""{w('results', 'runs')}, o AS (SELECT scrape_run_id, source_slug, max(status) AS status, bool_or(is_failure) AS is_failure, CAST(sum(new_documents) AS BIGINT) AS new_documents FROM results GROUP BY 1, 2),
g AS (SELECT scrape_run_id AS run, count(*) AS n, count(*) FILTER (status NOT IN ('SKIPPED_DISABLED', 'NOT_IMPLEMENTED')) AS open, count(*) FILTER (is_failure AND status NOT IN ('SKIPPED_DISABLED', 'NOT_IMPLEMENTED')) AS bad,
  coalesce(string_agg('"' || source_slug || '"', ',' ORDER BY source_slug) FILTER (is_failure), '') AS failed, coalesce(string_agg('"' || source_slug || '"', ',' ORDER BY source_slug) FILTER (NOT is_failure AND status = 'OK_NO_PUBLICATIONS'), '') AS empty,
  string_agg('{{"source_slug":"' || source_slug || '","status":"' || status || '","is_failure":' || is_failure || ',"new_documents":' || new_documents || '}}', ',' ORDER BY source_slug) AS sources FROM o GROUP BY 1)
SELECT 'health/run-' || run || '.json' AS name, '{{"run_id":' || run || ',"aggregate_status":"' || CASE WHEN open = 0 THEN 'degraded' WHEN bad = open THEN 'failed' WHEN bad > 0 THEN 'degraded' ELSE 'completed' END || '","source_count":' || n || ',"failed_sources":[' || failed || '],"empty_sources":[' || empty || '],"sources":[' || sources || ']}}' AS text FROM g""")
def health_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = t.results(spark, sf_dir).groupBy("scrape_run_id", "source_slug").agg(F.max("status").alias("status"), F.bool_or("is_failure").alias("is_failure"), F.sum("new_documents").alias("new_documents"))
    statuses = runs.run_status(one, t.runs(spark, sf_dir).withColumnRenamed("id", "scrape_run_id"), "scrape_run_id")
    return feeds.health_reports(one, statuses, ["status", "is_failure", "new_documents"])


_RENDERED = f"""{_ARCHIVE}, r AS (SELECT id, article_path, CASE WHEN id % 41 = 0 THEN replace(date, '-', '/') WHEN id % 43 = 0 THEN '2026-02-30' WHEN id % 47 = 0 THEN ' ' ELSE date END AS date, summary FROM archive)"""


def _rendered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, k = _archive(spark, sf_dir), F.col("id")
    date = F.when(k % 41 == 0, F.replace("date", F.lit("-"), F.lit("/"))).when(k % 43 == 0, "2026-02-30").when(k % 47 == 0, " ").otherwise(F.col("date"))
    return rows.select("id", "article_path", date.alias("date"), "summary"), rows.filter(k % 29 != 0).select(F.col("article_path").alias("name"))


@query(f"""{_RENDERED} SELECT CAST(id AS VARCHAR) AS subject, 'missing_page' AS rule, 'error' AS severity, article_path AS detail FROM r WHERE id % 29 = 0
UNION ALL SELECT CAST(id AS VARCHAR), 'malformed_date', 'error', date FROM r WHERE id % 41 = 0 OR id % 43 = 0 UNION ALL SELECT CAST(id AS VARCHAR), 'blank_date', 'warning', NULL FROM r WHERE date = ' '
UNION ALL SELECT CAST(id AS VARCHAR), 'blank_summary', 'error', NULL FROM r WHERE trim(summary) = ''""")
def output_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.output_findings(*_rendered(spark, sf_dir))


@query(f"""{_RENDERED}, f AS (SELECT CAST(id AS VARCHAR) AS subject, unnest([CASE WHEN id % 29 = 0 THEN 'missing_page' END, CASE WHEN id % 41 = 0 OR id % 43 = 0 THEN 'malformed_date' END, CASE WHEN date = ' ' THEN 'blank_date' END, CASE WHEN trim(summary) = '' THEN 'blank_summary' END]) AS rule FROM r)
SELECT rule, CASE rule WHEN 'blank_date' THEN 'warning' ELSE 'error' END AS severity, count(*) AS n, (list(subject ORDER BY subject))[:10] AS subjects FROM f WHERE rule IS NOT NULL GROUP BY 1""")
def output_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.summary(findings.output_findings(*_rendered(spark, sf_dir)))


@query(f"""WITH {EDITIONS}, e AS (SELECT date, n_articles AS n, CASE WHEN n_articles % 6 = 0 THEN date - 5 ELSE date - 6 END AS ws, CASE WHEN n_articles % 8 = 0 THEN date - 1 ELSE date END AS we, row_number() OVER (ORDER BY date) AS k FROM editions),
i AS (SELECT *, CASE WHEN n % 9 = 0 THEN NULL WHEN n % 10 = 0 THEN 1 ELSE k END AS issue FROM e), l AS (SELECT date, issue, lag(issue) OVER (ORDER BY date) AS last FROM i WHERE issue IS NOT NULL),
f AS (SELECT date, unnest([CASE WHEN n % 4 = 0 THEN {{'r': 'missing_field', 's': 'error', 'd': 'dek'}} END, CASE WHEN we <> date THEN {{'r': 'date_is_not_week_ending', 's': 'error', 'd': CAST(we AS VARCHAR)}} END, CASE WHEN we - ws <> 6 THEN {{'r': 'span', 's': CASE WHEN n % 12 = 0 THEN 'warning' ELSE 'error' END, 'd': CAST(we - ws AS VARCHAR)}} END,
  CASE WHEN n % 7 = 0 THEN {{'r': 'trail_entry', 's': 'error', 'd': '0: url'}} END, CASE WHEN n % 5 = 0 THEN {{'r': 'undated_trail', 's': 'warning', 'd': '1/1'}} END, CASE WHEN n % 5 <> 0 AND date + 1 > we AND n % 3 = 0 THEN {{'r': 'trail_outside_week', 's': 'warning', 'd': '0: ' || (date + 1)}} WHEN n % 5 <> 0 AND n % 3 <> 0 AND date > we THEN {{'r': 'trail_outside_week', 's': 'warning', 'd': '0: ' || date}} END,
  CASE WHEN n % 11 = 0 THEN {{'r': 'trail_without_flag', 's': 'warning', 'd': NULL}} END, CASE WHEN n % 13 = 0 THEN {{'r': 'no_body', 's': 'error', 'd': NULL}} END, CASE WHEN n % 14 = 0 THEN {{'r': 'no_page', 's': 'error', 'd': NULL}} END, CASE WHEN issue IS NULL THEN {{'r': 'no_issue', 's': 'warning', 'd': NULL}} END]) AS f FROM i)
SELECT date || '.json' AS subject, f.r AS rule, f.s AS severity, f.d AS detail FROM f WHERE f IS NOT NULL UNION ALL SELECT (date + 1) || '.html', 'no_sidecar', 'error', NULL FROM e WHERE n % 15 = 0
UNION ALL SELECT min(date) || '.json', 'repeated_issue', 'error', CAST(issue AS VARCHAR) FROM i WHERE issue IS NOT NULL GROUP BY issue HAVING count(*) > 1 UNION ALL SELECT date || '.json', 'issue_order', 'error', issue || ' after ' || last FROM l WHERE issue < last""")
def edition_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly editions as sidecars, each rule broken in some of them."""
    n, date = F.col("n_articles"), F.col("date")
    rows = numbered(editions(spark, sf_dir).withColumn("id", F.unix_date("date")), into="k")
    day = F.when(n % 5 != 0, F.when(n % 3 == 0, F.date_add(date, 1)).otherwise(date).cast("string"))
    entry = F.struct(F.lit("t").alias("title"), F.when(n % 7 != 0, "u").alias("url"), F.lit("s").alias("source"), day.alias("date"), (n % 11 != 0).alias("is_significant"))
    text = F.to_json(
        F.struct(
            date.cast("string").alias("date"), F.when(n % 8 == 0, F.date_sub(date, 1)).otherwise(date).cast("string").alias("week_ending"), F.when(n % 6 == 0, F.date_sub(date, 5)).otherwise(F.date_sub(date, 6)).cast("string").alias("week_start"),
            F.lit("T").alias("title"), F.when(n % 4 != 0, "D").alias("dek"), (n + 1).alias("n_articles"), F.lit(1).alias("n_significant"), F.lit("weekly").alias("edition_type"), F.array(entry).alias("source_trail"),
            F.when(n % 12 == 0, "Pilot").alias("edition_label"), F.when(n % 13 != 0, "text").alias("what_stood_out"), F.when(n % 9 == 0, F.lit(None)).when(n % 10 == 0, 1).otherwise(F.col("k")).alias("issue_number"),
        )
    )
    html = lambda d: F.concat(d.cast("string"), F.lit(".html")).alias("name")
    files = rows.filter(n % 14 != 0).select(html(date)).union(rows.filter(n % 15 == 0).select(html(F.date_add(date, 1))))
    return findings.edition_findings(rows.select(F.concat(date.cast("string"), F.lit(".json")).alias("name"), text.alias("text")), files)


@query("""WITH p AS (SELECT page_id AS k, CASE WHEN page_id % 2 = 0 THEN 'article/' ELSE '' END || page_id || '.html' AS page FROM pages), q AS (SELECT * FROM p WHERE k % 3 = 0)
SELECT page AS subject, 'asset_missing' AS rule, 'error' AS severity, CASE WHEN k % 2 = 0 THEN '../' ELSE '' END || 'assets/editorial/' || k || '.jpg' AS detail FROM p WHERE k % 5 = 0
UNION ALL SELECT page, 'unknown_picture', 'error', 'p' || k FROM q WHERE k % 7 = 0 UNION ALL SELECT page, 'no_credit', 'error', 'p' || k FROM q WHERE k % 7 <> 0 AND k % 4 = 0 UNION ALL SELECT page, 'no_aria_label', 'error', 'p' || k FROM q WHERE k % 7 <> 0 AND k % 8 = 0
UNION ALL SELECT page, 'no_context', 'error', 'p' || k FROM q WHERE k % 7 <> 0 AND k % 9 = 0 UNION ALL SELECT page, 'no_article_url', 'error', 'p' || k FROM q WHERE k % 7 <> 0 AND k % 2 = 0 AND k % 10 = 0
UNION ALL SELECT 'p' || k, 'derivative_missing', 'error', 'assets/editorial/derivatives/p' || k || '-duo-paper.jpg' FROM q WHERE k % 7 <> 0 AND k % 11 = 0 UNION ALL SELECT page, 'retired_pattern', 'error', 'hero-figure' FROM p WHERE k % 17 = 0""")
def image_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with editorial pictures, each rule broken in some of them."""
    k = F.col("page_id")
    key = k.cast("string")
    pick = lambda test, x: F.when(test, x).otherwise("")
    tag = F.concat(F.lit('<i data-editorial-id="p'), key, F.lit('"'), pick(k % 8 != 0, ' aria-label="picture"'), F.lit(">"), pick(k % 4 != 0, F.concat(F.lit("http://credit/"), key)), pick(k % 9 != 0, " This is not evidence. "), pick(k % 10 != 0, F.concat(F.lit("http://article/"), key)))
    asset = F.concat(F.lit('<img src="'), pick(k % 2 == 0, "../"), F.lit("assets/editorial/"), key, F.lit('.jpg">'))
    name = F.concat(pick(k % 2 == 0, "article/"), key, F.lit(".html"))
    pages = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.concat("html", pick(k % 3 == 0, tag), asset, pick(k % 17 == 0, '<b class="hero-figure">')).alias("text"))
    shown = pages.filter((k % 3 == 0) & (k % 7 != 0))
    entry = [F.concat(F.lit("p"), key).alias("id"), F.lit(None).cast("string").alias("file"), F.concat(F.lit("http://credit/"), key).alias("source_page"), F.lit("veil").alias("treatment"), F.array(F.lit("home")).alias("routes"), F.array(F.concat(F.lit("http://article/"), key)).alias("article_urls")]
    files = pages.filter(k % 5 != 0).select(F.concat(F.lit("assets/editorial/"), key, F.lit(".jpg")).alias("name"))
    files = files.union(shown.filter(k % 11 != 0).select(F.concat(F.lit("assets/editorial/derivatives/p"), key, F.lit("-duo-paper.jpg"))))
    return findings.image_findings(pages.drop("page_id"), shown.select(*entry), files)


@query("""WITH c AS (SELECT c_custkey AS k, 'm' || c_custkey AS m FROM customer), f AS (SELECT k, m, unnest([CASE WHEN k % 5 = 0 THEN {'s': ':desk', 'r': 'not_permitted', 'd': 'public_status=open'} END, CASE WHEN k % 7 = 0 THEN {'s': ':desk', 'r': 'missing_field', 'd': 'display_name'} END,
  CASE WHEN k % 11 = 0 THEN {'s': ':institutions[0]', 'r': 'unknown_parent', 'd': 'nowhere'} END, CASE WHEN k % 13 = 0 THEN {'s': ':sources[0]', 'r': 'unknown_institution', 'd': 'i0'} END, CASE WHEN k % 17 = 0 THEN {'s': ':sources[0]', 'r': 'language_tag', 'd': 'zh_CN'} WHEN k % 19 = 0 THEN {'s': ':sources[0]', 'r': 'undeclared_language', 'd': 'fr'} END,
  CASE WHEN k % 23 = 0 THEN {'s': ':sources[0]', 'r': 'cadence', 'd': NULL} END, CASE WHEN k % 29 = 0 THEN {'s': ':sources[0]', 'r': 'not_permitted', 'd': 'authority_tier=E'} END]) AS f FROM c),
r AS (SELECT m, row_number() OVER (PARTITION BY k % 1000 ORDER BY m || ':sources[0]') AS n, 's' || (k % 1000) AS slug FROM c)
SELECT m || f.s AS subject, f.r AS rule, 'error' AS severity, f.d AS detail FROM f WHERE f IS NOT NULL UNION ALL SELECT m || ':sources[0]', 'repeated_slug', 'error', slug FROM r WHERE n > 1""")
def manifest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A desk manifest for each customer, each rule broken in some of them."""
    k = F.col("c_custkey")
    key = k.cast("string")
    desk = F.struct(
        F.concat(F.lit("d"), key).alias("desk_id"), F.when(k % 7 != 0, F.col("c_name")).otherwise(" ").alias("display_name"), F.lit("X").alias("jurisdiction_code"), F.lit("UTC").alias("default_timezone"),
        F.when(k % 5 == 0, "open").otherwise("public").alias("public_status"), F.array(F.lit("en"), F.lit("zh-Hans")).alias("supported_language_tags"),
    )
    institution = F.struct(F.lit("i1").alias("institution_id"), F.lit("I").alias("display_name"), F.lit("other").alias("institution_type"), F.when(k % 11 == 0, "nowhere").alias("parent_institution_id"))
    source = F.struct(
        F.concat(F.lit("s"), (k % 1000).cast("string")).alias("slug"), F.when(k % 13 == 0, "i0").otherwise("i1").alias("institution_id"), F.col("c_name").alias("display_name"), F.lit("u").alias("base_url"),
        F.when(k % 17 == 0, "zh_CN").when(k % 19 == 0, "fr").otherwise("en").alias("language_tag"), F.lit("rss").alias("access_method"), F.when(k % 29 == 0, "E").otherwise("A").alias("authority_tier"),
        F.lit("news").alias("source_type"), F.lit("mirror").alias("originality"), F.when(k % 23 == 0, -1).otherwise(2).alias("expected_cadence_days"),
    )
    text = F.to_json(F.struct(desk.alias("desk"), F.array(institution).alias("institutions"), F.array(source).alias("sources")))
    return findings.manifest_findings(spread(table(spark, sf_dir, "customer"), "c_custkey").select(F.concat(F.lit("m"), key).alias("name"), text.alias("text")))


@query("""WITH s AS (SELECT lang AS label, CAST(sum(length(text)) AS BIGINT) AS chars, CASE WHEN lang = 'en' THEN 'small' ELSE 'large' END AS model, CASE WHEN lang = 'en' THEN 0.1::DOUBLE ELSE 1.3::DOUBLE END AS ratio FROM documents WHERE lang IS NOT NULL GROUP BY 1)
SELECT label, model, chars AS input_tokens, CAST(floor(chars * ratio) AS BIGINT) AS output_tokens, round(chars / 1e6 * CASE model WHEN 'small' THEN 1 ELSE 3 END + chars * ratio / 1e6 * CASE model WHEN 'small' THEN 5 ELSE 15 END, 6) AS total_usd FROM s""")
def spend_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by language as stages of two models."""
    small = F.col("label") == "en"
    stages = table(spark, sf_dir, "documents").filter("lang is not null").groupBy(F.col("lang").alias("label")).agg(F.sum(F.length("text")).alias("input_chars"))
    stages = stages.withColumns({"model": F.when(small, "small").otherwise("large"), "output_ratio": F.when(small, 0.1).otherwise(1.3)})
    prices = spark.createDataFrame([("small", 1.0, 5.0), ("large", 3.0, 15.0)], "model string, input double, output double")
    return findings.spend(stages, prices).select("label", "model", "input_tokens", "output_tokens", F.round("total_usd", 6).alias("total_usd"))


@query("SELECT 'partially_applied' AS state, ['5', '6'] AS missing FROM region HAVING count(*) = 5")
def store_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region's keys as the migrations of a ledger that should have seven."""
    ledger = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("version"))
    return findings.currency(spark, [*findings.CORE_TABLES, "region"], ledger, [str(k) for k in range(7)])


@query(f"""{w('articles', 'sources', 'runs')}, c AS (SELECT a.*, CASE WHEN passed_relevance IS NULL THEN 'awaiting_screening' WHEN NOT passed_relevance THEN 'not_selected' WHEN analyzed_at IS NULL THEN 'analysis_incomplete' ELSE 'analyzed' END AS state, display_name AS source_name, institution_id AS institution,
  CASE WHEN analyzed_at IS NOT NULL THEN 'm' END AS model_id, CASE WHEN a.id % 9 <> 0 THEN 'v1' END AS prompt_version FROM articles a LEFT JOIN sources s ON a.source_id = s.id),
i AS (SELECT CAST(institution AS VARCHAR) AS institution, count(*) AS n FROM c WHERE institution IS NOT NULL GROUP BY 1), d AS (SELECT DISTINCT CAST(started_at AS DATE) AS a FROM runs WHERE id % 9 > 1), g AS (SELECT a + 1 AS f, lead(a) OVER (ORDER BY a) - 1 AS t FROM d)
SELECT count(*) AS total, max(id) AS max_id, count(*) FILTER (state = 'awaiting_screening') AS awaiting_screening, count(*) FILTER (state = 'analysis_incomplete') AS analysis_incomplete, count(*) FILTER (state = 'not_selected') AS not_selected, count(*) FILTER (state = 'analyzed') AS analyzed,
  count(*) FILTER (state IN ('awaiting_screening', 'analysis_incomplete')) AS backlog, count(*) FILTER (trim(coalesce(title_english, '')) = '') AS no_english, count(*) FILTER (trim(coalesce(summary_english, '')) = '') AS no_summary, count(*) FILTER (model_id IS NULL) AS no_model, count(*) FILTER (state <> 'analyzed') AS non_analyzed, false AS english_sets_identical,
  count(*) FILTER (published_date BETWEEN DATE '1998-01-01' AND DATE '1998-03-01') AS outage_records, count(*) FILTER (trim(text_original) = '') AS empty_text, count(*) FILTER (state = 'analyzed' AND prompt_version IS NULL) AS prompt_version_missing, count(DISTINCT institution) AS institutions, count(DISTINCT source_name) AS outlets, min(published_date) AS first_date, max(published_date) AS last_date,
  (SELECT arg_min(institution, (-n, institution)) FROM i) AS top_institution, (SELECT max(n) FROM i) AS top_institution_count, round((SELECT max(n) FROM i) * 100 / count(*), 1) AS top_institution_pct,
  (SELECT min(f) FROM g WHERE t >= f + 1) AS gap_from, (SELECT arg_min(t, f) FROM g WHERE t >= f + 1) AS gap_to, (SELECT CAST(arg_min(t - f + 1, f) AS INTEGER) FROM g WHERE t >= f + 1) AS gap_days FROM c""")
def corpus_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = t.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("display_name").alias("source_name"), F.col("institution_id").cast("string").alias("institution"))
    passed, done = F.col("passed_relevance"), F.col("analyzed_at").isNotNull()
    state = F.when(passed.isNull(), "awaiting_screening").when(~passed, "not_selected").when(~done, "analysis_incomplete").otherwise("analyzed")
    rows = t.articles(spark, sf_dir).join(sources, "source_id", "left").withColumns({"state": state, "model_id": F.when(done, "m"), "prompt_version": F.when(F.col("id") % 9 != 0, "v1")})
    days = t.runs(spark, sf_dir).filter("id % 9 > 1").select(F.col("started_at").cast("date").alias("day"))
    return views.corpus_guide(rows, days, ("1998-01-01", "1998-03-01"))
