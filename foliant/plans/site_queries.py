"""Queries of the read models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import extraction, site, store, views
from foliant.operators import readout as daily
from foliant.plans import store as t
from foliant.plans.corpus import EDITIONS, editions
from foliant.plans.registry import query
from foliant.plans.store import with_tables as w
from foliant.sources.snapshots import table

_NAMED = "named AS (SELECT a.*, s.slug AS source_slug FROM articles a LEFT JOIN sources s ON a.source_id = s.id)"
_ISSUE = "contains(lower(coalesce(summary_english, '')), 'does not match')"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = t.sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"))
    return t.articles(spark, sf_dir).join(sources, "source_id", "left")


@query(f"{w('articles')} SELECT id, {_ISSUE} AS extraction_issue FROM articles")
def extraction_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.articles(spark, sf_dir).select("id", site.extraction_issue(F.col("summary_english")).alias("extraction_issue"))


@query(f"{w('articles')} SELECT id, CASE WHEN id % 10 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (id % 150 - 20) / 100)) END AS score, 1.0::DOUBLE AS plain FROM articles")
def default_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    error, score = F.when(F.col("id") % 10 == 0, "no answer"), (F.col("id") % 150 - 20) / 100
    return t.articles(spark, sf_dir).select("id", site.score_or_default(score, error, True).alias("score"), site.score_or_default(score, error, False).alias("plain"))


@query("SELECT p_partkey, list_filter(list_distinct_in_order, lambda c: c IN ('Brand#11', 'Brand#12', 'Brand#13')) AS kept FROM (SELECT p_partkey, CASE WHEN p_brand = 'Brand#12' THEN ['Brand#12', 'nowhere'] ELSE [p_brand, 'Brand#12', 'nowhere'] END AS list_distinct_in_order FROM part)")
def allowed_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.array("p_brand", F.lit("Brand#12"), F.lit("nowhere"), F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", site.allowed(given, ["Brand#11", "Brand#12", "Brand#13"]).alias("kept"))


@query(f"{w('articles')} SELECT id, url FROM articles WHERE published_date BETWEEN DATE '1999-05-25' AND DATE '1999-06-01' ORDER BY published_date DESC, url DESC LIMIT 40")
def collection_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bounded run of a desk: the cap is the operator's own."""
    return site.in_window(t.articles(spark, sf_dir), "1999-06-01", 7, 40, "published_date").select("id", "url")


@query(f"{w('articles', 'sources')}, {_NAMED}, c AS (SELECT source_slug, count(*) AS n FROM named WHERE analyzed_at IS NOT NULL GROUP BY 1) SELECT display_name AS name, CASE WHEN n > 0 THEN 'articles collected' ELSE 'nothing yet' END AS status, coalesce(n, 0) AS count FROM sources LEFT JOIN c ON slug = source_slug")
def source_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = t.sources(spark, sf_dir).select("slug", F.col("display_name").alias("name"), F.lit("nothing yet").alias("fallback"))
    return site.statuses(_named(spark, sf_dir).filter("analyzed_at is not null"), configured)


@query(f"""{w('articles')}, b AS (SELECT trim(coalesce(title_english, '')) = '' AS a, trim(coalesce(summary_english, '')) = '' AS b, analyzed_at IS NULL AS c FROM articles)
SELECT count(*) FILTER (a) AS n_blank_title_english, count(*) FILTER (b) AS n_blank_summary_english, count(*) FILTER (c) AS n_other, count(*) FILTER (a <> c OR b <> c) = 0 AS identical FROM b""")
def blank_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.blank_sets(t.articles(spark, sf_dir), ["title_english", "summary_english"], F.col("analyzed_at").isNull())


@query(f"""{w('articles', 'sources', 'article_categories')}, {_NAMED}, r AS (SELECT *, CAST(date_trunc('week', published_date) AS DATE) AS week FROM named WHERE analyzed_at IS NOT NULL),
c AS (SELECT week, category, count(*) AS n FROM r JOIN article_categories ON id = article_id GROUP BY 1, 2)
SELECT r.week, count(*) AS total, count(*) FILTER (is_significant) AS n_significant, list_sort(list(DISTINCT published_date)) AS dates, list_sort(list(DISTINCT source_slug)) AS sources, any_value(categories) AS categories
FROM r LEFT JOIN (SELECT week, list(category ORDER BY n DESC, category) AS categories FROM c GROUP BY 1) k ON r.week = k.week GROUP BY 1""")
def week_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir).filter("analyzed_at is not null")
    return site.week_stats(rows, t.article_categories(spark, sf_dir), fx.monday(F.col("published_date")))


@query(f"{w('articles', 'article_categories')} SELECT category, count(*) AS n FROM article_categories JOIN articles ON id = article_id WHERE NOT {_ISSUE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def dominant_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.dominant(t.articles(spark, sf_dir), t.article_categories(spark, sf_dir))


@query(f"{w('articles', 'sources')}, {_NAMED} SELECT source_slug, count(*) AS n FROM named WHERE published_date BETWEEN DATE '2001-07-02' AND DATE '2001-08-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def source_mix_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit("2001-08-01").cast("date")
    return views.top_values(_named(spark, sf_dir).filter(F.col("published_date").between(F.date_sub(day, 30), day)), "source_slug", 10)


#: Five categories with a priority; the others come last.
_PRIORITY = {"Brand#11": 1, "Brand#23": 2, "Brand#35": 3, "Brand#44": 4, "Brand#52": 5}
_RANK = "CASE category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _PRIORITY.items()) + " ELSE 99 END"
_SHORT = "CASE WHEN coalesce(title_english, '') <> '' THEN title_english ELSE title_original END"
#: The parts of each day's readout by windows and sorted lists.
_READOUT = f"""{w('articles', 'sources', 'article_categories')}, {_NAMED}, k AS (SELECT article_id, list(category ORDER BY category) AS cats, min({_RANK}) AS rank, arg_min(category, ({_RANK}, category)) AS best FROM article_categories GROUP BY 1),
c AS (SELECT n.*, coalesce(cats, []) AS cats, best, coalesce(rank, 99) AS rank, NOT {_ISSUE} AS clean, NOT {_ISSUE} AND coalesce(is_significant, false) AS flagged, {_SHORT} AS short, row_number() OVER (PARTITION BY published_date ORDER BY coalesce(is_significant, false) DESC, coalesce(rank, 99), relevance_score DESC, id) AS place FROM named n LEFT JOIN k ON id = article_id WHERE analyzed_at IS NOT NULL),
g AS (SELECT published_date AS day, count(*) FILTER (clean) AS n_clean, count(*) FILTER (flagged) AS n_flagged, arg_min(id, place) FILTER (clean) AS lead, arg_min(short, place) FILTER (clean) AS lead_title, arg_min(cats, place) FILTER (clean) AS lead_categories, arg_min(coalesce(best, ''), place) FILTER (clean) AS lead_category,
  count(DISTINCT source_slug) FILTER (clean) AS n_names, min(source_slug) FILTER (clean) AS one, coalesce((list(short ORDER BY place) FILTER (flagged))[:2], []) AS mattered FROM c GROUP BY 1),
x AS (SELECT published_date AS day, flagged, unnest(cats) AS category FROM c WHERE clean),
y AS (SELECT day, category, count(*) AS a, count(*) FILTER (flagged) AS b, count(*) FILTER (NOT flagged) AS r FROM x GROUP BY 1, 2),
z AS (SELECT day, (list(category ORDER BY a DESC, category))[:3] AS dominant, coalesce((list(category ORDER BY b DESC, category) FILTER (b > 0))[:3], []) AS flagged_categories, coalesce((list(category ORDER BY r DESC, category) FILTER (r > 0))[:3], []) AS routine_categories FROM y GROUP BY 1),
readout AS (SELECT g.day, CASE WHEN n_clean = 0 THEN 'no_clean' WHEN n_flagged > 0 THEN 'flagged' ELSE 'routine' END AS branch, n_clean, n_flagged, lead, lead_title, lead_categories, nullif(lead_category, '') AS lead_category, CASE WHEN n_names = 1 THEN one END AS only_source, mattered, coalesce(dominant, []) AS dominant, coalesce(flagged_categories, []) AS flagged_categories, coalesce(routine_categories, []) AS routine_categories FROM g LEFT JOIN z ON g.day = z.day)"""


@query(f"{_READOUT} SELECT * FROM readout")
def daily_readout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir).filter("analyzed_at is not null")
    return daily.readout(rows, t.article_categories(spark, sf_dir), _PRIORITY)


_WORDING = {
    "overview.no_clean": "No clean text.", "overview.flagged": "{n} flagged item{s} on {pattern}.", "overview.routine": "Nothing flagged; mostly {pattern}.", "single": " All from {source}.",
    "pattern.flagged.none": "no theme", "pattern.routine.none": "the usual", "mattered.no_clean": "Nothing.", "mattered.routine": "{title}{labels}.", "mattered.labels": " ({labels})",
    "routine.no_clean": "Unknown.", "routine.flagged": "The rest: {pattern}.", "routine.flagged.none": "Little else.", "routine.routine": "Mostly {pattern}.", "watch": "Watch for repeats.",
}
_LABELS = {"Brand#11": "Eleven", "Brand#12": "Twelve"}
_WATCH = {"Brand#11": "Watch eleven.", "Brand#35": "Watch thirty-five."}
_LABEL = "array_to_string(list_transform({x}, lambda c: CASE c WHEN 'Brand#11' THEN 'Eleven' WHEN 'Brand#12' THEN 'Twelve' ELSE c END), ', ')"


def _or(x: str, none: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN {_LABEL.format(x=x)} ELSE '{none}' END"


@query(f"""{_READOUT}, s AS (SELECT *, CASE WHEN only_source IS NOT NULL THEN ' All from ' || only_source || '.' ELSE '' END AS single FROM readout)
SELECT day, CASE branch WHEN 'no_clean' THEN 'No clean text.' WHEN 'flagged' THEN n_flagged || ' flagged item' || CASE WHEN n_flagged = 1 THEN '' ELSE 's' END || ' on ' || {_or("flagged_categories", "no theme")} || '.' || single ELSE 'Nothing flagged; mostly ' || {_or("dominant", "the usual")} || '.' || single END AS overview,
CASE branch WHEN 'no_clean' THEN 'Nothing.' WHEN 'flagged' THEN array_to_string(mattered, '; ') ELSE lead_title || CASE WHEN len(lead_categories) > 0 THEN ' (' || {_LABEL.format(x="lead_categories")} || ')' ELSE '' END || '.' END AS what_mattered,
CASE branch WHEN 'no_clean' THEN 'Unknown.' WHEN 'flagged' THEN CASE WHEN len(routine_categories) > 0 THEN 'The rest: ' || {_LABEL.format(x="routine_categories")} || '.' ELSE 'Little else.' END ELSE 'Mostly ' || {_or("dominant", "the usual")} || '.' END AS what_was_routine,
CASE lead_category WHEN 'Brand#11' THEN 'Watch eleven.' WHEN 'Brand#35' THEN 'Watch thirty-five.' ELSE 'Watch for repeats.' END AS what_to_watch FROM s""")
def readout_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.texts(daily_readout(spark, sf_dir), _WORDING, _LABELS, _WATCH)


@query(f"""{_READOUT}, d AS (SELECT max(published_date) AS day FROM c), l AS (SELECT c.* FROM c JOIN d ON published_date = day),
st AS (SELECT list(display_name || '|' || CASE WHEN n > 0 THEN 'articles collected' ELSE 'nothing yet' END || '|' || coalesce(n, 0) ORDER BY display_name) AS statuses FROM sources LEFT JOIN (SELECT source_slug, count(*) AS n FROM l GROUP BY 1) ON slug = source_slug),
rs AS (SELECT list(id ORDER BY k) AS recent_signals FROM (SELECT id, row_number() OVER (ORDER BY published_date DESC, relevance_score DESC, id) AS k FROM c WHERE flagged) WHERE k <= 3)
SELECT r.*, n, n_significant, n_sources, ids, statuses, recent_signals FROM (SELECT published_date AS day, count(*) AS n, count(*) FILTER (is_significant) AS n_significant, count(DISTINCT source_slug) AS n_sources, list(id ORDER BY place) AS ids FROM l GROUP BY 1) JOIN readout r USING (day), st, rs""")
def daily_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = t.sources(spark, sf_dir).select("slug", F.col("display_name").alias("name"), F.lit("nothing yet").alias("fallback"))
    found = daily.brief(_named(spark, sf_dir).filter("analyzed_at is not null"), t.article_categories(spark, sf_dir), _PRIORITY, configured)
    return found.withColumn("statuses", F.transform("statuses", lambda s: F.concat_ws("|", s["name"], s["status"], s["count"].cast("string"))))


@query(f"""{w('articles', 'sources')}, {_NAMED} SELECT id, coalesce(title_english, '') AS title_en, title_original AS title_zh, coalesce(summary_english, '') AS summary, CAST(published_date AS VARCHAR) AS date, strftime(published_date, '%-d %B %Y') AS date_fmt,
coalesce(source_slug, '') AS source, coalesce(is_significant, false) AS is_significant, round(relevance_score, 2) AS relevance_score, url, 'article/' || id || '.html' AS article_path, {_ISSUE} AS extraction_issue FROM named WHERE analyzed_at IS NOT NULL""")
def archive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.archive_rows(_named(spark, sf_dir).filter("analyzed_at is not null"))


@query(f"{w('articles')} SELECT id, published_date FROM articles WHERE is_significant AND NOT {_ISSUE} ORDER BY published_date DESC, relevance_score DESC, id LIMIT 6")
def recent_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.recent_signals(t.articles(spark, sf_dir), 6).select("id", "published_date")


@query(f"{w('articles')} SELECT 'https://site.example/article/' || id || '.html?a=1&amp;b=2' AS loc FROM articles WHERE analyzed_at IS NOT NULL")
def sitemap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir).filter("analyzed_at is not null")
    return site.feed_rows(rows, "https://site.example/article/", F.concat(F.col("id").cast("string"), F.lit(".html?a=1&b=2")))


@query(f"{w('articles')} SELECT 'article/' || id || '.html' AS old_path, 'record/' || id || '/' AS new_path FROM articles")
def legacy_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id").cast("string")
    return site.redirects(t.articles(spark, sf_dir), F.concat(F.lit("article/"), key, F.lit(".html")), F.concat(F.lit("record/"), key, F.lit("/")))


_PICTURES = "pictures AS (SELECT 'http://s' || (p_partkey * 3 % 50) || '.example/n' || (p_partkey * 3) AS url, p_size AS position, p_name || '-' || p_partkey AS picture FROM part)"


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey") * 3
    url = F.concat(F.lit("http://s"), (key % 50).cast("string"), F.lit(".example/n"), key.cast("string"))
    return table(spark, sf_dir, "part").select(url.alias("url"), F.col("p_size").alias("position"), F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string")).alias("picture"))


@query(f"{w('articles')}, {_PICTURES} SELECT id, url, picture FROM (SELECT id, url, published_date, (SELECT arg_min(picture, position) FROM pictures p WHERE p.url = a.url) AS picture FROM articles a WHERE is_significant AND published_date BETWEEN DATE '1996-05-01' AND DATE '1999-05-01') WHERE picture IS NOT NULL ORDER BY published_date DESC, id DESC LIMIT 1")
def lead_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir)
    return site.lead_picture(rows, _pictures(spark, sf_dir), "1999-05-01", 1095)


@query("WITH e AS (SELECT p_brand, p_partkey AS position, p_name FROM part) SELECT p_brand, arg_min(position, position) AS position, arg_min(p_name, position) AS p_name FROM e WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 25) GROUP BY 1")
def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return site.first_match(parts.select("p_brand", F.col("p_partkey").alias("position"), "p_name"), parts.filter("p_size > 25"), "p_brand", "position")


@query("WITH e AS (SELECT p_partkey AS entry, unnest([p_brand, p_type]) AS route, ['u' || (p_partkey % 50), 'u' || (p_partkey % 7)] AS urls FROM part), f AS (SELECT DISTINCT entry, route, unnest(urls) AS url FROM e) SELECT entry, route, url FROM f WHERE (route, url) IN (SELECT (p_brand, 'u' || (p_size % 9)) FROM part)")
def routed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    u = lambda c: F.concat(F.lit("u"), c.cast("string"))
    entries = parts.select(F.col("p_partkey").alias("id"), F.array("p_brand", "p_type").alias("routes"), F.array(u(F.col("p_partkey") % 50), u(F.col("p_partkey") % 7)).alias("article_urls"))
    return site.routed(entries, parts.select(F.col("p_brand").alias("route"), u(F.col("p_size") % 9).alias("url"))).select("entry", "route", "url")


@query(f"{w('articles')}, g AS (SELECT id AS position, CASE WHEN id % 10 = 0 THEN '' ELSE 'g' || (id % 700) END AS g, relevance_score FROM articles) SELECT position FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY relevance_score DESC, position DESC) AS k FROM g) WHERE k = 1 OR g = ''")
def kept_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir).select(F.col("id").alias("position"), F.when(F.col("id") % 10 == 0, "").otherwise(F.concat(F.lit("g"), (F.col("id") % 700).cast("string"))).alias("g"), "relevance_score")
    return site.kept_in_order(rows, "g", F.col("relevance_score")).select("position")


@query("WITH f AS (SELECT l_orderkey AS g, lower(l_returnflag || l_suppkey % 40) AS low, arg_min(l_returnflag || l_suppkey % 40, l_linenumber) AS v, min(l_linenumber) AS position FROM lineitem GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY g ORDER BY position, low) AS INTEGER) AS place FROM f) SELECT g, v, position, place FROM r WHERE place <= 3")
def distinct_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat("l_returnflag", (F.col("l_suppkey") % 40).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("g"), value.alias("v"), F.col("l_linenumber").alias("position"))
    return site.distinct_in_order(rows, "g", "v", cap=3)


@query("""WITH c AS (SELECT p_brand AS article, p_name || ' ' || p_partkey AS title, CASE p_partkey % 5 WHEN 0 THEN 'Public domain' WHEN 1 THEN 'CC BY-SA 4.0' WHEN 2 THEN 'CC BY 4.0' ELSE 'unknown' END AS licence, p_size * 50 AS width, 700 AS height, p_partkey % 8 AS overlap, p_partkey % 11 = 0 AS inst, p_partkey % 13 = 0 AS low FROM part),
s AS (SELECT article, title, CAST(CASE WHEN licence = 'Public domain' THEN 4 WHEN licence LIKE 'CC BY-SA%' THEN 2 WHEN licence LIKE 'CC BY%' THEN 3 ELSE 0 END + CASE WHEN width >= 1600 THEN 3 WHEN width >= 1200 THEN 2 WHEN width >= 800 THEN 1 ELSE 0 END
+ CASE WHEN width >= height THEN 2 WHEN width / height >= 0.85 THEN 1 ELSE 0 END + least(overlap, 5) + CASE WHEN inst THEN 1.5 ELSE 0 END - CASE WHEN low THEN 1 ELSE 0 END AS DOUBLE) AS score FROM c)
SELECT article, title, score FROM (SELECT *, row_number() OVER (PARTITION BY article ORDER BY score DESC, title) AS k FROM s) WHERE k = 1 AND score >= 6""")
def best_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, width = F.col("p_partkey"), F.col("p_size") * 50
    licence = F.when(key % 5 == 0, "Public domain").when(key % 5 == 1, "CC BY-SA 4.0").when(key % 5 == 2, "CC BY 4.0").otherwise("unknown")
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("article"), F.concat("p_name", F.lit(" "), key.cast("string")).alias("title"), licence.alias("licence"), width.alias("width"), key.alias("key"))
    score = site.media_score(F.col("licence"), F.col("width"), F.lit(700), F.col("key") % 8, F.col("key") % 11 == 0, F.col("key") % 13 == 0)
    return site.best_media(rows, "article", score)


@query(f"{w('articles')} SELECT id, id % 3 = 0 AS foreign FROM articles")
def foreign_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    image = F.concat(F.lit("http://img.example/"), F.when(key % 3 == 0, key + 1).otherwise(key).cast("string"), F.lit("_1.jpg"))
    return t.articles(spark, sf_dir).select("id", site.foreign_asset(F.col("url"), image, "/n(\\d+)$", "/(\\d+)_").alias("foreign"))


@query(f"{w('articles')} SELECT published_date, count(*) FILTER (is_significant) AS k, count(*) AS n, (SELECT count(*) FILTER (is_significant) FROM articles) AS k_all, (SELECT count(*) FROM articles) AS n_all FROM articles GROUP BY 1")
def archive_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.grouped_counts(t.articles(spark, sf_dir), F.col("is_significant"))


#: The key of a URL, from its rule: trimmed, in lower case, without scheme, then without www. or else without last slashes.
_KEY = "CASE WHEN regexp_matches(lower(trim({u})), '^(https?://)?www\\.') THEN regexp_replace(lower(trim({u})), '^(https?://)?www\\.', '') ELSE rtrim(regexp_replace(lower(trim({u})), '^https?://', ''), '/') END"
_TRAILS = """trails AS (SELECT CAST(date_trunc('week', published_date) AS DATE) AS date, list(source_slug ORDER BY id) AS names, list(CASE WHEN id % 2 = 0 THEN ' HTTPS://' || upper(substr(url, 8)) || '/' ELSE 'https://www.' || substr(url, 8) || '/' END ORDER BY id) AS urls FROM named WHERE is_significant GROUP BY 1)"""


def _trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(spark, sf_dir).filter("is_significant")
    rest = F.substr("url", F.lit(8))
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" HTTPS://"), F.upper(rest), F.lit("/"))).otherwise(F.concat(F.lit("https://www."), rest, F.lit("/")))
    entry = F.struct("id", F.col("source_slug").alias("source"), url.alias("url"))
    return rows.groupBy(fx.monday(F.col("published_date")).alias("date")).agg(F.array_sort(F.collect_list(entry)).alias("source_trail"))


@query(f"{w('articles', 'sources')}, {_NAMED}, {_TRAILS}, f AS (SELECT date, s, min(k) AS k FROM (SELECT date, unnest(names) AS s, generate_subscripts(names, 1) AS k FROM trails) GROUP BY 1, 2) SELECT date, list(s ORDER BY k) AS sources, CAST(count(*) AS INTEGER) AS n_sources FROM f GROUP BY 1")
def edition_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site.edition_sources(_trails(spark, sf_dir))


@query(f"{w('articles', 'sources')}, {_NAMED}, {_TRAILS}, u AS (SELECT date, unnest(urls) AS url FROM trails) SELECT date, u.url, id FROM u LEFT JOIN articles a ON {_KEY.format(u="u.url")} = {_KEY.format(u="a.url")}")
def edition_trail_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """www. URLs keep their last slash in the key, so that they match no article; the others do, in any case."""
    return site.trail_matches(_trails(spark, sf_dir), t.articles(spark, sf_dir))


@query(f"WITH {EDITIONS}, i AS (SELECT date, CASE WHEN n_articles % 7 = 0 THEN 1 ELSE row_number() OVER (ORDER BY date) END AS issue_number FROM editions), l AS (SELECT *, lag(issue_number) OVER (ORDER BY date) AS previous_issue FROM i) SELECT * FROM l WHERE issue_number <= previous_issue")
def issue_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.edition_sequence(editions(spark, sf_dir))
    issue = F.when(F.col("n_articles") % 7 == 0, 1).otherwise(F.col("issue"))
    return site.broken_sequence(rows.select("date", issue.cast("long").alias("issue_number")))


@query(f"WITH {EDITIONS} SELECT 'term ' || n_articles AS term, 'of ' || date AS explanation, date FROM editions WHERE n_articles % 3 <> 0 ORDER BY date DESC")
def term_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_articles")
    term = F.when(n % 3 != 0, F.concat(F.lit("term "), n.cast("string"))).otherwise(" ")
    return site.glossary(editions(spark, sf_dir), term, F.concat(F.lit("of "), F.col("date").cast("string")))


@query("WITH r AS (SELECT DISTINCT page_id AS id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS ref FROM pages) SELECT id, ref FROM r WHERE ref NOT IN (SELECT ref FROM r WHERE id % 2 = 0)")
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    pattern = 'href="([^"]+)"'
    known = pages.filter("id % 2 = 0").select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("ref"))
    return site.missing_references(pages, pattern, known)


@query(f"{w('articles')} SELECT unnest(['count', 'date', 'arity', 'code']) AS rule, unnest([0, 0, count(*) FILTER (id % 50 = 0), count(*) FILTER (id % 30 >= 29)]) AS violations FROM articles")
def index_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir).select(F.col("published_date").alias("date"), F.when(F.col("id") % 50 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("row"), (F.col("id") % 30).alias("code"))
    return site.index_check(rows, t.articles(spark, sf_dir).count(), "2001-08-01", 2, {"code": 29})


@query(f"""{w('sources', 'results', 'articles')}, h AS (SELECT slug, (SELECT count(*) FROM articles WHERE source_id = s.id) AS n, (SELECT max(completed_at) FROM results r WHERE r.source_slug = slug AND NOT is_failure) AS last_ok, (SELECT arg_max(status, (scrape_run_id, id)) FROM results r WHERE r.source_slug = slug) AS status FROM sources s)
SELECT slug AS source_slug, slug || ' | ' || coalesce(status, 'no result') || ' | last success ' || coalesce(CAST(DATE '2024-02-10' - CAST(last_ok AS DATE) AS VARCHAR) || ' days ago', 'never') || ' | ' || format('{{:,}}', n) || ' articles' AS line FROM h""")
def health_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = store.latest_results(t.results(spark, sf_dir), t.articles(spark, sf_dir), t.sources(spark, sf_dir))
    return site.health_lines(health, "2024-02-10")


@query("""SELECT page_id, CASE WHEN h <> '' THEN lower(split_part(u, '://', 1)) || '://' || lower(h) || p ELSE p END AS normal, h AS domain FROM (SELECT page_id, url AS u, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h, regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') AS p FROM pages)""")
def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", fx.url_normal(url).alias("normal"), fx.url_domain(url).alias("domain"))


@query(f"""WITH {EDITIONS}, e AS (SELECT date - 5 AS a, CASE WHEN n_articles % 5 = 0 THEN date - 5 WHEN n_articles % 5 = 1 THEN date + 300 ELSE date END AS b, n_articles FROM editions)
SELECT a, n_articles, strftime(a, '%-d %B %Y') AS reader, strftime(a, '%B %-d, %Y') AS american, CASE WHEN a = b THEN strftime(a, '%B %-d, %Y') WHEN strftime(a, '%Y-%m') = strftime(b, '%Y-%m') THEN strftime(a, '%B %-d') || '–' || strftime(b, '%-d, %Y')
WHEN year(a) = year(b) THEN strftime(a, '%b %-d') || '–' || strftime(b, '%b %-d, %Y') ELSE strftime(a, '%b %-d %Y') || '–' || strftime(b, '%b %-d %Y') END AS span,
CASE WHEN n_articles % 6 < 4 THEN 'Thin week · ' || CASE WHEN n_articles % 2 = 0 THEN 'significant' ELSE 'routine' END WHEN n_articles % 2 = 0 THEN 'Significant' ELSE 'Routine' END AS label, format('{{:,}}', n_articles * 1000) AS figure FROM e""")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, day = F.col("n_articles"), F.col("date")
    rows = editions(spark, sf_dir).select(F.date_sub(day, 5).alias("a"), F.when(n % 5 == 0, F.date_sub(day, 5)).when(n % 5 == 1, F.date_add(day, 300)).otherwise(day).alias("b"), "n_articles")
    a, kind = F.col("a"), F.when(n % 2 == 0, "significant").otherwise("routine")
    return rows.select(
        "a", "n_articles", fx.long_date(a).alias("reader"), fx.american_date(a).alias("american"), fx.date_range(a, F.col("b")).alias("span"),
        fx.edition_label(kind, n % 6).alias("label"), fx.thousands(n * 1000).alias("figure"),
    )


@query("""WITH k AS (SELECT p_partkey, 'https://x.example/latest-releases/' || (p_partkey % 28 + 1) || 'aug26-' || CASE p_partkey % 6 WHEN 0 THEN 'nr' WHEN 1 THEN 'speech' WHEN 2 THEN 'fs' WHEN 3 THEN 'mq2' WHEN 4 THEN 'pq' ELSE 'zz3' END || '/' AS url FROM part)
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'news release' WHEN 1 THEN 'speech' WHEN 2 THEN 'fact sheet' WHEN 3 THEN 'ministerial question' WHEN 4 THEN 'parliamentary question' ELSE 'other' END AS kind, make_date(2026, 8, CAST(p_partkey % 28 + 1 AS INTEGER)) AS day FROM k""")
def publication_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    names = ["nr", "speech", "fs", "mq2", "pq", "zz3"]
    slug = F.concat((key % 28 + 1).cast("string"), F.lit("aug26-"), F.element_at(F.array(*map(F.lit, names)), (key % 6 + 1).cast("int")))
    url = F.concat(F.lit("https://x.example/latest-releases/"), slug, F.lit("/"))
    return table(spark, sf_dir, "part").select("p_partkey", fx.publication_kind(url).alias("kind"), fx.slug_date(slug).alias("day"))


#: Titles in DuckDB: the first line of a text in one line.
_LINE = "trim(regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, {_LINE} AS x FROM documents) SELECT doc_id, CASE WHEN x = '' THEN 'Untitled' WHEN length(x) <= 40 THEN x ELSE regexp_replace(regexp_replace(substr(x, 1, 40), ' [^ ]*$', ''), '[,;: ]+$', '') || '…' END AS title,
list_filter(string_split(trim(regexp_replace(lower(x), '[^\\w''À-ɏ-]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'was')) AS tokens, CAST(len(list_filter(string_split(x, ' '), lambda w: w <> '')) AS INTEGER) AS n_words FROM d""")
def title_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = fx.collapse(F.element_at(F.split("text", "\n"), 1))
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.short_title(F.lit(None).cast("string"), x, 40).alias("title"), fx.tokens(x, ["the", "and", "was"]).alias("tokens"), fx.n_words(x).alias("n_words")
    )


@query("SELECT event_id, ['k' || json_extract_string(props, '$.k'), 'two', CAST(event_type AS VARCHAR)] AS strings FROM events")
def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"props": '), F.replace("props", F.lit(": "), F.lit(': "k')), F.lit(', "d": [{"b": "two", "c": 3}], "e": "'), "event_type", F.lit('"}'))
    text = F.replace(text, F.lit("}, "), F.lit('"}, '))
    return table(spark, sf_dir, "events").select("event_id", fx.json_strings(text).alias("strings"))


_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
_RUNGS = [("article", "(?is)<article>(.*)</article>", "(?is)<p>([^<]*)</p>", 400), ("long", "", "(?is)<p>([^<]*)</p>", 60), ("any", "", "(?is)<p>([^<]*)", 1)]


def _rung(name: str, container: str, paragraph: str, least: int) -> str:
    inside = f"regexp_extract(page, '{container}', 1)" if container else "page"
    texts = f"list_transform(regexp_extract_all({inside}, '{paragraph}', 1), lambda x: {_PLAIN.format(x='x')})"
    return f"array_to_string(list_filter({texts}, lambda x: length(x) >= {least} AND NOT contains(x, 'Copyright') AND NOT contains(x, 'thereon')), chr(10)) AS {name}_body"


@query(f"""WITH p AS (SELECT page_id, html, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS page FROM pages), b AS (SELECT *, {", ".join(_rung(*r) for r in _RUNGS)} FROM p)
SELECT page_id, nullif({_PLAIN.format(x="coalesce(nullif(regexp_extract(page, '(?is)<h2>(.*?)</h2>', 1), ''), regexp_extract(page, '(?is)<h1>(.*?)</h1>', 1))")}, '') AS title,
CASE WHEN article_body <> '' THEN 'article' WHEN long_body <> '' THEN 'long' WHEN any_body <> '' THEN 'any' END AS rung, CASE WHEN article_body <> '' THEN article_body WHEN long_body <> '' THEN long_body WHEN any_body <> '' THEN any_body END AS body,
regexp_extract(html, 'track\\((\\d+)\\)', 1) AS published FROM b""")
def ladder_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    titles = ["(?is)<h2>(.*?)</h2>", "(?is)<h1>(.*?)</h1>"]
    return extraction.by_ladder(pages, titles, _RUNGS, ["Copyright", "thereon"], "track\\((\\d+)\\)").drop("html")


@query("""SELECT o_custkey AS page_id, strftime(o_orderdate, '/%Y/%-m/%-d/n') || o_orderkey || '.html' AS href, CAST(o_orderdate AS DATE) AS day, 'Item ' || o_orderkey AS label FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1999-05-26' AND DATE '1999-06-01'""")
def listing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, key = F.col("o_orderdate").cast("date"), F.col("o_orderkey").cast("string")
    address = F.concat(F.date_format(day, "/yyyy/M/d/'n'"), key, F.lit(".html"))
    anchors = F.concat(F.lit('<a href="'), address, F.lit('"> </a><a href="'), address, F.lit('"><b>Item</b> '), key, F.lit("</a>"))
    pages = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.collect_list(anchors), "\n").alias("html"))
    return extraction.dated_links(pages, "^/(\\d{4})/(\\d{1,2})/(\\d{1,2})/", "1999-06-01")
