"""Queries of single rules and small operators, each with its SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import filters, gates, lineage, reconcile, runs, views
from foliant.plans import store as t
from foliant.plans.corpus import EDITIONS, RECORDS, editions, records
from foliant.plans.registry import query
from foliant.plans.store import with_tables as w
from foliant.sources.snapshots import fingerprint, table
from foliant.streaming import clock, intake


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 7 AS refs, c_custkey % 5 AS fetched, c_custkey % 3 AS extracted, c_custkey % 2 AS failed FROM customer)
SELECT k AS source, CASE WHEN k % 11 = 0 THEN 'SKIPPED_DISABLED' WHEN k % 17 = 0 THEN 'LISTING_FAILURE' WHEN refs = 0 THEN CASE WHEN failed > 0 THEN 'LISTING_FAILURE' WHEN k % 13 = 0 THEN 'NOT_IMPLEMENTED' ELSE 'OK_NO_PUBLICATIONS' END
WHEN fetched = 0 THEN 'FETCH_FAILURE' WHEN extracted = 0 THEN 'EXTRACTION_FAILURE' ELSE 'OK' END AS status FROM c""")
def source_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = runs.outcome(k % 11 != 0, k % 13 != 0, k % 17 != 0, k % 7, k % 5, k % 3, k % 2)
    return table(spark, sf_dir, "customer").select(k.alias("source"), status.alias("status"))


@query(f"""{w('articles', 'article_categories')} SELECT a.id FROM articles a JOIN (SELECT article_id FROM article_categories GROUP BY 1 HAVING bool_or(category IN ('Brand#11', 'Brand#23'))) c ON a.id = c.article_id
WHERE is_significant AND contains(lower(coalesce(title_english, '') || ' ' || ''), 'title 1') AND published_date >= DATE '1996-01-01' AND published_date <= DATE '2000-12-31'""")
def archive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = t.article_categories(spark, sf_dir).groupBy(F.col("article_id").alias("id")).agg(F.collect_set("category").alias("categories"))
    rows = t.articles(spark, sf_dir).withColumn("significant", F.col("is_significant")).join(folded, "id")
    return filters.search(rows, " Title 1", "1996-01-01", "2000-12-31", flagged=True, categories=["Brand#11", "Brand#23"]).select("id")


@query(f"{w('articles')} SELECT id, coalesce(passed_relevance, false) AND trim(coalesce(title_english, '')) <> '' AND trim(coalesce(summary_english, '')) <> '' AS publishable FROM articles")
def publishable_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = filters.publishable(F.col("passed_relevance"), F.col("title_english"), F.col("summary_english"))
    return t.articles(spark, sf_dir).select("id", ready.alias("publishable"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'licence forbids' WHEN 1 THEN 'licence unknown' ELSE CASE WHEN p_size * 40 < 800 OR p_size * 30 < 400 THEN 'too small' ELSE 'ok' END END AS verdict FROM part""")
def licence_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ["CC BY-NC 4.0", "all rights kept", "CC BY-SA 3.0", "Public domain", "CC0 1.0"]))
    licence = F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", filters.licence_verdict(licence, F.col("p_size") * 40, F.col("p_size") * 30).alias("verdict"))


@query("""WITH p AS (SELECT page_id, 'https' || substr(url, strpos(url, ':')) AS u FROM pages) SELECT page_id, regexp_replace(regexp_extract(u, '^https://[^?#]*'), '/*$', '/') AS canonical,
CASE WHEN split_part(split_part(u, '/', 3), ':', 1) = 'thther.example.org' AND regexp_matches(u, '^https://[^/]+/en/') THEN regexp_replace(regexp_extract(u, '^https://[^?#]*'), '/*$', '/') END AS allowed,
CASE WHEN starts_with(lower(substr(u, 9)), 'www.') THEN lower(substr(u, 13)) ELSE lower(regexp_replace(substr(u, 9), '/+$', '')) END AS key FROM p""")
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", "^[a-z]+:", "https:")
    return table(spark, sf_dir, "pages").select("page_id", fx.url_canonical(url).alias("canonical"), fx.url_allowed(url, "thther.example.org", "^/en/").alias("allowed"), fx.url_key(url).alias("key"))


@query("""SELECT doc_id, sha1(substr(regexp_replace(text, '\\s+', '', 'g'), 1, 200)) AS prefix_hash, substr(sha256(text), 1, 16) AS short_hash, CASE WHEN length(one) <= 200 THEN one ELSE substr(one, 1, 199) || '…' END AS line,
CASE WHEN length(one) <= 300 THEN one ELSE rtrim(regexp_replace(substr(one, 1, 300), '\\s\\S*$', '')) || '...' END AS excerpt,
replace(replace(replace(replace(one, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM documents)""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, one = F.col("text"), fx.collapse(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", fx.body_prefix_hash(x).alias("prefix_hash"), fx.short_hash(x).alias("short_hash"), fx.one_line(x).alias("line"), fx.excerpt(one).alias("excerpt"), fx.escaped(one).alias("escaped")
    )


@query("""WITH k AS (SELECT c_custkey AS k, ['zh-Hans', 'EN', 'english', 'de-DE-1996', 'x', 'fr_FR'][c_custkey % 6 + 1] AS tag, ['2024-05-06x', ' 2024-13-45', '6 May', '2024-02-29', '2023-02-29', NULL][c_custkey % 6 + 1] AS d FROM customer)
SELECT k, CASE WHEN regexp_full_match(lower(split_part(tag, '-', 1)), '[a-z]{2,3}') THEN lower(split_part(tag, '-', 1)) END AS subtag, regexp_full_match(tag, '[A-Za-z]{2,3}(-[A-Za-z0-9]+)*') AS valid,
coalesce(regexp_extract(trim(d), '^(\\d{4}-\\d{2}-\\d{2})', 1), '') AS stamp, CAST(DATE '2024-06-01' - try_cast(substr(d, 1, 10) AS DATE) AS INTEGER) AS days FROM k""")
def tag_and_date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = (F.col("c_custkey") % 6 + 1).cast("int")
    tag = F.element_at(F.array(*map(F.lit, ["zh-Hans", "EN", "english", "de-DE-1996", "x", "fr_FR"])), at)
    day = F.element_at(F.array(*[F.lit(x).cast("string") for x in ("2024-05-06x", " 2024-13-45", "6 May", "2024-02-29", "2023-02-29", None)]), at)
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), fx.language_subtag(tag).alias("subtag"), fx.is_language_tag(tag).alias("valid"), fx.date_stamp(day).alias("stamp"), fx.days_since(day, F.lit("2024-06-01").cast("date")).alias("days")
    )


@query(f"WITH {EDITIONS} SELECT date, n_articles, round(n_articles * 100 / (SELECT max(n_articles) FROM editions), 1) AS height FROM editions")
def volume_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars(editions(spark, sf_dir), "n_articles")


@query(f"""{w('articles', 'article_categories')}, c AS (SELECT article_id, min(CASE category WHEN 'Brand#11' THEN 1 WHEN 'Brand#12' THEN 2 WHEN 'Brand#23' THEN 3 ELSE 99 END) AS p FROM article_categories GROUP BY 1)
SELECT id, published_date, row_number() OVER (PARTITION BY published_date ORDER BY coalesce(is_significant, false) DESC, coalesce(p, 99), relevance_score DESC, id) AS place FROM articles LEFT JOIN c ON id = article_id WHERE analyzed_at IS NOT NULL""")
def day_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = t.article_categories(spark, sf_dir).groupBy(F.col("article_id").alias("id")).agg(F.collect_set("category").alias("categories"))
    rows = t.articles(spark, sf_dir).filter("analyzed_at is not null").join(folded, "id", "left")
    order = views.article_order(F.col("is_significant"), F.col("categories"), F.col("relevance_score"), {"Brand#11": 1, "Brand#12": 2, "Brand#23": 3}, F.col("id"))
    return views.numbered(rows, order, "published_date").select("id", "published_date", "place")


@query(f"""{w('articles')}, p AS (SELECT id, CAST(date_trunc('week', published_date) AS DATE) AS week, length(text_original) AS b, row_number() OVER (PARTITION BY CAST(date_trunc('week', published_date) AS DATE) ORDER BY id) AS place FROM articles),
s AS (SELECT week, size, max(total) AS most FROM (SELECT week, size, ceil(place / size) AS page, sum(b) AS total FROM p CROSS JOIN (SELECT unnest([50, 25, 12, 6, 3, 1]) AS size) GROUP BY 1, 2, 3) GROUP BY 1, 2),
f AS (SELECT week, max(size) AS per_page FROM s WHERE most <= 3000 OR size = 1 GROUP BY 1)
SELECT id, week, per_page, CAST(ceil(place / per_page) AS INTEGER) AS page FROM p JOIN f USING (week)""")
def budgeted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir).withColumn("week", fx.monday(F.col("published_date")))
    return views.budgeted_pages(rows, [F.asc("id")], "week", F.length("text_original"), budget=3000).select("id", "week", "per_page", "page")


@query(f"{w('runs')}, z AS (SELECT min(completed_at) AS zero FROM runs WHERE articles_new % 3 = 0) SELECT id, CASE WHEN completed_at >= zero THEN zero END AS day_zero, CASE WHEN articles_new % 3 = 0 THEN CAST(floor(epoch(completed_at - zero) / 86400) AS BIGINT) END AS day FROM runs, z")
def day_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.runs(spark, sf_dir).select("id", F.col("completed_at").alias("finished_at"), (F.col("articles_new") % 3 == 0).alias("ok"))
    return runs.day_clock(rows).select("id", "day_zero", "day")


@query(f"""{w('results')}, r AS (SELECT scrape_run_id, source_slug, max(status) AS status, min(completed_at) AS started_at FROM results GROUP BY 1, 2), o AS (SELECT scrape_run_id, source_slug, status, CASE WHEN scrape_run_id % 4 <> 0 THEN started_at END AS started_at FROM r WHERE scrape_run_id <= 20),
n AS (SELECT scrape_run_id, source_slug, 'OK' AS status, started_at FROM r WHERE scrape_run_id > 10)
SELECT scrape_run_id, source_slug, coalesce(n.status, o.status) AS status, CASE WHEN o.status IS NOT NULL THEN o.started_at ELSE n.started_at END AS started_at FROM o FULL OUTER JOIN n USING (scrape_run_id, source_slug)""")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.results(spark, sf_dir).groupBy("scrape_run_id", "source_slug").agg(F.max("status").alias("status"), F.min("completed_at").alias("started_at"))
    old = rows.filter("scrape_run_id <= 20").withColumn("started_at", F.when(F.col("scrape_run_id") % 4 != 0, F.col("started_at")))
    return runs.upsert_results(old, rows.filter("scrape_run_id > 10").withColumn("status", F.lit("OK")), ["scrape_run_id", "source_slug"], ["started_at"])


@query("""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0),
b AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 1)
SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b USING (s, p, n)""")
def payload_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_orderpriority")
    return lineage.nth_match(rows.filter("id % 2 = 0"), rows.filter("id % 2 = 1"), ["o_orderstatus", "o_orderpriority"], "id")


#: orders as runs of three snapshots; the merge keeps origin's ids and numbers local's own runs above them.
_RUN_SIDES = """o AS (SELECT o_orderkey AS id, o_orderstatus AS s, o_orderpriority AS p FROM orders), own AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM o WHERE id % 3 = 2),
moved AS (SELECT id, s, p, k + (SELECT max(id) FROM o WHERE id % 3 <> 2) AS new_id FROM own)"""


def _run_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    base, origin, local = rows.filter("id % 3 = 0"), rows.filter("id % 3 <> 2"), rows.filter("id % 3 <> 1")
    new = reconcile.renumbered(rows.filter("id % 3 = 2"), origin).select(F.col("new_id").alias("id"), "s", "p")
    return base, origin, local, origin.unionByName(new)


@query(f"""WITH {_RUN_SIDES} SELECT id AS local_id, id AS merged_id, 'inherited' AS how FROM o WHERE id % 3 = 0 UNION ALL SELECT id, new_id, 'matched' FROM moved""")
def run_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local runs in a merge, recovered from payloads that a fifteenth of all runs share."""
    return lineage.recovered(*_run_sides(spark, sf_dir), ["s", "p"])


@query(f"""WITH {_RUN_SIDES}, m AS (SELECT id, CASE WHEN id % 50 = 1 THEN 'X' ELSE s END AS s, p FROM o WHERE id % 3 <> 2 AND id % 40 <> 4 UNION ALL SELECT new_id, CASE WHEN new_id % 50 = 1 THEN 'X' ELSE s END, p FROM moved WHERE new_id % 40 <> 4 UNION ALL SELECT 1000000000 + id, s, p FROM o WHERE id % 900 = 0),
a AS (SELECT s, p, count(*) AS n FROM own GROUP BY 1, 2), b AS (SELECT s, p, count(*) AS n FROM m WHERE id NOT IN (SELECT id FROM o WHERE id % 3 <> 2) GROUP BY 1, 2),
lost AS (SELECT s, p, count(*) AS n FROM o WHERE id % 3 = 0 AND id % 40 = 4 GROUP BY 1, 2),
need AS (SELECT s, p, sum(n) AS n FROM (FROM a UNION ALL FROM lost) GROUP BY 1, 2),
u AS (SELECT sum(greatest(coalesce(need.n, 0) - coalesce(b.n, 0), 0)) AS unproven, sum(greatest(coalesce(b.n, 0) - coalesce(need.n, 0), 0)) AS unexplained FROM need FULL JOIN b ON need.s = b.s AND need.p = b.p)
SELECT unnest(['origin_lost', 'origin_altered', 'inherited_altered', 'merged_unexplained', 'repeated_id', 'local_unproven']) AS name,
  unnest([(SELECT count(*) FROM o WHERE id % 3 <> 2 AND id % 40 = 4), (SELECT count(*) FROM o WHERE id % 3 <> 2 AND id % 40 <> 4 AND id % 50 = 1), 0, CAST(unexplained AS BIGINT), 0, CAST(unproven AS BIGINT)]) AS violations FROM u""")
def lineage_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proof on a merge that was tampered with: runs lost, altered and invented must show."""
    base, origin, local, merged = _run_sides(spark, sf_dir)
    bad = merged.filter("id % 40 <> 4").withColumn("s", F.when(F.col("id") % 50 == 1, "X").otherwise(F.col("s")))
    more = table(spark, sf_dir, "orders").filter("o_orderkey % 900 = 0").select((F.col("o_orderkey") + 1_000_000_000).alias("id"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    return lineage.explained(base, origin, local, bad.unionByName(more), ["s", "p"])


@query(f"""{w('articles')}, e AS (SELECT CAST(date_trunc('week', published_date) AS DATE) AS week, count(*) AS n, count(*) FILTER (is_significant) AS s FROM articles GROUP BY 1), r AS (SELECT week, n, s, n % 9 = 0 AS short, n % 10 = 0 AS late, n % 7 = 0 AS out FROM e)
SELECT unnest(['span', 'date_is_week_end', 'trail_beyond_articles', 'flagged_beyond_articles', 'trail_outside_week']) AS rule,
unnest([count(*) FILTER (short), count(*) FILTER (late), count(*) FILTER (1 > n - 40), count(*) FILTER (s > n - 40), count(*) FILTER (out)]) AS violations FROM r""")
def edition_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.articles(spark, sf_dir).groupBy(fx.monday(F.col("published_date")).alias("week")).agg(F.count("*").alias("n"), F.count_if("is_significant").alias("n_significant"))
    n, week = F.col("n"), F.col("week")
    shaped = rows.select(
        F.date_add(week, 6).alias("week_ending"),
        F.when(n % 9 == 0, F.date_add(week, 1)).otherwise(week).alias("week_start"),
        F.when(n % 10 == 0, F.date_add(week, 5)).otherwise(F.date_add(week, 6)).alias("date"),
        (n - 40).alias("n_articles"),
        "n_significant",
        F.array(F.struct(F.when(n % 7 == 0, F.date_add(week, 30)).otherwise(F.date_add(week, 3)).alias("date"))).alias("source_trail"),
    )
    return gates.rule_counts(shaped, gates.edition_rules())


@query("SELECT page_id FROM pages WHERE regexp_matches(html || CASE WHEN page_id % 9 = 0 THEN '{{ title }}' WHEN page_id % 9 = 1 THEN '{% if %}' ELSE '' END, '\\{\\{|\\}\\}|\\{%|%\\}')")
def unrendered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("page_id") % 9 == 0, "{{ title }}").when(F.col("page_id") % 9 == 1, "{% if %}").otherwise("")
    return gates.unrendered(table(spark, sf_dir, "pages").select("page_id", F.concat("html", mark).alias("value"))).select("page_id")


@query(f"""{w('sources', 'institutions')}, s AS (SELECT CASE WHEN id % 40 = 1 THEN 's0' ELSE slug END AS slug, coalesce(institution_id, 99) AS institution_id, id % 6 - 1 AS cadence, language_tag FROM sources)
SELECT 'repeated_slug' AS rule, slug AS key FROM s GROUP BY slug HAVING count(*) > 1 UNION ALL SELECT 'unknown_institution', slug FROM s WHERE institution_id NOT IN (SELECT id FROM institutions)
UNION ALL SELECT 'cadence_not_positive', slug FROM s WHERE cadence <= 0 UNION ALL SELECT 'language_tag', slug FROM s WHERE language_tag IS NULL OR NOT regexp_full_match(language_tag, '[A-Za-z]{{2,3}}(-[A-Za-z0-9]+)*')
UNION ALL SELECT 'unknown_parent', CAST(id AS VARCHAR) FROM institutions WHERE id % 5 = 4""")
def manifest_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    sources = t.sources(spark, sf_dir).select(F.when(key % 40 == 1, "s0").otherwise(F.col("slug")).alias("slug"), F.coalesce("institution_id", F.lit(99)).alias("institution_id"), (key % 6 - 1).alias("expected_cadence_days"), "language_tag")
    inst = t.institutions(spark, sf_dir).select(key.alias("institution_id"), F.when(key % 5 == 4, 1000).when(key % 5 != 0, key - key % 5).alias("parent_id"))
    return gates.manifest_rules(sources, inst)


@query("SELECT n_nationkey AS id, nation.n_name AS name, p.n_name AS parent FROM nation LEFT JOIN (SELECT n_nationkey AS k, n_name FROM nation) p ON n_nationkey - n_nationkey % 5 = p.k AND n_nationkey % 5 <> 0")
def institution_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.institutions(spark, sf_dir)
    parents = rows.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"))
    own = rows.withColumn("parent_id", F.when(F.col("id") % 5 != 0, F.col("id") - F.col("id") % 5))
    return own.join(parents, "parent_id", "left").select("id", "name", "parent")


@query(f"""WITH {RECORDS}, c AS (SELECT (SELECT count(*) FROM records) AS a, (SELECT count(*) FROM records WHERE id % 100 <> 7) AS b)
SELECT 'right' AS declared, unnest(['record_count', 'fingerprint']) AS name, unnest([CAST(a <> a AS BIGINT), 0]) AS violations FROM c UNION ALL SELECT 'altered', unnest(['record_count', 'fingerprint']), unnest([0, CAST(b < a AS BIGINT)]) FROM c
UNION ALL SELECT 'shorter', unnest(['record_count', 'fingerprint']), unnest([CAST(a <> b AS BIGINT), CAST(a <> b AS BIGINT)]) FROM c""")
def declared_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus against declarations: its own, that of rows with one URL altered, that of fewer rows."""
    rows = records(spark, sf_dir).select("id", "url")
    altered = rows.withColumn("url", F.when(F.col("id") % 100 == 7, F.concat("url", F.lit("/"))).otherwise(F.col("url")))
    found = fingerprint(rows)
    parts = []
    for name, df in (("right", rows), ("altered", altered), ("shorter", rows.filter("id % 100 <> 7"))):
        n, *words = fingerprint(df).first()
        parts.append(gates.declared_snapshot(found, n, words).select(F.lit(name).alias("declared"), "name", "violations"))
    return parts[0].union(parts[1]).union(parts[2])


#: Runs by user: every event is a run of its user, a purchase a success.
_USER_RUNS = """runs AS (SELECT user_id AS source, event_id AS run_id, ts AS "at", event_type = 'purchase' AS ok FROM events)"""


def _user_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source"), F.col("event_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "purchase").alias("ok"))


@query(f"""WITH {_USER_RUNS}, z AS (SELECT *, min("at") FILTER (ok) OVER (PARTITION BY source ORDER BY "at" RANGE UNBOUNDED PRECEDING) AS zero FROM runs),
s AS (SELECT source, "at" + INTERVAL 5 DAY AS due, zero, lead("at") OVER (PARTITION BY source ORDER BY "at") AS next FROM z WHERE ok)
SELECT CAST(source AS VARCHAR) AS source, 'run' AS kind, run_id, "at", ok, zero AS day_zero, CASE WHEN ok THEN CAST(floor(epoch("at" - zero) / 86400) AS BIGINT) END AS day FROM z
UNION ALL SELECT CAST(source AS VARCHAR), 'overdue', NULL, due, false, zero, CAST(floor(epoch(due - zero) / 86400) AS BIGINT) FROM s WHERE (next IS NULL OR next > due) AND due <= TIMESTAMP '2024-01-29'""")
def source_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day numbers of runs and silences of more than five days, by source."""
    rows = _user_runs(spark, sf_dir)
    found = clock.day_rows(rows).unionByName(clock.overdue_rows(rows, 5, datetime(2024, 1, 29)))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "day_zero")})


#: orders as publications found again on other days, one to ten days late or two early, under fewer URLs than rows.
_ARRIVALS = """a AS (SELECT o_orderkey AS id, 'u' || (o_orderkey % 9000) AS url, CAST(o_orderdate AS DATE) AS published, CAST(o_orderdate AS DATE) + CAST(o_custkey % 12 - 2 AS INTEGER) AS arrived FROM orders)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = F.col("o_orderdate").cast("date")
    shift = (F.col("o_custkey") % 12 - 2).cast("int")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), (F.col("o_orderkey") % 9000).cast("string")).alias("url"), published.alias("published"), F.date_add(published, shift).alias("arrived"))


@query(f"""WITH {_ARRIVALS}, f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY arrived, id) AS k FROM a WHERE arrived - published BETWEEN 0 AND 6)
SELECT id, 'accepted' AS verdict FROM f WHERE k = 1 AND url NOT LIKE '%7' UNION ALL SELECT id, CASE WHEN arrived < published THEN 'future' ELSE 'late' END FROM a WHERE arrived - published NOT BETWEEN 0 AND 6""")
def intake_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late, future, repeated and known publications of seven-day windows."""
    rows = _arrivals(spark, sf_dir)
    accepted, rejected = intake.windowed(rows, rows.filter("url like '%7'").select("url"))
    return accepted.select("id", F.lit("accepted").alias("verdict")).union(rejected.select("id", "verdict"))
