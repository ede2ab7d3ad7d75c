"""All registered queries of the library with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import dedup, extraction, filters, gates, queue, reconcile, runs, views
from foliant.plans.corpus import EDITIONS, RECORDS, RESULTS, SNAPSHOTS, editions, records, results, snapshots
from foliant.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from foliant.sources.snapshots import fingerprint, table
from foliant.streaming import intake

AS_OF = "2024-04-20"
#: Analysis columns of the stand-in snapshots.
DECIDED = ["relevance_score", "passed_relevance", "analyzed_at"]
TIERS = {"src1": "A", "src2": "B", "src3": "B", "src4": "C", "src5": "D"}
_RANK = "CASE source WHEN 'src1' THEN 400 WHEN 'src2' THEN 300 WHEN 'src3' THEN 300 WHEN 'src4' THEN 200 WHEN 'src5' THEN 100 ELSE 0 END"


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).withColumn("title_hash", fx.title_hash(F.col("title")))


#: Titles in DuckDB: white space of the test texts is ASCII.
TITLED = RECORDS + """, titled AS (
  SELECT *, CASE WHEN t = '' THEN '' ELSE sha1(t) END AS title_hash FROM (
    SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM records))"""
CANONICAL = TITLED + f""", canonical AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY title_hash ORDER BY {_RANK} DESC, source DESC, length(url), url DESC) AS rn FROM titled)
  WHERE rn = 1 OR title_hash = '')"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.canonical(_titled(spark, sf_dir), dedup.canonical_key(TIERS, {}))


@query(f"WITH {CANONICAL} SELECT state, source, count(*) AS n FROM canonical GROUP BY 1, 2")
def corpus_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).groupBy("state", "source").agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT s.state, s.position, coalesce(n, 0) AS n FROM (VALUES ('analyzed', 0), ('not_selected', 1), ('awaiting_screening', 2), ('analysis_incomplete', 3)) s(state, position) LEFT JOIN (SELECT state, count(*) AS n FROM records GROUP BY 1) c ON s.state = c.state")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.state_counts(records(spark, sf_dir))


@query(f"WITH {CANONICAL} SELECT id, title_hash, source, url FROM canonical")
def title_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).select("id", "title_hash", "source", "url")


@query(f"WITH {TITLED} SELECT id, title_hash, row_number() OVER (PARTITION BY title_hash ORDER BY {_RANK} DESC, source DESC, length(url), url DESC) AS rank FROM titled WHERE title_hash <> ''")
def title_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.ranked(_titled(spark, sf_dir), dedup.canonical_key(TIERS, {})).select("id", "title_hash", "rank")


@query(f"WITH {TITLED} SELECT title_hash, 'ungoverned source' AS reason FROM titled WHERE title_hash <> '' GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT source) > 1 AND bool_or(source NOT IN ('src1', 'src2', 'src3', 'src4', 'src5'))")
def refused_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.refused_groups(_titled(spark, sf_dir), TIERS)


@query(f"WITH {RECORDS} SELECT sha256(trim(regexp_replace(title, '\\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS content_hash, count(*) AS n, min(id) AS first_id FROM records GROUP BY 1 HAVING count(*) > 1")
def content_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("id", fx.content_hash(F.col("title"), F.col("text")).alias("content_hash"))
    return rows.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


@query(f"WITH {RECORDS} SELECT id, contains(title || ' ' || text, 'für') OR contains(lower(title || ' ' || text), 'idiot') OR contains(lower(title || ' ' || text), 'license') AS passed FROM records")
def keyword_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, rejected = filters.keyword_split(records(spark, sf_dir), ["für"], ["Idiot", "license"])
    return passed.select("id", F.lit(True).alias("passed")).union(rejected.select("id", F.lit(False)))


@query(f"WITH {RECORDS} SELECT source, count(*) FILTER (score >= 0.6) AS n_passed, count(*) FILTER (score < 0.6) AS n_rejected FROM records GROUP BY 1")
def relevance_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed, rejected = filters.relevance_split(records(spark, sf_dir))
    rows = passed.select("source", F.lit(1).alias("p")).union(rejected.select("source", F.lit(0)))
    return rows.groupBy("source").agg(F.count_if(F.col("p") == 1).alias("n_passed"), F.count_if(F.col("p") == 0).alias("n_rejected"))


@query("WITH d AS (SELECT doc_id, sha256(text) AS h, doc_id % 2 = 0 AS stored FROM documents) SELECT doc_id FROM d WHERE NOT stored AND h NOT IN (SELECT h FROM d WHERE stored)")
def store_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return dedup.unseen(rows.filter("doc_id % 2 <> 0"), rows.filter("doc_id % 2 = 0"), ["h"]).select("doc_id")


@query("""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, sha1(split_part(text, chr(10), 1)) AS a, sha1(string_split(text, chr(10))[-1]) AS b FROM documents),
r(k, doc_id, kept, sa, sb) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
UNION ALL SELECT d.k, d.doc_id, ok, CASE WHEN ok THEN list_append(sa, a) ELSE sa END, CASE WHEN ok THEN list_append(sb, b) ELSE sb END FROM r JOIN d ON d.k = r.k + 1 CROSS JOIN LATERAL (SELECT NOT list_contains(sa, a) AND NOT list_contains(sb, b) AS ok))
SELECT doc_id FROM r WHERE kept""")
def store_dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.element_at(F.split("text", "\n"), 1)).alias("first_key"), F.sha1(F.element_at(F.split("text", "\n"), -1)).alias("second_key"))
    return dedup.greedy_unique(rows, "doc_id", "first_key", "second_key").select("doc_id")


ARTICLES = """articles AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS published_date, c_name AS source, n_name AS institution, o_orderpriority = '1-URGENT' AS significant, o_totalprice AS score, o_orderstatus = 'F' AS analyzed
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey),
cats AS (SELECT DISTINCT l_orderkey AS id, p_brand AS category FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation"))
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"], "left")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").cast("date").alias("published_date"),
        F.col("c_name").alias("source"),
        F.col("n_name").alias("institution"),
        (F.col("o_orderpriority") == "1-URGENT").alias("significant"),
        F.col("o_totalprice").alias("score"),
        (F.col("o_orderstatus") == "F").alias("analyzed"),
    )


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("category")).distinct()


@query(f"WITH {ARTICLES} SELECT a.id, published_date, source, institution, significant, coalesce(categories, '') AS categories FROM articles a LEFT JOIN (SELECT id, string_agg(category, ',' ORDER BY category) AS categories FROM cats GROUP BY 1) c ON a.id = c.id WHERE analyzed ORDER BY published_date DESC, significant DESC, score DESC")
def analyzed_with_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _articles(spark, sf_dir).filter("analyzed")
    folded = _categories(spark, sf_dir).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("category")), ",").alias("categories"))
    rows = rows.join(folded, "id", "left").orderBy(F.desc("published_date"), F.desc("significant"), F.desc("score"))
    return rows.select("id", "published_date", "source", "institution", "significant", F.coalesce("categories", F.lit("")).alias("categories"))


@query(f"WITH {ARTICLES} SELECT id, published_date, source FROM articles WHERE analyzed AND published_date BETWEEN DATE '1996-03-01' AND DATE '1996-03-31'")
def date_range_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.search(_articles(spark, sf_dir).filter("analyzed"), since="1996-03-01", until="1996-03-31").select("id", "published_date", "source")


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY 1 DESC LIMIT 30")
def recent_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().orderBy(F.desc("day")).limit(30)


@query(f"WITH {RECORDS}, f AS (SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(language) = 0 THEN 'language' ELSE 'state' END AS dimension, coalesce(source, language, state) AS key, count(*) AS n FROM records GROUP BY GROUPING SETS ((source), (language), (state))) SELECT dimension, key, n, CAST(row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) - 1 AS INTEGER) AS code FROM f")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.coded(views.facets(records(spark, sf_dir), ["source", "language", "state"]))


@query(f"WITH {RECORDS}, w AS (SELECT CAST(date_trunc('week', published_date) AS DATE) AS week, count(*) AS n FROM records GROUP BY 1), r AS (SELECT CAST(date_trunc('week', d) AS DATE) AS week, count(*) AS run_dates FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) GROUP BY 1), v AS (SELECT w.week, w.week + 6 AS week_end, n, coalesce(run_dates, 0) AS run_dates FROM w LEFT JOIN r ON w.week = r.week) SELECT *, CASE WHEN week = (SELECT min(week) FROM v) THEN 'first' WHEN week = (SELECT max(week) FROM v) THEN 'last' WHEN week <= DATE '2024-02-20' AND week_end >= DATE '2024-02-10' THEN 'outage' END AS annotation FROM v")
def weekly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"))
    return views.week_edges(views.weekly_volume(records(spark, sf_dir), days), [("2024-02-10", "2024-02-20")])


@query(f"WITH {RECORDS} SELECT CAST(day AS DATE) AS day, count(r.id) AS n FROM (SELECT unnest(generate_series(DATE '2024-03-22', DATE '{AS_OF}', INTERVAL 1 DAY)) AS day) s LEFT JOIN records r ON r.published_date = CAST(day AS DATE) GROUP BY 1")
def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.daily_series(records(spark, sf_dir), AS_OF)


@query("WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS a FROM orders), l AS (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a) AS b FROM d) SELECT o_custkey AS source, a + 1 AS gap_from, b - 1 AS gap_to, CAST(b - a - 1 AS INTEGER) AS n_days FROM l WHERE b - a - 1 >= 2")
def run_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("day"))
    return views.collection_gaps(days, group="source")


@query("WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS a FROM orders), l AS (SELECT a, lead(a) OVER (ORDER BY a) AS b FROM d) SELECT a + 1 AS gap_from, b - 1 AS gap_to, CAST(b - a - 1 AS INTEGER) AS n_days FROM l WHERE b - a - 1 >= 1")
def store_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.collection_gaps(table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("day")), least=1)


@query(f"WITH {EDITIONS}, l AS (SELECT date, lag(date) OVER (ORDER BY date) AS previous FROM editions) SELECT date, previous, CAST(date - previous AS INTEGER) AS gap FROM l WHERE date - previous <> 7")
def cadence_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.cadence_gaps(editions(spark, sf_dir)).select("date", "previous", "gap")


@query(f"WITH {EDITIONS} SELECT date, n_articles, CAST(row_number() OVER w AS INTEGER) AS issue, lag(date) OVER w AS previous, lead(date) OVER w AS next FROM editions WINDOW w AS (ORDER BY date)")
def edition_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.edition_sequence(editions(spark, sf_dir))


@query(f"WITH {ARTICLES} SELECT category, count(*) AS n FROM cats JOIN articles USING (id) WHERE published_date BETWEEN DATE '2001-07-02' AND DATE '2001-08-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_categories_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = filters.rolling_window(_articles(spark, sf_dir), "2001-08-01", 30)
    return views.top_values(_categories(spark, sf_dir).join(recent.select("id"), "id"), "category", 10)


@query(f"WITH {RECORDS} SELECT days, count(*) FILTER (published_date BETWEEN DATE '{AS_OF}' - days AND DATE '{AS_OF}') AS n, count(*) FILTER (published_date BETWEEN DATE '{AS_OF}' - days AND DATE '{AS_OF}' AND significant) AS n_significant FROM records CROSS JOIN (VALUES (7), (30)) s(days) GROUP BY 1")
def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.window_stats(records(spark, sf_dir), AS_OF)


@query(f"WITH {RESULTS}, c AS (SELECT run_id, count(*) AS n_sources, count(*) FILTER (is_failure) AS n_failed FROM results GROUP BY 1) SELECT run_id, n_sources, n_failed, CASE WHEN n_failed = n_sources THEN 'failed' WHEN n_failed > 0 THEN 'degraded' ELSE 'completed' END AS status FROM c UNION ALL SELECT DATE '2024-02-01', 0, 0, 'failed'")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = results(spark, sf_dir)
    empty = spark.range(1).select(F.lit("2024-02-01").cast("date").alias("run_id"))  # a run without any result
    return runs.run_status(found, found.select("run_id").union(empty))


@query(f"WITH {RESULTS} SELECT source, max(completed_at) FILTER (new_documents > 0) AS last_new, max(completed_at) FILTER (NOT is_failure) AS last_ok, arg_max(status, (completed_at, result_id)) AS latest_status FROM results GROUP BY 1")
def last_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.last_success(results(spark, sf_dir))


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS scraped, count(*) FILTER (event_type IN ('purchase', 'click')) AS fresh, count(*) FILTER (event_type = 'purchase') AS inserted, count(*) FILTER (event_type = 'click') AS rejected FROM events GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS source, CASE WHEN inserted = 0 AND scraped > fresh THEN 'OK_ALL_DUPLICATES' WHEN inserted = 0 AND rejected > 0 THEN 'OK_ALL_FILTERED' ELSE 'OK' END AS status, greatest(0, scraped - fresh) AS duplicates, inserted AS new_documents, rejected AS relevance_rejected FROM c""")
def run_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, source = F.col("event_type"), F.col("user_id").cast("string").alias("source")
    events = table(spark, sf_dir, "events")
    counts = events.groupBy(source).agg(
        F.count_if(kind != "error").alias("scraped"), F.count_if(kind.isin("purchase", "click")).alias("fresh"), F.count_if(kind == "purchase").alias("inserted"), F.count_if(kind == "click").alias("rejected")
    )
    return runs.attribution(events.select(source, F.lit("OK").alias("status")).distinct(), counts)


@query("""SELECT c_custkey AS source, count(o_orderkey) AS n, max(CAST(o_orderdate AS DATE)) AS last_seen, CAST(DATE '2001-08-02' - max(CAST(o_orderdate AS DATE)) AS INTEGER) AS days_silent,
CASE WHEN c_custkey IN (3, 6) THEN 'INERT' WHEN max(o_orderdate) IS NULL THEN 'UNHEALTHY' WHEN DATE '2001-08-02' - max(CAST(o_orderdate AS DATE)) > 7 THEN 'UNHEALTHY' ELSE 'HEALTHY' END AS state
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def source_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderdate").cast("date").alias("scraped_on"))
    return runs.liveness(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source")), articles, "2001-08-02", [3, 6])


@query("""WITH s AS (SELECT c_custkey, 1 + c_custkey % 60 AS threshold, CAST(DATE '2001-08-02' - max(CAST(o_orderdate AS DATE)) AS INTEGER) AS days FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT c_custkey AS source, CASE WHEN days IS NULL THEN 'unknown' WHEN days <= threshold THEN 'within_cadence' ELSE 'overdue' END AS verdict FROM s""")
def source_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.max(F.col("o_orderdate").cast("date")).alias("seen"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source")).join(orders, "source", "left")
    days = F.datediff(F.lit("2001-08-02").cast("date"), "seen")
    return rows.select("source", runs.silence(days, 1 + F.col("source") % 60).alias("verdict"))


@query(f"""WITH {RECORDS}, n AS (SELECT id, 'fresh' AS part, row_number() OVER (ORDER BY id) AS place FROM records WHERE state = 'awaiting_screening' AND published_date > DATE '2024-04-10'),
b AS (SELECT id, 'backlog' AS part, row_number() OVER (ORDER BY CASE WHEN published_date >= DATE '2024-03-27' THEN 0 ELSE 1 END, id) AS place FROM records WHERE state = 'awaiting_screening' AND published_date <= DATE '2024-04-10'),
s AS (SELECT least((SELECT count(*) FROM n), 55 - least((SELECT count(*) FROM b), 16)) AS k)
SELECT id, part, CAST(place AS INTEGER) AS place FROM n, s WHERE place <= k UNION ALL SELECT id, part, CAST(place AS INTEGER) FROM b, s WHERE place <= 55 - k""")
def analysis_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = records(spark, sf_dir).filter("state = 'awaiting_screening'").select("id", "published_date")
    is_new = F.col("published_date") > F.lit("2024-04-10").cast("date")
    tier = queue.backlog_tier(F.col("published_date"), "2024-04-10")
    found = queue.analysis_queue(waiting.filter(is_new), waiting.filter(~is_new), [F.asc("id")], [tier.asc(), F.asc("id")])
    return found.select("id", "part", "place")


@query(f"WITH {ARTICLES}, r AS (SELECT *, count(*) OVER (PARTITION BY institution) > 13 AS truncated, row_number() OVER (PARTITION BY institution ORDER BY significant DESC, CASE WHEN significant THEN 0 ELSE score END DESC, id) AS place FROM articles) SELECT institution, id, CAST(place AS INTEGER) AS place, truncated FROM r WHERE place <= 13")
def source_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.source_trail(_articles(spark, sf_dir), "institution").select("institution", "id", "place", "truncated")


@query(f"WITH {RECORDS} SELECT id, title, place, CAST(ceil(place / 50.0) AS BIGINT) AS page FROM (SELECT id, title, row_number() OVER (ORDER BY published_date DESC, id DESC) AS place FROM records WHERE contains(lower(title), 'the') AND language = 'en' AND published_date >= DATE '2024-01-15' AND published_date <= DATE '2024-03-31')")
def search_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.search(records(spark, sf_dir), "The ", since="2024-01-15", until="2024-03-31", language="en")
    return views.pages(found, [F.desc("published_date"), F.desc("id")]).select("id", "title", "place", "page")


@query(f"WITH {SNAPSHOTS} SELECT * FROM merged")
def reconcile_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.reconcile_articles(*snapshots(spark, sf_dir), fields=DECIDED)


@query(f"""WITH {SNAPSHOTS} SELECT 'duplicate_url' AS name, count(*) AS violations FROM (SELECT url FROM merged GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM merged GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'id_drift', count(*) FROM origin o JOIN merged m USING (url) WHERE o.id <> m.id
UNION ALL SELECT 'origin_url_lost', count(*) FROM origin WHERE url NOT IN (SELECT url FROM merged)
UNION ALL SELECT 'local_url_lost', count(*) FROM loc WHERE url NOT IN (SELECT url FROM merged)
UNION ALL SELECT 'origin_decision_lost', count(*) FROM origin o JOIN merged m USING (url) WHERE o.passed_relevance IS NOT NULL AND m.passed_relevance IS NULL
UNION ALL SELECT 'local_decision_lost', count(*) FROM loc o JOIN merged m USING (url) WHERE o.passed_relevance IS NOT NULL AND m.passed_relevance IS NULL
UNION ALL SELECT 'source_conflict', count(*) FROM origin o JOIN loc m USING (url) WHERE o.source IS DISTINCT FROM m.source
UNION ALL SELECT 'origin_source_changed', count(*) FROM origin o JOIN merged m USING (url) WHERE o.source IS DISTINCT FROM m.source
UNION ALL SELECT 'local_source_changed', count(*) FROM loc o JOIN merged m USING (url) WHERE o.source IS DISTINCT FROM m.source AND url NOT IN (SELECT url FROM origin)""")
def reconcile_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin, local = snapshots(spark, sf_dir)
    return reconcile.gates(origin, origin, local, reconcile.reconcile_articles(origin, local, fields=DECIDED), source="source")


@query(f"WITH {SNAPSHOTS} SELECT count(*) FILTER (m.id IS NULL) AS missing, count(*) FILTER (o.id IS NULL) AS extra, count(*) FILTER (o.id IS NOT NULL AND m.id IS NOT NULL AND (o.passed_relevance IS DISTINCT FROM m.passed_relevance OR o.analyzed_at IS DISTINCT FROM m.analyzed_at)) AS altered FROM origin o FULL OUTER JOIN merged m ON o.url = m.url")
def reconcile_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin, local = snapshots(spark, sf_dir)
    return reconcile.accounting(origin, reconcile.reconcile_articles(origin, local, fields=DECIDED), ["url"], ["passed_relevance", "analyzed_at"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id").select("doc_id")


@query(f"""WITH {RECORDS}, d AS (SELECT *, CASE id % 23 WHEN 1 THEN '' WHEN 2 THEN '2024-02-30' WHEN 3 THEN strftime(published_date, '%Y/%m/%d') ELSE CAST(published_date AS VARCHAR) END AS day FROM records)
SELECT unnest(['blank_date', 'malformed_date', 'blank_title', 'blank_text']) AS rule, unnest([count(*) FILTER (day = ''), count(*) FILTER (day <> '' AND try_strptime(day, '%Y-%m-%d') IS NULL), count(*) FILTER (trim(title) = ''), count(*) FILTER (trim(text) = '')]) AS violations FROM d""")
def article_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as texts, some blank, some of another form or of no calendar."""
    day, k = F.col("published_date").cast("string"), F.col("id") % 23
    dated = F.when(k == 1, "").when(k == 2, "2024-02-30").when(k == 3, F.replace(day, F.lit("-"), F.lit("/"))).otherwise(day)
    return gates.rule_counts(records(spark, sf_dir).withColumn("published_date", dated), gates.article_rules())


@query(f"""WITH {RECORDS}, t AS (SELECT source, count(*) AS n FROM records GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (state = 'analyzed') AS n_analyzed, count(*) FILTER (state = 'not_selected') AS n_not_selected, count(*) FILTER (state = 'awaiting_screening') AS n_awaiting_screening,
count(*) FILTER (state = 'analysis_incomplete') AS n_analysis_incomplete, count(*) FILTER (trim(title) = '') AS n_blank_title, count(*) FILTER (significant) AS n_flagged, count(DISTINCT language) AS n_languages, count(DISTINCT source) AS n_sources, min(published_date) AS first_date, max(published_date) AS last_date,
(SELECT arg_max(source, (n, source)) FROM t) AS top_source, (SELECT max(n) FROM t) AS top_n, round((SELECT max(n) FROM t) * 100 / count(*), 1) AS top_share FROM records""")
def guide_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.guide_stats(records(spark, sf_dir))


_FIELDS = ["id", "source", "language", "url", "title", "text", "published_date", "passed", "state", "significant"]


@query(f"""WITH {RECORDS}, c AS (SELECT sha256({" || chr(31) || ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in sorted(_FIELDS))}) AS d FROM records)
SELECT count(*) AS n, {", ".join(f"CAST(sum(CAST(('0x' || substr(d, {1 + 12 * k}, 12)) AS BIGINT)) % 281474976710656 AS BIGINT) AS h{k}" for k in range(4))} FROM c""")
def snapshot_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(records(spark, sf_dir).select(_FIELDS))


#: Short markup in one line, without tags and with the five named references.
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g'))"
_OWN = "regexp_extract(x, '(?is)^(.*?)(?:</p|</article|</body|$)', 1)"
_HEAD, _TITLE = "regexp_extract(page, '(?is)<h1[^>]*>(.*?)</h1>', 1)", "regexp_extract(page, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(f"""WITH p AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g') AS page FROM pages),
t AS (SELECT *, list_transform(string_split_regex(page, '(?i)<p\\b[^>]*>')[2:], lambda x: {_PLAIN.format(x=_OWN)}) AS ps, coalesce(nullif({_PLAIN.format(x=_HEAD)}, ''), nullif({_PLAIN.format(x=_TITLE)}, '')) AS title FROM p),
b AS (SELECT page_id, url, title, array_to_string(list_filter(ps, lambda x: length(x) >= 30 AND NOT regexp_matches(x, '(?i)copyright|all rights reserved')), chr(10)) AS body FROM t)
SELECT page_id, url, title, body, '' AS published, CASE WHEN title IS NULL THEN 'no title' WHEN length(body) < 200 THEN 'no body' END AS refusal FROM b""")
def page_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.article(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake.event_windows(table(spark, sf_dir, "events"))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = intake.sessions(table(spark, sf_dir, "events"))
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages) SELECT page_id, host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)/', 1) AS own_section, CASE WHEN host = 'thther.example.org' THEN regexp_extract(url, '^https?://[^/]+/([^/?#]+)/', 1) ELSE '' END AS section FROM p")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", fx.url_host(url).alias("host"), fx.first_directory(url).alias("own_section"), fx.url_section(url, ["thther.example.org"]).alias("section"))


@query(f"WITH {RECORDS} SELECT source, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(length(text)) * 13 // 10 AS BIGINT) AS n_output FROM records WHERE state = 'awaiting_screening' GROUP BY 1")
def spend_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).filter("state = 'awaiting_screening'").groupBy("source").agg(F.sum(F.length("text")).cast("long").alias("n_chars"))
    return rows.withColumn("n_output", F.floor(F.col("n_chars") * 13 / 10))

from foliant.plans import document_queries, page_queries, publication_queries, reconcile_queries, record_queries, rule_queries, site_queries, store_queries  # noqa: E402, F401  they register their queries
