"""Queries of records on their way into the store, of runs' ledgers and of fingerprints that changes update."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import variants as vx
from foliant.operators import lineage, records, runs
from foliant.plans import corpus
from foliant.plans.page_queries import _unescaped, stripped
from foliant.plans.registry import query
from foliant.sources.markup import trees
from foliant.sources.snapshots import fingerprint, table

_SPACE = "[\\s\\x{00a0}\\x{3000}\\x1c-\\x1f]+"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}', ' ', 'g'))"


@query(f"""WITH d AS (SELECT doc_id, {_collapsed("split_part(coalesce(text, ''), chr(10), 1)")} AS title, {_collapsed("coalesce(text, '')")} AS body FROM documents)
SELECT doc_id, title AS title_original, length(body) AS n_chars, CASE doc_id % 3 WHEN 0 THEN '2024-01-02' ELSE '' END AS published_date, sha256(title || chr(10) || body) AS content_hash FROM d""")
def normalized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 3
    title = F.concat(F.lit(" 　"), F.element_at(F.split("text", "\n"), 1), F.lit("\n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", title.alias("title_original"), F.col("text").alias("text_original"), F.when(k == 0, " 2024-01-02T03:04").when(k == 1, "2 May").alias("published_date"))
    return records.normalized(rows).select("doc_id", "title_original", F.length("text_original").alias("n_chars"), "published_date", "content_hash")


@query("""WITH s AS (SELECT o_orderkey AS id, 'u' || (o_orderkey % 9000) AS url FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT 'u' || (o_orderkey % 9000) AS url, min(o_orderkey) AS position FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY position) AS id, url, o_custkey AS source_id FROM f JOIN orders ON position = o_orderkey WHERE url NOT IN (SELECT url FROM s)""")
def inserted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the orders inserted into a store that has the others, under fewer URLs than rows."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("position"), F.concat(F.lit("u"), (F.col("o_orderkey") % 9000).cast("string")).alias("url"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("source_slug"))
    store = rows.filter("position % 3 = 0").select(F.col("position").alias("id"), "url")
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("slug"))
    return records.inserted(store, rows.filter("position % 3 <> 0"), sources).select("id", "url", "source_id")


_AFTER = "regexp_replace(html, '(?s)^.*?</h1>', '')"


@query(f"""WITH p AS (SELECT page_id, {stripped(_unescaped("regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS h1, {_collapsed(_unescaped(f"regexp_replace({_AFTER}, '(?s)<[^>]*>', ' ', 'g')"))} AS body FROM pages),
r AS (SELECT *, CASE WHEN page_id % 6 = 0 THEN 'declared ' || page_id ELSE h1 END AS t, CASE WHEN page_id % 6 <> 0 AND h1 = '' THEN 'no title' WHEN page_id % 5 = 0 THEN 'no date' WHEN length(body) < 200 THEN 'short body' END AS refusal FROM p)
SELECT page_id, CASE WHEN refusal IS NULL THEN {_collapsed("t")} END AS title, CASE WHEN refusal IS NULL THEN md5(replace(body, ' ', '')) END AS digest, refusal FROM r""")
def release_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a ministry's releases; the digest is of the body without blanks, which tags inside words would set otherwise."""
    k = F.col("page_id")
    meta = F.when(k % 6 == 0, F.concat(F.lit('<meta property="og:title" content=" declared '), k.cast("string"), F.lit('">'))).otherwise("")
    html = F.regexp_replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), meta))
    rows = trees(table(spark, sf_dir, "pages").select("page_id", "url", html.alias("html")))
    found = records.releases(rows, F.when(k % 5 != 0, "2024-01-01"))
    return found.select("page_id", "title", F.md5(F.replace("body", F.lit(" "), F.lit(""))).alias("digest"), "refusal")


@query("""SELECT page_id, 'https://h.example/' || page_id || '/og.jpg' AS declared, CASE WHEN page_id % 2 = 0 THEN ['https://h.example/p/a.jpg', 'https://c.example/b.png'] ELSE ['https://h.example/p/a.jpg'] END AS images FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT page_id, NULL, CASE WHEN page_id % 2 = 0 THEN ['https://h.example/p/a.jpg', 'https://c.example/b.png'] ELSE ['https://h.example/p/a.jpg'] END FROM pages WHERE page_id % 3 = 0""")
def page_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    meta = F.when(k % 3 != 0, F.concat(F.lit('<meta property="og:image" content="/'), k.cast("string"), F.lit('/og.jpg">'))).otherwise("")
    more = F.concat(F.lit('<img src="a.jpg"><img src="/img/logo.png"><img src="x.gif">'), F.when(k % 2 == 0, '<img src="//c.example/b.png">').otherwise('<img src="data:,">'))
    rows = table(spark, sf_dir, "pages").select("page_id", F.lit("https://h.example/p/q.html").alias("url"), F.concat(meta, "html", more).alias("html"))
    return records.pictures(trees(rows), F.col("url")).select("page_id", "declared", "images")


@query("SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props as models answer: bare, in fences, in prose, cut off."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), "props", F.lit(" as asked."))).when(k == 3, F.concat(F.lit("```\n"), "props", F.lit("```  "))).otherwise(F.substring("props", 1, 5))
    return table(spark, sf_dir, "events").select("event_id", vx.field(records.model_answer(raw), ["$.k"], "int").alias("k"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '&lt;strong&gt;', '<strong>'), '&lt;/strong&gt;', '</strong>'), '&lt;em&gt;', '<em>'), '&lt;/em&gt;', '</em>'), 'zz', 'zz')) AS digest
FROM (SELECT doc_id, '<strong>' || coalesce(text, '') || '</strong> <em class="x">"' AS t FROM documents)""")
def inline_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("<strong>"), F.coalesce("text", F.lit("")), F.lit('</strong> <em class="x">"'))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(records.inline_markup(text)).alias("digest"))


_LINT = f"""WITH d AS (SELECT doc_id, {_collapsed("coalesce(text, '')")} AS s, {_collapsed("split_part(coalesce(text, ''), chr(10), 1)")} AS t FROM documents),
p AS (SELECT *, list_filter(string_split(regexp_replace(s, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS parts, len(list_filter(string_split(s, ' '), lambda x: x <> '')) AS n, list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '') AS head, list_filter(string_split(regexp_replace(lower(s), '[^a-z0-9 ]', '', 'g'), ' '), lambda x: x <> '') AS ws FROM d)"""


@query(f"""{_LINT} SELECT doc_id, CASE WHEN s = '' THEN ['empty summary'] ELSE list_filter([CASE WHEN starts_with(lower(s), 'the ') THEN 'opener: the ' WHEN starts_with(lower(s), 'a') THEN 'opener: a' END, CASE WHEN contains(lower(s), 'ation') THEN 'phrase: ation' END, CASE WHEN len(parts) > 12 THEN len(parts) || ' sentences' END, CASE WHEN n > 90 THEN n || ' words' END,
CASE WHEN len(head) >= 8 AND ws[1:len(head)] = head THEN 'repeats the headline' END, CASE WHEN length(parts[1]) > 120 THEN 'first sentence of ' || length(parts[1]) || ' characters' END], lambda x: x IS NOT NULL) END AS findings FROM p""")
def summary_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.split("text", "\n"), 1)
    lint = records.summary_lint(title, F.col("text"), ["the ", "a"], ["ation"], most_sentences=12, excerpt=120)
    return table(spark, sf_dir, "documents").select("doc_id", lint.alias("findings"))


@query("""WITH r AS (SELECT user_id * 100 + day(ts) AS run_id, min(ts) AS opened, max(ts) AS closed, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS new, list('e' || event_id ORDER BY event_id) FILTER (event_type = 'error') AS errors, arg_max(event_type, (ts, event_id)) AS last FROM events GROUP BY 1)
SELECT run_id, opened AS started_at, CASE WHEN last <> 'click' THEN closed END AS completed_at, CASE WHEN last <> 'click' THEN n END AS articles_scraped, CASE WHEN last <> 'click' THEN new END AS articles_new, CASE WHEN last <> 'click' THEN 0 END AS articles_analyzed,
CASE WHEN last <> 'click' THEN CASE WHEN errors IS NULL THEN '[]' ELSE '["' || array_to_string(errors, '","') || '"]' END END AS errors, CASE WHEN last = 'click' THEN 'running' WHEN errors IS NULL THEN 'completed' ELSE 'degraded' END AS status FROM r""")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user and day, opened by its first event and closed by its last, unless that is a click; errors as JSON."""
    kind = F.col("event_type")
    days = table(spark, sf_dir, "events").groupBy((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("run_id")).agg(
        F.min("ts").alias("opened"), F.max("ts").alias("closed"), F.count("*").alias("n"), F.count_if(kind == "purchase").alias("new"),
        F.array_sort(F.collect_list(F.when(kind == "error", F.col("event_id")))).alias("e"), F.max_by(kind, F.struct("ts", "event_id")).alias("last"),
    )
    none = F.lit(None).cast("long")
    errors = F.transform("e", lambda x: F.concat(F.lit("e"), x.cast("string")))
    opened = days.select("run_id", F.lit("opened").alias("event"), F.col("opened").alias("at"), none.alias("articles_scraped"), none.alias("articles_new"), none.alias("articles_analyzed"), F.lit(None).cast("array<string>").alias("errors"), F.lit(None).cast("string").alias("status"))
    status = F.when(F.size("e") > 0, "degraded").otherwise("completed")
    closed = days.filter("last <> 'click'").select("run_id", F.lit("closed"), "closed", "n", "new", F.lit(0).cast("long"), F.when(F.size("e") > 0, errors), status)
    return runs.run_rows(opened.union(closed))


_PRINT = """c AS (SELECT id, sha256(coalesce(CAST(id AS VARCHAR), chr(0)) || chr(31) || coalesce(url, chr(0))) AS d FROM now)"""


@query(f"""WITH {corpus.RECORDS}, now AS (SELECT id, CASE WHEN id % 7 = 0 THEN url || '/new' ELSE url END AS url FROM records WHERE id % 11 <> 0), {_PRINT},
f AS (SELECT count(*) AS n, {", ".join(f"CAST(sum(CAST(('0x' || substr(d, {1 + 12 * k}, 12)) AS BIGINT)) % 281474976710656 AS BIGINT) AS h{k}" for k in range(4))} FROM c)
SELECT 'updated' AS how, * FROM f UNION ALL SELECT 'by parts', * FROM f""")
def fingerprint_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus' fingerprint after rows were altered and removed, from these rows alone, and as the sum of its parts."""
    rows = corpus.records(spark, sf_dir).select("id", "url")
    altered = rows.filter("id % 7 = 0 and id % 11 <> 0")
    new = altered.withColumn("url", F.concat("url", F.lit("/new")))
    after = rows.filter("id % 7 <> 0 and id % 11 <> 0").union(new)
    updated = lineage.updated(fingerprint(rows), new, altered.union(rows.filter("id % 11 = 0")))
    parts = lineage.combined(lineage.partition_fingerprints(after, F.col("id") % 16))
    return updated.select(F.lit("updated").alias("how"), "*").union(parts.select(F.lit("by parts"), "*"))
