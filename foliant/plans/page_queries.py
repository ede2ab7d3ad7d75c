"""Queries of publishers' ladders and listings: the test pages in the markup of four publishers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import ladders, runs
from foliant.plans.registry import query
from foliant.sources.landing import with_text
from foliant.sources.snapshots import table

#: By page_id modulo 4: publisher, address, container tags, paragraph tag, title tag of the pages in its markup.
_MARKUP = [
    ("pla_daily", "http://www.81.cn/yw/{}.html", '<ul class="row m-t-list">', "</ul>", '<p class="ueditor-text-p_display">', "h2"),
    ("mod_china", "http://www.mod.gov.cn/gfbw/wzll/{}.html", "<div>", "</div>", '<p class="ueditor-text-p_display">', "h1"),
    ("global_times_mil", "https://www.globaltimes.cn/page/202401/{}.shtml", '<div class="article_content">', "</div>", "<p>", "h1"),
    ("china_mil_online", "http://eng.chinamil.com.cn/2025xb/N/{}.html", "<div>", "</div>", '<p class="ueditor-text-p_display">', "h1"),
]


def _by_publisher(values: list[Column]) -> Column:
    k = F.col("page_id") % 4
    return F.when(k == 0, values[0]).when(k == 1, values[1]).when(k == 2, values[2]).otherwise(values[3])


def publisher_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as (page_id, url, html) in the publishers' markup; every fifth keeps its own paragraphs, so that later rungs are met."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    parts = []
    for _, _, start, end, paragraph, title in _MARKUP:
        html = F.replace(F.replace(F.col("html"), F.lit("<article>"), F.lit(start)), F.lit("</article>"), F.lit(end))
        html = F.when(F.col("page_id") % 5 != 0, F.replace(html, F.lit("<p>"), F.lit(paragraph))).otherwise(html)
        parts.append(F.replace(F.replace(html, F.lit("<h1>"), F.lit(f"<{title}>")), F.lit("</h1>"), F.lit(f"</{title}>")))
    url = _by_publisher([F.replace(F.lit(u), F.lit("{}"), F.col("page_id").cast("string")) for _, u, *_ in _MARKUP])
    return pages.select("page_id", url.alias("url"), _by_publisher(parts).alias("html"))


def _unescaped(x: str) -> str:
    for mark, sign in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&copy;", "'©'"), ("&middot;", "'·'")):
        x = f"replace({x}, '{mark}', {sign})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"  # a cut text may end without the semicolon


def stripped(x: str) -> str:
    space = "[\\s\\x{00a0}\\x{3000}\\x1c-\\x1f]+"
    return f"regexp_replace({x}, '^{space}|{space}$', '', 'g')"


def _texts(x: str) -> str:
    """The texts of an element: cut at tags and comments, each stripped, the blank ones left out."""
    return f"list_filter(list_transform(string_split_regex({x}, '(?s)<[^>]*>'), lambda y: {stripped(_unescaped('y'))}), lambda y: y <> '')"


def _joined(x: str) -> str:
    return f"array_to_string({_texts(x)}, '')"


@query(f"""WITH p AS (SELECT page_id, page_id % 4 AS k, page_id % 5 <> 0 AS own, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS a,
  {_joined("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title FROM pages),
b AS (SELECT *, list_transform(string_split(a, '<p>')[2:], lambda z: {_joined("z")}) AS ps, array_to_string({_texts("a")}, chr(10)) AS lines FROM p),
c AS (SELECT *, CASE WHEN k = 0 THEN CASE WHEN own THEN 'display' WHEN length(lines) > 50 THEN 'container' ELSE 'long' END WHEN k = 2 AND len(list_filter(ps, lambda x: length(x) > 30)) > 0 THEN 'content' WHEN own AND k <> 2 THEN 'display' ELSE 'long' END AS rung,
  CASE WHEN own AND k = 0 THEN -1 WHEN k = 2 THEN 30 WHEN own THEN 10 WHEN k = 3 THEN 40 ELSE 30 END AS longer FROM b),
d AS (SELECT *, CASE WHEN rung = 'container' THEN lines ELSE array_to_string(list_filter(ps, lambda x: length(x) > longer), chr(10)) END AS body FROM c)
SELECT page_id, ['pla_daily', 'mod_china', 'global_times_mil', 'china_mil_online'][k + 1] AS source, nullif(title, '') AS title, CASE WHEN title <> '' THEN CASE WHEN k = 0 THEN 'h2' ELSE 'h1' END END AS title_rung,
  body, CASE WHEN body <> '' OR rung = 'display' THEN rung END AS body_rung, '2024-01-09' AS published FROM d""")
def article_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = publisher_pages(spark, sf_dir)
    found = ladders.articles(pages, ladders.article_rules(spark), F.lit("2024-01-09").cast("date"))
    return found.select("page_id", "source", "title", "title_rung", "body", "body_rung", "published")


#: What stands in a link of a listing after its label, by publisher, and around the list.
_STAMPS = [" {day}", '<small class="time hidden-xs">{day} 10:30</small>', "", '<div class="title"><h3></h3><small class="time">{day} 08:00</small></div>']


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as listings: the links of their own menus, dated by the publisher's way ten days around 2024-01-09 (every seventh page undated)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 11).cast("int")), "yyyy-MM-dd")
    dated = F.col("page_id") % 7 != 0
    made = []
    for k, (_, address, *_rest) in enumerate(_MARKUP):
        base, _, end = address.partition("{}")
        # the n-th link of the menu is the page's id and n in decimals
        links = F.transform(F.regexp_extract_all("html", F.lit('<a href="/[^"]*">(.*?)</a>'), F.lit(1)), lambda x, i: F.struct(x.alias("label"), i.alias("i")))
        stamp = F.replace(F.lit(_STAMPS[k]), F.lit("{day}"), day)
        anchor = lambda s: F.concat(F.lit(f'<li><a href="{base}'), F.col("page_id").cast("string"), F.lpad(s["i"].cast("string"), 2, "0"), F.lit(f'{end}">'), s["label"], F.when(dated, stamp).otherwise(""), F.lit("</a></li>"))  # noqa: E731, B023
        body = F.array_join(F.transform(links, anchor), "")
        line = F.when(dated & (F.lit(k) == 2), F.concat(F.lit('<div class="source_time">By X | '), F.replace(day, F.lit("-"), F.lit("/")), F.lit(" 18:37:07</div>"))).otherwise("")
        made.append(F.concat(F.lit("<body><div><ul>"), body, F.lit("</ul>"), line, F.lit("</div></body>")))
    url = _by_publisher([F.lit(u.replace("{}", "index")) for _, u, *_ in _MARKUP])
    return pages.select("page_id", F.concat(url, F.lit("?"), F.col("page_id").cast("string")).alias("url"), _by_publisher(made).alias("html"))


@query(f"""WITH p AS (SELECT page_id, page_id % 4 AS k, page_id % 7 <> 0 AS dated, DATE '2024-01-01' + CAST(page_id % 11 AS INTEGER) AS day, regexp_extract_all(html, '<a href="/[^"]*">(.*?)</a>', 1) AS labels FROM pages),
l AS (SELECT page_id, k, dated, day, unnest(labels) AS label, unnest(range(len(labels))) AS i FROM p),
w AS (SELECT *, CASE WHEN NOT dated THEN k = 2 WHEN k = 1 THEN day BETWEEN DATE '2024-01-03' AND DATE '2024-01-09' ELSE day = DATE '2024-01-09' END AS wanted FROM l)
SELECT ['pla_daily', 'mod_china', 'global_times_mil', 'china_mil_online'][k + 1] AS source, replace(['{"', '".join(m[1] for m in _MARKUP).replace('"', "'")}'][k + 1], '{{}}', page_id || lpad(CAST(i AS VARCHAR), 2, '0')) AS link,
  trim(regexp_replace({_unescaped("label")} || CASE WHEN k = 0 THEN ' 2024-01-09' WHEN k = 1 THEN strftime(day, '%Y-%m-%d 10:30') WHEN k = 3 THEN '2024-01-09 08:00' ELSE '' END, '\\s+', ' ', 'g')) AS label, CASE WHEN dated THEN day END AS day FROM w WHERE wanted""")
def listed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.listed_links(listing_pages(spark, sf_dir), ladders.listing_rules(spark), F.lit("2024-01-09").cast("date"))


@query("SELECT page_id, CASE page_id % 3 WHEN 1 THEN 'utf-16le' ELSE 'utf-8' END AS charset, md5(html) AS digest FROM pages")
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as bytes in the charsets that their headers or their markup declare, decoded again."""
    key = F.col("page_id") % 3
    content = F.when(key == 1, F.encode("html", "UTF-16LE")).otherwise(F.encode("html", "UTF-8"))
    kind = F.when(key == 0, "text/html; charset=UTF-8").when(key == 1, "text/html; charset=utf-16le").otherwise("text/html")
    rows = with_text(table(spark, sf_dir, "pages").select("page_id", content.alias("content"), kind.alias("kind")), "content", "kind")
    return rows.select("page_id", "charset", F.md5("text").alias("digest"))


@query("""WITH c AS (SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS source, url, page_id % 7 <> 0 AS ok, contains(html, '</html>') AS out FROM pages),
u AS (SELECT source, url, bool_or(ok) AS ok, bool_or(ok AND out) AS out FROM c GROUP BY 1, 2), n AS (SELECT source, count(*) AS refs, count(*) FILTER (ok) AS fetched, count(*) FILTER (out) AS extracted FROM u GROUP BY 1),
r AS (SELECT source, refs, fetched, extracted FROM n UNION ALL SELECT unnest(['quiet', 'stub', 'broken', 'off']), 0, 0, 0)
SELECT source, CASE source WHEN 'off' THEN 'SKIPPED_DISABLED' WHEN 'broken' THEN 'LISTING_FAILURE' WHEN 'stub' THEN 'NOT_IMPLEMENTED' WHEN 'quiet' THEN 'OK_NO_PUBLICATIONS' ELSE CASE WHEN fetched = 0 THEN 'FETCH_FAILURE' WHEN extracted = 0 THEN 'EXTRACTION_FAILURE' ELSE 'OK' END END AS status,
refs AS "references", fetched, extracted, refs - fetched AS failed, CASE WHEN extracted > 0 AND fetched > extracted THEN (fetched - extracted) || ' of ' || fetched || ' items failed extraction' END AS note FROM r""")
def collected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures of their hosts: every seventh failed, those cut off before the end gave no document."""
    pages = table(spark, sf_dir, "pages").select(fx.url_host(F.col("url")).alias("source"), "url", (F.col("page_id") % 7 != 0).alias("ok"), F.contains("html", F.lit("</html>")).alias("out"))
    more = spark.range(1).select(F.explode(F.array(F.lit("quiet"), F.lit("stub"), F.lit("broken"), F.lit("off"))).alias("source"))
    captures = pages.select("source", F.when(F.col("ok"), "OK").otherwise("FETCH_FAILURE").alias("status"), "url")
    captures = captures.union(more.filter("source = 'broken'").select("source", F.lit("LISTING_FAILURE"), F.lit(None).cast("string")))
    registry = pages.select("source").distinct().union(more).select("source", (F.col("source") != "off").alias("enabled"), (F.col("source") != "stub").alias("implemented"))
    return runs.collected(captures, pages.filter("ok and out").select("source", "url"), registry)
