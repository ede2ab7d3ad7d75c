"""Published documents as texts to write: sitemaps, an Atom feed, the archive as JSON, health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators.lineage import numbered
from foliant.operators.site import extraction_issue

#: What the standard allows in one sitemap (fixed value), and articles in one file of the archive.
SITEMAP_URLS, ARCHIVE_ROWS = 50_000, 5_000
_XML = '<?xml version="1.0" encoding="UTF-8"?>'
_SITEMAPS = "http://www.sitemaps.org/schemas/sitemap/0.9"
_NOTHING = {"OK_NO_PUBLICATIONS", "OK_ALL_DUPLICATES", "OK_ALL_FILTERED"}


def _lines(parts: Column) -> Column:
    return F.concat(F.array_join(parts, "\n"), F.lit("\n"))


def _filed(rows: DataFrame, order: str, entry: Column, per_file: int) -> DataFrame:
    """(file, entries): the entries in order, per_file to a file from 1."""
    placed = numbered(rows, order=order, into="n_").select("n_", entry.alias("entry_"))
    file = F.expr(f"(n_ - 1) div {per_file} + 1")
    return placed.groupBy(file.alias("file")).agg(F.array_sort(F.collect_list(F.struct("n_", "entry_")))["entry_"].alias("entries"))  # per_file rows at most


def sitemap_files(pages: DataFrame, root: str, order: str = "id", loc: str = "loc", per_file: int = SITEMAP_URLS) -> DataFrame:
    """(name, text) of the sitemaps of all pages (a numeric id, loc without the root), in order: sitemap-1.xml and on, and sitemap.xml, which names them.

    No pages give a sitemap.xml that names nothing.
    """
    url = fx.escaped(F.concat(F.lit(root), F.coalesce(loc, F.lit(""))))
    files = _filed(pages, order, F.concat(F.lit("  <url>\n    <loc>"), url, F.lit("</loc>\n  </url>")), per_file)
    name = F.concat(F.lit("sitemap-"), F.col("file").cast("string"), F.lit(".xml"))
    head = F.lit(f'{_XML}\n<urlset xmlns="{_SITEMAPS}">')
    maps = files.select(name.alias("name"), _lines(F.concat(F.array(head), "entries", F.array(F.lit("</urlset>")))).alias("text"))
    named = F.transform(F.array_sort(F.collect_list("file")), lambda k: F.concat(F.lit(f"  <sitemap>\n    <loc>{root}sitemap-"), k.cast("string"), F.lit(".xml</loc>\n  </sitemap>")))
    index = files.agg(_lines(F.concat(F.array(F.lit(f'{_XML}\n<sitemapindex xmlns="{_SITEMAPS}">')), named, F.array(F.lit("</sitemapindex>")))).alias("text"))
    return maps.unionByName(index.select(F.lit("sitemap.xml").alias("name"), "text"))


def atom_feed(editions: DataFrame, site: str, title: str, subtitle: str, author: str, newest: int = 100) -> DataFrame:
    """One row (name, text): the feed of the newest editions (date, title, dek, author_name, published_date), of those that have a date.

    Stamps are the editions' own, never the clock's, so that equal editions
    give an equal feed: updated is the newest date. A blank title or author is
    the feed's own, a blank dek gives no summary. newest is the feed's length.
    """
    esc = lambda x: fx.escaped(x)
    own = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    day = F.col("date").cast("string")
    dated = editions.filter(F.coalesce(day, F.lit("")) != "").orderBy(F.col("date").desc(), F.col("title").asc()).limit(newest)
    url = F.concat(F.lit(f"{site}/posts/"), day, F.lit(".html"))
    stamp = F.concat(F.coalesce(F.nullif(F.col("published_date").cast("string"), F.lit("")), day), F.lit("T00:00:00Z"))
    dek = fx.collapse(F.coalesce("dek", F.lit("")))
    entry = F.concat_ws(
        "\n",
        F.lit("  <entry>"),
        F.concat(F.lit("    <title>"), esc(own("title", title)), F.lit("</title>")),
        F.concat(F.lit('    <link href="'), url, F.lit('" rel="alternate" type="text/html"/>')),
        F.concat(F.lit("    <id>"), url, F.lit("</id>")),
        F.concat(F.lit("    <updated>"), stamp, F.lit("</updated>")),
        F.concat(F.lit("    <published>"), stamp, F.lit("</published>")),
        F.concat(F.lit("    <author><name>"), esc(own("author_name", author)), F.lit("</name></author>")),
        F.when(dek != "", F.concat(F.lit("    <summary>"), esc(dek), F.lit("</summary>"))),
        F.lit("  </entry>"),
    )
    rows = dated.select(F.struct((-F.unix_date(F.col("date").cast("date"))).alias("k"), F.col("title").alias("t"), entry.alias("entry")).alias("e"), day.alias("day"))
    found = rows.agg(F.max("day").alias("last"), F.array_sort(F.collect_list("e"))["entry"].alias("entries"))
    text = lambda x: F.lit(x)
    plain = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    head = [
        text('<?xml version="1.0" encoding="utf-8"?>'),
        text('<feed xmlns="http://www.w3.org/2005/Atom">'),
        text(f"  <title>{plain(title)}</title>"),
        text(f"  <subtitle>{plain(subtitle)}</subtitle>"),
        text(f'  <link href="{site}/feed.xml" rel="self" type="application/atom+xml"/>'),
        text(f'  <link href="{site}/" rel="alternate" type="text/html"/>'),
        text(f"  <id>{site}/</id>"),
        F.concat(text("  <updated>"), F.coalesce("last", text("1970-01-01")), text("T00:00:00Z</updated>")),
    ]
    return found.select(F.lit("feed.xml").alias("name"), _lines(F.concat(F.array(*head), "entries", F.array(text("</feed>")))).alias("text"))


def archive(articles: DataFrame, links: DataFrame, labels: dict[str, str]) -> DataFrame:
    """The sixteen columns of the public archive, nulls as empty values; categories in order of name, with their labels (or themselves)."""
    text = lambda c, name: F.coalesce(F.col(c), F.lit("")).alias(name)
    by_article = links.groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("category")).alias("categories"))
    rows = articles.drop("categories").join(by_article, "id", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    label = F.transform("categories", lambda c: F.coalesce(fx.mapped(labels, c, None), c) if labels else c)
    return rows.select(
        "id",
        text("title_english", "title_en"),
        text("title_original", "title_zh"),
        text("summary_english", "summary"),
        F.coalesce(F.col("published_date").cast("string"), F.lit("")).alias("date"),
        F.coalesce(fx.long_date(F.col("published_date")), F.lit("")).alias("date_fmt"),
        text("source_name", "source"),
        text("source_slug", "source_slug"),
        "categories",
        label.alias("category_labels"),
        F.coalesce("is_significant", F.lit(False)).alias("is_significant"),
        text("significance_reasoning", "significance_reason"),
        F.round(F.coalesce("relevance_score", F.lit(0.0)), 2).alias("relevance_score"),
        text("url", "url"),
        F.concat(F.lit("article/"), F.col("id").cast("string"), F.lit(".html")).alias("article_path"),
        extraction_issue(F.col("summary_english")).alias("extraction_issue"),
    )


def _json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def archive_files(rows: DataFrame, per_file: int = ARCHIVE_ROWS, latest: int = 100) -> DataFrame:
    """(name, text) of archive() as JSON lists: data/articles-1.json and on, by id, and data/latest.json, the newest by date, ties by id."""
    entry = _json(rows.columns)
    listing = lambda x: F.concat(F.lit("["), F.array_join(x, ",\n"), F.lit("]\n"))
    files = _filed(rows, "id", entry, per_file).select(F.concat(F.lit("data/articles-"), F.col("file").cast("string"), F.lit(".json")).alias("name"), listing(F.col("entries")).alias("text"))
    newest = rows.orderBy(F.desc("date"), "id").limit(latest).select(F.struct((-F.coalesce(F.unix_date(fx.calendar_date(F.col("date"))), F.lit(-(1 << 30)))).alias("k"), "id", entry.alias("entry")).alias("e"))
    last = newest.agg(listing(F.array_sort(F.collect_list("e"))["entry"]).alias("text")).select(F.lit("data/latest.json").alias("name"), "text")
    return files.unionByName(last)


def health_reports(results: DataFrame, statuses: DataFrame, columns: list[str]) -> DataFrame:
    """(name, text): for each run (scrape_run_id, status of run_status()) the machine's report as JSON, with the results' columns of each source.

    failed_sources and empty_sources are sorted, a source in order of its
    slug; keys don't change. A run without results has empty lists.
    """
    one = F.struct("source_slug", *columns)
    slug = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("source_slug"))))
    by_run = results.groupBy("scrape_run_id").agg(
        F.count("*").alias("source_count"),
        slug(F.col("is_failure")).alias("failed_sources"),
        slug(F.col("status").isin(sorted(_NOTHING)) & ~F.col("is_failure")).alias("empty_sources"),
        F.array_sort(F.collect_list(one)).alias("sources"),
    )
    rows = statuses.select("scrape_run_id", F.col("status").alias("aggregate_status")).join(by_run, "scrape_run_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array()).alias(c)
    report = F.struct(F.col("scrape_run_id").alias("run_id"), "aggregate_status", F.coalesce("source_count", F.lit(0)).alias("source_count"), none("failed_sources"), none("empty_sources"), none("sources"))
    return rows.select(F.concat(F.lit("health/run-"), F.col("scrape_run_id").cast("string"), F.lit(".json")).alias("name"), F.to_json(report, {"ignoreNullFields": "false"}).alias("text"))
