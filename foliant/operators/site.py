"""Read models of the published pages: daily brief, statuses, archives, signals, editions, media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as fx

#: Phrases of a summary that report an article whose text could not be used (fixed values).
EXTRACTION_SIGNALS = [
    "does not match",
    "body does not match",
    "cannot be meaningfully analyzed",
    "mismatch between headline",
    "insufficient substantive content",
    "visible text does not",
]


def extraction_issue(summary: Column) -> Column:
    """Whether a summary says that the article's text could not be used."""
    text = F.lower(F.coalesce(summary, F.lit("")))
    found = F.lit(False)
    for phrase in EXTRACTION_SIGNALS:
        found |= F.contains(text, F.lit(phrase))
    return found


def score_or_default(score: Column, error: Column, analyzer: bool) -> Column:
    """The score of an article: 1 without an analyzer, 0 where it failed, else what it gave, within 0 and 1."""
    return F.when(error.isNotNull(), 0.0).otherwise(fx.clamp(score)) if analyzer else F.lit(1.0)


def allowed(given: Column, known: list[str]) -> Column:
    """Of given categories those that exist, in the order given, each once."""
    return F.filter(F.array_distinct(F.coalesce(given, F.array().cast("array<string>"))), lambda c: c.isin(known))


def in_window(entries: DataFrame, target: str, lookback: int, cap: int, date: str = "published") -> DataFrame:
    """The cap newest entries of the days to target, ties by URL from the end (the cap bounds one run)."""
    last = F.lit(target).cast("date")
    return entries.filter(F.col(date).between(F.date_sub(last, lookback), last)).orderBy(F.desc(date), F.desc("url")).limit(cap)


def statuses(articles: DataFrame, configured: DataFrame, source: str = "source_slug") -> DataFrame:
    """(name, status, count) of the configured sources (slug, name, fallback): what came, or the fallback text."""
    counts = articles.filter(F.coalesce(source, F.lit("")) != "").groupBy(F.col(source).alias("slug")).agg(F.count("*").alias("count"))
    rows = configured.join(counts, "slug", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return rows.select("name", F.when(F.col("count") > 0, "articles collected").otherwise(F.col("fallback")).alias("status"), "count")


def blank_sets(corpus: DataFrame, fields: list[str], other: Column) -> DataFrame:
    """One row: in how many records each field is blank, in how many other holds, and whether all these sets are the same."""
    marks = [fx.is_blank(F.col(c)) for c in fields]
    differ = F.lit(False)
    for m in marks:
        differ |= m != F.coalesce(other, F.lit(False))
    counts = [F.count_if(m).alias(f"n_blank_{c}") for c, m in zip(fields, marks)]
    return corpus.agg(*counts, F.count_if(other).alias("n_other"), (F.count_if(differ) == 0).alias("identical"))


def week_stats(articles: DataFrame, links: DataFrame, week: Column) -> DataFrame:
    """(week, total, n_significant, dates, sources, categories): of each week its dates and sources in order and its categories by count."""
    rows = articles.withColumn("week", week)
    base = rows.groupBy("week").agg(
        F.count("*").alias("total"),
        F.count_if("is_significant").alias("n_significant"),
        F.array_sort(F.collect_set("published_date")).alias("dates"),
        F.array_sort(F.collect_set("source_slug")).alias("sources"),
    )
    counts = rows.select("id", "week").join(links.select(F.col("article_id").alias("id"), "category"), "id").groupBy("week", "category").agg(F.count("*").alias("n"))
    ranked = counts.groupBy("week").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "category"))).alias("c"))
    return base.join(ranked.select("week", F.col("c.category").alias("categories")), "week", "left")


def dominant(articles: DataFrame, links: DataFrame, n: int = 3) -> DataFrame:
    """The n most frequent categories of articles without an extraction issue, ties by name."""
    clean = articles.filter(~extraction_issue(F.col("summary_english"))).select(F.col("id").alias("article_id"))
    return links.join(clean, "article_id").groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(n)


def archive_rows(articles: DataFrame) -> DataFrame:
    """The columns of the public archive, nulls as empty values."""
    text = lambda c, name: F.coalesce(c, F.lit("")).alias(name)
    return articles.select(
        "id",
        text("title_english", "title_en"),
        text("title_original", "title_zh"),
        text("summary_english", "summary"),
        F.coalesce(F.col("published_date").cast("string"), F.lit("")).alias("date"),
        F.coalesce(fx.long_date(F.col("published_date")), F.lit("")).alias("date_fmt"),
        text("source_slug", "source"),
        F.coalesce("is_significant", F.lit(False)).alias("is_significant"),
        F.round(F.coalesce("relevance_score", F.lit(0.0)), 2).alias("relevance_score"),
        text("url", "url"),
        F.concat(F.lit("article/"), F.col("id").cast("string"), F.lit(".html")).alias("article_path"),
        extraction_issue(F.col("summary_english")).alias("extraction_issue"),
    )


def recent_signals(articles: DataFrame, n: int = 3) -> DataFrame:
    """The n newest flagged articles without an extraction issue."""
    rows = articles.filter(F.coalesce("is_significant", F.lit(False)) & ~extraction_issue(F.col("summary_english")))
    return rows.orderBy(F.desc("published_date"), F.desc("relevance_score"), "id").limit(n)


def feed_rows(rows: DataFrame, root: str, path: Column) -> DataFrame:
    """(loc) of a sitemap or feed: the escaped URL of each row."""
    return rows.select(fx.escaped(F.concat(F.lit(root), path)).alias("loc"))


def redirects(articles: DataFrame, old: Column, new: Column) -> DataFrame:
    return articles.select(old.alias("old_path"), new.alias("new_path"))


def first_match(entries: DataFrame, wanted: DataFrame, key: str, position: str) -> DataFrame:
    """For each wanted key the entry of the least position that has it."""
    hit = entries.join(wanted.select(key).distinct(), key, "left_semi")
    return hit.groupBy(key).agg(F.min_by(F.struct(*[c for c in entries.columns if c != key]), position).alias("_e")).select(key, "_e.*")


def routed(entries: DataFrame, pages: DataFrame, routes: str = "routes", urls: str = "article_urls") -> DataFrame:
    """(route, url, entry id) of the pages (route, url) that a manifest's entry names, both exactly."""
    flat = entries.select(F.col("id").alias("entry"), F.explode(routes).alias("route"), urls)
    return flat.withColumn("url", F.explode(urls)).select("entry", "route", "url").distinct().join(pages.select("route", "url").distinct(), ["route", "url"])


def lead_picture(articles: DataFrame, pictures: DataFrame, brief: str, days: int = 7) -> DataFrame:
    """The newest flagged article of the last days that has a picture, with its first picture (url, position)."""
    last = F.lit(brief).cast("date")
    rows = articles.filter(F.coalesce("is_significant", F.lit(False)) & F.col("published_date").between(F.date_sub(last, days), last))
    first = pictures.groupBy("url").agg(F.min_by("picture", "position").alias("picture"))
    return rows.join(first, "url").orderBy(F.desc("published_date"), F.desc("id")).limit(1).select("id", "url", "picture")


def kept_in_order(rows: DataFrame, group: str, key: Column, position: str = "position") -> DataFrame:
    """One row of each group, those without a group all, in the order of position; ungrouped ones last."""
    grouped = rows.filter(F.coalesce(group, F.lit("")) != "")
    best = grouped.groupBy(group).agg(F.max(F.struct(key.alias("k"), F.col(position).alias("p"))).alias("m")).select(F.col("m.p").alias(position))
    kept = grouped.join(best, position, "left_semi").withColumn("_last", F.lit(0))
    return kept.unionByName(rows.filter(F.coalesce(group, F.lit("")) == "").withColumn("_last", F.lit(1))).orderBy("_last", position)


def distinct_in_order(values: DataFrame, group: str, value: str, position: str = "position", cap: int = 8) -> DataFrame:
    """The first cap different values of each group, blank ones left out, compared in any case, in their order, ties by value."""
    rows = values.withColumn(value, fx.collapse(F.col(value))).filter(F.coalesce(value, F.lit("")) != "")
    # Dealt before they are combined: a task sorts what it combines, and a split of a large file is a large sort.
    rows = rows.repartition(F.xxhash64(group, value, position))
    first = rows.groupBy(group, F.lower(value).alias("_low")).agg(F.min_by(value, position).alias(value), F.min(position).alias(position))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(position, "_low")))
    return placed.filter(F.col("place") <= cap).drop("_low")


def media_score(licence: Column, width: Column, height: Column, overlap: Column, institutional: Column, low_value: Column) -> Column:
    """The score of a picture for an article: licence, size, shape, common words (five at most), a bonus and a malus."""
    name = F.lower(F.coalesce(licence, F.lit("")))
    free = F.when(name.rlike("public domain|cc0"), 4).when(name.rlike("cc[ -]by-sa"), 2).when(name.rlike("cc[ -]by"), 3).otherwise(0)
    large = F.when(width >= 1600, 3).when(width >= 1200, 2).when(width >= 800, 1).otherwise(0)
    shape = F.when((height > 0) & (width >= height), 2).when((height > 0) & (width / height >= 0.85), 1).otherwise(0)
    return F.round(free + large + shape + F.least(overlap, F.lit(5)) + F.when(institutional, 1.5).otherwise(0.0) - F.when(low_value, 1).otherwise(0), 2)


def best_media(candidates: DataFrame, article: str, score: Column, least: float = 6.0) -> DataFrame:
    """The candidate of the greatest score of each article, if it reaches the threshold; ties by title."""
    rows = candidates.withColumn("score", score)
    best = rows.groupBy(article).agg(F.min_by(F.struct("title", "score"), F.struct(-F.col("score"), F.col("title"))).alias("b"))
    return best.select(article, "b.*").filter(F.col("score") >= least)


def foreign_asset(page_url: Column, image_url: Column, page_id: str, image_id: str) -> Column:
    """Whether page and image both carry an id by their patterns, and not the same one."""
    a, b = F.regexp_extract(page_url, page_id, 1), F.regexp_extract(image_url, image_id, 1)
    return F.coalesce((a != "") & (b != "") & (a != b), F.lit(False))


def grouped_counts(articles: DataFrame, matches: Column, group: str = "published_date") -> DataFrame:
    """(group, k, n, k_all, n_all): of each group and of all, how many match."""
    rows = articles.groupBy(group).agg(F.count_if(matches).alias("k"), F.count("*").alias("n"))
    total = articles.agg(F.count_if(matches).alias("k_all"), F.count("*").alias("n_all"))
    return rows.join(F.broadcast(total))  # one row


def edition_sources(editions: DataFrame, trail: str = "source_trail") -> DataFrame:
    """(date, sources, n_sources): the sources of each edition's trail in their order, each once."""
    names = F.array_distinct(F.filter(F.transform(trail, lambda e: e["source"]), lambda s: F.coalesce(s, F.lit("")) != ""))
    return editions.select("date", names.alias("sources"), F.size(names).alias("n_sources"))


def broken_sequence(editions: DataFrame, date: str = "date", issue: str = "issue_number") -> DataFrame:
    """Editions whose issue number isn't greater than that of the one before; editions are few (one a week)."""
    rows = editions.withColumn("previous_issue", F.lag(issue).over(Window.orderBy(date)))
    return rows.filter(F.col(issue) <= F.col("previous_issue")).select(date, issue, "previous_issue")


def trail_matches(editions: DataFrame, articles: DataFrame, trail: str = "source_trail") -> DataFrame:
    """(date, url, id) of trail entries and the articles with the same URL but for scheme, 'www.' and last slashes."""
    entries = editions.select("date", F.explode(F.transform(trail, lambda e: e["url"])).alias("url")).withColumn("_k", fx.url_key(F.col("url")))
    known = articles.select("id", fx.url_key(F.col("url")).alias("_k"))
    return entries.join(known, "_k", "left").drop("_k")


def glossary(editions: DataFrame, term: Column, explanation: Column) -> DataFrame:
    """(term, explanation, date) of the editions with a term, the newest first."""
    rows = editions.select(term.alias("term"), explanation.alias("explanation"), "date")
    return rows.filter(~fx.is_blank(F.col("term")) & F.col("date").isNotNull()).orderBy(F.desc("date"))


def missing_references(documents: DataFrame, pattern: str, known: DataFrame, text: str = "text") -> DataFrame:
    """(id, ref) of the references in texts, by the pattern's first group, that name nothing known (ref)."""
    refs = documents.select("id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).alias("ref"))
    return refs.join(known.select("ref").distinct(), "ref", "left_anti").select("id", "ref")


def index_check(index: DataFrame, expected_count: int, expected_date: str, arity: int, codes: dict[str, int]) -> DataFrame:
    """(rule, violations) of an index (date, row: array, and code columns): its count, newest date, row lengths and codes within their dictionaries."""
    cells = [F.when(F.count("*") != expected_count, 1).otherwise(0).alias("count"), F.when(F.max("date") != F.lit(expected_date).cast("date"), 1).otherwise(0).alias("date"), F.count_if(F.size("row") != arity).alias("arity")]
    cells += [F.count_if((F.col(c) < 0) | (F.col(c) >= n)).alias(c) for c, n in codes.items()]
    row = index.agg(*cells)
    pairs = F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("violations")) for c in row.columns])
    return row.select(F.inline(pairs))


def health_lines(health: DataFrame, as_of: str) -> DataFrame:
    """(source_slug, line): one readable line for each source of latest_results()."""
    days = F.datediff(F.lit(as_of).cast("date"), F.col("last_ok").cast("date"))
    ago = F.when(days.isNull(), "never").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))
    return health.select("source_slug", F.concat_ws(" | ", "source_slug", F.coalesce("status", F.lit("no result")), F.concat(F.lit("last success "), ago), F.concat(fx.thousands(F.col("n_articles")), F.lit(" articles"))).alias("line"))
