"""Reads of the store: lookups, lists of work, joins to sources, desks and categories, and its structural check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx

#: Primary subtags by the language codes of older rows (fixed values).
LEGACY_TAGS = {"ZH": "zh-Hans", "EN": "en"}
#: Outcomes of sources that were not collected at all.
IDLE = ["SKIPPED_DISABLED", "NOT_IMPLEMENTED"]


def id_of(dimension: DataFrame, slug: str) -> DataFrame:
    """(id) of a slug; no row if there is none."""
    return dimension.filter(F.col("slug") == slug).select("id")


def stored(batch: DataFrame, articles: DataFrame, keys: list[str]) -> DataFrame:
    """batch with known: whether the store has any of its keys; a null key is none."""
    known = F.lit(False)
    for k, key in enumerate(keys):
        have = articles.select(F.col(key).alias(f"_k{k}"), F.lit(True).alias(f"_h{k}")).filter(F.col(f"_k{k}").isNotNull()).distinct()
        batch = batch.join(have, F.col(key) == F.col(f"_k{k}"), "left").drop(f"_k{k}")
        known |= F.coalesce(f"_h{k}", F.lit(False))
    return batch.withColumn("known", known).drop(*[f"_h{k}" for k in range(len(keys))])


def pending_analysis(articles: DataFrame) -> DataFrame:
    """Articles that passed the screening and aren't analyzed yet, oldest id first."""
    return articles.filter(F.col("passed_relevance") & F.col("analyzed_at").isNull()).orderBy("id")


def unscored(articles: DataFrame, since: str | None = None, until: str | None = None, most: int | None = None) -> DataFrame:
    """Articles without a decision, by id, of a range of publication dates (inclusive) and at most so many, if given."""
    rows = articles.filter("passed_relevance is null")
    if since:
        rows = rows.filter(F.col("published_date") >= F.lit(since).cast("date"))
    if until:
        rows = rows.filter(F.col("published_date") <= F.lit(until).cast("date"))
    rows = rows.orderBy("id")
    return rows if most is None else rows.limit(most)


def folded_categories(links: DataFrame, article: str = "article_id", category: str = "category") -> DataFrame:
    """(article, categories): each article's categories in order, comma-separated."""
    return links.groupBy(article).agg(F.array_join(F.array_sort(F.collect_set(category)), ",").alias("categories"))


def analyzed(articles: DataFrame, sources: DataFrame, links: DataFrame) -> DataFrame:
    """Analyzed articles with source slug and categories ('' for none), the newest first, then flagged ones, then by score."""
    named = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"), "display_name")
    rows = articles.filter("analyzed_at is not null").join(named, "source_id")
    rows = rows.join(folded_categories(links).withColumnRenamed("article_id", "id"), "id", "left").withColumn("categories", F.coalesce("categories", F.lit("")))
    return rows.orderBy(*newest_first())


def newest_first() -> list[Column]:
    return [F.desc("published_date"), F.desc("is_significant"), F.desc("relevance_score"), F.desc("id")]


def of_day(articles: DataFrame, sources: DataFrame, day: str) -> DataFrame:
    """Analyzed articles of one day with their source, flagged ones first, then by score."""
    named = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"))
    rows = articles.filter(F.col("analyzed_at").isNotNull() & (F.col("published_date") == F.lit(day).cast("date")))
    return rows.join(named, "source_id").orderBy(F.desc("is_significant"), F.desc("relevance_score"), "id")


def recent_analyzed(articles: DataFrame, sources: DataFrame, n: int = 60) -> DataFrame:
    """The n newest analyzed articles with their source (a top-k report)."""
    named = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"))
    return articles.filter("analyzed_at is not null").orderBy(F.desc("published_date"), F.desc("id")).limit(n).join(named, "source_id", "left")


def language_tag(tag: Column, legacy: Column) -> Column:
    """The tag of a source, else the one of its older code, else the code itself."""
    return F.coalesce(F.when(tag != "", tag), fx.mapped(LEGACY_TAGS, legacy, None), legacy)


def source_state(sources: DataFrame) -> DataFrame:
    """Sources with on: the explicit switch, or where it is null the older one."""
    return sources.withColumn("on", F.coalesce("enabled", "is_active"))


def named_sources(sources: DataFrame, desks: DataFrame, institutions: DataFrame) -> DataFrame:
    """All sources with the names of their desk and institution, null where they have none."""
    d = desks.select(F.col("id").alias("desk_id"), F.col("name").alias("desk"))
    i = institutions.select(F.col("id").alias("institution_id"), F.col("name").alias("institution"))
    return sources.join(d, "desk_id", "left").join(i, "institution_id", "left")  # broadcast where Spark finds them small


def results_of(results: DataFrame, run: int) -> DataFrame:
    return results.filter(F.col("scrape_run_id") == run).orderBy("source_slug", "id")


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(1)


def executed(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Results of sources that were collected, with the desk of each source (null where unmapped)."""
    desk = sources.select(F.col("slug").alias("source_slug"), "desk_id")
    return results.filter(~F.col("status").isin(IDLE)).join(desk, "source_slug", "left")


def collecting_desks(results: DataFrame, sources: DataFrame) -> DataFrame:
    """(scrape_run_id, desk_id) of the desks that a run collected for."""
    return executed(results, sources).filter("desk_id is not null").select("scrape_run_id", "desk_id").distinct()


def unmapped_results(results: DataFrame, sources: DataFrame) -> DataFrame:
    return executed(results, sources).filter("desk_id is null").drop("desk_id")


def run_summary(results: DataFrame, sources: DataFrame) -> DataFrame:
    """Of each run: sources executed, failed, not implemented and disabled, and its desks, null if a source of it has none."""
    desk = sources.select(F.col("slug").alias("source_slug"), "desk_id")
    rows = results.join(desk, "source_slug", "left").withColumn("ran", ~F.col("status").isin(IDLE))
    found = rows.groupBy("scrape_run_id").agg(
        F.count_if("ran").alias("n_executed"),
        F.count_if(F.col("ran") & F.col("is_failure")).alias("n_failed"),
        F.count_if(F.col("status") == "NOT_IMPLEMENTED").alias("n_unimplemented"),
        F.count_if(F.col("status") == "SKIPPED_DISABLED").alias("n_disabled"),
        F.count_if(F.col("ran") & F.col("desk_id").isNull()).alias("_unmapped"),
        F.count_distinct(F.when(F.col("ran"), F.col("desk_id"))).alias("n_desks"),
    )
    return found.withColumn("n_desks", F.when(F.col("_unmapped") == 0, F.col("n_desks"))).drop("_unmapped")


def totals(articles: DataFrame, sources: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: articles, analyzed ones, sources, institutions and runs."""
    a = articles.agg(F.count("*").alias("n_articles"), F.count("analyzed_at").alias("n_analyzed"))
    s = sources.agg(F.count("*").alias("n_sources"), F.count_distinct("institution_id").alias("n_institutions"))
    return a.join(F.broadcast(s)).join(F.broadcast(runs.agg(F.count("*").alias("n_runs"))))  # one row each


def stuck_translations(articles: DataFrame) -> DataFrame:
    """Articles that passed and have a blank title in translation, the longest first."""
    rows = articles.filter(F.col("passed_relevance") & fx.is_blank(F.col("title_english")))
    return rows.withColumn("n_chars", F.length("text_original")).orderBy(F.desc("n_chars"), "id")


def screening_summary(articles: DataFrame) -> DataFrame:
    """One row: all, passed and flagged articles, and the share that passed of those decided."""
    row = articles.agg(F.count("*").alias("n"), F.count("passed_relevance").alias("n_decided"), F.count_if("passed_relevance").alias("n_passed"), F.count_if("is_significant").alias("n_flagged"))
    return row.withColumn("rate", F.round(F.col("n_passed") * 100 / F.nullif("n_decided", F.lit(0)), 1))


def titles(articles: DataFrame, title: str = "title_english") -> DataFrame:
    """(url, title) of the articles with a title that isn't blank."""
    return articles.filter(~fx.is_blank(F.col(title))).select("url", F.col(title).alias("title"))


def attribution(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(url, source_slug): what source an article is from, by the one name that stays the same in all snapshots."""
    named = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"))
    return articles.join(named, "source_id", "left").select("url", "source_slug")


def span(articles: DataFrame, date: str = "published_date") -> DataFrame:
    return articles.agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"))


def rendered_difference(articles: DataFrame, rendered: DataFrame) -> DataFrame:
    """(id, side): publishable articles that aren't rendered, and rendered ids that are none."""
    publishable = articles.filter(F.col("analyzed_at").isNotNull() & F.col("passed_relevance")).select("id")
    missing = publishable.join(rendered.select("id"), "id", "left_anti").withColumn("side", F.lit("not_rendered"))
    return missing.union(rendered.select("id").join(publishable, "id", "left_anti").withColumn("side", F.lit("not_publishable")))


def latest_results(results: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Health of each source: its latest result, last new document and last success, and its articles; sources without any too."""
    found = results.groupBy("source_slug").agg(
        F.max_by(F.struct("scrape_run_id", "status"), F.struct("scrape_run_id", "id")).alias("latest"),
        F.max(F.when(F.col("new_documents") > 0, F.col("completed_at"))).alias("last_new"),
        F.max(F.when(~F.col("is_failure"), F.col("completed_at"))).alias("last_ok"),
    )
    counts = articles.groupBy("source_id").agg(F.count("*").alias("n_articles"), F.count("analyzed_at").alias("n_analyzed"))
    rows = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug")).join(found, "source_slug", "left").join(counts, "source_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_articles", "n_analyzed")]
    return rows.select("source_slug", F.col("latest.scrape_run_id").alias("run"), F.col("latest.status").alias("status"), "last_new", "last_ok", *zero)


def structure(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]], required: list[tuple[str, str]], key: str = "id") -> DataFrame:
    """(check, value): for each table its count, distinct keys and greatest key, for each reference (table, column, table, column) its orphans, for each required column its nulls."""
    def values(name: str, df: DataFrame) -> DataFrame:
        row = df.agg(F.count("*").alias("count"), F.count_distinct(key).alias("distinct"), F.coalesce(F.max(key).cast("long"), F.lit(0)).alias("max"))
        return row.select(F.expr(f"stack(3, '{name}.count', `count`, '{name}.distinct', `distinct`, '{name}.max', `max`) as (check, value)"))

    parts = [values(name, df) for name, df in tables.items()]
    for a, column, b, other in references:
        known = tables[b].select(F.col(other).alias(column)).distinct()
        lost = tables[a].filter(F.col(column).isNotNull()).join(known, column, "left_anti")
        parts.append(lost.agg(F.lit(f"{a}.{column} orphans").alias("check"), F.count("*").alias("value")))
    for a, column in required:
        parts.append(tables[a].agg(F.lit(f"{a}.{column} null").alias("check"), F.count_if(F.col(column).isNull()).alias("value")))
    return reduce(DataFrame.union, parts)


def with_relevance(articles: DataFrame, scores: DataFrame, least: float = 0.6) -> DataFrame:
    """articles with the decisions of scores (id, score, reasoning, error): the score clamped, 0 with the error as reason where there is one, the verdict by the threshold."""
    s = scores.select("id", F.when(F.col("error").isNull(), fx.clamp(F.col("score"))).otherwise(0.0).alias("_score"), F.coalesce("error", "reasoning").alias("_why"), F.lit(True).alias("_new"))
    joined = articles.join(s, "id", "left")
    passed = F.when(F.col("_new"), F.col("_score") >= least).otherwise(F.col("passed_relevance"))
    out = joined.withColumns({"relevance_score": F.when(F.col("_new"), F.col("_score")).otherwise(F.col("relevance_score")), "passed_relevance": passed})
    if "relevance_reasoning" in articles.columns:
        out = out.withColumn("relevance_reasoning", F.when(F.col("_new"), F.col("_why")).otherwise(F.col("relevance_reasoning")))
    return out.select(articles.columns)


def linked_categories(links: DataFrame, given: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, unknown): links of articles with the categories given (article_id, slugs) added once each, and the slugs that no category has."""
    wanted = given.select("article_id", F.explode(F.array_distinct("slugs")).alias("category"))
    known = categories.select(F.col("slug").alias("category"))
    new = wanted.join(known, "category", "left_semi").select("article_id", "category")
    return links.select("article_id", "category").union(new).distinct(), wanted.join(known, "category", "left_anti").select("article_id", "category")


def without(articles: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles and their links less those of gone (id): the cascade as two anti-joins."""
    ids = gone.select("id").distinct()
    return articles.join(ids, "id", "left_anti"), links.join(ids.withColumnRenamed("id", "article_id"), "article_id", "left_anti")


def synced(current: DataFrame, declared: DataFrame, key: str, owner: str) -> DataFrame:
    """current with the declared rows of one owner: updated and added by key; others' rows stay, and a key that another owner has is an error.

    Columns that the declaration lacks keep their value.
    """
    a, b = current.alias("a"), declared.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    clash = F.col(f"a.{owner}").isNotNull() & F.col(f"b.{owner}").isNotNull() & (F.col(f"a.{owner}") != F.col(f"b.{owner}"))
    stop = F.raise_error(F.concat(F.lit("declared by two owners: "), F.col(f"a.{key}").cast("string")))
    there = F.col(f"b.{key}").isNotNull()
    pick = lambda c: F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")) if c in declared.columns else F.col(f"a.{c}")
    out = [pick(c).alias(c) if c != owner else F.when(clash, stop.cast(current.schema[owner].dataType)).otherwise(pick(c)).alias(c) for c in current.columns]
    return joined.select(*out)
