"""The daily readout: what a day's clean articles amount to, by rule, in parts and in four texts; and the daily brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators.site import extraction_issue, statuses

#: So many categories name a day, and so many flagged titles what mattered (fixed values).
TOP, TITLES = 3, 2
#: The rank of an article none of whose categories has a priority (fixed value).
LAST = 99


def ranked(articles: DataFrame, links: DataFrame, priority: dict[str, int]) -> DataFrame:
    """articles with categories (in order of name), clean, flagged (clean ones only) and order_: flag, best category priority, relevance, id."""
    by_article = links.groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set("category")).alias("categories"), F.min(fx.mapped(priority, F.col("category"), LAST)).alias("rank_"))
    rows = articles.drop("categories", "rank_").join(by_article, "id", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    clean = ~extraction_issue(F.col("summary_english"))
    flag = F.coalesce("is_significant", F.lit(False))
    order = F.struct((~flag).alias("routine"), F.coalesce("rank_", F.lit(LAST)).alias("rank"), (-F.coalesce("relevance_score", F.lit(0.0))).alias("score"), F.col("id").alias("id"))
    return rows.withColumns({"clean": clean, "flagged": clean & flag, "order_": order}).drop("rank_")


def _top(rows: DataFrame) -> DataFrame:
    """(day, dominant, flagged_categories, routine_categories): the most frequent categories of a day's clean articles, and of the flagged and other ones apart; ties by name."""
    kinds = {"dominant": F.lit(True), "flagged_categories": F.col("flagged"), "routine_categories": ~F.col("flagged")}
    each = rows.filter("clean").select(F.col("published_date").alias("day"), "flagged", F.explode("categories").alias("category"))
    counts = each.groupBy("day", "category").agg(*[F.count_if(test).alias(name) for name, test in kinds.items()])
    first = lambda name: F.slice(F.array_sort(F.collect_list(F.when(F.col(name) > 0, F.struct((-F.col(name)).alias("n"), "category")))), 1, TOP)["category"]
    return counts.groupBy("day").agg(*[first(name).alias(name) for name in kinds])  # a row for each category of the day at most


def readout(articles: DataFrame, links: DataFrame, priority: dict[str, int], source: str = "source_slug") -> DataFrame:
    """One row for each published day with its branch and the parts of its texts.

    branch is no_clean, flagged or routine, by the articles whose text could be
    used. lead is the first of these in ranked()'s order, with lead_title,
    lead_categories and lead_category, the one of the best priority (ties by
    name, null without categories). mattered are the titles of the first two
    flagged ones. only_source is set where all clean articles with a source
    have the same one.
    """
    rows = ranked(articles, links, priority).withColumn("short_", fx.short_title(F.col("title_english"), F.col("title_original")))
    best = F.struct(F.col("id").alias("lead"), F.col("short_").alias("lead_title"), F.col("categories").alias("lead_categories"))
    when = lambda test, x: F.when(test, x)
    name = F.nullif(F.col(source).cast("string"), F.lit(""))
    days = rows.groupBy(F.col("published_date").alias("day")).agg(
        F.count_if("clean").alias("n_clean"),
        F.count_if("flagged").alias("n_flagged"),
        F.min_by(when(F.col("clean"), best), when(F.col("clean"), F.col("order_"))).alias("best_"),
        F.min(when(F.col("clean"), name)).alias("least_"),
        F.max(when(F.col("clean"), name)).alias("most_"),
    )
    place = F.row_number().over(Window.partitionBy("published_date").orderBy("order_"))  # with the filter, each task keeps two rows a day before they meet
    titles = rows.filter("flagged").withColumn("place_", place).filter(F.col("place_") <= TITLES)
    titles = titles.groupBy(F.col("published_date").alias("day")).agg(F.array_sort(F.collect_list(F.struct("place_", "short_")))["short_"].alias("mattered"))
    found = days
    for part in (titles, _top(rows)):
        keyed = part.withColumnRenamed("day", "day_")
        found = found.join(keyed, F.col("day").eqNullSafe(F.col("day_")), "left").drop("day_")
    none = F.array().cast("array<string>")
    branch = F.when(F.col("n_clean") == 0, "no_clean").when(F.col("n_flagged") > 0, "flagged").otherwise("routine")
    listed = [F.coalesce(c, none).alias(c) for c in ("mattered", "dominant", "flagged_categories", "routine_categories")]
    ranks = F.transform("best_.lead_categories", lambda c: F.struct(fx.mapped(priority, c, LAST).alias("rank"), c.alias("category")))
    category = F.array_min(ranks)["category"]
    only = F.when(F.col("least_") == F.col("most_"), F.col("least_"))
    return found.select("day", branch.alias("branch"), "n_clean", "n_flagged", "best_.lead", "best_.lead_title", "best_.lead_categories", category.alias("lead_category"), only.alias("only_source"), *listed)


def texts(parts: DataFrame, wording: dict[str, str], labels: dict[str, str], watch: dict[str, str]) -> DataFrame:
    """(day, overview, what_mattered, what_was_routine, what_to_watch) of readout() in the wording given.

    wording has for each branch overview.{branch} and routine.{branch} (and
    routine.flagged.none, pattern.flagged.none and pattern.routine.none where a
    day has no categories), mattered.no_clean, mattered.routine and
    mattered.labels, single and watch. {n} and {s} are the flagged count and
    its plural, {pattern} the day's categories, {source}, {title}, {labels}.
    labels name categories, watch has a text for some; others are themselves
    and wording's watch.
    """
    named = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(fx.mapped(labels, x, None), x) if labels else x), ", ")

    def fill(key: str, **values: Column) -> Column:
        out = F.lit(wording[key])
        for name, value in values.items():
            out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
        return out

    def pattern(c: str, otherwise: str) -> Column:
        return F.when(F.size(c) > 0, named(F.col(c))).otherwise(F.lit(wording[otherwise]))

    single = F.when(F.col("only_source").isNotNull(), fill("single", source=F.col("only_source"))).otherwise("")
    counted = {"n": F.col("n_flagged").cast("string"), "s": F.when(F.col("n_flagged") == 1, "").otherwise("s")}
    routine = pattern("dominant", "pattern.routine.none")
    flagged = pattern("flagged_categories", "pattern.flagged.none")
    of = lambda none, flag, plain: F.when(F.col("branch") == "no_clean", none).when(F.col("branch") == "flagged", flag).otherwise(plain)
    own = F.when(F.size("lead_categories") > 0, fill("mattered.labels", labels=named(F.col("lead_categories")))).otherwise("")
    return parts.select(
        "day",
        of(fill("overview.no_clean"), F.concat(fill("overview.flagged", pattern=flagged, **counted), single), F.concat(fill("overview.routine", pattern=routine), single)).alias("overview"),
        of(fill("mattered.no_clean"), F.array_join("mattered", "; "), fill("mattered.routine", title=F.col("lead_title"), labels=own)).alias("what_mattered"),
        of(fill("routine.no_clean"), F.when(F.size("routine_categories") > 0, fill("routine.flagged", pattern=named(F.col("routine_categories")))).otherwise(fill("routine.flagged.none")), fill("routine.routine", pattern=routine)).alias("what_was_routine"),
        F.coalesce(fx.mapped(watch, F.col("lead_category"), None) if watch else F.lit(None).cast("string"), F.lit(wording["watch"])).alias("what_to_watch"),
    )


def brief(articles: DataFrame, links: DataFrame, priority: dict[str, int], configured: DataFrame, signals: int = 3, source: str = "source_slug") -> DataFrame:
    """One row, the newest day's: its articles in order, counts, the readout's parts, statuses of the configured sources, the newest signals.

    ids are the day's articles in ranked()'s order, all of them; n_sources
    counts different sources. Without any dated article there is no row.
    """
    newest = articles.agg(F.max("published_date").alias("published_date"))
    of_day = articles.join(F.broadcast(newest), "published_date", "left_semi")  # one row
    rows = ranked(of_day, links.join(of_day.select(F.col("id").alias("article_id")), "article_id", "left_semi"), priority)
    day = rows.groupBy(F.col("published_date").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("is_significant", F.lit(False))).alias("n_significant"), F.count_distinct(source).alias("n_sources"), F.array_sort(F.collect_list("order_"))["id"].alias("ids")
    )
    parts = readout(of_day, links, priority, source).withColumnRenamed("day", "day_")
    told = statuses(of_day, configured, source).agg(F.array_sort(F.collect_list(F.struct("name", "status", "count"))).alias("statuses"))  # a row for each configured source
    flagged = articles.filter(F.coalesce("is_significant", F.lit(False)) & ~extraction_issue(F.col("summary_english")))
    order = F.struct(F.coalesce(F.datediff(F.lit("9999-12-31").cast("date"), "published_date"), F.lit(2**31 - 1)).alias("age"), (-F.coalesce("relevance_score", F.lit(0.0))).alias("score"), "id")
    recent = flagged.withColumn("k", order).orderBy("k").limit(signals)
    latest = recent.agg(F.array_sort(F.collect_list("k"))["id"].alias("recent_signals"))
    return day.join(parts, F.col("day") == F.col("day_")).drop("day_").join(F.broadcast(told)).join(F.broadcast(latest))  # one row each
