"""Read models: counts, facets, weeks, series, gaps, trails and sequences."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.sources.snapshots import checkpointed

STATES = ["analyzed", "not_selected", "awaiting_screening", "analysis_incomplete"]
TRAIL = 13


def state_counts(corpus: DataFrame) -> DataFrame:
    """(state, position, n) of all states, those without records too, in their fixed order."""
    dim = corpus.sparkSession.createDataFrame(list(enumerate(STATES)), "position int, state string")
    counts = corpus.groupBy("state").agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "state", "left").select("state", "position", F.coalesce("n", F.lit(0)).alias("n"))


def facets(corpus: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, key, n) of the values that have records, from one pass over the corpus (grouping sets)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dimensions]))
    return corpus.select(pairs.alias("p")).select("p.*").filter("key is not null").groupBy("dimension", "key").agg(F.count("*").alias("n"))


def coded(counts: DataFrame, dimension: str = "dimension") -> DataFrame:
    """Facets with the place of each value in its dimension, from 0, by count and then value."""
    return counts.withColumn("code", F.row_number().over(Window.partitionBy(dimension).orderBy(F.desc("n"), "key")) - 1)


def weekly_volume(records: DataFrame, run_days: DataFrame, date: str = "published_date") -> DataFrame:
    """(week, week_end, n, run_dates): records and days with a run by week from Monday; weeks without records are left out."""
    weeks = records.filter(F.col(date).isNotNull()).groupBy(fx.monday(F.col(date)).alias("week")).agg(F.count("*").alias("n"))
    days = run_days.select("day").distinct().groupBy(fx.monday(F.col("day")).alias("week")).agg(F.count("*").alias("run_dates"))
    rows = weeks.join(days, "week", "left")
    return rows.select("week", F.date_add("week", 6).alias("week_end"), "n", F.coalesce("run_dates", F.lit(0)).alias("run_dates"))


def week_edges(weeks: DataFrame, outages: list[tuple[str, str]]) -> DataFrame:
    """Weeks with an annotation: the first, the last, or one that overlaps a declared outage."""
    ends = weeks.agg(F.min("week").alias("_first"), F.max("week").alias("_last"))
    rows = weeks.join(F.broadcast(ends))  # one row
    hit = F.lit(False)
    for a, b in outages:
        hit |= (F.col("week") <= F.lit(b).cast("date")) & (F.col("week_end") >= F.lit(a).cast("date"))
    note = F.when(F.col("week") == F.col("_first"), "first").when(F.col("week") == F.col("_last"), "last").when(hit, "outage")
    return rows.withColumn("annotation", note).drop("_first", "_last")


def daily_series(records: DataFrame, as_of: str, days: int = 30, date: str = "published_date") -> DataFrame:
    """(day, n) of each of the last days, those without records 0."""
    last = F.lit(as_of).cast("date")
    spine = records.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counts = records.filter(F.col(date).between(F.date_sub(last, days - 1), last)).groupBy(F.col(date).cast("date").alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def collection_gaps(days: DataFrame, least: int = 2, day: str = "day", group: str | None = None) -> DataFrame:
    """(gap_from, gap_to, n_days) of runs of least days or more without one, by group if given; the distinct days of a store are few (one a day of operation)."""
    keys = [group] if group else []
    single = days.select(*keys, F.col(day).cast("date").alias("a")).filter("a is not null").distinct()
    rows = single.withColumn("b", F.lead("a").over(Window.partitionBy(*keys).orderBy("a"))).withColumn("n_days", F.datediff("b", "a") - 1)
    return rows.filter(F.col("n_days") >= least).select(*keys, F.date_add("a", 1).alias("gap_from"), F.date_sub("b", 1).alias("gap_to"), "n_days")


def cadence_gaps(editions: DataFrame, days: int = 7, date: str = "date") -> DataFrame:
    """Editions that don't follow the one before by days."""
    rows = editions.withColumn("previous", F.lag(date).over(Window.orderBy(date)))
    return rows.withColumn("gap", F.datediff(date, "previous")).filter(F.col("gap") != days)


def edition_sequence(editions: DataFrame, date: str = "date") -> DataFrame:
    """Editions with issue number, previous and next."""
    w = Window.orderBy(date)
    return editions.withColumns({"issue": F.row_number().over(w), "previous": F.lag(date).over(w), "next": F.lead(date).over(w)})


def top_values(records: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return records.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def window_stats(records: DataFrame, as_of: str, spans: tuple[int, ...] = (7, 30), date: str = "published_date", flag: str = "significant") -> DataFrame:
    """(days, n, n_significant) of the last days, one scan for all spans."""
    last = F.lit(as_of).cast("date")
    hit = lambda d: F.col(date).between(F.date_sub(last, d), last)
    cells = [F.struct(F.lit(d).alias("days"), F.count_if(hit(d)).alias("n"), F.count_if(hit(d) & F.col(flag)).alias("n_significant")) for d in spans]
    return records.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def source_trail(records: DataFrame, group: str, cap: int = TRAIL) -> DataFrame:
    """The first cap records of each group, flagged ones first (by id), then by score, with place and truncated.

    Groups are ranked by salted top-k: each part of a group keeps cap rows before they meet.
    """
    order = [F.desc("significant"), F.when(F.col("significant"), F.lit(0.0)).otherwise(F.coalesce("score", F.lit(0.0))).desc(), F.asc("id")]
    sizes = records.groupBy(group).agg(F.count("*").alias("n"))
    salted = records.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    part = salted.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_salt").orderBy(*order))).filter(F.col("_r") <= cap)
    best = part.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= cap)
    return best.drop("_r", "_salt").join(sizes, group).withColumn("truncated", F.col("n") > cap).drop("n")


def article_order(flag: Column, categories: Column, score: Column, priority: dict[str, int], tie: Column) -> list[Column]:
    """Order of a daily list: flagged, best category priority, score, then the tie-break."""
    ranks = F.array_min(F.transform(categories, lambda c: fx.mapped(priority, c, 99)))
    return [F.desc(F.coalesce(flag, F.lit(False))), F.coalesce(ranks, F.lit(99)).asc(), F.coalesce(score, F.lit(0.0)).desc(), tie.asc()]


def numbered(records: DataFrame, order: list[Column], group: str | None = None, name: str = "place") -> DataFrame:
    """records with their place in order from 1, by group if given.

    Ranges of (group, order) are numbered apart and shifted by what their
    group has in the ranges before. Only groups that go on from one range to
    the next need that: at most one row a range, which is broadcast.
    """
    parts = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = records.withColumn("_g", F.col(group) if group else F.lit(0))
    # A checkpoint fixes the ranges: both uses below must see the same partitions.
    placed = checkpointed(rows.repartitionByRange(parts, "_g", *order).withColumn("_p", F.spark_partition_id()))
    placed = placed.withColumn("_r", F.row_number().over(Window.partitionBy("_p", "_g").orderBy(*order)).cast("long"))
    sizes = placed.groupBy("_p", "_g").agg(F.count("*").alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.withColumn("_before", ahead).filter("_before is not null").select("_p", "_g", "_before")
    out = placed.join(F.broadcast(before), ["_p", "_g"], "left")
    return out.withColumn(name, F.col("_r") + F.coalesce("_before", F.lit(0))).drop("_p", "_g", "_r", "_before")


def pages(records: DataFrame, order: list[Column], size: int = 50, group: str | None = None) -> DataFrame:
    """Records with place and page from 1, size to a page (by group if given)."""
    return numbered(records, order, group).withColumn("page", F.ceil(F.col("place") / size))


def budgeted_pages(records: DataFrame, order: list[Column], group: str, size_of: Column, budget: int = 120_000, size: int = 50) -> DataFrame:
    """Pages of the largest size of 50, 25, 12, ... whose pages all keep the byte budget (1 at last), by group."""
    sizes = []
    while size >= 1:
        sizes.append(size)
        size //= 2
    placed = records.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).withColumn("_b", size_of)
    tried = placed.withColumn("_size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("page", F.ceil(F.col("place") / F.col("_size")).cast("int"))
    sums = tried.groupBy(group, "_size", "page").agg(F.sum("_b").alias("_sum"))
    fits = sums.groupBy(group, "_size").agg(F.max("_sum").alias("_most")).filter((F.col("_most") <= budget) | (F.col("_size") == 1))
    best = fits.groupBy(group).agg(F.max("_size").alias("per_page"))
    return placed.join(best, group).withColumn("page", F.ceil(F.col("place") / F.col("per_page")).cast("int")).drop("_b")


def bars(counts: DataFrame, n: str = "n") -> DataFrame:
    """Counts with their share of the greatest in per cent, one decimal."""
    most = counts.agg(F.max(n).alias("_most"))
    return counts.join(F.broadcast(most)).withColumn("height", F.round(F.col(n) * 100 / F.col("_most"), 1)).drop("_most")  # one row


def guide_stats(corpus: DataFrame) -> DataFrame:
    """One row of counts over the corpus: states, blanks, span, languages, the largest source's share."""
    by_source = corpus.groupBy("source").agg(F.count("*").alias("n"))
    top = by_source.agg(F.max_by("source", F.struct("n", "source")).alias("top_source"), F.max("n").alias("top_n"))
    row = corpus.agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in STATES],
        F.count_if(fx.is_blank(F.col("title"))).alias("n_blank_title"),
        F.count_if(F.coalesce(F.col("significant"), F.lit(False))).alias("n_flagged"),
        F.count_distinct("language").alias("n_languages"),
        F.count_distinct("source").alias("n_sources"),
        F.min("published_date").alias("first_date"),
        F.max("published_date").alias("last_date"),
    )
    return row.join(F.broadcast(top)).withColumn("top_share", F.round(F.col("top_n") * 100 / F.col("n"), 1))  # one row each


def corpus_guide(corpus: DataFrame, run_days: DataFrame, outage: tuple[str, str]) -> DataFrame:
    """Every figure of the corpus guide in one row, from records (id, state, source_name, institution, published_date, title_english, summary_english, model_id, text_original, prompt_version) and the days of runs (day).

    no_english, no_summary and no_model are the records whose title, summary
    or model is blank, english_sets_identical whether these and the records
    that aren't analyzed are the same. outage_records were published in the
    days of outage; gap_from, gap_to and gap_days are the first gap of the
    runs. An empty corpus counts 0, with a share of 0 and no institution.
    """
    blank = {"no_english": "title_english", "no_summary": "summary_english", "no_model": "model_id"}
    is_blank = {name: fx.is_blank(F.col(c)) for name, c in blank.items()}
    other = F.col("state") != "analyzed"
    differ = reduce(or_, [test != other for test in is_blank.values()])
    state = lambda *s: F.count_if(F.col("state").isin(*s))
    row = corpus.agg(
        F.count("*").alias("total"),
        F.coalesce(F.max("id"), F.lit(0)).alias("max_id"),
        *[state(s).alias(s) for s in ("awaiting_screening", "analysis_incomplete", "not_selected", "analyzed")],
        state("awaiting_screening", "analysis_incomplete").alias("backlog"),
        *[F.count_if(test).alias(name) for name, test in is_blank.items()],
        F.count_if(other).alias("non_analyzed"),
        (F.count_if(differ) == 0).alias("english_sets_identical"),
        F.count_if(F.col("published_date").between(*[F.lit(d).cast("date") for d in outage])).alias("outage_records"),
        F.count_if(fx.is_blank(F.col("text_original"))).alias("empty_text"),
        F.count_if(~other & fx.is_blank(F.col("prompt_version"))).alias("prompt_version_missing"),
        F.count_distinct(F.nullif("institution", F.lit(""))).alias("institutions"),
        F.count_distinct("source_name").alias("outlets"),
        F.min("published_date").alias("first_date"),
        F.max("published_date").alias("last_date"),
    )
    by_institution = corpus.filter(F.coalesce("institution", F.lit("")) != "").groupBy("institution").agg(F.count("*").alias("n"))
    top = by_institution.agg(F.min_by("institution", F.struct(-F.col("n"), "institution")).alias("top_institution"), F.coalesce(F.max("n"), F.lit(0)).alias("top_institution_count"))
    gap = collection_gaps(run_days).agg(F.min(F.struct("gap_from", "gap_to", "n_days")).alias("g")).select("g.gap_from", "g.gap_to", F.col("g.n_days").alias("gap_days"))
    found = row.join(F.broadcast(top)).join(F.broadcast(gap))  # one row each
    return found.withColumn("top_institution_pct", F.when(F.col("total") > 0, F.round(F.col("top_institution_count") * 100 / F.col("total"), 1)).otherwise(0.0))
