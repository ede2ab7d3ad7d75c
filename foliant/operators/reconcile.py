"""Three-way reconcile of diverged snapshots: local-only rows, backfill, results, and the gates on the outcome."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.lineage import numbered

#: Columns of a decided analysis that a backfill copies (fixed values); prompt_version stays behind unless asked for.
ANALYSIS = [
    "relevance_score", "relevance_reasoning", "passed_relevance", "title_english", "text_english",
    "summary_english", "analyzed_at", "is_significant", "significance_reasoning", "model_id",
]


def renumbered(rows: DataFrame, start: DataFrame, key: str = "id") -> DataFrame:
    """rows with new_id: numbers above the greatest key of start, in key order."""
    top = start.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
    out = numbered(rows, order=key, into="new_id").join(F.broadcast(top))
    return out.withColumn("new_id", F.col("_top") + F.col("new_id")).drop("_top")


def local_only(local: DataFrame, origin: DataFrame, url: str = "url") -> DataFrame:
    return local.join(origin.select(url).distinct(), url, "left_anti")


def _first_by_url(local: DataFrame, url: str) -> DataFrame:
    """local with one row for each URL, the one of the least id."""
    first = local.groupBy(url).agg(F.min("id").alias("id"))
    return local.join(first, [url, "id"], "left_semi")


def reconcile_articles(origin: DataFrame, local: DataFrame, url: str = "url", fields: list[str] = ANALYSIS) -> DataFrame:
    """origin with the decisions that only local has, and local's own rows with ids above origin's.

    A shared row takes local's fields where local decided and origin is
    pending, by analyzed_at or by passed_relevance. Both sides must have all
    fields. Of rows of local with one URL, that of the least id counts.
    """
    for side, df in (("origin", origin), ("local", local)):
        if lacking := [c for c in fields if c not in df.columns]:
            raise ValueError(f"{side} lacks the analysis columns {lacking}")
    local = _first_by_url(local, url)
    pending = F.col("o.analyzed_at").isNull() & F.col("l.analyzed_at").isNotNull() | F.col("o.passed_relevance").isNull() & F.col("l.passed_relevance").isNotNull()
    joined = origin.alias("o").join(local.alias("l"), F.col(f"o.{url}") == F.col(f"l.{url}"), "left")
    shared = joined.select(*[F.when(pending, F.col(f"l.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in fields else F.col(f"o.{c}") for c in origin.columns])
    new = renumbered(local_only(local, origin, url), origin).withColumn("id", F.col("new_id")).select(origin.columns)
    return shared.union(new)


def run_map(base: DataFrame, origin: DataFrame, local: DataFrame) -> DataFrame:
    """(scrape_run_id, new_run): the runs that local wrote itself, numbered above origin's."""
    own = local.select("id").join(base.select("id"), "id", "left_anti")
    return renumbered(own, origin).select(F.col("id").alias("scrape_run_id"), F.col("new_id").alias("new_run"))


def in_terms_of(local: DataFrame, runs: DataFrame, local_sources: DataFrame, sources: DataFrame) -> DataFrame:
    """local articles with the run ids of run_map and, by slug, the source ids of the other snapshot; source_slug is added.

    A slug that the other snapshot lacks gives a null source_id: unresolved() lists those.
    """
    own = local_sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"))
    other = sources.select(F.col("slug").alias("source_slug"), F.col("id").alias("_source"))
    rows = local.join(own, "source_id", "left").join(other, "source_slug", "left").join(runs, "scrape_run_id", "left")
    moved = rows.withColumns({"source_id": F.col("_source"), "scrape_run_id": F.coalesce("new_run", "scrape_run_id")})
    return moved.select(*local.columns, "source_slug")


def unresolved(local: DataFrame) -> DataFrame:
    """(url, source_slug) of articles of in_terms_of() without a source in the other snapshot; must be empty."""
    return local.filter("source_id is null").select("url", "source_slug")


def merged_links(origin_links: DataFrame, local_links: DataFrame, local: DataFrame, origin: DataFrame, merged: DataFrame) -> DataFrame:
    """origin's category links, and local's for the articles that are local's own or were backfilled, by URL."""
    taken = origin.select("url", F.col("analyzed_at").alias("_a"), F.col("passed_relevance").alias("_p")).alias("o")
    now = merged.select("url", F.col("id").alias("_id"), "analyzed_at", "passed_relevance").join(taken, "url", "left")
    fresh = now.filter("_a is null and analyzed_at is not null or _p is null and passed_relevance is not null")
    ids = local.select(F.col("id").alias("article_id"), "url").join(fresh.select("url", "_id"), "url")
    own = now.join(origin.select("url"), "url", "left_anti")
    ids = ids.union(local.select(F.col("id").alias("article_id"), "url").join(own.select("url", "_id"), "url").select(ids.columns)).distinct()
    moved = local_links.join(ids, "article_id").select(F.col("_id").alias("article_id"), "category")
    return origin_links.select("article_id", "category").union(moved).distinct()


def placed_results(local: DataFrame, base_runs: DataFrame, local_runs: DataFrame, runs: DataFrame) -> DataFrame:
    """local per-source results with their run in the merge, mapped; unmapped where its lineage can't be proven (null)."""
    inherited = base_runs.select("id").join(local_runs.select("id"), "id").select(F.col("id").alias("scrape_run_id"), F.col("id").alias("_same"))
    rows = local.join(runs, "scrape_run_id", "left").join(inherited, "scrape_run_id", "left")
    return rows.withColumn("mapped", F.coalesce("new_run", "_same")).drop("new_run", "_same")


def merged_results(origin: DataFrame, placed: DataFrame, keys: tuple[str, str] = ("scrape_run_id", "source_slug")) -> DataFrame:
    """origin's results and local's (placed) under keys that origin lacks; origin wins where both have one."""
    moved = placed.filter("mapped is not null").withColumn("scrape_run_id", F.col("mapped"))
    return origin.union(moved.join(origin.select(*keys), list(keys), "left_anti").select(origin.columns))


def attribution_conflicts(origin: DataFrame, local: DataFrame, url: str = "url", source: str = "source") -> DataFrame:
    """Shared URLs that the two snapshots give to different sources; must be empty."""
    pair = origin.select(url, F.col(source).alias("origin_source")).join(local.select(url, F.col(source).alias("local_source")), url)
    return pair.filter(~F.col("origin_source").eqNullSafe(F.col("local_source")))


def accounting(before: DataFrame, after: DataFrame, key: list[str], payload: list[str]) -> DataFrame:
    """(missing, extra, altered) counts of after against before by key."""
    a = before.select(*key, F.xxhash64(*payload).alias("_a"), F.lit(1).alias("_l"))
    b = after.select(*key, F.xxhash64(*payload).alias("_b"), F.lit(1).alias("_r"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_r").isNull()).alias("missing"),
        F.count_if(F.col("_l").isNull()).alias("extra"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("altered"),
    )


def _counted(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(name, violations): the sums of the rules' figures over rows, in one pass."""
    cells = [F.struct(F.lit(k).alias("name"), F.coalesce(F.sum(v.cast("long")), F.lit(0)).alias("violations")) for k, v in rules.items()]
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def _sides(sides: dict[str, DataFrame], keys: list[str], values: list[Column]) -> DataFrame:
    """All sides' keys and values below one another, with the side's name: one shuffle by key serves every comparison."""
    return reduce(DataFrame.unionByName, [df.select(*keys, F.lit(name).alias("side"), *values) for name, df in sides.items()])


def _differ(a: str, b: str) -> Column:
    """Whether the values v of two sides are not one and the same, nulls equal (an absent side has no row to differ)."""
    return ~(F.col(f"least_{a}").eqNullSafe(F.col(f"least_{b}")) & F.col(f"most_{a}").eqNullSafe(F.col(f"most_{b}")))


def gates(base: DataFrame, origin: DataFrame, local: DataFrame, merged: DataFrame, url: str = "url", source: str = "source_slug") -> DataFrame:
    """(name, violations) of the merged articles; all must be 0 before they are published. Ids may not move against base.

    Violations count URLs (duplicate_id: ids). The four snapshots are grouped
    once, by URL and, for merged, by id, with what each has there; a null source is a source of its own.
    """
    names = ["base", "origin", "local", "merged"]
    no_source = lambda df: df if source in df.columns else df.withColumn(source, F.lit(None).cast("string"))
    sides = {k: no_source(df) for k, df in zip(names, (base, origin, local, merged))}
    # A merged row stands under its URL and under its id, so that the merge is computed once.
    under = F.array(F.struct(F.lit("url").alias("by"), F.lit(None).cast(merged.schema["id"].dataType).alias("key")), F.struct(F.lit("id").alias("by"), F.col("id").alias("key")))
    sides = {k: df.withColumn("_at", F.explode(under if k == "merged" else F.slice(under, 1, 1))) for k, df in sides.items()}
    sides = {k: df.withColumns({"_by": F.col("_at.by"), "_key": F.col("_at.key").cast("string"), url: F.when(F.col("_at.by") == "url", F.col(url))}) for k, df in sides.items()}
    every = _sides(sides, ["_by", "_key", url], [F.col("id"), F.col("passed_relevance").isNotNull().alias("decided"), F.struct(F.col(source).cast("string").alias("s")).alias("v")])
    at = lambda side, x: F.when(F.col("side") == side, x)
    figures = [f for k in names for f in (F.count(at(k, F.lit(1))).alias(f"n_{k}"), F.min(at(k, F.col("v"))).alias(f"least_{k}"), F.max(at(k, F.col("v"))).alias(f"most_{k}"))]
    figures += [f for k in ("base", "merged") for f in (F.min(at(k, F.col("id"))).alias(f"least_id_{k}"), F.max(at(k, F.col("id"))).alias(f"most_id_{k}"))]
    figures += [F.count_if((F.col("side") == k) & F.col("decided")).alias(f"decided_{k}") for k in names]
    grouped = every.groupBy("_by", "_key", url).agg(*figures)
    has = {k: F.col(f"n_{k}") > 0 for k in names}
    undecided = F.col("decided_merged") < F.col("n_merged")
    rules = {
        "duplicate_url": (F.col("_by") == "url") & (F.col("n_merged") > 1),
        "id_drift": has["base"] & has["merged"] & ((F.col("least_id_base") != F.col("least_id_merged")) | (F.col("most_id_base") != F.col("most_id_merged"))),
        "origin_url_lost": has["origin"] & ~has["merged"],
        "local_url_lost": has["local"] & ~has["merged"],
        "origin_decision_lost": has["merged"] & (F.col("decided_origin") > 0) & undecided,
        "local_decision_lost": has["merged"] & (F.col("decided_local") > 0) & undecided,
        "source_conflict": has["origin"] & has["local"] & _differ("origin", "local"),
        "origin_source_changed": has["origin"] & has["merged"] & _differ("origin", "merged"),
        "local_source_changed": has["local"] & ~has["origin"] & has["merged"] & _differ("local", "merged"),
        "duplicate_id": (F.col("_by") == "id") & (F.col("n_merged") > 1),
    }
    return _counted(grouped, rules)


def result_gates(origin: DataFrame, placed: DataFrame, merged: DataFrame, runs: DataFrame, payload: list[str], keys: tuple[str, str] = ("scrape_run_id", "source_slug")) -> DataFrame:
    """(name, violations) of the merged per-source results against both inputs and the merged runs; rows, by one grouping of all three."""
    on = list(keys)
    moved = placed.filter("mapped is not null").withColumn("scrape_run_id", F.col("mapped"))
    every = _sides({"origin": origin, "local": moved, "merged": merged}, on, [F.struct(*payload).alias("v")])
    at = lambda side, x: F.when(F.col("side") == side, x)
    names = ["origin", "local", "merged"]
    by_key = every.groupBy(*on).agg(*[f for k in names for f in (F.count(at(k, F.lit(1))).alias(f"n_{k}"), F.min(at(k, F.col("v"))).alias(f"least_{k}"), F.max(at(k, F.col("v"))).alias(f"most_{k}"))])
    known = runs.select(F.col("id").alias(on[0])).distinct().withColumn("_run", F.lit(True))
    by_key = by_key.join(known, on[0], "left")
    n = {k: F.col(f"n_{k}") for k in names}
    there = n["merged"] > 0
    rules = {
        "origin_result_lost": F.when(~there, n["origin"]),
        "origin_result_altered": (n["origin"] > 0) & there & _differ("origin", "merged"),
        "local_result_lost": F.when(~there, n["local"]),
        "local_result_altered": (n["local"] > 0) & (n["origin"] == 0) & there & _differ("local", "merged"),
        "result_of_neither": F.when((n["origin"] == 0) & (n["local"] == 0), n["merged"]),
        "duplicate_result": n["merged"] > 1,
        "result_without_run": F.when(F.col("_run").isNull(), n["merged"]),
    }
    return _counted(by_key, rules).union(_counted(placed, {"local_result_unproven": F.col("mapped").isNull()}))


def schema_gates(merged: dict[str, DataFrame], required: list[str], migrations: DataFrame, ledger: list[str], accepted: list[str], inputs: list[DataFrame]) -> DataFrame:
    """(name, violations) of the merge as a whole: missing tables, migrations that its ledger (version) lacks, statuses of the inputs' runs that it doesn't accept."""
    spark = migrations.sparkSession
    wanted = spark.createDataFrame([(x,) for x in ledger], "version string")
    lacking = wanted.join(migrations.select(F.col("version").cast("string")), "version", "left_anti").agg(F.lit("migration_missing").alias("name"), F.count("*").alias("violations"))
    statuses = reduce(DataFrame.union, [df.select("status").distinct() for df in inputs]).distinct()
    refused = statuses.agg(F.lit("status_not_accepted").alias("name"), F.count_if(F.col("status").isNotNull() & ~F.col("status").isin(accepted)).alias("violations"))
    absent = spark.createDataFrame([("table_missing", sum(t not in merged for t in required))], "name string, violations long")
    return absent.union(lacking).union(refused)


def preflight(snapshots: dict[str, dict[str, DataFrame]], required: dict[str, list[str]], references: list[tuple[str, str, str]]) -> DataFrame:
    """(snapshot, problem, n) of all inputs: tables and columns that are missing, repeated ids, and references (table, column, table) to no row.

    A missing table is a problem, never an empty one.
    """
    spark = next(df for tables in snapshots.values() for df in tables.values()).sparkSession
    found: list[tuple[str, str, int]] = []
    counted: list[DataFrame] = []
    for name, tables in snapshots.items():
        for wanted, columns in required.items():
            if wanted not in tables:
                found.append((name, f"no table {wanted}", 1))
                continue
            found += [(name, f"no column {wanted}.{c}", 1) for c in columns if c not in tables[wanted].columns]
            if "id" in columns and "id" in tables[wanted].columns:
                again = tables[wanted].groupBy("id").count().filter("count > 1")
                counted.append(again.agg(F.lit(name).alias("snapshot"), F.lit(f"repeated {wanted}.id").alias("problem"), F.count("*").alias("n")))
        for a, column, b in references:
            if a in tables and b in tables and column in tables[a].columns:
                lost = tables[a].filter(F.col(column).isNotNull()).join(tables[b].select(F.col("id").alias(column)), column, "left_anti")
                counted.append(lost.agg(F.lit(name).alias("snapshot"), F.lit(f"{a}.{column} without {b}").alias("problem"), F.count("*").alias("n")))
    fixed = spark.createDataFrame(found, "snapshot string, problem string, n long")
    return reduce(DataFrame.union, counted, fixed).filter("n > 0")
