"""Collection outcomes: per-source status, attribution, run status, silence and liveness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed vocabulary of outcomes (fixed values): good, neutral and failed ones.
SUCCESS = ["OK", "OK_NO_PUBLICATIONS", "OK_ALL_DUPLICATES", "OK_ALL_FILTERED"]
NEUTRAL = ["SKIPPED_DISABLED", "NOT_IMPLEMENTED"]
DEFAULT_SILENCE_DAYS = 7


def outcome(enabled: Column, implemented: Column, listed: Column, references: Column, fetched: Column, extracted: Column, failed: Column) -> Column:
    """The outcome of one source: which kind of nothing it was, if nothing came.

    A listing that broke off is a failure; with references the listing was
    right, whatever else failed and whether or not the source is a stub; without
    any, failed fetches come before being a stub.
    """
    return (
        F.when(~enabled, "SKIPPED_DISABLED")
        .when(~listed | ((references == 0) & (failed > 0)), "LISTING_FAILURE")
        .when((references == 0) & ~implemented, "NOT_IMPLEMENTED")
        .when(references == 0, "OK_NO_PUBLICATIONS")
        .when(fetched == 0, "FETCH_FAILURE")
        .when(extracted == 0, "EXTRACTION_FAILURE")
        .otherwise("OK")
    )


def attribution(results: DataFrame, counts: DataFrame, source: str = "source") -> DataFrame:
    """Results with duplicates, new_documents and relevance_rejected from counts (source, scraped, fresh, inserted, rejected).

    An OK source that added nothing becomes OK_ALL_DUPLICATES or else OK_ALL_FILTERED.
    """
    n = lambda c: F.coalesce(c, F.lit(0))
    rows = results.join(counts, source, "left")
    rows = rows.withColumns(
        {
            "duplicates": F.greatest(F.lit(0), n("scraped") - n("fresh")),
            "new_documents": n("inserted"),
            "relevance_rejected": n("rejected"),
        }
    )
    idle = (F.col("status") == "OK") & (F.col("new_documents") == 0)
    status = F.when(idle & (F.col("duplicates") > 0), "OK_ALL_DUPLICATES").when(idle & (F.col("relevance_rejected") > 0), "OK_ALL_FILTERED")
    return rows.withColumn("status", F.coalesce(status, "status")).drop("scraped", "fresh", "inserted", "rejected")


def run_status(results: DataFrame, runs: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, n_sources, n_failed, status) of runs (run) by their results (run, status, is_failure).

    failed: all collectible sources failed, or the run has no result at all;
    degraded: some failed, or none was collectible; else completed.
    """
    open_to = ~F.col("status").isin(NEUTRAL)
    found = results.groupBy(run).agg(
        F.count("*").alias("n_sources"),
        F.count_if(open_to).alias("_open"),
        F.count_if(open_to & F.col("is_failure")).alias("n_failed"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_sources", "n_failed", "_open")}
    rows = runs.select(run).distinct().join(found, run, "left").withColumns(zero)
    status = (
        F.when(F.col("n_sources") == 0, "failed")
        .when(F.col("_open") == 0, "degraded")
        .when(F.col("n_failed") == F.col("_open"), "failed")
        .when(F.col("n_failed") > 0, "degraded")
        .otherwise("completed")
    )
    return rows.withColumn("status", status).drop("_open")


def silence(days: Column, threshold: Column | None = None) -> Column:
    limit = F.lit(DEFAULT_SILENCE_DAYS) if threshold is None else F.when(threshold > 0, threshold).otherwise(DEFAULT_SILENCE_DAYS)
    return F.when(days.isNull(), "unknown").when(days <= limit, "within_cadence").otherwise("overdue")


def liveness(sources: DataFrame, articles: DataFrame, as_of: str, inert: list[str], key: str = "source", seen: str = "scraped_on", threshold: str | None = None) -> DataFrame:
    """(source, n, last_seen, days_silent, state) of all sources, those without articles too."""
    found = articles.groupBy(key).agg(F.count("*").alias("n"), F.max(seen).alias("last_seen"))
    rows = sources.join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    days = F.datediff(F.lit(as_of).cast("date"), F.col("last_seen"))
    limit = F.coalesce(F.col(threshold), F.lit(DEFAULT_SILENCE_DAYS)) if threshold else F.lit(DEFAULT_SILENCE_DAYS)
    state = F.when(F.col(key).isin(inert), "INERT").when(F.col("last_seen").isNull(), "UNHEALTHY").when(days > limit, "UNHEALTHY").otherwise("HEALTHY")
    return rows.select(key, "n", "last_seen", days.alias("days_silent"), state.alias("state"))


def last_success(results: DataFrame, source: str = "source", at: str = "completed_at") -> DataFrame:
    """(source, last_new, last_ok, latest_status) by source."""
    return results.groupBy(source).agg(
        F.max(F.when(F.col("new_documents") > 0, F.col(at))).alias("last_new"),
        F.max(F.when(~F.col("is_failure"), F.col(at))).alias("last_ok"),
        F.max_by("status", F.struct(at, "result_id")).alias("latest_status"),
    )


def upsert_results(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """old with the rows of new by key; where both have one, the columns keep are old's, nulls too, and the others new's."""
    a, b = old.withColumn("_old", F.lit(True)).alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    older, there = F.col("a._old").isNotNull(), F.col("b._new").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"a.{c}", f"b.{c}")
        if c in keep:
            return F.when(older, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}"))
        return F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return joined.select(*[pick(c).alias(c) for c in old.columns])


def day_clock(runs: DataFrame, ok: str = "ok", at: str = "finished_at") -> DataFrame:
    """Runs with day_zero (the first success, never moved by failures or later runs) and the whole days since.

    A failed run has no day, and no day_zero before the first success.
    """
    zero = runs.filter(F.col(ok)).agg(F.min(at).alias("_zero"))
    rows = runs.drop("_zero").join(F.broadcast(zero))  # one row
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    day = F.when(F.coalesce(ok, F.lit(False)), F.floor((micros(at) - micros("_zero")) / 86_400_000_000))
    return rows.withColumns({"day_zero": F.when(F.col(at) >= F.col("_zero"), F.col("_zero")), "day": day}).drop("_zero")


def run_rows(entries: DataFrame) -> DataFrame:
    """The runs of a ledger (versions.LEDGER): started_at, completed_at, counts, errors as a JSON list, status.

    A run that wasn't closed is 'running', with null counts, errors and end; one
    that was closed without being opened has no start. Of repeated entries the
    earliest of each event counts. Null ids are one run like others.
    """
    closing = F.when(F.col("event") == "closed", F.col("at"))
    last = ["articles_scraped", "articles_new", "articles_analyzed", "errors", "status"]
    body = F.struct(*[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c == "errors" else F.col(c) for c in last])
    found = entries.groupBy("run_id").agg(F.min(F.when(F.col("event") == "opened", F.col("at"))).alias("started_at"), F.min(closing).alias("completed_at"), F.min_by(body, closing).alias("c"))
    counts = [F.col(f"c.{c}").alias(c) for c in last[:3]]
    return found.select("run_id", "started_at", "completed_at", *counts, F.to_json("c.errors").alias("errors"), F.when(F.col("completed_at").isNull(), "running").otherwise(F.col("c.status")).alias("status"))


def collected(captures: DataFrame, extracted: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, status, references, fetched, extracted, failed, note) of every source in the registry (source, enabled, implemented).

    captures (source, status, url) has a row for each reference, OK if it was
    fetched, and a LISTING_FAILURE without a url where the listing broke off; extracted
    (source, url) the documents that came out. The note tells how many
    captures gave no document where some did. Captures of sources that the
    registry lacks are no source's; repeated references count once.
    """
    one = captures.filter("url is not null").groupBy("source", "url").agg(F.max((F.col("status") == "OK").cast("int")).alias("ok"))
    listings = captures.filter("url is null and status = 'LISTING_FAILURE'").groupBy("source").agg(F.count("*").alias("broken"))
    documents = extracted.select("source", "url").distinct().withColumn("out", F.lit(1))
    found = one.join(documents, ["source", "url"], "left").groupBy("source")
    counts = found.agg(F.count("*").alias("references"), F.sum("ok").alias("fetched"), F.coalesce(F.sum(F.when(F.col("ok") == 1, F.col("out"))), F.lit(0)).alias("extracted"))
    rows = registry.join(counts, "source", "left").join(listings, "source", "left").fillna(0, ["references", "fetched", "extracted", "broken"])
    rows = rows.withColumn("failed", F.col("references") - F.col("fetched"))
    status = outcome(F.col("enabled"), F.col("implemented"), F.col("broken") == 0, F.col("references"), F.col("fetched"), F.col("extracted"), F.col("failed"))
    lost = F.col("fetched") - F.col("extracted")
    note = F.when((status == "OK") & (lost > 0), F.concat(lost.cast("string"), F.lit(" of "), F.col("fetched").cast("string"), F.lit(" items failed extraction")))
    return rows.select("source", status.alias("status"), "references", "fetched", "extracted", "failed", note.alias("note"))
