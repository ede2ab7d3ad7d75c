"""Quality gates: rules as violation counts over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose key no parent has (null keys are orphans too)."""
    return child.join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def rule_counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row rules in one scan; a rule is true where it is broken."""
    cells = [F.struct(F.lit(k).alias("rule"), F.count_if(v).alias("violations")) for k, v in rules.items()]
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def article_rules() -> dict[str, Column]:
    """Rules of published records: dates of the right shape and calendar, no blank summary or title."""
    date = F.coalesce(F.col("published_date").cast("string"), F.lit(""))
    return {
        "blank_date": date == "",
        "malformed_date": (date != "") & fx.calendar_date(date).isNull(),
        "blank_title": fx.is_blank(F.col("title")),
        "blank_text": fx.is_blank(F.col("text")),
    }


def edition_rules() -> dict[str, Column]:
    """Rules of editions: a span of seven days to the edition's date, counts that agree with the trail."""
    trail = F.size("source_trail")
    return {
        "span": F.datediff("week_ending", "week_start") != 6,
        "date_is_week_end": F.col("date") != F.col("week_ending"),
        "trail_beyond_articles": trail > F.col("n_articles"),
        "flagged_beyond_articles": F.col("n_significant") > F.col("n_articles"),
        "trail_outside_week": F.exists("source_trail", lambda t: ~t["date"].between(F.col("week_start"), F.col("week_ending"))),
    }


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(side, key) of what is expected and not found, and found and not expected."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    missing = a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key)
    return missing.union(b.join(a, key, "left_anti").select(F.lit("extra").alias("side"), key))


def unrendered(texts: DataFrame, column: str = "value") -> DataFrame:
    """Rows with template markers left in them."""
    return texts.filter(F.col(column).rlike("\\{\\{|\\}\\}|\\{%|%\\}"))


def declared_snapshot(fingerprint: DataFrame, expected_records: int | None, expected_words: list[int] | None) -> DataFrame:
    """(name, violations) of a fingerprint (n, h0..h3) against what was declared; a declared null opts out."""
    words = [F.col(f"h{k}") != F.lit(w) for k, w in enumerate(expected_words or [])]
    checks = [("record_count", F.col("n") != F.lit(expected_records) if expected_records is not None else F.lit(False)), ("fingerprint", reduce(lambda x, y: x | y, words, F.lit(False)))]
    return reduce(DataFrame.union, [fingerprint.select(F.lit(name).alias("name"), test.cast("int").cast("long").alias("violations")) for name, test in checks])


def prose_findings(text: Column, words: int = 30) -> Column:
    """Findings on a paragraph: long sentences, exclamation, double spaces."""
    sentences = F.split(text, "(?<=[.!?])\\s+")
    longest = F.array_max(F.transform(sentences, lambda s: F.size(F.split(s, "\\s+"))))
    checks = [F.when(longest > words, "long sentence"), F.when(text.contains("!"), "exclamation"), F.when(text.contains("  "), "double space")]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def manifest_rules(sources: DataFrame, institutions: DataFrame) -> DataFrame:
    """(rule, key) of registry rows that break a rule: repeated slugs, unknown institutions, cadence, language tags."""
    parts = [
        sources.groupBy("slug").count().filter("count > 1").select(F.lit("repeated_slug").alias("rule"), F.col("slug").alias("key")),
        sources.join(institutions.select("institution_id"), "institution_id", "left_anti").select(F.lit("unknown_institution"), "slug"),
        sources.filter("expected_cadence_days <= 0").select(F.lit("cadence_not_positive"), "slug"),
        sources.filter(~fx.is_language_tag(F.col("language_tag"))).select(F.lit("language_tag"), "slug"),
        institutions.join(institutions.select(F.col("institution_id").alias("parent_id")), "parent_id", "left_anti").filter("parent_id is not null").select(F.lit("unknown_parent"), F.col("institution_id").cast("string")),
    ]
    return reduce(DataFrame.union, parts)
