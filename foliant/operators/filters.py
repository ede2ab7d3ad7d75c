"""Splits, searches and predicates over the corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx

#: Least score of a relevant record (inclusive).
RELEVANCE = 0.60


def has_keyword(exact: list[str], folded: list[str], title: str = "title", text: str = "text") -> Column:
    """Whether title or text contains one of the exact words, or of the folded ones in any case."""
    both = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(text, F.lit("")))
    tests = [F.lit(False)]
    if exact:
        tests.append(both.rlike("|".join(map(re.escape, exact))))
    if folded:
        tests.append(F.lower(both).rlike("|".join(re.escape(w.lower()) for w in folded)))
    return tests[0] | tests[-1] if len(tests) < 3 else tests[1] | tests[2]


def keyword_split(articles: DataFrame, exact: list[str], folded: list[str]) -> tuple[DataFrame, DataFrame]:
    """(passed, rejected): the two parts together are all rows."""
    found = has_keyword(exact, folded)
    return articles.filter(found), articles.filter(~found)


def relevance_split(articles: DataFrame, score: str = "score", least: float = RELEVANCE) -> tuple[DataFrame, DataFrame]:
    passed = F.coalesce(fx.clamp(F.col(score)) >= least, F.lit(False))
    return articles.filter(passed), articles.filter(~passed)


def processing_state(passed: Column, analyzed: Column) -> Column:
    """The four exhaustive and disjoint states; passed is null before screening."""
    return (
        F.when(passed.isNull(), "awaiting_screening").when(~passed, "not_selected").when(analyzed, "analyzed").otherwise("analysis_incomplete")
    )


def publishable(passed: Column, title: Column, summary: Column) -> Column:
    return F.coalesce(passed, F.lit(False)) & ~fx.is_blank(title) & ~fx.is_blank(summary)


def search(
    records: DataFrame, q: str = "", since: str = "", until: str = "", *, flagged: bool = False, categories: list[str] | None = None, **equal: str
) -> DataFrame:
    """Records that meet all criteria given: q in the titles or summary in any case, inclusive dates, equal columns."""
    tests = []
    if q.strip():
        names = [c for c in ("title", "title_english", "summary") if c in records.columns]
        tests.append(F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in names])), F.lit(q.strip().lower())))
    # Literals of the column's own type: a filter on a date column reaches the scan.
    for bound, reached in ((since, F.col("published_date").__ge__), (until, F.col("published_date").__le__)):
        if bound:
            tests.append(reached(F.lit(bound).cast(records.schema["published_date"].dataType)))
    if flagged:
        tests.append(F.col("significant"))
    if categories:
        tests.append(F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    tests += [F.col(c) == v for c, v in equal.items() if v]
    for test in tests:
        records = records.filter(test)
    return records


def rolling_window(records: DataFrame, as_of: str, days: int, column: str = "published_date") -> DataFrame:
    """Records of the last days to as_of, both included; texts that are no date don't count."""
    day = F.col(column) if records.schema[column].dataType.typeName() == "date" else fx.calendar_date(F.col(column).cast("string"))
    return records.filter(day.between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))


def language_tag(tag: Column, language: Column, legacy: dict[str, str]) -> Column:
    return F.coalesce(F.nullif(tag, F.lit("")), fx.mapped(legacy, language, None) if legacy else F.lit(None), language)


#: Words of a licence that allow or forbid reuse (fixed values).
ALLOWED_LICENCES = "(?i)\\b(cc0|public domain|cc[ -]by|cc[ -]by[ -]sa|pd)\\b"
FORBIDDEN_LICENCES = "(?i)\\b(nc|nd)\\b"


def licence_verdict(licence: Column, width: Column, height: Column, least_width: int = 800, least_height: int = 400) -> Column:
    """'ok' or the first reason against a picture."""
    name = F.coalesce(licence, F.lit(""))
    return (
        F.when(name.rlike(FORBIDDEN_LICENCES), "licence forbids")
        .when(~name.rlike(ALLOWED_LICENCES), "licence unknown")
        .when((width < least_width) | (height < least_height), "too small")
        .otherwise("ok")
    )
