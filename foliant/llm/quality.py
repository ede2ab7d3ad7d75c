"""Quality rules: a threshold table compiled into one Spark projection.

No user functions: every measure is a built-in expression, and each row of
THRESHOLDS becomes one term of the verdict. Measures are computed in steps,
each a column that the next ones read, so that words and windows are made once
a row. Repeated windows are found by a hash set over the window hashes of a
text; only texts that have any sort them to count the words covered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of the supported languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it on was with be as by this at from or an are "
    "der die und das den von zu mit ist nicht ein eine auf sich des im für "
    "le la les de des et un une du en que qui dans pour est au sur par "
    "el los las del y se por con para su una no al lo es"
).split()

#: (measure, lower bound, upper bound): a text is kept if each measure that it has is within its bounds.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, None),
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", None, 0.35),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.5),
    ("upper_share", None, 0.6),
]


def _shifted(x: Column) -> tuple[Column, Column]:
    """An array without its last and without its first item."""
    n = F.greatest(F.size(x) - 1, F.lit(0))
    return F.slice(x, F.lit(1), n), F.slice(x, F.lit(2), n)


def with_measures(docs: DataFrame, text: str) -> DataFrame:
    """docs with the counts of a text in columns _n.. ; a null text counts as empty."""
    forms = list(dict.fromkeys(x for w in STOP_WORDS for x in (w, w.capitalize(), w.upper())))
    col, none = F.col, F.array().cast("array<long>")
    rows = docs.withColumn("_text", F.coalesce(text, F.lit("")))
    rows = rows.withColumn("_words", F.array_remove(F.split("_text", GAP), ""))
    rows = rows.withColumns({"_n": F.size("_words"), "_lines": F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))})
    windows = F.transform(F.sequence(F.lit(0), col("_n") - WINDOW), lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]))
    rows = rows.withColumn("_wins", F.when(col("_n") > WINDOW, windows).otherwise(none))
    # Only texts with a repeated window go on with theirs; others have nothing to sort.
    rows = rows.withColumn("_wins", F.when(F.size(F.array_distinct("_wins")) < F.size("_wins"), col("_wins")).otherwise(none))
    rows = rows.withColumn("_order", F.sort_array(F.transform("_wins", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_same", F.zip_with(*_shifted(col("_order.h")), lambda a, b: a == b))
    in_run = lambda k: F.coalesce(F.get("_same", k - 1), F.lit(False)) | F.coalesce(F.get("_same", k), F.lit(False))
    rows = rows.withColumn("_places", F.sort_array(F.filter(col("_order.i"), lambda i, k: in_run(k))))
    # A window covers its words up to the next repeated one; the last covers all of its own.
    steps = F.zip_with(*_shifted(col("_places")), lambda a, b: F.least(F.lit(WINDOW), b - a))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x) + F.when(F.size("_places") > 0, WINDOW).otherwise(0)
    return rows.select(
        *docs.columns,
        col("_n").cast("long").alias("_n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("_word_chars"),
        covered.alias("_n_repeat_words"),
        F.size(F.filter("_words", lambda w: w.isin(forms))).cast("long").alias("_n_stop_words"),
        F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("_n_symbols"),
        F.regexp_count("_text", F.lit("[A-Z\u00c0-\u00de]")).alias("_n_upper"),
    )


def compile_rules(thresholds: list[tuple[str, float | None, float | None]], columns: dict[str, Column]) -> Column:
    """The threshold table as one boolean expression; a measure that is null (no words, no lines) passes."""
    terms = [F.lit(True)]
    for name, low, high in thresholds:
        if low is not None:
            terms.append(F.coalesce(columns[name] >= low, F.lit(True)))
        if high is not None:
            terms.append(F.coalesce(columns[name] <= high, F.lit(True)))
    return reduce(lambda a, b: a & b, terms)


def quality_rules(
    docs: DataFrame, text: str = "text", thresholds: list[tuple[str, float | None, float | None]] | None = None
) -> DataFrame:
    """docs with the counts, ratios and verdict of the rules in further columns (an older column of such a name goes).

    Words are runs of other characters than space and x09-x0D. base_failed: fewer
    than 10 words, or more than a fifth of the words in repeated windows. kept: not
    base_failed and within all thresholds. Null and empty texts have no words and
    fail; very long texts are counted whole; repeated rows each get their own verdict,
    and equal windows or lines count alike whatever their order; an empty table gives
    an empty one.
    """
    # The caller's columns travel as one struct, so that none of them meets a work column.
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "mean_word_chars", "symbols_per_word", "stop_word_share", "dup_line_share", "upper_share", "base_failed", "kept"]
    own = [c for c in docs.columns if c not in names]
    row = with_measures(docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(own)]).alias("own"), F.col(text).alias("text")), "text")
    n = F.col("_n_words")
    counts = {c: F.col(f"_{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    per = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
    ratios = {
        "mean_word_chars": per("_word_chars", "_n_words"),
        "symbols_per_word": per("_n_symbols", "_n_words"),
        "stop_word_share": per("_n_stop_words", "_n_words"),
        "dup_line_share": per("_n_dup_lines", "_n_lines"),
        "upper_share": per("_n_upper", "_word_chars"),
    }
    base = (n < 10) | (100 * F.col("_n_repeat_words") > 20 * n)
    verdict = compile_rules(thresholds or THRESHOLDS, counts | ratios)
    new = counts | ratios | {"base_failed": base, "kept": ~base & verdict}
    return row.select(*[F.col(f"own.c{k}").alias(c) for k, c in enumerate(own)], *[x.alias(c) for c, x in new.items()])
