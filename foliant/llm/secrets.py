"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Each row of the input is one version of a path. Its text is addressed by
SHA-256; only pairs of blob and rule version that the ledger lacks are
scanned, once however many paths hold the blob, and the findings are joined
back to all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULE_VERSION = "1"

#: (kind, pattern, group that holds the secret, least length of that group); a match below it is dropped.
BASE_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),  # the matches of AKIA[A-Z0-9]+ that have 16 characters or more
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the maximal runs of 32 or more
]
#: Public formats of keys, tokens and signed claims.
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
]
SPAN = "struct<start:int,rank:int,kind:string,end:int>"


def spans_of(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The leftmost non-overlapping matches of a pattern as spans in code points, end exclusive.

    The texts between the matches come from split() and the matches from
    regexp_extract_all(); their running lengths are the positions.
    """
    p = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(
        F.transform(gaps, lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), lambda x: F.length(x)).alias("all"),
        F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda x: F.length(x)).alias("own"),
    )
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + F.coalesce(x["all"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"))
        keep = x["all"].isNotNull() & (x["own"] >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(parts, start, step, lambda acc: acc["found"])).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(blobs: DataFrame, text: str = "text") -> DataFrame:
    """blobs with base (spans of BASE_RULES) and found (of all rules), sorted by start, then kind as listed.

    Texts are scanned whole, whatever their length; a null one has no spans.
    Older columns base, found and _s0 to _s7 are replaced or go; rows that
    stand twice are scanned each; an empty table gives an empty one.
    """
    t = F.col(text)
    rules = [*BASE_RULES, *MORE_RULES]
    every = blobs.withColumns({f"_s{i}": spans_of(t, i, *rule) for i, rule in enumerate(rules)})
    names = [f"_s{i}" for i in range(len(rules))]
    base = F.array_sort(F.concat(*names[: len(BASE_RULES)]))
    return every.withColumns({"base": base, "found": F.array_sort(F.concat(*names))}).drop(*names)


def unseen(docs: DataFrame, ledger: DataFrame | None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(blob, text) of the blobs that the ledger has not under RULE_VERSION, each once.

    One path stands for each blob (a minimum, combined before the shuffle, so
    that a blob with a third of all paths costs no more than another); texts
    move once, by path.
    """
    versions = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    versions = versions.withColumn("blob", F.sha2("text", 256))
    todo = versions.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        todo = todo.join(ledger.filter(F.col("rule_version") == RULE_VERSION), "blob", "left_anti")
    todo = todo.select(F.col("blob").alias("b"), F.col("path").alias("p"))
    first = versions.join(todo, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
    return first.select("blob", "text").dropDuplicates(["blob"])


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger (blob, rule_version, base, found) after a scan of what it lacks; None is an empty ledger.

    Equal texts of any number of paths are one blob, a null text is the empty
    one; very long texts are scanned whole. Other columns of docs are not
    read; without rows the ledger stays as it is. A ledger of another rule
    version is kept and its blobs are scanned again.
    """
    new = scan(unseen(docs, ledger, path, text)).select("blob", F.lit(RULE_VERSION).alias("rule_version"), "base", "found")
    return new if ledger is None else ledger.unionByName(new)


def findings(docs: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """docs with the findings of their blobs: base and found (arrays of spans).

    One row for each input row, repeated rows and rows with null keys
    included; a null text counts as empty and has no findings.
    """
    known = ledger.filter(F.col("rule_version") == RULE_VERSION).select(F.col("blob").alias("_blob"), "base", "found")
    rows = docs.drop("base", "found", "_blob").withColumn("_blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return rows.join(known, "_blob", "left").drop("_blob")


def digest(found: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts by base kind, the SHA-256 of the joined base spans and all joined spans.

    One row for each row, in the columns named alone, whatever others there
    are; spans that start at one place stand in the order of their rules. A
    row without findings has counts of 0 and the digest of the empty text; an
    empty table gives an empty one.
    """
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        path,
        *[count(kind) for kind, *_ in BASE_RULES],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )
