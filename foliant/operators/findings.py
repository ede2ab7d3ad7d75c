"""Findings before publication: (subject, rule, severity, detail) rows of what is wrong, and gates that they close.

Severity is error or warning; a publication with an error is refused, one
with warnings isn't.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.functions import variants as vx

ERROR, WARNING = "error", "warning"
FINDING = "subject string, rule string, severity string, detail string"

# The fields that an edition and a manifest must have, and the values that they may have.
EDITION_FIELDS = ["date", "week_ending", "week_start", "title", "dek", "n_articles", "n_significant", "edition_type", "source_trail"]
BODY_FIELDS = ["opening_note", "what_stood_out", "why_it_matters", "what_was_routine", "what_im_watching_next"]
DESK_FIELDS = ["desk_id", "display_name", "jurisdiction_code", "default_timezone", "public_status", "supported_language_tags"]
INSTITUTION_FIELDS = ["institution_id", "display_name", "institution_type"]
SOURCE_FIELDS = ["slug", "institution_id", "display_name", "base_url", "language_tag", "access_method", "authority_tier", "source_type", "originality"]
LISTS = ["listing_endpoints", "article_url_patterns"]
PERMITTED = {
    "public_status": ["legacy", "shadow", "public", "paused"],
    "authority_tier": ["A", "B", "C", "D"],
    "access_method": ["html", "rss", "api", "telegram", "manual"],
    "originality": ["original", "mirror", "syndicated", "unknown"],
    "institution_type": ["head_of_state", "defense_ministry", "armed_forces", "service_branch", "security_council", "state_news_agency", "state_linked_media", "other"],
    "calendar": ["gregorian", "hijri", "solar_hijri"],
}
RETIRED = ['class="lead-figure"', "hero-figure", "issue-cover-thumb", 'class="cover-figure"', "entry-thumb"]
CORE_TABLES = ["articles", "sources", "scrape_runs"]


class Refused(ValueError):
    """There are errors, or a cost that nobody has confirmed."""


def _finding(test: Column, rule: str, severity: str | Column = ERROR, detail: Column | None = None) -> Column:
    level = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(test, F.struct(F.lit(rule).alias("rule"), level.alias("severity"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))


def _told(rows: DataFrame, subject: Column, found: list[Column], lists: list[Column] = ()) -> DataFrame:
    """One row for each finding of each row; lists are arrays of findings."""
    every = F.concat(F.array(*found), *lists)
    return rows.select(subject.cast("string").alias("subject"), F.explode(F.filter(every, lambda x: x.isNotNull())).alias("f")).select("subject", "f.rule", "f.severity", "f.detail")


def summary(findings: DataFrame, sample: int = 10) -> DataFrame:
    """(rule, severity, n, subjects): how often each rule is broken, with the first subjects in order of their names."""
    at = findings.withColumn("k", F.row_number().over(Window.partitionBy("rule", "severity").orderBy("subject", "detail")))
    first = at.filter(F.col("k") <= sample).groupBy("rule", "severity").agg(F.array_sort(F.collect_list(F.struct("k", "subject")))["subject"].alias("subjects"))
    return findings.groupBy("rule", "severity").agg(F.count("*").alias("n")).join(first, ["rule", "severity"])


def passed(findings: DataFrame) -> DataFrame:
    """The warnings, if there is no error; Refused else, with the broken rules and how often."""
    broken = findings.filter(F.col("severity") == ERROR).groupBy("rule").agg(F.count("*").alias("n")).orderBy("rule").collect()  # a row for each rule
    if broken:
        raise Refused(", ".join(f"{r['rule']} ({r['n']})" for r in broken))
    return findings


def output_findings(articles: DataFrame, files: DataFrame) -> DataFrame:
    """What is wrong with rendered articles (id, article_path, date as text, summary): missing_page, malformed_date, blank_summary, and blank_date as a warning.

    files (name) are the rendered ones. A date must have the form and be in
    the calendar.
    """
    there = files.select(F.col("name").alias("article_path")).distinct().withColumn("there_", F.lit(True))
    rows = articles.join(there, "article_path", "left")
    date = F.trim(F.coalesce("date", F.lit("")))
    real = date.rlike("^\\d{4}-\\d{2}-\\d{2}$") & fx.calendar_date(date).isNotNull()
    found = [
        _finding(F.col("there_").isNull(), "missing_page", ERROR, F.coalesce("article_path", F.lit(""))),
        _finding((date != "") & ~real, "malformed_date", ERROR, date),
        _finding(date == "", "blank_date", WARNING),
        _finding(fx.is_blank(F.col("summary")), "blank_summary"),
    ]
    return _told(rows, F.col("id"), found)


def edition_findings(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """What is wrong with weekly editions: sidecars (name, text: JSON, named {date}.json), against the rendered files (name).

    Errors: no_parse, missing_field (of EDITION_FIELDS; 0 is a value),
    name_is_not_date, date_is_not_week_ending, span (other than six days; a
    warning for a pilot), malformed_week, flagged_beyond_articles,
    trail_beyond_articles, trail_entry (without title, url or source), no_body,
    no_page, no_sidecar, repeated_issue, issue_order. Warnings: undated_trail,
    trail_outside_week, trail_without_flag, no_issue.
    """
    doc = vx.parsed(F.col("text"))
    whole = F.try_variant_get(doc, "$", "map<string,variant>")
    get = lambda name: F.coalesce(F.trim(vx.field(doc, [f"$.{name}"])), F.lit(""))
    number = lambda name: F.coalesce(F.try_variant_get(doc, f"$.{name}", "int"), F.lit(0))
    rows = sidecars.select("name", "text").withColumns(
        {
            "whole": whole,
            "date": get("date"), "we": get("week_ending"), "ws": get("week_start"),
            "n": number("n_articles"), "sig": number("n_significant"), "issue": F.try_variant_get(doc, "$.issue_number", "int"),
            "trail": F.transform(vx.items(doc, "$.source_trail"), lambda e: F.struct(*[F.coalesce(vx.field(e, [f"$.{k}"]), F.lit("")).alias(k) for k in ("title", "url", "source", "date")], F.coalesce(F.try_variant_get(e, "$.is_significant", "boolean"), F.lit(False)).alias("flag"))),
            "pilot": F.contains(F.lower(get("edition_label")), F.lit("pilot")),
            "body": reduce(lambda a, b: a | b, [get(f) != "" for f in BODY_FIELDS]),
            # absent, null, empty texts and empty lists are missing; 0 and false are not
            "lacking": F.filter(F.array(*[F.when(F.coalesce(vx.field(doc, [f"$.{f}"]), F.lit("")).isin("", "[]", "{}"), F.lit(f)) for f in EDITION_FIELDS]), lambda x: x.isNotNull()),
        }
    )
    stem = F.regexp_replace("name", "^.*/|\\.json$", "")
    pages = files.filter(F.col("name").endswith(".html")).select(F.regexp_replace("name", "^.*/|\\.html$", "").alias("stem")).distinct()
    rows = rows.withColumn("stem", stem).join(pages.withColumn("page", F.lit(True)), "stem", "left")
    a, b = fx.calendar_date(F.col("ws")), fx.calendar_date(F.col("we"))
    span = F.datediff(b, a)
    parsed = F.col("whole").isNotNull()
    undated = F.size(F.filter("trail", lambda e: e["date"] == ""))
    found = [
        _finding(~parsed, "no_parse"),
        _finding(parsed & (F.size("lacking") > 0), "missing_field", ERROR, F.array_join("lacking", ", ")),
        _finding(parsed & (F.col("stem") != F.col("date")), "name_is_not_date", ERROR, F.col("date")),
        _finding(parsed & (F.col("date") != F.col("we")), "date_is_not_week_ending", ERROR, F.col("we")),
        _finding(parsed & (span != 6), "span", F.when(F.col("pilot"), WARNING).otherwise(ERROR), span),
        _finding(parsed & span.isNull(), "malformed_week", ERROR, F.concat_ws("..", "ws", "we")),
        _finding(parsed & (F.col("sig") > F.col("n")), "flagged_beyond_articles"),
        _finding(parsed & (F.size("trail") > F.col("n")), "trail_beyond_articles"),
        _finding(parsed & (undated > 0), "undated_trail", WARNING, F.concat_ws("/", undated.cast("string"), F.size("trail").cast("string"))),
        _finding(parsed & (F.col("sig") > 0) & (F.size("trail") > 0) & ~F.exists("trail", lambda e: e["flag"]), "trail_without_flag", WARNING),
        _finding(parsed & ~F.col("body"), "no_body"),
        _finding(parsed & F.col("page").isNull(), "no_page"),
        _finding(parsed & (F.coalesce("issue", F.lit(0)) == 0), "no_issue", WARNING),
    ]
    empty = lambda e: F.array_join(F.filter(F.array(*[F.when(e[k] == "", k) for k in ("title", "url", "source")]), lambda x: x.isNotNull()), ", ")
    entries = F.transform("trail", lambda e, i: _finding(parsed & (empty(e) != ""), "trail_entry", ERROR, F.concat(i.cast("string"), F.lit(": "), empty(e))))
    outside = F.transform("trail", lambda e, i: _finding(parsed & (e["date"] != "") & (F.col("ws") != "") & (F.col("we") != "") & ~e["date"].between(F.col("ws"), F.col("we")), "trail_outside_week", WARNING, F.concat(i.cast("string"), F.lit(": "), e["date"])))
    own = _told(rows, F.col("name"), found, [entries, outside])
    orphans = pages.join(rows.select("stem").distinct(), "stem", "left_anti").select(F.concat("stem", F.lit(".html")).alias("subject"), F.lit("no_sidecar").alias("rule"), F.lit(ERROR).alias("severity"), F.lit(None).cast("string").alias("detail"))
    # issues among all editions: one row each, weeks apart
    numbered = rows.filter(parsed & (F.coalesce("issue", F.lit(0)) != 0))
    again = numbered.groupBy("issue").agg(F.count("*").alias("k"), F.min("name").alias("name")).filter("k > 1").select("name", F.lit("repeated_issue").alias("rule"), F.col("issue").cast("string").alias("detail"))
    before = numbered.withColumn("last", F.lag("issue").over(Window.orderBy("name")))
    order = before.filter("issue < last").select("name", F.lit("issue_order").alias("rule"), F.concat_ws(" after ", F.col("issue").cast("string"), F.col("last").cast("string")).alias("detail"))
    series = again.unionByName(order).select(F.col("name").alias("subject"), "rule", F.lit(ERROR).alias("severity"), "detail")
    return own.unionByName(orphans).unionByName(series)


def image_findings(pages: DataFrame, manifest: DataFrame, files: DataFrame, veils: str = "media") -> DataFrame:
    """What is wrong with editorial pictures on rendered pages (name, text).

    manifest (id, file, source_page, treatment, routes, article_urls) lists
    the pictures, files (name) all that is published. Errors: derivative_missing
    and file_missing of the manifest's entries; on pages asset_missing,
    unknown_picture, no_credit, no_aria_label, no_context ('not evidence'
    nowhere), no_article_url (on article/ pages, where the entry names some)
    and retired_pattern. Pictures named src-{date} belong to an edition's own
    article: their derivative, veils/{date}-veil.jpg, must be published and their
    article, given as an entry of the manifest under that id, linked.
    """
    names = files.select("name").distinct()
    routes = F.coalesce("routes", F.array().cast("array<string>"))
    duo = F.when(F.array_contains(routes, "home") | F.array_contains(routes, "article"), F.concat("id", F.when(F.col("treatment") == "dither", "-dither-ink.png").otherwise("-duo-paper.jpg")))
    navy = F.when(F.array_contains(routes, "pw-post"), F.concat("id", F.lit("-duo-navy.jpg")))
    curated = manifest.filter(~F.col("id").startswith("src-"))
    derived = curated.select("id", F.explode(F.array_compact(F.array(duo, navy))).alias("file")).select("id", F.concat(F.lit("assets/editorial/derivatives/"), "file").alias("name"), F.lit("derivative_missing").alias("rule"))
    sources = curated.filter((F.size(routes) > 0) & F.col("file").isNotNull()).select("id", F.concat(F.lit("assets/editorial/"), "file").alias("name"), F.lit("file_missing").alias("rule"))
    own = manifest.filter(F.col("id").startswith("src-")).select("id", F.concat(F.lit(f"{veils}/"), F.substr("id", F.lit(5)), F.lit("-veil.jpg")).alias("name"), F.lit("derivative_missing").alias("rule"))
    lost = derived.unionByName(sources).unionByName(own).join(names, "name", "left_anti").select(F.col("id").alias("subject"), "rule", F.lit(ERROR).alias("severity"), F.col("name").alias("detail"))

    page, text = F.col("name"), F.col("text")
    # ../ at the front of a reference climbs from the page's folder; the rest is below the root or that folder
    refs = pages.select(page.alias("page"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("([^\"'()\\s]*assets/editorial/[^\"'()\\s]+)"), F.lit(1)))).alias("ref"))
    climbs = F.regexp_count("ref", F.lit("(?<![^/])\\.\\./"))
    folders = F.slice(F.split("page", "/"), 1, F.greatest(F.lit(0), F.size(F.split("page", "/")) - 1 - climbs))
    target = F.array_join(F.concat(folders, F.array(F.regexp_replace("ref", "^(?:\\.\\./)*(?:\\./)?", ""))), "/")
    dead = refs.withColumn("name", target).join(names, "name", "left_anti").select(F.col("page").alias("subject"), F.lit("asset_missing").alias("rule"), F.lit(ERROR).alias("severity"), F.col("ref").alias("detail"))

    tags = F.regexp_extract_all(text, F.lit('(<[^>]*data-editorial-id="[^"]+"[^>]*>)'), F.lit(1))
    shown = pages.select(page.alias("page"), text.alias("text"), F.explode(tags).alias("tag")).withColumn("id", F.regexp_extract("tag", 'data-editorial-id="([^"]+)"', 1))
    known = manifest.select("id", "source_page", F.coalesce("article_urls", F.array().cast("array<string>")).alias("urls"), F.lit(True).alias("known"))
    rows = shown.join(known, "id", "left")
    told = F.col("known").isNotNull()
    found = [
        _finding(~told, "unknown_picture", ERROR, F.col("id")),
        _finding(told & F.coalesce(~F.contains("text", F.col("source_page")), F.lit(False)), "no_credit", ERROR, F.col("id")),
        _finding(told & ~F.col("tag").rlike('aria-label="[^"]+"'), "no_aria_label", ERROR, F.col("id")),
        _finding(told & ~F.contains(F.lower("text"), F.lit("not evidence")), "no_context", ERROR, F.col("id")),
        _finding(told & F.col("page").startswith("article/") & (F.size("urls") > 0) & ~F.exists("urls", lambda u: F.contains(F.col("text"), u)), "no_article_url", ERROR, F.col("id")),
    ]
    retired = [_finding(F.contains("text", F.lit(p)), "retired_pattern", ERROR, F.lit(p)) for p in RETIRED]
    return lost.unionByName(dead).unionByName(_told(rows, F.col("page"), found)).unionByName(_told(pages, page, retired))


def currency(spark: SparkSession, tables: list[str], applied: DataFrame | None, expected: list[str]) -> DataFrame:
    """One row (state, missing): whether a store's tables and its ledger of migrations (version) are what this library expects.

    structurally_incompatible without a core table, ledger_absent without a
    ledger or entries, partially_applied, or fully_current; missing are the
    expected versions that the ledger lacks, in order.
    """
    lacking = [x for x in CORE_TABLES if x not in tables]
    wanted = spark.createDataFrame([(x,) for x in expected], "version string")
    have = applied.select(F.col("version").cast("string").alias("version"), F.lit(True).alias("have")).distinct() if applied is not None else spark.createDataFrame([], "version string, have boolean")
    both = wanted.withColumn("want", F.lit(True)).join(have, "version", "full_outer")
    row = both.agg(F.count_if("have").alias("n"), F.array_sort(F.collect_list(F.when(F.col("want") & F.col("have").isNull(), F.col("version")))).alias("missing"))
    state = F.when(F.lit(bool(lacking)), "structurally_incompatible").when(F.col("n") == 0, "ledger_absent").when(F.size("missing") > 0, "partially_applied").otherwise("fully_current")
    return row.select(state.alias("state"), "missing")


def _enum(value: Column, field: str, kind: str | None = None) -> Column:
    return _finding(value.isNotNull() & ~value.isin(PERMITTED[kind or field]), "not_permitted", ERROR, F.concat(F.lit(f"{field}="), value))


def manifest_findings(manifests: DataFrame) -> DataFrame:
    """What is wrong with desk manifests (name, text: JSON): subject is name:desk, name:institutions[i] or name:sources[i].

    no_parse; missing_field; not_permitted values; language_tag of another
    shape; undeclared_language, which the desk doesn't support; cadence that is
    no positive number; not_a_list; repeated_institution, repeated_slug (in one
    manifest or among all), repeated_desk; unknown_institution, unknown_parent.
    All findings of all manifests are told, not the first alone.
    """
    at = lambda e, name: vx.field(e, [f"$.{name}"])
    doc, e = F.col("doc"), F.col("e.e")
    # Parsed once, and each part of it looked at once: what is asked of an exploded column is not moved below the parse.
    rows = manifests.select("name", F.explode(F.array(vx.parsed(F.col("text")))).alias("doc"))
    desk = F.try_variant_get(doc, "$.desk", "variant")
    whole = F.try_variant_get(desk, "$", "map<string,variant>").isNotNull()
    part = lambda kind, i, x: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), x.alias("e"))
    listed = lambda kind: F.transform(vx.items(doc, f"$.{kind}"), lambda x, i: part(kind, i, x))
    parts = F.when(F.coalesce(whole, F.lit(False)), F.concat(F.array(part("desk", F.lit(0), desk)), listed("institutions"), listed("sources"))).otherwise(F.array(part("none", F.lit(0), F.lit(None).cast("variant"))))
    tags = F.transform(vx.items(doc, "$.desk.supported_language_tags"), lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.lit("")))
    kind, i = F.col("e.kind"), F.col("e.i").cast("string")
    names = sorted({*DESK_FIELDS[:-1], "default_calendar", *INSTITUTION_FIELDS, "parent_institution_id", *SOURCE_FIELDS, "calendar"})
    rows = rows.select("name", tags.alias("tags"), F.explode(parts).alias("e"))
    fields = rows.select(
        "name", "tags", kind.alias("kind"), *[at(e, f).alias(f) for f in names],
        F.concat("name", F.when(kind == "none", "").when(kind == "desk", ":desk").otherwise(F.concat(F.lit(":"), kind, F.lit("["), i, F.lit("]")))).alias("subject"),
        F.try_variant_get(e, "$.expected_cadence_days", "variant").alias("cadence"),
        *[(F.try_variant_get(e, f"$.{f}", "variant").isNotNull() & F.try_variant_get(e, f"$.{f}", "array<variant>").isNull()).alias(f"no_{f}") for f in LISTS],
    )
    lacks = lambda wanted: [_finding(fx.is_blank(F.col(f)), "missing_field", ERROR, F.lit(f)) for f in wanted]
    cadence = F.col("cadence")
    stated = cadence.isNotNull() & (F.schema_of_variant(cadence) != "VOID")
    days = F.coalesce(F.try_variant_get(cadence, "$", "double"), F.try_variant_get(cadence, "$", "string").try_cast("double"))
    tag = F.col("language_tag")
    shaped = fx.is_language_tag(tag)
    on_desk = F.concat(
        F.array(_enum(F.col("public_status"), "public_status"), _enum(F.col("default_calendar"), "default_calendar", "calendar"), _finding(F.size("tags") == 0, "missing_field", ERROR, F.lit("supported_language_tags")), *lacks(DESK_FIELDS[:-1])),
        F.transform("tags", lambda x: _finding(~fx.is_language_tag(x), "language_tag", ERROR, x)),
    )
    on_institution = F.array(_enum(F.col("institution_type"), "institution_type"), *lacks(INSTITUTION_FIELDS))
    on_source = F.array(
        *[_enum(F.col(f), f) for f in ("access_method", "authority_tier", "originality", "calendar")],
        _finding(tag.isNotNull() & ~shaped, "language_tag", ERROR, tag),
        _finding(shaped & ~F.array_contains("tags", tag), "undeclared_language", ERROR, tag),
        _finding(stated & ~F.coalesce(days > 0, F.lit(False)), "cadence"),
        *[_finding(F.col(f"no_{f}"), "not_a_list", ERROR, F.lit(f)) for f in LISTS],
        *lacks(SOURCE_FIELDS),
    )
    found = F.when(F.col("kind") == "desk", on_desk).when(F.col("kind") == "institutions", on_institution).when(F.col("kind") == "sources", on_source).otherwise(F.array(_finding(F.lit(True), "no_parse")))
    # What must stand once, or be declared: (space, scope, key), where a later row of one space repeats the first, and a reference wants a row that isn't one.
    mark = lambda space, scope, key, rule, refers: F.struct(F.lit(space).alias("space"), scope.alias("scope"), key.alias("key"), F.lit(rule).alias("rule"), F.lit(ERROR).alias("severity"), key.alias("detail"), F.lit(refers).alias("refers"))
    none = F.lit(None).cast("string")
    name = F.col("name").cast("string")
    marks = {
        "desk": [mark("desk", none, F.col("desk_id"), "repeated_desk", False)],
        "institutions": [mark("institution", name, F.col("institution_id"), "repeated_institution", False), mark("institution", name, F.col("parent_institution_id"), "unknown_parent", True)],
        "sources": [mark("slug", none, F.col("slug"), "repeated_slug", False), mark("institution", name, F.col("institution_id"), "unknown_institution", True)],
    }
    keyed = F.array().cast("array<struct<space:string,scope:string,key:string,rule:string,severity:string,detail:string,refers:boolean>>")
    for k, own in marks.items():
        keyed = F.when(F.col("kind") == k, F.filter(F.array(*own), lambda x: x["key"].isNotNull())).otherwise(keyed)
    told = F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: F.struct(F.lit("told").alias("space"), none.alias("scope"), none.alias("key"), x["rule"].alias("rule"), x["severity"].alias("severity"), x["detail"].alias("detail"), F.lit(False).alias("refers")))
    every = fields.select(F.col("subject").cast("string").alias("subject"), F.explode(F.concat(told, keyed)).alias("f")).select("subject", "f.*")
    # Findings that need no other row have keys of their own, so that one shuffle deals them all.
    every = every.withColumn("key", F.coalesce("key", "subject"))
    group = Window.partitionBy("space", "scope", "key")
    placed = every.withColumns({"k": F.row_number().over(group.orderBy("refers", "subject")), "declared": F.first(~F.col("refers")).over(group.orderBy("refers", "subject"))})
    wrong = (F.col("space") == "told") | (~F.col("refers") & (F.col("k") > 1)) | (F.col("refers") & ~F.col("declared"))
    return placed.filter(wrong).select("subject", "rule", "severity", "detail")


def spend(stages: DataFrame, prices: DataFrame, chars_per_token: float = 1.0) -> DataFrame:
    """(label, model, input_tokens, output_tokens, input_usd, output_usd, total_usd) of the stages (label, input_chars, model, output_ratio).

    prices (model, input, output) are dollars for a million tokens; a model
    without one stops the query, since its cost is unknown. Tokens are whole,
    rounded down; dollars are of the unrounded ones.
    """
    rows = stages.join(prices.select("model", "input", "output", F.lit(True).alias("priced")), "model", "left")
    known = F.when(F.col("priced").isNull(), F.raise_error(F.concat(F.lit("no price on file for "), F.coalesce("model", F.lit("null")))).cast("double"))
    tokens = F.col("input_chars") / F.lit(chars_per_token)
    made = tokens * F.col("output_ratio")
    a, b = F.coalesce(known, tokens / 1_000_000 * F.col("input")), made / 1_000_000 * F.col("output")
    return rows.select("label", "model", F.floor(tokens).alias("input_tokens"), F.floor(made).alias("output_tokens"), a.alias("input_usd"), b.alias("output_usd"), (a + b).alias("total_usd"))


def affordable(estimates: DataFrame, confirmed: bool, threshold_usd: float) -> float:
    """The total of spend(), which must be below the threshold or confirmed; Refused else. No stages cost nothing."""
    total = estimates.agg(F.coalesce(F.sum("total_usd"), F.lit(0.0))).first()[0]
    if total >= threshold_usd and not confirmed:
        raise Refused(f"an estimated ${total:.2f} is not below ${threshold_usd:.2f} and not confirmed")
    return total
