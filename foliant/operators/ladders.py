"""Publishers' rules as rows: ladders of titles, bodies and dates of articles, and dated links of listings.

Rules are a table, joined to the pages by host; every rule reads the page's
one tree (sources.markup.trees). A page's rules stand beside it as an array,
so that nothing but the join with the small table moves.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.sources.markup import trees

RULE = (
    "source string, host string, field string, rung int, name string, within_tag string, within_class string, within_part boolean, "
    "tag string, class string, class_part boolean, classless boolean, skipped_class string, skipped_sole boolean, first boolean, by_lines boolean, "
    "longer_than int, phrases array<string>, refused array<string>, takes string, takes_over int, needs string, pattern string"
)
_DEFAULTS = {
    "within_part": False, "class_part": False, "classless": False, "skipped_sole": False, "first": False, "by_lines": False,
    "longer_than": 0, "phrases": [], "refused": [], "takes": "text", "takes_over": 0,
}

LISTING = "source string, host string, address string, by_month boolean, how string, days int, undated boolean"

# The hosts, element and class names, phrases, lengths and date forms of four publishers.
_ISO = "(\\d{4})-(\\d{2})-(\\d{2})"
_SLASHED = "(\\d{4})/(\\d{1,2})/(\\d{1,2})"
_NOTICES = ["版权", "责任编辑"]
_PUBLISHERS = {
    ("pla_daily", "www.81.cn"): {
        "title": [dict(tag="h2", first=True), dict(tag="h1", first=True)],
        "body": [
            dict(name="display", within_tag="ul", within_class="m-t-list", within_part=True, tag="p", **{"class": "ueditor"}, class_part=True, takes="match", longer_than=-1),
            dict(name="container", within_tag="ul", within_class="m-t-list", within_part=True, by_lines=True, takes_over=50),
            dict(name="long", tag="p", longer_than=30, phrases=_NOTICES),
        ],
        "date": [
            dict(name="info", within_tag="div", within_class="artichle-info", within_part=True, pattern="发布[：:]\\s*" + _ISO),
            dict(name="stamp", tag="#text", needs="发布[：:]\\s*" + _ISO, pattern=_ISO),
        ],
    },
    ("mod_china", "www.mod.gov.cn"): {
        "title": [dict(tag="h1", first=True), dict(tag="h2", first=True)],
        "body": [
            dict(name="display", tag="p", **{"class": "ueditor"}, class_part=True, skipped_class="ueditor-text-tushuo", longer_than=10, takes="match"),
            dict(name="long", tag="p", longer_than=30, phrases=_NOTICES),
        ],
        "date": [dict(name="page", tag="#page", pattern=_ISO)],
    },
    ("global_times_mil", "www.globaltimes.cn"): {
        "title": [dict(tag="div", **{"class": "article_title"}, first=True), dict(tag="h1", first=True)],
        "body": [
            dict(name="content", within_tag="div", within_class="article_content", tag="p", longer_than=30, skipped_class="picture", skipped_sole=True),
            dict(name="long", tag="p", classless=True, longer_than=40),
        ],
        "date": [dict(name="source", tag="div", **{"class": "source_time"}, class_part=True, pattern=_SLASHED)],
    },
    ("china_mil_online", "eng.chinamil.com.cn"): {
        "title": [dict(name="header", within_tag="div", within_class="article-header", tag="h1", first=True), dict(tag="h1", first=True, refused=["China Military"])],
        "body": [dict(name="display", tag="p", **{"class": "ueditor"}, class_part=True, longer_than=10, takes="match"), dict(name="long", tag="p", longer_than=40)],
        "date": [dict(name="info", within_tag="div", within_class="pub-info", tag="dd", pattern="^" + _ISO), dict(name="page", tag="#page", pattern=_ISO)],
    },
}
_LISTINGS = [
    ("pla_daily", "www.81.cn", "^https?://www\\.81\\.cn/[^/]+/\\d+\\.html$", False, "label", 1, False),
    ("mod_china", "www.mod.gov.cn", "^https?://www\\.mod\\.gov\\.cn/gfbw/\\S+/\\d+\\.html$", False, "stamp", 7, False),
    ("global_times_mil", "www.globaltimes.cn", "^https?://www\\.globaltimes\\.cn/page/(\\d{4})(\\d{2})/\\d+\\.shtml$", True, "around", 1, True),
    ("china_mil_online", "eng.chinamil.com.cn", "^https?://eng\\.chinamil\\.com\\.cn/\\S+/\\d+\\.html$", False, "inside", 1, False),
]
#: How many ancestors of a link are searched for its date.
LEVELS = 4


def article_rules(spark: SparkSession, publishers: dict = _PUBLISHERS) -> DataFrame:
    """The rule rows of publishers: {(source, host): {field: [rungs in order]}}; a rung without a name is named by its tag."""
    names = [c.split()[0] for c in RULE.split(", ")]
    rows = []
    for (source, host), fields in publishers.items():
        for field, rungs in fields.items():
            for k, rung in enumerate(rungs):
                full = _DEFAULTS | {"source": source, "host": host, "field": field, "rung": k, "name": rung.get("tag")} | rung
                rows.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(rows, RULE)


def listing_rules(spark: SparkSession, rows: list[tuple] = _LISTINGS) -> DataFrame:
    return spark.createDataFrame(rows, LISTING)


def _beside(pages: DataFrame, rules: DataFrame, host: Column) -> DataFrame:
    """pages of the hosts that have rules, with source and rules_ (all rules of the host, by field and rung)."""
    order = ["field", "rung"] if "rung" in rules.columns else ["how"]
    rest = [c for c in rules.columns if c not in ("host", *order)]
    by_host = rules.groupBy(F.col("host").alias("host_"), F.col("source").alias("source_")).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias("rules_"))
    return pages.withColumn("host_", host).join(by_host, "host_").drop("host_")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")


def inside(nodes: Column, node: Column) -> Column:
    """All nodes inside a node."""
    return F.slice(nodes, node["i"] + 2, node["last"] - node["i"])


def whole_text(nodes: Column, node: Column) -> Column:
    """The texts in a node, as they are, one after the other."""
    own = F.slice(nodes, node["i"] + 1, node["last"] - node["i"] + 1)
    return F.array_join(F.transform(F.filter(own, lambda n: n["tag"] == "#text"), lambda n: n["text"]), "")


def stripped_text(nodes: Column, node: Column, separator: Column) -> Column:
    """The texts in a node, each without outer white space, the blank ones left out."""
    own = F.slice(nodes, node["i"] + 1, node["last"] - node["i"] + 1)
    texts = F.transform(F.filter(own, lambda n: n["tag"] == "#text"), lambda n: strip(n["text"]))
    kept = F.filter(texts, lambda x: x != "")
    return F.when(separator, F.array_join(kept, "\n")).otherwise(F.array_join(kept, ""))


def _classed(node: Column, wanted: Column, part: Column) -> Column:
    """A null class asks for nothing, a part stands anywhere in the attribute, else it is one of its words or all of it."""
    own = F.coalesce(node["class"], F.lit(""))
    return wanted.isNull() | F.when(part, F.contains(own, wanted)).otherwise((own == wanted) | F.array_contains(F.split(own, "\\s+"), wanted))


def _group(x: Column, pattern: Column, k: int) -> Column:
    return F.call_function("regexp_extract", x, pattern, F.lit(k))  # the pattern is a rule's


def _dated(x: Column, pattern: Column) -> Column:
    part = lambda k: F.lpad(_group(x, pattern, k), 4 if k == 1 else 2, "0")
    return F.when(F.regexp_like(x, pattern), F.concat_ws("-", part(1), part(2), part(3)))


def _let(x: Column, f) -> Column:
    """f of x, with x computed once."""
    return F.get(F.transform(F.array(x), f), 0)


def _rung(nodes: Column, page: Column, rule: Column) -> Column:
    """What a rule gives: its text, or null where it isn't taken."""
    holds = lambda n: (n["tag"] == rule["within_tag"]) & _classed(n, rule["within_class"], rule["within_part"])
    container = F.slice(F.filter(nodes, holds), 1, 1)
    scope = F.when(rule["within_tag"].isNull(), nodes).otherwise(F.flatten(F.transform(container, lambda c: inside(nodes, c))))
    fits = lambda n: (n["tag"] == rule["tag"]) & _classed(n, rule["class"], rule["class_part"]) & (~rule["classless"] | (F.coalesce(n["class"], F.lit("")) == ""))
    found = F.when(rule["tag"].isNull(), container).otherwise(F.filter(scope, fits))
    found = F.slice(found, 1, F.when(rule["first"], 1).otherwise(2**31 - 1))
    return _let(found, lambda elements: F.when(rule["pattern"].isNotNull(), _stamp(nodes, page, rule, elements)).otherwise(_text(nodes, rule, elements)))


def _text(nodes: Column, rule: Column, elements: Column) -> Column:
    words = lambda n: F.split(F.coalesce(n["class"], F.lit("")), "\\s+")
    sole = lambda n: ~rule["skipped_sole"] | (F.size(words(n)) == 1)
    left = F.filter(elements, lambda n: rule["skipped_class"].isNull() | ~(F.array_contains(words(n), rule["skipped_class"]) & sole(n)))
    texts = F.transform(left, lambda n: stripped_text(nodes, n, rule["by_lines"]))
    kept = F.filter(texts, lambda x: (F.length(x) > rule["longer_than"]) & ~F.exists(rule["phrases"], lambda p: F.contains(x, p)) & ~F.array_contains(rule["refused"], x))
    taken = lambda x: (F.length(x) > rule["takes_over"]) | ((rule["takes"] == "match") & (F.size(elements) > 0))
    return _let(F.array_join(kept, "\n"), lambda x: F.when(taken(x), x))


def _stamp(nodes: Column, page: Column, rule: Column, elements: Column) -> Column:
    """The first date of the rule's form in the texts as they are; a form that starts the text, in the stripped ones."""
    raw = F.when(rule["tag"] == "#page", F.array(page)).otherwise(F.transform(elements, lambda n: whole_text(nodes, n)))
    told = F.filter(raw, lambda x: rule["needs"].isNull() | F.regexp_like(x, rule["needs"]))
    cut = F.transform(told, lambda x: F.when(rule["pattern"].startswith("^"), strip(x)).otherwise(x))
    return F.get(F.filter(F.transform(cut, lambda x: _dated(x, rule["pattern"])), lambda d: d.isNotNull()), 0)


def _field(field: str, nodes: Column, page: Column) -> Column:
    """(rung, value) of the first rule of a field that is taken; later rules aren't evaluated."""
    own = F.filter("rules_", lambda r: r["field"] == field)
    none = F.lit(None).cast("struct<rung:string,value:string>")

    def step(found: Column, rule: Column) -> Column:
        taken = _let(_rung(nodes, page, rule), lambda x: F.when(x.isNotNull(), F.struct(rule["name"].alias("rung"), x.alias("value"))))
        return F.when(found.isNotNull(), found).otherwise(taken)

    return F.aggregate(own, none, step)


def articles(pages: DataFrame, rules: DataFrame, day: Column, html: str = "html", url: str = "url") -> DataFrame:
    """pages of the publishers in rules with source, title, body and published, and the rung that gave each.

    The page's host chooses the publisher; pages of other hosts go. The title
    and the body are those of the first rung that is taken: one that 'match'es
    is taken with its first element, even if all its texts are left out; any
    other with a text longer than takes_over. A page without a title has a
    null one, one without a body an empty one. published is the first date of
    the form, else day, with a null rung. Null, empty and repeated pages are
    rows like others; further columns stay but those named like a new one.
    """
    new = ["source", "title", "title_rung", "body", "body_rung", "published", "published_rung"]
    kept = [c for c in pages.columns if c not in new and c != html]
    with_day = pages.select(*kept, F.col(html).alias("page_"), F.date_format(day, "yyyy-MM-dd").alias("day_"))
    rows = _beside(trees(with_day, "page_", url, "nodes_"), rules, fx.url_host(F.col(url)))
    found = rows.withColumns({f"{f}_": _field(f, F.col("nodes_"), F.col("page_")) for f in ("title", "body", "date")})
    return found.select(
        *kept,
        F.col("source_").alias("source"),
        F.col("title_.value").alias("title"),
        F.col("title_.rung").alias("title_rung"),
        F.coalesce("body_.value", F.lit("")).alias("body"),
        F.col("body_.rung").alias("body_rung"),
        F.coalesce("date_.value", "day_").alias("published"),
        F.col("date_.rung").alias("published_rung"),
    )


def _iso_day(x: Column, pattern: str) -> Column:
    """The date of a text by a pattern of three groups, null if it hasn't the form or the calendar lacks it."""
    return fx.calendar_date(_dated(x, F.lit(pattern)))


def _link_day(nodes: Column, anchor: Column, how: Column, day: Column) -> Column:
    """The date of a link: told by its label, by a stamp in or at the end of it, by a stamped title in it, or around it."""
    label = whole_text(nodes, anchor)
    terminal = _ISO + "\\s+\\d{1,2}:\\d{2}(?::\\d{2})?\\s*\\z"
    timed = lambda scope: F.get(F.filter(scope, lambda n: (n["tag"] == "small") & F.contains(F.coalesce(n["class"], F.lit("")), F.lit("time"))), 0)
    stamp = timed(inside(nodes, anchor))
    by_stamp = _iso_day(F.when(stamp.isNotNull(), whole_text(nodes, stamp)).otherwise(label), terminal)
    titles = F.filter(inside(nodes, anchor), lambda n: (n["tag"] == "div") & (n["parent"] == anchor["i"]) & _classed(n, F.lit("title"), F.lit(False)))
    days = F.transform(titles, lambda n: _iso_day(strip(whole_text(nodes, timed(inside(nodes, n)))), "^" + _ISO))
    by_title = F.coalesce(F.get(F.filter(days, lambda d: d == day), 0), F.get(F.filter(days, lambda d: d.isNotNull()), 0))
    named = F.when(F.contains(label, F.date_format(day, "yyyy-MM-dd")), day)

    def around(level: int, node: Column) -> Column:
        """The date in the parent, or else in the one above it."""
        line = lambda n: (n["tag"] == "div") & F.contains(F.coalesce(n["class"], F.lit("")), F.lit("source_time"))
        dates = lambda above: F.filter(F.transform(F.filter(inside(nodes, above), line), lambda n: _dated(whole_text(nodes, n), F.lit(_SLASHED))), lambda d: d.isNotNull())
        further = lambda above: around(level - 1, above) if level > 1 else F.lit(None).cast("string")
        return F.when(node["parent"] >= 0, _let(F.get(nodes, node["parent"]), lambda above: F.coalesce(F.get(dates(above), 0), further(above))))

    # a date around that the calendar lacks is a date all the same: not the day, and not undated
    by_ancestor = _let(around(LEVELS, anchor), lambda near: F.when(near.isNotNull(), F.coalesce(fx.calendar_date(near), F.lit("1000-01-01").cast("date"))))
    return F.when(how == "label", named).when(how == "stamp", by_stamp).when(how == "inside", by_title).when(how == "around", by_ancestor)


def listed_links(pages: DataFrame, rules: DataFrame, day: Column, html: str = "html", url: str = "url") -> DataFrame:
    """(source, link, label, day) of the articles that listing pages name for a day and the days before it that their rule allows.

    how a link is dated: 'label' (the day itself stands in its text), 'stamp'
    (an element of class time in it, or else a date and time that end its
    text), 'inside' (a stamped title that is its child), 'around' (the nearest
    of LEVELS ancestors that holds a dated source line). Later days, dates
    that the calendar lacks and links without a date are left out; a rule with
    undated keeps those without, as the month in their address is the day's
    (by_month). A link that several pages name is one row, of the first page
    by address. Null and empty pages name nothing.
    """
    rows = trees(pages.select(F.col(url).alias("url"), F.col(html).alias("html"), day.alias("day")))
    rows = _beside(rows, rules, fx.url_host(F.col("url"))).select("url", "day", "source_", F.explode("rules_").alias("rule"), "nodes")
    nodes, rule = F.col("nodes"), F.col("rule")
    month = lambda link: F.concat(_group(link, rule["address"], 1), _group(link, rule["address"], 2))
    anchors = F.filter("nodes", lambda n: (n["tag"] == "a") & F.regexp_like(n["link"], rule["address"]))
    anchors = F.filter(anchors, lambda n: F.when(rule["by_month"], month(n["link"]) == F.date_format("day", "yyyyMM")).otherwise(True))
    made = F.transform(
        anchors,
        lambda a: F.struct(a["link"].alias("link"), a["i"].alias("i"), fx.collapse(whole_text(nodes, a)).alias("label"), _link_day(nodes, a, rule["how"], F.col("day")).alias("on")),
    )
    dated = rows.select("source_", "url", "day", rule["undated"].alias("undated"), rule["days"].alias("days"), F.inline(made))
    wanted = F.when(F.col("on").isNull(), F.col("undated")).otherwise((F.col("on") <= F.col("day")) & (F.col("on") > F.date_sub("day", F.col("days"))))
    first = dated.filter(wanted).groupBy(F.col("source_").alias("source"), "link").agg(F.min(F.struct("url", "i", "label", "on")).alias("first"))
    return first.select("source", "link", "first.label", F.col("first.on").alias("day"))


