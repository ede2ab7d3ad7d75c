"""Rule-driven extraction from markup with built-in functions: links, meta tags, titles, paragraphs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, "(?is)<!--.*?-->|<(script|style)\\b.*?</\\1\\s*>", " ")


def links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, href, label) of all anchors of the pages."""
    body = without_scripts(F.col(html))
    anchors = F.arrays_zip(
        F.regexp_extract_all(body, F.lit("(?is)<a\\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"), F.lit(1)).alias("href"),
        F.regexp_extract_all(body, F.lit("(?is)<a\\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"), F.lit(2)).alias("label"),
    )
    return pages.select(key, F.inline(anchors)).withColumn("label", fx.plain_text(F.col("label")))


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag by property or name, null if there is none."""
    tag = f"(?is)<meta\\b[^>]*(?:property|name)=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']"
    return F.nullif(F.regexp_extract(html, tag, 1), F.lit(""))


def first_of(rules: list[Column]) -> Column:
    """The first rule that gives a non-blank text: a ladder of fallbacks."""
    return F.coalesce(*[F.when(~fx.is_blank(r), r) for r in rules])


def title(html: Column) -> Column:
    body = without_scripts(html)
    element = lambda tag: fx.plain_text(F.regexp_extract(body, f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>", 1))
    return first_of([meta(html, "og:title"), element("h1"), element("h2"), element("title")])


def paragraphs(html: Column, least: int = 30, boilerplate: str = "(?i)copyright|all rights reserved") -> Column:
    """Texts of the p elements with at least so many characters and no boilerplate."""
    found = F.regexp_extract_all(without_scripts(html), F.lit("(?is)<p\\b[^>]*>(.*?)(?=</?p\\b|</article|</body|\\z)"), F.lit(1))
    return F.filter(F.transform(found, fx.plain_text), lambda x: (F.length(x) >= least) & ~x.rlike(boilerplate))


def article(pages: DataFrame, html: str = "html", least_body: int = 200) -> DataFrame:
    """pages with title, body (paragraphs by line breaks), published and refusal (null, or why the page is no article)."""
    rows = pages.withColumns({"title": title(F.col(html)), "body": F.array_join(paragraphs(F.col(html)), "\n"), "published": fx.date_stamp(F.coalesce(meta(F.col(html), "article:published_time"), F.lit("")))})
    refusal = F.when(fx.is_blank(F.col("title")), "no title").when(F.length("body") < least_body, "no body")
    return rows.withColumn("refusal", refusal)


def images(html: Column, skipped: str = "(?i)logo|icon|avatar|sprite|pixel") -> Column:
    """Image addresses, the declared one first, without decoration, each once."""
    declared = F.array(F.coalesce(meta(html, "og:image"), meta(html, "twitter:image"), F.lit("")))
    own = F.regexp_extract_all(html, F.lit("(?is)<img\\b[^>]*src=[\"']([^\"']+)[\"']"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(declared, own), lambda x: (x != "") & ~x.rlike(skipped)))


def _wanted(least: int, skipped: list[str]) -> Callable[[Column], Column]:
    """The test of a paragraph: its length, and no skipped phrase."""
    return lambda x: reduce(and_, [~F.contains(x, F.lit(phrase)) for phrase in skipped], F.length(x) >= least)


def ladder_body(html: Column, rungs: list[tuple[str, str, str, int]], skipped: list[str]) -> Column:
    """(rung, body) of the first rung that yields text: rungs are (name, container, paragraph, least characters).

    Container and paragraph are patterns with one group; the container may be
    '' for the whole page. Paragraphs that are shorter, or hold a skipped
    phrase, don't count.
    """
    page = without_scripts(html)
    found = F.lit(None).cast("struct<rung:string,body:string>")
    for name, container, paragraph, least in reversed(rungs):
        inside = F.regexp_extract(page, container, 1) if container else page
        texts = F.transform(F.regexp_extract_all(inside, F.lit(paragraph), F.lit(1)), fx.plain_text)
        body = F.array_join(F.filter(texts, _wanted(least, skipped)), "\n")
        found = F.when(body != "", F.struct(F.lit(name).alias("rung"), body.alias("body"))).otherwise(found)
    return found


def by_ladder(pages: DataFrame, titles: list[str], rungs: list[tuple[str, str, str, int]], skipped: list[str], date: str, html: str = "html") -> DataFrame:
    """pages with title, rung, body and published by a publisher's rule rows: the first title pattern, rung and date that match.

    A page without a title or body has nulls there; published is '' without a date.
    """
    page = F.col(html)
    names = [fx.plain_text(F.regexp_extract(without_scripts(page), t, 1)) for t in titles]
    rows = pages.withColumns({"title": first_of(names), "_b": ladder_body(page, rungs, skipped), "published": F.regexp_extract(page, date, 1)})
    return rows.withColumns({"rung": F.col("_b.rung"), "body": F.col("_b.body")}).drop("_b")


def dated_links(pages: DataFrame, path: str, target: str, days: int = 7, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, href, label, day) of anchors whose address has a date (three groups of path: year, month, day) in the days to target, both included.

    An address that stands several times on a page is listed once, with its
    first label that isn't blank; dates that the calendar lacks don't count.
    """
    part = lambda k: F.lpad(F.regexp_extract("href", path, k), 4 if k == 1 else 2, "0")
    found = links(pages, html, key).withColumn("day", F.try_to_date(F.concat_ws("-", part(1), part(2), part(3)), "yyyy-MM-dd"))
    last = F.lit(target).cast("date")
    found = found.filter(F.col("day").between(F.date_sub(last, days - 1), last))
    return found.groupBy(key, "href", "day").agg(F.first(F.when(~fx.is_blank(F.col("label")), F.col("label")), ignorenulls=True).alias("label"))
