"""Scalar expressions over text, URLs and dates, all as Spark columns."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the corpus rules read it: Unicode space and the ASCII separators x1C-x1F.
SPACE = "(?U)[\\s\\x1c-\\x1f]+"


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), 0)


def is_blank(x: Column) -> Column:
    return F.coalesce(collapse(x), F.lit("")) == ""


def content_hash(title: Column, text: Column) -> Column:
    return F.sha2(F.concat(collapse(F.coalesce(title, F.lit(""))), F.lit("\n"), collapse(F.coalesce(text, F.lit("")))), 256)


def strip_tags(title: Column) -> Column:
    """A title without the bracketed tags that precede it, however many."""
    head = "(?U)^\\s*(?:(?:【[^】]*】|\\[[^\\]]*\\])\\s*)+"
    return collapse(F.regexp_replace(F.coalesce(title, F.lit("")), head, ""))


def title_hash(title: Column) -> Column:
    """SHA-1 of the stripped title, '' for a blank one (which is in no group)."""
    t = strip_tags(title)
    return F.when(t == "", F.lit("")).otherwise(F.sha1(t))


def body_prefix_hash(text: Column, n: int = 200) -> Column:
    return F.sha1(F.left(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""), F.lit(n)))


def short_hash(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(16))


def date_stamp(x: Column) -> Column:
    """The leading yyyy-mm-dd of a text by its shape alone, else ''."""
    return F.coalesce(F.regexp_extract(F.trim(x), "^(\\d{4}-\\d{2}-\\d{2})", 1), F.lit(""))


def calendar_date(x: Column) -> Column:
    """The date of a text, null where the calendar has none such."""
    return F.try_to_date(x, "yyyy-MM-dd")


def monday(d: Column) -> Column:
    return F.date_trunc("week", d).cast("date")


def saturday_ending(d: Column) -> Column:
    """The Saturday that ends a date's week; a Sunday belongs to the day before."""
    return F.date_add(F.date_trunc("week", d).cast("date"), 5)


def long_date(d: Column) -> Column:
    return F.date_format(d, "d MMMM yyyy")


def days_since(x: Column, as_of: Column) -> Column:
    return F.datediff(as_of, calendar_date(F.left(x, F.lit(10))))


def url_host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def first_directory(url: Column) -> Column:
    """The first directory of a URL's path, '' if it has none."""
    return F.coalesce(F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/([^/]+)/", 1), F.lit(""))


def url_section(url: Column, hosts: list[str]) -> Column:
    """The section of a URL: its first directory on the hosts whose directories are sections, '' on any other."""
    return F.when(url_host(url).isin(hosts), first_directory(url)).otherwise("")


def url_key(url: Column) -> Column:
    """A URL in lower case without scheme, and without 'www.' or else without its last slashes."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$", "")), "^https?://", "")
    return F.when(bare.startswith("www."), F.substr(bare, F.lit(5))).otherwise(F.regexp_replace(bare, "/+$", ""))


def url_canonical(url: Column) -> Column:
    """Scheme, host and path of a URL with a final slash, without query and fragment; null for other schemes."""
    path = F.regexp_extract(url, "^(https://[^/?#]+[^?#]*)", 1)
    return F.when(path != "", F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/")))


def url_allowed(url: Column, host: str, path: str) -> Column:
    """The canonical form of a URL of one https host whose path matches a pattern; null for any other."""
    own = url_canonical(F.trim(url))
    return F.when((url_host(own) == host) & F.regexp_extract(own, "^https://[^/]+(/.*)$", 1).rlike(path), own)


def excerpt(x: Column, n: int = 300, tail: str = "...") -> Column:
    """At most n characters, cut at the last white space before, with a tail if cut."""
    cut = F.rtrim(F.regexp_replace(F.left(x, F.lit(n)), "\\s\\S*$", ""))
    return F.when(F.length(x) <= n, x).otherwise(F.concat(cut, F.lit(tail)))


def mapped(table: dict, key: Column, default: object) -> Column:
    """A small fixed table as an expression."""
    if not table:
        return F.lit(default)
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def language_subtag(tag: Column) -> Column:
    """The primary subtag of two or three letters in lower case; null for other tags."""
    first = F.lower(F.element_at(F.split(tag, "-"), 1))
    return F.when(first.rlike("^[a-z]{2,3}$"), first)


def is_language_tag(tag: Column) -> Column:
    return F.coalesce(tag.rlike("^[A-Za-z]{2,3}(-[A-Za-z0-9]+)*$"), F.lit(False))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x within the bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def json_object(raw: Column, schema: str) -> Column:
    """The outermost {...} of a model's answer, parsed; null if it is none."""
    return F.from_json(F.regexp_extract(raw, "(?s)\\{.*\\}", 0), schema)


def plain_text(markup: Column) -> Column:
    """Short markup without tags, with the five named references, in one line."""
    out = F.regexp_replace(markup, "(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return collapse(out)


def escaped(x: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(char), F.lit(name))
    return x


def leading_ideographs(title: Column, n: int = 2) -> Column:
    return F.left(F.regexp_extract(title, "^[\\u4e00-\\u9fff\\u3400-\\u4dbf]+", 0), F.lit(n))


def one_line(x: Column, n: int = 200) -> Column:
    """A message in one line of at most n characters, the last an ellipsis if cut."""
    line = collapse(x)
    return F.when(F.length(line) <= n, line).otherwise(F.concat(F.left(line, F.lit(n - 1)), F.lit("…")))


def slug_date(slug: Column) -> Column:
    """The date of a slug that begins with ddmonyy, such as 15aug26; null if it has none."""
    part = lambda k: F.regexp_extract(F.lower(slug), "^(\\d{1,2})([a-z]{3})(\\d{2})(?![0-9])", k)
    months = {m: f"{k:02d}" for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
    return F.try_to_date(F.concat(F.lit("20"), part(3), F.lit("-"), mapped(months, part(2), "00"), F.lit("-"), F.lpad(part(1), 2, "0")), "yyyy-MM-dd")


def url_normal(url: Column) -> Column:
    """Scheme and host in lower case and the path without last slashes; the path alone where there is no host."""
    x = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(x, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    scheme = F.lower(F.regexp_extract(x, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(x, "^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    return F.when(host != "", F.concat(scheme, F.lit("://"), host, path)).otherwise(path)


def url_domain(url: Column) -> Column:
    """The host and port of a URL as written, or what was given."""
    host = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.when(host != "", host).otherwise(url)


#: Tokens of a slug and the kind of publication they mean (fixed values).
KINDS = {"nr": "news release", "speech": "speech", "fs": "fact sheet", "mq": "ministerial question", "pq": "parliamentary question"}


def publication_kind(url: Column) -> Column:
    """The kind that a URL's last part names after its date and before its number, else 'other'."""
    tail = F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1)
    token = F.regexp_replace(F.regexp_replace(tail, "^\\d{1,2}[a-z]{3}\\d{2}[-_]", ""), "\\d+$", "")
    return mapped(KINDS, token, "other")


def american_date(d: Column) -> Column:
    return F.date_format(d, "MMMM d, yyyy")


def date_range(a: Column, b: Column) -> Column:
    """Two dates as a range, as short as their months and years allow; '' if one is missing."""
    same = lambda pattern: F.date_format(a, pattern) == F.date_format(b, pattern)
    short = lambda d: F.date_format(d, "MMM d")
    return (
        F.when(a.isNull() | b.isNull(), "")
        .when(a == b, american_date(a))
        .when(same("yyyy-MM"), F.concat(F.date_format(a, "MMMM d"), F.lit("–"), F.date_format(b, "d, yyyy")))
        .when(same("yyyy"), F.concat(short(a), F.lit("–"), short(b), F.date_format(b, ", yyyy")))
        .otherwise(F.concat(short(a), F.date_format(a, " yyyy"), F.lit("–"), short(b), F.date_format(b, " yyyy")))
    )


def short_title(title: Column, other: Column, n: int = 110) -> Column:
    """The first title that isn't empty, else Untitled, cut at a space before n characters with an ellipsis."""
    x = F.trim(F.coalesce(F.nullif(title, F.lit("")), F.nullif(other, F.lit("")), F.lit("Untitled")))
    cut = F.regexp_replace(F.regexp_replace(F.left(x, F.lit(n)), " [^ ]*$", ""), "[,;: ]+$", "")
    return F.when(F.length(x) <= n, x).otherwise(F.concat(cut, F.lit("…")))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def edition_label(kind: Column, days: Column) -> Column:
    """The label of an edition, marked where it covers fewer than four days."""
    base = F.when(kind == "significant", "Significant").otherwise("Routine")
    return F.when(days < 4, F.concat(F.lit("Thin week · "), F.lower(base))).otherwise(base)


def tokens(x: Column, stop: list[str], banned: list[str] | None = None) -> Column:
    """Words of three characters or more in lower case, without punctuation, stop words and banned words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "(?U)[^\\w'-]+", " ")), " ")
    out = [*stop, *(banned or [])]
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(out)) if out else F.filter(words, lambda w: F.length(w) > 2)


def sentences(x: Column) -> Column:
    """The sentences of a text: it is cut at white space after a full stop, a question or an exclamation mark."""
    return F.filter(F.split(F.trim(F.coalesce(x, F.lit(""))), "(?<=[.!?])\\s+"), lambda s: s != "")


def n_words(x: Column) -> Column:
    return F.size(F.filter(F.split(collapse(F.coalesce(x, F.lit(""))), " "), lambda w: w != ""))


def repeats_headline(x: Column, headline: Column, n: int = 6) -> Column:
    """Whether a text begins with the first n words of its headline (all of a shorter one), in any case."""
    first = lambda c: F.slice(F.split(collapse(F.lower(F.coalesce(c, F.lit("")))), " "), 1, n)
    return (F.size(first(headline)) <= F.size(first(x))) & (F.slice(first(x), 1, F.size(first(headline))) == first(headline)) & ~is_blank(headline)


def json_strings(document: Column) -> Column:
    """All string values of a JSON text, at any depth, in order; names of fields don't count."""
    marked = F.regexp_replace(document, "\"((?:[^\"\\\\]|\\\\.)*)\"", "\u0002$1\u0003")  # control characters are escaped inside JSON strings
    found = F.regexp_extract_all(marked, F.lit("\u0002([^\u0003]*)\u0003(?!\\s*:)"), F.lit(1))
    return F.transform(found, lambda s: F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), 0))


def required(x: Column, what: str) -> Column:
    """x, which stops the query where it is blank: for texts that may not be published without it."""
    return F.when(is_blank(x), F.raise_error(F.lit(f"missing {what}")).cast("string")).otherwise(x)


def citation(author: Column, title: Column, date: Column, url: Column) -> Column:
    return F.concat(required(author, "author"), F.lit(", “"), required(title, "title"), F.lit(",” "), long_date(date), F.lit(", "), required(url, "url"), F.lit("."))
