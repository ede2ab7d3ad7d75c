"""Records on their way into the store: normal form, insertion, releases from pages, model answers, lint of summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.functions import variants as vx
from foliant.operators.ladders import strip, whole_text
from foliant.operators.lineage import numbered

#: Inline elements that prose may have (fixed values), without attributes.
INLINE = ["strong", "em"]
#: Parts of paths and ends of addresses that mark decoration (fixed values).
DECORATION = ["/template/", "/img/share", "/img/logo", "/img/icon", "/themes/", "/static/", "/common/"]
DECORATIVE_ENDS = [".gif", ".svg", ".ico", ".bmp"]
#: A release of fewer characters is none (fixed value).
LEAST_BODY = 200


def normalized(articles: DataFrame) -> DataFrame:
    """articles with title_original and text_original in normal white space, published_date as yyyy-mm-dd or '', and content_hash of both texts; nulls are ''."""
    text = lambda c: fx.collapse(F.coalesce(c, F.lit("")))
    rows = articles.withColumns({c: text(c) for c in ("title_original", "text_original")} | {"published_date": fx.date_stamp(F.coalesce(F.col("published_date").cast("string"), F.lit("")))})
    return rows.withColumn("content_hash", fx.content_hash(F.col("title_original"), F.col("text_original")))


def inserted(store: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows to append to the store (id, url, source_id, ...): articles (url, source_slug, ..., and a numeric position) that it lacks by URL.

    Each URL is one row, of the least position; ids go on above the store's, in
    that order. A slug that sources (id, slug) lacks stops the query, as does a
    null URL: such an article is never skipped. URLs of the store are skipped.
    """
    known = sources.select(F.col("id").alias("source_id"), F.col("slug").alias("source_slug"))
    refused = lambda what, x: F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("long")
    rows = articles.join(known, "source_slug", "left")
    rows = rows.withColumn("source_id", F.coalesce("source_id", refused("unknown source", F.col("source_slug"))))
    rows = rows.withColumn("url", F.coalesce("url", refused("an article without a URL at", F.col("position")).cast("string")))
    others = [c for c in rows.columns if c not in ("url", "position")]
    first = rows.groupBy("url").agg(F.min(F.struct("position", *others)).alias("f")).select("url", "f.*")
    new = numbered(first.join(store.select("url"), "url", "left_anti"), order="position", into="n_")
    top = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top_"))  # one row
    return new.join(F.broadcast(top)).withColumn("id", F.col("top_") + F.col("n_")).drop("top_", "n_", "position", "source_slug")


def releases(trees: DataFrame, published: Column, nodes: str = "nodes", least: int = LEAST_BODY) -> DataFrame:
    """trees with title, body and refusal of ministry releases: one whole record or none.

    The title is the page's declared one, or else its first heading; the body
    all text after the first heading (of the page, where there is none or
    nothing follows). refusal is 'no title', 'no date' or 'short body', null
    for a record; what is refused has null title and body.
    """
    tree = F.col(nodes)
    first = lambda test: F.slice(F.filter(tree, test), 1, 1)
    declared = F.get(F.transform(first(lambda n: (n["tag"] == "meta") & (n["name"] == "og:title")), lambda n: strip(F.coalesce(n["content"], F.lit("")))), 0)
    h1 = first(lambda n: n["tag"] == "h1")
    heading = F.get(F.transform(h1, lambda n: fx.collapse(whole_text(tree, n))), 0)
    words = lambda scope: fx.collapse(F.array_join(F.transform(F.filter(scope, lambda n: n["tag"] == "#text"), lambda n: n["text"]), " "))
    after = F.get(F.transform(h1, lambda n: words(F.slice(tree, n["last"] + 2, F.size(tree)))), 0)
    title = F.coalesce(F.nullif(declared, F.lit("")), F.nullif(heading, F.lit("")))
    body = F.coalesce(F.nullif(after, F.lit("")), words(tree))
    rows = trees.withColumns({"title": title, "body": body})
    refusal = F.when(F.col("title").isNull(), "no title").when(F.coalesce(published.cast("string"), F.lit("")) == "", "no date").when(F.length("body") < least, "short body")
    told = rows.withColumn("refusal", refusal)
    return told.withColumns({c: F.when(F.col("refusal").isNull(), F.col(c)) for c in ("title", "body")})


def pictures(trees: DataFrame, base: Column, nodes: str = "nodes") -> DataFrame:
    """trees with declared, the picture that the page declares (og:image or else twitter:image), and images, those in its content in order, without decoration.

    Addresses are absolute by the page's own (base): with a host, from its
    root, or beside the page. data: addresses are none.
    """
    tree = F.col(nodes)
    root, folder = F.regexp_extract(base, "^(https?://[^/?#]+)", 1), F.regexp_extract(base, "^(https?://[^?#]*/)", 1)
    absolute = lambda u: F.when(u.rlike("(?i)^[a-z][a-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), u)).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(folder, u))
    meta = lambda name: F.get(F.transform(F.filter(tree, lambda n: (n["tag"] == "meta") & (n["name"] == name) & (F.coalesce(n["content"], F.lit("")) != "")), lambda n: strip(n["content"])), 0)
    declared = F.coalesce(meta("og:image"), meta("twitter:image"))
    raw = F.transform(F.filter(tree, lambda n: (n["tag"] == "img") & (F.coalesce(strip(n["src"]), F.lit("")) != "") & ~strip(n["src"]).startswith("data:")), lambda n: absolute(strip(n["src"])))
    path = lambda u: F.lower(F.regexp_extract(u, "^[^:]+://[^/?#]*([^?#]*)", 1))
    plain = lambda u: reduce(lambda a, b: a & b, [~F.contains(path(u), F.lit(x)) for x in DECORATION] + [~path(u).endswith(x) for x in DECORATIVE_ENDS])
    return trees.withColumns({"declared": F.when(declared.isNotNull(), absolute(declared)), "images": F.filter(raw, plain)})


def inline_markup(x: Column) -> Column:
    """A text escaped for HTML, but for the bare elements of INLINE; null is empty."""
    out = F.replace(fx.escaped(F.coalesce(x, F.lit(""))), F.lit("'"), F.lit("&#39;"))
    for tag in INLINE:
        for mark in (tag, f"/{tag}"):
            out = F.replace(out, F.lit(f"&lt;{mark}&gt;"), F.lit(f"<{mark}>"))
    return out


def model_answer(raw: Column) -> Column:
    """The JSON object in a model's answer as a document: without a fence, or from the first { to the last }; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), "^\\s*```(?:json)?\\s*\\n?", ""), "\\n?\\s*```\\s*$", "")
    cut = F.when(strip(bare).startswith("{"), strip(bare)).otherwise(F.regexp_extract(F.coalesce(raw, F.lit("")), "(?s)\\{.*\\}", 0))
    doc = vx.parsed(cut)
    return F.when(F.try_variant_get(doc, "$", "map<string,variant>").isNotNull(), doc)


def summary_lint(title: Column, summary: Column, openers: list[str], phrases: list[str], most_sentences: int = 4, most_words: int = 90, excerpt: int = 300) -> Column:
    """Findings on a summary, in a fixed order: its opener (the first that matches), phrases, length, a repeated headline of eight words or more, a long first sentence.

    An empty summary is the one finding 'empty summary'.
    """
    words = lambda x: F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9 ]", ""), " +"), lambda w: w != "")
    told = lambda s, head: fx.bound(F.struct(s.alias("s"), head.alias("head"), F.lower(s).alias("low"), fx.sentences(s).alias("parts"), fx.n_words(s).alias("n")), checks)

    def checks(x: Column) -> Column:
        return _lint(x["s"], x["low"], x["parts"], x["n"], x["head"], words, openers, phrases, most_sentences, most_words, excerpt)

    return fx.bound(F.struct(fx.collapse(F.coalesce(summary, F.lit(""))).alias("s"), words(F.coalesce(title, F.lit(""))).alias("head")), lambda x: told(x["s"], x["head"]))


def _lint(s: Column, low: Column, parts: Column, n: Column, head: Column, words: Callable[[Column], Column], openers: list[str], phrases: list[str], most_sentences: int, most_words: int, excerpt: int) -> Column:
    opened = reduce(lambda a, b: F.coalesce(a, b), [F.when(low.startswith(o), F.lit(f"opener: {o}")) for o in openers], F.lit(None).cast("string"))
    found = [F.when(F.contains(low, F.lit(p)), f"phrase: {p}") for p in phrases]
    repeats = (F.size(head) >= 8) & (F.slice(words(s), F.lit(1), F.greatest(F.size(head), F.lit(1))) == head)
    first = F.length(F.get(parts, 0))
    checks = [
        opened, *found,
        F.when(F.size(parts) > most_sentences, F.concat(F.size(parts).cast("string"), F.lit(" sentences"))),
        F.when(n > most_words, F.concat(n.cast("string"), F.lit(" words"))),
        F.when(repeats, "repeats the headline"),
        F.when(first > excerpt, F.concat(F.lit("first sentence of "), first.cast("string"), F.lit(" characters"))),
    ]
    return F.when(s == "", F.array(F.lit("empty summary"))).otherwise(F.filter(F.array(*checks), lambda x: x.isNotNull()))


