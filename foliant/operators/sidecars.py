"""Edition sidecars of any shape, the sections of a published edition, and candidate pictures from metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.functions import variants as vx
from foliant.operators.ladders import inside, strip, whole_text

ARTICLE = "struct<title:string,title_zh:string,url:string,source:string,date:string,is_significant:boolean>"
#: Media types of pictures that may be published (fixed values).
PICTURES = ["image/jpeg", "image/png", "image/webp"]


def _flag(document: Column) -> Column:
    """A flag written as a boolean, a number or a text."""
    number = F.try_variant_get(document, "$", "double")
    return F.coalesce(F.try_variant_get(document, "$", "boolean"), number != 0, F.try_variant_get(document, "$", "string") != "", F.lit(False))


def _entry(e: Column, default_source: Column, trail: bool) -> Column:
    one = lambda *paths: F.coalesce(vx.field(e, list(paths)), F.lit(""))
    url = one("$.url")
    host = F.regexp_replace(fx.url_host(url), "^www\\.", "")
    title = F.coalesce(vx.field(e, ["$.label", "$.title"]), F.nullif(host, F.lit("")), url) if trail else one("$.title")
    source = F.coalesce(vx.field(e, ["$.source"]), default_source) if trail else one("$.source")
    flag = _flag(F.try_variant_get(e, "$.is_significant", "variant"))
    return F.struct(title.alias("title"), one("$.title_zh").alias("title_zh"), url.alias("url"), source.alias("source"), one("$.date").alias("date"), flag.alias("is_significant"))


def editions(sidecars: DataFrame, text: str = "text") -> DataFrame:
    """sidecars with what their JSON says in one shape: date, term, explanation, days_covered, articles, and corrupt for a text that is no JSON object.

    The term is nested (term, translation, explanation) or flat; articles are
    listed as such or come from the source trail, whose entries have a label
    or a title, or else the host of their URL, and the first seen source where
    they name none. days_covered is stated or counted from the week's dates,
    0 without them. Values that are missing, empty or of another kind are ''.
    """
    doc = vx.parsed(F.col(text))
    whole = F.try_variant_get(doc, "$", "map<string,variant>").isNotNull()
    nested = F.try_variant_get(doc, "$.term_to_know", "map<string,variant>").isNotNull()
    get = lambda *paths: vx.field(doc, list(paths))
    word, translated = get("$.term_to_know.term"), get("$.term_to_know.term_translation")
    term = F.when(nested, F.concat_ws(" — ", word, translated)).otherwise(get("$.term_to_know_term"))
    explanation = F.when(nested, get("$.term_to_know.explanation")).otherwise(get("$.term_to_know_explanation"))
    stated = F.nullif(F.coalesce(F.try_variant_get(doc, "$.days_covered", "int"), get("$.days_covered").try_cast("int")), F.lit(0))
    start, end = fx.calendar_date(get("$.week_start")), fx.calendar_date(get("$.week_ending", "$.date"))
    days = F.coalesce(stated, F.when(F.datediff(end, start).isNotNull(), F.greatest(F.lit(1), F.datediff(end, start) + 1)), F.lit(0))
    seen = F.coalesce(F.get(F.transform(vx.items(doc, "$.sources_seen"), lambda v: F.try_variant_get(v, "$", "string")), 0), F.lit(""))
    listed = F.transform(vx.items(doc, "$.articles"), lambda e: _entry(e, seen, False))
    trail = F.transform(vx.items(doc, "$.source_trail"), lambda e: _entry(e, seen, True))
    new = {
        "date": F.coalesce(get("$.date"), F.lit("")),
        "term": F.coalesce(term, F.lit("")),
        "explanation": F.coalesce(explanation, F.lit("")),
        "days_covered": F.when(whole, days),
        "articles": F.when(F.size(listed) > 0, listed).otherwise(trail),
        "corrupt": ~F.coalesce(whole, F.lit(False)),
    }
    kept = [c for c in sidecars.columns if c not in new and c != text]
    return sidecars.select(*kept, *[v.alias(k) for k, v in new.items()])


#: Heading texts of published editions and the fields they head (fixed values, old wordings included).
HEADINGS = {
    "opening note": "opening_note",
    "what stood out": "what_stood_out",
    "why it matters": "why_it_matters",
    "routine baseline": "what_was_routine",
    "what was routine": "what_was_routine",
    "what i'm watching next": "what_im_watching_next",
    "what i’m watching next": "what_im_watching_next",
}


def _classed(n: Column, name: str) -> Column:
    return (n["tag"] == "div") & F.contains(n["class"], F.lit(name)) & F.array_contains(F.split(F.coalesce(n["class"], F.lit("")), "\\s+"), name)


def _paragraphs(nodes: Column, n: Column) -> Column:
    texts = F.transform(F.filter(inside(nodes, n), lambda p: p["tag"] == "p"), lambda p: strip(whole_text(nodes, p)))
    return F.array_join(F.filter(texts, lambda x: x != ""), "\n\n")


def sections(trees: DataFrame, nodes: str = "nodes") -> DataFrame:
    """trees (sources.markup.trees) with fields, a map of field and text: the body of a published edition.

    A heading's section is the element right after it, and its text the
    paragraphs in that, a blank line between them. Headings that are unknown,
    or have no such section or no text, give nothing; of a field that is
    headed twice the last text counts. Term, explanation (paragraphs, or else
    the plain text) and signal are the first of their kind on the page.
    """
    tree = F.col(nodes)
    named = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])
    headings = F.filter(tree, lambda n: _classed(n, "mod-heading"))

    def section(h: Column) -> Column:
        after = F.filter(F.slice(tree, h["last"] + 2, F.size(tree)), lambda n: (n["parent"] == h["parent"]) & (n["tag"] != "#text"))
        own = F.filter(F.slice(after, 1, 1), lambda n: _classed(n, "section-text"))
        return F.struct(F.element_at(named, F.lower(strip(whole_text(tree, h)))).alias("field"), F.get(F.transform(own, lambda n: _paragraphs(tree, n)), 0).alias("text"))

    def first(name: str, text_of) -> Column:
        found = F.slice(F.filter(tree, lambda n: _classed(n, name)), 1, 1)
        return F.get(F.transform(found, text_of), 0)

    plain = lambda n: strip(whole_text(tree, n))
    told = lambda n: F.coalesce(F.nullif(_paragraphs(tree, n), F.lit("")), plain(n))
    single = [("term_to_know_term", first("term-word", plain)), ("term_to_know_explanation", first("term-explanation", told)), ("signal", first("signal-text", plain))]
    every = F.concat(F.transform(headings, section), F.array(*[F.struct(F.lit(k).alias("field"), v.alias("text")) for k, v in single]))

    def last(full: Column) -> Column:
        fields = F.array_distinct(F.transform(full, lambda s: s["field"]))
        return F.transform(fields, lambda f: F.struct(f.alias("key"), F.element_at(F.filter(full, lambda s: s["field"] == f), -1)["text"].alias("value")))

    full = F.filter(every, lambda s: s["field"].isNotNull() & (F.coalesce(s["text"], F.lit("")) != ""))
    return trees.withColumn("fields", F.map_from_entries(fx.bound(full, last)))


def candidates(metadata: DataFrame, text: str = "text", title: str = "title") -> DataFrame:
    """The pictures that the metadata (a JSON text each) of a media archive allows: those with a URL and a media type of PICTURES.

    Texts of the metadata are without markup; the licence is its short name,
    else the licence field, else Unknown; a page without an address of its own
    has one made of the title. Numbers that are missing are 0.
    """
    # A document is parsed once: what is asked of an exploded column is not moved below the parse.
    metadata = metadata.select(F.col(title).alias("title"), F.explode(F.array(vx.parsed(F.col(text)))).alias("doc"))
    doc = F.col("doc")
    about = lambda name: F.coalesce(fx.plain_text(F.coalesce(vx.field(doc, [f"$.extmetadata.{name}.value"]), F.lit(""))), F.lit(""))
    short, licence = about("LicenseShortName"), about("License")
    number = lambda p: F.coalesce(F.try_variant_get(doc, p, "int"), F.lit(0))
    url, mime = vx.field(doc, ["$.url"]), vx.field(doc, ["$.mime"])
    rows = metadata.select(
        "title",
        url.alias("url"),
        mime.alias("mime"),
        number("$.width").alias("width"),
        number("$.height").alias("height"),
        F.coalesce(F.nullif(short, F.lit("")), F.nullif(licence, F.lit("")), F.lit("Unknown")).alias("license_label"),
        about("Artist").alias("artist"),
        about("ImageDescription").alias("description"),
        F.coalesce(vx.field(doc, ["$.descriptionurl"]), F.concat(F.lit("https://commons.wikimedia.org/wiki/"), F.replace(F.col("title"), F.lit(" "), F.lit("_")))).alias("description_url"),
    )
    return rows.filter(F.col("mime").isin(PICTURES) & F.col("url").isNotNull())
