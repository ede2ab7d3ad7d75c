"""Queries of drifting JSON documents, edition bodies and media metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import variants as vx
from foliant.operators import sidecars
from foliant.plans.corpus import EDITIONS, editions
from foliant.plans.page_queries import stripped
from foliant.plans.registry import query
from foliant.sources.markup import trees
from foliant.sources.snapshots import spread, table


def _drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props as they are for even ids, deep inside another document for odd ones."""
    deep = F.concat(F.lit('{"n": {"props": '), "props", F.lit(', "tag": "t-'), "event_type", F.lit('"}, "list": [1, ["two", {}], null]}'))
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(deep).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '$.' ELSE '$.n.props.' END || j.key AS path, CAST(j.value AS VARCHAR) AS value FROM events, json_each(props) j
UNION ALL SELECT event_id, unnest(['$.list[0]', '$.list[1][0]', '$.list[2]', '$.n.tag']), unnest(['1', 'two', NULL, 't-' || event_type]) FROM events WHERE event_id % 2 = 1""")
def prop_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value in the events' documents with its path."""
    rows = _drifting(spark, sf_dir).select("event_id", F.explode(vx.leaves(F.col("text"))).alias("x"))
    return rows.select("event_id", "x.path", F.try_variant_get("x.value", "$", "string").alias("value"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 2 = 1 THEN 't-' || event_type ELSE 'untagged' END AS tag FROM events")
def drifting_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that have moved between the two shapes."""
    doc = vx.parsed(F.col("text"))
    return _drifting(spark, sf_dir).select("event_id", vx.field(doc, ["$.k", "$.n.props.k"], "int").alias("k"), F.coalesce(vx.field(doc, ["$.tag", "$.n.tag"]), F.lit("untagged")).alias("tag"))


@query(f"""WITH {EDITIONS} SELECT CAST(date AS VARCHAR) AS date, CASE WHEN n_articles % 2 = 0 THEN 'term — ' || n_articles ELSE 'flat ' || n_articles END AS term, 'about ' || n_articles AS explanation, CAST(CASE WHEN n_articles % 3 = 0 THEN 4 ELSE 7 END AS INTEGER) AS days_covered,
CASE WHEN n_articles % 2 = 0 THEN 'label ' || n_articles ELSE 'a.example' END AS title, CASE WHEN n_articles % 2 = 0 THEN 'first' ELSE 'own' END AS source, n_articles % 2 = 0 AS is_significant FROM editions""")
def edition_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Editions written as sidecars of two shapes and read in one."""
    rows = editions(spark, sf_dir)
    n, day = F.col("n_articles").cast("string"), F.col("date").cast("string")
    quoted = lambda *parts: F.concat(F.lit('"'), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit('"'))
    written = lambda **fields: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": '), v) for k, v in fields.items()]), F.lit("}"))
    listed = lambda x: F.concat(F.lit("["), x, F.lit("]"))
    stated = F.when(F.col("n_articles") % 3 == 0, "4").otherwise("0")
    start = F.date_sub("date", 6).cast("string")
    nested = written(
        date=quoted(day), week_start=quoted(start), days_covered=stated, term_to_know=written(term=quoted("term"), term_translation=quoted(n), explanation=quoted("about ", n)),
        sources_seen=F.lit('["first", "second"]'), source_trail=listed(written(label=quoted("label ", n), url=quoted("u"), is_significant=F.lit("1"))),
    )
    flat = written(
        week_ending=quoted(day), date=quoted(day), week_start=quoted(start), days_covered=quoted(stated), term_to_know_term=quoted("flat ", n), term_to_know_explanation=quoted("about ", n),
        source_trail=listed(written(url=quoted("https://www.a.example/x"), source=quoted("own"))),
    )
    found = sidecars.editions(rows.select(F.when(F.col("n_articles") % 2 == 0, nested).otherwise(flat).alias("text")))
    rows = found.select("date", "term", "explanation", "days_covered", F.explode("articles").alias("a"))
    return rows.select("date", "term", "explanation", "days_covered", "a.title", "a.source", "a.is_significant")


_PARTS = "(SELECT doc_id, unnest(['what_stood_out', 'opening_note', 'signal']) AS field, unnest([list_filter(lines[:3], lambda x: x <> ''), list_filter(lines[4:], lambda x: x <> ''), list_filter(lines[:1], lambda x: x <> '')]) AS own FROM l)"


@query(f"""WITH l AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {stripped("x")}) AS lines FROM documents)
SELECT doc_id, field, array_to_string(own, chr(10) || chr(10)) AS text FROM {_PARTS} WHERE len(own) > 0""")
def edition_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents published as edition pages, three lines under one heading and the rest under another, and read back by section."""
    escaped = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    lines = F.split(escaped, "\n")
    paragraphs = lambda x: F.array_join(F.transform(x, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n")
    section = lambda heading, x: F.concat(F.lit(f'<div><div class="mod-heading brand">{heading}</div> <div class="section-text">'), paragraphs(x), F.lit("</div></div>"))
    rest = F.slice(lines, 4, F.greatest(F.size(lines) - 3, F.lit(0)))
    signal = F.concat(F.lit('<div class="signal-text"><em>'), F.get(lines, 0), F.lit("</em></div>"))
    html = F.concat(section("What Stood Out", F.slice(lines, 1, 3)), section("Unknown", F.array(F.lit("of no field"))), section("opening note", F.slice(rest, 1, 1)), section("Opening note", rest), signal)
    html = F.when(F.size(rest) == 0, F.concat(section("What Stood Out", F.slice(lines, 1, 3)), signal)).otherwise(html)
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit("u").alias("url"), html.alias("html"))
    return sidecars.sections(trees(pages)).select("doc_id", F.explode("fields").alias("field", "text"))


@query("""SELECT p_name || ' ' || p_partkey AS title, 'http://i.example/' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN 'image/jpeg' ELSE 'image/png' END AS mime, CAST(p_size * 50 AS INTEGER) AS width, CASE WHEN p_partkey % 4 = 0 THEN 'CC BY' WHEN p_partkey % 4 = 1 THEN 'cc0' ELSE 'Unknown' END AS license_label, p_brand || ' & Co' AS artist,
CASE WHEN p_partkey % 2 = 0 THEN 'http://d.example/' || p_partkey ELSE 'https://commons.wikimedia.org/wiki/' || replace(p_name || ' ' || p_partkey, ' ', '_') END AS description_url FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 5 <> 0""")
def media_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as metadata of a picture archive: other media types and entries without a URL go."""
    key = F.col("p_partkey")
    text = lambda x: F.struct(x.alias("value"))
    about = F.struct(
        text(F.when(key % 4 == 0, "<b>CC BY</b>").otherwise("")).alias("LicenseShortName"),
        text(F.when(key % 4 == 1, "cc0")).alias("License"),
        text(F.concat("p_brand", F.lit(" &amp; <i>Co</i>"))).alias("Artist"),
    )
    doc = F.to_json(
        F.struct(
            F.when(key % 5 != 0, F.concat(F.lit("http://i.example/"), key.cast("string"))).otherwise("").alias("url"),
            F.when(key % 3 == 0, "image/jpeg").when(key % 3 == 1, "image/png").otherwise("image/svg+xml").alias("mime"),
            (F.col("p_size") * 50).alias("width"),
            about.alias("extmetadata"),
            F.when(key % 2 == 0, F.concat(F.lit("http://d.example/"), key.cast("string"))).alias("descriptionurl"),
        )
    )
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select(F.concat("p_name", F.lit(" "), key.cast("string")).alias("title"), doc.alias("text"))
    return sidecars.candidates(rows).select("title", "url", "mime", "width", "license_label", "artist", "description_url")
