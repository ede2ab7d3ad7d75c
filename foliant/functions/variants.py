"""JSON documents whose shape drifts, as VARIANT values: fields by alternative paths, and walks to any depth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM = "struct<path:string,value:variant>"


def parsed(text: Column) -> Column:
    """The document of a JSON text, null if it isn't one, or has more behind it.

    The parser stops after one value. A text that is the one item of a list,
    and the value of a field too, has nothing behind its value.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & named.isNotNull(), F.get(listed, 0))


def field(document: Column, paths: list[str], kind: str = "string") -> Column:
    """The first of the paths that holds a value of the kind, for strings one that isn't empty; null if none does."""
    found = [F.try_variant_get(document, p, kind) for p in paths]
    return F.coalesce(*[F.nullif(x, F.lit("")) if kind == "string" else x for x in found])


def items(document: Column, path: str) -> Column:
    """The items of the list at a path, as documents; none if there is no list."""
    return F.coalesce(F.try_variant_get(document, path, "array<variant>"), F.array().cast("array<variant>"))


def _children(x: Column) -> Column:
    """The items inside a container with their paths, null for what is none."""
    members = F.try_variant_get(x["value"], "$", "map<string,variant>")
    listed = F.try_variant_get(x["value"], "$", "array<variant>")
    by_name = F.transform(F.map_entries(members), lambda e: F.struct(F.concat(x["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("value")))
    by_place = F.transform(listed, lambda v, i: F.struct(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")).alias("path"), v.alias("value")))
    return F.coalesce(by_name, by_place)


def leaves(text: Column) -> Column:
    """(path, value) of all values in a JSON text that hold no others, in order; fields of an object by name.

    Each step opens all containers that are left, in place. A text can't nest
    deeper than it has brackets, and steps after the last container do nothing.
    A text that is no JSON gives null, an empty container nothing.
    """
    root = F.array(F.struct(F.lit("$").alias("path"), parsed(text).alias("value")))
    opened = lambda level: F.flatten(F.transform(level, lambda x: F.coalesce(_children(x), F.array(x))))
    closed = lambda level: ~F.exists(level, lambda x: _children(x).isNotNull())
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.regexp_count(text, F.lit("[\\[{]"))))
    walked = F.aggregate(steps, root.cast(f"array<{ITEM}>"), lambda level, _: F.when(closed(level), level).otherwise(opened(level)))
    return F.when(parsed(text).isNotNull(), walked)


def strings(text: Column) -> Column:
    """All string values of a JSON text at any depth, in the order of leaves(); names of fields don't count."""
    texts = F.filter(leaves(text), lambda x: F.schema_of_variant(x["value"]) == "STRING")
    return F.transform(texts, lambda x: F.try_variant_get(x["value"], "$", "string"))
