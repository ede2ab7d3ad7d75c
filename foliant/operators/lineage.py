"""Lineage of rows whose ids were changed: equal payloads matched n-th to n-th, proofs, and which side was published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.snapshots import fingerprint, fingerprint_words

#: Ids are numbered in spans of 2^SPAN_BITS, so that no group that is put in order holds more ids than that.
SPAN_BITS = 20
WORDS = [f"h{k}" for k in range(4)]


class Refused(ValueError):
    """What was asked for can't be proven."""


def numbered(rows: DataFrame, payload: list[Column] | None = None, order: str = "id", into: str = "n") -> DataFrame:
    """rows with their number (from 1) in the order of a numeric id, among those of equal payload if one is given.

    Rows are put in order inside spans of ids only; the sizes of the spans
    before are added. A payload that a third of all rows share is therefore as
    many groups as it has spans. Equal ids are numbered in any order; a null
    id comes first.
    """
    keys = {f"_k{i}": c for i, c in enumerate(payload or [])}
    spanned = rows.withColumns(keys | {"_span": F.coalesce(F.shiftright(F.col(order), SPAN_BITS), F.lit(-(1 << 62)))})
    sizes = spanned.groupBy(*keys, "_span").agg(F.count("*").alias("_rows"))  # few rows: spans, by payload
    until = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(*[F.col(k).alias(f"{k}b") for k in keys], F.col("_span").alias("_spanb"), F.coalesce(F.sum("_rows").over(until), F.lit(0)).alias("_before"))
    inside = spanned.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_span").orderBy(F.col(order).asc_nulls_first())))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys], F.col("_span") == F.col("_spanb"))
    return inside.join(before, same).withColumn(into, F.col("_before") + F.col("_row")).select(*rows.columns, into)


def nth_match(left: DataFrame, right: DataFrame, payload: list[str], order: str = "id") -> DataFrame:
    """(left_id, right_id) of equal payloads, the first with the first, and so on; nulls equal nulls.

    What one side has more of is matched with nothing. The join is by payload
    and number, so that a frequent payload is spread over all tasks.
    """
    a = numbered(left.select(F.struct(*payload).alias("_p"), F.col(order).alias("left_id")), [F.col("_p")], "left_id", "_n")
    b = numbered(right.select(F.struct(*payload).alias("_q"), F.col(order).alias("right_id")), [F.col("_q")], "right_id", "_m")
    return a.join(b, F.col("_p").eqNullSafe(F.col("_q")) & (F.col("_n") == F.col("_m"))).select("left_id", "right_id")


def _dealt(id: str, *sides: DataFrame) -> list[DataFrame]:
    """The sides by id, in as many tasks as the session shuffles into: joins and groups by id need no further shuffle, and each task holds a small share."""
    n = int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return [df.repartition(n, id) for df in sides]


def recovered(base: DataFrame, origin: DataFrame, local: DataFrame, merged: DataFrame, payload: list[str], id: str = "id") -> DataFrame:
    """(local_id, merged_id, how) of all rows of local, found from the four tables alone.

    A row that base has too, and the merge under that id, is 'inherited'. The
    others are matched by payload, in the order of ids, with the rows of the
    merge that stand in neither base nor origin: 'matched', or else merged_id
    and how are null, and nothing is known about the row.
    """
    base, origin, local, merged = _dealt(id, base, origin, local, merged)
    ids = lambda df: df.select(F.col(id)).distinct()
    kept = ids(local).join(ids(base), id, "left_semi").join(ids(merged), id, "left_semi")
    new = merged.join(ids(base), id, "left_anti").join(ids(origin), id, "left_anti")
    own = local.join(kept, id, "left_anti")
    found = nth_match(own, new, payload, id).select(F.col("left_id").alias(id), F.col("right_id").alias("merged_id"))
    rest = ids(own).join(found, id, "left").select(F.col(id).alias("local_id"), "merged_id", F.when(F.col("merged_id").isNotNull(), "matched").alias("how"))
    return kept.select(F.col(id).alias("local_id"), F.col(id).alias("merged_id"), F.lit("inherited").alias("how")).unionByName(rest)


def explained(base: DataFrame, origin: DataFrame, local: DataFrame, merged: DataFrame, payload: list[str], id: str = "id") -> DataFrame:
    """(name, violations): whether each row of the merge comes from an input, unaltered, and each row of the inputs is in it.

    origin_lost and origin_altered by id; local_unproven for rows of local
    without lineage; inherited_altered where local's inherited row was
    carried with neither origin's payload nor its own; merged_unexplained for rows of the merge
    that no input accounts for; repeated_id for ids that stand twice.
    """
    base, origin, local, merged = _dealt(id, base, origin, local, merged)
    found = recovered(base, origin, local, merged, payload, id)
    packed = lambda df, side: df.select(F.col(id).alias("id"), F.lit(side).alias("side"), F.struct(*payload).alias("p"))
    kept = local.join(found.filter("how = 'inherited'").select(F.col("local_id").alias(id)), id, "left_semi")
    named = found.filter("how = 'matched'").select(F.col("merged_id").alias("id"), F.lit("named").alias("side"), F.lit(None).cast(packed(local, "l").schema["p"].dataType).alias("p"))
    sides = packed(origin, "origin").unionByName(packed(kept, "kept")).unionByName(packed(merged, "merged")).unionByName(named)
    at = lambda side: F.when(F.col("side") == side, F.col("p"))
    # Dealt by id first: a group has a few rows, and combining them as they are read would sort all that a task reads.
    by_id = _dealt("id", sides)[0].groupBy("id").agg(*[F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("origin", "kept", "merged", "named")], *[F.min(at(s)).alias(f"p_{s}") for s in ("origin", "kept", "merged")])
    there, n = F.col("n_merged") > 0, lambda s: F.col(f"n_{s}") > 0
    rules = {
        "origin_lost": n("origin") & ~there,
        "origin_altered": n("origin") & there & ~F.col("p_origin").eqNullSafe(F.col("p_merged")),
        "inherited_altered": n("kept") & ~n("origin") & there & ~F.col("p_kept").eqNullSafe(F.col("p_merged")),
        "merged_unexplained": there & ~n("origin") & ~n("kept") & ~n("named"),
        "repeated_id": F.col("n_merged") > 1,
    }
    counts = by_id.agg(F.array(*[F.struct(F.lit(k).alias("name"), F.count_if(v).alias("violations")) for k, v in rules.items()]).alias("c")).select(F.inline("c"))
    return counts.unionByName(found.agg(F.lit("local_unproven").alias("name"), F.count_if(F.col("how").isNull()).alias("violations")))


def proven(base: DataFrame, origin: DataFrame, local: DataFrame, merged: DataFrame, payload: list[str], id: str = "id") -> DataFrame:
    """recovered(), if explained() has no violation; Refused else."""
    broken = explained(base, origin, local, merged, payload, id).filter("violations > 0").orderBy("name").collect()  # six rows at most
    if broken:
        raise Refused("lineage is unproven: " + ", ".join(f"{r['name']} ({r['violations']})" for r in broken))
    return recovered(base, origin, local, merged, payload, id)


def partition_fingerprints(df: DataFrame, by: Column, name: str = "part") -> DataFrame:
    """(part, n, h0..h3): the fingerprint of each part of df, so that a part that changed is read alone."""
    digest = fingerprint_words(df)
    return digest.withColumn(name, by).groupBy(name).agg(F.count("*").alias("n"), *[(F.sum(w) % (1 << 48)).cast("long").alias(w) for w in WORDS])


def combined(parts: DataFrame) -> DataFrame:
    """One fingerprint of disjoint parts' fingerprints; none gives that of no rows."""
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce((F.sum(F.col(w).cast("decimal(38,0)")) % (1 << 48)).cast("long"), F.lit(0)).alias(w) for w in WORDS])


def updated(before: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The fingerprint after rows were inserted and deleted, from the one before and these rows alone.

    An altered row is deleted as it was and inserted as it is. Deleting what
    wasn't there gives a fingerprint of no table; the caller knows its rows.
    """
    signed = lambda df, sign: df.select((F.col("n") * sign).alias("n"), *[(F.col(w) * sign).alias(w) for w in WORDS])
    parts = signed(before, 1).union(signed(fingerprint(inserted), 1)).union(signed(fingerprint(deleted), -1))
    mod = lambda w: F.pmod(F.sum(F.col(w).cast("decimal(38,0)")), F.lit(1 << 48).cast("decimal(38,0)")).cast("long").alias(w)
    return parts.agg(F.sum("n").alias("n"), *[mod(w) for w in WORDS])


def published_side(sides: dict[str, DataFrame], published: DataFrame) -> str:
    """The name of the side whose fingerprint is published's (one row n, h0..h3), whatever its place; Refused if there is none.

    Ids of the published side are in use elsewhere, so that a guess could
    renumber them. Of several equal sides the first is as good as any.
    """
    want = tuple(published.select("n", *WORDS).first())
    for name, df in sides.items():
        if tuple(fingerprint(df).select("n", *WORDS).first()) == want:
            return name
    raise Refused(f"none of {', '.join(sides)} is what was published")
