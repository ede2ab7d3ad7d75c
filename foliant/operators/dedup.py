"""Canonical choice among copies, and dedup against a store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators.views import numbered
from foliant.sources.snapshots import checkpointed

#: Rank of an authority tier (fixed values); unknown sources rank 0.
TIER_RANK = {"A": 400, "B": 300, "C": 200, "D": 100}
DEFAULT_SECTION, NO_SECTION = 70, 50


def authority(slug: Column, url: Column, hosts: dict[str, str]) -> Column:
    """The source of an article: its trimmed slug, or where that is blank the one of its URL's host; '' if neither is known."""
    own = fx.collapse(F.coalesce(slug, F.lit("")))
    return F.when(own != "", own).otherwise(fx.mapped(hosts, fx.url_host(url), ""))


def canonical_key(tiers: dict[str, str], sections: dict[str, int], slug: str = "source", url: str = "url", section_hosts: tuple[str, ...] = (), hosts: dict[str, str] | None = None) -> Column:
    """The total order of copies, the greatest first: tier, source, section, shorter URL, URL.

    Only URLs of section_hosts have a section; hosts names the source of a host
    for articles without one.
    """
    source = authority(F.col(slug), F.col(url), hosts or {})
    rank = fx.mapped({s: TIER_RANK[t] for s, t in tiers.items() if t in TIER_RANK}, source, 0)
    section = fx.url_section(F.col(url), list(section_hosts))
    priority = F.when(section == "", NO_SECTION).otherwise(fx.mapped(sections, section, DEFAULT_SECTION))
    link = F.coalesce(F.col(url), F.lit(""))
    return F.struct(rank.alias("rank"), source.alias("slug"), priority.alias("priority"), (-F.length(link)).alias("length"), link.alias("link"))


def canonical(articles: DataFrame, key: Column, group: str = "title_hash", id: str = "id") -> DataFrame:
    """One row for each non-empty group, the one with the greatest key; rows with an empty group all stay.

    The winner's id is a maximum that is combined before the shuffle, so a
    group of any size costs one row a task. Only the columns that the caller
    uses meet the winners' ids; rows without a group aren't shuffled at all.
    """
    grouped = articles.filter(F.coalesce(group, F.lit("")) != "")
    best = grouped.groupBy(group).agg(F.max(F.struct(key.alias("_key"), F.col(id).alias("_id"))).alias("_best"))
    alone = articles.filter(F.coalesce(group, F.lit("")) == "")
    return grouped.join(best.select(F.col("_best._id").alias(id)), id, "left_semi").unionByName(alone)


def ranked(articles: DataFrame, key: Column, group: str = "title_hash") -> DataFrame:
    """All rows of non-empty groups with their rank in the group, the winner 1; a group of any size is many tasks."""
    rows = articles.filter(F.coalesce(group, F.lit("")) != "").withColumn("_key", key)
    return numbered(rows, [F.desc("_key")], group, "rank").drop("_key")


def refused_groups(articles: DataFrame, tiers: dict[str, str], group: str = "title_hash", slug: str = "source") -> DataFrame:
    """(group, reason) of the groups whose copies must not be deleted: unresolved or mixed ungoverned sources."""
    known = F.col(slug).isin(list(tiers)) if tiers else F.lit(False)
    blank = F.coalesce(F.col(slug), F.lit("")) == ""
    found = articles.filter(F.coalesce(group, F.lit("")) != "").groupBy(group)
    found = found.agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"), F.count_if(~known & ~blank).alias("unknown"), F.count_distinct(slug).alias("sources"))
    reason = F.when(F.col("blank") > 0, "unresolved source").when((F.col("unknown") > 0) & (F.col("sources") > 1), "ungoverned source")
    return found.filter("n > 1").withColumn("reason", reason).filter("reason is not null").select(group, "reason")


def unseen(batch: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of a batch of which no key is in the store (a null key matches nothing)."""
    for key in keys:
        batch = batch.join(store.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return batch


def greedy_unique(batch: DataFrame, position: str, first: str, second: str) -> DataFrame:
    """The rows that a pass in order of position keeps if it drops each row with a key of a kept one.

    A dropped row blocks nothing. In each round the rows that come first in
    both of their key groups are kept, and the rows that share a key with them
    go; the rest decides in the next round. Positions must be unique.
    """
    kept, rest = None, checkpointed(batch)
    while not rest.isEmpty():
        a = rest.groupBy(first).agg(F.min(position).alias("_a"))
        b = rest.groupBy(second).agg(F.min(position).alias("_b"))
        heads = rest.join(a, rest[first].eqNullSafe(a[first]), "left").drop(a[first]).join(b, rest[second].eqNullSafe(b[second]), "left").drop(b[second])
        won = checkpointed(heads.filter((F.col("_a") == F.col(position)) & (F.col("_b") == F.col(position))).select(batch.columns))
        kept = won if kept is None else kept.union(won)
        for key in (first, second):
            rest = rest.join(won.select(F.col(key).alias("_k")).distinct(), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
        rest = checkpointed(rest)
    return batch.limit(0) if kept is None else kept
