"""The bounded analysis queue with a share reserved for the backlog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAP, RESERVE, LIVE_DAYS = 55, 0.3, 14


def backlog_tier(scraped_on: Column, as_of: str, live_days: int = LIVE_DAYS) -> Column:
    """0 for what was scraped in the last live_days, 1 for older rows and those without a date."""
    return F.when(scraped_on >= F.date_sub(F.lit(as_of).cast("date"), live_days), 0).otherwise(1)


def first_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in order with their places from 1: a top-k, so that one task ranks n rows, not all."""
    top = rows.orderBy(*order).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def analysis_queue(fresh: DataFrame, backlog: DataFrame, order: list[Column], backlog_order: list[Column], cap: int = CAP, reserve: float = RESERVE) -> DataFrame:
    """At most cap rows: fresh ones up to the cap less the reserved slots, then the backlog up to the cap.

    Reserved are min(backlog, max(1, the half-even rounded share of the cap))
    slots; what fresh rows don't use goes to the backlog. part tells the two,
    place their order. A cap of 0 gives no rows.
    """
    new = first_rows(fresh, order, cap).withColumn("part", F.lit("fresh"))
    old = first_rows(backlog, backlog_order, cap).withColumn("part", F.lit("backlog"))
    sizes = new.agg(F.count("*").alias("n_new")).join(old.agg(F.count("*").alias("n_old")))  # one row each, cap at most
    slots = F.least("n_old", F.greatest(F.lit(1), F.bround(F.lit(cap * reserve)).cast("int"))) if cap else F.lit(0)
    sizes = sizes.select(F.least("n_new", F.greatest(F.lit(0), F.lit(cap) - slots)).alias("_new"))
    rows = new.unionByName(old).join(F.broadcast(sizes))
    limit = F.when(F.col("part") == "fresh", F.col("_new")).otherwise(F.lit(cap) - F.col("_new"))
    return rows.filter(F.col("place") <= limit).drop("_new")
