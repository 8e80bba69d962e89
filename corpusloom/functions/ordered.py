"""Ranks, predecessors and pages within groups that may be arbitrarily large.

A plain window puts a whole group into one task. These helpers cut every group at
``bucket``, a column that never decreases along the sort order, so that only the
(group, bucket) pairs meet in a task; a small table of per-bucket summaries then
stitches the pieces together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Up to this rank Spark prunes each map task to the leading rows before the shuffle.
GROUP_LIMIT = 1000


def grouped_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                 out: str = "rank") -> DataFrame:
    """Row number (from 1) along ``order`` within ``keys``."""
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = keyed.withColumn("_local", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    joined = local.join(offsets, [*keys, "_bucket"])
    return joined.withColumn(out, F.col("_local") + F.col("_offset")).drop("_bucket", "_local", "_offset")


def grouped_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                     value: Column, out: str) -> DataFrame:
    """``value`` of the row just before along ``order`` within ``keys``; null for the first."""
    keyed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    along = W.partitionBy(*keys, "_bucket").orderBy(*order)
    last = keyed.groupBy(*keys, "_bucket").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = last.select(*keys, "_bucket",
                          F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")).alias("_carried"))
    local = (keyed.withColumn("_local", F.lag("_value").over(along))
                  .withColumn("_first", F.row_number().over(along) == 1))
    joined = local.join(carried, [*keys, "_bucket"])
    value_before = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_local"))
    return joined.withColumn(out, value_before).drop("_bucket", "_value", "_local", "_first", "_carried")


def grouped_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, value: Column, out: str) -> DataFrame:
    """The last ``value`` that is not null at or before each row along ``order`` within ``keys``; null before the first."""
    keyed = df.withColumn("_bucket", bucket).withColumn("_value", value)
    last = keyed.where("_value IS NOT NULL").groupBy(*keys, "_bucket").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    buckets = keyed.select(*keys, "_bucket").distinct().join(last, [*keys, "_bucket"], "left")
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = buckets.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    along = W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = keyed.withColumn("_local", F.last("_value", ignorenulls=True).over(along))
    joined = local.join(carried, [*keys, "_bucket"])
    return joined.withColumn(out, F.coalesce("_local", "_carried")).drop("_bucket", "_value", "_local", "_carried")


def grouped_page(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, cursor: int = 0,
                 bucket: Column | None = None) -> DataFrame:
    """One page per group, with the group's ``total``, the row's ``position`` and the ``next_cursor``.

    Shallow pages rank only the leading rows of every map task; deep pages need a ``bucket``.
    """
    if limit < 1 or cursor < 0:
        raise ValueError("a page has at least one row and starts at 0 or later")
    last = cursor + limit
    if last <= GROUP_LIMIT or bucket is None:
        ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    else:
        ranked = grouped_rank(df, keys, order, bucket, "_rank")
    rows = ranked.where(F.col("_rank") <= last)
    if cursor:
        rows = rows.where(F.col("_rank") > cursor)
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return (rows.join(totals, list(keys))
                .withColumn("position", F.col("_rank").cast("int"))
                .withColumn("next_cursor", F.when(F.col("total") > last, F.lit(last).cast("long")))
                .drop("_rank"))
