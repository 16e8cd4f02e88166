"""Spending limits over an ordered work list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldproof.session import cut_lineage


def within_budget(work: DataFrame, cap: int, cost: str = "cost_nano", key: str = "photo_id") -> DataFrame:
    """Rows in key order until the running cost first exceeds ``cap``; that row is kept.

    A prefix scan on two levels: rows are dealt by ranges of the key, whatever
    its type and spread, each range is summed on its own, and the totals of the
    ranges before, one row each, are added. Equal keys go by cost, then as
    numbered when the ranges are written, so a key that repeats is split as well.
    """
    order = [key, cost, "_no"]
    dealt = work.withColumn("_no", F.monotonically_increasing_id()).repartitionByRange(*order)
    ranges = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy("_range").agg(F.sum(cost).alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Ranges that begin beyond the cap hold nothing that is kept.
    return (
        ranges.join(offsets.filter(F.col("_offset") <= cap), "_range")
        .withColumn("spent_before", F.col("_offset") + F.coalesce(F.sum(cost).over(inside), F.lit(0)))
        .filter(F.col("spent_before") <= cap)
        .drop("_range", "_offset", "_no")
    )
