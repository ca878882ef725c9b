"""Windows, orders and group statistics over rows, cut so that no task holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import pct_change
from tidemark.operators.features import rolled
from tidemark.plans.prefix import with_running


def differences(df: DataFrame, value: str, by: str, order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """diff and pct: the change, and the change in percent, from the row before in the group."""
    out = rolled(df, by, order, 1, lambda rows, window: rows.withColumn("_before", F.lag(value).over(window)), parts)
    return out.withColumns({"diff": F.col(value) - F.col("_before"), "pct": pct_change(F.col("_before"), F.col(value))}).drop("_before")


def cumulative(df: DataFrame, value: str, by: str, order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """total, growth and peak: the running sum, the running product of 1 + value, and its running maximum."""
    walked = with_running(df, [by], list(order), {"total": ("sum", F.col(value)), "growth": ("product", 1 + F.col(value))}, parts)
    return with_running(walked, [by], list(order), {"peak": ("max", F.col("growth"))}, parts)


def group_statistics(df: DataFrame, value: str, by: str) -> DataFrame:
    """mean and std of the row's group; a null group is a group."""
    g = df.groupBy(F.col(by).alias("_g")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return df.join(g, F.col(by).eqNullSafe(F.col("_g"))).drop("_g")


def places(df: DataFrame, by: str, block: str, order: list[Column], descending: bool = True) -> DataFrame:
    """place: the row's number in its group by block (descending or not), then order. Blocks are counted first, so a group's
    rows never meet in one task."""
    later = Window.partitionBy(by).orderBy(F.desc(block) if descending else F.asc(block)).rowsBetween(Window.unboundedPreceding, -1)
    start = df.groupBy(by, block).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(later), F.lit(0))).drop("_n")
    inside = df.withColumn("_k", F.row_number().over(Window.partitionBy(by, block).orderBy(*order)))
    return inside.join(start, [by, block]).withColumn("place", F.col("_start") + F.col("_k")).drop("_start", "_k")


def top_per_group(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; tasks drop all but their own first k before rows are shuffled."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")
