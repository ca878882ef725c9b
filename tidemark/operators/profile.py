"""Profiles: each takes a table and returns a small one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dist import t_two_sided
from tidemark.plans.prefix import quantile_values

SUSPICIOUS = "return|target|pct_change|close|high_price|low_price"


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std, min, quartiles, max: all columns together."""
    q = quantile_values(df, {c: F.col(c) for c in columns}, [0.25, 0.5, 0.75])
    stat = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *(F.lit(q[c] and q[c][i]).cast("double").alias(n) for i, n in enumerate(("p25", "p50", "p75"))), F.max(c).cast("double").alias("max"))
    return df.agg(F.array(*map(stat, columns)).alias("x")).select(F.inline("x"))


def correlations(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """feature, target, n, corr over rows that have both: one pass for all pairs."""
    pair = lambda f, t: F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.count_if(F.col(f).isNotNull() & F.col(t).isNotNull()).alias("n"), F.corr(f, t).alias("corr"))
    return df.agg(F.array(*(pair(f, t) for f in features for t in targets)).alias("x")).select(F.inline("x"))


def correlation_t(r: Column, n: Column) -> Column:
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))


def leakage(correlated: DataFrame) -> DataFrame:
    """correlated with its p-value and whether the feature looks like a leak of the target."""
    out = correlated.withColumn("p", t_two_sided(correlation_t(F.col("corr"), F.col("n")), F.col("n").cast("double") - 2))
    strong, named = F.abs("corr") > 0.9, (F.abs("corr") > 0.7) & F.col("feature").rlike(SUSPICIOUS)
    return out.withColumn("leak", (strong | named) & (F.col("p") < 0.01))


def skew_sample(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_sample(c: str) -> Column:
    n = F.count(c).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(c) + 6))


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, missing, corrected and plain skewness and kurtosis, zero_rate, unique_rate."""
    total = F.count("*").cast("double")
    stat = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), (1 - F.count(c) / total).alias("missing"), skew_sample(c).alias("skew_sample"), F.skewness(c).alias("skew_pop"), kurtosis_sample(c).alias("kurtosis_sample"), F.kurtosis(c).alias("kurtosis_pop"), (F.count_if(F.col(c) == 0) / total).alias("zero_rate"), (F.count_distinct(c) / total).alias("unique_rate"))
    return df.agg(F.array(*map(stat, columns)).alias("x")).select(F.inline("x"))


def monthly(df: DataFrame, value: str, day: str = "report_date", digits: int = 4) -> DataFrame:
    return df.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("std"))


def stability(months: DataFrame, limit: float = 0.5) -> DataFrame:
    cv = F.try_divide(F.stddev_samp("mean"), F.abs(F.avg("mean")))
    return months.agg(F.count("*").alias("n_months"), cv.alias("cv")).withColumn("unstable", F.col("cv") > limit)


def by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def value_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last(column)).limit(k)


def unique_counts(df: DataFrame, columns: list[str], approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(F.array(*(F.struct(F.lit(c).alias("column"), count(c).alias("n_unique")) for c in columns)).alias("x")).select(F.inline("x"))


def seasonality(df: DataFrame, day: str = "report_date", part: str = "month") -> DataFrame:
    """Period, count, share, and bias: the share over the mean share; the peak period is marked."""
    period = {"month": F.month, "quarter": F.quarter}[part](F.col(day))
    counts = df.groupBy(period.alias("period")).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # twelve rows at most
    share = F.col("n") / F.sum("n").over(everything)
    return counts.select("period", "n", share.alias("share"), (F.col("n") / F.avg("n").over(everything)).alias("bias"), (F.col("n") == F.max("n").over(everything)).alias("peak"))


def daily_candidates(df: DataFrame, day: str, minimum: int) -> DataFrame:
    """Days, mean and largest number of candidates a day, share of days that reach the minimum."""
    counts = df.groupBy(day).agg(F.count("*").alias("n"))
    return counts.agg(F.count("*").alias("n_days"), F.avg("n").alias("mean_n"), F.max("n").alias("max_n"), (F.count_if(F.col("n") >= minimum) / F.count("*")).alias("qualifying_rate"))


def qualifying_days(df: DataFrame, day: str, minimum: int) -> DataFrame:
    return df.groupBy(day).agg(F.count("*").alias("n")).filter(F.col("n") >= minimum)
