"""Return metrics of strategies: aggregations over a trades table (strategy, d, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.prefix import depth, drawdown_parts, log_growth, merge_drawdowns, quantiles


YEAR = 252


def moments(r: Column) -> dict[str, Column]:
    return {"n": F.count(r), "mean": F.avg(r), "std": F.stddev_samp(r), "total": F.sum(r), "wins": F.count_if(r > 0), "gain": F.sum(F.when(r > 0, r).otherwise(0.0)), "loss": F.sum(F.when(r < 0, -r).otherwise(0.0)), "down_std": F.stddev_samp(F.when(r < 0, r))}


def series_metrics(trades: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    """n, total, mean, monthly (21 days), Sharpe and Sortino (by the root of 252), win rate, profit factor."""
    m = trades.groupBy(*by).agg(*(c.alias(k) for k, c in moments(F.col(r)).items()))
    root = F.lit(float(YEAR) ** 0.5)
    return m.select(*by, "n", "total", "mean", "std", (F.col("mean") * 21).alias("monthly"), F.coalesce(F.try_divide("mean", "std") * root, F.lit(0.0)).alias("sharpe"), F.coalesce(F.try_divide("mean", "down_std") * root, F.lit(0.0)).alias("sortino"), F.try_divide("wins", "n").alias("win_rate"), F.try_divide("gain", "loss").alias("profit_factor"))


def annual_metrics(trades: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    """annual_return, annual_vol, sharpe, win_rate, profit_factor, n."""
    m = series_metrics(trades, by, r)
    return m.select(*by, (F.col("mean") * YEAR).alias("annual_return"), (F.col("std") * float(YEAR) ** 0.5).alias("annual_vol"), "sharpe", "win_rate", "profit_factor", "n")


def with_defaults(metrics: DataFrame, strategies: DataFrame, by: str = "strategy") -> DataFrame:
    """A row for every strategy; those without trades get zeros and profit factor 1."""
    out = strategies.select(by).distinct().join(metrics, by, "left")
    return out.fillna(0).withColumn("profit_factor", F.when(F.col("n") == 0, 1.0).otherwise(F.col("profit_factor")))


def max_drawdown(trades: DataFrame, by: list[str], r: str = "r", day: str = "d", order: list[str] | None = None) -> DataFrame:
    """growth and mdd of the cumulative product of 1 + r in order of the day; the running peak starts at the first
    value. Days are partial states, merged in order, so a strategy's trades need not fit in a task."""
    return merge_drawdowns(drawdown_parts(trades, by, r, day, order or ["trade_id"]), by, day)


#: Digits of a drawdown; those equal to that many are ties.
DEPTH_DIGITS = 12


def drawdown_span(daily: DataFrame, by: str, r: str = "r", day: str = "d") -> DataFrame:
    """The deepest drawdown of a daily series with the day of its peak, of its trough and its length in rows. Of equally deep
    ones the first counts, of equal peaks before it the last; drawdowns are compared to DEPTH_DIGITS digits."""
    w = Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    walk = daily.withColumn("_l", F.sum(log_growth(F.col(r))).over(w)).withColumn("_i", F.row_number().over(Window.partitionBy(by).orderBy(day)))
    walk = walk.withColumn("_p", F.max("_l").over(w)).withColumn("_dd", F.round(depth(F.col("_l"), F.col("_p")), DEPTH_DIGITS))
    walk = walk.withColumn("_peak", F.max(F.when(F.col("_dd") == 0, F.struct("_i", F.col(day).alias("day")))).over(w))
    key = F.struct(F.col("_dd").isNull().alias("none"), "_dd", "_i")
    worst = walk.groupBy(by).agg(F.min_by(F.struct(F.col("_dd").alias("mdd"), F.col("_peak.day").alias("peak_day"), F.col(day).alias("trough_day"), (F.col("_i") - F.col("_peak._i")).alias("length")), key).alias("x"))
    return worst.select(by, "x.*")


def demeaned_drawdown(daily: DataFrame, by: str, r: str = "r", day: str = "d") -> DataFrame:
    """The lowest point of the cumulative sum of r minus its mean."""
    mean = daily.groupBy(F.col(by).alias("_by")).agg(F.avg(r).alias("_m"))
    w = Window.partitionBy(by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return daily.join(mean, F.col(by) == F.col("_by")).withColumn("_s", F.sum(F.col(r) - F.col("_m")).over(w)).groupBy(by).agg(F.min("_s").alias("demeaned_drawdown"))


def value_at_risk(trades: DataFrame, by: list[str], r: str = "r", level: float = 0.05, accuracy: int | None = None) -> DataFrame:
    """var and cvar: the level's percentile and the mean of the returns at or below it. accuracy: use a sketch of that
    accuracy instead of the exact percentile, in one pass less."""
    edge = trades.groupBy(*by).agg(F.percentile_approx(r, level, accuracy).alias("var")) if accuracy else quantiles(trades, r, [level], by).select(*by, F.col("q")[0].alias("var"))
    tail = trades.join(edge, by).filter(F.col(r) <= F.col("var"))
    return tail.groupBy(*by).agg(F.first("var").alias("var"), F.avg(r).alias("cvar"))


def shape(trades: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    return trades.groupBy(*by).agg(F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess_kurtosis"))


def downside(trades: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    """downside deviation (population, of the losses) and the mean loss."""
    x = F.col(r)
    return trades.groupBy(*by).agg(F.stddev_pop(F.when(x < 0, x)).alias("downside_deviation"), F.avg(F.when(x < 0, x)).alias("avg_loss"))


def half_stability(trades: DataFrame, by: str, r: str = "r", day: str = "d") -> DataFrame:
    """Means before and after the middle of each strategy's days, and the lesser over the greater in size."""
    mid = trades.groupBy(F.col(by).alias("_by")).agg((F.datediff(F.max(day), F.min(day)) / 2).cast("int").alias("_h"), F.min(day).alias("_f"))
    halves = trades.join(mid, F.col(by) == F.col("_by")).groupBy(by).agg(*(F.avg(F.when(c, F.col(r))).alias(n) for n, c in (("first_mean", F.datediff(day, "_f") <= F.col("_h")), ("second_mean", F.datediff(day, "_f") > F.col("_h")))))
    a, b = F.abs("first_mean"), F.abs("second_mean")
    return halves.withColumn("stability", F.when(F.col("first_mean") * F.col("second_mean") > 0, F.try_divide(F.least(a, b), F.greatest(a, b))).otherwise(0.0))


def portfolio(strategies: DataFrame, k: int = 20) -> DataFrame:
    """Summary of the k best strategies(strategy, sharpe, annual_return, win_rate, features)."""
    top = strategies.orderBy(F.desc("sharpe"), "strategy").limit(k)
    return top.agg(F.count("*").alias("n"), F.avg("sharpe").alias("avg_sharpe"), F.sum("annual_return").alias("total_return"), F.avg("win_rate").alias("avg_win_rate"), (F.count_distinct("features") / F.count("*")).alias("distinct_share"))


def daily_mean(df: DataFrame, value: str, day: str = "report_date") -> DataFrame:
    return df.groupBy(day).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
