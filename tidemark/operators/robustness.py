"""Robustness of strategies: their metrics again, by another key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.metrics import series_metrics
from tidemark.plans.prefix import quantile_values


def tercile(x: Column, edges: list[float]) -> Column:
    """small, medium or large by two quantile edges, right-closed."""
    return F.when(x <= edges[0], "small").when(x <= edges[1], "medium").when(x.isNotNull(), "large")


def by_sector(trades: DataFrame, sector: str = "sector", k: int = 5, r: str = "r", min_mean: float = 0.005, max_ratio: float = 5.0) -> DataFrame:
    """strategy, n_sectors, worst and best mean over the k most frequent sectors, passed."""
    from tidemark.operators.features import top_values

    m = trades.filter(F.col(sector).isin(top_values(trades, sector, k))).groupBy("strategy", sector).agg(F.avg(r).alias("mean"))
    return _spread(m, min_mean, max_ratio)


def by_cap(trades: DataFrame, cap: str, r: str = "r", min_mean: float = 0.005, max_ratio: float = 5.0) -> DataFrame:
    edges = quantile_values(trades, {"cap": F.col(cap)}, [1 / 3, 2 / 3])["cap"]
    m = trades.withColumn("_t", tercile(F.col(cap), edges or [0.0, 0.0])).filter(F.col("_t").isNotNull()).groupBy("strategy", "_t").agg(F.avg(r).alias("mean"))
    return _spread(m, min_mean, max_ratio)


def _spread(means: DataFrame, min_mean: float, max_ratio: float) -> DataFrame:
    g = means.groupBy("strategy").agg(F.count("*").alias("n_groups"), F.min("mean").alias("worst"), F.max("mean").alias("best"))
    return g.withColumn("passed", F.coalesce((F.col("worst") > min_mean) & (F.try_divide("best", "worst") < max_ratio), F.lit(False)))


def by_half(trades: DataFrame, day: str = "d", r: str = "r", min_days: int = 180) -> DataFrame:
    """strategy, first and second mean around the middle day of the table, passed (both of one sign)."""
    first, span = trades.agg(F.min(day), F.datediff(F.max(day), F.min(day))).first()
    late = F.datediff(day, F.lit(first)) > (span or 0) // 2
    g = trades.groupBy("strategy").agg(F.avg(F.when(~late, F.col(r))).alias("first_mean"), F.avg(F.when(late, F.col(r))).alias("second_mean"))
    return g.withColumn("passed", F.coalesce((F.col("first_mean") > 0) & (F.col("second_mean") > 0), F.lit(False)) & F.lit((span or 0) > min_days))


def costs(trades: DataFrame, multipliers: tuple[float, ...] = (0.5, 1.0, 1.5, 2.0, 3.0), cost_bps: float = 5.0, slippage_bps: float = 5.0, r: str = "r") -> DataFrame:
    """strategy, kind, multiplier, net mean and Sharpe. Costs are a constant a trade, so all scenarios come from the
    moments and the trades are read once."""
    m = series_metrics(trades, ["strategy"], r).select("strategy", "mean", "std", "n")
    rows = [(kind, x, 2 * ((x * cost_bps + slippage_bps) if kind == "cost" else (cost_bps + x * slippage_bps)) / 10_000) for kind in ("cost", "slippage") for x in multipliers]
    scenarios = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(x).alias("multiplier"), F.lit(c).alias("charge")) for k, x, c in rows))
    out = m.select("strategy", "mean", "std", "n", F.inline(scenarios)).withColumn("net_mean", F.col("mean") - F.col("charge"))
    return out.select("strategy", "kind", "multiplier", "net_mean", (F.try_divide("net_mean", "std") * 252**0.5).alias("net_sharpe"))


def by_market(trades: DataFrame, bull: str = "bull_regime", r: str = "r") -> DataFrame:
    x = F.col(r)
    g = trades.groupBy("strategy").agg(F.avg(F.when(F.col(bull) == 1, x)).alias("bull_mean"), F.avg(F.when(F.col(bull) == 0, x)).alias("bear_mean"), F.count(F.when(F.col(bull) == 1, x)).alias("n_bull"), F.count(F.when(F.col(bull) == 0, x)).alias("n_bear"))
    return g.withColumn("passed", F.coalesce((F.col("bull_mean") > 0) & (F.col("bear_mean") > 0), F.lit(False)))


def score(checks: dict[str, DataFrame], need: float = 0.7) -> DataFrame:
    """strategy, n_checks, score (share of passed checks) and robust."""
    parts = [df.select("strategy", F.lit(n).alias("check"), F.col("passed").cast("int").alias("ok")) for n, df in checks.items()]
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy("strategy").agg(F.count("*").alias("n_checks"), F.avg("ok").alias("score")).withColumn("robust", F.col("score") >= need)
