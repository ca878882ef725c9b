"""Position sizes, a row a strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_SIZE, MIN_SIZE = 0.05, 0.001
#: Size multipliers by regime.
BY_REGIME = {"bull_low_vol": 1.3, "bull_high_vol": 1.0, "bear_low_vol": 0.7, "bear_high_vol": 0.5, "sideways_low_vol": 1.1, "sideways_high_vol": 0.8}


def clamp(x: Column, high: float = MAX_SIZE) -> Column:
    return F.greatest(F.lit(MIN_SIZE), F.least(F.lit(high), x))


def kelly(trades: DataFrame, by: list[str], drawdowns: DataFrame, confidence: float = 0.5, r: str = "r", min_n: int = 30) -> DataFrame:
    """by, kelly: the Kelly fraction times confidence, reduced for drawdown and for volatility over 40 % a year; 0.01
    without enough trades, winners or losers."""
    x = F.col(r)
    m = trades.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(x > 0).alias("w"), F.count_if(x < 0).alias("k"), F.avg(F.when(x > 0, x)).alias("up"), F.avg(F.when(x < 0, -x)).alias("down"), (F.stddev_samp(x) * 252**0.5).alias("vol")).join(drawdowns, by, "left")
    b, p = F.try_divide("up", "down"), F.try_divide("w", "n")
    f = F.try_divide(b * p - (1 - p), b) * confidence * F.greatest(F.lit(0.3), 1 - 2 * F.abs(F.coalesce("mdd", F.lit(0.0)))) * F.when(F.col("vol") > 0.4, F.try_divide(F.lit(0.4), "vol")).otherwise(1.0)
    usable = (F.col("n") >= min_n) & (F.col("w") > 0) & (F.col("k") > 0) & (F.col("w") < F.col("n"))
    return m.select(*by, F.when(usable, clamp(f)).otherwise(0.01).alias("kelly"), "vol")


def risk_parity(vol: Column, target: float = 0.15) -> Column:
    return F.when(vol > 0, clamp(target / vol)).otherwise(MIN_SIZE)


def vol_target(vol: Column, target: float = 0.12) -> Column:
    return F.when(vol > 0, clamp(target * 0.6 / vol)).otherwise(MIN_SIZE)


def position_size(sizes: DataFrame, regime: str, consistency: str = "consistency", effect: str = "effect", power: str = "power", mdd: str = "mdd") -> DataFrame:
    """sizes(kelly, vol, ...) with the three methods, their geometric mean (of those above the minimum), the regime's
    multiplier and haircuts for weak effect, low power and deep drawdown."""
    df = sizes.withColumns({"risk_parity": risk_parity(F.col("vol")), "vol_target": vol_target(F.col("vol"))})
    some = F.filter(F.array("kelly", "risk_parity", "vol_target"), lambda v: v > MIN_SIZE)
    mean = F.when(F.size(some) > 0, F.exp(F.aggregate(some, F.lit(0.0), lambda a, v: a + F.ln(v)) / F.size(some))).otherwise(MIN_SIZE)
    adjusted = clamp(mean * BY_REGIME.get(regime, 1.0) * (0.5 + 0.5 * F.col(consistency)))
    cut = F.when(F.col(effect) < 0.4, 0.7).otherwise(1.0) * F.when(F.col(power) < 0.85, 0.8).otherwise(1.0) * F.when(F.abs(mdd) > 0.08, 0.6).otherwise(1.0)
    return df.withColumns({"base_size": mean, "size": adjusted * cut})


def quantity(cash: Column, price: Column, fraction: float = 0.9, min_candidates: int = 3) -> Column:
    """Whole shares for one of at least min_candidates positions."""
    return F.floor(F.try_divide(cash * fraction / min_candidates, price)).cast("bigint")
