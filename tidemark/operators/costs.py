"""Execution costs as columns of a trades table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Multipliers of spread by regime and of impact by timeframe, fill penalties by timeframe.
SPREAD_BY_REGIME = {"bull_low_vol": 0.85, "bull_high_vol": 1.4, "bear_low_vol": 1.2, "bear_high_vol": 1.9, "sideways_low_vol": 1.0, "sideways_high_vol": 1.5}
IMPACT_BY_TIME = {"market_open": 1.7, "1min": 1.5, "5min": 1.3, "15min": 1.1, "30min": 1.0, "1hr": 0.9, "close": 1.2}
FILL_BY_TIME = {"market_open": 0.10, "1min": 0.05, "5min": 0.02, "15min": 0.0, "30min": 0.0, "1hr": 0.0, "close": 0.08}
#: Difficulty and liquidity penalty by timeframe.
TIMEFRAMES = {"market_open": (1.8, 0.25), "1min": (1.5, 0.15), "5min": (1.3, 0.10), "15min": (1.1, 0.05), "30min": (1.0, 0.02), "1hr": (0.9, 0.0)}
COMMISSION, SPREAD_BPS, IMPACT_BPS, SLIPPAGE_BPS = 0.005, 10.0, 20.0, 3.0


def lookup(table: dict[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def execution(trades: DataFrame, cap: str = "market_cap", adv: str = "adv", timeframe: str = "timeframe", regime: str = "regime", earnings_day: str = "is_earnings_day", vol_penalties: bool = True) -> DataFrame:
    """trades(shares, price, market cap in dollars, average daily volume, ...) with commission, spread, impact,
    slippage, timing, total_cost_bps, fill_probability and fill_rate. vol_penalties: charge high-volatility regimes."""
    value, e = F.col("shares") * F.col("price"), F.coalesce(F.col(earnings_day), F.lit(False))
    c, r, t = F.col(cap), F.col(regime), F.col(timeframe)
    rough = F.endswith(r, F.lit("_high_vol")) if vol_penalties else F.lit(False)
    by_cap = F.when(c < 1e9, 2.2).when(c < 5e9, 1.6).when(c < 20e9, 1.3).otherwise(1.0)
    share = F.coalesce(F.when(F.col(adv) > 0, F.try_divide(value, F.col(adv) * F.col("price"))), F.lit(0.1))
    df = trades.withColumns({"_value": value, "_share": share})
    s = F.col("_share")
    df = df.withColumns({
        "commission": F.col("shares") * COMMISSION,
        "spread": F.col("_value") * (SPREAD_BPS * F.when(e, 1.8).otherwise(1.0) * by_cap * lookup(SPREAD_BY_REGIME, r, 1.0)) / 10_000,
        "impact": F.col("_value") * (IMPACT_BPS * F.sqrt(s) * F.when(e, 1.6).otherwise(1.0) * lookup(IMPACT_BY_TIME, t, 1.0)) / 10_000,
        "slippage": F.col("_value") * (SLIPPAGE_BPS * F.when(e, 1.7).otherwise(1.0) * F.when(rough, 1.4).otherwise(1.0) * (1 + 2 * s)) / 10_000 * 0.6,
        "timing": F.when(t == "market_open", F.col("_value") * 15 / 10_000).otherwise(0.0),
        "fill_probability": F.greatest(F.lit(0.4), 0.93 - F.when(s > 0.08, F.least(F.lit(0.25), s * 2.5)).otherwise(0.0) - F.when(e, 0.08).otherwise(0.0) - F.when(rough, 0.12).otherwise(0.0) - lookup(FILL_BY_TIME, t, 0.0)),
    })
    total = F.col("commission") + F.col("spread") + F.col("impact") + F.col("slippage") + F.col("timing")
    return df.withColumns({"total_cost_bps": F.try_divide(total, "_value") * 10_000, "fill_rate": F.col("fill_probability") * 0.96}).drop("_value", "_share")


def for_timeframe(costed: DataFrame, timeframe: str = "timeframe") -> DataFrame:
    """Cost scaled by the timeframe's difficulty, fill probability reduced by its liquidity penalty."""
    hard, thin = ({k: v[i] for k, v in TIMEFRAMES.items()} for i in (0, 1))
    t = F.col(timeframe)
    return costed.withColumns({"scaled_cost_bps": F.col("total_cost_bps") * lookup(hard, t, 1.0), "scaled_fill": F.col("fill_probability") * (1 - lookup(thin, t, 0.0))})


def net_returns(costed: DataFrame, r: str = "r") -> DataFrame:
    """net_r: gross return by fill rate, less the round trip's cost over the fill probability."""
    return costed.withColumn("net_r", F.col(r) * F.col("fill_rate") - F.try_divide(F.col("total_cost_bps") * 2 / 10_000, "fill_probability"))
