"""Targets of earnings records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalar import RETURN_EDGES, RETURN_NAMES, cut
from tidemark.operators.features import flag
from tidemark.plans.prefix import quantile_values

THRESHOLDS = [0.01, 0.02, 0.03, 0.05]


def returns(df: DataFrame) -> DataFrame:
    o = F.col("open_price")
    out = {"next_session_return": F.try_divide(F.col("close_price") - o, o), "full_day_return": F.col("pct_change_close") / 100}
    return df.withColumns(out | {f"intraday_return_{w}": F.col(f"pct_{w}") / 100 for w in ("1min", "5min", "15min", "30min", "1hr")})


def binary(df: DataFrame) -> DataFrame:
    r, i, out = F.col("next_session_return"), F.col("intraday_return_1hr"), {}
    for t in THRESHOLDS:
        p = round(t * 100)
        out |= {f"target_{p}pct_up": flag(r > t), f"target_{p}pct_down": flag(r < -t), f"target_intraday_{p}pct_up": flag(i > t)}
    return df.withColumns(out | {"target_up": flag(r > 0), "target_down": flag(r < 0)})


def category(df: DataFrame) -> DataFrame:
    return df.withColumn("return_category", cut(F.col("next_session_return"), RETURN_EDGES, RETURN_NAMES))


def risk_adjusted(df: DataFrame, epsilon: float = 0.001) -> DataFrame:
    df = df.withColumn("risk_adjusted_return", F.try_divide(F.col("next_session_return"), F.col("intraday_vol") + epsilon))
    return df.withColumn("target_risk_adj_positive", flag(F.col("risk_adjusted_return") > 0))


def create(df: DataFrame) -> DataFrame:
    """All targets; rows without the main one go."""
    return risk_adjusted(category(binary(returns(df)))).dropna(subset=["next_session_return"])


def balance(df: DataFrame, target: str = "target_2pct_up", value: str = "next_session_return") -> DataFrame:
    q = quantile_values(df, {"q": F.col(value)}, [0.05, 0.95])["q"] or [None, None]
    return df.agg(F.count("*").alias("n"), F.avg(target).alias("positive_rate"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), *(F.lit(x).cast("double").alias(n) for n, x in zip(("p05", "p95"), q, strict=True))).withColumn("extreme", (F.col("positive_rate") < 0.05) | (F.col("positive_rate") > 0.95))
