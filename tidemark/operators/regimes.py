"""Market regimes from a price series, and strategies within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.operators.costs import TIMEFRAMES
from tidemark.operators.metrics import annual_metrics

REGIMES = ["bull_low_vol", "bull_high_vol", "bear_low_vol", "bear_high_vol", "sideways_low_vol", "sideways_high_vol"]


def classify(series: DataFrame, price: str = "close", day: str = "day", by: list[str] | None = None, frame: int = 60, trend: float = 0.05, vol: float = 0.20) -> DataFrame:
    """series with return, rolling_return, rolling_vol (annualised) and regime. The series is one market (an index, a
    row a day) or one a key in `by`. A row is judged by the frame that ends the day before it; until the frame is full
    it is sideways_low_vol."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(day)  # a calendar, not row-level data
    near = w.rowsBetween(-frame, -1)
    out = series.withColumn("return", F.try_divide(price, F.lag(price).over(w)) - 1)
    out = out.withColumns({"_n": F.count("return").over(near), "rolling_return": F.avg("return").over(near), "rolling_vol": F.stddev_samp("return").over(near) * 252**0.5})
    full = F.col("_n") >= frame
    side = F.when(F.col("rolling_return") > trend, "bull").when(F.col("rolling_return") < -trend, "bear").otherwise("sideways")
    name = F.concat(side, F.when(F.col("rolling_vol") > vol, "_high_vol").otherwise("_low_vol"))
    return out.withColumn("regime", F.when(full, name).otherwise("sideways_low_vol")).drop("_n")


def consistency(trades: DataFrame, regimes: DataFrame, day: str = "d", min_rows: int = 50, min_trades: int = 20, min_regimes: int = 3, min_sharpe: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(metrics by strategy and regime, score by strategy). regimes(day, regime) has a row a day."""
    joined = trades.join(regimes.select(F.col("day").alias(day), "regime"), day)
    enough = joined.groupBy("regime").agg(F.count_distinct("trade_id").alias("rows")).filter(F.col("rows") >= min_rows).select("regime")
    m = annual_metrics(joined.join(enough, "regime", "left_semi"), ["strategy", "regime"]).filter(F.col("n") >= min_trades)
    g = m.groupBy("strategy").agg(F.count("*").alias("n_regimes"), F.count_if(F.col("sharpe") >= min_sharpe).alias("n_good"))
    return m, g.withColumn("consistency", F.when(F.col("n_regimes") < min_regimes, 0.0).otherwise(F.try_divide("n_good", "n_regimes")))


def current(classified: DataFrame, day: str = "day") -> DataFrame:
    return classified.agg(F.max(day).alias("day"), F.max_by("regime", day).alias("regime"))


def timeframes(trades: DataFrame, drawdowns: DataFrame | None = None, min_n: int = 30, min_sharpe: float = 0.8, min_win: float = 0.48, min_return: float = 0.03) -> DataFrame:
    """strategy, timeframe and score of those that pass the filters. trades(strategy, timeframe, d, r) hold a row for
    each alternative target; drawdowns(strategy, timeframe, mdd) counts against the score."""
    m = annual_metrics(trades, ["strategy", "timeframe"]).filter((F.col("n") >= min_n) & (F.col("sharpe") >= min_sharpe) & (F.col("win_rate") >= min_win) & (F.col("annual_return") >= min_return))
    m = m.join(drawdowns, ["strategy", "timeframe"], "left").withColumn("mdd", F.coalesce("mdd", F.lit(0.0))) if drawdowns is not None else m.withColumn("mdd", F.lit(0.0))
    hard = F.create_map(*(x for k, v in TIMEFRAMES.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("d"), F.lit(v[1]).alias("p")))))
    at = F.try_element_at(hard, F.col("timeframe"))
    score = 0.4 * F.col("sharpe") + 0.25 * F.least("annual_return", F.lit(0.3)) + 0.2 * (F.col("win_rate") - 0.5) - 0.15 * F.abs("mdd") - 0.1 * (F.coalesce(at["d"], F.lit(1.0)) - 1) - 0.05 * F.coalesce(at["p"], F.lit(0.0))
    return m.withColumn("score", score)


def best_timeframe(scores: DataFrame, min_valid: int = 2) -> DataFrame:
    g = scores.groupBy("strategy").agg(F.count("*").alias("n_valid"), F.max_by("timeframe", F.struct("score", "timeframe")).alias("timeframe"), F.max("score").alias("score"))
    return g.filter(F.col("n_valid") >= min_valid)
