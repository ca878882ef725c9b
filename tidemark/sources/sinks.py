"""Sinks: record tables, ranked JSON, report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.scalar import buy_time, risk_level, signed_pct, thousands


def filled(df: DataFrame) -> DataFrame:
    """Nulls as the record format writes them: -1 for numbers, empty text."""
    return df.fillna(-1).fillna("")


def append_records(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    w = filled(df).write.mode("append")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def overwrite_days(df: DataFrame, path: str, day: str = "report_date", fmt: str = "parquet") -> None:
    """Replaces just the days that df holds, so a rerun of a week is idempotent."""
    w = filled(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day)
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def ranked_strategies(strategies: DataFrame) -> DataFrame:
    """rank and the strategy as a nested record, by Sharpe ratio. A row a strategy, so one window ranks them."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("sharpe"), "strategy"))
    return strategies.select(rank.alias("rank"), F.struct(*strategies.columns).alias("record"))


def strategies_json(strategies: DataFrame, path: str) -> None:
    ranked_strategies(strategies).orderBy("rank").write.mode("overwrite").json(path)


def signals(strategies: DataFrame, k: int = 20, details: int = 10) -> DataFrame:
    """rank, strategy and json for the k best strategies; the first `details` with all their fields."""
    top = strategies.orderBy(F.desc("sharpe"), "strategy").limit(k)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("sharpe"), "strategy"))
    brief = F.to_json(F.struct("strategy", F.round("sharpe", 4).alias("sharpe"), risk_level(F.col("mdd")).alias("risk"), buy_time(F.col("timeframe")).alias("buy_time")))
    full = F.to_json(F.struct(*(F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in strategies.dtypes)))
    return top.withColumn("rank", rank).select("rank", "strategy", F.when(F.col("rank") <= details, full).otherwise(brief).alias("json"))


def report_lines(records: DataFrame) -> DataFrame:
    """record_id and a line of text."""
    return records.select("record_id", F.concat_ws(" | ", "symbol", F.date_format("report_date", "yyyy-MM-dd"), F.concat(F.lit("surprise "), signed_pct(F.col("surprise"))), F.concat(F.lit("high "), signed_pct(F.col("pct_change_high"))), F.concat(F.lit("close "), signed_pct(F.col("pct_change_close"))), F.concat(F.lit("volume "), thousands(F.col("opening_minute_volume")))).alias("line"))


def append_report(records: DataFrame, path: str) -> None:
    report_lines(records).select("line").write.mode("append").text(path)


def save_profiles(profiles: dict[str, DataFrame], path: str) -> None:
    for name, df in profiles.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
