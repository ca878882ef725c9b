"""Bars to records: sessions, premarket, interval returns, volumes. One grouping of minute bars by symbol and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE, PREMARKET = 570, 960, 240
NEW_YORK = "America/New_York"
INTERVALS = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "1hr": 60}


def minute_of_day(t: Column) -> Column:
    return F.hour(t) * 60 + F.minute(t)


def local_time(t: Column, zone: str | None = NEW_YORK) -> Column:
    """The wall clock of a zone for times in UTC; without a zone times are local already."""
    return F.from_utc_timestamp(t, zone) if zone else t


def in_session(t: Column) -> Column:
    return minute_of_day(t).between(OPEN, CLOSE)


def in_premarket(t: Column) -> Column:
    """04:00 to 09:30, the opening minute left out."""
    return (minute_of_day(t) >= PREMARKET) & (minute_of_day(t) < OPEN)


def minute_bars(ticks: DataFrame, minutes: int = 1) -> DataFrame:
    """symbol, t (bar start), o, h, l, c, v from ticks(symbol, t, price, size, tick_id)."""
    order = F.struct("t", "tick_id")
    start = F.window("t", f"{minutes} minutes")["start"]
    return ticks.groupBy("symbol", start.alias("bar")).agg(F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.sum("size").alias("v")).withColumnRenamed("bar", "t")


def sessions(bars: DataFrame, zone: str | None = None) -> DataFrame:
    """One row a symbol and day: OHLC, times of the first high and low, premarket range, volumes, high_before_low. Bars
    stamped in UTC are cut into the sessions of `zone`."""
    bars = bars.withColumn("t", local_time(F.col("t"), zone))
    t = F.col("t")
    s, p = in_session(t), in_premarket(t)
    only = lambda flag, c: F.when(flag, c)
    out = bars.groupBy("symbol", F.to_date("t").alias("session_day")).agg(
        F.min_by("o", only(s, t)).alias("open"), F.max(only(s, F.col("h"))).alias("high"), F.min(only(s, F.col("l"))).alias("low"), F.max_by("c", only(s, t)).alias("close"),
        F.min_by("t", only(s, F.struct(-F.col("h"), t))).alias("high_at"), F.min_by("t", only(s, F.struct("l", t))).alias("low_at"),
        F.min_by("v", only(s, t)).alias("opening_minute_volume"), F.sum(only(s, F.col("v"))).alias("volume"), F.count(only(s, t)).alias("n_bars"),
        F.max(only(p, F.col("h"))).alias("premarket_high"), F.min(only(p, F.col("l"))).alias("premarket_low"), F.sum(only(p, F.col("v"))).alias("premarket_volume"),
    )
    # without a session bar the order keys above are all null
    none = F.col("n_bars") == 0
    out = out.withColumns({c: F.when(~none, F.col(c)) for c in ("open", "close", "high_at", "low_at", "opening_minute_volume")})
    return out.withColumns({"high_time": F.date_format("high_at", "HH:mm"), "low_time": F.date_format("low_at", "HH:mm"), "high_before_low": F.when(none, -1).when(F.col("high_at") < F.col("low_at"), 1).otherwise(0)}).drop("high_at", "low_at")


def interval_returns(bars: DataFrame, strict: bool = False, zone: str | None = None) -> DataFrame:
    """symbol, session_day and pct_<interval>: the close of the k-th session bar against the open, in percent. With
    fewer than k bars the last one counts, or none if strict."""
    bars = bars.withColumn("t", local_time(F.col("t"), zone))
    w = Window.partitionBy("symbol", F.to_date("t")).orderBy("t")
    n = bars.filter(in_session(F.col("t"))).withColumn("k", F.row_number().over(w)).groupBy("symbol", F.to_date("t").alias("session_day"))
    at = {name: F.max(F.when(F.col("k") == k, F.col("c"))) for name, k in INTERVALS.items()}
    g = n.agg(F.max(F.when(F.col("k") == 1, F.col("o"))).alias("open"), F.max_by("c", "k").alias("last"), *(x.alias(f"at_{name}") for name, x in at.items()))
    price = lambda name: F.col(f"at_{name}") if strict else F.coalesce(f"at_{name}", "last")
    return g.select("symbol", "session_day", *((F.try_divide(price(name) - F.col("open"), F.col("open")) * 100).alias(f"pct_{name}") for name in INTERVALS))


def ratios(opening: Column, avg_30: Column, avg_7: Column, total: Column) -> dict[str, Column]:
    return {"volume_ratio_30_day": F.try_divide(opening, avg_30), "volume_ratio_7_day": F.try_divide(opening, avg_7), "volume_comparison": F.round(F.try_divide(total, avg_30), 2)}


def changes(prev: Column, o: Column, h: Column, low: Column, c: Column) -> dict[str, Column]:
    """Percent changes: open and close against the previous close, high and low against the open."""
    pct = lambda a, b: F.try_divide(b - a, F.when(a != 0, a)) * 100
    return {"pct_change_open": pct(prev, o), "pct_change_high": pct(o, h), "pct_change_low": pct(o, low), "pct_change_close": pct(prev, c)}


def ranked(records: DataFrame, by: str = "pct_change_high", day: str = "report_date") -> DataFrame:
    """records with their rank a day, failures (null) last."""
    return records.withColumn("rank", F.row_number().over(Window.partitionBy(day).orderBy(F.desc_nulls_last(by), "symbol", "record_id")))


def source_summary(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce("data_source", F.lit("FAILED")).alias("data_source")).agg(F.count("*").alias("n"))
