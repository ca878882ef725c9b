"""Sources and sinks: tables written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import metrics as M
from tidemark.plans.registry import Views, query
from tidemark.shared import new_path
from tidemark.sources import readers, sinks

_BACK = "SELECT symbol, report_date, coalesce(surprise, -1) AS surprise, coalesce(data_source, '') AS data_source FROM records"


@query("s1_records_csv", "SELECT symbol, CAST(report_date AS VARCHAR) AS report_date, coalesce(surprise, -1) AS surprise, coalesce(earnings_time, -1) AS earnings_time FROM records", "records", "surprise", 4)
def _(v: Views) -> DataFrame:
    """Records as CSV with a semicolon, read back with detected encoding and separator."""
    path = new_path(v.spark, "records-csv")
    sinks.filled(v.records.drop("record_id")).write.option("header", True).option("sep", ";").csv(path)
    return readers.records_csv(v.spark, path).select("symbol", "report_date", "surprise", "earnings_time")


@query("s6_snapshots_json", "SELECT strftime(report_date, '%Y-%m-%d') AS snapshot_date, symbol, open_price FROM records WHERE open_price IS NOT NULL", "records", "open_price", 4)
def _(v: Views) -> DataFrame:
    path = new_path(v.spark, "snapshots")
    day = v.records.filter("open_price IS NOT NULL").groupBy(F.date_format("report_date", "yyyy-MM-dd").alias("date")).agg(F.collect_list(F.struct("symbol", "open_price")).alias("data"))  # a day's records
    month = day.withColumn("timestamp", F.col("date")).groupBy(F.substring("date", 1, 7)).agg(F.to_json(F.collect_list(F.struct("timestamp", "date", "data"))).alias("value"))  # one file a month
    month.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.snapshots_json(v.spark, path, "symbol string, open_price double").select("snapshot_date", "symbol", "open_price")


@query("s7_calendar_range", "SELECT symbol, day, hour, eps_actual FROM calendar WHERE day BETWEEN DATE '1998-01-05' AND DATE '1998-01-30'", "calendar", "eps_actual")
def _(v: Views) -> DataFrame:
    from datetime import date

    path = new_path(v.spark, "calendar")
    entry = F.struct("symbol", F.col("day").alias("date"), "hour", F.col("eps_estimate").alias("epsEstimate"), F.col("eps_actual").alias("epsActual"), F.col("revenue_estimate").alias("revenueEstimate"), F.col("revenue_actual").alias("revenueActual"))
    week = v.calendar.groupBy(F.date_trunc("week", "day").alias("week")).agg(F.collect_list(entry).alias("earningsCalendar"))  # one response a week
    week.select("earningsCalendar").repartition("earningsCalendar").write.option("maxRecordsPerFile", 1).json(path)
    return readers.calendar_json(v.spark, path, date(1998, 1, 5), date(1998, 1, 30)).select("symbol", "day", "hour", "eps_actual")


@query("s8_bars_scan", "SELECT symbol, day, count(*) AS n, max(price) AS top FROM ticks WHERE symbol IN ('click', 'view') AND day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1, 2", "ticks", "top", 4)
def _(v: Views) -> DataFrame:
    from datetime import date

    path = new_path(v.spark, "bars")
    v.ticks.write.partitionBy("day").parquet(path)
    return readers.bars(v.spark, path, ["click", "view"], date(2024, 1, 10), date(2024, 1, 12)).groupBy("symbol", "day").agg(F.count("*").alias("n"), F.max("price").alias("top"))


@query("s11_append_records", f"SELECT symbol, report_date, surprise, data_source, 2 AS n FROM ({_BACK}) q WHERE true", "records", "surprise", 4)
def _(v: Views) -> DataFrame:
    path = new_path(v.spark, "appended")
    r = v.records.select("record_id", "symbol", "report_date", "surprise", "data_source")
    for _ in range(2):
        sinks.append_records(r, path)
    return v.spark.read.parquet(path).groupBy("record_id", "symbol", "report_date", "surprise", "data_source").agg(F.count("*").cast("int").alias("n")).drop("record_id")


@query("s12_overwrite_days", "SELECT report_date, count(*) AS n FROM records GROUP BY 1", "records")
def _(v: Views) -> DataFrame:
    """All years are written, then one of them again: the others stay, the one is not doubled."""
    path = new_path(v.spark, "days")
    r = v.records.select("symbol", F.year("report_date").alias("year"), "report_date")
    sinks.overwrite_days(r, path, "year")
    sinks.overwrite_days(r.filter("year = 1997"), path, "year")
    return v.spark.read.parquet(path).groupBy("report_date").agg(F.count("*").alias("n"))


@query("s13_ranked_strategies", "WITH m AS (SELECT strategy, coalesce(avg(r) / stddev_samp(r) * sqrt(252), 0) AS sharpe FROM trades GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY sharpe DESC, strategy) AS INT) AS rank, strategy, sharpe FROM m", "trades", "sharpe")
def _(v: Views) -> DataFrame:
    path = new_path(v.spark, "strategies")
    sinks.strategies_json(M.series_metrics(v.trades, ["strategy"]), path)
    back = v.spark.read.schema("rank int, record struct<strategy:string,sharpe:double>").json(path)
    return back.select("rank", "record.strategy", "record.sharpe")


def signalled(v: Views) -> DataFrame:
    """Strategies with their drawdown and the timeframe that scores best."""
    from tidemark.operators import regimes as G
    from tidemark.plans.q_strategies import framed, small

    frame = G.best_timeframe(G.timeframes(framed(v)), 1).select("strategy", "timeframe")
    m = M.series_metrics(v.trades, ["strategy"]).join(M.max_drawdown(small(v), ["strategy"]).select("strategy", "mdd"), "strategy")
    return m.join(frame, "strategy", "left").fillna("1hr", ["timeframe"])


@query("s14_signals", lambda: _SIGNALS(), "trades", "sharpe mdd", 4)
def _(v: Views) -> DataFrame:
    """The signals' JSON, read back: the best two have all their fields, the next two a few."""
    json = F.col("json")
    s = sinks.signals(signalled(v), 4, 2)
    field = lambda n: F.get_json_object(json, f"$.{n}")
    return s.select("rank", "strategy", field("sharpe").cast("double").alias("sharpe"), field("mdd").cast("double").alias("mdd"), field("timeframe").alias("timeframe"), field("risk").alias("risk"), field("buy_time").alias("buy_time"))


def _SIGNALS() -> str:
    from tidemark.functions.scalar import BUY_TIMES
    from tidemark.plans.q_strategies import BEST_FRAMES, DRAWDOWN, METRICS

    buy = " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in BUY_TIMES.items())
    return f"""WITH m AS ({METRICS}), dd AS ({DRAWDOWN}), bf AS ({BEST_FRAMES}), j AS (SELECT m.strategy, m.sharpe, dd.mdd, coalesce(bf.timeframe, '1hr') AS timeframe, CAST(row_number() OVER (ORDER BY m.sharpe DESC, m.strategy) AS INT) AS rank FROM m JOIN dd USING (strategy) LEFT JOIN bf USING (strategy))
SELECT rank, strategy, round(sharpe, 4) AS sharpe, CASE WHEN rank <= 2 THEN round(mdd, 4) END AS mdd, CASE WHEN rank <= 2 THEN timeframe END AS timeframe, CASE WHEN rank > 2 THEN CASE WHEN abs(mdd) < 0.05 THEN 'LOW' WHEN abs(mdd) < 0.1 THEN 'MEDIUM' ELSE 'HIGH' END END AS risk, CASE WHEN rank > 2 THEN CASE timeframe {buy} ELSE '09:30:00' END END AS buy_time FROM j WHERE rank <= 4"""


@query("s15_report", "SELECT symbol || ' | ' || strftime(report_date, '%Y-%m-%d') AS head, CASE WHEN opening_minute_volume IS NULL THEN 'N/A' ELSE format('{:,}', CAST(opening_minute_volume AS BIGINT)) END AS volume, CASE WHEN surprise IS NULL THEN 'N/A' END AS no_surprise, 2 * count(*) AS n FROM records GROUP BY ALL", "records")
def _(v: Views) -> DataFrame:
    """The report appended twice, its lines read back."""
    path = new_path(v.spark, "report")
    for _ in range(2):
        sinks.append_report(v.records, path)
    part = F.split("value", " \\| ")
    back = v.spark.read.text(path).select(F.concat_ws(" | ", part[0], part[1]).alias("head"), F.substring_index("value", "volume ", -1).alias("volume"), F.when(part[2] == "surprise N/A", "N/A").alias("no_surprise"))
    return back.groupBy("head", "volume", "no_surprise").agg(F.count("*").alias("n"))
