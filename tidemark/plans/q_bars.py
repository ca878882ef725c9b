"""Joins and bars: calendar, profile, sessions and ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import bars as B, joins as J
from tidemark.plans.registry import Views, query

BARS = """
b AS (SELECT symbol, date_trunc('minute', t) AS t, arg_min(price, t) AS o, max(price) AS h, min(price) AS l, arg_max(price, t) AS c, sum(size) AS v FROM ticks GROUP BY 1, 2),
bm AS (SELECT *, CAST(t AS DATE) AS session_day, hour(t) * 60 + minute(t) AS m FROM b),
s AS (SELECT symbol, session_day, min(o) FILTER (WHERE rk = 1) AS open, max(h) AS high, min(l) AS low, min(c) FILTER (WHERE rl = 1) AS close, CAST(sum(v) AS BIGINT) AS volume, count(*) AS n_bars, CAST(min(v) FILTER (WHERE rk = 1) AS BIGINT) AS opening_minute_volume
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session_day ORDER BY t) AS rk, row_number() OVER (PARTITION BY symbol, session_day ORDER BY t DESC) AS rl FROM bm WHERE m BETWEEN 570 AND 960) q GROUP BY 1, 2)
"""
DAYS = "dd AS (SELECT symbol, day AS session_day, arg_max(price, t) AS close, CAST(sum(size) AS DOUBLE) AS volume FROM ticks GROUP BY 1, 2)"


def sessions(v: Views) -> DataFrame:
    return B.sessions(B.minute_bars(v.ticks))


def days(v: Views) -> DataFrame:
    """Every day's last price and volume by symbol."""
    return v.ticks.groupBy("symbol", F.col("day").alias("session_day")).agg(F.max_by("price", F.struct("t", "tick_id")).alias("close"), F.sum("size").cast("double").alias("volume"))


@query("b3_session_bars", "WITH " + BARS + "SELECT symbol, session_day, open, high, low, close, volume, n_bars, opening_minute_volume FROM s", "ticks", "open high low close", 4)
def _(v: Views) -> DataFrame:
    return sessions(v).filter("n_bars > 0").select("symbol", "session_day", "open", "high", "low", "close", "volume", "n_bars", "opening_minute_volume")


@query("b4_high_low_times", "WITH " + BARS + """, x AS (SELECT symbol, session_day, arg_min(t, -h * 1e6 + m / 1e4) AS ht, arg_min(t, l * 1e6 + m / 1e4) AS lt FROM bm WHERE m BETWEEN 570 AND 960 GROUP BY 1, 2)
SELECT symbol, session_day, strftime(ht, '%H:%M') AS high_time, strftime(lt, '%H:%M') AS low_time, CASE WHEN ht < lt THEN 1 ELSE 0 END AS high_before_low FROM x""", "ticks")
def _(v: Views) -> DataFrame:
    return sessions(v).filter("n_bars > 0").select("symbol", "session_day", "high_time", "low_time", "high_before_low")


@query("b5_premarket", "WITH " + BARS + "SELECT symbol, session_day, max(h) AS premarket_high, min(l) AS premarket_low, CAST(sum(v) AS BIGINT) AS premarket_volume FROM bm WHERE m >= 240 AND m < 570 GROUP BY 1, 2", "ticks", "premarket_high premarket_low", 4)
def _(v: Views) -> DataFrame:
    return sessions(v).filter("premarket_volume IS NOT NULL").select("symbol", "session_day", "premarket_high", "premarket_low", "premarket_volume")


def _intervals(strict: bool) -> str:
    at = {"1min": 1, "5min": 5, "15min": 15, "30min": 30, "1hr": 60}
    price = lambda k: f"max(c) FILTER (WHERE k = {k})" if strict else f"coalesce(max(c) FILTER (WHERE k = {k}), arg_max(c, k))"
    cols = ", ".join(f"({price(k)} - max(o) FILTER (WHERE k = 1)) / max(o) FILTER (WHERE k = 1) * 100 AS pct_{n}" for n, k in at.items())
    return "WITH " + BARS + f", k AS (SELECT *, row_number() OVER (PARTITION BY symbol, session_day ORDER BY t) AS k FROM bm WHERE m BETWEEN 570 AND 960) SELECT symbol, session_day, {cols} FROM k GROUP BY 1, 2"


_PCT = "pct_1min pct_5min pct_15min pct_30min pct_1hr"


@query("b7_interval_returns", _intervals(False), "ticks", _PCT)
def _(v: Views) -> DataFrame:
    return B.interval_returns(B.minute_bars(v.ticks))


@query("b8_interval_returns_strict", _intervals(True), "ticks", _PCT)
def _(v: Views) -> DataFrame:
    return B.interval_returns(B.minute_bars(v.ticks), strict=True)


def _avg(n: int, least: int, span: int, where: str = "") -> str:
    return f"""(SELECT CASE WHEN count(*) >= {least} THEN avg(volume) END FROM (SELECT volume FROM dd p WHERE p.symbol = x.symbol AND p.session_day < x.session_day AND p.session_day >= x.session_day - {span} {where} ORDER BY p.session_day DESC LIMIT {n}) q)"""


@query("b10_average_volumes", f"WITH {DAYS} SELECT symbol, session_day, {_avg(30, 5, 45)} AS avg_30, {_avg(7, 3, 10)} AS avg_7, {_avg(30, 10, 45, 'AND volume > 700')} AS avg_pos FROM dd x", "ticks", "avg_30 avg_7 avg_pos")
def _(v: Views) -> DataFrame:
    d = days(v).select("symbol", "session_day", "volume")
    r = J.average_before(J.average_before(d.select("symbol", "session_day"), d, 30, 5, 45, name="avg_30"), d, 7, 3, 10, name="avg_7")
    return J.average_before(r, d.filter("volume > 700"), 30, 10, 45, positive=True, name="avg_pos")


@query("b12_ratios_changes", f"""WITH {BARS}, {DAYS}, y AS (SELECT s.*, d.close AS prev, {_avg(30, 5, 45).replace('x.', 's.')} AS a30 FROM s LEFT JOIN dd d ON d.symbol = s.symbol AND d.session_day = s.session_day - CAST(CASE isodow(s.session_day) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS INT))
SELECT symbol, session_day, prev, opening_minute_volume / a30 AS volume_ratio_30_day, round(volume / a30, 2) AS volume_comparison, (open - prev) / prev * 100 AS pct_change_open, (high - open) / open * 100 AS pct_change_high, (low - open) / open * 100 AS pct_change_low, (close - prev) / prev * 100 AS pct_change_close FROM y""", "ticks", "prev volume_ratio_30_day volume_comparison pct_change_open pct_change_high pct_change_low pct_change_close", 4)
def _(v: Views) -> DataFrame:
    d = days(v)
    s = J.previous_session_close(sessions(v).filter("n_bars > 0"), d)
    s = J.average_before(s, d.select("symbol", "session_day", "volume"), 30, 5, 45, name="a30")
    r = B.ratios(F.col("opening_minute_volume"), F.col("a30"), F.col("a30"), F.col("volume"))
    s = s.withColumns({"volume_ratio_30_day": r["volume_ratio_30_day"], "volume_comparison": r["volume_comparison"]} | B.changes(F.col("prev_close"), F.col("open"), F.col("high"), F.col("low"), F.col("close")))
    return s.select("symbol", "session_day", F.col("prev_close").alias("prev"), "volume_ratio_30_day", "volume_comparison", "pct_change_open", "pct_change_high", "pct_change_low", "pct_change_close")


@query("b14_ranked_report", "SELECT record_id, report_date, row_number() OVER (PARTITION BY report_date ORDER BY pct_change_high DESC NULLS LAST, symbol, record_id) AS rank FROM records", "records")
def _(v: Views) -> DataFrame:
    return B.ranked(v.records).select("record_id", "report_date", F.col("rank").cast("long").alias("rank"))


@query("b15_source_summary", "SELECT coalesce(data_source, 'FAILED') AS data_source, count(*) AS n FROM records GROUP BY 1", "records")
def _(v: Views) -> DataFrame:
    return B.source_summary(v.records)


@query("j1_profile", "SELECT entry_id, symbol, p.market_cap, p.industry, p.country, p.region FROM calendar JOIN profile p USING (symbol)", "calendar profile", "market_cap", 4)
def _(v: Views) -> DataFrame:
    return J.with_profile(v.calendar.select("entry_id", "symbol"), v.profile)


@query("j2_prev_close", "SELECT c.entry_id, c.symbol, coalesce(p.prev_close, 0e0) AS prev_close FROM calendar c LEFT JOIN (SELECT symbol, market_cap / 10 AS prev_close FROM profile WHERE market_cap > 2000) p USING (symbol)", "calendar profile", "prev_close", 4)
def _(v: Views) -> DataFrame:
    closes = v.profile.filter("market_cap > 2000").select("symbol", (F.col("market_cap") / 10).alias("prev_close"))
    return J.with_prev_close(v.calendar.select("entry_id", "symbol"), closes)


@query("j3_reaction_session", """
WITH c AS (SELECT entry_id, symbol, CASE WHEN hour = 'amc' THEN day + CAST(CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT) ELSE day END AS session_day FROM calendar)
SELECT c.entry_id, c.symbol, c.session_day, r.record_id FROM c JOIN records r ON r.symbol = c.symbol AND r.report_date = c.session_day""", "calendar records")
def _(v: Views) -> DataFrame:
    s = v.records.select("symbol", F.col("report_date").alias("session_day"), "record_id")
    return J.on_reaction_day(v.calendar.select("entry_id", "symbol", "day", "hour"), s).select("entry_id", "symbol", "session_day", "record_id")


@query("j4_asof_close", f"WITH {DAYS} SELECT symbol, session_day, lag(close) OVER (PARTITION BY symbol ORDER BY session_day) AS prev_close FROM dd", "ticks", "prev_close", 4)
def _(v: Views) -> DataFrame:
    d = days(v)
    return J.asof_close(d.select("symbol", "session_day"), d)


@query("j5_fallback_quotes", """
SELECT r.record_id, coalesce(a.open_price, CASE WHEN a.record_id IS NULL THEN f.open_price END) AS open_price, CASE WHEN a.record_id IS NOT NULL THEN 'Alpaca' WHEN f.record_id IS NOT NULL THEN 'Finnhub' ELSE 'FAILED' END AS data_source
FROM records r LEFT JOIN (SELECT record_id, open_price FROM records WHERE data_source = 'Alpaca') a USING (record_id) LEFT JOIN (SELECT record_id, open_price + 1 AS open_price FROM records WHERE data_source IS NOT NULL) f USING (record_id)""", "records", "open_price", 4)
def _(v: Views) -> DataFrame:
    r = v.records
    return J.with_fallback(r.select("record_id"), r.filter("data_source = 'Alpaca'"), r.filter("data_source IS NOT NULL").withColumn("open_price", F.col("open_price") + 1), ["record_id"], ["open_price"])


@query("j6_exclusions", "SELECT record_id, symbol FROM records WHERE date_trunc('month', report_date) NOT IN (SELECT DISTINCT date_trunc('month', report_date) FROM records WHERE data_source IS NULL AND surprise > 60)", "records")
def _(v: Views) -> DataFrame:
    r = v.records.withColumn("month", F.trunc("report_date", "month"))
    return J.exclude(r, r.filter("data_source IS NULL AND surprise > 60").select("month").distinct(), ["month"]).select("record_id", "symbol")


BINS = [(0, -10.0, -2.0, -3.0, 2.0), (1, -2.0, 0.0, -2.0, 1.5), (2, 0.0, 2.0, -1.5, 2.5), (3, 1.0, 4.0, -2.5, 5.0), (4, 4.5, 10.0, -4.0, 8.0)]
BINS_SQL = "bins(ordinal, range_min, range_max, stop_loss, target_profit) AS (VALUES " + ", ".join(f"({o}, {a}e0, {b}e0, {s}e0, {t}e0)" for o, a, b, s, t in BINS) + ")"


def bins(v: Views) -> DataFrame:
    return v.spark.createDataFrame(BINS, "ordinal int, range_min double, range_max double, stop_loss double, target_profit double")


@query("j7_gap_bins", f"""WITH {BINS_SQL}, m AS (SELECT record_id, pct_change_open, min(ordinal) AS ordinal FROM records LEFT JOIN bins ON pct_change_open >= range_min AND pct_change_open < range_max GROUP BY 1, 2)
SELECT record_id, ordinal, b.stop_loss, b.target_profit FROM m LEFT JOIN bins b USING (ordinal)""", "records")
def _(v: Views) -> DataFrame:
    m = J.match_bin(v.records, bins(v), F.col("pct_change_open"))
    return m.select("record_id", "bin.ordinal", "bin.stop_loss", "bin.target_profit")


@query("j8_market_return", "SELECT record_id, avg(pct_change_close) OVER (PARTITION BY report_date) AS market_return FROM records", "records", "market_return")
def _(v: Views) -> DataFrame:
    from tidemark.operators.metrics import daily_mean

    return v.records.join(daily_mean(v.records, "pct_change_close").withColumnRenamed("mean", "market_return"), "report_date").select("record_id", "market_return")


@query("j10_revenue_entry", """
WITH e AS (SELECT c.symbol, c.day, min(struct_pack(day := e.day, entry_id := e.entry_id)) AS x FROM (SELECT DISTINCT symbol, day FROM calendar) c JOIN calendar e ON e.symbol = c.symbol AND e.day BETWEEN c.day - 1 AND c.day + 1 GROUP BY 1, 2)
SELECT c.entry_id, e.x.entry_id AS revenue_entry FROM calendar c LEFT JOIN e USING (symbol, day)""", "calendar")
def _(v: Views) -> DataFrame:
    return J.revenue_entry(v.calendar.select("entry_id", "symbol", "day"), v.calendar).select("entry_id", F.col("entry.entry_id").alias("revenue_entry"))
