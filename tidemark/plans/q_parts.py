"""Queries of operators that other queries only use inside: one each."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import dist, scalar as S
from tidemark.operators import bars as B, clean, conditions as X, features as E, folds as D, inference as I, joins as J, metrics as M, models as L, targets as T, windows as N
from tidemark.plans.prefix import average_ranks, with_running
from tidemark.plans.q_bars import BARS, DAYS, _avg, days, sessions
from tidemark.plans.q_more import _T
from tidemark.plans.q_strategies import _HITS, CONDITIONS, EXPANDING, FEATURES_SQL, LONG, METRICS, conditioned, daily, hits
from tidemark.plans.registry import Views, query, t_critical, t_power

_flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"

# cleaning


@query("p2_resolve_date", "SELECT record_id, report_date FROM records", "records")
def _(v: Views) -> DataFrame:
    return clean.resolve_date(v.records.select("record_id", F.col("report_date").alias("earnings_date")))


@query("p4_infinities", "SELECT record_id, CASE WHEN record_id % 5 < 2 THEN NULL ELSE market_cap END AS x FROM records", "records", "x", 4)
def _(v: Views) -> DataFrame:
    x = F.when(F.col("record_id") % 5 == 0, float("inf")).when(F.col("record_id") % 5 == 1, float("-inf")).otherwise(F.col("market_cap"))
    return clean.sentinels_to_null(v.records.select("record_id", x.alias("x")), percents=["x"])


@query("p10_safe_ints", "SELECT record_id, CASE WHEN record_id % 3 = 0 THEN -1 ELSE CAST(trunc(record_id / 2e0) AS BIGINT) END AS x, CAST(earnings_time AS BIGINT) AS code FROM records", "records")
def _(v: Views) -> DataFrame:
    text = F.when(F.col("record_id") % 3 == 0, F.col("high_time")).otherwise(F.concat(F.lit(" "), (F.col("record_id") / 2).cast("string")))
    return v.records.select("record_id", S.safe_int(text).alias("x"), S.safe_int(F.col("earnings_time")).alias("code"))


@query("p12_symbols", "SELECT record_id, CASE WHEN record_id % 2 = 0 THEN 'SB' ELSE 'S' END AS symbol FROM records WHERE record_id % 7 <> 0", "records")
def _(v: Views) -> DataFrame:
    raw = F.when(F.col("record_id") % 7 == 0, F.col("record_id").cast("string")).when(F.col("record_id") % 2 == 0, F.concat("symbol", F.lit(".B"))).otherwise(F.concat(F.lit(" "), "symbol", F.lit("x-")))
    return clean.clean_symbols(v.records.select("record_id", raw.alias("symbol")))


@query("p17_category_default", "SELECT record_id, coalesce(data_source, 'Other') AS data_source, CASE WHEN record_id % 4 = 0 THEN 'Other' ELSE sector END AS sector FROM records", "records")
def _(v: Views) -> DataFrame:
    return clean.fill_text(v.records.select("record_id", "data_source", F.when(F.col("record_id") % 4 != 0, F.col("sector")).alias("sector")), ["data_source", "sector"])


@query("p19_to_numbers", "SELECT record_id, CASE WHEN record_id % 3 <> 0 THEN CAST(record_id AS DOUBLE) / 4 END AS x FROM records", "records", "x")
def _(v: Views) -> DataFrame:
    text = F.when(F.col("record_id") % 3 == 0, F.col("sector")).otherwise((F.col("record_id") / 4).cast("string"))
    return clean.to_numbers(v.records.select("record_id", text.alias("x")), ["x"])


@query("p22_report_window", "SELECT entry_id, (day = DATE '1997-03-03' AND hour = 'amc') OR (day = DATE '1997-03-04' AND hour = 'bmo') AS inside FROM calendar", "calendar")
def _(v: Views) -> DataFrame:
    return v.calendar.select("entry_id", clean.window_predicate(F.col("day"), F.col("hour"), F.lit(date(1997, 3, 3)), F.lit(date(1997, 3, 4))).alias("inside"))


@query("p23_failures_last", "SELECT report_date, count(*) FILTER (WHERE pct_change_high IS NULL) AS n_failed, CASE WHEN count(*) > count(pct_change_high) THEN count(pct_change_high) + 1 END AS first_failed_rank FROM records GROUP BY 1", "records")
def _(v: Views) -> DataFrame:
    failed = F.col("pct_change_high").isNull()
    return B.ranked(v.records).groupBy("report_date").agg(F.count_if(failed).alias("n_failed"), F.min(F.when(failed, F.col("rank"))).cast("long").alias("first_failed_rank"))


_R = "(close_price - open_price) / open_price"


@query("p25_without_target", f"SELECT count(*) AS n, count({_R}) AS n_kept FROM records", "records")
def _(v: Views) -> DataFrame:
    kept = T.create(E.intraday(v.records)).agg(F.count("*").alias("n_kept"))
    return v.records.agg(F.count("*").alias("n")).crossJoin(F.broadcast(kept))  # one row each


# joins and bars


@query("j11_rows_of_folds", f'SELECT fold, role, count(*) AS n, min(trades.d) AS first_day FROM trades JOIN ({EXPANDING}) f ON trades.d BETWEEN f.start AND f."end" GROUP BY 1, 2', "trades")
def _(v: Views) -> DataFrame:
    return D.assign(v.trades, D.expanding(v.trades)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("d").alias("first_day"))


@query("j12_volume_before", f"WITH {DAYS} SELECT symbol, session_day, {_avg(7, 3, 10)} AS avg_7 FROM dd x", "ticks", "avg_7")
def _(v: Views) -> DataFrame:
    d = days(v).select("symbol", "session_day", "volume")
    return J.average_before(d.select("symbol", "session_day"), d, 7, 3, 10, name="avg_7")


#: The events lie in one winter month, so New York time is five hours behind.
_LOCAL = "l AS (SELECT symbol, t - INTERVAL 5 HOUR AS t, h, l, v FROM b), m AS (SELECT *, CAST(t AS DATE) AS session_day, hour(t) * 60 + minute(t) AS m FROM l)"


@query("b1_regular_session", f"WITH {BARS}, {_LOCAL} SELECT symbol, session_day, count(*) AS n_bars, max(h) AS high, min(l) AS low FROM m WHERE m BETWEEN 570 AND 960 GROUP BY 1, 2", "ticks", "high low", 4)
def _(v: Views) -> DataFrame:
    """Bars stamped in UTC, sessions of New York."""
    return B.sessions(B.minute_bars(v.ticks), zone=B.NEW_YORK).filter("n_bars > 0").select("symbol", "session_day", "n_bars", "high", "low")


@query("b2_premarket_session", f"WITH {BARS}, {_LOCAL} SELECT symbol, session_day, max(h) AS premarket_high, min(l) AS premarket_low, CAST(sum(v) AS BIGINT) AS premarket_volume FROM m WHERE m >= 240 AND m < 570 GROUP BY 1, 2", "ticks", "premarket_high premarket_low", 4)
def _(v: Views) -> DataFrame:
    return B.sessions(B.minute_bars(v.ticks), zone=B.NEW_YORK).filter("premarket_volume IS NOT NULL").select("symbol", "session_day", "premarket_high", "premarket_low", "premarket_volume")


@query("b6_opening_minute", "WITH " + BARS + "SELECT symbol, session_day, opening_minute_volume FROM s", "ticks")
def _(v: Views) -> DataFrame:
    return sessions(v).filter("n_bars > 0").select("symbol", "session_day", "opening_minute_volume")


@query("b9_high_before_low", "WITH " + BARS + ", x AS (SELECT symbol, session_day, arg_min(m, -h * 1e6 + m / 1e4) AS ht, arg_min(m, l * 1e6 + m / 1e4) AS lt FROM bm WHERE m BETWEEN 570 AND 960 GROUP BY 1, 2) SELECT symbol, count(*) FILTER (WHERE ht < lt) AS high_first, count(*) FILTER (WHERE ht >= lt) AS low_first FROM x GROUP BY 1", "ticks")
def _(v: Views) -> DataFrame:
    """By bar time, and the same by the times' texts."""
    s = sessions(v).filter("n_bars > 0")
    first = (F.col("high_before_low") == 1) & (F.col("high_time") < F.col("low_time"))
    return s.groupBy("symbol").agg(F.count_if(first).alias("high_first"), F.count_if((F.col("high_before_low") == 0) & (F.col("high_time") >= F.col("low_time"))).alias("low_first"))


@query("b11_positive_volumes", f"WITH {DAYS} SELECT symbol, session_day, {_avg(30, 10, 45, 'AND volume > 0')} AS avg_30 FROM dd x", "ticks", "avg_30")
def _(v: Views) -> DataFrame:
    d = days(v).select("symbol", "session_day", "volume")
    return J.average_before(d.select("symbol", "session_day"), d, 30, 10, 45, positive=True, name="avg_30")


_CHANGES = "pct_change_open pct_change_high pct_change_low pct_change_close"


@query("b13_changes", "SELECT record_id, (open_price - p) / p * 100 AS pct_change_open, (high_price - open_price) / open_price * 100 AS pct_change_high, (low_price - open_price) / open_price * 100 AS pct_change_low, (close_price - p) / p * 100 AS pct_change_close FROM (SELECT *, reference_prev_close AS p FROM records) q", "records", _CHANGES, 5)
def _(v: Views) -> DataFrame:
    c = B.changes(*(F.col(x) for x in ("reference_prev_close", "open_price", "high_price", "low_price", "close_price")))
    return v.records.select("record_id", *(x.alias(n) for n, x in c.items()))


# scalars


@query("f2_revenue_surprise", "SELECT entry_id, (revenue_actual - revenue_estimate) / nullif(abs(revenue_estimate), 0) * 100 AS x FROM calendar", "calendar", "x")
def _(v: Views) -> DataFrame:
    return v.calendar.select("entry_id", S.surprise_pct(F.col("revenue_actual"), F.col("revenue_estimate")).alias("x"))


@query("f3_percent_change", "SELECT record_id, (close_price - open_price) / nullif(open_price, 0) * 100 AS x FROM records", "records", "x", 5)
def _(v: Views) -> DataFrame:
    return v.records.select("record_id", S.pct_change(F.col("open_price"), F.col("close_price")).alias("x"))


@query("f5_business_days_of_calendar", "SELECT count(*) FILTER (WHERE isodow(day) < 6) AS n_business, count(*) FILTER (WHERE isodow(day) >= 6) AS n_other FROM calendar", "calendar")
def _(v: Views) -> DataFrame:
    b = S.is_business_day(F.col("day"))
    return v.calendar.agg(F.count_if(b).alias("n_business"), F.count_if(~b).alias("n_other"))


@query("f6_reaction_days", "SELECT hour, CASE WHEN hour = 'amc' THEN CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END ELSE 0 END AS days_on, count(*) AS n FROM calendar GROUP BY 1, 2", "calendar")
def _(v: Views) -> DataFrame:
    return v.calendar.groupBy("hour", F.datediff(S.reaction_date(F.col("day"), F.col("hour")), "day").alias("days_on")).agg(F.count("*").alias("n"))


@query("f10_codes", "SELECT hour, CASE hour WHEN 'bmo' THEN 0 WHEN 'amc' THEN 1 ELSE -1 END AS code, count(*) AS n FROM calendar GROUP BY 1, 2", "calendar")
def _(v: Views) -> DataFrame:
    return v.calendar.groupBy("hour", S.earnings_time_code(F.upper("hour")).alias("code")).agg(F.count("*").alias("n"))


@query("f11_logs", "SELECT record_id, ln(1 + opening_minute_volume) AS opening, ln(1 + volume_30_day_avg) AS thirty, ln(1 + volume_7_day_avg) AS seven, ln(1 + coalesce(market_cap, 0)) AS cap FROM records", "records", "opening thirty seven cap", 5)
def _(v: Views) -> DataFrame:
    return E.volume(E.market_cap(v.records)).select("record_id", F.col("opening_volume_log").alias("opening"), F.col("volume_30d_log").alias("thirty"), F.col("volume_7d_log").alias("seven"), F.col("market_cap_log").alias("cap"))


@query("f13_surprise_classes", "SELECT CASE WHEN abs(surprise) <= 2 THEN 'small' WHEN abs(surprise) <= 5 THEN 'medium' WHEN abs(surprise) <= 10 THEN 'large' ELSE 'huge' END AS class, count(*) AS n FROM records WHERE surprise IS NOT NULL GROUP BY 1", "records")
def _(v: Views) -> DataFrame:
    return v.records.filter("surprise IS NOT NULL").groupBy(S.cut(F.abs("surprise"), S.SURPRISE_EDGES, S.SURPRISE_NAMES).alias("class")).agg(F.count("*").alias("n"))


_I = "list_filter([pct_1min, pct_5min, pct_15min, pct_30min, pct_1hr], lambda z: z IS NOT NULL)"


@query("f15_row_statistics", f"SELECT record_id, CASE WHEN len(a) >= 2 THEN list_stddev_samp(a) END AS std, list_max(a) - list_min(a) AS width, coalesce(len(list_filter(a, lambda z: z > 0)) / nullif(len(a), 0), 0.5) AS up FROM (SELECT record_id, {_I} AS a FROM records) q", "records", "std width up", 5)
def _(v: Views) -> DataFrame:
    c = [F.col(x) for x in E.INTRADAY]
    return v.records.select("record_id", S.row_std(*c).alias("std"), S.row_range(*c).alias("width"), S.positive_share(*c).alias("up"))


def timed(v: Views) -> DataFrame:
    return E.timing(v.records)


@query("f16_calendar_parts", "SELECT CAST(year(report_date) AS INT) AS year, CAST(quarter(report_date) AS INT) AS quarter, CAST(month(report_date) AS INT) AS month, CAST(isodow(report_date) - 1 AS INT) AS day_of_week, count(*) AS n FROM records GROUP BY ALL", "records")
def _(v: Views) -> DataFrame:
    return timed(v).groupBy("year", "quarter", "month", "day_of_week").agg(F.count("*").alias("n"))


@query("f17_period_ends", f"SELECT record_id, {_flag('report_date = last_day(report_date)')} AS is_month_end, {_flag('report_date = last_day(report_date) AND month(report_date) % 3 = 0')} AS is_quarter_end FROM records", "records")
def _(v: Views) -> DataFrame:
    return timed(v).select("record_id", "is_month_end", "is_quarter_end")


@query("f18_earnings_season", f"SELECT {_flag('month(report_date) % 3 = 1')} AS earnings_season, count(*) AS n FROM records GROUP BY 1", "records")
def _(v: Views) -> DataFrame:
    return timed(v).groupBy("earnings_season").agg(F.count("*").alias("n"))


@query("f22_rules", "SELECT record_id, concat_ws(' ', sector, CASE WHEN record_id % 2 = 0 THEN '>' ELSE '<=' END, printf('%.4f', CAST(record_id AS DOUBLE) / 4)) AS rule FROM records", "records")
def _(v: Views) -> DataFrame:
    return v.records.select("record_id", S.rule_text(F.col("sector"), F.when(F.col("record_id") % 2 == 0, ">").otherwise("<="), F.col("record_id") / 4).alias("rule"))


_FRAMES = ["market_open", "1min", "5min", "15min", "30min", "1hr", "close", "never"]
_BUY = "CASE record_id % 8 " + " ".join(f"WHEN {i} THEN '{S.BUY_TIMES.get(n, '09:30:00')}'" for i, n in enumerate(_FRAMES)) + " END"


@query("f23_times_and_risk", f"SELECT record_id, {_BUY} AS buy_time, CASE WHEN abs(pct_1min) < 0.05 THEN 'LOW' WHEN abs(pct_1min) < 0.1 THEN 'MEDIUM' WHEN pct_1min IS NOT NULL THEN 'HIGH' END AS risk FROM records", "records")
def _(v: Views) -> DataFrame:
    frame = F.element_at(F.array(*map(F.lit, _FRAMES)), (F.col("record_id") % 8 + 1).cast("int"))
    return v.records.select("record_id", S.buy_time(frame).alias("buy_time"), S.risk_level(F.col("pct_1min")).alias("risk"))


@query("f24_signals_of_strategies", f"WITH m AS ({METRICS}) SELECT strategy, CASE WHEN sharpe > 0 THEN 'BUY' ELSE 'SELL' END AS action, least(win_rate, 0.75) AS confidence FROM m", "trades", "confidence")
def _(v: Views) -> DataFrame:
    m = M.series_metrics(v.trades, ["strategy"])
    return m.select(S.trading_signal(F.col("strategy"), F.col("sharpe"), F.col("win_rate"), F.lit(0.25)).alias("x")).select("x.strategy", "x.action", "x.confidence")


# features


@query("e2_market_cap", "WITH x AS (SELECT record_id, market_cap, ln(1 + coalesce(market_cap, 0)) AS c FROM records), b AS (SELECT min(c) AS lo, max(c) AS hi FROM x) SELECT record_id, c AS market_cap_log, market_cap / 1000 AS market_cap_billions, ['XS', 'S', 'M', 'L', 'XL'][CAST(greatest(1, least(5, ceil((c - lo) / ((hi - lo) / 5)))) AS INT)] AS market_cap_bucket FROM x, b", "records", "market_cap_log market_cap_billions")
def _(v: Views) -> DataFrame:
    return E.market_cap(v.records).select("record_id", "market_cap_log", "market_cap_billions", "market_cap_bucket")


@query("e10_sector_zscore", "SELECT record_id, (pct_1hr - avg(pct_1hr) OVER w) / (stddev_samp(pct_1hr) OVER w + 1e-6) AS pct_1hr_sector_zscore FROM records WINDOW w AS (PARTITION BY sector)", "records", "pct_1hr_sector_zscore", 5)
def _(v: Views) -> DataFrame:
    return E.relative(v.records, ["pct_1hr"]).select("record_id", "pct_1hr_sector_zscore")


@query("e16_gap", "SELECT record_id, (open_price - reference_prev_close) / reference_prev_close AS gap_pct FROM records", "records", "gap_pct")
def _(v: Views) -> DataFrame:
    return E.price_returns(v.records).select("record_id", "gap_pct")


@query("e17_volume_ratio", "SELECT record_id, opening_minute_volume / volume_30_day_avg AS volume_ratio FROM records", "records", "volume_ratio")
def _(v: Views) -> DataFrame:
    return E.price_returns(v.records).select("record_id", "volume_ratio")


@query("e18_surprise_ratios", "SELECT entry_id, (eps_actual - eps_estimate) / nullif(abs(eps_estimate), 0) AS eps, (revenue_actual - revenue_estimate) / nullif(abs(revenue_estimate), 0) AS revenue FROM calendar", "calendar", "eps revenue")
def _(v: Views) -> DataFrame:
    ratio = lambda n: S.surprise_pct(F.col(f"{n}_actual"), F.col(f"{n}_estimate")) / 100
    return v.calendar.select("entry_id", ratio("eps").alias("eps"), ratio("revenue").alias("revenue"))


# windows, orders, unions

_BY = "PARTITION BY symbol ORDER BY report_date, record_id"


@query("w1_lag", f"SELECT record_id, lag(pct_1hr) OVER ({_BY}) AS pct_1hr_lag1 FROM records", "records", "pct_1hr_lag1", 4)
def _(v: Views) -> DataFrame:
    return E.lags(v.series("pct_1hr"), ["pct_1hr"]).select("record_id", "pct_1hr_lag1")


@query("w2_rolling_two", f"SELECT record_id, avg(pct_1hr) OVER w AS pct_1hr_rolling_mean, stddev_samp(pct_1hr) OVER w AS pct_1hr_rolling_std FROM records WINDOW w AS ({_BY} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)", "records", "pct_1hr_rolling_mean pct_1hr_rolling_std", 5)
def _(v: Views) -> DataFrame:
    return E.lags(v.series("pct_1hr"), ["pct_1hr"]).select("record_id", "pct_1hr_rolling_mean", "pct_1hr_rolling_std")


@query("w3_rolling_quantile", f"WITH w AS (SELECT record_id, surprise AS x, count(surprise) OVER w AS n, quantile_cont(surprise, 0.75) OVER w AS q FROM records WINDOW w AS ({_BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT record_id, {_flag('n = 5 AND x > q')} AS high_vol_regime FROM w", "records")
def _(v: Views) -> DataFrame:
    return E.vol_regime(v.series("surprise").withColumnRenamed("surprise", "intraday_vol"), 5).select("record_id", "high_vol_regime")


@query("w5_differences", f"WITH x AS (SELECT record_id, market_cap AS p, lag(market_cap) OVER ({_BY}) AS q FROM records) SELECT record_id, p - q AS diff, (p - q) / nullif(q, 0) * 100 AS pct FROM x", "records", "diff pct", 5)
def _(v: Views) -> DataFrame:
    return N.differences(v.series("market_cap"), "market_cap", "symbol", ("report_date", "record_id")).select("record_id", "diff", "pct")


@query("w7_cumulative_sum", _T + " SELECT strategy, d, sum(r) OVER (PARTITION BY strategy ORDER BY d) AS total FROM t", "trades", "total", 7)
def _(v: Views) -> DataFrame:
    return with_running(daily(v), ["strategy"], ["d"], {"total": ("sum", F.col("r"))}).select("strategy", "d", "total")


@query("w8_percent_rank", "SELECT record_id, CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2e0) / count(s) OVER () END AS share FROM (SELECT record_id, revenue_surprise AS s FROM records) q", "records", "share")
def _(v: Views) -> DataFrame:
    return average_ranks(v.records, "revenue_surprise", "share", share=True).select("record_id", "share")


@query("w9_forward_fill", f"WITH f AS (SELECT record_id, last_value(pct_1hr IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS x FROM records) SELECT record_id, coalesce(x, (SELECT median(x) FROM f)) AS pct_1hr FROM f", "records", "pct_1hr", 5)
def _(v: Views) -> DataFrame:
    return clean.forward_fill(v.series("pct_1hr"), ["pct_1hr"], order=["report_date", "record_id"]).select("record_id", "pct_1hr")


@query("w10_group_statistics", "SELECT record_id, avg(surprise) OVER w AS mean, stddev_samp(surprise) OVER w AS std FROM records WINDOW w AS (PARTITION BY industry)", "records", "mean std", 5)
def _(v: Views) -> DataFrame:
    return N.group_statistics(v.records, "surprise", "industry").select("record_id", "mean", "std")


@query("o1_order_by_several", "SELECT record_id, row_number() OVER (PARTITION BY sector ORDER BY report_date DESC, surprise NULLS LAST, record_id) AS place FROM records", "records")
def _(v: Views) -> DataFrame:
    return N.places(v.records, "sector", "report_date", [F.asc_nulls_last("surprise"), F.asc("record_id")]).select("record_id", "place")


@query("o3_top_by_sector", "SELECT sector, symbol, n FROM (SELECT sector, symbol, count(*) AS n, row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, symbol) AS k FROM records GROUP BY 1, 2) q WHERE k <= 5", "records")
def _(v: Views) -> DataFrame:
    n = v.records.groupBy("sector", "symbol").agg(F.count("*").alias("n"))
    return N.top_per_group(n, "sector", [F.desc("n"), F.asc("symbol")], 5)


@query("o4_rank_of_strategies", f"WITH m AS ({METRICS}) SELECT strategy, CAST(row_number() OVER (ORDER BY sharpe DESC, strategy) AS INT) AS rank FROM m", "trades")
def _(v: Views) -> DataFrame:
    from tidemark.sources.sinks import ranked_strategies

    return ranked_strategies(M.series_metrics(v.trades, ["strategy"])).select("record.strategy", "rank")


@query("x2_singles_and_combinations", f"WITH {_HITS} SELECT 'single' AS kind, strategy, count(*) AS n, avg(r) AS mean FROM trades GROUP BY 1, 2 UNION ALL SELECT 'combination', strategy, count(*), avg(r) FROM h GROUP BY 1, 2", "trades", "mean")
def _(v: Views) -> DataFrame:
    both = v.trades.select(F.lit("single").alias("kind"), "strategy", "r").unionByName(hits(v).select(F.lit("combination").alias("kind"), "strategy", "r"))
    return both.groupBy("kind", "strategy").agg(F.count("*").alias("n"), F.avg("r").alias("mean"))


# conditions, inference, models


@query("c1_conditions", LONG + " SELECT condition, count(*) FILTER (WHERE flag) AS n_true, count(*) FILTER (WHERE NOT flag) AS n_false FROM long GROUP BY 1", "records")
def _(v: Views) -> DataFrame:
    every = E.written(conditioned(v))
    df, library = every.filter("r IS NOT NULL"), X.library(every)
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(c).alias(n) for n, c in library.items()))
    return counts.unpivot("_n", list(library), "condition", "n_true").select("condition", "n_true", (F.col("_n") - F.col("n_true")).alias("n_false"))


_TOP = [f"sector = (SELECT top_sector FROM ranked_top WHERE k = {i + 1})" for i in range(5)]


def _mask_sql() -> str:
    tests = [*list(CONDITIONS.values())[:-2], *_TOP, *list(CONDITIONS.values())[-2:]]
    bits = " + ".join(f"CASE WHEN {c} THEN CAST({1 << i} AS BIGINT) ELSE 0 END" for i, c in enumerate(tests))
    return f"WITH {FEATURES_SQL}, ranked_top AS (SELECT sector AS top_sector, row_number() OVER (ORDER BY count(*) DESC, sector) AS k FROM f GROUP BY sector) SELECT record_id, {bits} AS mask FROM f, q"


@query("c1_condition_masks", _mask_sql(), "records")
def _(v: Views) -> DataFrame:
    """Every record's conditions, one bit each in the library's order."""
    df = E.written(conditioned(v))
    return df.select("record_id", X.mask_of(list(X.library(df).values())).alias("mask"))


@query("i5_effect_sizes", f"WITH {FEATURES_SQL}, s AS (SELECT avg(r) FILTER (WHERE surprise > 0) AS a, avg(r) FILTER (WHERE NOT coalesce(surprise > 0, false)) AS b, stddev_samp(r) FILTER (WHERE surprise > 0) AS sa, stddev_samp(r) FILTER (WHERE NOT coalesce(surprise > 0, false)) AS sb, count(r) FILTER (WHERE surprise > 0) AS na, count(r) FILTER (WHERE NOT coalesce(surprise > 0, false)) AS nb, avg(r) / stddev_samp(r) AS own FROM f) SELECT 'surprise_positive' AS condition, (a - b) / sqrt(((na - 1) * sa ** 2 + (nb - 1) * sb ** 2) / (na + nb - 2)) AS cohens_d, own FROM s", "records", "cohens_d own", 5)
def _(v: Views) -> DataFrame:
    df = conditioned(v)
    d = I.welch(X.split_stats(df, {"surprise_positive": F.col("surprise") > 0}, "r", medians=False)).select("condition", "cohens_d")
    own = I.one_sample(M.series_metrics(df.withColumn("strategy", F.lit("all")), ["strategy"])).select(F.col("d").alias("own"))
    return d.crossJoin(F.broadcast(own))  # one row each


def powered(tests: str) -> str:
    """SQL of the power of tests(n, d, ...), the critical value found once a sample size."""
    return f"pw_t AS ({tests}), pw_c AS (SELECT n, {t_critical('n - 1e0')} AS c FROM (SELECT DISTINCT n FROM pw_t WHERE n > 1)), pw AS (SELECT pw_t.*, {t_power('d', 'n', 'c')} AS power FROM pw_t JOIN pw_c USING (n))"


@query("i9_power", f"WITH {powered('SELECT strategy, count(r) AS n, avg(r) / stddev_samp(r) AS d FROM trades GROUP BY 1')} SELECT strategy, n, d, power FROM pw", "trades", "d power")
def _(v: Views) -> DataFrame:
    """Power of a one-sample test of each strategy, against Simpson's rule on the noncentral density."""
    t = I.one_sample(M.series_metrics(v.trades, ["strategy"]))
    return I.gates(I.quick_adjust(t, 10)).select("strategy", "n", "d", "power")


@query("i9_power_of_parts", f"WITH {powered('SELECT part, count(r) AS n, avg(r) / stddev_samp(r) AS d FROM trades GROUP BY 1 HAVING count(r) > 1 AND stddev_samp(r) > 0')} SELECT part, n, d, power FROM pw", "trades", "d power")
def _(v: Views) -> DataFrame:
    """The same for the few trades of each part, where it lies anywhere between the level and one."""
    t = v.trades.groupBy("part").agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s")).filter("n > 1 AND s > 0").withColumn("d", F.col("m") / F.col("s"))
    return t.select("part", "n", "d", dist.t_power(F.col("d"), F.col("n")).alias("power"))


@query("l1_classifiers")
def _(v: Views) -> DataFrame:
    """Mean area under the curve of the four classifiers over the walk-forward folds (MLlib fits, no SQL)."""
    from tidemark.plans.q_models import fold_metrics

    return fold_metrics(v).groupBy("model").agg(F.count("*").alias("n_folds"), F.avg("auc").alias("auc"))


@query("l5_standard_scaling", "SELECT trade_id, (qty - avg(qty) OVER ()) / stddev_samp(qty) OVER () AS qty, (price - avg(price) OVER ()) / stddev_samp(price) OVER () AS price FROM trades", "trades", "qty price", 5)
def _(v: Views) -> DataFrame:
    return L.scaled(v.trades.select("trade_id", "qty", "price"), ["qty", "price"])


@query("u1_normal_tails", f"WITH m AS (SELECT strategy, avg(r) / stddev_samp(r) AS z FROM trades GROUP BY 1), s AS (SELECT strategy, z, i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM m, range(0, 2001) g(i)) SELECT strategy, z, 1 - 2 * sum(w * exp(-((z * i / 2000) ** 2) / 2)) * abs(z) / 6000 / sqrt(2 * pi()) AS p FROM s GROUP BY 1, 2", "trades", "z p")
def _(v: Views) -> DataFrame:
    """Two-sided tails of the normal distribution, against Simpson's rule."""
    from tidemark.functions.dist import normal_two_sided

    z = M.series_metrics(v.trades, ["strategy"]).select("strategy", (F.col("mean") / F.col("std")).alias("z"))
    return z.withColumn("p", normal_two_sided(F.col("z")))


@query("u2_bootstrap_sums", "SELECT strategy, count(r) AS n, 1000 AS n_replicates, true AS near FROM trades GROUP BY 1", "trades")
def _(v: Views) -> DataFrame:
    """Replicates of each strategy; their mean weight lies within five standard errors of one a trade."""
    s = I.bootstrap_sums(v.trades).groupBy("strategy").agg(F.count("*").cast("int").alias("n_replicates"), F.avg("w").alias("w"))
    n = v.trades.groupBy("strategy").agg(F.count("r").alias("n"))
    return n.join(s, "strategy").select("strategy", "n", "n_replicates", (F.abs(F.col("w") - F.col("n")) <= 5 * F.sqrt(F.col("n") / F.col("n_replicates"))).alias("near"))

