"""Feature columns, targets and profiles of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import features as E, profile as A, targets as T
from tidemark.plans.registry import ORACLES, ROUNDED, Views, query
from tidemark.plans.views import records_of


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


_flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"


@query("e1_premarket", """SELECT record_id, (premarket_high - premarket_low) / reference_prev_close AS premarket_range, ((premarket_high + premarket_low) / 2 - reference_prev_close) / reference_prev_close AS premarket_gap,
 (open_price - reference_prev_close) / reference_prev_close AS open_gap, ln(1 + premarket_volume) AS premarket_volume_normalized FROM records""", "records", "premarket_range premarket_gap open_gap premarket_volume_normalized", 6)
def _(v: Views) -> DataFrame:
    return E.premarket(v.records).select("record_id", "premarket_range", "premarket_gap", "open_gap", "premarket_volume_normalized")


@query("e3_volume", f"""WITH x AS (SELECT *, CASE WHEN volume_30_day_avg > 0 THEN opening_minute_volume / volume_30_day_avg ELSE 1e0 END AS r30, CASE WHEN volume_7_day_avg > 0 THEN opening_minute_volume / volume_7_day_avg ELSE 1e0 END AS r7 FROM records)
SELECT record_id, ln(1 + opening_minute_volume) AS opening_volume_log, r30 AS volume_ratio_30_day, r7 AS volume_ratio_7_day, {_flag('r30 > 2')} AS volume_spike_30d, {_flag('r7 > 1.5')} AS volume_spike_7d FROM x""", "records", "opening_volume_log volume_ratio_30_day volume_ratio_7_day", 5)
def _(v: Views) -> DataFrame:
    return E.volume(v.records).select("record_id", "opening_volume_log", "volume_ratio_30_day", "volume_ratio_7_day", "volume_spike_30d", "volume_spike_7d")


_I = "[pct_1min, pct_5min, pct_15min, pct_30min, pct_1hr]"


@query("e4_intraday", f"""WITH x AS (SELECT *, list_filter({_I}, lambda z: z IS NOT NULL) AS a FROM records)
SELECT record_id, CASE WHEN len(a) >= 2 THEN list_stddev_samp(a) END AS intraday_vol, list_max(a) - list_min(a) AS intraday_range, pct_5min / (abs(pct_1min) + 0.001) AS early_momentum, (pct_30min - pct_5min) / (abs(pct_5min) + 0.001) AS momentum_acceleration,
 coalesce(len(list_filter(a, lambda z: z > 0)) / nullif(len(a), 0), 0.5) AS direction_consistency FROM x""", "records", "intraday_vol intraday_range early_momentum momentum_acceleration direction_consistency", 5)
def _(v: Views) -> DataFrame:
    return E.intraday(v.records).select("record_id", "intraday_vol", "intraday_range", "early_momentum", "momentum_acceleration", "direction_consistency")


@query("e5_vol_regime", f"""WITH x AS (SELECT record_id, symbol, report_date, pct_1hr AS vol FROM records), w AS (SELECT record_id, vol, count(vol) OVER w AS n, quantile_cont(vol, 0.75) OVER w AS q FROM x WINDOW w AS (PARTITION BY symbol ORDER BY report_date, record_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))
SELECT record_id, {_flag('n = 8 AND vol > q')} AS high_vol_regime FROM w""", "records")
def _(v: Views) -> DataFrame:
    return E.vol_regime(v.series("pct_1hr").withColumnRenamed("pct_1hr", "intraday_vol"), 8).select("record_id", "high_vol_regime")


@query("e6_surprise", f"""WITH q AS (SELECT quantile_cont(surprise, 0.2) AS a, quantile_cont(surprise, 0.8) AS b FROM records)
SELECT record_id, {_flag('surprise > b')} AS surprise_large_positive, {_flag('surprise < a')} AS surprise_large_negative, CASE WHEN abs(surprise) > 0 THEN CASE WHEN abs(surprise) <= 2 THEN 'small' WHEN abs(surprise) <= 5 THEN 'medium' WHEN abs(surprise) <= 10 THEN 'large' ELSE 'huge' END END AS surprise_magnitude,
 (surprise + revenue_surprise) / 2 AS combined_surprise, {_flag('surprise * revenue_surprise < 0')} AS surprise_mismatch FROM records, q""", "records", "combined_surprise", 5)
def _(v: Views) -> DataFrame:
    return E.surprise(v.records).select("record_id", "surprise_large_positive", "surprise_large_negative", "surprise_magnitude", "combined_surprise", "surprise_mismatch")


@query("e7_timing", f"""SELECT record_id, {_flag('earnings_time = 0')} AS earnings_bmo, {_flag('earnings_time = 1')} AS earnings_amc, CAST(month(report_date) AS INT) AS month, CAST(quarter(report_date) AS INT) AS quarter, CAST(isodow(report_date) - 1 AS INT) AS day_of_week, {_flag('isodow(report_date) = 1')} AS is_monday, {_flag('isodow(report_date) = 5')} AS is_friday,
 {_flag('month(report_date) IN (1, 4, 7, 10)')} AS earnings_season, {_flag('report_date = last_day(report_date)')} AS is_month_end, {_flag('report_date = last_day(report_date) AND month(report_date) IN (3, 6, 9, 12)')} AS is_quarter_end FROM records""", "records")
def _(v: Views) -> DataFrame:
    return E.timing(v.records).select("record_id", "earnings_bmo", "earnings_amc", "month", "quarter", "day_of_week", "is_monday", "is_friday", "earnings_season", "is_month_end", "is_quarter_end")


@query("e8_price_action", f"""WITH x AS (SELECT *, (open_price - reference_prev_close) / reference_prev_close AS g FROM records)
SELECT record_id, high_price / low_price AS high_low_ratio, (close_price - low_price) / nullif(high_price - low_price, 0) AS close_position, {_flag('g > 0.005')} AS gap_up, {_flag('g < -0.005')} AS gap_down, abs(g) AS gap_magnitude, coalesce(high_before_low, 0) AS high_before_low_flag FROM x""", "records", "high_low_ratio close_position gap_magnitude", 5)
def _(v: Views) -> DataFrame:
    return E.price_action(E.premarket(v.records)).select("record_id", "high_low_ratio", "close_position", "gap_up", "gap_down", "gap_magnitude", "high_before_low_flag")


@query("e9_sector_relative", """WITH x AS (SELECT record_id, sector, revenue_surprise AS s FROM records), k AS (SELECT record_id, sector, s, CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY sector, s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY sector, s) - 1) / 2e0) / count(s) OVER (PARTITION BY sector) END AS r, avg(s) OVER (PARTITION BY sector) AS m, stddev_samp(s) OVER (PARTITION BY sector) AS d FROM x)
SELECT record_id, r AS revenue_surprise_sector_rank, (s - m) / (d + 1e-6) AS revenue_surprise_sector_zscore FROM k""", "records", "revenue_surprise_sector_rank revenue_surprise_sector_zscore")
def _(v: Views) -> DataFrame:
    return E.relative(v.records, ["revenue_surprise"]).select("record_id", "revenue_surprise_sector_rank", "revenue_surprise_sector_zscore")


@query("e11_interactions", """WITH x AS (SELECT *, CASE WHEN volume_7_day_avg > 0 THEN opening_minute_volume / volume_7_day_avg ELSE 1e0 END AS r7, ln(1 + coalesce(market_cap, 0)) AS c, (open_price - reference_prev_close) / reference_prev_close AS g, ln(1 + premarket_volume) AS pv, ((premarket_high + premarket_low) / 2 - reference_prev_close) / reference_prev_close AS pg FROM records)
SELECT record_id, surprise * r7 AS surprise_x_volume_ratio_7d, surprise * pv AS surprise_x_premarket_vol, surprise * c AS surprise_x_market_cap, surprise * g AS surprise_x_gap, r7 * abs(g) AS volume_x_gap, r7 * c AS volume_x_market_cap, pg * pv AS premarket_gap_x_volume FROM x""", "records", "surprise_x_volume_ratio_7d surprise_x_premarket_vol surprise_x_market_cap surprise_x_gap volume_x_gap volume_x_market_cap premarket_gap_x_volume", 4)
def _(v: Views) -> DataFrame:
    return E.interactions(E.price_action(E.timing(E.volume(E.market_cap(E.premarket(v.records)))))).select("record_id", "surprise_x_volume_ratio_7d", "surprise_x_premarket_vol", "surprise_x_market_cap", "surprise_x_gap", "volume_x_gap", "volume_x_market_cap", "premarket_gap_x_volume")


@query("e12_day_regimes", f"""WITH x AS (SELECT record_id, abs(pct_1hr) AS rg, avg(pct_change_close) OVER (PARTITION BY report_date) AS m FROM records), q AS (SELECT quantile_cont(rg, 0.7) AS v, quantile_cont(m, 0.4) AS lo, quantile_cont(m, 0.6) AS hi FROM x)
SELECT record_id, {_flag('rg > v')} AS high_vol_day, m AS market_return, {_flag('m > hi + 1e-9')} AS bull_regime, {_flag('m < lo - 1e-9')} AS bear_regime FROM x, q""", "records", "market_return")
def _(v: Views) -> DataFrame:
    return E.day_regimes(v.records.withColumn("intraday_range", F.abs("pct_1hr"))).select("record_id", "high_vol_day", "market_return", "bull_regime", "bear_regime")


@query("e13_one_hot", f"""SELECT record_id, {", ".join(f"{_flag(f"sector = '{s}'")} AS sector_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}, {", ".join(f"{_flag(f"industry = 'IND{i}'")} AS industry_IND{i}" for i in range(1, 6))}, {_flag("data_source = 'Alpaca'")} AS data_source_Alpaca, {_flag("data_source = 'Finnhub'")} AS data_source_Finnhub FROM records""", "records")
def _(v: Views) -> DataFrame:
    r = E.one_hot(v.records)
    return r.select("record_id", *sorted(c for c in r.columns if c.startswith(("sector_", "industry_", "data_source_"))))


@query("e14_lags", """SELECT record_id, lag(surprise) OVER w AS surprise_lag1, avg(surprise) OVER (PARTITION BY symbol ORDER BY report_date, record_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS surprise_rolling_mean, stddev_samp(surprise) OVER (PARTITION BY symbol ORDER BY report_date, record_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS surprise_rolling_std
FROM records WINDOW w AS (PARTITION BY symbol ORDER BY report_date, record_id)""", "records", "surprise_lag1 surprise_rolling_mean surprise_rolling_std", 6)
def _(v: Views) -> DataFrame:
    return E.lags(v.series("surprise"), ["surprise"]).select("record_id", "surprise_lag1", "surprise_rolling_mean", "surprise_rolling_std")


@query("e15_price_returns", """SELECT record_id, (close_price - open_price) / open_price AS return_open_close, (high_price - open_price) / open_price AS return_open_high, (low_price - open_price) / open_price AS return_open_low, (high_price - low_price) / open_price AS daily_range, (open_price - reference_prev_close) / reference_prev_close AS gap_pct, opening_minute_volume / volume_30_day_avg AS volume_ratio FROM records""", "records", "return_open_close return_open_high return_open_low daily_range gap_pct volume_ratio", 5)
def _(v: Views) -> DataFrame:
    return E.price_returns(v.records).select("record_id", "return_open_close", "return_open_high", "return_open_low", "daily_range", "gap_pct", "volume_ratio")


@query("e19_moving_averages", """WITH x AS (SELECT record_id, symbol, report_date, close_price AS p FROM records)
SELECT record_id, CASE WHEN count(p) OVER a >= 2 THEN avg(p) OVER a END AS sma_5, CASE WHEN count(p) OVER b >= 5 THEN avg(p) OVER b END AS sma_10, p / CASE WHEN count(p) OVER a >= 2 THEN avg(p) OVER a END - 1 AS price_vs_sma_5 FROM x
WINDOW a AS (PARTITION BY symbol ORDER BY report_date, record_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY report_date, record_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "records", "sma_5 sma_10 price_vs_sma_5", 5)
def _(v: Views) -> DataFrame:
    return E.moving_averages(v.series("close_price"), frames=(5, 10)).select("record_id", "sma_5", "sma_10", "price_vs_sma_5")


@query("e20_rsi", """WITH x AS (SELECT record_id, symbol, report_date, coalesce(close_price, 0) - lag(coalesce(close_price, 0)) OVER (PARTITION BY symbol ORDER BY report_date, record_id) AS d FROM records),
g AS (SELECT record_id, count(d) OVER w AS n, avg(CASE WHEN d IS NOT NULL THEN greatest(d, 0) END) OVER w AS up, avg(CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END) OVER w AS dn FROM x WINDOW w AS (PARTITION BY symbol ORDER BY report_date, record_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT record_id, CASE WHEN n = 5 THEN CASE WHEN dn = 0 THEN 100e0 ELSE 100 - 100 / (1 + up / dn) END END AS rsi_5 FROM g""", "records", "rsi_5", 4)
def _(v: Views) -> DataFrame:
    return E.rsi(v.series("close_price").withColumn("close_price", F.coalesce("close_price", F.lit(0.0))), n=5).select("record_id", "rsi_5")


@query("e21_label_codes", "SELECT record_id, CAST(dense_rank() OVER (ORDER BY sector) - 1 AS INT) AS sector_code FROM records", "records")
def _(v: Views) -> DataFrame:
    return E.label_codes(v.records).select("record_id", "sector_code")


@query("e0_all_features")
def _(v: Views) -> DataFrame:
    return E.engineer(v.entries, make=records_of)


#: Queries of single groups whose columns the whole table has with the same parameters.
_GROUPS = ["e1_premarket", "e2_market_cap", "e3_volume", "e4_intraday", "e6_surprise", "e7_timing", "e8_price_action", "e11_interactions", "e13_one_hot", "e14_lags"]


@query("e0_joined_features", lambda: "SELECT * FROM " + " JOIN ".join(f"({ORACLES[g]}) g{i}" + (" USING (record_id)" if i else "") for i, g in enumerate(_GROUPS)))
def _(v: Views) -> DataFrame:
    """The columns of these groups as engineered in one go, against the groups' own SQL joined by record."""
    df = E.engineer(v.entries, make=records_of)
    rounded = {c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for g in _GROUPS for c in ROUNDED[g][0] for digits in [ROUNDED[g][1]]}
    one_hot = [c for c in df.columns if c.startswith(("sector_", "industry_", "data_source_"))]
    columns = ["premarket_range", "premarket_gap", "open_gap", "premarket_volume_normalized", "market_cap_log", "market_cap_billions", "market_cap_bucket", "opening_volume_log", "volume_ratio_30_day", "volume_ratio_7_day", "volume_spike_30d", "volume_spike_7d", "intraday_vol", "intraday_range", "early_momentum", "momentum_acceleration", "direction_consistency", "surprise_large_positive", "surprise_large_negative", "surprise_magnitude", "combined_surprise", "surprise_mismatch", "earnings_bmo", "earnings_amc", "month", "quarter", "day_of_week", "is_monday", "is_friday", "earnings_season", "is_month_end", "is_quarter_end", "high_low_ratio", "close_position", "gap_up", "gap_down", "gap_magnitude", "high_before_low_flag", "surprise_x_volume_ratio_7d", "surprise_x_premarket_vol", "surprise_x_market_cap", "surprise_x_gap", "volume_x_gap", "volume_x_market_cap", "premarket_gap_x_volume", "surprise_lag1", "surprise_rolling_mean", "surprise_rolling_std"]
    return df.withColumns({c: x for c, x in rounded.items() if c in columns}).select("record_id", *columns, *one_hot)


_R = "(close_price - open_price) / open_price"


@query("t1_returns", f"SELECT record_id, {_R} AS next_session_return, pct_change_close / 100 AS full_day_return, pct_1min / 100 AS intraday_return_1min, pct_1hr / 100 AS intraday_return_1hr FROM records WHERE {_R} IS NOT NULL", "records", "next_session_return full_day_return intraday_return_1min intraday_return_1hr", 5)
def _(v: Views) -> DataFrame:
    return T.create(E.intraday(v.records)).select("record_id", "next_session_return", "full_day_return", "intraday_return_1min", "intraday_return_1hr")


@query("t2_binary_targets", f"SELECT record_id, {', '.join(f'{_flag(f"r > {p / 100}")} AS target_{p}pct_up, {_flag(f"r < -{p / 100}")} AS target_{p}pct_down' for p in (1, 2, 3, 5))}, {_flag('pct_1hr / 100 > 0.02')} AS target_intraday_2pct_up, {_flag('r > 0')} AS target_up, {_flag('r < 0')} AS target_down FROM (SELECT *, {_R} AS r FROM records) q WHERE r IS NOT NULL", "records")
def _(v: Views) -> DataFrame:
    return T.create(E.intraday(v.records)).select("record_id", *(f"target_{p}pct_{s}" for p in (1, 2, 3, 5) for s in ("up", "down")), "target_intraday_2pct_up", "target_up", "target_down")


@query("t3_return_category", f"SELECT record_id, CASE WHEN r <= -0.05 THEN 'large_down' WHEN r <= -0.02 THEN 'med_down' WHEN r <= -0.005 THEN 'small_down' WHEN r <= 0.005 THEN 'flat' WHEN r <= 0.02 THEN 'small_up' WHEN r <= 0.05 THEN 'med_up' ELSE 'large_up' END AS return_category FROM (SELECT record_id, {_R} AS r FROM records) q WHERE r IS NOT NULL", "records")
def _(v: Views) -> DataFrame:
    return T.create(E.intraday(v.records)).select("record_id", "return_category")


@query("t4_risk_adjusted", f"WITH x AS (SELECT record_id, {_R} / (list_stddev_samp(list_filter({_I}, lambda z: z IS NOT NULL)) + 0.001) AS a FROM records WHERE {_R} IS NOT NULL) SELECT record_id, a AS risk_adjusted_return, {_flag('a > 0')} AS target_risk_adj_positive FROM x", "records", "risk_adjusted_return", 5)
def _(v: Views) -> DataFrame:
    return T.create(E.intraday(v.records)).select("record_id", "risk_adjusted_return", "target_risk_adj_positive")


@query("t5_target_balance", f"WITH x AS (SELECT {_R} AS r FROM records WHERE {_R} IS NOT NULL) SELECT count(*) AS n, avg({_flag('r > 0.02')}) AS positive_rate, avg(r) AS mean, stddev_samp(r) AS std, quantile_cont(r, 0.05) AS p05, quantile_cont(r, 0.95) AS p95, avg({_flag('r > 0.02')}) < 0.05 OR avg({_flag('r > 0.02')}) > 0.95 AS extreme FROM x", "records", "positive_rate mean std p05 p95")
def _(v: Views) -> DataFrame:
    return T.balance(T.create(E.intraday(v.records)))


_C = ["surprise", "revenue_surprise", "market_cap", "volume_ratio_7_day", "pct_1min"]


@query("a1_describe", _union([f"SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM records" for c in _C]), "records", "mean std min p25 p50 p75 max", 5)
def _(v: Views) -> DataFrame:
    return A.describe(v.records, _C)


@query("a2_correlations", _union([f"SELECT '{c}' AS feature, '{t}' AS target, count(*) FILTER (WHERE {c} IS NOT NULL AND {t} IS NOT NULL) AS n, corr({c}, {t}) AS corr FROM records" for c in _C for t in ("pct_change_close", "pct_1hr")]), "records", "corr")
def _(v: Views) -> DataFrame:
    return A.correlations(v.records, _C, ["pct_change_close", "pct_1hr"])


@query("a3_leakage", _union([f"SELECT '{c}' AS feature, corr({c}, pct_change_close) AS corr, abs(corr({c}, pct_change_close)) > 0.9 OR (abs(corr({c}, pct_change_close)) > 0.7 AND regexp_matches('{c}', 'return|target|pct_change|close|high_price|low_price')) AS leak FROM records" for c in ("surprise", "pct_change_open", "close_price", "pct_change_low")]), "records", "corr")
def _(v: Views) -> DataFrame:
    return A.leakage(A.correlations(v.records, ["surprise", "pct_change_open", "close_price", "pct_change_low"], ["pct_change_close"])).select("feature", "corr", "leak")


@query("a4_distributions", _union([f"SELECT '{c}' AS \"column\", count({c}) AS n, 1 - count({c}) / CAST(count(*) AS DOUBLE) AS missing, skewness({c}) AS skew_sample, kurtosis({c}) AS kurtosis_sample, kurtosis_pop({c}) AS kurtosis_pop, count(*) FILTER (WHERE {c} = 0) / CAST(count(*) AS DOUBLE) AS zero_rate, count(DISTINCT {c}) / CAST(count(*) AS DOUBLE) AS unique_rate FROM records" for c in _C]), "records", "missing skew_sample kurtosis_sample kurtosis_pop zero_rate unique_rate", 5)
def _(v: Views) -> DataFrame:
    return A.distributions(v.records, _C).drop("skew_pop")


@query("a5_monthly", "SELECT strftime(report_date, '%Y-%m') AS month, count(surprise) AS n, avg(surprise) AS mean, stddev_samp(surprise) AS std FROM records GROUP BY 1", "records", "mean std", 4)
def _(v: Views) -> DataFrame:
    return A.monthly(v.records, "surprise", digits=9)


@query("a6_stability", "WITH m AS (SELECT strftime(report_date, '%Y-%m') AS month, avg(CASE WHEN surprise > 0 THEN 1e0 ELSE 0e0 END) AS mean FROM records GROUP BY 1) SELECT count(*) AS n_months, stddev_samp(mean) / abs(avg(mean)) AS cv, stddev_samp(mean) / abs(avg(mean)) > 0.5 AS unstable FROM m", "records", "cv", 5)
def _(v: Views) -> DataFrame:
    return A.stability(A.monthly(v.records.withColumn("up", F.when(F.col("surprise") > 0, 1.0).otherwise(0.0)), "up", digits=12))


@query("a7_sectors", "SELECT sector, count(surprise) AS n, avg(surprise) AS mean FROM records GROUP BY 1", "records", "mean")
def _(v: Views) -> DataFrame:
    return A.by_group(v.records, "sector", "surprise")


@query("a17_value_counts", "SELECT industry, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, industry LIMIT 3", "records")
def _(v: Views) -> DataFrame:
    return A.value_counts(v.records, "industry", 3)


@query("a18_unique_counts", _union([f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_unique FROM records" for c in ("sector", "symbol", "data_source", "report_date")]), "records")
def _(v: Views) -> DataFrame:
    return A.unique_counts(v.records, ["sector", "symbol", "data_source", "report_date"])


@query("a19_daily_mean", "SELECT report_date, avg(pct_change_close) AS mean, count(pct_change_close) AS n FROM records GROUP BY 1", "records", "mean")
def _(v: Views) -> DataFrame:
    from tidemark.operators.metrics import daily_mean

    return daily_mean(v.records, "pct_change_close")


@query("a21_seasonality", "WITH c AS (SELECT CAST(month(report_date) AS INT) AS period, count(*) AS n FROM records GROUP BY 1) SELECT period, n, n / sum(n) OVER () AS share, n / avg(n) OVER () AS bias, n = max(n) OVER () AS peak FROM c", "records", "share bias")
def _(v: Views) -> DataFrame:
    return A.seasonality(v.records)


@query("a22_daily_candidates", "WITH c AS (SELECT day, count(*) AS n FROM calendar GROUP BY 1) SELECT count(*) AS n_days, avg(n) AS mean_n, max(n) AS max_n, count(*) FILTER (WHERE n >= 7) / CAST(count(*) AS DOUBLE) AS qualifying_rate FROM c", "calendar", "mean_n qualifying_rate")
def _(v: Views) -> DataFrame:
    return A.daily_candidates(v.calendar, "day", 7)


@query("c19_qualifying_days", "SELECT day, count(*) AS n FROM calendar GROUP BY 1 HAVING count(*) >= 7", "calendar")
def _(v: Views) -> DataFrame:
    return A.qualifying_days(v.calendar, "day", 7)
