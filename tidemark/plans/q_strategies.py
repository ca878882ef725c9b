"""Strategies: metrics, thresholds, combinations, folds, robustness, regimes, costs and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.operators import combos as C, conditions as X, costs as K, features as E, folds as D, metrics as M, regimes as G, robustness as R, sizing as Z, thresholds as H
from tidemark.plans.prefix import quantile_values, row_numbers
from tidemark.plans.registry import Views, query, t_tail

YEAR = "15.874507866387544e0"  # the root of 252


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


METRICS = f"""SELECT strategy, count(r) AS n, sum(r) AS total, avg(r) AS mean, stddev_samp(r) AS std, avg(r) * 21 AS monthly, coalesce(avg(r) / nullif(stddev_samp(r), 0) * {YEAR}, 0) AS sharpe, coalesce(avg(r) / nullif(stddev_samp(r) FILTER (WHERE r < 0), 0) * {YEAR}, 0) AS sortino,
 count(*) FILTER (WHERE r > 0) / CAST(count(r) AS DOUBLE) AS win_rate, sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(sum(CASE WHEN r < 0 THEN -r ELSE 0 END), 0) AS profit_factor FROM trades GROUP BY 1"""
_M = "total mean std monthly sharpe sortino win_rate profit_factor"


@query("a9_series_metrics", METRICS, "trades", _M)
def _(v: Views) -> DataFrame:
    return M.series_metrics(v.trades, ["strategy"])


@query("a10_annual_metrics", f"SELECT strategy, sector, avg(r) * 252 AS annual_return, stddev_samp(r) * {YEAR} AS annual_vol, avg(r) / stddev_samp(r) * {YEAR} AS sharpe, count(*) FILTER (WHERE r > 0) / CAST(count(*) AS DOUBLE) AS win_rate, sum(CASE WHEN r > 0 THEN r ELSE 0 END) / sum(CASE WHEN r < 0 THEN -r ELSE 0 END) AS profit_factor, count(*) AS n FROM trades GROUP BY 1, 2", "trades", "annual_return annual_vol sharpe win_rate profit_factor", 5)
def _(v: Views) -> DataFrame:
    return M.annual_metrics(v.trades, ["strategy", "sector"])


#: A small return a trade, so that products over sixty thousand trades stay in range.
_SMALL = "WITH t AS (SELECT strategy, d, trade_id, r / 100 AS r FROM trades)"


def small(v: Views) -> DataFrame:
    return v.trades.withColumn("r", F.col("r") / 100)


DRAWDOWN = _SMALL + """, w AS (SELECT strategy, sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY d, trade_id ROWS UNBOUNDED PRECEDING) AS g, d, trade_id FROM t), p AS (SELECT strategy, g, max(g) OVER (PARTITION BY strategy ORDER BY d, trade_id ROWS UNBOUNDED PRECEDING) AS p, row_number() OVER (PARTITION BY strategy ORDER BY d DESC, trade_id DESC) AS k FROM w)
SELECT strategy, exp(max(g) FILTER (WHERE k = 1)) AS growth, min(exp(g - p) - 1) AS mdd FROM p GROUP BY 1"""


@query("a11_max_drawdown", DRAWDOWN, "trades", "growth mdd")
def _(v: Views) -> DataFrame:
    return M.max_drawdown(small(v), ["strategy"])


_DAILY = "WITH t AS (SELECT strategy, d, avg(r) AS r FROM trades GROUP BY 1, 2)"


def daily(v: Views) -> DataFrame:
    return v.trades.groupBy("strategy", "d").agg(F.avg("r").alias("r"))


@query("a11_drawdown_span", _DAILY + """, w AS (SELECT strategy, d, sum(ln(1 + r)) OVER o AS g, row_number() OVER o AS i FROM t WINDOW o AS (PARTITION BY strategy ORDER BY d)), p AS (SELECT *, max(g) OVER (PARTITION BY strategy ORDER BY d) AS p FROM w), e AS (SELECT *, round(exp(g - p) - 1, 12) AS dd FROM p),
q AS (SELECT *, max(CASE WHEN dd = 0 THEN i END) OVER (PARTITION BY strategy ORDER BY d) AS pi, row_number() OVER (PARTITION BY strategy ORDER BY dd, i) AS k FROM e)
SELECT x.strategy, x.dd AS mdd, q.d AS peak_day, x.d AS trough_day, CAST(x.i - x.pi AS INT) AS length FROM q x JOIN q ON x.k = 1 AND q.strategy = x.strategy AND q.i = x.pi""", "trades", "mdd")
def _(v: Views) -> DataFrame:
    return M.drawdown_span(daily(v), "strategy")


@query("a12_demeaned_drawdown", _DAILY + ", m AS (SELECT strategy, d, r - avg(r) OVER (PARTITION BY strategy) AS x FROM t), w AS (SELECT strategy, sum(x) OVER (PARTITION BY strategy ORDER BY d) AS s FROM m) SELECT strategy, min(s) AS demeaned_drawdown FROM w GROUP BY 1", "trades", "demeaned_drawdown")
def _(v: Views) -> DataFrame:
    return M.demeaned_drawdown(daily(v), "strategy")


@query("a13_value_at_risk", "WITH q AS (SELECT strategy, quantile_cont(r, 0.05) AS v FROM trades GROUP BY 1) SELECT strategy, v AS var, avg(r) AS cvar FROM trades JOIN q USING (strategy) WHERE r <= v GROUP BY 1, 2", "trades", "var cvar")
def _(v: Views) -> DataFrame:
    return M.value_at_risk(v.trades, ["strategy"])


@query("a14_shape", "SELECT strategy, (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * avg(r) ** 3) / stddev_pop(r) ** 3 AS skew, kurtosis_pop(r) AS excess_kurtosis FROM trades GROUP BY 1", "trades", "skew excess_kurtosis", 5)
def _(v: Views) -> DataFrame:
    return M.shape(v.trades, ["strategy"])


@query("a15_downside", "SELECT strategy, stddev_pop(r) FILTER (WHERE r < 0) AS downside_deviation, avg(r) FILTER (WHERE r < 0) AS avg_loss FROM trades GROUP BY 1", "trades", "downside_deviation avg_loss")
def _(v: Views) -> DataFrame:
    return M.downside(v.trades, ["strategy"])


@query("a16_half_stability", """WITH m AS (SELECT strategy, CAST(floor((max(d) - min(d)) / 2) AS INT) AS h, min(d) AS f FROM trades GROUP BY 1), x AS (SELECT strategy, avg(r) FILTER (WHERE d - f <= h) AS first_mean, avg(r) FILTER (WHERE d - f > h) AS second_mean FROM trades JOIN m USING (strategy) GROUP BY 1)
SELECT strategy, first_mean, second_mean, CASE WHEN first_mean * second_mean > 0 THEN least(abs(first_mean), abs(second_mean)) / greatest(abs(first_mean), abs(second_mean)) ELSE 0 END AS stability FROM x""", "trades", "first_mean second_mean stability", 5)
def _(v: Views) -> DataFrame:
    return M.half_stability(v.trades, "strategy")


@query("a20_portfolio", f"WITH m AS ({METRICS}), t AS (SELECT *, substr(strategy, 1, 1) AS features FROM m ORDER BY sharpe DESC, strategy LIMIT 4) SELECT count(*) AS n, avg(sharpe) AS avg_sharpe, sum(mean * 252) AS total_return, avg(win_rate) AS avg_win_rate, count(DISTINCT features) / CAST(count(*) AS DOUBLE) AS distinct_share FROM t", "trades", "avg_sharpe total_return avg_win_rate distinct_share", 5)
def _(v: Views) -> DataFrame:
    m = M.series_metrics(v.trades, ["strategy"]).withColumns({"annual_return": F.col("mean") * 252, "features": F.substring("strategy", 1, 1)})
    return M.portfolio(m, 4)


@query("a23_default_metrics", "WITH s AS (SELECT DISTINCT strategy FROM trades UNION ALL SELECT 'none'), m AS (SELECT strategy, count(*) AS n, avg(r) AS mean, sum(CASE WHEN r > 0 THEN r ELSE 0 END) / sum(CASE WHEN r < 0 THEN -r ELSE 0 END) AS profit_factor FROM trades GROUP BY 1) SELECT strategy, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, CASE WHEN n IS NULL THEN 1 ELSE profit_factor END AS profit_factor FROM s LEFT JOIN m USING (strategy)", "trades", "mean profit_factor")
def _(v: Views) -> DataFrame:
    names = v.trades.select("strategy").distinct().unionByName(v.spark.createDataFrame([("none",)], "strategy string"))
    return M.with_defaults(M.series_metrics(v.trades, ["strategy"]), names).select("strategy", "n", "mean", "profit_factor")


# conditions

FEATURES_SQL = """f AS (SELECT record_id, symbol, sector, report_date, surprise, premarket_volume, market_cap, earnings_time, CASE WHEN volume_7_day_avg > 0 THEN opening_minute_volume / volume_7_day_avg ELSE 1e0 END AS v7, CASE WHEN volume_30_day_avg > 0 THEN opening_minute_volume / volume_30_day_avg ELSE 1e0 END AS v30,
 (open_price - reference_prev_close) / reference_prev_close AS gap, (premarket_high - premarket_low) / reference_prev_close AS prange, (close_price - open_price) / open_price AS r FROM records),
q AS (SELECT quantile_cont(surprise, [0.1, 0.2, 0.8, 0.9]) AS s, quantile_cont(abs(surprise), 0.8) AS a, quantile_cont(premarket_volume, [0.8, 0.9]) AS pv, quantile_cont(prange, 0.8) AS pr, quantile_cont(market_cap, [0.2, 0.8]) AS mc FROM f),
top5 AS (SELECT sector AS top_sector FROM f GROUP BY sector ORDER BY count(*) DESC, sector LIMIT 5)"""
CONDITIONS = {"surprise_very_high": "surprise > s[4]", "surprise_high": "surprise > s[3]", "surprise_positive": "surprise > 0", "surprise_negative": "surprise < 0", "surprise_low": "surprise < s[2]", "surprise_very_low": "surprise < s[1]", "surprise_large_magnitude": "abs(surprise) > a", "volume_spike_high": "v7 > 2", "volume_spike_medium": "v7 > 1.5", "volume_normal": "v7 BETWEEN 0.8 AND 1.2", "volume_low": "v7 < 0.5", "volume_30d_spike": "v30 > 1.5", "volume_30d_low": "v30 < 0.8", "gap_up_small": "gap > 0.005", "gap_up_medium": "gap > 0.01", "gap_up_large": "gap > 0.02", "gap_down_small": "gap < -0.005", "gap_down_medium": "gap < -0.01", "gap_down_large": "gap < -0.02", "premarket_vol_high": "premarket_volume > pv[1]", "premarket_vol_very_high": "premarket_volume > pv[2]", "premarket_volatile": "prange > pr", "earnings_bmo": "earnings_time = 0", "earnings_amc": "earnings_time = 1", "large_cap": "market_cap > mc[2]", "small_cap": "market_cap < mc[1]", "surprise_pos_volume_high": "surprise > 0 AND v7 > 1.5", "surprise_neg_volume_high": "surprise < 0 AND v7 > 1.5"}
LONG = f"WITH {FEATURES_SQL}, long AS (" + _union([f"SELECT '{n}' AS condition, coalesce({c}, false) AS flag, r FROM f, q WHERE r IS NOT NULL" for n, c in CONDITIONS.items()] + ["SELECT 'sector_' || top_sector AS condition, coalesce(sector = top_sector, false) AS flag, r FROM f, top5 WHERE r IS NOT NULL"]) + ")"


def conditioned(v: Views) -> DataFrame:
    r = E.price_returns(E.volume(E.premarket(v.records)))
    return r.select("record_id", "symbol", "sector", "report_date", "surprise", "premarket_volume", "premarket_range", "market_cap", "earnings_time", "volume_ratio_7_day", "volume_ratio_30_day", "open_gap", F.col("return_open_close").alias("r"))


def _split(columns: list[str]) -> str:
    agg = {"n": "count(r)", "mean": "avg(r)", "std": "stddev_samp(r)", "win_rate": "avg(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END)", "median": "median(r)"}
    return ", ".join(f"{agg[c]} FILTER (WHERE {'' if s == 'true' else 'NOT '}flag) AS {c}_{s}" for c in columns for s in ("true", "false"))


@query("a8_condition_split", LONG + f" SELECT * FROM (SELECT condition, {_split(['n', 'mean', 'std', 'win_rate', 'median'])} FROM long GROUP BY 1) z WHERE n_true >= 3 AND n_false >= 3", "records", "mean_true mean_false std_true std_false win_rate_true win_rate_false median_true median_false")
def _(v: Views) -> DataFrame:
    df = E.written(conditioned(v))
    return X.split_stats(df, X.library(df), "r")


@query("c12_signal_grid", "WITH x AS (SELECT 1 / (1 + exp(-surprise / 50)) AS p, CASE WHEN volume_7_day_avg > 0 THEN opening_minute_volume / volume_7_day_avg ELSE 1e0 END AS v7, market_cap AS c, (close_price - open_price) / open_price AS r FROM records), g AS (SELECT * FROM (VALUES (0.5e0), (0.55e0), (0.6e0)) a(prob_min), (VALUES (0e0), (5e-1)) b(volume_min)) SELECT prob_min, volume_min, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END) AS win_rate FROM x JOIN g ON p >= prob_min AND v7 >= volume_min WHERE c >= 900 GROUP BY 1, 2", "records", "mean std win_rate")
def _(v: Views) -> DataFrame:
    df = conditioned(v).withColumn("p", 1 / (1 + F.exp(-F.col("surprise") / 50)))
    return X.signal_grid(df, "p", "volume_ratio_7_day", "market_cap", "r", volumes=(0.0, 0.5), min_cap=900.0)


_RULES = {"surprise": [0.0, 0.5, 1.0], "volume_ratio_7_day": [0.0, 0.5, 1.1, 1.2]} | {f"pct_{w}": [0.0, 0.5, 1.0] for w in ("1min", "5min", "15min")}


@query("c13_rule_grid", "WITH x AS (SELECT *, (close_price - open_price) / open_price AS r FROM records) " + _union([f"SELECT '{c}' AS rule, CAST({t} AS DOUBLE) AS threshold, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END) AS win_rate FROM x WHERE {c} >= {t} HAVING count(*) > 0" for c, ts in _RULES.items() for t in ts]), "records", "mean std win_rate")
def _(v: Views) -> DataFrame:
    return X.grid(E.price_returns(v.records).withColumnRenamed("return_open_close", "r"), _RULES, "r")


# thresholds and folds: features of trades are integers or money, returns are tax-adjusted discounts

_FOLDED = "(SELECT CASE WHEN d < DATE '1999-01-01' THEN 0 ELSE 1 END AS fold, qty, price, r FROM trades)"


def _thresholds(grid: str) -> str:
    return f"""WITH t AS {_FOLDED}, long AS (SELECT fold, 'qty' AS feature, qty AS x, r FROM t UNION ALL SELECT fold, 'price', price, r FROM t), {grid},
c AS (SELECT feature, fold, th, '>' AS direction, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win_rate FROM long JOIN g USING (feature, fold) WHERE x > th GROUP BY 1, 2, 3 UNION ALL
      SELECT feature, fold, th, '<=', count(*), avg(r), stddev_samp(r), avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) FROM long JOIN g USING (feature, fold) WHERE x <= th GROUP BY 1, 2, 3),
k AS (SELECT *, mean / std * {YEAR} AS sharpe, row_number() OVER (PARTITION BY feature, fold ORDER BY mean / std DESC, th, direction DESC) AS k FROM c WHERE n >= 15)
SELECT feature, CAST(fold AS INT) AS fold, th AS threshold, direction, n, mean, std, win_rate, sharpe FROM k WHERE k = 1"""


#: Both folds are trained on.
_HALVES = [(0, 0, "train"), (1, 1, "train")]


def folded(v: Views) -> DataFrame:
    return v.trades.withColumn("fold", F.when(F.col("d") < "1999-01-01", 0).otherwise(1))


@query("c2_best_threshold", _thresholds("q AS (SELECT feature, fold, quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b FROM long GROUP BY 1, 2), g AS (SELECT feature, fold, a + i * (b - a) / 49 AS th FROM q, range(0, 50) z(i))"), "trades", "threshold mean std win_rate sharpe", 5)
def _(v: Views) -> DataFrame:
    table, _, _ = H.span_tables(folded(v).withColumn("_span", F.col("fold")), ["qty", "price"], _HALVES)
    return H.best(table, ["feature", "fold"]).select("feature", "fold", "threshold", "direction", "n", "mean", "std", "win_rate", "sharpe")


@query("c18_percentile_thresholds", _thresholds("g AS (SELECT DISTINCT feature, fold, unnest(quantile_cont(x, [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])) AS th FROM long GROUP BY feature, fold)"), "trades", "threshold mean std win_rate sharpe", 5)
def _(v: Views) -> DataFrame:
    table, _, _ = H.span_tables(folded(v).withColumn("_span", F.col("fold")), ["qty", "price"], _HALVES, grids_of=H.span_percentiles)
    return H.best(table, ["feature", "fold"]).select("feature", "fold", "threshold", "direction", "n", "mean", "std", "win_rate", "sharpe")


def walked(v: Views) -> tuple[DataFrame, DataFrame]:
    return H.walk_forward(v.trades, ["qty", "price", "tax"], D.expanding(v.trades))


EVALUATED = "mean win_rate degradation std sharpe d p"


def evaluated(by: str, tests: str, min_sharpe: float, min_win: float, max_p: float, min_d: float) -> str:
    """SQL of thresholds.evaluate over tests(by, n, m, s, w, sharpe, train_sharpe), a row a fold."""
    return f"""ev_t AS ({tests}), ev_g AS (SELECT {by}, count(*) AS n_folds, CAST(sum(n) AS BIGINT) AS n, sum(n * m) / sum(n) AS mean, sum((n - 1) * coalesce(s, 0) ** 2 + n * m * m) AS q, sum(n * w) / sum(n) AS win_rate, avg((train_sharpe - sharpe) / greatest(train_sharpe, 0.01)) AS degradation FROM ev_t GROUP BY 1),
ev_h AS (SELECT * EXCLUDE (q), sqrt(greatest((q - n * mean * mean) / (n - 1), 0)) AS std FROM ev_g), ev_i AS (SELECT *, mean / std * {YEAR} AS sharpe, abs(mean / std) AS d FROM ev_h), ev_z AS (SELECT *, {t_tail('d * sqrt(n)', 'n - 1e0')} AS p FROM ev_i)
SELECT *, coalesce(degradation <= 0.5 AND n >= 20 AND sharpe >= {min_sharpe} AND win_rate >= {min_win} AND p <= {max_p} AND d >= {min_d}, false) AS passed FROM ev_z"""


def _walked() -> str:
    """Best training thresholds b and test metrics of the expanding folds, as SQL."""
    rows = " UNION ALL ".join(f"SELECT f.fold, f.role, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, r FROM trades JOIN fo f ON trades.d BETWEEN f.start AND f.\"end\"" for c in ("qty", "price", "tax"))
    side = lambda d: f"SELECT feature, fold, th, '{d}' AS direction, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std FROM long JOIN g USING (feature, fold) WHERE role = 'train' AND x {d} th GROUP BY 1, 2, 3"
    return f"""fo AS ({EXPANDING}), long AS ({rows}), q AS (SELECT feature, fold, count(DISTINCT x) AS nd, quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b FROM long WHERE role = 'train' GROUP BY 1, 2),
g AS (SELECT feature, fold, a + i * (b - a) / 49 AS th FROM q, range(0, 50) z(i) WHERE nd > 20 UNION SELECT feature, fold, x FROM long JOIN q USING (feature, fold) WHERE nd <= 20 AND role = 'train'),
c AS ({side('>')} UNION ALL {side('<=')}), k AS (SELECT *, mean / std * {YEAR} AS train_sharpe, row_number() OVER (PARTITION BY feature, fold ORDER BY round(mean / std, 12) DESC, th, direction DESC) AS k FROM c WHERE n >= 15 AND std > 1e-12),
te AS (SELECT l.feature, l.fold, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS w, any_value(train_sharpe) AS train_sharpe FROM long l JOIN k ON k.k = 1 AND k.feature = l.feature AND k.fold = l.fold WHERE role = 'test' AND (CASE WHEN direction = '>' THEN x > th ELSE x <= th END) GROUP BY 1, 2 HAVING count(*) >= 5)"""


@query("c3_test_metrics", lambda: f"WITH {_walked()} SELECT feature, CAST(fold AS INT) AS fold, n, m AS mean, s AS std, w AS win_rate, coalesce(m / nullif(s, 0) * {YEAR}, 0) AS sharpe FROM te", "trades", "mean std win_rate sharpe", 5)
def _(v: Views) -> DataFrame:
    return walked(v)[1]


@query("c5_walk_forward", lambda: f"WITH {_walked()}, {evaluated('feature', f'SELECT *, coalesce(m / nullif(s, 0) * {YEAR}, 0) AS sharpe FROM te', 0.8, 0.48, 0.05, 0.2)}", "trades", EVALUATED, 5)
def _(v: Views) -> DataFrame:
    return H.evaluate(*walked(v))


@query("c7_prescreen", _union([f"SELECT '{c}' AS feature, count(*) AS n, corr({c}, r) AS corr FROM trades HAVING abs(corr({c}, r)) >= 0.05 AND count(*) >= 50" for c in ("qty", "price", "tax", "part", "supp")]), "trades", "corr")
def _(v: Views) -> DataFrame:
    from tidemark.operators.profile import correlations

    return correlations(v.trades, ["qty", "price", "tax", "part", "supp"], ["r"]).filter((F.abs("corr") >= 0.05) & (F.col("n") >= 50)).select("feature", "n", "corr")


_F5 = ["qty", "price", "tax", "part", "supp"]


@query("c8_pair_correlations", _union([f"SELECT '{min(a, b)}' AS f1, '{max(a, b)}' AS f2, count(*) AS n, corr({a}, {b}) AS corr FROM trades" for i, a in enumerate(sorted(_F5)) for b in sorted(_F5)[i + 1 :]]), "trades", "corr")
def _(v: Views) -> DataFrame:
    return C.pair_correlations(v.trades, _F5)


def _singles(v: Views) -> DataFrame:
    """A single feature's strategy: trades above the feature's mean."""
    cuts = v.trades.agg(*(F.avg(f).alias(f) for f in _F5)).first()
    hits = F.filter(F.array(*(F.when(F.col(f) > cuts[f], F.lit(f)) for f in _F5)), lambda x: x.isNotNull())
    t = v.trades.select("trade_id", "d", (F.col("r") / 100).alias("r"), F.explode(hits).alias("strategy"))
    m = M.series_metrics(t, ["strategy"]).join(M.max_drawdown(t, ["strategy"]), "strategy")
    return m.select(F.col("strategy").alias("feature"), "sharpe", "mdd", "win_rate", "n")


_CUTS = "cuts AS (SELECT " + ", ".join(f"avg({f}) AS c_{f}" for f in _F5) + " FROM trades)"
_SINGLES = f"""{_CUTS}, sx AS ({_union([f"SELECT '{f}' AS feature, d, trade_id, r / 100 AS r FROM trades, cuts WHERE {f} > c_{f}" for f in _F5])}),
sw AS (SELECT feature, d, trade_id, sum(ln(1 + r)) OVER (PARTITION BY feature ORDER BY d, trade_id ROWS UNBOUNDED PRECEDING) AS g FROM sx), sp AS (SELECT feature, exp(g - max(g) OVER (PARTITION BY feature ORDER BY d, trade_id ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM sw), sd AS (SELECT feature, min(dd) AS mdd FROM sp GROUP BY 1),
singles AS (SELECT feature, avg(r) / stddev_samp(r) * {YEAR} AS sharpe, any_value(mdd) AS mdd, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, count(*) AS n FROM sx JOIN sd USING (feature) GROUP BY 1), cand AS (SELECT feature FROM singles WHERE n >= 50 ORDER BY sharpe DESC, feature LIMIT 4)"""
_CORR = "co AS (" + _union([f"SELECT '{min(a, b)}' AS f1, '{max(a, b)}' AS f2, corr({a}, {b}) AS corr FROM trades" for i, a in enumerate(sorted(_F5)) for b in sorted(_F5)[i + 1 :]]) + ")"
_PAIRED = "pa AS (SELECT a.feature || '+' || b.feature AS key, [a.feature, b.feature] AS fs FROM cand a JOIN cand b ON a.feature < b.feature)"
_GROWN = "tr AS (SELECT key || '+' || feature AS key, list_append(fs, feature) AS fs FROM pa JOIN cand ON feature > fs[2]), qu AS (SELECT key || '+' || feature AS key, list_append(fs, feature) AS fs FROM tr JOIN cand ON feature > fs[3]), co_all AS (SELECT * FROM pa UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM qu)"


def candidates(v: Views) -> DataFrame:
    """The four features of the best Sharpe ratio."""
    return _singles(v).filter("n >= 50").orderBy(F.desc("sharpe"), "feature").limit(4).select("feature")


def combos_of(v: Views) -> DataFrame:
    """Pairs of candidates, grown one feature at a time to all of them (six at most)."""
    f = candidates(v)
    found = [C.pairs(f)]
    while len(found) < 3:
        found.append(C.grow(found[-1], f))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("c8_combinations", f"WITH {_SINGLES}, {_PAIRED}, {_GROWN} SELECT key, CAST(len(fs) AS INT) AS size FROM co_all", "trades")
def _(v: Views) -> DataFrame:
    return combos_of(v).select(F.array_join("combo", "+").alias("key"), F.size("combo").alias("size"))


@query("c9_combination_scores", f"""WITH {_SINGLES}, {_CORR}, {_PAIRED}, {_GROWN}, me AS (SELECT key, unnest(fs) AS feature FROM co_all), ms AS (SELECT key, count(*) AS k, avg(sharpe) AS s, max(abs(mdd)) AS dd, avg(win_rate) AS w FROM me JOIN singles USING (feature) GROUP BY 1),
ea AS (SELECT a.key, avg(abs(coalesce(co.corr, 0))) AS c FROM me a JOIN me b ON a.key = b.key AND a.feature < b.feature LEFT JOIN co ON co.f1 = a.feature AND co.f2 = b.feature GROUP BY 1), ex AS (SELECT *, s * least(sqrt(k) * sqrt(greatest(0.1, 1 - c)), 2.0) AS e FROM ms JOIN ea USING (key))
SELECT key, k, e AS expected_sharpe, c AS avg_correlation, 0.4 * greatest(0, least(1, e / 3)) + 0.25 * (1 - c) + 0.15 * greatest(0, 1 - dd / 0.12) + 0.1 * (greatest(0, (w - 0.45) / 0.25) + greatest(0.5, 1 - (k - 2) * 0.15)) AS score FROM ex""", "trades", "expected_sharpe avg_correlation score", 5)
def _(v: Views) -> DataFrame:
    return C.scored(combos_of(v), _singles(v), C.pair_correlations(v.trades, _F5)).drop("combo")


_MIXED = {"discount": "r + tax", "spread": "tax - 0.25 * (r + tax)", "load": "qty / 1000 - 0.1 * (r + tax)", "tax": "tax", "qty": "qty", "price": "price"}
_MIXED_CORR = "mx AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _MIXED.items()) + " FROM trades), co AS (" + _union([f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS corr FROM mx" for i, a in enumerate(sorted(_MIXED)) for b in sorted(_MIXED)[i + 1 :]]) + "), mild AS (SELECT * FROM co WHERE corr > -0.4 AND corr < -0.1), en AS (SELECT f1 AS hub, f2 AS other, corr FROM mild UNION ALL SELECT f2, f1, corr FROM mild)"


@query("c10_covariance_patterns", f"WITH {_MIXED_CORR} SELECT 'pair' AS kind, f1 || '+' || f2 AS key, abs(corr) AS strength FROM mild UNION ALL SELECT 'hub', a.hub || '+' || a.other || '+' || b.other, (abs(a.corr) + abs(b.corr)) / 2 FROM en a JOIN en b ON a.hub = b.hub AND a.other < b.other", "trades", "strength", 5)
def _(v: Views) -> DataFrame:
    mixed = v.trades.select(*(F.expr(e).alias(n) for n, e in _MIXED.items()))
    return C.covariance_patterns(C.pair_correlations(mixed, list(_MIXED))).select("kind", F.array_join("combo", "+").alias("key"), "strength")


STRATEGIES = [("cheap_small", "qty", 20.0, "<="), ("cheap_small", "price", 30000.0, "<="), ("large", "qty", 30.0, ">"), ("low_tax", "tax", 0.02, "<="), ("low_tax", "qty", 10.0, ">"), ("low_tax", "price", 50000.0, "<=")]
_HITS = "h AS (SELECT 'cheap_small' AS strategy, trade_id, d, sector, r FROM trades WHERE qty <= 20 AND price <= 30000 UNION ALL SELECT 'large', trade_id, d, sector, r FROM trades WHERE qty > 30 UNION ALL SELECT 'low_tax', trade_id, d, sector, r FROM trades WHERE tax <= 0.02 AND qty > 10 AND price <= 50000)"


def rules(v: Views) -> DataFrame:
    return v.spark.createDataFrame(STRATEGIES, "strategy string, feature string, threshold double, direction string")


def hits(v: Views) -> DataFrame:
    return C.trades_of(v.trades.withColumnRenamed("strategy", "own"), rules(v), "trade_id")


@query("c14_strategy_trades", f"WITH {_HITS} SELECT strategy, trade_id, r FROM h", "trades", "r")
def _(v: Views) -> DataFrame:
    return hits(v).select("strategy", "trade_id", "r")


@query("j13_strategies_by_join", f"WITH {_HITS} SELECT strategy, count(*) AS n, sum(r) AS total FROM h GROUP BY 1", "trades", "total")
def _(v: Views) -> DataFrame:
    return C.trades_of_many(v.trades.drop("strategy"), rules(v), "trade_id").groupBy("strategy").agg(F.count("*").alias("n"), F.sum("r").alias("total"))


@query("c11_final_filter", f"""WITH {_HITS}, t AS (SELECT strategy, d, trade_id, r / 100 AS r FROM h), w AS (SELECT strategy, d, trade_id, sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY d, trade_id ROWS UNBOUNDED PRECEDING) AS g FROM t), p AS (SELECT strategy, exp(g - max(g) OVER (PARTITION BY strategy ORDER BY d, trade_id ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM w), m AS (SELECT strategy, min(dd) AS mdd FROM p GROUP BY 1),
x AS (SELECT strategy, avg(r) / stddev_samp(r) * {YEAR} AS sharpe, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, count(*) AS n FROM t GROUP BY 1) SELECT strategy, sharpe, win_rate, mdd, n FROM x JOIN m USING (strategy) WHERE sharpe >= 2 AND win_rate >= 0.4 AND n >= 20 AND abs(mdd) <= 0.02""", "trades", "sharpe win_rate mdd", 5)
def _(v: Views) -> DataFrame:
    h = hits(v).withColumn("r", F.col("r") / 100)
    m = M.series_metrics(h, ["strategy"]).join(M.max_drawdown(h, ["strategy"]).select("strategy", "mdd"), "strategy")
    return C.final_filter(m, min_sharpe=2.0, min_win=0.4, max_dd=0.02).select("strategy", "sharpe", "win_rate", "mdd", "n")


@query("c15_bins", "WITH q AS (SELECT quantile_cont(price, [0.25, 0.5, 0.75]) AS q FROM trades), b AS (SELECT CASE WHEN price <= q[1] THEN 'q1' WHEN price <= q[2] THEN 'q2' WHEN price <= q[3] THEN 'q3' ELSE 'q4' END AS bin, r FROM trades, q) SELECT 'price' AS feature, bin, count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win_rate FROM b GROUP BY 1, 2", "trades", "mean std win_rate")
def _(v: Views) -> DataFrame:
    return C.bin_performance(v.trades, "price", C.quantile_bins(v.trades, "price"))


_BINNED = "count(*) AS n, avg(r) AS mean, stddev_samp(r) AS std, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win_rate"
_WIDTHS = "WITH e AS (SELECT min(price) AS a, max(price) AS b FROM trades), w AS (SELECT 'w' || CAST(CAST(greatest(1, least(5, ceil((price - a) / ((b - a) / 5)))) AS INT) AS VARCHAR) AS bin, r FROM trades, e)"


@query("c15_width_bins", f"{_WIDTHS} SELECT 'price' AS feature, bin, {_BINNED} FROM w GROUP BY 1, 2", "trades", "mean std win_rate")
def _(v: Views) -> DataFrame:
    return C.bin_performance(v.trades, "price", C.width_bins(v.trades, "price"))


@query("c15_category_bins", f"WITH t AS (SELECT supp % 7 AS x FROM trades GROUP BY 1 ORDER BY count(*) DESC, x LIMIT 3), b AS (SELECT CASE WHEN supp % 7 IN (SELECT x FROM t) THEN CAST(supp % 7 AS VARCHAR) ELSE 'other' END AS bin, r FROM trades) SELECT 'desk' AS feature, bin, {_BINNED} FROM b GROUP BY 1, 2", "trades", "mean std win_rate")
def _(v: Views) -> DataFrame:
    df = v.trades.withColumn("desk", (F.col("supp") % 7).cast("string"))
    return C.bin_performance(df, "desk", C.category_bins(df, "desk", 3))


@query("c15_best_bin", f"{_WIDTHS}, p AS (SELECT bin, {_BINNED} FROM w GROUP BY 1) SELECT 'price' AS feature, arg_max(bin, mean) AS bin, max(mean) AS mean FROM p WHERE n >= 10", "trades", "mean")
def _(v: Views) -> DataFrame:
    return C.best_bin(C.bin_performance(v.trades, "price", C.width_bins(v.trades, "price")))


@query("c15_tree_bins", "SELECT 'tax' AS feature, count(*) AS n, avg(r) AS mean FROM trades", "trades", "mean")
def _(v: Views) -> DataFrame:
    """Bins by a regression tree; together they hold every trade."""
    bins = C.bin_performance(v.trades, "tax", C.tree_bins(v.trades, "tax"))
    return bins.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))


@query("c16_stop_target_grid", "WITH x AS (SELECT pct_change_high AS h, pct_change_low AS l, (close_price - open_price) / open_price * 100 AS c FROM records WHERE pct_change_high IS NOT NULL), g AS (SELECT * FROM (VALUES (-1e0), (-15e-1), (-2e0)) a(stop), (VALUES (2e0), (3e0), (5e0)) b(target)), o AS (SELECT stop, target, CASE WHEN l <= stop THEN stop WHEN h >= target THEN target ELSE c END AS y FROM x, g) SELECT stop, target, count(*) AS n, avg(y) AS mean, avg(CASE WHEN y > 0 THEN 1e0 ELSE 0e0 END) AS win_rate FROM o GROUP BY 1, 2", "records", "mean win_rate")
def _(v: Views) -> DataFrame:
    df = E.price_returns(v.records).withColumn("return_open_close_pct", F.col("return_open_close") * 100)
    return C.stop_target_grid(df, [-1.0, -1.5, -2.0], [2.0, 3.0, 5.0])


@query("c17_interactions", "WITH m AS (SELECT avg(r) FILTER (WHERE qty > 25) AS a, avg(r) FILTER (WHERE price > 40000) AS b, avg(r) FILTER (WHERE tax > 0.04) AS c, avg(r) FILTER (WHERE qty > 25 AND price > 40000) AS ab, avg(r) FILTER (WHERE qty > 25 AND tax > 0.04) AS ac, avg(r) FILTER (WHERE price > 40000 AND tax > 0.04) AS bc, count(*) FILTER (WHERE qty > 25 AND price > 40000) AS nab, count(*) FILTER (WHERE qty > 25 AND tax > 0.04) AS nac, count(*) FILTER (WHERE price > 40000 AND tax > 0.04) AS nbc FROM trades) SELECT 'a' AS a, 'b' AS b, nab AS n_both, ab - greatest(m.a, m.b) AS strength FROM m UNION ALL SELECT 'a', 'c', nac, ac - greatest(m.a, m.c) FROM m UNION ALL SELECT 'b', 'c', nbc, bc - greatest(m.b, m.c) FROM m", "trades", "strength")
def _(v: Views) -> DataFrame:
    return C.interaction_strength(v.trades, {"a": F.col("qty") > 25, "b": F.col("price") > 40000, "c": F.col("tax") > 0.04})


EXPANDING = """WITH dd AS (SELECT d, count(*) AS n, row_number() OVER (ORDER BY d) - 1 AS i FROM trades GROUP BY d), t AS (SELECT count(*) AS days FROM dd), f AS (SELECT k AS fold, CAST(floor(days * (0.6 + 0.08 * k)) AS INT) AS e, days FROM t, range(0, 3) z(k)),
b AS (SELECT f.*, (SELECT d FROM dd WHERE i = e - 1) AS last_train, (SELECT min(d) FROM dd) AS first_day FROM f), c AS (SELECT b.*, dd.d AS test_day, row_number() OVER (PARTITION BY fold ORDER BY dd.d) AS k2 FROM b JOIN dd ON dd.i >= e AND dd.d > last_train + 1)
SELECT CAST(fold AS INT) AS fold, 'train' AS role, first_day AS start, last_train AS "end" FROM b UNION ALL SELECT CAST(fold AS INT), 'test', min(test_day), max(test_day) FROM c WHERE k2 <= greatest(10, CAST(floor(days * 0.15) AS INT)) GROUP BY fold"""


@query("k1_expanding_folds", EXPANDING, "trades")
def _(v: Views) -> DataFrame:
    return D.expanding(v.trades)


@query("k2_row_positions", "SELECT trade_id, row_number() OVER (ORDER BY d, trade_id) - 1 AS position FROM trades", "trades")
def _(v: Views) -> DataFrame:
    return row_numbers(v.trades, "d", ["trade_id"]).select("trade_id", "position")


@query("k2_rolling_rows", "WITH p AS (SELECT row_number() OVER (ORDER BY d, trade_id) - 1 AS pos, r FROM trades), f AS (SELECT CAST(i AS INT) AS fold, n, CAST(floor(n * 0.5) AS BIGINT) AS a, CAST(floor(n * 0.15) AS BIGINT) AS b, i FROM (SELECT count(*) AS n FROM trades) c, range(0, 4) z(i)), w AS (SELECT fold, 'train' AS role, i * b AS lo, i * b + a - 1 AS hi FROM f WHERE i * b + a + b <= n UNION ALL SELECT fold, 'test', i * b + a, i * b + a + b - 1 FROM f WHERE i * b + a + b <= n) SELECT fold, role, count(*) AS n, sum(r) AS total FROM p JOIN w ON pos BETWEEN lo AND hi GROUP BY 1, 2", "trades", "total")
def _(v: Views) -> DataFrame:
    """Rolling folds by row position (the tables hold a thousand rows or more)."""
    rows = row_numbers(v.trades, "d", ["trade_id"])
    folds = D.rolling_rows(rows.count())
    inside = F.filter(F.array(*(F.when(F.col("position").between(a, b), F.struct(F.lit(f).alias("fold"), F.lit(role).alias("role"))) for f, role, a, b in folds)), lambda x: x.isNotNull())
    return rows.select("r", F.inline(inside)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("r").alias("total"))


@query("k3_monthly_folds", "WITH b AS (SELECT min(d) AS f FROM trades), k AS (SELECT CAST(i AS INT) AS i, f, f + 90 + 30 * CAST(i AS INT) AS a FROM b, range(0, 6) z(i)) SELECT i AS fold, 'train' AS role, f AS start, a - 1 AS \"end\" FROM k UNION ALL SELECT i, 'test', a, a + 29 FROM k", "trades")
def _(v: Views) -> DataFrame:
    return D.monthly(v.trades)


@query("k4_fold_rows", "WITH b AS (SELECT min(d) AS f FROM trades), k AS (SELECT CAST(i AS INT) AS fold, f, f + 90 + 30 * CAST(i AS INT) AS a FROM b, range(0, 6) z(i)), p AS (SELECT fold, 'train' AS role, f AS s, a - 1 AS e FROM k UNION ALL SELECT fold, 'test', a, a + 29 FROM k) SELECT fold, role, count(*) AS n, sum(r) AS total FROM trades JOIN p ON d BETWEEN s AND e GROUP BY 1, 2", "trades", "total")
def _(v: Views) -> DataFrame:
    return D.assign(v.trades, D.monthly(v.trades)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("r").alias("total"))


# robustness

@query("r1_by_sector", "WITH m AS (SELECT substr(strategy, 2, 1) AS strategy, sector, avg(r) AS mean FROM trades GROUP BY 1, 2), g AS (SELECT strategy, count(*) AS n_groups, min(mean) AS worst, max(mean) AS best FROM m GROUP BY 1) SELECT *, coalesce(worst > 0.005 AND best / worst < 5, false) AS passed FROM g", "trades", "worst best", 9)
def _(v: Views) -> DataFrame:
    return R.by_sector(v.trades.withColumn("strategy", F.substring("strategy", 2, 1)))


@query("r2_by_cap", "WITH q AS (SELECT quantile_cont(price, 1/3e0) AS a, quantile_cont(price, 2/3e0) AS b FROM trades), m AS (SELECT strategy, CASE WHEN price <= a THEN 1 WHEN price <= b THEN 2 ELSE 3 END AS t, avg(r) AS mean FROM trades, q GROUP BY 1, 2), g AS (SELECT strategy, count(*) AS n_groups, min(mean) AS worst, max(mean) AS best FROM m GROUP BY 1) SELECT *, coalesce(worst > 0.005 AND best / worst < 5, false) AS passed FROM g", "trades", "worst best", 9)
def _(v: Views) -> DataFrame:
    return R.by_cap(v.trades, "price")


@query("r3_by_half", "WITH b AS (SELECT min(d) AS f, max(d) - min(d) AS s FROM trades), g AS (SELECT strategy, avg(r) FILTER (WHERE d - f <= CAST(floor(s / 2) AS INT)) AS first_mean, avg(r) FILTER (WHERE d - f > CAST(floor(s / 2) AS INT)) AS second_mean FROM trades, b GROUP BY 1) SELECT *, coalesce(first_mean > 0 AND second_mean > 0, false) AS passed FROM g", "trades", "first_mean second_mean", 9)
def _(v: Views) -> DataFrame:
    return R.by_half(v.trades)


@query("r4_cost_scenarios", f"WITH m AS (SELECT strategy, avg(r) AS mean, stddev_samp(r) AS std FROM trades GROUP BY 1), c AS (SELECT 'cost' AS kind, x AS multiplier, 2 * (x * 5 + 5) / 1e4 AS charge FROM (VALUES (5e-1), (1e0), (15e-1), (2e0), (3e0)) a(x) UNION ALL SELECT 'slippage', x, 2 * (5 + x * 5) / 1e4 FROM (VALUES (5e-1), (1e0), (15e-1), (2e0), (3e0)) a(x)) SELECT strategy, kind, multiplier, mean - charge AS net_mean, (mean - charge) / std * {YEAR} AS net_sharpe FROM m, c", "trades", "net_mean net_sharpe", 5)
def _(v: Views) -> DataFrame:
    return R.costs(v.trades)


_MARKET = "m AS (SELECT d, avg(r) AS m FROM trades GROUP BY 1), q AS (SELECT quantile_cont(m, 0.6) AS hi FROM (SELECT m.m FROM trades JOIN m USING (d)) z)"


@query("r6_by_market", f"WITH {_MARKET} SELECT strategy, avg(r) FILTER (WHERE m > hi + 1e-9) AS bull_mean, avg(r) FILTER (WHERE m <= hi + 1e-9) AS bear_mean, count(*) FILTER (WHERE m > hi + 1e-9) AS n_bull, count(*) FILTER (WHERE m <= hi + 1e-9) AS n_bear, coalesce(avg(r) FILTER (WHERE m > hi + 1e-9) > 0 AND avg(r) FILTER (WHERE m <= hi + 1e-9) > 0, false) AS passed FROM trades JOIN m USING (d), q GROUP BY 1", "trades", "bull_mean bear_mean", 9)
def _(v: Views) -> DataFrame:
    t = v.trades.join(v.trades.groupBy("d").agg(F.avg("r").alias("m")), "d")
    hi = (quantile_values(t, {"m": F.col("m")}, [0.6])["m"] or [0.0])[0]
    return R.by_market(t.withColumn("bull_regime", F.when(F.col("m") > F.lit(hi + 1e-9), 1).otherwise(0)))


@query("r7_robustness_score", "WITH b AS (SELECT min(d) AS f, max(d) - min(d) AS s FROM trades), h AS (SELECT strategy, coalesce(avg(r) FILTER (WHERE d - f <= CAST(floor(s / 2) AS INT)) > 0 AND avg(r) FILTER (WHERE d - f > CAST(floor(s / 2) AS INT)) > 0, false) AS p FROM trades, b GROUP BY 1), q AS (SELECT quantile_cont(price, 1/3e0) AS a, quantile_cont(price, 2/3e0) AS b FROM trades), m AS (SELECT strategy, CASE WHEN price <= a THEN 1 WHEN price <= b THEN 2 ELSE 3 END AS t, avg(r) AS mean FROM trades, q GROUP BY 1, 2), c AS (SELECT strategy, coalesce(min(mean) > 0.005 AND max(mean) / min(mean) < 5, false) AS p FROM m GROUP BY 1), u AS (SELECT * FROM h UNION ALL SELECT * FROM c) SELECT strategy, count(*) AS n_checks, avg(CAST(p AS INT)) AS score, avg(CAST(p AS INT)) >= 0.7 AS robust FROM u GROUP BY 1", "trades", "score")
def _(v: Views) -> DataFrame:
    return R.score({"half": R.by_half(v.trades), "cap": R.by_cap(v.trades, "price")})


# regimes: the daily close of all orders is the market

_SERIES = "c AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS close FROM orders GROUP BY 1)"


def _regime_sql(frame: int) -> str:
    return f"""{_SERIES}, x AS (SELECT day, close, close / lag(close) OVER (ORDER BY day) - 1 AS ret FROM c), y AS (SELECT day, count(ret) OVER w AS n, avg(ret) OVER w AS m, stddev_samp(ret) OVER w * {YEAR} AS s FROM x WINDOW w AS (ORDER BY day ROWS BETWEEN {frame} PRECEDING AND 1 PRECEDING)),
z AS (SELECT day, CASE WHEN n >= {frame} THEN CASE WHEN m > 0.05 THEN 'bull' WHEN m < -0.05 THEN 'bear' ELSE 'sideways' END || CASE WHEN s > 6 THEN '_high_vol' ELSE '_low_vol' END ELSE 'sideways_low_vol' END AS regime FROM y)"""


def regimes(v: Views) -> DataFrame:
    o = v.spark.read.parquet(f"{v.sf_dir}/orders.parquet")
    return G.classify(o.groupBy(F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("close")), vol=6.0)


@query("m1_regimes", f"WITH {_regime_sql(60)} SELECT day, regime FROM z")
def _(v: Views) -> DataFrame:
    return regimes(v).select("day", "regime")


@query("m2_regime_metrics", f"WITH {_regime_sql(60)}, j AS (SELECT t.strategy, regime, r FROM trades t JOIN z ON z.day = t.d) SELECT strategy, regime, avg(r) * 252 AS annual_return, avg(r) / stddev_samp(r) * {YEAR} AS sharpe, count(*) AS n FROM j GROUP BY 1, 2 HAVING count(*) >= 20 AND (SELECT count(*) FROM j k WHERE k.regime = j.regime) >= 50", "trades", "annual_return sharpe", 5)
def _(v: Views) -> DataFrame:
    return G.consistency(v.trades, regimes(v))[0].select("strategy", "regime", "annual_return", "sharpe", "n")


@query("m2_consistency", f"WITH {_regime_sql(60)}, j AS (SELECT t.strategy, regime, r FROM trades t JOIN z ON z.day = t.d), m AS (SELECT strategy, regime, avg(r) / stddev_samp(r) * {YEAR} AS sharpe FROM j GROUP BY 1, 2 HAVING count(*) >= 20 AND (SELECT count(*) FROM j k WHERE k.regime = j.regime) >= 50) SELECT strategy, count(*) AS n_regimes, count(*) FILTER (WHERE sharpe >= 0.5) AS n_good, CASE WHEN count(*) < 3 THEN 0e0 ELSE count(*) FILTER (WHERE sharpe >= 0.5) / CAST(count(*) AS DOUBLE) END AS consistency FROM m GROUP BY 1", "trades", "consistency")
def _(v: Views) -> DataFrame:
    return G.consistency(v.trades, regimes(v))[1]


@query("m3_current_regime", f"WITH {_regime_sql(60)} SELECT day, regime FROM z ORDER BY day DESC LIMIT 1")
def _(v: Views) -> DataFrame:
    return G.current(regimes(v))


_TF = {"1min": 1, "5min": 2, "15min": 3, "30min": 4, "1hr": 5}


_FRAMES = f"""WITH t AS ({_union([f'SELECT strategy, {chr(39)}{k}{chr(39)} AS timeframe, r / {i}e0 + qty / 1e5 AS r FROM trades' for k, i in _TF.items()])}), m AS (SELECT strategy, timeframe, avg(r) * 252 AS a, avg(r) / stddev_samp(r) * {YEAR} AS s, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS w, count(*) AS n FROM t GROUP BY 1, 2), p(timeframe, d, q) AS (VALUES ('1min', 15e-1, 15e-2), ('5min', 13e-1, 1e-1), ('15min', 11e-1, 5e-2), ('30min', 1e0, 2e-2), ('1hr', 9e-1, 0e0)) SELECT strategy, timeframe, 0.4 * s + 0.25 * least(a, 0.3) + 0.2 * (w - 0.5) - 0.1 * (d - 1) - 0.05 * q AS score FROM m JOIN p USING (timeframe) WHERE n >= 30 AND s >= 0.8 AND w >= 0.48 AND a >= 0.03"""
BEST_FRAMES = f"SELECT strategy, arg_max(timeframe, struct_pack(s := score, t := timeframe)) AS timeframe, max(score) AS score, count(*) AS n_valid FROM ({_FRAMES}) q GROUP BY 1"


def framed(v: Views) -> DataFrame:
    """Trades with an alternative return for each timeframe."""
    cells = F.array(*(F.struct(F.lit(k).alias("timeframe"), (F.col("r") / i + F.col("qty") / 1e5).alias("x")) for k, i in _TF.items()))
    return v.trades.select("strategy", "d", F.inline(cells)).withColumnRenamed("x", "r")


@query("m4_timeframes", _FRAMES, "trades", "score", 5)
def _(v: Views) -> DataFrame:
    return G.timeframes(framed(v)).select("strategy", "timeframe", "score")


@query("m4_best_timeframe", f"SELECT strategy, n_valid, timeframe, score FROM ({BEST_FRAMES}) z WHERE n_valid >= 2", "trades", "score", 5)
def _(v: Views) -> DataFrame:
    return G.best_timeframe(G.timeframes(framed(v))).select("strategy", "n_valid", "timeframe", "score")


_COST = """x AS (SELECT trade_id, r, price, qty * 10 AS shares, 500 + price AS px, 1e6 * (1 + part % 40000) AS cap, 1000e0 + supp * 100 AS adv, CASE part % 3 WHEN 0 THEN 'market_open' WHEN 1 THEN '5min' ELSE 'close' END AS tf, CASE supp % 2 WHEN 0 THEN 'bull_low_vol' ELSE 'bear_high_vol' END AS rg, part % 2 = 0 AS e FROM trades),
y AS (SELECT *, shares * px AS val, shares * px / (adv * px) AS sh FROM x),
z AS (SELECT *, shares * 0.005 AS commission, val * (10 * CASE WHEN e THEN 1.8 ELSE 1 END * CASE WHEN cap < 1e9 THEN 2.2 WHEN cap < 5e9 THEN 1.6 WHEN cap < 2e10 THEN 1.3 ELSE 1 END * CASE rg WHEN 'bull_low_vol' THEN 0.85 ELSE 1.9 END) / 10000 AS spread,
 val * (20 * sqrt(sh) * CASE WHEN e THEN 1.6 ELSE 1 END * CASE tf WHEN 'market_open' THEN 1.7 WHEN '5min' THEN 1.3 ELSE 1.2 END) / 10000 AS impact, val * (3 * CASE WHEN e THEN 1.7 ELSE 1 END * CASE rg WHEN 'bear_high_vol' THEN 1.4 ELSE 1 END * (1 + 2 * sh)) / 10000 * 0.6 AS slippage, CASE tf WHEN 'market_open' THEN val * 15 / 10000 ELSE 0 END AS timing,
 greatest(0.4, 0.93 - CASE WHEN sh > 0.08 THEN least(0.25, sh * 2.5) ELSE 0 END - CASE WHEN e THEN 0.08 ELSE 0 END - CASE rg WHEN 'bear_high_vol' THEN 0.12 ELSE 0 END - CASE tf WHEN 'market_open' THEN 0.1 WHEN '5min' THEN 0.02 ELSE 0.08 END) AS fp FROM y)"""


def costed(v: Views) -> DataFrame:
    x = v.trades.select("trade_id", "r", (F.col("qty") * 10).alias("shares"), (F.col("price") + 500).alias("price"), (F.lit(1e6) * (1 + F.col("part") % 40000)).alias("market_cap"), (F.lit(1000.0) + F.col("supp") * 100).alias("adv"), F.element_at(F.array(F.lit("market_open"), F.lit("5min"), F.lit("close")), (F.col("part") % 3 + 1).cast("int")).alias("timeframe"), F.when(F.col("supp") % 2 == 0, "bull_low_vol").otherwise("bear_high_vol").alias("regime"), (F.col("part") % 2 == 0).alias("is_earnings_day"))
    return K.execution(x)


@query("m5_execution_costs", f"WITH {_COST} SELECT trade_id, (commission + spread + impact + slippage + timing) / val * 10000 AS total_cost_bps, fp AS fill_probability, fp * 0.96 AS fill_rate FROM z", "trades", "total_cost_bps fill_probability fill_rate", 7)
def _(v: Views) -> DataFrame:
    return costed(v).select("trade_id", "total_cost_bps", "fill_probability", "fill_rate")


@query("m6_net_returns", f"WITH {_COST} SELECT trade_id, r * fp * 0.96 - (commission + spread + impact + slippage + timing) / val * 2 / fp AS net_r, (commission + spread + impact + slippage + timing) / val * 10000 * CASE tf WHEN 'market_open' THEN 1.8 WHEN '5min' THEN 1.3 ELSE 1 END AS scaled_cost_bps FROM z", "trades", "net_r scaled_cost_bps", 5)
def _(v: Views) -> DataFrame:
    return K.net_returns(K.for_timeframe(costed(v))).select("trade_id", "net_r", "scaled_cost_bps")


_KELLY = f"""k AS (SELECT strategy, count(r) AS n, count(*) FILTER (WHERE r > 0) AS w, count(*) FILTER (WHERE r < 0) AS l, avg(r) FILTER (WHERE r > 0) AS up, -avg(r) FILTER (WHERE r < 0) AS dn, stddev_samp(r) * {YEAR} AS vol FROM trades GROUP BY 1),
f AS (SELECT *, greatest(0.001, least(0.05, ((up / dn) * (w / CAST(n AS DOUBLE)) - (1 - w / CAST(n AS DOUBLE))) / (up / dn) * 0.5 * greatest(0.3, 1 - 2 * 0.1) * CASE WHEN vol > 0.4 THEN 0.4 / vol ELSE 1 END)) AS kelly FROM k)"""


def sizes(v: Views) -> DataFrame:
    dd = v.trades.select("strategy").distinct().withColumn("mdd", F.lit(-0.1))
    return Z.kelly(v.trades, ["strategy"], dd).withColumn("mdd", F.lit(-0.1))


@query("m7_kelly", f"WITH {_KELLY} SELECT strategy, kelly, vol FROM f", "trades", "kelly vol")
def _(v: Views) -> DataFrame:
    return sizes(v).select("strategy", "kelly", "vol")


@query("m9_position_size", f"""WITH {_KELLY}, p AS (SELECT strategy, kelly, greatest(0.001, least(0.05, 0.15 / vol)) AS rp, greatest(0.001, least(0.05, 0.12 * 0.6 / vol)) AS vt FROM f), g AS (SELECT *, exp(list_avg(list_transform(list_filter([kelly, rp, vt], lambda z: z > 0.001), lambda z: ln(z)))) AS b FROM p)
SELECT strategy, rp AS risk_parity, vt AS vol_target, b AS base_size, greatest(0.001, least(0.05, b * 0.7 * (0.5 + 0.5 * 0.8))) * 0.7 * 0.6 AS size FROM g""", "trades", "risk_parity vol_target base_size size")
def _(v: Views) -> DataFrame:
    s = sizes(v).withColumns({"consistency": F.lit(0.8), "effect": F.lit(0.3), "power": F.lit(0.9)})
    return Z.position_size(s, "bear_low_vol").select("strategy", "risk_parity", "vol_target", "base_size", "size")


@query("m10_quantity", "SELECT record_id, CAST(floor(10000e0 * 0.9 / 3 / open_price) AS BIGINT) AS quantity FROM records", "records")
def _(v: Views) -> DataFrame:
    return v.records.select("record_id", Z.quantity(F.lit(10000.0), F.col("open_price")).alias("quantity"))
