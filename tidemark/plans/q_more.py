"""Remaining scalar functions, windows, orders, set operations, sources and combination tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scalar as S
from tidemark.operators import combos as C, folds as D, metrics as M, robustness as R, sizing as Z, thresholds as H, windows as N
from tidemark.operators.features import rolling_moments, written
from tidemark.plans.prefix import quantile_values
from tidemark.plans.q_bars import BINS, bins
from tidemark.plans.q_strategies import EVALUATED, STRATEGIES, YEAR, daily, evaluated, rules
from tidemark.plans.registry import Views, query
from tidemark.shared import new_path
from tidemark.sources import readers, sinks

_T = "WITH t AS (SELECT strategy, d, avg(r) AS r FROM trades GROUP BY 1, 2)"


@query("s2_tab_separated", "SELECT symbol, coalesce(surprise, -1) AS surprise FROM records", "records", "surprise", 4)
def _(v: Views) -> DataFrame:
    path = new_path(v.spark, "records-tsv")
    sinks.filled(v.records.drop("record_id")).write.option("header", True).option("sep", "\t").option("encoding", "iso-8859-1").csv(path)
    return readers.records_csv(v.spark, path).select("symbol", "surprise")


@query("s2_mixed_dialects", "SELECT symbol, coalesce(surprise, -1) AS surprise, coalesce(industry, '') AS industry FROM records", "records", "surprise", 4)
def _(v: Views) -> DataFrame:
    """A folder whose files differ in separator, encoding and order of columns, read back as one table."""
    path, rows = new_path(v.spark, "records-mixed"), sinks.filled(v.records.drop("record_id"))
    for i, (sep, code) in enumerate(((",", "utf-8"), (";", "iso-8859-1"), ("\t", "utf-8"))):
        part = rows.filter(F.pmod(F.xxhash64("symbol"), F.lit(3)) == i)
        part = part.select(*(rows.columns if i else reversed(rows.columns)))
        part.write.mode("append").option("header", True).option("sep", sep).option("encoding", code).csv(path)
    return readers.records_csv(v.spark, path).select("symbol", "surprise", F.coalesce("industry", F.lit("")).alias("industry"))


@query("s10_bins", "WITH b(ordinal, range_min, range_max, stop_loss, target_profit) AS (VALUES " + ", ".join(f"({o}, {a}e0, {b}e0, {s}e0, {t}e0)" for o, a, b, s, t in BINS) + "), r AS (SELECT pct_change_open AS x FROM records) SELECT ordinal, stop_loss, count(x) AS n FROM b LEFT JOIN r ON x >= range_min AND x < range_max GROUP BY 1, 2", "records")
def _(v: Views) -> DataFrame:
    """Bins written as one configuration file and read back; how many records each range holds, overlaps counted twice."""
    path = new_path(v.spark, "bins")
    bins(v).orderBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("ordinal", "range_min", "range_max", "stop_loss", "target_profit"))).alias("bins")).write.json(path)
    table = readers.bins_json(v.spark, path)
    inside = [F.count_if((F.col("pct_change_open") >= b["range_min"]) & (F.col("pct_change_open") < b["range_max"])).alias(str(b["ordinal"])) for b in table.collect()]  # a small configured table
    counts = v.records.agg(*inside).unpivot([], [str(b[0]) for b in BINS], "ordinal", "n").withColumn("ordinal", F.col("ordinal").cast("int"))
    return table.join(counts, "ordinal").select("ordinal", "stop_loss", "n")


@query("s16_saved_profiles", "SELECT strftime(report_date, '%Y-%m') AS month, count(surprise) AS n, round(avg(surprise), 4) AS mean, round(stddev_samp(surprise), 4) AS std FROM records GROUP BY 1", "records", "mean std", 4)
def _(v: Views) -> DataFrame:
    from tidemark.operators.profile import monthly

    path = new_path(v.spark, "profiles")
    sinks.save_profiles({"months": monthly(v.records, "surprise")}, path)
    return v.spark.read.option("header", True).schema("month string, n bigint, mean double, std double").csv(f"{path}/months")


@query("f14_terciles", "WITH q AS (SELECT quantile_cont(price, 1/3e0) AS a, quantile_cont(price, 2/3e0) AS b FROM trades) SELECT trade_id, CASE WHEN price <= a THEN 'small' WHEN price <= b THEN 'medium' ELSE 'large' END AS tercile FROM trades, q", "trades")
def _(v: Views) -> DataFrame:
    edges = quantile_values(v.trades, {"price": F.col("price")}, [1 / 3, 2 / 3])["price"]
    return v.trades.select("trade_id", R.tercile(F.col("price"), edges or [0.0, 0.0]).alias("tercile"))


@query("f19_sigmoid", "SELECT trade_id, greatest(0.001, least(0.999, 1 / (1 + exp(-(qty - 25) / 3)))) AS p FROM trades", "trades", "p")
def _(v: Views) -> DataFrame:
    return v.trades.select("trade_id", S.sigmoid((F.col("qty") - 25) / 3).alias("p"))


@query("f21_labels", """WITH m AS (SELECT strategy, avg(r) / stddev_samp(r) AS d FROM trades GROUP BY 1) SELECT strategy, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS effect,
 'qty > ' || printf('%.4f', 12.5) AS rule, '09:35:00' AS buy_time, 'MEDIUM' AS risk, 'BUY' AS action, 0.8 AS confidence FROM m""", "trades", "confidence")
def _(v: Views) -> DataFrame:
    m = M.series_metrics(v.trades, ["strategy"])
    signal = S.trading_signal(F.col("strategy"), F.col("sharpe"), F.lit(0.8), F.lit(0.01))
    return m.select("strategy", S.effect_label(F.col("mean") / F.col("std")).alias("effect"), S.rule_text(F.lit("qty"), F.lit(">"), F.lit(12.5)).alias("rule"), S.buy_time(F.lit("5min")).alias("buy_time"), S.risk_level(F.lit(-0.07)).alias("risk"), signal["action"].alias("action"), signal["confidence"].alias("confidence"))


@query("w4_rolling_volatility", _T + f" SELECT strategy, d, avg(r) OVER w AS m, stddev_samp(r) OVER w * {YEAR} AS s FROM t WINDOW w AS (PARTITION BY strategy ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", "trades", "m s", 10)
def _(v: Views) -> DataFrame:
    return rolling_moments(daily(v), "r", 60, "strategy", ("d",)).select("strategy", "d", F.col("rolling_mean").alias("m"), (F.col("rolling_std") * 252**0.5).alias("s"))


@query("w6_cumulative", _T + ", g AS (SELECT strategy, d, exp(sum(ln(1 + r / 100)) OVER w) AS growth, sum(r) OVER w AS total, r - lag(r) OVER (PARTITION BY strategy ORDER BY d) AS diff FROM t WINDOW w AS (PARTITION BY strategy ORDER BY d ROWS UNBOUNDED PRECEDING)) SELECT *, max(growth) OVER (PARTITION BY strategy ORDER BY d) AS peak FROM g", "trades", "growth total diff peak", 7)
def _(v: Views) -> DataFrame:
    days = N.differences(daily(v).withColumn("x", F.col("r") / 100), "r", "strategy", ("d",)).drop("pct")
    return N.cumulative(days, "x", "strategy", ("d",)).select("strategy", "d", "growth", (F.col("total") * 100).alias("total"), "diff", "peak")


@query("o2_top_surprises", "SELECT record_id, symbol, surprise FROM records ORDER BY surprise DESC NULLS LAST, report_date, record_id LIMIT 20", "records", "surprise", 4)
def _(v: Views) -> DataFrame:
    return v.records.orderBy(F.desc_nulls_last("surprise"), "report_date", "record_id").limit(20).select("record_id", "symbol", "surprise")


@query("o5_best_per_group", "SELECT symbol, arg_max(record_id, struct_pack(s := surprise, r := record_id)) FILTER (WHERE surprise IS NOT NULL) AS record_id FROM records GROUP BY 1", "records")
def _(v: Views) -> DataFrame:
    return v.records.groupBy("symbol").agg(F.max_by("record_id", F.when(F.col("surprise").isNotNull(), F.struct("surprise", "record_id"))).alias("record_id"))


@query("x1_union_of_feeds", "SELECT feed, count(*) AS n, count(size) AS n_sized FROM (SELECT feed, size FROM ticks WHERE feed = 'alpaca' UNION ALL SELECT feed, NULL FROM ticks WHERE feed = 'finnhub') q GROUP BY 1", "ticks")
def _(v: Views) -> DataFrame:
    a, f = (v.ticks.filter(F.col("feed") == x) for x in ("alpaca", "finnhub"))
    return a.unionByName(f.drop("size"), allowMissingColumns=True).groupBy("feed").agg(F.count("*").alias("n"), F.count("size").alias("n_sized"))


@query("x4_symbols_in_both", "SELECT symbol FROM calendar INTERSECT SELECT symbol FROM profile WHERE market_cap > 5000", "calendar profile")
def _(v: Views) -> DataFrame:
    return v.calendar.select("symbol").intersect(v.profile.filter("market_cap > 5000").select("symbol"))


@query("x5_symbols_without_reports", "SELECT symbol FROM profile EXCEPT SELECT symbol FROM calendar WHERE hour = 'amc'", "calendar profile")
def _(v: Views) -> DataFrame:
    return v.profile.select("symbol").exceptAll(v.calendar.filter("hour = 'amc'").select("symbol").distinct())


_RULES = {}
for _s, _f, _t, _d in STRATEGIES:
    _RULES.setdefault(_s, []).append(f"{_f} {_d} {_t}")
_FOLDS = "b AS (SELECT min(d) AS f FROM trades), k AS (SELECT CAST(i AS INT) AS fold, f + 90 + 30 * CAST(i AS INT) AS a FROM b, range(0, 6) z(i))"
_COMBO = " UNION ALL ".join(f"SELECT '{s}' AS strategy, fold, count(*) AS n, avg(r) AS mean, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS win_rate FROM trades JOIN k ON d BETWEEN a AND a + 29 WHERE {' AND '.join(c)} GROUP BY 2" for s, c in _RULES.items())


def combo_tests(v: Views) -> DataFrame:
    rows = D.assign(v.trades.withColumnRenamed("strategy", "own"), D.monthly(v.trades)).filter("role = 'test'")
    t = C.trades_of(rows, rules(v), "trade_id")
    return t.groupBy("strategy", "fold").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.avg((F.col("r") > 0).cast("int")).alias("win_rate")).filter("n >= 5")


@query("c4_combination_tests", f"WITH {_FOLDS} SELECT * FROM ({_COMBO}) q WHERE n >= 5", "trades", "mean win_rate")
def _(v: Views) -> DataFrame:
    return combo_tests(v).select("strategy", "fold", "n", "mean", "win_rate")


_TRAIN = " UNION ALL ".join(f"SELECT '{s}' AS strategy, fold, avg(r) / stddev_samp(r) * {YEAR} AS train_sharpe FROM trades JOIN k ON d BETWEEN (SELECT min(d) FROM trades) AND a - 1 WHERE {' AND '.join(c)} GROUP BY 2" for s, c in _RULES.items())
_TEST = " UNION ALL ".join(f"SELECT '{s}' AS strategy, fold, count(*) AS n, avg(r) AS m, stddev_samp(r) AS s, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS w FROM trades JOIN k ON d BETWEEN a AND a + 29 WHERE {' AND '.join(c)} GROUP BY 2 HAVING count(*) >= 5" for s, c in _RULES.items())


@query("c6_combination_walk_forward", f"WITH {_FOLDS}, tr AS ({_TRAIN}), te AS ({_TEST}), {evaluated('strategy', 'SELECT te.*, m / s * ' + YEAR + ' AS sharpe, train_sharpe FROM te JOIN tr USING (strategy, fold)', 1.0, 0.5, 0.02, 0.25)}", "trades", EVALUATED, 5)
def _(v: Views) -> DataFrame:
    """Combinations pooled over the test folds, against their training folds, with the gates of a combination."""
    rows = D.assign(v.trades.withColumnRenamed("strategy", "own"), D.monthly(v.trades))
    t = C.trades_of(rows, rules(v), "trade_id")
    sharpe = F.coalesce(F.try_divide(F.avg("r"), F.stddev_samp("r")) * 252**0.5, F.lit(0.0)).alias("sharpe")
    train = t.filter("role = 'train'").groupBy("strategy", "fold").agg(sharpe)
    return H.evaluate(train, combo_tests(v).withColumn("sharpe", F.coalesce(F.try_divide("mean", "std") * 252**0.5, F.lit(0.0))), "strategy", min_sharpe=1.0, min_win=0.5, max_p=0.02, min_d=0.25)


#: Features of the wide cube over trades, and each fold's conditions: above the mean of the feature's training rows.
WIDE = {"qty": "qty", "price": "price", "tax": "tax", "part": "part", "supp": "supp", "discount": "r + tax", "unit": "price / qty", "month": "month(d)", "weekday": "(part + supp) % 7", "size": "part % 50", "zone": "supp % 25"}
_WIDE_ROWS = "wi AS (SELECT d, r, " + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in WIDE.items()) + " FROM trades)"
_CUBE = f"""{_FOLDS}, {_WIDE_ROWS}, fr AS (SELECT fold, CASE WHEN d < a THEN 'train' ELSE 'test' END AS role, wi.* FROM wi JOIN k ON d <= a + 29), th AS (SELECT fold, {', '.join(f'avg({n}) AS t_{n}' for n in WIDE)} FROM fr WHERE role = 'train' GROUP BY 1),
ma AS (SELECT fold, role, r, {' + '.join(f'CASE WHEN {n} > t_{n} THEN {1 << i} ELSE 0 END' for i, n in enumerate(WIDE))} AS mask FROM fr JOIN th USING (fold)), ce AS (SELECT fold, role, mask, count(*) AS n, sum(r) AS s, sum(r * r) AS q, count(*) FILTER (WHERE r > 0) AS w FROM ma GROUP BY 1, 2, 3),
cs AS (SELECT i AS combo FROM range(0, {1 << len(WIDE)}) z(i) WHERE bit_count(i) BETWEEN 2 AND 6), su AS (SELECT fold, role, combo, CAST(sum(n) AS BIGINT) AS n, sum(s) AS s, sum(q) AS q, CAST(sum(w) AS BIGINT) AS w FROM ce JOIN cs ON mask & combo = combo GROUP BY 1, 2, 3),
me AS (SELECT fold, role, combo, n, s / n AS mean, CASE WHEN n > 1 THEN sqrt(greatest((q - s * s / n) / (n - 1), 0)) END AS std, w / CAST(n AS DOUBLE) AS win_rate FROM su)"""


def wide_rows(v: Views) -> tuple[DataFrame, DataFrame]:
    """The rows of the monthly folds with the wide features, written once, and each training fold's mean of each feature."""
    trades = v.trades.select("d", "r", *(F.expr(e).cast("double").alias(n) for n, e in WIDE.items()))
    rows = written(D.assign(trades, D.monthly(trades)))
    means = rows.filter("role = 'train'").groupBy("fold").agg(*(F.avg(n).alias(n) for n in WIDE))
    return rows, means.unpivot("fold", list(WIDE), "feature", "threshold").withColumn("direction", F.lit(">"))


@query("c4_combination_cube", f"WITH {_CUBE} SELECT combo, fold, role, n, mean, std, win_rate FROM me", "trades", "mean std win_rate", 11)
def _(v: Views) -> DataFrame:
    """All 1,474 combinations of two to six of eleven features, by fold and role, in one pass."""
    rows, means = wide_rows(v)
    return C.combination_table(C.masked(rows, means, list(WIDE)), list(WIDE), C.subsets(len(WIDE)), ["fold", "role"])


_ME_SHARPE = f"coalesce(mean / nullif(std, 0) * {YEAR}, 0)"
_CUBE_TESTS = f"SELECT te.combo, te.n, te.mean AS m, te.std AS s, te.win_rate AS w, coalesce(te.mean / nullif(te.std, 0) * {YEAR}, 0) AS sharpe, coalesce(tr.mean / nullif(tr.std, 0) * {YEAR}, 0) AS train_sharpe FROM me te JOIN me tr ON tr.combo = te.combo AND tr.fold = te.fold AND tr.role = 'train' WHERE te.role = 'test' AND te.n >= 5"


@query("c6_combination_cube", f"WITH {_CUBE}, {evaluated('combo', _CUBE_TESTS, 1.0, 0.5, 0.02, 0.25)}", "trades", EVALUATED, 9)
def _(v: Views) -> DataFrame:
    """Walk-forward evaluation of all of them."""
    return C.walk_forward_cube(*wide_rows(v), list(WIDE))


def _growth() -> str:
    """Pairs, then what adds a feature to a passed combination of one less, six at most, as a chain of levels."""
    levels, rows = "l2 AS (SELECT combo FROM cs WHERE bit_count(combo) = 2)", ["SELECT combo, 2 AS size FROM l2"]
    for k in range(3, 7):
        levels += f", l{k} AS (SELECT DISTINCT l.combo | (1 << CAST(i AS INT)) AS combo FROM l{k - 1} l JOIN res USING (combo), range(0, {len(WIDE)}) z(i) WHERE passed AND sharpe > {1.2 if k == 3 else 1.5} AND l.combo & (1 << CAST(i AS INT)) = 0)"
        rows.append(f"SELECT combo, {k} FROM l{k}")
    return f"WITH {_CUBE}, res AS (WITH {evaluated('combo', _CUBE_TESTS, 1.0, 0.5, 0.02, 0.25)}), {levels}, al AS ({' UNION ALL '.join(rows)}) SELECT CAST(combo AS BIGINT) AS combo, CAST(size AS INT) AS size FROM al"


@query("c8_grown_combinations", _growth(), "trades")
def _(v: Views) -> DataFrame:
    """What a growth from pairs to six features tries, pruned by the walk-forward results."""
    results = written(C.walk_forward_cube(*wide_rows(v), list(WIDE)))
    return C.grown(results, len(WIDE))


@query("m8_weights", f"WITH k AS (SELECT strategy, stddev_samp(r) * {YEAR} AS vol FROM trades GROUP BY 1) SELECT strategy, greatest(0.001, least(0.05, 0.15 / vol)) AS risk_parity, greatest(0.001, least(0.05, 0.12 * 0.6 / vol)) AS vol_target FROM k", "trades", "risk_parity vol_target")
def _(v: Views) -> DataFrame:
    k = v.trades.groupBy("strategy").agg((F.stddev_samp("r") * 252**0.5).alias("vol"))
    return k.select("strategy", Z.risk_parity(F.col("vol")).alias("risk_parity"), Z.vol_target(F.col("vol")).alias("vol_target"))
