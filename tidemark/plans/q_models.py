"""Feature selection and models over records. Distributed fits; results depend on MLlib, so there is no SQL for them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.dist import t_power
from tidemark.operators import combos as C, features as E, folds as D, models as L, selection as G
from tidemark.plans.registry import ORACLES, Views, query
from tidemark.plans.views import view
from tidemark.shared import new_path

FEATURES = ["surprise", "revenue_surprise", "open_gap", "premarket_range", "volume_ratio_7_day", "market_cap_log", "pct_1min", "pct_5min"]


#: Records in a part of the rows that models are fitted on.
PART_ROWS = 250_000

_kept: dict[tuple, tuple] = {}


def _state(v: Views) -> tuple:
    """The files of the tables that records come from, with their sizes and times of change."""
    jvm, conf = v.spark._jvm, v.spark._jsc.hadoopConfiguration()
    out = []
    for table in ("orders", "customer"):
        for name in v.spark.read.parquet(f"{v.sf_dir}/{table}.parquet").inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            status = path.getFileSystem(conf).getFileStatus(path)
            out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def kept(v: Views, name: str, make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """make's table, written once a session and state of the tables, as fits read their rows many times; a folder a value of
    by."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir, name, _state(v))
    if key not in _kept:
        path, df = new_path(v.spark, name), make()
        df.write.parquet(path, partitionBy=list(by) or None)
        _kept[key] = (path, df.schema)
    path, schema = _kept[key]
    return v.spark.read.schema(schema).parquet(path)


def parts_of(v: Views) -> int:
    """Parts that records are dealt into, a multiple of the cores: fits run as many tasks as they find parts, and cache one whole in
    each. Files of equal size are read in as many tasks as there are cores, where one more would double the time."""
    cores, orders = v.spark.sparkContext.defaultParallelism, v.spark.read.parquet(f"{v.sf_dir}/orders.parquet").count()
    return cores * max(1, math.ceil(orders / PART_ROWS / cores))


def prepared(v: Views) -> DataFrame:
    """Rows without nulls. They are left out on reading what is written, as a filter before that would be pushed into the scan
    with all that its columns are made of, once more for each use of a part."""
    return kept(v, "prepared", lambda: _prepared(v)).dropna()


def _prepared(v: Views) -> DataFrame:
    r = E.price_returns(E.volume(E.market_cap(E.premarket(view(v.spark, v.sf_dir, "records", {"orders": parts_of(v)})))))
    return r.select(F.col("record_id").alias("row_id"), F.col("report_date").alias("d"), *FEATURES, F.col("return_open_close").alias("r"), F.when(F.col("return_open_close").isNotNull(), (F.col("return_open_close") > 0).cast("int")).alias("y"))


@query("g1_variance_filter", "SELECT 'surprise' AS feature, var_samp(surprise) AS variance, var_samp(surprise) > 0.01 AS kept FROM records UNION ALL SELECT 'high_before_low', var_samp(high_before_low), var_samp(high_before_low) > 0.01 FROM records UNION ALL SELECT 'constant', 0e0, false FROM records WHERE record_id = 0", "records", "variance", 4)
def _(v: Views) -> DataFrame:
    return G.variance_filter(v.records.withColumn("constant", F.lit(1.0)), ["surprise", "high_before_low", "constant"])


_WALK = ["pct_change_open", "twice", "market_cap", "shifted", "surprise"]
_ABS = lambda a, b: f"coalesce(abs(corr({a}, {b})), 0)"


def _walk_sql() -> str:
    """The walk over the correlations: a feature stays if none that stays before it correlates with it."""
    pairs = ", ".join(f"{_ABS(a, b)} AS {a}__{b}" for i, a in enumerate(_WALK) for b in _WALK[i + 1 :])
    steps = "".join(f", k{i} AS (SELECT *, " + (" AND ".join(f"NOT (keep_{_WALK[j]} AND {_WALK[j]}__{f} > 0.95)" for j in range(i)) or "true") + f" AS keep_{f} FROM {'c' if i == 0 else f'k{i - 1}'})" for i, f in enumerate(_WALK))
    last = f"k{len(_WALK) - 1}"
    return f"WITH x AS (SELECT *, pct_change_open * 2 AS twice, market_cap + 1 AS shifted FROM records), c AS (SELECT {pairs} FROM x){steps} " + " UNION ALL ".join(f"SELECT '{f}' AS feature FROM {last} WHERE keep_{f}" for f in _WALK)


@query("g2_correlation_filter", _walk_sql(), "records")
def _(v: Views) -> DataFrame:
    df = v.records.withColumns({"twice": F.col("pct_change_open") * 2, "shifted": F.col("market_cap") + 1})
    return v.spark.createDataFrame([(f,) for f in G.correlation_filter(df, _WALK)], "feature string")


@query("g3_mutual_information", " UNION ALL ".join(f"SELECT * FROM (WITH q AS (SELECT quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM trades), b AS (SELECT len(list_filter(list_distinct(q), lambda t: t < {c})) AS b, r > 0 AS y FROM trades, q), n AS (SELECT b, y, count(*) AS n FROM b GROUP BY 1, 2), j AS (SELECT n, sum(n) OVER (PARTITION BY b) AS nx, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER () AS t FROM n) SELECT '{c}' AS feature, sum(n / t * ln(n * t / CAST(nx * ny AS DOUBLE))) AS mi FROM j) x" for c in ("qty", "price", "tax")), "trades", "mi", 7)
def _(v: Views) -> DataFrame:
    return G.mutual_information(v.trades.withColumn("y", F.col("r") > 0), ["qty", "price", "tax"], "y")


@query("g4_recursive_elimination")
def _(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(f,) for f in G.recursive_elimination(prepared(v), FEATURES, "y", 5)], "feature string")


@query("g5_lasso")
def _(v: Views) -> DataFrame:
    return v.spark.createDataFrame([(f,) for f in G.lasso(prepared(v), FEATURES, "y", 0.001)], "feature string")


@query("g6_forest_importance")
def _(v: Views) -> DataFrame:
    return G.forest_importance(prepared(v), FEATURES, "y", 20)


@query("g6_permutation_importance")
def _(v: Views) -> DataFrame:
    """Loss of AUC when a column is shuffled, five times each (a seeded MLlib forest, no SQL)."""
    df, some = prepared(v), FEATURES[:3]
    rows = G.assemble(df, some, "y", scale=False)
    forest = L.RandomForestClassifier(numTrees=10, maxDepth=5, seed=7).fit(rows)
    return G.permutation_importance(df, forest, some, "y")


@query("g7_vote")
def _(v: Views) -> DataFrame:
    df = prepared(v)
    known = G.known_by(FEATURES, 5)
    chosen = {"variance": [r["feature"] for r in G.variance_filter(df, known).filter("kept").collect()], "correlation": G.correlation_filter(df, known), "lasso": G.lasso(df, known, "y", 0.001)}
    return G.vote(v.spark, chosen, G.mutual_information(df, known, "y"), 6)


@query("g8_info_ratio", " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, pct_1hr) AS corr, count(*) FILTER (WHERE {c} IS NOT NULL AND pct_1hr IS NOT NULL) AS n, abs(corr({c}, pct_1hr)) * sqrt(count(*) FILTER (WHERE {c} IS NOT NULL AND pct_1hr IS NOT NULL)) AS info_ratio FROM records" for c in ("surprise", "revenue_surprise", "market_cap", "pct_5min")), "records", "corr info_ratio", 5)
def _(v: Views) -> DataFrame:
    return G.info_ratio(v.records, ["surprise", "revenue_surprise", "market_cap", "pct_5min"], "pct_1hr")


def _ranking() -> str:
    from tidemark.plans.q_parts import powered
    from tidemark.plans.q_strategies import _CORR, _F5, _SINGLES, YEAR

    power = powered(f"SELECT feature, n, sharpe / {YEAR} AS d FROM singles")
    ratio = " UNION ALL ".join(f"SELECT '{f}' AS feature, abs(corr({f}, r)) * sqrt(count(*)) AS info_ratio FROM trades" for f in _F5)
    return f"""WITH {_SINGLES}, {_CORR}, {power}, ir AS ({ratio}), bo AS (SELECT f1, f2, corr FROM co UNION ALL SELECT f2, f1, corr FROM co), spr AS (SELECT bo.f1 AS feature, avg(1 - abs(coalesce(corr, 0))) AS dv FROM bo JOIN singles s ON s.feature = bo.f2 AND s.sharpe > 0.8 GROUP BY 1),
x AS (SELECT singles.feature, coalesce(dv, 0.5) AS dv, 0.4 * greatest(0, least(1, sharpe / 3)) + 0.2 * greatest(0, least(1, info_ratio / 5)) + 0.2 * greatest(0, 1 - abs(mdd) / 0.15) + 0.2 * greatest(0, least(1, (win_rate - 0.4) / 0.3)) AS own FROM singles JOIN ir USING (feature) LEFT JOIN spr ON spr.feature = singles.feature)
SELECT x.feature, own AS individual, dv AS diversification, 0.7 * own + 0.25 * dv + 0.05 * least(power, 1) AS total FROM x JOIN pw ON pw.feature = x.feature"""


@query("g9_feature_ranking", _ranking, "trades", "individual diversification total", 5)
def _(v: Views) -> DataFrame:
    from tidemark.plans.q_strategies import _F5, _singles

    corr = C.pair_correlations(v.trades, _F5)
    return C.feature_ranking(_singles(v).join(G.info_ratio(v.trades, _F5, "r").select("feature", "info_ratio"), "feature").withColumn("power", t_power(F.col("sharpe") / 252**0.5, F.col("n"))), corr)


def fold_rows(v: Views) -> DataFrame:
    df = prepared(v)
    return kept(v, "fold-rows", lambda: D.assign(df, D.expanding(df, splits=2)), ("fold", "role"))


def predictions(v: Views) -> DataFrame:
    """Scores of the test rows by the four classifiers over the folds, fitted once a session and folder."""
    return kept(v, "predictions", lambda: L.predict_folds(fold_rows(v), FEATURES, "y", L.classifiers(len(FEATURES))))


def fold_metrics(v: Views) -> DataFrame:
    return kept(v, "fold-metrics", lambda: L.fold_metrics(predictions(v)))


@query("l3_fold_metrics")
def _(v: Views) -> DataFrame:
    return fold_metrics(v)


@query("l2_regressors")
def _(v: Views) -> DataFrame:
    return L.fit_regressors(fold_rows(v), FEATURES, "r")


@query("l4_grid_search")
def _(v: Views) -> DataFrame:
    return L.search(fold_rows(v), FEATURES, "y", {"maxDepth": [3, 5], "numTrees": [10]})


#: A small corner of the grids, so that the query fits each model twice at least.
_CORNER = {"logistic": {"C": [0.01, 1], "penalty": ["l1", "l2"]}, "forest": {"numTrees": [10, 20], "maxDepth": [5], "minInstancesPerNode": [1, 4], "featureSubsetStrategy": ["sqrt"]}, "boosted": {"maxIter": [5, 10], "maxDepth": [3], "stepSize": [0.1, 0.2], "subsamplingRate": [0.8]}, "perceptron": {"hidden": [(10,), (10, 5)]}}


@query("l4_search_all")
def _(v: Views) -> DataFrame:
    """Points of all four models over the folds, the worse half of each model's left out after every fold."""
    return L.search_all(fold_rows(v), FEATURES, "y", _CORNER, trials=2)


@query("l6_calibration")
def _(v: Views) -> DataFrame:
    """The curve of each classifier over ten bins, with its mean gap."""
    curve, gap = L.calibration(predictions(v), by=["model"])
    return curve.join(F.broadcast(gap), "model").select("bin", "n", "mean_p", "rate", "calibration_error", "model")  # gap: a row a model


@query("l7_error_metrics")
def _(v: Views) -> DataFrame:
    return L.error_metrics(predictions(v))


@query("l8_ensemble")
def _(v: Views) -> DataFrame:
    """The mean of the four models by row, and its area under the curve."""
    p = predictions(v)
    mean = E.written(L.ensemble(p, also=("label",)))
    auc = G.auc_by(mean.withColumn("all", F.lit(1)), "p", "label", ["all"]).select("auc")
    return mean.select("row_id", "p").crossJoin(F.broadcast(auc))  # one row


#: Scores that SQL can state too, as two models' probabilities in two folds, with the label of a rising day.
_SCORES = "sc AS (SELECT record_id AS row_id, record_id % 2 AS fold, (close_price - open_price) / open_price > 0 AS y, surprise AS a, pct_1min AS b FROM records WHERE close_price IS NOT NULL AND surprise IS NOT NULL AND pct_1min IS NOT NULL), pr AS (SELECT row_id, 'surprise' AS model, CAST(fold AS INT) AS fold, 1 / (1 + exp(-round(a / 25, 1))) AS p, CASE WHEN y THEN 1e0 ELSE 0e0 END AS label FROM sc UNION ALL SELECT row_id, 'minute', CAST(fold AS INT), 1 / (1 + exp(-round(b, 1))), CASE WHEN y THEN 1e0 ELSE 0e0 END FROM sc)"


def scores(v: Views) -> DataFrame:
    rows = v.records.filter("close_price IS NOT NULL AND surprise IS NOT NULL AND pct_1min IS NOT NULL")
    part = lambda name, x: F.struct(F.lit(name).alias("model"), (1 / (1 + F.exp(-F.round(x, 1)))).alias("p"))
    label = ((F.col("close_price") - F.col("open_price")) / F.col("open_price") > 0).cast("double").alias("label")
    return E.written(rows.select(F.col("record_id").alias("row_id"), (F.col("record_id") % 2).cast("int").alias("fold"), label, F.inline(F.array(part("surprise", F.col("surprise") / 25), part("minute", F.col("pct_1min"))))))


_RANKED = "rk AS (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY p) + (count(*) OVER (PARTITION BY model, fold, p) - 1) / 2e0 AS rk FROM pr)"


@query("l3_metrics_of_scores", f"WITH {_SCORES}, {_RANKED} SELECT model, fold, (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc, avg(-(label * ln(p) + (1 - label) * ln(1 - p))) AS log_loss FROM rk GROUP BY 1, 2", "records", "auc log_loss", 8)
def _(v: Views) -> DataFrame:
    """Exact area under the curve and log loss by model and fold."""
    s = scores(v)
    loss = s.groupBy("model", "fold").agg(L.log_loss(F.col("p"), F.col("label")).alias("log_loss"))
    return G.auc_by(s, "p", "label", ["model", "fold"]).join(loss, ["model", "fold"])


@query("l6_calibration_of_scores", f"WITH {_SCORES}, bi AS (SELECT model, CAST(least(9, floor(p * 10)) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(label) AS rate FROM pr GROUP BY 1, 2) SELECT model, bin, n, mean_p, rate, avg(abs(mean_p - rate)) OVER (PARTITION BY model) AS calibration_error FROM bi", "records", "mean_p rate calibration_error", 8)
def _(v: Views) -> DataFrame:
    curve, gap = L.calibration(scores(v), by=["model"])
    return curve.join(F.broadcast(gap), "model").select("bin", "n", "mean_p", "rate", "calibration_error", "model")  # gap: a row a model


@query("l7_errors_of_scores", f"WITH {_SCORES} SELECT model, avg(abs(p - label)) AS mae, sqrt(avg((p - label) ** 2)) AS rmse FROM pr GROUP BY 1", "records", "mae rmse", 8)
def _(v: Views) -> DataFrame:
    return L.error_metrics(scores(v)).select("model", "mae", "rmse")


@query("l8_ensemble_of_scores", f"WITH {_SCORES}, en AS (SELECT row_id, round(avg(p), 12) AS p, any_value(label) AS label FROM pr GROUP BY 1), ra AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS rk FROM en), au AS (SELECT (sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) AS auc FROM ra) SELECT row_id, p, auc FROM en, au", "records", "p auc", 8)
def _(v: Views) -> DataFrame:
    """The mean of the models by row, and its exact area under the curve."""
    s = scores(v)
    mean = E.written(L.ensemble(s).withColumn("p", F.round("p", 12)).join(s.filter("model = 'minute'").select("row_id", "label"), "row_id"))
    auc = G.auc_by(mean.withColumn("all", F.lit(1)), "p", "label", ["all"]).select("auc")
    return mean.select("row_id", "p").crossJoin(F.broadcast(auc))  # one row


_VOTERS = ["qty", "price", "tax", "part"]


def _vote_sql() -> str:
    mi = ORACLES["g3_mutual_information"]
    strong = " UNION ALL ".join(f"SELECT '{f}' AS feature FROM trades HAVING abs(corr({f}, r)) >= 0.05" for f in _VOTERS)
    wide = " UNION ALL ".join(f"SELECT '{f}' AS feature FROM trades HAVING var_samp({f}) > 0.01" for f in _VOTERS)
    return f"SELECT feature, CAST(count(method) AS BIGINT) AS votes, coalesce(max(mi), 0) AS mi FROM (SELECT feature, 'wide' AS method, NULL AS mi FROM ({wide}) UNION ALL SELECT feature, 'strong', NULL FROM ({strong}) UNION ALL SELECT feature, NULL, mi FROM ({mi})) x GROUP BY 1"


@query("g7_vote_of_filters", _vote_sql, "trades", "mi", 6)
def _(v: Views) -> DataFrame:
    """Votes of two filters, with the mutual information that breaks ties and fills up."""
    from tidemark.operators.profile import correlations

    chosen = {"wide": [r["feature"] for r in G.variance_filter(v.trades, _VOTERS).filter("kept").collect()], "strong": [r["feature"] for r in correlations(v.trades, _VOTERS, ["r"]).filter("abs(corr) >= 0.05").collect()]}
    mi = G.mutual_information(v.trades.withColumn("y", F.col("r") > 0), ["qty", "price", "tax"], "y").withColumn("mi", F.round("mi", 7))
    return G.vote(v.spark, chosen, mi, 10)


@query("r5_ablation")
def _(v: Views) -> DataFrame:
    """Mean return of predicted ups by fold, with all features and with the strongest one set to zero."""
    rows, out = fold_rows(v), None
    for fold in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):
        train, test = (rows.filter((F.col("fold") == fold) & (F.col("role") == x)).withColumn("label", F.col("y").cast("double")) for x in ("train", "test"))
        model = L.pipeline(FEATURES, L.classifiers(len(FEATURES))["logistic"](), scaled=True).fit(train)
        weights = model.stages[-1].coefficients.toArray()
        top = max(zip(FEATURES, weights, strict=True), key=lambda fw: abs(fw[1]))[0]
        for scenario, scored in (("all", model.transform(test)), (f"without {top}", L.ablation(test, model, FEATURES, top))):
            part = scored.filter("prediction = 1").agg(F.lit(fold).alias("fold"), F.lit(scenario).alias("scenario"), F.count("*").alias("n"), F.avg("r").alias("mean"))
            out = part if out is None else out.unionByName(part)
    return out
