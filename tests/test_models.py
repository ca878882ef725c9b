"""The model layer against plain versions: fits on data whose answer is known, and every metric by hand."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_scale import plain_auc
from tidemark.operators import models as L, selection as G

FEATURES = ["strong", "weak", "noise"]


@pytest.fixture(scope="module")
def folded(spark):
    """Rows of two folds; the label follows `strong` mostly and `weak` a little."""
    rng = random.Random(9)
    rows = []
    for i in range(900):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(2 * a + 0.8 * b + rng.gauss(0, 0.7) > 0)
        rows.append((f"r{i}", i % 2, "train" if i < 600 else "test", a, b, c, y, a + 0.5 * b, 1.0 if i % 3 else None))
    return spark.createDataFrame(rows, "row_id string, fold int, role string, strong double, weak double, noise double, y int, r double, gap double").repartition(3).cache()


def test_elimination_keeps_what_matters(folded):
    assert set(G.recursive_elimination(folded, FEATURES, "y", 2)) == {"strong", "weak"}
    assert G.recursive_elimination(folded, FEATURES, "y", 1, model="forest") == ["strong"]


def test_lasso_drops_noise(folded):
    assert G.lasso(folded, FEATURES, "y", 0.05) == ["strong", "weak"]


def test_forest_importance(folded):
    w = {r["feature"]: r["importance"] for r in G.forest_importance(folded, FEATURES, "y", 15).collect()}
    assert w["strong"] > w["weak"] > w["noise"] and sum(w.values()) == pytest.approx(1)


def test_vote(spark):
    mi = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.3), ("d", 0.9)], "feature string, mi double")
    rows = [tuple(r) for r in G.vote(spark, {"x": ["b", "a"], "y": ["a"], "z": ["c"]}, mi, 4).collect()]
    assert rows == [("a", 2, 0.1), ("b", 1, 0.5), ("c", 1, 0.3), ("d", 0, 0.9)]


def test_fold_fits_and_their_metrics(folded):
    predictions, metrics = L.fit_folds(folded, FEATURES, "y", {"logistic": L.classifiers(3)["logistic"], "forest": L.classifiers(3)["forest"]})
    rows = predictions.collect()
    assert len(rows) == 2 * 300
    for m in metrics.collect():
        own = [r for r in rows if (r["model"], r["fold"]) == (m["model"], m["fold"])]
        p, y = [r["p"] for r in own], [int(r["label"]) for r in own]
        assert m["auc"] == pytest.approx(plain_auc(p, y), abs=0.01) and m["auc"] > 0.9
        assert m["log_loss"] == pytest.approx(-np.mean([math.log(max(1e-15, a if b else 1 - a)) for a, b in zip(p, y, strict=True)]))
    mean = {r["row_id"]: r["p"] for r in L.ensemble(predictions).collect()}
    for key in ("r600", "r899"):
        assert mean[key] == pytest.approx(np.mean([r["p"] for r in rows if r["row_id"] == key]))


def test_regressors(folded):
    out = L.fit_regressors(folded, FEATURES, "r").collect()
    assert {(r["model"], r["fold"]) for r in out} == {(m, f) for m in ("forest", "boosted") for f in (0, 1)}
    sd = folded.filter("role = 'test'").agg(F.stddev("r")).first()[0]
    assert all(r["mae"] <= r["rmse"] < 0.6 * sd and r["neg_mse"] == pytest.approx(-r["rmse"] ** 2) for r in out)


def test_calibration_and_errors(spark):
    rng = random.Random(3)
    rows = [("m", p, float(rng.random() < p)) for p in [rng.random() for _ in range(400)]] + [("m", 1.0, 1.0), ("m", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, p double, label double")
    curve, gap = L.calibration(df)
    bins = {}
    for _, p, y in rows:
        bins.setdefault(min(9, int(p * 10)), []).append((p, y))
    got = {r["bin"]: (r["n"], r["mean_p"], r["rate"]) for r in curve.collect()}
    assert got == {b: (len(x), pytest.approx(np.mean([p for p, _ in x])), pytest.approx(np.mean([y for _, y in x]))) for b, x in bins.items()}
    assert gap.first()[0] == pytest.approx(np.mean([abs(np.mean([p for p, _ in x]) - np.mean([y for _, y in x])) for x in bins.values()]))
    e = L.error_metrics(df).first()
    assert (e["mae"], e["rmse"]) == (pytest.approx(np.mean([abs(p - y) for _, p, y in rows])), pytest.approx(np.mean([(p - y) ** 2 for _, p, y in rows]) ** 0.5))
    ranked = sorted(rows, key=lambda r: -r[1])
    hits = np.cumsum([y for _, _, y in ranked])
    precision = hits / np.arange(1, len(ranked) + 1)
    assert e["pr_auc"] == pytest.approx(np.sum(np.diff(np.concatenate([[0], hits])) * precision) / hits[-1], abs=0.02)


def test_ablation(folded):
    model = L.pipeline(FEATURES, L.classifiers(3)["logistic"](), scaled=True).fit(folded.withColumn("label", F.col("y").cast("double")))
    zero = {r["row_id"]: r["p"] for r in L.ablation(folded, model, FEATURES, "strong").select("row_id", L.vector_to_array("probability")[1].alias("p")).collect()}
    plain = {r["row_id"]: r["p"] for r in model.transform(folded.withColumn("strong", F.lit(0.0))).select("row_id", L.vector_to_array("probability")[1].alias("p")).collect()}
    assert zero == plain
    same = L.ablation(folded, model, FEATURES, "other").select("row_id", "prediction")
    assert same.exceptAll(model.transform(folded).select("row_id", "prediction")).isEmpty()


def test_points():
    grid = {"a": [1, 2, 3], "b": ["x", "y"]}
    assert len(L.points(grid, 99)) == 6 and L.points(grid, 3) == L.points(grid, 3)
    assert {tuple(p.values()) for p in L.points(grid, 99)} == {(a, b) for a in (1, 2, 3) for b in "xy"}
    assert set(L.GRIDS) == set(L.classifiers(2))


def test_search_halves_each_model(folded):
    """Every point is fitted on the first fold, half of a model's on the next; the order is that of folds and scores."""
    grids = {"logistic": {"C": [1e-6, 1], "penalty": ["l1", "l2"]}, "forest": {"numTrees": [5], "maxDepth": [1, 4], "minInstancesPerNode": [1], "featureSubsetStrategy": ["all"]}, "boosted": {"maxIter": [3], "maxDepth": [2], "stepSize": [0.1, 0.2], "subsamplingRate": [1.0]}, "perceptron": {"hidden": [(4,)]}}
    rows = [tuple(r) for r in L.search_all(folded, FEATURES, "y", grids, trials=4).collect()]
    count = lambda m, n: sum(r[0] == m and r[2] >= n for r in rows)
    assert {m: (count(m, 1), count(m, 2)) for m in grids} == {"logistic": (4, 2), "forest": (2, 1), "boosted": (2, 1), "perceptron": (1, 1)}
    assert rows == sorted(rows, key=lambda r: (-r[2], -r[3], r[0], r[1]))
    best = {m: next(r for r in rows if r[0] == m) for m in grids}
    assert "C=1" in best["logistic"][1] and "maxDepth=4" in best["forest"][1]  # a C of one in a million shrinks all to zero
    assert all(r[3] > 0.85 for r in best.values())


def test_prepared_matrix(folded):
    m = L.prepared_matrix(folded, FEATURES, "y").select("role", L.vector_to_array("binned").alias("b"), L.vector_to_array("scaled").alias("s")).filter("role = 'train'")
    b, s = (np.array([r[c] for r in m.collect()]) for c in "bs")
    assert b.min() == 0 and b.max() == L.TREE_BINS - 1
    assert all(abs(np.bincount(b[:, i].astype(int)) - 600 / L.TREE_BINS).max() <= 1.5 for i in range(3))
    assert s.mean(0) == pytest.approx([0] * 3, abs=1e-9) and s.std(0, ddof=1) == pytest.approx([1] * 3)
