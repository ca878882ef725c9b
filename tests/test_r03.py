"""What the review of round 3 found: overflow, ties and steps that move too many rows or bytes, against plain versions."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics as M


def days(returns):
    return [("a", dt.date(2000, 1, 1) + dt.timedelta(i), i, float(r)) for i, r in enumerate(returns)]


def test_drawdown_beyond_the_range_of_doubles(spark):
    """Growth overflows long before the only drawdown; F3, F4."""
    rows = days([1.0] * 1200 + [-0.5, -0.2, 0.1])
    df = spark.createDataFrame(rows, "strategy string, d date, trade_id long, r double")
    assert M.max_drawdown(df, ["strategy"]).first()["mdd"] == pytest.approx(-0.6)
    one_day = df.withColumn("d", F.lit(dt.date(2000, 1, 1)))
    assert M.max_drawdown(one_day, ["strategy"]).first()["mdd"] == pytest.approx(-0.6)
    span = M.drawdown_span(df.drop("trade_id"), "strategy").first()
    assert (span["mdd"], span["length"]) == (pytest.approx(-0.6), 2)


def test_drawdown_of_all_that_is_lost(spark):
    df = spark.createDataFrame(days([0.5, -1.0, 0.5]), "strategy string, d date, trade_id long, r double")
    assert tuple(M.max_drawdown(df, ["strategy"]).first())[1:] == (0.0, -1.0)


def test_equally_deep_drawdowns(spark):
    """One percent is lost four times from different levels; the first counts, whatever the noise of the products; F2."""
    returns = [0.02, -0.01, 0.02, -0.01, 0.02, -0.01, 0.05, -0.01]
    span = M.drawdown_span(spark.createDataFrame(days(returns), "strategy string, d date, trade_id long, r double").drop("trade_id"), "strategy").first()
    assert (span["peak_day"], span["trough_day"], span["length"]) == (dt.date(2000, 1, 1), dt.date(2000, 1, 2), 1)
    assert math.isclose(span["mdd"], -0.01)


def test_critical_values_are_found_once(spark):
    """Ten thousand powers of one size of sample take one search of the critical value; F10, F13."""
    from tidemark.functions import dist

    dist.t_critical.cache_clear()
    values = [dist.power(i / 1e4, 30.0) for i in range(200)]
    assert dist.t_critical.cache_info().misses == 1 and values == sorted(values)


def test_whole_records_move_once(spark, sf):
    """The columns engineered in one go equal those of the groups one by one, also for records that share a number; F1, F9."""
    from tidemark.operators import features as E
    from tidemark.plans.views import view

    df = view(spark, sf, "records").limit(400).withColumn("symbol", F.concat(F.lit("S"), F.col("record_id") % 3))
    df = E.written(df.unionByName(df.filter("record_id % 50 = 0").withColumn("report_date", F.date_add("report_date", 1))))
    one = df
    for step in (E.premarket, E.market_cap, E.volume, E.intraday, E.vol_regime, E.surprise, E.timing, E.price_action):
        one = step(one)
    one = E.relative(E.written(one), ["surprise", "market_cap_log", "volume_ratio_7_day"])
    one = E.lags(E.one_hot(E.day_regimes(E.interactions(E.written(one)))), ["surprise", "volume_ratio_7_day", "pct_change_close"])
    got = E.engineer(df)
    assert sorted(got.columns) == sorted(one.columns)
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    rows = lambda out: sorted(str([value(r[c]) for c in sorted(out.columns)]) for r in out.collect())
    assert rows(got) == rows(one)


def test_records_are_shuffled_in_one_join(spark, sf, monkeypatch):
    """Two tables of whole records are written, and no range or rank carries one along; F1, F9."""
    from tidemark.operators import features as E
    from tidemark.plans import prefix
    from tidemark.plans.views import view

    widths = []
    ranged, ranks, whole = prefix.ranged, E.with_ranks, E.written
    monkeypatch.setattr(prefix, "ranged", lambda df, *a: (widths.append(len(df.columns)), ranged(df, *a))[1])
    monkeypatch.setattr(E, "with_ranks", lambda df, *a, **k: (widths.append(len(df.columns)), ranks(df, *a, **k))[1])
    tables = []
    monkeypatch.setattr(E, "written", lambda df: (tables.append(1), whole(df))[1])
    E.engineer(view(spark, sf, "records"))
    assert len(tables) == 2 and max(widths) <= 8


@pytest.mark.parametrize("name", ["w9_forward_fill", "w2_rolling_two", "w5_differences"])
def test_ranges_carry_few_columns(spark, sf, monkeypatch, name):
    """A window over one column writes that column, not the whole records; F18-F20."""
    from tidemark.plans import prefix
    from tidemark.plans.catalog import QUERIES

    widths = []
    ranged = prefix.ranged
    monkeypatch.setattr(prefix, "ranged", lambda df, *a: (widths.append(len(df.columns)), ranged(df, *a))[1])
    QUERIES[name](spark, sf)
    assert widths and max(widths) <= 5


def test_reality_check_draws_equal_returns_together(spark, monkeypatch):
    """Disjoint strategies: as many rows reach the draws as there are distinct returns, and the best t has the same spread; F11."""
    from tidemark.operators import inference as I
    from tidemark.plans.catalog import QUERIES

    t = spark.range(6000).select(F.col("id").alias("trade_id"), (F.col("id") % 3).cast("string").alias("strategy"), ((F.col("id") * 7 % 11) / 100 - 0.04).alias("r"))
    whole, few = (I.reality_tops(t, replicates=400, joint=j).agg(F.avg("t"), F.stddev("t"), F.count("*")).first() for j in (True, False))
    assert whole[2] == few[2] == 400 and few[0] == pytest.approx(whole[0], abs=0.15) and few[1] == pytest.approx(whole[1], rel=0.2)
    asked = []
    sums = I.bootstrap_sums
    monkeypatch.setattr(I, "bootstrap_sums", lambda *a, **k: (asked.append(k.get("joint", a[6] if len(a) > 6 else False)), sums(*a, **k))[1])
    QUERIES["i11_reality_check"](spark, "/root/testdata/sf0.001")
    assert asked == [False]


def test_records_are_dealt_into_even_parts(spark, sf):
    """Fits find as many parts as cores, each with its share of every fold, however few tasks the files give; F5, F16."""
    from tidemark.plans import q_models
    from tidemark.plans.registry import Views

    v = Views(spark, sf)
    assert q_models.parts_of(v) == spark.sparkContext.defaultParallelism
    train = q_models.fold_rows(v).filter("fold = 0 AND role = 'train'")
    sizes = [r["count"] for r in train.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1.5 * min(sizes)


def test_filters_do_not_repeat_what_columns_are_made_of(spark, sf):
    """The rows without nulls are filtered from a written table, not in the scan of orders; F5, F16."""
    from tidemark.plans import q_models
    from tidemark.plans.registry import Views

    plan = q_models.prepared(Views(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "o_totalprice" not in plan and len(plan) < 3000


def scored_rows(spark):
    import random

    rng = random.Random(4)
    rows = [(i, m, f, round(rng.random(), 2), float(rng.random() < 0.4)) for m in "ab" for f in (0, 1) for i in range(300)]
    return rows, spark.createDataFrame(rows, "row_id long, model string, fold int, p double, label double")


def test_area_under_the_curve_is_exact(spark):
    """Pairs of rows counted one by one, with ties as half; F5."""
    from tidemark.operators import models as L

    rows, df = scored_rows(spark)
    got = {(r["model"], r["fold"]): r["auc"] for r in L.fold_metrics(df).collect()}
    for m, f in got:
        ones, zeros = ([p for _, a, b, p, y in rows if (a, b) == (m, f) and y == x] for x in (1.0, 0.0))
        won = sum((a > b) + (a == b) / 2 for a in ones for b in zeros)
        assert got[m, f] == pytest.approx(won / len(ones) / len(zeros), abs=1e-12)
    assert len(got) == 4




def test_calibration_of_all_models_in_one_pass(spark):
    """Curves by model equal those of each model alone; F6."""
    from tidemark.operators import models as L

    _, df = scored_rows(spark)
    curve, gap = (sorted(map(tuple, x.collect())) for x in L.calibration(df, by=["model"]))
    for m in "ab":
        own, error = L.calibration(df.filter(F.col("model") == m))
        assert [r[1:] for r in curve if r[0] == m] == [pytest.approx(tuple(r)) for r in sorted(own.collect())]
        assert dict(gap)[m] == pytest.approx(error.first()[0])


def test_ensemble_keeps_the_label(spark):
    """The label comes with the mean, so predictions are grouped once; F7."""
    from tidemark.operators import models as L

    rows, df = scored_rows(spark)
    df = df.withColumn("label", (F.col("row_id") % 2).cast("double"))
    got = {r["row_id"]: (r["p"], r["label"]) for r in L.ensemble(df, also=("label",)).collect()}
    for i in range(300):
        assert got[i] == (pytest.approx(sum(p for k, _, _, p, _ in rows if k == i) / 4), i % 2)


def walked_rows(n=900):
    import random

    rng = random.Random(12)
    first = dt.date(2001, 1, 1)
    # few: three values; crowded: three values in one bin; wide: all differ; some are null
    value = lambda i: (rng.choice([0.0, 1.0, 2.0]), rng.choice([0.0, 1e-9, 2e-9, 1e9]), rng.uniform(-5, 5) if i % 50 else None)
    return [(first + dt.timedelta(i // 6), *(x := value(i)), round(rng.gauss(0.01 * (x[0] > 0), 0.05), 3)) for i in range(n)]


def plain_walk(rows, bounds):
    """Best thresholds and test metrics row by row."""
    import numpy as np

    out = {}
    for fold in sorted({b[0] for b in bounds}):
        span = {role: (a, b) for k, role, a, b in bounds if k == fold}
        for i, f in enumerate(("few", "crowded", "wide")):
            x, r = {}, {}
            for role, (a, b) in span.items():
                have = [t for t in rows if a <= t[0] <= b and t[i + 1] is not None]
                x[role], r[role] = np.array([t[i + 1] for t in have]), np.array([t[4] for t in have])
            values = sorted(set(x["train"]))
            grid = values if len(values) <= 20 else np.linspace(*np.quantile(x["train"], [0.05, 0.95]), 50)
            sides = [(t, d, (lambda z, t=t, d=d: z > t if d == ">" else z <= t)) for t in grid for d in (">", "<=")]
            scored = [(round(r["train"][m].mean() / r["train"][m].std(ddof=1), 12), -t, d, p) for t, d, p in sides if (m := p(x["train"])).sum() >= 15]
            best = max(scored, key=lambda s: s[:3])
            test = r["test"][best[3](x["test"])]
            out[f, fold] = (-best[1], best[2], len(test), test.mean(), test.std(ddof=1), (test > 0).mean())
    return out


def test_folds_that_overlap_are_summed_by_spans(spark):
    """Thresholds and test metrics equal plain ones, and a row is read once however many folds hold it; F12, F15."""
    from tidemark.operators import folds as D, thresholds as H

    rows = walked_rows()
    df = spark.createDataFrame(rows, "d date, few double, crowded double, wide double, r double").repartition(3)
    folds = D.expanding(df)
    bounds = [tuple(b) for b in folds.collect()]
    assert len(bounds) == 6
    at, members = D.spans(folds)
    by_span = df.withColumn("_span", at)
    roles = spark.createDataFrame(members, "_span int, fold int, role string")
    assert sorted(by_span.join(roles, "_span").select("d", "r", "fold", "role").collect()) == sorted(D.assign(df, folds).select("d", "r", "fold", "role").collect())
    cells = H.cells_of(by_span, {"wide": [0.0, 1.0]}, "r", 0.0, max(m[0] for m in members) + 2)  # a span after all folds
    assert cells.agg(F.sum("n")).first()[0] == sum(t[3] is not None for t in rows)
    bests, tests = H.walk_forward(df, ["few", "crowded", "wide"], folds)
    chosen = {(b["feature"], b["fold"]): (b["threshold"], b["direction"]) for b in bests.collect()}
    got = {(t["feature"], t["fold"]): (*chosen[t["feature"], t["fold"]], t["n"], t["mean"], t["std"], t["win_rate"]) for t in tests.collect()}
    want = plain_walk(rows, bounds)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == (pytest.approx(want[k][0]), want[k][1], want[k][2], *(pytest.approx(z) for z in want[k][3:])), k


def test_equal_returns_do_not_deviate(spark):
    """A side whose returns are all equal has no Sharpe ratio, whatever the noise of its sums; F12."""
    from tidemark.operators import thresholds as H

    df = spark.createDataFrame([(float(i % 2), 0.1 if i % 2 else 0.3 * (i % 3)) for i in range(999)], "x double, r double")
    table, _, _ = H.span_tables(df.withColumn("_span", F.lit(0)), ["x"], [(0, 0, "train")])
    got = {(t["threshold"], t["direction"]): (t["n"], t["std"], t["sharpe"]) for t in table.collect()}
    assert got[0.0, ">"] == (499, 0.0, None) and got[1.0, "<="][0] == 999 and got[0.0, "<="][1] > 0.1


def test_matrix_is_a_folder_a_fold_and_role(spark):
    """A fit reads its own rows only, in as many parts as they come, and bins and scales are those of plain numbers; F17."""
    import numpy as np
    from tidemark.operators import models as L

    rows = [(i, f, role, i % 2, float(i * 7 % 101), float(i % 3) if i % 10 else None) for f in (0, 1) for role in ("train", "test") for i in range(200)]
    given = L.written(spark.createDataFrame(rows, "row_id long, fold int, role string, y int, a double, b double").repartition(4))
    m = L.prepared_matrix(given, ["a", "b"], "y")
    assert m.count() == 4 * 180 and m.columns == ["fold", "role", "label", "binned", "scaled"]
    part = m.filter("fold = 0 AND role = 'train'")
    assert all("fold=0/role=train" in x for x in part.inputFiles()) or "PartitionFilters: [isnotnull(fold" in part._jdf.queryExecution().executedPlan().toString()
    train = np.array([r[4:] for r in rows if r[2] == "train" and r[5] is not None])
    edges = [np.unique(np.quantile(train[:, i], [k / L.TREE_BINS for k in range(1, L.TREE_BINS)])) for i in (0, 1)]
    want = sorted((float(r[3]), *(float((edges[i] < r[4 + i] - 1e-12).sum()) for i in (0, 1)), *(float(z) for z in (np.array(r[4:]) - train.mean(0)) / train.std(0, ddof=1))) for r in rows if r[1:3] == (1, "test") and r[5] is not None)
    got = sorted((r["label"], *r["binned"].toArray(), *r["scaled"].toArray()) for r in m.filter("fold = 1 AND role = 'test'").collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose(got, want)
    assert L.prepared_matrix(given.limit(0), ["a", "b"], "y").count() == 0


def test_points_of_a_fold_are_scored_in_one_pass(spark, monkeypatch):
    """The search asks for exact areas once a fold, however many points there are; F17."""
    import random

    from tidemark.operators import models as L

    rng = random.Random(17)
    rows = [(rng.randrange(2), fold, role, rng.randrange(4)) for fold in (0, 1) for role in ("train", "test") for _ in range(300)]
    df = spark.createDataFrame([(f, role, y, float(x + y)) for y, f, role, x in rows], "fold int, role string, y int, a double")
    asked, own = [], L.auc_by
    monkeypatch.setattr(L, "auc_by", lambda *a, **k: (asked.append(a[3]), own(*a, **k))[1])
    out = L.search_all(L.written(df), ["a"], "y", {"logistic": {"C": [1, 10], "penalty": ["l2"]}, "forest": {"numTrees": [5], "maxDepth": [2], "minInstancesPerNode": [1], "featureSubsetStrategy": ["all"]}}, trials=2)
    assert asked == [["model"], ["model"]] and out.count() == 3
    pairs = [(x + y, y) for y, f, role, x in rows if (f, role) == (0, "test")]
    ones, zeros = ([a for a, y in pairs if y == k] for k in (1, 0))
    plain = sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / len(ones) / len(zeros)
    one = next(r for r in out.collect() if r["model"] == "logistic" and r["folds"] == 1)
    assert one["auc"] == pytest.approx(plain, abs=1e-9)


def test_cells_are_read_off_bins(spark, monkeypatch):
    """Thresholds read rows again only in bins that an edge cuts, without Python, and need no percentile pass to place bins; F15."""
    from tidemark.operators import folds as D, thresholds as H

    rows = walked_rows()
    df = spark.createDataFrame(rows, "d date, few double, crowded double, wide double, r double").repartition(3)
    at, members = D.spans(D.expanding(df))
    edges = {"few": [0.0, 2.0], "wide": [-1.5, 0.0, 0.25, 40.0]}
    cells = H.cells_of(df.withColumn("_span", at), edges, "r", 0.1, max(m[0] for m in members) + 2)
    assert "Arrow" not in cells._jdf.queryExecution().executedPlan().toString()
    got = {f: [0] * (len(e) + 1) for f, e in edges.items()}
    sums = {f: [0.0] * (len(e) + 1) for f, e in edges.items()}
    for c in cells.collect():
        i = len(edges[c["feature"]]) if math.isnan(c["x"]) else edges[c["feature"]].index(c["x"])
        got[c["feature"]][i] += c["n"]
        sums[c["feature"]][i] += c["s"]
    for f, k in (("few", 1), ("wide", 3)):
        below = [next((i for i, e in enumerate(edges[f]) if t[k] <= e), len(edges[f])) for t in rows if t[k] is not None]
        assert got[f] == [below.count(i) for i in range(len(edges[f]) + 1)]
        for i in range(len(edges[f]) + 1):
            assert sums[f][i] == pytest.approx(sum(t[4] - 0.1 for t in rows if t[k] is not None and t[k] <= edges[f][-1] and next(j for j, e in enumerate(edges[f]) if t[k] <= e) == i) if i < len(edges[f]) else sum(t[4] - 0.1 for t in rows if t[k] is not None and t[k] > edges[f][-1]), abs=1e-9)
    monkeypatch.setattr(H, "spreads", lambda *_: pytest.fail("percentiles of all rows"))
    assert H.walk_forward(df, ["few", "wide"], D.expanding(df))[1].count() == 6
    assert H.walk_forward(df.limit(9), ["few", "wide"], D.expanding(df.limit(9)))[1].count() == 0


def test_crowded_bins_are_placed_anew(spark, monkeypatch):
    """Grids are exact where one value far out draws all others into one bin, which is then placed by quartiles; F15."""
    import numpy as np
    from tidemark.operators import thresholds as H

    asked, own = [], H.spreads
    monkeypatch.setattr(H, "BLOCK_ROWS", 100)
    monkeypatch.setattr(H, "spreads", lambda rows, f: (asked.append(f), own(rows, f))[1])
    x = [-1e12, *(-5 + i * 7919 % 4001 / 1000 for i in range(4000))]
    df = spark.createDataFrame([(i % 2, v, v / 3 if i else None, float(i % 7)) for i, v in enumerate(x)], "_span int, far double, near double, r double")
    train = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "_span int, fold int")
    at, _ = H.moment_spreads(df, ["far", "near"], "r")
    q, counts = H.span_quantiles(df, ["far", "near"], train, "r", 0.0, at, [0.05, 0.3, 0.95])
    assert asked == [["far"]] and counts.agg(F.sum("_n")).first()[0] == 8001
    got = {(t["feature"], t["fold"]): t["_q"] for t in q.collect()}
    for f, of in (("far", lambda i: x[i]), ("near", lambda i: x[i] / 3 if i else None)):
        for fold in (0, 1):
            have = [v for i in range(len(x)) if (fold or i % 2 == 0) and (v := of(i)) is not None]
            assert got[f, fold] == pytest.approx(list(np.quantile(have, [0.05, 0.3, 0.95])))


def test_bins_ascend_far_below_zero(spark):
    """Bins of ascending values ascend on both sides of the middle; F15."""
    from tidemark.plans.prefix import Spread

    s = Spread(-1e6, 1e6, [-0.5, 0.0, 0.5], 1 << 20)
    bins = [r[0] for r in spark.range(20000).select((F.lit(-1e6) + F.col("id") * 0.01).alias("x")).orderBy("x").select(s.bin(F.col("x"))).collect()]
    assert bins == sorted(bins) and bins[-1] > bins[0]
