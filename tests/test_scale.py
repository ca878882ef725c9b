"""Operators whose work is dealt to tasks of bounded size, against plain versions."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import conditions, selection
from tidemark.plans import prefix


def plain_auc(p, y):
    p, y = np.asarray(p), np.asarray(y)
    a, b = p[y == 1], p[y == 0]
    return ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))


def test_hashed_positions(spark):
    """Positions are dense, follow the hash, and no block holds many rows, whatever the number of rows."""
    for n in (0, 1, 1000, 5000):
        df = spark.range(n).withColumn("h", F.xxhash64("id"))
        rows = prefix.hashed_positions(df, "h", n, block_rows=100).collect()
        assert sorted(r["position"] for r in rows) == list(range(n))
        unsigned = [r["h"] % 2**64 for r in sorted(rows, key=lambda r: r["position"])]
        bits = max(0, math.ceil(math.log2(max(n, 1) / 100)))
        assert [u >> (64 - bits) for u in unsigned] == sorted(u >> (64 - bits) for u in unsigned)
        if n > 1000:
            blocks = df.groupBy(F.shiftrightunsigned("h", 64 - bits)).count()
            assert blocks.agg(F.max("count")).first()[0] < 200


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(2)
    rows = [(i, a := rng.choice([0.0, 1.0, 2.0, 3.0]), b := rng.random(), rng.random(), int(a + b + rng.random() > 2.5)) for i in range(1000)]
    rows += [(i, 3.0, 0.5, 0.5, 1) for i in range(1000, 1400)]  # a group of copies
    return spark.createDataFrame(rows, "id long, a double, b double, noise double, y int").repartition(4).cache()


def test_area_under_the_curve(spark, labelled):
    rows = [(r["a"], r["y"], g) for r in labelled.collect() for g in (0, 1)]
    scored = spark.createDataFrame([(p if g else float(round(p / 2)), y, g) for p, y, g in rows], "p double, y int, g int")
    got = {r["g"]: r["auc"] for r in selection.auc_by(scored, "p", "y", ["g"]).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(plain_auc([p if g else round(p / 2) for p, _, k in rows if k == g], [y for _, y, k in rows if k == g]))


def test_permutation_importance_equals_a_plain_one(spark, labelled):
    """The same permutations drawn plainly, from the hashes' orders, on 1,400 rows."""
    features = ["a", "b", "noise"]
    rows = selection.assemble(labelled, features, "y", scale=False)
    model = selection.LogisticRegression(maxIter=20).fit(rows)
    got = {r["feature"]: r["importance"] for r in selection.permutation_importance(labelled, model, features, "y", 3, block_rows=64).collect()}
    base = labelled.withColumn("_row", F.monotonically_increasing_id())
    hashes = base.select("_row", "y", *features, F.xxhash64(F.lit(0), "_row").alias("home"), *(F.xxhash64(F.lit(0), "_row", F.lit(i), F.lit(k)).alias(f"h{i}{k}") for i in range(3) for k in range(3))).collect()
    w, c = model.coefficients.toArray(), model.intercept
    unsigned = lambda v: v % 2**64
    home = sorted(hashes, key=lambda r: unsigned(r["home"]))
    x, y = np.array([[r[f] for f in features] for r in home]), np.array([r["y"] for r in home])
    whole = plain_auc(x @ w + c, y)
    for i, f in enumerate(features):
        losses = []
        for k in range(3):
            moved = x.copy()
            moved[:, i] = [r[f] for r in sorted(hashes, key=lambda r: unsigned(r[f"h{i}{k}"]))]
            losses.append(whole - plain_auc(moved @ w + c, y))
        assert got[f] == pytest.approx(np.mean(losses), abs=1e-9)
    assert got["a"] > got["b"] > got["noise"] - 0.01


def test_quantiles_of_columns(spark):
    rng = random.Random(1)
    values = {"normal": [rng.gauss(0, 1) for _ in range(5000)], "ties": [float(rng.randrange(3)) for _ in range(5000)], "wild": [rng.gauss(0, 1) ** 9 * 1e6 for _ in range(5000)], "one": [7.0] * 5000, "none": [None] * 5000, "some": [rng.random() if i % 50 == 0 else None for i in range(5000)]}
    df = spark.createDataFrame(list(zip(*values.values(), strict=True)), ", ".join(f"{k} double" for k in values)).repartition(3)
    probs = [0.0, 0.013, 0.5, 0.77, 1.0]
    got = prefix.quantile_values(df, {k: F.col(k) for k in values}, probs)
    for k, xs in values.items():
        xs = [x for x in xs if x is not None]
        assert got[k] == (None if not xs else pytest.approx(list(np.quantile(xs, probs)), rel=1e-12, abs=1e-12))


def test_condition_splits_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1) if rng.random() < 0.9 else None, rng.choice([None, "x", "y"]), rng.choice([rng.gauss(0.1, 1), 0.5, None])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a double, b string, r double").repartition(4)
    tests = {"a_up": lambda a, b: a is not None and a > 0, "x": lambda a, b: b == "x", "both": lambda a, b: b == "y" and a is not None and a < 1, "never": lambda a, b: False, "few": lambda a, b: a is not None and a > 2.9}
    made = {"a_up": F.col("a") > 0, "x": F.col("b") == "x", "both": (F.col("b") == "y") & (F.col("a") < 1), "never": F.lit(False), "few": F.col("a") > 2.9}
    for medians in (True, False):
        got = {r["condition"]: r.asDict() for r in conditions.split_stats(df, made, "r", medians=medians).collect()}
        for name, test in tests.items():
            sides = {side: np.array([r for a, b, r in rows if r is not None and test(a, b) is flag]) for side, flag in (("true", True), ("false", False))}
            if min(map(len, sides.values())) < 3:
                assert name not in got
                continue
            for side, x in sides.items():
                want = {"n": len(x), "mean": x.mean(), "std": x.std(ddof=1), "win_rate": (x > 0).mean()} | ({"median": np.median(x)} if medians else {})
                assert {k: got[name][f"{k}_{side}"] for k in want} == pytest.approx(want)


def test_masks(spark):
    df = spark.range(16)
    rows = df.select("id", conditions.mask_of([F.col("id") % 2 == 1, F.lit(None).cast("boolean"), F.col("id") > 7]).alias("m")).collect()
    assert all(r["m"] == (r["id"] % 2) | 4 * (r["id"] > 7) for r in rows)
    with pytest.raises(ValueError, match="conditions"):
        conditions.mask_of(list(itertools.repeat(F.lit(True), 63)))


def test_combination_cube_equals_plain_tests(spark):
    """All 2,431 combinations of three to six of twelve features, one pass, against plain masks."""
    from tidemark.operators import combos

    rng = np.random.default_rng(5)
    n, features = 3000, [f"f{i}" for i in range(12)]
    x, r = rng.normal(size=(n, 12)), rng.normal(0.01, 1, n)
    x[rng.random((n, 12)) < 0.05] = np.nan
    fold, role = rng.integers(0, 2, n), np.where(rng.random(n) < 0.6, "train", "test")
    rows = spark.createDataFrame([(int(f), str(o), float(y), *(None if np.isnan(v) else float(v) for v in row)) for f, o, y, row in zip(fold, role, r, x, strict=True)], "fold int, role string, r double, " + ", ".join(f"{f} double" for f in features)).repartition(4)
    rules = [(k, f, float(rng.normal() / 2), ">" if rng.random() < 0.7 else "<=") for k in (0, 1) for f in features if (k, f) != (1, "f3")]
    conditions = spark.createDataFrame(rules, "fold int, feature string, threshold double, direction string")
    wanted = combos.subsets(12, 3)
    assert len(wanted) == 220 + 495 + 792 + 924
    marked = combos.masked(rows, conditions, features)
    got = {(g["fold"], g["role"], g["combo"]): g for g in combos.combination_table(marked, features, wanted, ["fold", "role"]).collect()}
    met = np.zeros((n, 12), bool)
    for k, f, t, d in rules:
        i = features.index(f)
        with np.errstate(invalid="ignore"):
            met[fold == k, i] = (x[fold == k, i] > t) if d == ">" else (x[fold == k, i] <= t)
    for k in (0, 1):
        for o in ("train", "test"):
            own = (fold == k) & (role == o)
            for c in wanted[::7]:
                hit = r[own & met[:, [i for i in range(12) if c >> i & 1]].all(1)]
                g = got.get((k, o, c))
                assert (g is None) == (len(hit) == 0)
                if len(hit) > 1:
                    assert (g["n"], g["mean"], g["std"], g["win_rate"]) == (len(hit), pytest.approx(hit.mean()), pytest.approx(hit.std(ddof=1)), pytest.approx((hit > 0).mean()))
    plan = combos.combination_table(marked, features, wanted, ["fold", "role"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Cartesian" not in plan  # rows are never multiplied by combinations
    with pytest.raises(ValueError, match="features"):
        combos.masked(rows, conditions, [f"g{i}" for i in range(19)])


def test_growth_is_pruned(spark):
    from tidemark.operators import combos

    good = {0b0011: 1.3, 0b0110: 1.1, 0b0111: 1.6, 0b1111: 2.0}
    rows = [(m, good.get(m, 0.0), m in good) for m in combos.subsets(5)]
    results = spark.createDataFrame(rows, "combo bigint, sharpe double, passed boolean")
    tried = {k: {r["combo"] for r in combos.grown(results, 5).collect() if r["size"] == k} for k in range(2, 7)}
    assert len(tried[2]) == 10 and tried[3] == {0b0111, 0b1011, 0b10011}  # from 0011 alone: 0110 stays below the bar
    assert tried[4] == {0b1111, 0b10111} and tried[5] == {0b11111} and not tried[6]
    scores = spark.createDataFrame([(0b1011, 0.9)], "combo bigint, score double")
    assert {r["combo"] for r in combos.grown(results, 5, scores).collect() if r["size"] > 2} == {0b1011}
    assert [r[0] for r in spark.range(1).select(combos.combo_names(["b", "a", "c"], F.lit(0b011).cast("long"))).collect()] == ["a+b"]


@pytest.fixture(scope="module")
def one_symbol(spark):
    """A symbol that holds nearly all rows, small ones, and nulls."""
    rng = random.Random(6)
    rows = [(i, "hot" if i % 40 else f"s{i % 7}", f"2024-{1 + i // 100:02d}-{1 + i % 28:02d}", rng.choice([rng.gauss(50, 5), 40.0, None])) for i in range(1100)]
    return spark.createDataFrame(rows, "record_id bigint, symbol string, day string, close_price double").withColumn("report_date", F.to_date("day")).withColumn("intraday_vol", F.col("close_price")).repartition(3)


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_windows_over_ranges(spark, one_symbol, parts):
    """The same rows whatever the ranges, also where a range is shorter than a frame; no task holds the hot symbol."""
    from tidemark.operators import features as E

    order = ["report_date", "record_id"]
    cut = prefix.with_halo(one_symbol, ["symbol"], order, 49, parts)
    own = cut.filter("not _halo")
    assert own.drop("_part", "_halo").exceptAll(one_symbol.select(own.drop("_part", "_halo").columns)).isEmpty() and own.count() == 1100
    assert own.groupBy("_part").count().agg(F.max("count")).first()[0] <= 3 * 1100 / parts + 20
    w = prefix.Window.partitionBy("symbol").orderBy(*order)
    calls = {"sma_50": E.moving_averages(one_symbol, parts=parts), "rsi_14": E.rsi(one_symbol, parts=parts), "high_vol_regime": E.vol_regime(one_symbol, 20, parts=parts), "close_price_lag1": E.lags(one_symbol, ["close_price"], parts=parts), "rolling_std": E.rolling_moments(one_symbol, "close_price", 30, "symbol", tuple(order), parts)}
    near = lambda n: w.rowsBetween(1 - n, 0)
    p = F.col("close_price")
    d = one_symbol.withColumn("d", p - F.lag(p).over(w))
    gain, loss = (F.avg(F.when(F.col("d").isNotNull(), F.greatest(s * F.col("d"), F.lit(0.0)))).over(near(14)) for s in (1, -1))
    plain = {
        "sma_50": one_symbol.withColumn("x", F.when(F.count(p).over(near(50)) >= 25, F.avg(p).over(near(50)))),
        "rsi_14": d.withColumn("x", F.when(F.count("d").over(near(14)) == 14, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)))),
        "high_vol_regime": one_symbol.withColumn("x", F.coalesce(((F.count(p).over(near(20)) == 20) & (p > F.percentile(p, 0.75).over(near(20)))).cast("int"), F.lit(0))),
        "close_price_lag1": one_symbol.withColumn("x", F.lag(p).over(w)),
        "rolling_std": one_symbol.withColumn("x", F.stddev_samp(p).over(near(30))),
    }
    for name, df in calls.items():
        got = {r[0]: r[1] for r in df.select("record_id", name).collect()}
        want = {r[0]: r[1] for r in plain[name].select("record_id", "x").collect()}
        assert len(got) == 1100 and all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-9)) for k, v in want.items()), name


def test_grids_without_counting_distinct_values(spark):
    """Few values, however they lie, are the grid; more give 50 points. Crowded bins are looked into."""
    from tidemark.operators import thresholds as H

    rng = random.Random(8)
    groups = {
        "twenty": [float(rng.randrange(20)) for _ in range(500)],
        "more": [float(rng.randrange(21)) for _ in range(500)],
        "crowded": [rng.choice([0.0, 1e-9, 2e-9, 1e9]) for _ in range(500)],  # three values in one bin
        "crowd": [rng.random() * 1e-9 for _ in range(499)] + [1e12],  # many values in one bin
        "one": [3.0] * 100,
        "small": [1.0] * 29,
    }
    rows = [(g, x, 0.0) for g, xs in groups.items() for x in xs]
    long = spark.createDataFrame(rows, "feature string, x double, r double").repartition(4)
    got = {r["feature"]: r["grid"] for r in H.grids(long, ["feature"]).collect()}
    assert set(got) == set(groups) - {"small"}
    for g in ("twenty", "crowded", "one"):
        assert got[g] == sorted(set(groups[g]))
    for g in ("more", "crowd"):
        low, high = np.quantile(groups[g], [0.05, 0.95])
        assert got[g] == pytest.approx(list(np.linspace(low, high, 50)))
    sets = {r["feature"]: r["_values"] for r in H.saturating_sets(long, ["feature"], "x", 20).collect()}
    assert sets["twenty"] == sorted(set(groups["twenty"])) and sets["more"] is None and sets["one"] == [3.0]


def test_feature_quality_without_expand(spark):
    from tidemark.operators import clean

    df = spark.createDataFrame([(float(i % 30), i if i % 10 else None, "x") for i in range(100)], "a double, b long, c string")
    out = clean.feature_quality(df, ["a", "b", "c"])
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["column"]: (round(r["missing"], 6), r["n_distinct"], r["usable"]) for r in out.collect()} == {"a": (0.0, 30, True), "b": (0.1, 90, False), "c": (0.0, 1, False)}
    assert {r["column"]: (r["missing"], r["n_distinct"], r["usable"]) for r in clean.feature_quality(df.limit(0), ["a", "b"]).collect()} == {c: (None, 0, False) for c in "ab"}
    assert clean.feature_quality(df, ["a"], approx=True).first()["column"] == "a"


@pytest.mark.parametrize("parts", [1, 6, 50])
def test_running_values_over_ranges(spark, one_symbol, parts):
    """Sums, products, extremes and last values carry over ranges as a window over the whole group has them."""
    from tidemark.operators import clean, windows as N

    order = ["report_date", "record_id"]
    w = prefix.Window.partitionBy("symbol").orderBy(*order)
    run = w.rowsBetween(prefix.Window.unboundedPreceding, 0)
    p, g = F.col("close_price"), 1 + F.col("close_price") / 1e4
    got = prefix.with_running(one_symbol, ["symbol"], order, {"s": ("sum", p), "p": ("product", g), "hi": ("max", p), "lo": ("min", p), "last": ("last", p)}, parts)
    want = one_symbol.select("record_id", F.sum(p).over(run).alias("s"), F.product(g).over(run).alias("p"), F.max(p).over(run).alias("hi"), F.min(p).over(run).alias("lo"), F.last(p, ignorenulls=True).over(run).alias("last"))
    a, b = ({r["record_id"]: r for r in df.select("record_id", "s", "p", "hi", "lo", "last").collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(a) == 1100
    for k, r in b.items():
        assert [x for x in a[k]] == [None if x is None else pytest.approx(x) for x in r]
    some = one_symbol.withColumn("x", F.coalesce(p / 1e4, F.lit(0.0)))
    a = {r["record_id"]: r for r in N.cumulative(some, "x", "symbol", tuple(order), parts).collect()}
    growth = some.withColumn("g", F.product(1 + F.col("x")).over(run))
    for r in growth.withColumn("top", F.max("g").over(run)).withColumn("t", F.sum("x").over(run)).collect():
        assert (a[r["record_id"]]["growth"], a[r["record_id"]]["peak"], a[r["record_id"]]["total"]) == (pytest.approx(r["g"]), pytest.approx(r["top"]), pytest.approx(r["t"]))
    changes = {r["record_id"]: (r["diff"], r["pct"]) for r in N.differences(one_symbol, "close_price", "symbol", tuple(order), parts).collect()}
    for r in one_symbol.withColumn("b", F.lag(p).over(w)).collect():
        want = None if r["close_price"] is None or r["b"] is None else r["close_price"] - r["b"]
        assert changes[r["record_id"]][0] == (None if want is None else pytest.approx(want))
    filled = clean.forward_fill(one_symbol, ["close_price"], order=order)
    assert filled.filter("close_price IS NULL").isEmpty() and filled.columns == one_symbol.columns


def test_places_and_tops(spark):
    from tidemark.operators import windows as N

    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.randrange(5), rng.choice([rng.random(), None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, day int, x double").repartition(4)
    got = {r["id"]: r["place"] for r in N.places(df, "g", "day", [F.asc_nulls_last("x"), F.asc("id")]).collect()}
    for name in "ab":
        own = sorted((r for r in rows if r[1] == name), key=lambda r: (-r[2], r[3] is None, r[3] or 0, r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    top = {r["id"] for r in N.top_per_group(df, "g", [F.desc("day"), F.asc("id")], 3).collect()}
    assert top == {r[0] for name in "ab" for r in sorted((r for r in rows if r[1] == name), key=lambda r: (-r[2], r[0]))[:3]}
    stats = {r["id"]: r["mean"] for r in N.group_statistics(df.withColumn("g", F.when(F.col("g") == "a", "a")), "x", "g").collect()}
    assert len(stats) == 300
