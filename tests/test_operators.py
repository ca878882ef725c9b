"""Hand-worked rows and properties of the event-study operators."""

from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dist, scalar as S
from tidemark.operators import bars, clean, combos, conditions, costs, features as E, folds, inference as I, joins, metrics as M, profile, regimes, robustness, selection, sizing, thresholds as H
from tidemark.plans import prefix
from tidemark.sources import readers, sinks
from tidemark.streaming import streams as Z


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [(None, 0.0), ("abc", 0.0), (" 12.5 ", 12.5), ("inf", 0.0), ("NaN", 0.0), ("5000", 1000.0), ("-5000", -1000.0), ("", 0.0)])
def test_safe_double(spark, text, want):
    assert one(spark, S.safe_double(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize(("day", "prev", "following"), [(date(2024, 1, 1), date(2023, 12, 29), date(2024, 1, 2)), (date(2024, 1, 5), date(2024, 1, 4), date(2024, 1, 8)), (date(2024, 1, 6), date(2024, 1, 5), date(2024, 1, 8)), (date(2024, 1, 7), date(2024, 1, 5), date(2024, 1, 8))])
def test_business_days(spark, day, prev, following):
    assert one(spark, S.prev_business_day(F.lit(day))) == prev
    assert one(spark, S.next_business_day(F.lit(day))) == following
    assert one(spark, S.reaction_date(F.lit(day), F.lit("amc"))) == following
    assert one(spark, S.reaction_date(F.lit(day), F.lit("bmo"))) == day


@pytest.mark.parametrize(("clock", "want"), [("09:30", 0), ("16:00", 390), ("16:01", None), ("09:29", None), ("N/A", None), (None, None), ("10:05", 35)])
def test_minutes_since_open(spark, clock, want):
    assert one(spark, S.minutes_since_open(F.lit(clock).cast("string"))) == want


def test_cuts_are_right_closed(spark):
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(x,) for x in (None, 1.0, 1.5, 2.0, 2.1)], "x double")
    assert [r[0] for r in df.select(S.cut(F.col("x"), [1.0, 2.0], names)).collect()] == [None, "a", "b", "b", "c"]
    wide = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    assert [r[0] for r in wide.select(S.equal_width(F.col("x"), F.lit(0.0), F.lit(10.0), list("VWXYZ"))).collect()] == list("VVVWWXXYYZZ")
    assert one(spark, S.equal_width(F.lit(3.0), F.lit(3.0), F.lit(3.0), names)) == "a"


def test_zero_denominators_give_null(spark):
    assert one(spark, S.surprise_pct(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, S.pct_change(F.lit(0.0), F.lit(2.0))) is None
    assert one(spark, S.row_std(F.lit(1.0), F.lit(None).cast("double"))) is None
    assert one(spark, S.positive_share(F.lit(None).cast("double"))) == 0.5


def test_sentinels_keep_a_genuine_minus_one_percent(spark):
    df = spark.createDataFrame([(-1.0, -1.0), (-999.0, -999.0), (float("nan"), float("inf"))], "price double, pct double")
    assert [tuple(r) for r in clean.sentinels_to_null(df, ["price"], ["pct"]).collect()] == [(None, -1.0), (-999.0, None), (None, None)]


def test_last_by_key_takes_the_last_value_of_each_column(spark):
    df = spark.createDataFrame([("A", 1, 10, None), ("A", 2, None, "x"), (None, 3, 1, "y")], "k string, t int, a int, b string")
    assert [tuple(r) for r in clean.last_by_key(df, ["k"], ["t"]).collect()] == [("A", 2, 10, "x")]


def test_mad_clip_leaves_small_and_flat_columns(spark):
    df = spark.createDataFrame([(float(i), 1.0) for i in range(9)] + [(1000.0, 1.0)], "a double, b double")
    out = clean.mad_clip(df, ["a", "b"]).agg(F.max("a"), F.max("b")).first()
    assert out[0] == pytest.approx(4.5 + 3.5 * 2.5 / 0.6745)
    assert out[1] == 1.0
    assert clean.mad_clip(df.limit(5), ["a"]).agg(F.max("a")).first()[0] == 4.0


def test_missing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="missing"):
        clean.require(spark.range(1), ["id", "gone"])
    with pytest.raises(ValueError, match="date"):
        clean.resolve_date(spark.range(1))


@pytest.mark.parametrize(("est", "act", "want"), [(None, 1.0, "missing_eps"), (0.0, 1.0, "zero_estimate"), (1.0, -1.0, "negative_actual"), (100.0, 101.0, "low_surprise"), (1.0, 7.0, None), (1.0, 7.5, "high_surprise"), (1.0, 1.5, None)])
def test_candidate_reasons(spark, est, act, want):
    assert one(spark, clean.candidate_reason(F.lit(est).cast("double"), F.lit(act), F.lit(True))) == want


def ts(text):
    return datetime.fromisoformat(f"2024-01-02 {text}")


def test_session_edges(spark):
    rows = [("A", ts("09:29:00"), 1.0, 9.0, 1.0, 1.0, 5), ("A", ts("09:30:00"), 2.0, 5.0, 2.0, 3.0, 7), ("A", ts("12:00:00"), 3.0, 5.0, 1.5, 4.0, 1), ("A", ts("16:00:00"), 4.0, 4.0, 1.5, 3.5, 2), ("A", ts("16:01:00"), 9.0, 99.0, 0.1, 9.0, 3), ("B", ts("05:00:00"), 1.0, 2.0, 0.5, 1.0, 4)]
    df = spark.createDataFrame(rows, "symbol string, t timestamp, o double, h double, l double, c double, v bigint")
    out = {r["symbol"]: r for r in bars.sessions(df).collect()}
    a = out["A"]
    assert (a["open"], a["high"], a["low"], a["close"], a["volume"], a["opening_minute_volume"]) == (2.0, 5.0, 1.5, 3.5, 10, 7)
    assert (a["high_time"], a["low_time"], a["high_before_low"]) == ("09:30", "12:00", 1)  # the first bar of a tie
    assert (a["premarket_high"], a["premarket_volume"]) == (9.0, 5)
    assert (out["B"]["open"], out["B"]["high_before_low"], out["B"]["premarket_low"]) == (None, -1, 0.5)
    r = {x["symbol"]: x for x in bars.interval_returns(df).collect()}
    assert r["A"]["pct_1min"] == pytest.approx(50.0)
    assert r["A"]["pct_1hr"] == pytest.approx(75.0)
    assert bars.interval_returns(df, strict=True).first()["pct_5min"] is None


def test_average_before_is_strict_and_gated(spark):
    s = spark.createDataFrame([("A", date(2024, 1, d), float(d)) for d in range(1, 7)] + [("A", date(2023, 1, 1), 999.0)], "symbol string, session_day date, volume double")
    r = spark.createDataFrame([("A", date(2024, 1, 4)), ("A", date(2024, 1, 7)), ("B", date(2024, 1, 7))], "symbol string, session_day date")
    out = {(x["symbol"], x["session_day"].day): x["avg_volume"] for x in joins.average_before(r, s, 4, 4, 45).collect()}
    assert out == {("A", 4): None, ("A", 7): 4.5, ("B", 7): None}


def test_asof_and_bins(spark):
    s = spark.createDataFrame([("A", date(2024, 1, 2), 10.0), ("A", date(2024, 1, 5), 11.0)], "symbol string, session_day date, close double")
    r = spark.createDataFrame([("A", date(2024, 1, d)) for d in (1, 2, 4, 6)], "symbol string, session_day date")
    assert [x["prev_close"] for x in joins.asof_close(r, s).orderBy("session_day").collect()] == [None, None, 10.0, 11.0]
    b = spark.createDataFrame([(0, 0.0, 2.0, -1.0, 1.0), (1, 1.0, 3.0, -2.0, 2.0)], "ordinal int, range_min double, range_max double, stop_loss double, target_profit double")
    v = spark.createDataFrame([(-0.1,), (0.0,), (1.5,), (2.0,), (3.0,), (None,)], "x double")
    assert [x["bin"] and x["bin"]["ordinal"] for x in joins.match_bin(v, b, F.col("x")).collect()] == [None, 0, 0, 1, None, None]
    assert joins.match_bin(v, b.limit(0), F.col("x")).filter("bin is not null").count() == 0


def test_percent_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("a", None), ("b", 7.0)], "sector string, x double")
    out = E.relative(df, ["x"]).orderBy("sector", F.asc_nulls_first("x")).collect()
    assert [r["x_sector_rank"] for r in out] == [None, 0.25, 0.625, 0.625, 1.0, 1.0]
    from tidemark.plans.prefix import average_ranks

    assert [r["p"] for r in average_ranks(df, "x", "p", ["sector"], share=True).orderBy("sector", F.asc_nulls_first("x")).collect()] == [None, 0.25, 0.625, 0.625, 1.0, 1.0]
    assert out[-1]["x_sector_zscore"] is None


def trades(spark, rows):
    return spark.createDataFrame([(str(i), s, date(2024, 1, 1 + i % 20), r) for i, (s, r) in enumerate(rows)], "trade_id string, strategy string, d date, r double")


def test_metrics_edges(spark):
    t = trades(spark, [("up", 0.1), ("up", 0.1), ("one", 0.2), ("down", -0.1), ("down", 0.3)])
    m = {r["strategy"]: r for r in M.series_metrics(t, ["strategy"]).collect()}
    assert (m["up"]["sharpe"], m["up"]["win_rate"], m["up"]["profit_factor"]) == (0.0, 1.0, None)
    assert (m["one"]["std"], m["one"]["sharpe"]) == (None, 0.0)
    assert m["down"]["profit_factor"] == pytest.approx(3.0)


def test_drawdown(spark):
    r = [0.1, -0.5, 0.2, 0.3, -0.4, 0.9, -0.05]
    t = spark.createDataFrame([(str(i), "s", date(2024, 1, 1 + i // 2), x) for i, x in enumerate(r)] + [("z", "loss", date(2024, 1, 1), -1.0)], "trade_id string, strategy string, d date, r double")
    g, peak, mdd = 1.0, None, 0.0
    for x in r:
        g *= 1 + x
        peak = g if peak is None else max(peak, g)
        mdd = min(mdd, g / peak - 1)
    out = {x["strategy"]: x for x in M.max_drawdown(t, ["strategy"]).collect()}
    assert out["s"]["mdd"] == pytest.approx(mdd)
    assert out["s"]["growth"] == pytest.approx(g)
    assert out["loss"]["growth"] == 0.0


@pytest.mark.parametrize(("t", "df", "p"), [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0), (12.706, 1, 0.05), (3.169, 10, 0.01)])
def test_t_tail(t, df, p):
    assert dist.t_p(t, df) == pytest.approx(p, abs=2e-4)


def test_f_and_power():
    assert dist.f_p(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-4)
    assert dist.f_p(3.4928, 2, 20) == pytest.approx(0.05, abs=1e-3)
    assert dist.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert dist.power(0.5, 34) == pytest.approx(0.8077775013, abs=1e-8)
    assert dist.power(0.0, 30) == pytest.approx(0.05, abs=1e-9) and dist.power(-0.5, 34) == dist.power(0.5, 34)
    assert dist.power(3.0, 10**6) == 1.0 and math.isnan(dist.power(0.5, 1))
    # the noncentral density's integral by Simpson's rule
    for d, n in ((0.25, 30), (1.5, 5), (0.1, 800), (0.3, 2)):
        df, delta, c = n - 1, d * math.sqrt(n), dist.t_critical(n - 1)
        s = [i / 400 for i in range(1, 4001)]
        chi = [math.exp(math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * math.log(x) - df * x * x / 2) for x in s]
        inside = [0.5 * (math.erf((c * x - delta) / math.sqrt(2)) - math.erf((-c * x - delta) / math.sqrt(2))) for x in s]
        middle = sum(a * b * (1 if i == 3999 else 4 if i % 2 == 0 else 2) for i, (a, b) in enumerate(zip(chi, inside, strict=True))) / 1200
        assert dist.power(d, n) == pytest.approx(1 - middle, abs=2e-3 if n == 2 else 1e-6)


def test_corrections_are_ordered(spark):
    ps = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.2, 0.2]
    out = I.adjust(spark.createDataFrame([(f"s{i}", p) for i, p in enumerate(ps)], "strategy string, p double")).orderBy("strategy").collect()
    assert all(r["p_fdr"] <= r["p_holm"] + 1e-12 <= r["p_bonferroni"] + 2e-12 for r in out)
    assert [round(r["p_fdr"], 4) for r in out[:5]] == [0.008, 0.032, 0.0672, 0.0672, 0.0672]
    assert [round(r["p_holm"], 3) for r in out[:3]] == [0.008, 0.056, 0.234]


def test_bootstrap_is_stable_and_covers(spark):
    t = spark.createDataFrame([(str(i), "s", math.sin(i) / 10) for i in range(2000)], "trade_id string, strategy string, r double")
    a, b = (I.bootstrap_ci(I.bootstrap_sums(t.repartition(n), replicates=300)).first() for n in (1, 7))
    assert a["mean_low"] == pytest.approx(b["mean_low"], abs=1e-12)
    m, sd = t.agg(F.avg("r"), F.stddev("r")).first()
    half = 1.96 * sd / 2000**0.5
    assert a["mean_low"] == pytest.approx(m - half, abs=half * 0.25)
    assert a["mean_high"] == pytest.approx(m + half, abs=half * 0.25)


def test_reality_check_separates(spark):
    flat = [(f"{s}{i}", s, math.sin(i * (3 + k)) / 10) for k, s in enumerate("abc") for i in range(400)]
    strong = [(f"z{i}", "z", 0.03 + math.sin(i) / 10) for i in range(400)]
    schema = "trade_id string, strategy string, r double"
    assert I.reality_check(spark.createDataFrame(flat, schema), replicates=200).first()["p"] > 0.2
    assert I.reality_check(spark.createDataFrame(flat + strong, schema), replicates=200).first()["p"] < 0.05


def test_average_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (5.0, 1.0, 3.0, 3.0, None, 9.0)], "x double")
    assert sorted(r["rank"] for r in prefix.average_ranks(df, "x").collect() if r["x"] is not None) == [1.0, 2.5, 2.5, 4.0, 5.0]


def test_quantiles(spark):
    """Exact for outliers, ties, infinities, one value and none, by group."""
    import numpy as np

    from tidemark.plans.prefix import quantile_values, quantiles

    rng = np.random.default_rng(3)
    groups = {"normal": rng.normal(size=501).tolist(), "tail": (rng.pareto(0.3, 400) * rng.choice([-1, 1], 400)).tolist(), "ties": [1.0] * 300 + [2.0] * 100, "one": [5.0], "spread": [*range(50), 1e300, -1e300], "infinite": [float("inf"), 1.0, 2.0, 3.0, 4.0]}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    probs = [0.0, 0.05, 1 / 3, 0.5, 0.75]
    got = {r["g"]: r["q"] for r in quantiles(df, "x", probs, ["g"]).collect()}
    assert set(got) == set(groups)

    def plain(xs, p):
        xs, at = sorted(xs), p * (len(xs) - 1)
        a, b = xs[math.floor(at)], xs[math.ceil(at)]
        return a if a == b else a + (b - a) * (at - math.floor(at))

    for g, xs in groups.items():
        assert got[g] == pytest.approx([plain(xs, p) for p in probs], rel=1e-12), g
    whole = [x for _, x in rows if x is not None]
    assert quantile_values(df, {"a": F.col("x"), "b": F.lit(None)}, [0.5, 0.6]) == {"a": pytest.approx([plain(whole, 0.5), plain(whole, 0.6)]), "b": None}


def test_ranks_with_outliers(spark):
    from tidemark.plans.prefix import average_ranks

    values = [0.1 * i for i in range(100)] + [1e12, -1e12, 0.5, float("inf")]
    out = {r["x"]: r["rank"] for r in average_ranks(spark.createDataFrame([(x,) for x in values], "x double"), "x").collect()}
    for x in values:
        below, same = sum(y < x for y in values), values.count(x)
        assert out[x] == below + (same + 1) / 2


def test_label_codes_of_many_values(spark):
    df = spark.range(12000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("sector")).unionByName(spark.sql("SELECT CAST(NULL AS STRING) AS sector"))
    out = E.label_codes(df).orderBy(F.asc_nulls_last("sector")).collect()
    assert [r["sector_code"] for r in out] == [*range(12000), None]


def test_new_york_sessions(spark):
    """Bars in UTC are cut by New York's clock, in summer and winter."""
    df = spark.createDataFrame([("A", datetime.fromisoformat("2024-01-10 14:29:00"), 1.0), ("A", datetime.fromisoformat("2024-01-10 14:30:00"), 2.0), ("A", datetime.fromisoformat("2024-07-10 13:30:00"), 3.0), ("A", datetime.fromisoformat("2024-07-10 20:00:00"), 4.0), ("A", datetime.fromisoformat("2024-07-10 20:01:00"), 5.0)], "symbol string, t timestamp, o double").selectExpr("*", "o AS h", "o AS l", "o AS c", "10 AS v")
    out = {str(r["session_day"]): r for r in bars.sessions(df, zone=bars.NEW_YORK).collect()}
    assert (out["2024-01-10"]["n_bars"], out["2024-01-10"]["open"], out["2024-01-10"]["premarket_high"]) == (1, 2.0, 1.0)
    assert (out["2024-07-10"]["n_bars"], out["2024-07-10"]["open"], out["2024-07-10"]["close"]) == (2, 3.0, 4.0)


def test_bins(spark):
    df = spark.createDataFrame([(float(i), "abcdefgh"[min(7, i % 11)], -0.1 if i < 60 else 0.2) for i in range(100)], "x double, c string, r double")
    count = lambda label, f: {r["bin"]: r["n"] for r in combos.bin_performance(df, f, label).collect()}
    assert count(combos.width_bins(df, "x", 4), "x") == {"w1": 25, "w2": 25, "w3": 25, "w4": 25}
    assert count(combos.quantile_bins(df, "x"), "x") == {"q1": 25, "q2": 25, "q3": 25, "q4": 25}
    assert set(count(combos.category_bins(df, "c", 3), "c")) == {"h", "a", "b", "other"}
    tree = combos.bin_performance(df, "x", combos.tree_bins(df, "x", depth=1)).orderBy("bin").collect()
    assert tree[0]["mean"] == pytest.approx(-0.1) and tree[1]["mean"] > 0.18  # the cut lies on one of the tree's candidate edges


def test_conditions_partition_rows(spark):
    df = spark.createDataFrame([(float(i), float(i % 7) - 3) for i in range(50)] + [(None, 1.0)], "x double, r double")
    out = conditions.split_stats(df, {"high": F.col("x") > 30, "none": F.lit(False)}, "r").collect()
    assert [(r["condition"], r["n_true"], r["n_false"]) for r in out] == [("high", 19, 32)]


def test_threshold_search_against_a_scan(spark):
    rows = [(i * 7 % 101 / 10, math.sin(i * i) / 10 + (0.05 if i * 7 % 101 > 60 else 0.0)) for i in range(400)]
    df = spark.createDataFrame(rows, "x double, r double")
    long = H.long_features(df, ["x"], ["r"])
    best = H.best(H.threshold_table(long, H.grids(long, ["feature"]), ["feature"]), ["feature"]).first()
    import numpy as np

    x, r = (np.array(v) for v in zip(*rows, strict=True))
    lo, hi = np.quantile(x, [0.05, 0.95])
    found = None
    for t in np.linspace(lo, hi, 50):
        for d, mask in ((">", x > t), ("<=", x <= t)):
            if mask.sum() >= 15:
                s = r[mask].mean() / r[mask].std(ddof=1) * 252**0.5
                if found is None or s > found[0] + 1e-12:
                    found = (s, t, d, int(mask.sum()))
    assert (best["sharpe"], best["threshold"], best["direction"], best["n"]) == (pytest.approx(found[0]), pytest.approx(found[1]), found[2], found[3])


def test_few_values_are_the_grid(spark):
    df = spark.createDataFrame([(float(i % 3), 0.1 * (i % 5)) for i in range(90)], "x double, r double")
    assert H.grids(H.long_features(df, ["x"], ["r"]), ["feature"]).first()["grid"] == [0.0, 1.0, 2.0]


def test_strategies_two_ways(spark):
    rows = spark.createDataFrame([(str(i), float(i), float(i % 4), 0.1) for i in range(20)] + [("n", None, 1.0, 0.1)], "k string, a double, b double, r double")
    c = spark.createDataFrame([("s", "a", 10.0, ">"), ("s", "b", 1.0, "<="), ("t", "a", 3.0, "<=")], "strategy string, feature string, threshold double, direction string")
    x, y = ({tuple(r) for r in f(rows, c, "k").select("strategy", "k").collect()} for f in (combos.trades_of, combos.trades_of_many))
    assert x == y == {("s", k) for k in ("12", "13", "16", "17")} | {("t", str(i)) for i in range(4)}
    assert combos.trades_of(rows, c.limit(0), "k").count() == 0


def test_folds_do_not_overlap(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31', interval 1 day)) d").withColumn("d", F.col("d").cast("date"))
    for f in (folds.expanding(days, embargo_days=3, purge_days=2), folds.monthly(days)):
        rows = {(r["fold"], r["role"]): (r["start"], r["end"]) for r in f.collect()}
        assert rows
        assert all(rows[k, "train"][1] < rows[k, "test"][0] for k, role in rows if role == "test")
    e = {(r["fold"], r["role"]): (r["start"], r["end"]) for r in folds.expanding(days, embargo_days=3, purge_days=2).collect()}
    assert (e[0, "test"][0] - e[0, "train"][1]).days > 5
    assert folds.rolling_rows(500) == [(0, "train", 0, 299), (0, "test", 300, 399), (1, "train", 0, 399), (1, "test", 400, 499)]
    assert [x[2:] for x in folds.rolling_rows(2000)[:2]] == [(0, 999), (1000, 1299)]


def test_regimes(spark):
    s = spark.createDataFrame([(date(2024, 1, 1 + i), 100.0 * 1.1**i) for i in range(10)], "day date, close double")
    out = [r["regime"] for r in regimes.classify(s, frame=3).orderBy("day").collect()]
    assert out[:4] == ["sideways_low_vol"] * 4
    assert set(out[4:]) == {"bull_low_vol"}
    assert regimes.current(regimes.classify(s, frame=3)).first()["regime"] == "bull_low_vol"


def test_costs_and_sizes(spark):
    t = spark.createDataFrame([(100.0, 50.0, 1e10, 1e6, "market_open", "bull_low_vol", False, 0.02)], "shares double, price double, market_cap double, adv double, timeframe string, regime string, is_earnings_day boolean, r double")
    c = costs.net_returns(costs.execution(t)).first()
    assert c["commission"] == pytest.approx(0.5)
    assert c["spread"] == pytest.approx(5000 * 10 * 1.3 * 0.85 / 1e4)
    assert c["timing"] == pytest.approx(7.5)
    assert c["fill_probability"] == pytest.approx(0.83)
    assert c["net_r"] == pytest.approx(0.02 * 0.83 * 0.96 - c["total_cost_bps"] * 2 / 1e4 / 0.83)
    assert one(spark, sizing.risk_parity(F.lit(0.0))) == 0.001
    assert one(spark, sizing.quantity(F.lit(1000.0), F.lit(7.0))) == 42
    t = trades(spark, [("w", 0.1)] * 40 + [("m", 0.1), ("m", -0.05)] * 20)
    k = {r["strategy"]: r["kelly"] for r in sizing.kelly(t, ["strategy"], t.select("strategy").distinct().withColumn("mdd", F.lit(-0.2))).collect()}
    assert k["w"] == 0.01  # no losers
    assert k["m"] == pytest.approx(0.125 * 0.6 * 0.4 / (0.075 * (40 / 39) ** 0.5 * 252**0.5))


def test_robustness(spark):
    t = trades(spark, [("g", 0.02), ("g", 0.03), ("b", -0.02), ("b", 0.03)]).withColumn("sector", F.when(F.col("trade_id").cast("int") % 2 == 0, "x").otherwise("y"))
    out = {r["strategy"]: r["passed"] for r in robustness.by_sector(t).collect()}
    assert out == {"g": True, "b": False}
    s = {r["strategy"]: (r["score"], r["robust"]) for r in robustness.score({"a": robustness.by_sector(t), "b": robustness.by_sector(t)}).collect()}
    assert s == {"g": (1.0, True), "b": (0.0, False)}


def test_selection(spark):
    assert selection.known_by(["surprise", "pct_1min", "pct_30min", "close_position", "return_open_high"], 5) == ["surprise", "pct_1min"]
    df = spark.createDataFrame([(float(i), 2.0 * i, float(i * 7 % 13), float(i > 50)) for i in range(100)], "a double, b double, c double, y double")
    assert selection.correlation_filter(df, ["a", "b", "c"]) == ["a", "c"]
    mi = {r["feature"]: r["mi"] for r in selection.mutual_information(df, ["a", "c"], "y").collect()}
    assert mi["a"] > 0.6 > 0.1 > mi["c"]
    assert selection.lasso(df, ["a", "c"], "y", 0.05) == ["a"]


def test_profiles_of_an_empty_table(spark):
    e = spark.createDataFrame([], "x double, y double, report_date date")
    assert profile.describe(e, ["x"]).first()["n"] == 0
    assert profile.correlations(e, ["x"], ["y"]).first()["corr"] is None
    assert profile.seasonality(e).collect() == []


def test_csv_fallbacks(spark, tmp_path):
    head = ";".join(readers.COLUMNS)
    row = ";".join({"symbol": "ABC", "sector": "Énergie", "surprise": "1.5", "market_cap": "oops", "report_date": "2024-01-02"}.get(c, "") for c in readers.COLUMNS)
    (tmp_path / "r.csv").write_bytes(f"{head}\n{row}\n".encode("latin-1"))
    r = readers.records_csv(spark, str(tmp_path / "r.csv")).first()
    assert (r["sector"], r["surprise"], r["market_cap"]) == ("Énergie", 1.5, None)
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        readers.records_csv(spark, str(tmp_path / "bad.csv"))


def test_csv_encoding_of_whole_files(spark, tmp_path):
    """The first accent lies far behind the head, or in another file; a file in UTF-8 beside them keeps its own."""
    head = ",".join(readers.COLUMNS)

    def row(symbol, sector):
        return ",".join({"symbol": symbol, "sector": sector}.get(c, "") for c in readers.COLUMNS)

    plain = "\n".join(row(f"P{i}", "Energy") for i in range(3000))
    for name, sector, code in (("a", "Plain", "utf-8"), ("b é", "Énergie", "latin-1"), ("c", "Santé", "utf-8")):
        (tmp_path / f"{name}.csv").write_bytes(f"{head}\n{plain}\n{row(name[0].upper(), sector)}\n".encode(code))
    alone = readers.records_csv(spark, str(tmp_path / "b é.csv"))
    assert alone.filter("symbol = 'B'").first()["sector"] == "Énergie"
    rows = readers.records_csv(spark, str(tmp_path))
    assert rows.count() == 9003
    assert {r["symbol"]: r["sector"] for r in rows.filter("length(symbol) = 1").collect()} == {"A": "Plain", "B": "Énergie", "C": "Santé"}


def test_csv_dialects_by_file(spark, tmp_path):
    """Three separators, two encodings, quoted headers, other orders and more columns in one folder, odd names of files."""

    def write(name, sep, code, columns, rows, end="\n", quote=False):
        head = [f'"{c}, ; \t"' if quote and c == "note" else f'"{c}"' if quote else c for c in columns]
        body = [sep.join(r.get(c, "") for c in columns) for r in rows]
        (tmp_path / name).write_bytes(end.join([sep.join(head), *body, ""]).encode(code))

    c = readers.COLUMNS
    write("a [1].csv", ",", "utf-8", c, [{"symbol": "A", "sector": "Santé", "surprise": "1"}])
    write("b.csv", ";", "latin-1", c[::-1], [{"symbol": "B", "sector": "Énergie", "surprise": "2"}, {"symbol": "B2", "sector": "x,y,z", "surprise": "3"}])
    write("c {x}.csv", "\t", "latin-1", [*c, "note"], [{"symbol": "C", "sector": "Größe", "surprise": "4", "note": "n"}], "\r\n", quote=True)
    write("d.csv", ";", "latin-1", c[::-1], [{"symbol": "D", "sector": "plain", "surprise": "5"}])
    (tmp_path / "e.csv").write_bytes(b"")
    rows = {r["symbol"]: (r["sector"], r["surprise"]) for r in readers.records_csv(spark, str(tmp_path)).collect()}
    assert rows == {"A": ("Santé", 1.0), "B": ("Énergie", 2.0), "B2": ("x,y,z", 3.0), "C": ("Größe", 4.0), "D": ("plain", 5.0)}
    found = readers.dialects(spark, str(tmp_path))
    assert sorted((e, s, len(f)) for (e, s, _), f in found.items()) == [("iso-8859-1", "\t", 1), ("iso-8859-1", ";", 1), ("utf-8", ",", 1), ("utf-8", ";", 1)]
    assert readers.records_csv(spark, str(tmp_path / "d.csv"), "utf-8", ";").first()["symbol"] == "D"


def test_json_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text('[{"timestamp": "t", "date": "2024-01-02", "data": [{"symbol": "A", "surprise": 2.5, "volume_comparison": "2.63x"}, {"symbol": "B"}]}]')
    assert [(r["symbol"], r["surprise"]) for r in readers.snapshots_json(spark, str(tmp_path / "s.json")).collect()] == [("A", 2.5), ("B", None)]
    (tmp_path / "c.json").write_text('{"earningsCalendar": [{"symbol": "A", "date": "2024-01-02", "hour": "bmo", "epsActual": 1}, {"symbol": "B", "date": "2024-02-02"}]}')
    assert [r["symbol"] for r in readers.calendar_json(spark, str(tmp_path / "c.json"), date(2024, 1, 1), date(2024, 1, 31)).collect()] == ["A"]
    (tmp_path / "b.json").write_text('{"bins": [{"range_min": 0, "range_max": 1, "stop_loss": -1, "target_profit": 2}]}')
    assert tuple(readers.bins_json(spark, str(tmp_path / "b.json")).first()) == (0, 0.0, 1.0, -1.0, 2.0)


def test_profiles_are_saved(spark, tmp_path):
    sinks.save_profiles({"months": spark.range(3)}, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/months").count() == 3


def test_messages(spark):
    raw = spark.createDataFrame([('{"type":"trade","data":[{"s":"A","p":1.5,"t":1000,"v":2},{"s":"B","p":2,"t":2000}]}',), ('{"type":"ping"}',), ("broken",)], "value string")
    assert [(r["symbol"], r["price"], r["t"].second) for r in Z.parse_messages(raw).collect()] == [("A", 1.5, 1), ("B", 2.0, 2)]


def step(state, price, trail=0.1):
    """One tick of a position, plainly: the new state and the reason to leave, if any."""
    entry, stop, target, peak, hit = state
    pnl = (price - entry) / entry * 100
    if pnl <= stop:
        return state, "STOP_LOSS"
    if not hit:
        return ((entry, stop, target, price, True), None) if pnl >= target else (state, None)
    if price > peak:
        return (entry, stop, target, price, True), None
    return (state, "TRAILING_STOP") if (peak - price) / peak >= trail else (state, None)


def test_exit_steps():
    """Whole batches of prices against one tick after the other, however the prices are dealt to batches."""
    import random

    import numpy as np

    s = (100.0, -5.0, 10.0, 100.0, False)
    assert Z.advance(s, np.array([105.0, 95.0])) == (s, 1, "STOP_LOSS")
    assert Z.advance(s, np.array([110.0, 120.0])) == ((100.0, -5.0, 10.0, 120.0, True), None, None)
    assert Z.advance((100.0, -5.0, 10.0, 120.0, True), np.array([109.0, 108.0]))[1:] == (1, "TRAILING_STOP")
    assert Z.advance(s, np.zeros(0)) == (s, None, None)
    rng = random.Random(4)
    for _ in range(3000):
        want = got = (100.0, rng.choice([-5.0, -20.0]), rng.choice([4.0, 10.0]), 100.0, False)
        price, prices = 100.0, []
        for _ in range(rng.randrange(1, 30)):
            price = max(1.0, price + rng.choice([-8, -3, 0, 0, 2, 3, 9]))
            prices.append(price)
        ended = None
        for i, p in enumerate(prices):
            want, why = step(want, p)
            if why:
                ended = i, why
                break
        cut = rng.randrange(len(prices) + 1)
        got, end, why = Z.advance(got, np.array(prices[:cut]))
        if end is None:
            got, end, why = Z.advance(got, np.array(prices[cut:]))
            end = None if end is None else end + cut
        assert (got, None if why is None else (end, why)) == (want, ended)


def test_keyed_table(spark, tmp_path):
    """A hundred batches leave few parts and files, a repeated or broken batch changes nothing."""
    from tidemark.streaming import keyed

    path, want = f"file://{tmp_path}/table", {}
    schema = "k bigint, v bigint"
    assert keyed.current(spark, path, ["k"], schema).collect() == []
    for b in range(100):
        rows = [((b * 7 + i) % 23, b * 10 + i) for i in range(3)]
        batch = spark.createDataFrame(rows, schema).coalesce(1)
        keyed.add(batch, b, path, ["k"], fan=4)
        want |= dict(rows)
        if b in (40, 63):
            files = sorted(p.name for p in (tmp_path / "table").iterdir())
            keyed.add(batch, b, path, ["k"], fan=4)  # committed already
            keyed.add(spark.createDataFrame([(0, -1)], schema), b - 3, path, ["k"], fan=4)
            assert sorted(p.name for p in (tmp_path / "table").iterdir()) == files
            batch.limit(1).write.parquet(f"{path}/part-{b + 1}-0")  # a batch that broke off before its pointer
        if b % 25 == 0:
            assert dict(map(tuple, keyed.current(spark, path, ["k"], schema).collect())) == want
    assert dict(map(tuple, keyed.current(spark, path, ["k"], schema).collect())) == want
    assert len(keyed.parts(spark, path)) < 4 * 4
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("part-")]) < 2 * 4 * 4
    assert len(list((tmp_path / "table" / "_pointers").glob("[0-9]*"))) <= 3


def test_exit_stream_equals_batch(spark, sf):
    from tidemark.plans.catalog import QUERIES

    a, b = ({(r["symbol"], r["session"]): (r["reason"], round(r["exit_price"], 6)) for r in QUERIES[n](spark, sf).collect()} for n in ("z5_exit_signals", "z5_exit_signals_batch"))
    assert a and a.items() <= b.items()
    assert len(a) >= len(b) - 5  # sessions of the last day are still open


def test_views_pass_shuffle_counts(spark, sf):
    from tidemark.plans.catalog import QUERIES

    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(str, QUERIES["c2_best_threshold"](spark, sf).collect())))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
