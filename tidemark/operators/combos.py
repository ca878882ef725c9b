"""Feature combinations: candidates, scores and evaluation as AND-conditions. All on tables with a row a feature."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalar import cut, equal_width
from tidemark.operators.conditions import mask_of
from tidemark.operators.thresholds import passes
from tidemark.plans.prefix import quantile_values

MAX_FEATURES = 200
#: Features of one cube, of which every subset is a cell, and the most members of a combination.
CUBE_FEATURES, MEMBERS = 18, 6


def pair_correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """f1, f2, n, corr for f1 < f2: one pass for all pairs."""
    if len(features) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} features")
    names = sorted(features)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    cell = lambda a, b: F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"), F.corr(a, b).alias("corr"))
    return df.agg(F.array(*(cell(a, b) for a, b in pairs)).alias("x")).select(F.inline("x"))


def _bounded(candidates: DataFrame) -> DataFrame:
    """The distinct candidates, MAX_FEATURES at most."""
    names = [r["feature"] for r in candidates.select("feature").distinct().limit(MAX_FEATURES + 1).collect()]
    if len(names) > MAX_FEATURES:
        raise ValueError(f"more than {MAX_FEATURES} candidates")
    return candidates.sparkSession.createDataFrame([(x,) for x in sorted(names)], "feature string")


def pairs(candidates: DataFrame) -> DataFrame:
    """All ordered pairs of candidates(feature)."""
    candidates = _bounded(candidates)
    a, b = candidates.select(F.col("feature").alias("f1")), candidates.select(F.col("feature").alias("f2"))
    return a.join(F.broadcast(b), F.col("f1") < F.col("f2")).select(F.array("f1", "f2").alias("combo"))  # MAX_FEATURES rows at most


def grow(combos: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every combination with one more candidate, in order of names, so each set appears once."""
    c = _bounded(candidates).select("feature")
    return combos.join(F.broadcast(c), F.col("feature") > F.element_at("combo", -1)).select(F.concat("combo", F.array("feature")).alias("combo"))


def scored(combos: DataFrame, singles: DataFrame, correlated: DataFrame) -> DataFrame:
    """combo, expected_sharpe, avg_correlation and score from the members' singles(feature, sharpe, mdd, win_rate) and
    their pairs' correlations. A combo is keyed by its text."""
    keyed = combos.withColumn("key", F.array_join("combo", "+"))
    members = keyed.select("key", F.explode("combo").alias("feature")).join(singles, "feature").groupBy("key").agg(F.count("*").alias("k"), F.avg("sharpe").alias("avg_sharpe"), F.max(F.abs("mdd")).alias("worst_dd"), F.avg("win_rate").alias("avg_win"))
    each = keyed.select("key", F.explode("combo").alias("f1"), "combo").select("key", "f1", F.explode("combo").alias("f2")).filter("f1 < f2").join(correlated.select("f1", "f2", "corr"), ["f1", "f2"], "left")
    corr = each.groupBy("key").agg(F.avg(F.abs(F.coalesce("corr", F.lit(0.0)))).alias("avg_correlation"))
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    k, c = F.col("k").cast("double"), F.col("avg_correlation")
    out = keyed.join(members, "key").join(corr, "key").withColumn("expected_sharpe", F.col("avg_sharpe") * F.least(F.sqrt(k) * F.sqrt(F.greatest(F.lit(0.1), 1 - c)), F.lit(2.0)))
    parts = {0.4: clip(F.col("expected_sharpe") / 3, 0.0, 1.0), 0.25: 1 - c, 0.15: F.greatest(F.lit(0.0), 1 - F.col("worst_dd") / 0.12), 0.1: F.greatest(F.lit(0.0), (F.col("avg_win") - 0.45) / 0.25) + F.greatest(F.lit(0.5), 1 - (k - 2) * 0.15)}
    return out.withColumn("score", sum((w * x for w, x in parts.items()), F.lit(0.0))).select("combo", "key", "k", "expected_sharpe", "avg_correlation", "score")


def covariance_patterns(correlated: DataFrame, low: float = -0.4, high: float = -0.1, limit: int = 50) -> DataFrame:
    """Pairs of mild negative correlation, and triples of a hub with two such partners."""
    mild = correlated.filter((F.col("corr") > low) & (F.col("corr") < high))
    pair = mild.select(F.lit("pair").alias("kind"), F.array("f1", "f2").alias("combo"), F.abs("corr").alias("strength"))
    ends = mild.select(F.col("f1").alias("hub"), F.col("f2").alias("other"), "corr").unionByName(mild.select(F.col("f2").alias("hub"), F.col("f1").alias("other"), "corr"))
    a, b = ends.alias("a"), ends.alias("b")
    hub = a.join(b, (F.col("a.hub") == F.col("b.hub")) & (F.col("a.other") < F.col("b.other"))).select(F.lit("hub").alias("kind"), F.array("a.hub", "a.other", "b.other").alias("combo"), ((F.abs("a.corr") + F.abs("b.corr")) / 2).alias("strength"))
    return pair.unionByName(hub).orderBy(F.desc("strength"), "kind", F.array_join("combo", "+")).limit(limit)


def trades_of(rows: DataFrame, conditions: DataFrame, key: str, r: str = "r") -> DataFrame:
    """(strategy, key, r) for every row that meets all conditions(strategy, feature, threshold, direction) of a strategy.

    Conditions are a small table: each becomes part of one boolean column a strategy, only hits are exploded, and no row
    is shuffled. Null features fail their condition."""
    rules: dict[str, list] = {}
    for c in conditions.collect():
        rules.setdefault(c["strategy"], []).append(c)
    hits = []
    for name in sorted(rules):
        ok = F.lit(True)
        for c in rules[name]:
            ok = ok & passes(F.col(c["feature"]), F.lit(c["threshold"]), F.lit(c["direction"]))
        hits.append(F.when(ok, F.lit(name)))
    names = F.filter(F.array(*hits), lambda h: h.isNotNull()) if hits else F.array().cast("array<string>")
    keep = [c for c in dict.fromkeys([key, r, *[c for c in ("d", "fold", "role", "sector", "regime") if c in rows.columns]])]
    return rows.select(F.explode(names).alias("strategy"), *keep)


def trades_of_many(rows: DataFrame, conditions: DataFrame, key: str, r: str = "r") -> DataFrame:
    """The same for thousands of strategies: they are one array of rules that each row filters, so the plan stays small
    and no row is shuffled."""
    rules: dict[str, list] = {}
    for c in conditions.collect():
        rules.setdefault(c["strategy"], []).append(c)
    features = sorted({c["feature"] for cs in rules.values() for c in cs})
    if not rules:
        return rows.select(F.lit("").alias("strategy"), key, r).limit(0)
    rule = lambda c: F.struct(F.lit(features.index(c["feature"]) + 1).alias("i"), F.lit(float(c["threshold"])).alias("t"), F.lit(c["direction"] == ">").alias("above"))
    table = F.array(*(F.struct(F.lit(n).alias("strategy"), F.array(*map(rule, rules[n])).alias("rules")) for n in sorted(rules)))
    x = F.array(*(F.col(f).cast("double") for f in features))

    def met(c):
        value = F.element_at(x, c["i"])
        return F.coalesce(F.when(c["above"], value > c["t"]).otherwise(value <= c["t"]), F.lit(False))

    names = F.transform(F.filter(table, lambda s: F.forall(s["rules"], met)), lambda s: s["strategy"])
    return rows.select(F.explode(names).alias("strategy"), key, r)


def masked(rows: DataFrame, conditions: DataFrame, features: list[str], by: str = "fold") -> DataFrame:
    """rows with `mask`: bit i is set where features[i] meets its condition of conditions(by, feature, threshold, direction)
    in the row's group. Null features, and features without a condition, do not."""
    if len(features) > CUBE_FEATURES:
        raise ValueError(f"more than {CUBE_FEATURES} features")
    own = conditions.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("threshold", "direction")))).alias("_c"))
    joined = rows.join(F.broadcast(own), by)  # CUBE_FEATURES entries for each of few groups
    met = lambda f: passes(F.col(f).cast("double"), F.col("_c")[f]["threshold"], F.col("_c")[f]["direction"])
    return joined.withColumn("mask", mask_of([met(f) for f in features])).drop("_c")


def subsets(n: int, low: int = 2, high: int = MEMBERS) -> list[int]:
    """The masks of all combinations of low to high of n features."""
    return [sum(1 << i for i in c) for k in range(low, min(high, n) + 1) for c in combinations(range(n), k)]


def _over_subsets(n: int, wanted: list[int], by: list[str]):
    def run(cells: pa.Table) -> pa.Table:
        """Cells of one group by mask to the sums over all masks that contain each wanted one."""
        sums = np.zeros((4, 1 << n))
        at = cells["mask"].to_numpy()
        for row, c in zip(sums, "nsqw", strict=True):
            row[at] = cells[c].to_numpy()
        for i in range(n):  # adds, feature by feature, the rows that also meet it
            halves = sums.reshape(4, -1, 2, 1 << i)
            halves[:, :, 0] += halves[:, :, 1]
        some = np.array(wanted, np.int64)
        some = some[sums[0, some] > 0]
        columns = [pa.array([cells[c][0].as_py()] * len(some), cells.schema.field(c).type) for c in by]
        return pa.Table.from_arrays([*columns, pa.array(some), *(pa.array(x[some].astype(np.int64) if c in "nw" else x[some]) for c, x in zip("nsqw", sums, strict=True))], [*by, "combo", *"nsqw"])

    return run


def combination_table(rows: DataFrame, features: list[str], wanted: list[int], by: list[str], r: str = "r", min_n: int = 1) -> DataFrame:
    """by, combo (a mask), n, mean, std and win_rate over the rows(by, mask, r) that meet every condition of the combo, for
    all wanted combos in one pass.

    Rows are grouped by their mask first (2 to the number of features cells a group at most, combined before the shuffle).
    A combo's sums are those of all masks that contain it, which one addition a feature and cell finds for every subset at
    once: a thousand combos cost as much as one."""
    y = F.col(r)
    centre = rows.agg(F.avg(r)).first()[0] or 0.0  # keeps the sums of squares small
    cells = rows.filter(y.isNotNull()).groupBy(*by, "mask").agg(F.count("*").alias("n"), F.sum(y - centre).alias("s"), F.sum((y - centre) ** 2).alias("q"), F.count_if(y > 0).alias("w"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by).schema)
    out = cells.groupBy(*by).applyInArrow(_over_subsets(len(features), wanted, by), f"{kinds}, combo bigint, n bigint, s double, q double, w bigint")
    n, mean = F.col("n"), F.col("s") / F.col("n")
    std = F.when(n > 1, F.sqrt(F.greatest((F.col("q") - n * mean * mean) / (n - 1), F.lit(0.0))))
    return out.filter(n >= min_n).select(*by, "combo", "n", (mean + centre).alias("mean"), std.alias("std"), (F.col("w") / n).alias("win_rate"))


def combo_names(features: list[str], combo: Column) -> Column:
    """The members' names, sorted, joined by +."""
    held = [F.when(combo.bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(f)) for i, f in enumerate(features)]
    return F.array_join(F.sort_array(F.filter(F.array(*held), lambda x: x.isNotNull())), "+")


def walk_forward_cube(rows: DataFrame, conditions: DataFrame, features: list[str], wanted: list[int] | None = None, min_test: int = 5, **gates) -> DataFrame:
    """Every wanted combo (all of two to MEMBERS features) over rows(fold, role, r, features): training Sharpe ratio and test
    metrics by fold, pooled, with the gates of a combination. conditions: fold, feature, threshold, direction."""
    from tidemark.operators.thresholds import YEAR, evaluate

    marked = masked(rows, conditions, features)
    table = combination_table(marked, features, subsets(len(features)) if wanted is None else wanted, ["fold", "role"])
    sharpe = F.coalesce(F.try_divide("mean", F.when(F.col("std") > 1e-12, F.col("std"))) * YEAR, F.lit(0.0))
    both = table.withColumn("sharpe", sharpe)
    train = both.filter("role = 'train'").select("combo", "fold", "sharpe")
    test = both.filter((F.col("role") == "test") & (F.col("n") >= min_test)).drop("role")
    return evaluate(train, test, "combo", **({"min_sharpe": 1.0, "min_win": 0.5, "max_p": 0.02, "min_d": 0.25} | gates))


def grown(results: DataFrame, n: int, scores: DataFrame | None = None, pair_sharpe: float = 1.2, more_sharpe: float = 1.5, min_score: float = 0.5, largest: int = MEMBERS) -> DataFrame:
    """combo and size of what a growth from pairs tries: all pairs, then each larger combo that adds one feature to a passed
    combo of one less whose Sharpe ratio is beyond the bar (pair_sharpe for pairs, more_sharpe beyond). results: combo,
    sharpe, passed. With scores(combo, score) only combos above min_score are tried. Small tables: a row a combo."""
    size = lambda c: F.call_function("bit_count", F.col(c))
    known = results.select("combo", "sharpe", "passed")
    if scores is not None:
        scores = scores.filter(F.col("score") > min_score).select("combo")
    level = results.sparkSession.createDataFrame([(m,) for m in subsets(n, 2, 2)], "combo bigint")
    out = level.withColumn("size", F.lit(2))
    for k in range(3, largest + 1):
        bar = pair_sharpe if k == 3 else more_sharpe
        base = level.join(known, "combo").filter(F.col("passed") & (F.col("sharpe") > bar))
        wider = F.array(*(F.when(F.col("combo").bitwiseAND(F.lit(1 << i).cast("long")) == 0, F.col("combo").bitwiseOR(F.lit(1 << i).cast("long"))) for i in range(n)))
        level = base.select(F.explode(F.filter(wider, lambda x: x.isNotNull())).alias("combo")).distinct()
        level = level if scores is None else level.join(scores, "combo", "left_semi")
        out = out.unionByName(level.withColumn("size", size("combo").cast("int")))
    return out


def final_filter(strategies: DataFrame, min_sharpe: float = 0.8, min_win: float = 0.48, max_dd: float = 0.10, min_n: int = 20) -> DataFrame:
    return strategies.filter((F.col("sharpe") >= min_sharpe) & (F.col("win_rate") >= min_win) & (F.abs("mdd") <= max_dd) & (F.col("n") >= min_n)).orderBy(F.desc("sharpe"), "strategy")


def feature_ranking(singles: DataFrame, correlated: DataFrame) -> DataFrame:
    """feature and its score: 70 % own performance, 25 % diversification against good features, 5 % power."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    own = 0.4 * clip(F.col("sharpe") / 3) + 0.2 * clip(F.col("info_ratio") / 5) + 0.2 * F.greatest(F.lit(0.0), 1 - F.abs("mdd") / 0.15) + 0.2 * clip((F.col("win_rate") - 0.4) / 0.3)
    both = correlated.select("f1", "f2", "corr").unionByName(correlated.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "corr"))
    good = singles.filter("sharpe > 0.8").select(F.col("feature").alias("f2"))
    spread = both.join(good, "f2").groupBy(F.col("f1").alias("feature")).agg(F.avg(1 - F.abs(F.coalesce("corr", F.lit(0.0)))).alias("diversification"))
    out = singles.join(spread, "feature", "left").withColumn("diversification", F.coalesce("diversification", F.lit(0.5))).withColumn("individual", own)
    return out.withColumn("total", 0.7 * F.col("individual") + 0.25 * F.col("diversification") + 0.05 * F.least(F.col("power"), F.lit(1.0))).select("feature", "individual", "diversification", "total")


def bin_performance(df: DataFrame, feature: str, label, r: str = "r") -> DataFrame:
    """bin, n, mean, std, win_rate of the returns by a bin label (any Column)."""
    x = F.col(r)
    return df.withColumn("bin", label).filter(F.col("bin").isNotNull() & x.isNotNull()).groupBy(F.lit(feature).alias("feature"), "bin").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("int")).alias("win_rate"))


def width_bins(df: DataFrame, feature: str, n: int = 5) -> Column:
    """A label of n classes of equal width over the feature's range."""
    low, high = df.agg(F.min(feature), F.max(feature)).first()
    return equal_width(F.col(feature), F.lit(low), F.lit(high), [f"w{i}" for i in range(1, n + 1)])


def quantile_bins(df: DataFrame, feature: str, n: int = 4) -> Column:
    """A label of n classes of equal counts."""
    edges = quantile_values(df, {feature: F.col(feature)}, [i / n for i in range(1, n)])[feature]
    return cut(F.col(feature), edges or [], [f"q{i}" for i in range(1, n + 1)])


def category_bins(df: DataFrame, feature: str, k: int = 10) -> Column:
    """The k most frequent values, and `other`."""
    from tidemark.operators.features import top_values

    return F.when(F.col(feature).isin(top_values(df, feature, k)), F.col(feature)).when(F.col(feature).isNotNull(), "other")


def tree_bins(df: DataFrame, feature: str, r: str = "r", depth: int = 2) -> Column:
    """A label by the cuts of a regression tree of the return on the feature."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    rows = VectorAssembler(inputCols=[feature], outputCol="_features", handleInvalid="skip").transform(df.select(F.col(feature).cast("double"), F.col(r).cast("double").alias("label")).dropna())
    tree = DecisionTreeRegressor(featuresCol="_features", maxDepth=depth, minInstancesPerNode=20).fit(rows)
    edges = sorted({float(x) for x in re.findall(r"feature 0 <= (\S+?)\)", tree.toDebugString)})
    return cut(F.col(feature), edges, [f"t{i}" for i in range(1, len(edges) + 2)])


def best_bin(bins: DataFrame, min_n: int = 10) -> DataFrame:
    return bins.filter(F.col("n") >= min_n).groupBy("feature").agg(F.max_by("bin", F.struct("mean", "bin")).alias("bin"), F.max("mean").alias("mean"))


def stop_target_grid(df: DataFrame, stops: list[float], targets: list[float], high: str = "pct_change_high", low: str = "pct_change_low", close: str = "return_open_close_pct") -> DataFrame:
    """stop, target, n, mean outcome: the stop if the low reaches it, else the target if the high does, else the close.
    A row is multiplied by the grid inside its task only; sums leave it."""
    cells = F.array(*(F.struct(F.lit(float(s)).alias("stop"), F.lit(float(t)).alias("target"), F.when(F.col(low) <= s, s).when(F.col(high) >= t, t).otherwise(F.col(close)).alias("outcome")) for s in stops for t in targets))
    rows = df.filter(F.col(high).isNotNull() & F.col(low).isNotNull() & F.col(close).isNotNull())
    return rows.select(F.inline(cells)).groupBy("stop", "target").agg(F.count("*").alias("n"), F.avg("outcome").alias("mean"), F.avg((F.col("outcome") > 0).cast("int")).alias("win_rate"))


def interaction_strength(df: DataFrame, conditions: dict, r: str = "r") -> DataFrame:
    """a, b, n_both, strength: the mean where both hold minus the better mean of one alone."""
    names = sorted(conditions)
    x = F.col(r)
    mean = lambda c: F.avg(F.when(c, x))
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(conditions[a] & conditions[b], x)).alias("n_both"), (mean(conditions[a] & conditions[b]) - F.greatest(mean(conditions[a]), mean(conditions[b]))).alias("strength")) for i, a in enumerate(names) for b in names[i + 1 :]))
    return df.agg(cells.alias("x")).select(F.inline("x"))
