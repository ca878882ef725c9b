"""Tests and corrections over small tables of moments; bootstrap over trades."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dist import f_upper, normal_two_sided, poisson, t_power, t_two_sided
from tidemark.plans.prefix import average_ranks, quantiles, with_bins


def welch(split: DataFrame) -> DataFrame:
    """split_stats with Welch's t, its degrees of freedom, p, and Cohen's d (pooled)."""
    a, b = F.col("std_true") ** 2 / F.col("n_true"), F.col("std_false") ** 2 / F.col("n_false")
    n1, n2 = F.col("n_true"), F.col("n_false")
    diff = F.col("mean_true") - F.col("mean_false")
    pooled = F.sqrt(((n1 - 1) * F.col("std_true") ** 2 + (n2 - 1) * F.col("std_false") ** 2) / (n1 + n2 - 2))
    out = split.withColumns({"t": F.try_divide(diff, F.sqrt(a + b)), "df": F.try_divide((a + b) ** 2, a**2 / (n1 - 1) + b**2 / (n2 - 1)), "cohens_d": F.coalesce(F.try_divide(diff, pooled), F.lit(0.0))})
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("df")))


def one_sample(metrics: DataFrame) -> DataFrame:
    """metrics(n, mean, std) with t, p and d = mean / std."""
    out = metrics.withColumns({"t": F.try_divide(F.col("mean") * F.sqrt(F.col("n").cast("double")), F.col("std")), "d": F.try_divide("mean", "std")})
    return out.withColumn("p", t_two_sided(F.col("t"), F.col("n").cast("double") - 1))


def mann_whitney(df: DataFrame, conditions: dict[str, Column], target: str) -> DataFrame:
    """condition, u, z, p: the target is ranked once, ranks are summed by condition (normal approximation with tie
    correction, no continuity correction)."""
    from tidemark.operators.conditions import long_flags

    rows = df.filter(F.col(target).isNotNull())
    ties = rows.groupBy(target).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") ** 3 - F.col("t"))).first()[0] or 0.0
    ranked = average_ranks(rows, target, "_rank")
    g = long_flags(ranked, conditions, ["_rank"]).groupBy("condition").agg(F.count_if("flag").cast("double").alias("n1"), F.count_if(~F.col("flag")).cast("double").alias("n2"), F.sum(F.when(F.col("flag"), F.col("_rank"))).alias("s"))
    n = F.col("n1") + F.col("n2")
    u = F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.try_divide(F.lit(float(ties)), n * (n - 1))))
    out = g.withColumn("u", u).withColumn("z", F.try_divide(F.col("u") - F.col("n1") * F.col("n2") / 2, sd))
    return out.select("condition", "n1", "n2", "u", "z", normal_two_sided(F.col("z")).alias("p"))


def levene(df: DataFrame, conditions: dict[str, Column], target: str) -> DataFrame:
    """condition, w, p: one-way F over absolute deviations from either side's median."""
    from tidemark.operators.conditions import long_flags

    long = long_flags(with_bins(df.filter(F.col(target).isNotNull()), target, [], "_bin"), conditions, [target, "_bin"])
    medians = quantiles(long, target, [0.5], ["condition", "flag"], binned="_bin").select("condition", "flag", F.col("q")[0].alias("m"))
    dev = long.join(F.broadcast(medians), ["condition", "flag"]).withColumn("z", F.abs(F.col(target) - F.col("m")))  # two rows a condition
    g = dev.groupBy("condition", "flag").agg(F.count("z").cast("double").alias("n"), F.avg("z").alias("mean"), F.var_pop("z").alias("var"))
    tot = g.groupBy("condition").agg(F.sum("n").alias("n"), F.count("*").cast("double").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("var")).alias("within"), F.sum(F.col("n") * F.col("mean") ** 2).alias("square"))
    between = F.col("square") - F.col("n") * F.col("grand") ** 2
    out = tot.withColumn("w", F.try_divide((F.col("n") - F.col("k")) * between, (F.col("k") - 1) * F.col("within")))
    return out.filter("k > 1").select("condition", "w", f_upper(F.col("w"), F.col("k") - 1, F.col("n") - F.col("k")).alias("p"))


def adjust(tests: DataFrame, p: str = "p", key: str = "strategy", alpha: float = 0.05) -> DataFrame:
    """tests with Bonferroni, Holm and Benjamini-Hochberg p-values and rejections. One row a test, so one window holds
    them all."""
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(p, key)
    n, i = F.count(p).over(one), F.row_number().over(order)
    out = tests.filter(F.col(p).isNotNull()).withColumns({"_n": n, "_i": i})
    up, down = order.rowsBetween(Window.unboundedPreceding, 0), one.orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    cap = lambda x: F.least(F.lit(1.0), x)
    out = out.withColumns({"p_bonferroni": cap(F.col(p) * F.col("_n")), "p_holm": cap(F.max(F.col(p) * (F.col("_n") - F.col("_i") + 1)).over(up)), "p_fdr": cap(F.min(F.col(p) * F.col("_n") / F.col("_i")).over(down))})
    return out.withColumns({f"reject_{m}": F.col(f"p_{m}") < alpha for m in ("bonferroni", "holm", "fdr")}).drop("_n", "_i")


def quick_adjust(tests: DataFrame, n_tests: int, p: str = "p") -> DataFrame:
    """Bonferroni by all tests tried, and the milder p * log10(tests)."""
    return tests.withColumns({"p_bonferroni": F.least(F.lit(1.0), F.col(p) * n_tests), "p_log": F.least(F.lit(1.0), F.col(p) * F.log10(F.lit(float(max(n_tests, 10)))))})


def gates(tests: DataFrame, min_n: int = 20, max_p: float = 0.05, min_d: float = 0.2, min_power: float = 0.6) -> DataFrame:
    """tests(n, d, p_bonferroni, p_log) with power, the first gate that fails (null: none) and passed."""
    out = tests.withColumn("power", t_power(F.col("d"), F.col("n")))
    reason = F.when(F.col("n") < min_n, "sample").when(F.col("p_log").isNull() | (F.col("p_log") > max_p), "significance").when(F.abs("d") < min_d, "effect").when(F.col("power") < min_power, "power")
    return out.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull())


def wilcoxon(trades: DataFrame, by: str = "strategy", r: str = "r") -> DataFrame:
    """by, n, w, z: signed ranks of the non-zero returns, ties averaged, from distinct sizes with counts."""
    sizes = trades.filter(F.col(r) != 0).groupBy(by, F.abs(r).alias("a")).agg(F.count("*").cast("double").alias("k"), F.count_if(F.col(r) > 0).cast("double").alias("pos"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(by).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    g = sizes.withColumn("rank", before + (F.col("k") + 1) / 2).groupBy(by).agg(F.sum("k").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("w"), F.sum(F.col("k") ** 3 - F.col("k")).alias("ties"))
    n = F.col("n")
    return g.select(by, "n", "w", F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)).alias("z"))


def _uniforms(keys: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Counter-based uniforms: the same for a row wherever it is processed."""
    x = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(replicates, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def bootstrap_sums(trades: DataFrame, key: str = "trade_id", by: str = "strategy", r: str = "r", replicates: int = 1000, seed: int = 7, joint: bool = False) -> DataFrame:
    """by, replicate, w, wr, wrr: Poisson bootstrap. Each partition emits its partial sums, so rows are never multiplied
    by the replicates in a shuffle. Equal returns of a group are counted first and drawn together (a sum of Poisson draws
    is one); joint draws each row by its key instead, so that a row weighs alike in every group. A key of whole numbers is
    taken as it is, any other by its hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for b in batches:
            for name, g in b.groupby("by"):
                acc = total.setdefault(name, np.zeros((3, replicates)))
                once, more = g[g["n"] == 1], g[g["n"] > 1]
                x = once["r"].to_numpy()
                for i in range(0, len(x), 2000):
                    w = poisson(_uniforms(once["key"].to_numpy()[i : i + 2000], replicates, seed))
                    y = x[i : i + 2000]
                    acc += np.stack([w.sum(0), y @ w, (y * y) @ w])
                keys, y, n = (more[c].to_numpy() for c in ("key", "r", "n"))
                for i in range(0, len(y), 2000):  # the draws of one return depend on its key alone
                    w = np.stack([np.random.Generator(np.random.Philox(key=[int(k) & (2**64 - 1), seed])).poisson(m, replicates) for k, m in zip(keys[i : i + 2000], n[i : i + 2000], strict=True)])
                    part = y[i : i + 2000]
                    acc += np.stack([w.sum(0), part @ w, (part * part) @ w])
        for name, acc in total.items():
            yield pd.DataFrame({by: name, "replicate": np.arange(replicates), "w": acc[0], "wr": acc[1], "wrr": acc[2]})

    own = F.col("id").cast("long") if dict(trades.dtypes)[key] in ("bigint", "int") else F.xxhash64("id")
    rows = trades.filter(F.col(r).isNotNull()).select(F.col(by).alias("by"), F.col(key).alias("id"), F.col(r).cast("double").alias("r"))
    rows = rows.select("by", own.alias("key"), "r", F.lit(1).cast("bigint").alias("n")) if joint else rows.groupBy("by", "r").agg(F.count("*").alias("n")).select("by", F.xxhash64("by", "r").alias("key"), "r", "n")
    return rows.mapInPandas(run, f"{by} string, replicate int, w double, wr double, wrr double").groupBy(by, "replicate").agg(*(F.sum(c).alias(c) for c in ("w", "wr", "wrr")))


def bootstrap_ci(sums: DataFrame, by: str = "strategy", level: float = 0.95) -> DataFrame:
    """Intervals of the mean and of the Sharpe ratio."""
    mean = F.try_divide("wr", "w")
    sharpe = F.try_divide(mean, F.sqrt(F.greatest(F.try_divide("wrr", "w") - mean * mean, F.lit(0.0)))) * 252**0.5
    tails = [(1 - level) / 2, (1 + level) / 2]
    g = sums.withColumns({"m": mean, "s": sharpe}).groupBy(by).agg(F.percentile("m", tails).alias("m"), F.percentile("s", tails).alias("s"))
    return g.select(by, F.col("m")[0].alias("mean_low"), F.col("m")[1].alias("mean_high"), F.col("s")[0].alias("sharpe_low"), F.col("s")[1].alias("sharpe_high"))


def difference_ci(df: DataFrame, conditions: dict[str, Column], target: str, key: str, replicates: int = 500, seed: int = 7, level: float = 0.95) -> DataFrame:
    """condition, low, high: the bootstrap interval of the mean where a condition holds minus the mean where not."""
    from tidemark.operators.conditions import long_flags

    long = long_flags(df.filter(F.col(target).isNotNull()), conditions, [key, target]).withColumn("side", F.concat("condition", F.lit("\t"), F.col("flag").cast("string")))
    sums = bootstrap_sums(long, key, "side", target, replicates, seed).withColumns({"condition": F.substring_index("side", "\t", 1), "flag": F.substring_index("side", "\t", -1) == "true", "m": F.try_divide("wr", "w")})
    diff = sums.groupBy("condition", "replicate").agg((F.max(F.when(F.col("flag"), F.col("m"))) - F.max(F.when(~F.col("flag"), F.col("m")))).alias("diff"))
    tails = [(1 - level) / 2, (1 + level) / 2]
    return diff.groupBy("condition").agg(F.percentile("diff", tails).alias("q")).select("condition", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))  # replicates values a condition


def reality_tops(trades: DataFrame, by: str = "strategy", r: str = "r", key: str = "trade_id", replicates: int = 1000, seed: int = 11, joint: bool = True) -> DataFrame:
    """replicate, t: the best t over strategies of centred returns in each replicate. joint: a key of several strategies weighs
    alike in all; where every row is of one strategy alone, joint=False draws equal returns together (see bootstrap_sums)."""
    m = trades.groupBy(by).agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), F.count(r).cast("double").alias("n"))
    sums = bootstrap_sums(trades, key, by, r, replicates, seed, joint).join(m, by)
    t = F.try_divide((F.try_divide("wr", "w") - F.col("mean")) * F.sqrt("n"), F.col("sd"))
    return sums.groupBy("replicate").agg(F.max(t).alias("t"))


def reality_check(trades: DataFrame, by: str = "strategy", r: str = "r", key: str = "trade_id", replicates: int = 1000, seed: int = 11, joint: bool = True) -> DataFrame:
    """White's test: statistic (the best t over strategies), p (share of replicates whose best t over centred returns
    reaches it) and the number of strategies. The standard deviation is the population one. joint as in reality_tops."""
    m = trades.groupBy(by).agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), F.count(r).cast("double").alias("n"))
    statistic, k = m.agg(F.max(F.try_divide(F.col("mean") * F.sqrt("n"), F.col("sd"))), F.count("*")).first()
    top = reality_tops(trades, by, r, key, replicates, seed, joint)
    return top.agg(F.lit(statistic).alias("statistic"), F.avg((F.col("t") >= F.lit(statistic)).cast("double")).alias("p"), F.lit(k).alias("n_strategies"), F.count("*").alias("n_replicates"))


def significant(tests: DataFrame, need: int = 2) -> DataFrame:
    """Combined decision: at least `need` of the three corrections reject and the mean is positive."""
    votes = sum((F.col(f"reject_{m}").cast("int") for m in ("bonferroni", "holm", "fdr")), F.lit(0))
    return tests.withColumn("significant", (votes >= need) & (F.col("mean") > 0))
