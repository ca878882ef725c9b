"""Named conditions and the returns on either side of them, all conditions in one grouping of packed masks."""

from __future__ import annotations

from math import ceil, floor

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.features import top_values, written
from tidemark.plans.prefix import BINS, quantile_values, spreads

#: Bits of a mask.
MAX_CONDITIONS = 62

SPIKE_30D, SPIKE_7D = 2.0, 1.5
GAPS = {"small": 0.005, "medium": 0.01, "large": 0.02}


def library(df: DataFrame) -> dict[str, Column]:
    """The condition library over a feature table: fixed, quantile and category conditions and combinations. All
    quantiles come from one pass."""
    probs = [0.1, 0.2, 0.8, 0.9]
    q = quantile_values(df, {"s": F.col("surprise"), "a": F.abs("surprise"), "v": F.col("premarket_volume"), "p": F.col("premarket_range"), "m": F.col("market_cap")}, probs)
    at = lambda n, p: F.lit(q[n][probs.index(p)] if q[n] else None)
    s, v7, v30, gap = F.col("surprise"), F.col("volume_ratio_7_day"), F.col("volume_ratio_30_day"), F.col("open_gap")
    out = {"surprise_very_high": s > at("s", 0.9), "surprise_high": s > at("s", 0.8), "surprise_positive": s > 0, "surprise_negative": s < 0, "surprise_low": s < at("s", 0.2), "surprise_very_low": s < at("s", 0.1), "surprise_large_magnitude": F.abs(s) > at("a", 0.8)}
    out |= {"volume_spike_high": v7 > SPIKE_30D, "volume_spike_medium": v7 > SPIKE_7D, "volume_normal": v7.between(0.8, 1.2), "volume_low": v7 < 0.5, "volume_30d_spike": v30 > SPIKE_7D, "volume_30d_low": v30 < 0.8}
    out |= {f"gap_up_{n}": gap > g for n, g in GAPS.items()} | {f"gap_down_{n}": gap < -g for n, g in GAPS.items()}
    out |= {"premarket_vol_high": F.col("premarket_volume") > at("v", 0.8), "premarket_vol_very_high": F.col("premarket_volume") > at("v", 0.9), "premarket_volatile": F.col("premarket_range") > at("p", 0.8)}
    out |= {"earnings_bmo": F.col("earnings_time") == 0, "earnings_amc": F.col("earnings_time") == 1, "large_cap": F.col("market_cap") > at("m", 0.8), "small_cap": F.col("market_cap") < at("m", 0.2)}
    out |= {f"sector_{x}": F.col("sector") == x for x in top_values(df, "sector", 5)}
    return out | {"surprise_pos_volume_high": (s > 0) & (v7 > SPIKE_7D), "surprise_neg_volume_high": (s < 0) & (v7 > SPIKE_7D)}


def long_flags(df: DataFrame, conditions: dict[str, Column], keep: list) -> DataFrame:
    """keep, condition, flag: a row for each row and condition; a null condition counts as false."""
    flags = F.array(*(F.struct(F.lit(n).alias("condition"), F.coalesce(c, F.lit(False)).alias("flag")) for n, c in conditions.items()))
    return df.select(*keep, F.inline(flags))


def mask_of(conditions: list[Column]) -> Column:
    """A long with bit i set where condition i holds; a null condition counts as false."""
    if len(conditions) > MAX_CONDITIONS:
        raise ValueError(f"more than {MAX_CONDITIONS} conditions")
    out = F.lit(0).cast("long")
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _bit(mask: Column, i: Column) -> Column:
    return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long"))


def split_stats(df: DataFrame, conditions: dict[str, Column], target: str, min_n: int = 3, medians: bool = True) -> DataFrame:
    """condition; n, mean, median, std, win_rate of the target where the condition holds (_true) and where not (_false).

    Each row's conditions are packed into one mask, written with the target (16 bytes a row). Moments are grouped by mask and
    bin of the target; only these cells are multiplied by the conditions they meet, and their sums, BINS rows a condition at
    most, reach the driver. The sums where a condition fails are those of all rows less those where it holds. For the
    medians a second grouping looks into the one or two bins that hold a side's middle rank."""
    spark, names = df.sparkSession, list(conditions)
    rows = written(df.filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("x"), mask_of(list(conditions.values())).alias("mask")))
    spread = spreads(rows, ["x"])["x"] if medians else None
    bin_of = spread.bin(F.col("x")) if spread else F.lit(0)
    centre = rows.agg(F.avg("x")).first()[0] or 0.0 if spread is None else spread.middle if spread.some else 0.0  # keeps the sums of squares small
    y = F.col("x") - centre
    cells = rows.groupBy("mask", bin_of.alias("bin")).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"), F.count_if(F.col("x") > 0).alias("w"))
    m = len(names)
    met = F.filter(F.sequence(F.lit(0), F.lit(max(m - 1, 0))), lambda i: _bit(F.col("mask"), i) == 1)
    found = cells.select(F.explode(F.concat(F.array(F.lit(m)), met)).alias("i"), "bin", *"nsqw").groupBy("i", "bin").agg(*(F.sum(c).alias(c) for c in "nsqw")).toArrow()
    at = found["i"].to_numpy(), found["bin"].to_numpy()
    held = {c: np.zeros((m + 1, BINS)) for c in "nsqw"}
    for c, x in held.items():
        x[at] = found[c].to_numpy()
    sides = {(i, side): {c: x[i] if side else x[m] - x[i] for c, x in held.items()} for i in range(m) for side in (True, False)}
    middle = _middles(rows, bin_of, {k: v["n"] for k, v in sides.items()}) if medians else {}
    out = []
    for i, name in enumerate(names):
        stats = []
        for side in (True, False):
            n, total, square, wins = (float(sides[i, side][c].sum()) for c in "nsqw")
            mean = total / n if n else 0.0
            std = (max(square - n * mean * mean, 0.0) / (n - 1)) ** 0.5 if n > 1 else None
            stats.append({"n": int(n), "mean": mean + centre, "std": std, "win_rate": wins / n if n else None} | ({"median": middle.get((i, side))} if medians else {}))
        if min(x["n"] for x in stats) >= min_n:
            out.append((name, *(x[k] for k in stats[0] for x in stats)))
    kinds = {"n": "bigint", "mean": "double", "std": "double", "win_rate": "double"} | ({"median": "double"} if medians else {})
    return spark.createDataFrame(out, "condition string, " + ", ".join(f"{k}_{side} {t}" for k, t in kinds.items() for side in ("true", "false")))


def _middles(rows: DataFrame, bin_of: Column, counts: dict[tuple[int, bool], np.ndarray]) -> dict[tuple[int, bool], float]:
    """The median of each condition and side from its counts by bin: two ranks each are looked up."""
    asked, wanted = [], {}
    for (i, side), n in counts.items():
        upto, total = np.cumsum(n), n.sum()
        if total:
            ranks = wanted[i, side] = floor((total - 1) / 2), ceil((total - 1) / 2)
            asked += [(i, int(side), int(b), int(upto[b] - n[b])) for b in {int(np.searchsorted(upto, k, "right")) for k in ranks}]
    if not asked:
        return {}
    table = rows.sparkSession.createDataFrame(asked, "i int, side int, bin int, before bigint")
    near = rows.withColumn("bin", bin_of).filter(F.col("bin").isin(sorted({a[2] for a in asked}))).groupBy("bin", "x", "mask").agg(F.count("*").alias("c"))
    some = near.join(F.broadcast(table), "bin").filter(_bit(F.col("mask"), F.col("i")) == F.col("side"))  # two rows a condition and side at most
    order = Window.partitionBy("i", "side", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    upto = some.groupBy("i", "side", "bin", "before", "x").agg(F.sum("c").alias("c")).withColumn("to", F.col("before") + F.sum("c").over(order))
    keys = rows.sparkSession.createDataFrame([(i, int(side), k) for (i, side), ks in wanted.items() for k in set(ks)], "i int, side int, k bigint")
    hit = upto.join(F.broadcast(keys), ["i", "side"]).filter((F.col("k") < F.col("to")) & (F.col("k") >= F.col("to") - F.col("c")))
    value = {(r["i"], bool(r["side"]), r["k"]): r["x"] for r in hit.select("i", "side", "k", "x").collect()}  # two rows a condition and side at most
    return {(i, side): (value[i, side, a] + value[i, side, b]) / 2 for (i, side), (a, b) in wanted.items()}


def grid(df: DataFrame, rules: dict[str, list[float]], target: str, by: list[str] | None = None) -> DataFrame:
    """rule, threshold and the target's metrics over rows whose column reaches the threshold: every rule in one pass, a
    row multiplied only by the thresholds it meets."""
    hits = F.array(*(F.when(F.col(c) >= t, F.struct(F.lit(c).alias("rule"), F.lit(float(t)).alias("threshold"))) for c, ts in rules.items() for t in ts))
    rows = df.select(*(by or []), target, F.inline(F.filter(hits, lambda h: h.isNotNull())))
    x = F.col(target)
    return rows.groupBy(*(by or []), "rule", "threshold").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("int")).alias("win_rate"))


def signal_grid(df: DataFrame, prob: str, volume: str, cap: str, target: str, probs: tuple[float, ...] = (0.5, 0.55, 0.6), volumes: tuple[float, ...] = (0.0, 5.0), min_cap: float | None = None) -> DataFrame:
    """prob_min, volume_min and the target's metrics over rows that pass both (and the size filter)."""
    rows = df if min_cap is None else df.filter(F.col(cap) >= min_cap)
    hits = F.array(*(F.when((F.col(prob) >= p) & (F.col(volume) >= v), F.struct(F.lit(p).alias("prob_min"), F.lit(v).alias("volume_min"))) for p in probs for v in volumes))
    x = F.col(target)
    return rows.select(target, F.inline(F.filter(hits, lambda h: h.isNotNull()))).groupBy("prob_min", "volume_min").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("int")).alias("win_rate"))
