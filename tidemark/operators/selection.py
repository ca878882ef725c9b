"""Feature selection: filters, binned mutual information, MLlib models and their vote."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.operators.combos import pair_correlations
from tidemark.operators.features import written
from tidemark.plans.prefix import BLOCK_ROWS, hashed_positions, quantile_values, with_bins

#: When each feature is known, in minutes after the open (negative: before).
AVAILABLE = {"premarket": -1, "open": 0, "pct_1min": 1, "pct_5min": 5, "pct_15min": 15, "pct_30min": 30, "pct_1hr": 60, "intraday": 60, "close": 390, "high": 390, "low": 390, "return": 390, "risk_adjusted": 390, "full_day": 390, "target": 390, "daily_range": 390}


def known_by(features: list[str], minute: int) -> list[str]:
    """The features that are known at a minute of the session; a name without a rule is known beforehand."""
    when = lambda f: max((m for k, m in AVAILABLE.items() if k in f), default=-1)
    return [f for f in features if when(f) <= minute]


def variance_filter(df: DataFrame, features: list[str], minimum: float = 0.01) -> DataFrame:
    """feature, variance, kept."""
    r = df.agg(F.array(*(F.struct(F.lit(f).alias("feature"), F.var_samp(f).alias("variance")) for f in features)).alias("x")).select(F.inline("x"))
    return r.withColumn("kept", F.coalesce(F.col("variance") > minimum, F.lit(False)))


def correlation_filter(df: DataFrame, features: list[str], limit: float = 0.95) -> list[str]:
    """Features that correlate no more than limit with any kept earlier one. Correlations come from one pass; the walk is
    over the small matrix."""
    corr = {(r["f1"], r["f2"]): abs(r["corr"] or 0.0) for r in pair_correlations(df, features).collect()}
    kept: list[str] = []
    for f in features:
        if all(corr.get((min(f, k), max(f, k)), 0.0) <= limit for k in kept):
            kept.append(f)
    return kept


def mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10) -> DataFrame:
    """feature, mi (nats): contingency of quantile bins and the label, one shuffle of counts for all features."""
    probs = [i / bins for i in range(1, bins)]
    q = quantile_values(df, {f: F.col(f) for f in features}, probs)

    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array_distinct(F.array(*map(F.lit, q[f]))), lambda t: t < F.col(f)))

    cells = F.array(*(F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bin")) for f in features if q[f]))
    long = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.inline(cells))
    n = long.groupBy("feature", "bin", "y").agg(F.count("*").cast("double").alias("n"))
    tot = n.groupBy("feature").agg(F.sum("n").alias("t"))
    fx, fy = n.groupBy("feature", "bin").agg(F.sum("n").alias("nx")), n.groupBy("feature", "y").agg(F.sum("n").alias("ny"))
    j = n.join(fx, ["feature", "bin"]).join(fy, ["feature", "y"]).join(tot, "feature")
    return j.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))


def assemble(df: DataFrame, features: list[str], label: str, scale: bool = True) -> DataFrame:
    rows = VectorAssembler(inputCols=features, outputCol="raw" if scale else "features", handleInvalid="skip").transform(df.filter(F.col(label).isNotNull()).withColumn("label", F.col(label).cast("double")))
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows).transform(rows).drop("raw") if scale else rows


def recursive_elimination(df: DataFrame, features: list[str], label: str, keep: int, step: float = 0.1, model: str = "logistic") -> list[str]:
    """Drops the weakest tenth (one at least) after each distributed fit until `keep` are left."""
    left = list(features)
    while len(left) > keep:
        rows = assemble(df, left, label)
        fitted = LogisticRegression(maxIter=30, regParam=0.01).fit(rows) if model == "logistic" else RandomForestClassifier(numTrees=20, maxDepth=5, seed=7).fit(rows)
        weight = np.abs(fitted.coefficients.toArray()) if model == "logistic" else fitted.featureImportances.toArray()
        drop = min(len(left) - keep, max(1, int(len(left) * step)))
        gone = {left[i] for i in np.argsort(weight, kind="stable")[:drop]}
        left = [f for f in left if f not in gone]
    return left


def lasso(df: DataFrame, features: list[str], label: str, strength: float = 0.01, minimum: float = 1e-6) -> list[str]:
    fitted = LogisticRegression(maxIter=50, regParam=strength, elasticNetParam=1.0).fit(assemble(df, features, label))
    return [f for f, w in zip(features, fitted.coefficients.toArray(), strict=True) if abs(w) > minimum]


def forest_importance(df: DataFrame, features: list[str], label: str, trees: int = 50) -> DataFrame:
    rows = assemble(df, features, label, scale=False)
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=7).fit(rows)
    return df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, fitted.featureImportances.toArray(), strict=True)], "feature string, importance double")


def auc_by(scored: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """by and the exact area under the curve: the share of pairs of a row labelled 1 and one labelled 0 in which the first has the
    higher score (ties count half).

    scored is grouped once into distinct scores with counts, which are written; rows labelled 0 below a score are those of the
    bins before its own and of the lower scores in it, so that no task holds more than a bin of a group."""
    cells = written(scored.filter(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count("*").cast("double").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p")))
    zeros = F.col("_n") - F.col("_p")
    binned = with_bins(cells, score, by, "_b")
    inside = Window.partitionBy(*by, "_b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(zeros).over(inside), F.lit(0.0))
    bins = binned.withColumn("_w", below + zeros / 2).groupBy(*by, "_b").agg(F.sum(F.col("_p") * F.col("_w")).alias("_pairs"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows a group at most
    won = F.sum(F.col("_pairs") + F.col("_p") * F.coalesce(F.col("_before"), F.lit(0.0)))
    sums = bins.withColumn("_before", F.sum(zeros).over(before)).groupBy(*by).agg(won.alias("_won"), F.sum("_p").alias("_ones"), F.sum(zeros).alias("_zeros"))
    return sums.select(*by, F.try_divide(F.col("_won"), F.col("_ones") * F.col("_zeros")).alias("auc"))


def permuted(rows: DataFrame, key: str, columns: dict[int, Column], repeats: int, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows once for each column and repeat (i, k) with `value`: the column's value in another row, so that each (i, k) is a
    permutation of the whole column.

    Two orders by hashes of the key, of which one depends on i and k, are numbered, and equal positions are joined: the
    largest task has some block_rows rows however many there are. rows are read several times: give a written table."""
    n = rows.count()
    home = hashed_positions(rows.withColumn("_h", F.xxhash64(F.lit(seed), key)), "_h", n, block_rows=block_rows).drop("_h")
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), x.alias("value")) for i, x in columns.items() for k in range(repeats)))
    donors = rows.select(F.col(key).alias("_key"), F.inline(cells)).withColumn("_h", F.xxhash64(F.lit(seed), "_key", "i", "k"))
    return home.join(hashed_positions(donors, "_h", n, ["i", "k"], block_rows=block_rows).drop("_h", "_key"), "position").drop("position")


def permutation_importance(df: DataFrame, model, features: list[str], label: str, repeats: int = 5, seed: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """feature, importance: mean loss of AUC when a column is permuted over the whole table, `repeats` times each. All
    permutations are made and scored in one job."""
    x = vector_to_array("features")
    rows = written(assemble(df, features, label, scale=False).select("label", x.alias("x")).withColumn("_row", F.monotonically_increasing_id()))
    moved = permuted(rows, "_row", {i: F.col("x")[i] for i in range(len(features))}, repeats, seed, block_rows)
    mixed = moved.withColumn("x", F.transform("x", lambda v, j: F.when(j == F.col("i"), F.col("value")).otherwise(v))).select("i", "k", "label", "x")
    every = mixed.unionByName(rows.select(F.lit(-1).alias("i"), F.lit(0).alias("k"), "label", "x"))
    scored = written(model.transform(every.withColumn("features", array_to_vector("x"))).select("i", "k", "label", vector_to_array("probability")[1].alias("p")))
    auc = auc_by(scored, "p", "label", ["i", "k"])
    base = auc.filter("i = -1").select(F.col("auc").alias("base"))
    names = F.array(*map(F.lit, features))
    return auc.filter("i >= 0").crossJoin(F.broadcast(base)).groupBy("i").agg(F.avg(F.col("base") - F.col("auc")).alias("importance")).select(names[F.col("i")].alias("feature"), "importance")  # base: one row


def vote(spark, chosen: dict[str, list[str]], mi: DataFrame, k: int = 20) -> DataFrame:
    """feature, votes: the k most chosen features (ties by the order of methods), filled up by mutual information."""
    rows = [(f, m, i) for i, (m, fs) in enumerate(chosen.items()) for f in fs]
    votes = spark.createDataFrame(rows, "feature string, method string, ordinal int").groupBy("feature").agg(F.count("*").alias("votes"), F.min("ordinal").alias("first"))
    both = votes.join(mi, "feature", "full").fillna({"votes": 0, "first": 99, "mi": 0.0})
    return both.orderBy(F.desc("votes"), "first", F.desc("mi"), "feature").limit(k).select("feature", "votes", "mi")


def info_ratio(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """feature, corr, n, info_ratio = |corr| times the root of n."""
    from tidemark.operators.profile import correlations

    return correlations(df, features, [target]).select("feature", "corr", "n", (F.abs("corr") * F.sqrt(F.col("n").cast("double"))).alias("info_ratio"))


