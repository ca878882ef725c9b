"""Best thresholds by walk-forward, as histograms of moments.

For each feature and fold every row falls into one cell of the threshold grid; cells hold partial moments (one shuffle
for all features and folds), running sums over the cells give the rows at or below each threshold and those above it, and
the best Sharpe ratio, to twelve digits, is picked by max_by. Ties go to the smaller threshold, '>' before '<='.

Folds that overlap are not laid out row by row: rows are counted and summed by the span of days between bounds of folds and by
bins of a feature's range, and what a fold has is added up from these. Rows are read again only in the few bins that hold a
percentile or a point of a grid between their values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.operators.features import written
from tidemark.operators.folds import spans
from tidemark.plans.prefix import BLOCK_ROWS, Spread, asked_ranks, moment_spreads, quantiles, read_ranks, spreads, values_at, with_bins

GRID, FEW = 50, 20
YEAR = 252**0.5


def long_features(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """keep, feature, x: non-null feature values in long form."""
    items = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features))
    return df.select(*keep, F.inline(items)).filter(F.col("x").isNotNull())


def grids(long: DataFrame, by: list[str]) -> DataFrame:
    """by, grid: the distinct values if there are at most FEW, else GRID points from the 5th to the 95th percentile.

    Values are not counted one by one: a group with more than FEW bins in use has more than FEW values, and only groups with
    fewer bins are looked into, for FEW + 1 values at most a task and bin."""
    rows = with_bins(long, "x", by, "_bin")
    counts = written(rows.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.min("x").alias("_least"), F.max("x").alias("_most")))
    q = read_ranks(rows.withColumnRenamed("x", "_x"), asked_ranks(counts.select(*by, "_bin", "_n"), [0.05, 0.95], by), by, "_q")
    g = bins_in_use(counts, by)
    seen = saturating_sets(long.join(F.broadcast(g.filter(UNCLEAR).select(*by)), by, "left_semi"), by, "x", FEW)  # a row a group
    return grid_points(g, q, seen, by)


#: Groups of bins_in_use whose values may be few, but are not told by the ends of their bins.
UNCLEAR = f"_bins <= {FEW} AND NOT _plain"


def bins_in_use(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, _n, _bins, whether each bin has one value (_plain), and these (_ends), from counts(by, _bin, _n, _least, _most)."""
    one = F.col("_least") == F.col("_most")
    return counts.groupBy(*by).agg(F.sum("_n").alias("_n"), F.count("*").alias("_bins"), F.bool_and(one).alias("_plain"), F.collect_set(F.when(one, F.col("_least"))).alias("_ends"))  # BINS values at most


def grid_points(g: DataFrame, q: DataFrame, seen: DataFrame, by: list[str]) -> DataFrame:
    """by, grid from bins_in_use, the two percentiles (_q) and the distinct values of groups that were looked into (_values)."""
    low, high = F.col("_q")[0], F.col("_q")[1]
    points = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda i: low + i * (high - low) / (GRID - 1))
    plain = F.when(F.col("_plain") & (F.col("_bins") <= FEW), F.array_sort("_ends"))
    return g.join(q, by).join(seen, by, "left").filter("_n >= 30").select(*by, F.coalesce(plain, "_values", points).alias("grid"))


def saturating_sets(rows: DataFrame, by: list[str], x: str, most: int) -> DataFrame:
    """by and the sorted distinct values of x where there are `most` at most, null elsewhere. Tasks send the distinct values
    of a group until they have more than `most`, then one mark, so a group's set never grows beyond that."""
    fields = list(rows.select(*by, x).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, set | None] = {}
        for b in batches:
            found = pa.Table.from_batches([b]).group_by(by).aggregate([(x, "distinct")])
            for *key, values in zip(*(found[c].to_pylist() for c in [*by, f"{x}_distinct"]), strict=True):
                have = held.setdefault(tuple(key), set())
                if have is not None:
                    have.update(values)
                    if len(have) > most:
                        held[tuple(key)] = None
        out = [(*k, v) for k, values in held.items() for v in (values if values is not None else [None])]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], to_arrow_type(f.dataType)) for i, f in enumerate(fields)], [f.name for f in fields])

    parts = rows.select(*by, x).mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
    sets = parts.groupBy(*by).agg(F.bool_and(F.col(x).isNotNull()).alias("_all"), F.array_sort(F.collect_set(x)).alias("_set"))  # most values a task at most
    return sets.select(*by, F.when(F.col("_all") & (F.size("_set") <= most), F.col("_set")).alias("_values"))


def percentile_grids(long: DataFrame, by: list[str], step: int = 5) -> DataFrame:
    """by, grid: the percentiles step, 2 step, ... below 100, without repeats."""
    probs = [p / 100 for p in range(step, 100, step)]
    return quantiles(long, "x", probs, by).select(*by, F.array_distinct("q").alias("grid"))


def threshold_table(long: DataFrame, grid: DataFrame, by: list[str], r: str = "r", min_n: int = 15) -> DataFrame:
    """by, threshold, direction, n, mean, std, sharpe, win_rate for every grid point and direction with min_n rows."""
    centre = long.agg(F.avg(r)).first()[0] or 0.0  # keeps the sums of squares small
    y = F.col(r) - centre
    sums = (F.count(r).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"), F.count_if(F.col(r) > 0).alias("w"), F.min(r).alias("lo"), F.max(r).alias("hi"))
    return table_of_cells(long.join(F.broadcast(grid), by).groupBy(*by, _cell().alias("g")).agg(*sums), grid, by, centre, min_n)  # grid: one row a feature and fold


def _cell() -> Column:
    """The number of points of the grid below x."""
    return F.size(F.filter("grid", lambda t: t < F.col("x")))


def table_of_cells(cells: DataFrame, grid: DataFrame, by: list[str], centre: float, min_n: int = 15) -> DataFrame:
    """threshold_table from cells(by, g, n, s, q, w, lo, hi): a cell's rows, their sums and sums of squares about centre, gains
    and extremes."""
    full = grid.select(*by, "grid", F.explode(F.sequence(F.lit(0), F.size("grid"))).alias("g")).join(cells, [*by, "g"], "left").fillna(0, subset=["n", "s", "q", "w"])
    order = Window.partitionBy(*by).orderBy("g")
    sides = {"gt": order.rowsBetween(1, Window.unboundedFollowing), "le": order.rowsBetween(Window.unboundedPreceding, 0)}
    both = full.withColumns({f"{c}_{k}": f(c).over(w) for k, w in sides.items() for c, f in SUMS.items()}).filter(F.col("g") < F.size("grid"))
    two = F.array(*(F.struct(F.lit(d).alias("direction"), *(F.col(f"{c}_{k}").alias(c) for c in SUMS)) for d, k in ((">", "gt"), ("<=", "le"))))
    out = both.select(*by, F.element_at("grid", F.col("g") + 1).alias("threshold"), F.inline(two)).filter(F.col("n") >= min_n)
    return with_metrics(out, centre).withColumn("sharpe", F.try_divide("mean", F.when(F.col("std") > 1e-12, F.col("std"))) * YEAR)


#: How the sums of cells are merged.
SUMS = {"n": F.sum, "s": F.sum, "q": F.sum, "w": F.sum, "lo": F.min, "hi": F.max}


def with_metrics(df: DataFrame, centre: float) -> DataFrame:
    """df with mean, std and win_rate instead of sums; equal values deviate by nothing, whatever the noise of their sums."""
    m = F.col("s") / F.col("n")
    std = F.when(F.col("n") > 1, F.when(F.col("lo") == F.col("hi"), 0.0).otherwise(F.sqrt(F.greatest((F.col("q") - F.col("n") * m * m) / (F.col("n") - 1), F.lit(0.0)))))
    return df.withColumns({"mean": m + centre, "std": std, "win_rate": F.col("w") / F.col("n")}).drop("s", "q", "w", "lo", "hi")


def best(table: DataFrame, by: list[str]) -> DataFrame:
    """The row of the greatest Sharpe ratio by group."""
    rest = [c for c in table.columns if c not in by]
    key = F.struct(F.round(F.col("sharpe") / YEAR, 12), -F.col("threshold"), F.when(F.col("direction") == ">", 1).otherwise(0))
    return table.filter(F.col("sharpe").isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*rest), key).alias("b")).select(*by, "b.*")


def passes(x: Column, threshold: Column, direction: Column) -> Column:
    return F.when(direction == ">", x > threshold).otherwise(x <= threshold)


def apply_best(cells: DataFrame, bests: DataFrame, by: list[str], centre: float, min_n: int = 5) -> DataFrame:
    """by and n, mean, std, sharpe, win_rate of the test rows that pass the training threshold, from cells_of's cells."""
    hit = cells.join(F.broadcast(bests.select(*by, "threshold", "direction")), by).filter(passes(F.col("x"), F.col("threshold"), F.col("direction")))  # one row a feature and fold
    m = with_metrics(hit.groupBy(*by).agg(*(f(c).alias(c) for c, f in SUMS.items())), centre)
    return m.filter(F.col("n") >= min_n).withColumn("sharpe", F.coalesce(F.try_divide("mean", F.when(F.col("std") > 1e-12, F.col("std"))) * YEAR, F.lit(0.0)))


def cells_of(rows: DataFrame, edges: dict[str, list[float]], r: str, centre: float, n_spans: int) -> DataFrame:
    """feature, _span, x and the sums (n, s, q, w, lo, hi) of rows(_span, r, features) in spans below n_spans, where x is the least
    edge of the feature at or above a row's value, or not-a-number above all: to the right and left of an edge lie the same
    rows as before."""
    rows = rows.filter(F.col("_span") < n_spans)
    at, _ = moment_spreads(rows, list(edges), r)
    return cells_of_bins(rows, span_bins(rows, list(edges), r, centre, at), edges, r, centre, at)


def sums_of(r: str, centre: float) -> tuple[Column, ...]:
    """The sums of cells_of; not-a-number is no extreme."""
    y, v = F.col(r) - centre, F.when(~F.isnan(r), F.col(r))
    return F.count(r).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"), F.count_if(F.col(r) > 0).alias("w"), F.min(v).alias("lo"), F.max(v).alias("hi")


def span_bins(rows: DataFrame, features: list[str], r: str, centre: float, at: dict[str, Spread]) -> DataFrame:
    """feature, _span, _bin, the number and ends of x (_n, _least, _most) and the sums of r as in cells_of, from
    rows(_span, r, features). Each feature has a grouping of its own, which costs less than a row a feature or a pass
    through Python."""
    ends = lambda f: (F.count("*").alias("_n"), F.min(f).alias("_least"), F.max(f).alias("_most"))
    parts = [rows.filter(F.col(f).isNotNull()).groupBy("_span", at[f].bin(F.col(f)).alias("_bin")).agg(*ends(f), *sums_of(r, centre)).select(F.lit(f).alias("feature"), "*") for f in features]
    return written(reduce(DataFrame.unionByName, parts))


def of_spans(counts: DataFrame, train: DataFrame) -> DataFrame:
    """feature, fold, _bin with _n, _least, _most of span_bins' counts added up by train(_span, fold)."""
    return counts.join(F.broadcast(train), "_span").groupBy("feature", "fold", "_bin").agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))  # a row a span and fold


def outside(bins: dict[str, list[int]]) -> Column:
    """Whether (feature, _bin) is none of these."""
    return reduce(Column.__and__, ((F.col("feature") != f) | ~F.col("_bin").isin(b) for f, b in bins.items()), F.lit(True))


#: A bin is crowded if it has more than one value, more than BLOCK_ROWS rows and over this share of its group's.
CROWDED = 1 / 256


def span_quantiles(rows: DataFrame, features: list[str], train: DataFrame, r: str, centre: float, at: dict[str, Spread], probs: list[float]) -> tuple[DataFrame, DataFrame]:
    """(feature, fold, _q: the exact quantiles of the training rows; the counts of span_bins).

    Values are read off the counts where a bin has one, and rows are read again only in those bins asked for that have more.
    Where moments have placed a feature's bins so that one asked for is crowded, its quartiles place them anew, in at."""
    by, place, key = ["feature", "fold"], ["feature", "_span", "_bin"], ["feature", "_bin"]

    def look(counts: DataFrame) -> tuple[DataFrame, list[Row]]:
        asked = written(asked_ranks(of_spans(counts, train).select(*by, "_bin", "_n"), probs, by))
        ends = counts.groupBy(*key).agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"), F.max("_most").alias("_most"))
        ends = ends.withColumns({"_all": F.sum("_n").over(Window.partitionBy("feature")), "_wide": F.col("_least") < F.col("_most")})  # BINS rows a feature
        return asked, ends.join(F.broadcast(asked.select(*key).distinct()), key, "left_semi").collect()  # two bins a quantile and fold at most

    counts = span_bins(rows, features, r, centre, at)
    asked, ends = look(counts)
    if crowded := sorted({e["feature"] for e in ends if e["_wide"] and e["_n"] > max(BLOCK_ROWS, e["_all"] * CROWDED)}):
        at |= spreads(rows, crowded)
        counts = written(counts.filter(~F.col("feature").isin(crowded)).unionByName(span_bins(rows, crowded, r, centre, at)))
        asked, ends = look(counts)
    wide = {f: [e["_bin"] for e in ends if e["_wide"] and e["feature"] == f] for f in sorted({e["feature"] for e in ends if e["_wide"]})}
    values = counts.join(F.broadcast(asked.select(*key).distinct()), key, "left_semi").filter(outside(wide)).select(*place, F.col("_least").alias("_x"), F.col("_n").alias("_c"))
    again = [rows.select("_span", at[f].bin(F.col(f)).alias("_bin"), F.col(f).alias("_x")).filter(F.col("_bin").isin(b)).groupBy("_span", "_bin", "_x").agg(F.count("*").alias("_c")).select(F.lit(f).alias("feature"), "*") for f, b in wide.items()]
    values = reduce(DataFrame.unionByName, again, values)
    inside = values.join(F.broadcast(train), "_span").groupBy(*by, "_bin", "_x").agg(F.sum("_c").alias("_c"))
    return values_at(inside, asked, by, "_q"), counts


def span_grids(rows: DataFrame, features: list[str], train: DataFrame, r: str, centre: float, at: dict[str, Spread]) -> tuple[DataFrame, DataFrame]:
    """(feature, fold, grid as in grids; the counts of span_bins) of the training rows among rows(_span, r, features).
    train(_span, fold) tells which spans a fold is trained on."""
    by = ["feature", "fold"]
    q, counts = span_quantiles(rows, features, train, r, centre, at, [0.05, 0.95])
    g = bins_in_use(of_spans(counts, train), by)
    unclear = sorted({x["feature"] for x in g.filter(UNCLEAR).select("feature").distinct().collect()})  # a row a feature
    if not unclear:
        seen = g.select(*by, F.lit(None).cast("array<double>").alias("_values")).limit(0)
    else:
        sets = saturating_sets(long_features(rows, unclear, ["_span"]), ["feature", "_span"], "x", FEW)
        merged = sets.join(F.broadcast(train), "_span").groupBy(*by).agg(F.bool_and(F.col("_values").isNotNull()).alias("_all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_values")))).alias("_set"))  # FEW values a span
        seen = merged.select(*by, F.when(F.col("_all") & (F.size("_set") <= FEW), F.col("_set")).alias("_values"))
    return grid_points(g, q, seen, by), counts


def span_percentiles(rows: DataFrame, features: list[str], train: DataFrame, r: str, centre: float, at: dict[str, Spread], step: int = 5) -> tuple[DataFrame, DataFrame]:
    """span_grids with the grid of percentile_grids."""
    q, counts = span_quantiles(rows, features, train, r, centre, at, [p / 100 for p in range(step, 100, step)])
    return q.select("feature", "fold", F.array_distinct("_q").alias("grid")), counts


def cells_of_bins(rows: DataFrame, counts: DataFrame, edges: dict[str, list[float]], r: str, centre: float, at: dict[str, Spread]) -> DataFrame:
    """cells_of from the counts of span_bins: bins without an edge between their values are added up whole, and rows are read
    again only in the others, a bin an edge at most."""
    given = F.broadcast(rows.sparkSession.createDataFrame([(f, sorted(map(float, e))) for f, e in edges.items()], "feature string, _edges array<double>"))  # a row a feature
    below = lambda c: F.size(F.filter("_edges", lambda t: t < F.col(c)))
    least_edge = lambda e, c: F.coalesce(F.get(F.filter(e, lambda t: t >= F.col(c)), F.lit(0)), F.lit(float("nan"))).alias("x")
    ends = counts.groupBy("feature", "_bin").agg(F.min("_least").alias("_low"), F.max("_most").alias("_high")).join(given, "feature")
    cut = written(ends.withColumns({"_i": below("_low"), "_j": below("_high")}).filter("_i < _j").select("feature", "_bin", F.slice("_edges", F.col("_i") + 1, F.col("_j") - F.col("_i") + 1).alias("_edges")))
    whole = counts.join(F.broadcast(cut), ["feature", "_bin"], "left_anti").join(given, "feature").select("feature", "_span", least_edge("_edges", "_least"), *SUMS).filter("n > 0")
    again = [
        rows.filter(F.col(r).isNotNull()).select("_span", r, F.col(f).alias("_x"), at[f].bin(F.col(f)).alias("_bin")).join(F.broadcast(cut.filter(F.col("feature") == f)), "_bin").groupBy("feature", "_span", least_edge("_edges", "_x")).agg(*sums_of(r, centre))
        for f in sorted(c["feature"] for c in cut.select("feature").distinct().collect())  # a row a feature
    ]
    return reduce(DataFrame.unionByName, again, whole).groupBy("feature", "_span", "x").agg(*(f(c).alias(c) for c, f in SUMS.items()))


def span_tables(rows: DataFrame, features: list[str], members: list[tuple[int, int, str]], r: str = "r", grids_of: Callable[..., tuple[DataFrame, DataFrame]] = span_grids) -> tuple[DataFrame, DataFrame, float]:
    """(threshold_table of the training rows by feature and fold, test cells by feature and fold, centre) of rows(_span, r, features)
    and the (span, fold, role) that belong together: a few passes over rows, whatever the number of folds. grids_of tells
    the grid: span_grids or span_percentiles."""
    spark, by = rows.sparkSession, ["feature", "fold"]
    roles = spark.createDataFrame(members, "_span int, fold int, role string")
    used = rows.filter(F.col("_span").isin(sorted({m[0] for m in members}))).select("_span", F.col(r).cast("double").alias(r), *(F.col(f).cast("double").alias(f) for f in features))
    at, mean = moment_spreads(used, features, r)
    centre = mean if mean is not None and math.isfinite(mean) else 0.0  # keeps the sums of squares small
    grid, counts = grids_of(used, features, roles.filter("role = 'train'").select("_span", "fold"), r, centre, at)
    grid = written(grid)
    edges: dict[str, set[float]] = {f: set() for f in features}
    for g in grid.collect():  # a row a feature and fold
        edges[g["feature"]].update(g["grid"])
    cells = cells_of_bins(used, counts, {f: sorted(e) for f, e in edges.items() if e}, r, centre, at)
    cells = written(cells.join(F.broadcast(roles), "_span"))  # a row a span and fold
    train = cells.filter("role = 'train'").join(F.broadcast(grid), by).groupBy(*by, _cell().alias("g")).agg(*(f(c).alias(c) for c, f in SUMS.items()))  # one row a feature and fold
    return table_of_cells(train, grid, by, centre), cells.filter("role = 'test'").drop("_span", "role"), centre


def walk_forward(df: DataFrame, features: list[str], folds: DataFrame, r: str = "r", day: str = "d") -> tuple[DataFrame, DataFrame]:
    """(best training thresholds, test metrics) by feature and fold, see folds for the bounds."""
    by = ["feature", "fold"]
    span, members = spans(folds, day)
    table, tests, centre = span_tables(df.withColumn("_span", span), features, members, r)
    bests = best(table, by)
    return bests, apply_best(tests, bests, by, centre)


def evaluate(bests: DataFrame, tests: DataFrame, by: str = "feature", max_degradation: float = 0.5, min_n: int = 20, min_sharpe: float = 0.8, min_win: float = 0.48, max_p: float = 0.05, min_d: float = 0.2) -> DataFrame:
    """Pooled test metrics by feature with degradation against training and whether all gates pass. Moments of the
    folds add up, so the test rows are not read again."""
    from tidemark.functions.dist import t_two_sided

    b = bests.select(by, "fold", F.col("sharpe").alias("train_sharpe"))
    t = tests.join(b, [by, "fold"])
    n, m, s = F.col("n"), F.col("mean"), F.coalesce("std", F.lit(0.0))
    g = t.groupBy(by).agg(F.count("*").alias("n_folds"), F.sum("n").alias("n"), (F.sum(n * m) / F.sum("n")).alias("mean"), F.sum((n - 1) * s * s + n * m * m).alias("_q"), (F.sum(n * F.col("win_rate")) / F.sum("n")).alias("win_rate"), F.avg((F.col("train_sharpe") - F.col("sharpe")) / F.greatest("train_sharpe", F.lit(0.01))).alias("degradation"))
    g = g.withColumn("std", F.sqrt(F.greatest(F.try_divide(F.col("_q") - n * m * m, n - 1), F.lit(0.0)))).drop("_q")
    g = g.withColumns({"sharpe": F.try_divide("mean", F.when(F.col("std") > 1e-12, F.col("std"))) * YEAR, "d": F.abs(F.try_divide("mean", F.when(F.col("std") > 1e-12, F.col("std"))))})
    g = g.withColumn("p", t_two_sided(F.col("d") * F.sqrt(n.cast("double")), n.cast("double") - 1))
    ok = (F.col("degradation") <= max_degradation) & (n >= min_n) & (F.col("sharpe") >= min_sharpe) & (F.col("win_rate") >= min_win) & (F.col("p") <= max_p) & (F.col("d") >= min_d)
    return g.withColumn("passed", F.coalesce(ok, F.lit(False)))
