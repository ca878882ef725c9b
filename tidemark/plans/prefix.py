"""Global ordered scans without one big partition.

A row-level window without partitions would put the whole table into one task. Here rows are grouped into blocks by a
coarse order key (here the day), blocks are summed up, a window over that small table carries the running state, and
each block adds its rows to the state it starts from.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.shared import new_path

#: Bins of a value's range that ranks and quantiles are found by, and rows that are numbered in one task.
BINS, BLOCK_ROWS = 4096, 100_000
#: Rows of a summary that may be broadcast; larger ones are joined by their keys.
SMALL = 100_000


def row_numbers(df: DataFrame, block: str, order: list[str], name: str = "position") -> DataFrame:
    """0-based positions in the order (block, *order). block is coarse: one of its values fits in a task."""
    counts = df.groupBy(block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a block
    inside = Window.partitionBy(block).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(inside)).join(starts, block).withColumn(name, F.col("_start") + F.col("_k") - 1).drop("_k", "_start")


def hashed_positions(df: DataFrame, h: str, n: int, by: list[str] | None = None, name: str = "position", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with 0-based positions within `by` in an order that the 64-bit hash h sets. n is the number of rows of a group.

    The top bits of the hash cut a group into blocks of about block_rows rows, whatever its size; a block's rows are numbered
    in a task, the blocks by the sums of their counts. Rows of equal hash are numbered as they come."""
    by, bits = by or [], max(0, math.ceil(math.log2(max(n, 1) / block_rows)))
    rows = df.withColumn("_block", F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long"))
    counts = rows.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))  # one row a block
    inside = Window.partitionBy(*by, "_block").orderBy(h)
    return rows.withColumn("_k", F.row_number().over(inside)).join(starts, [*by, "_block"]).withColumn(name, F.col("_start") + F.col("_k") - 1).drop("_k", "_start", "_block")


def noted(df: DataFrame) -> tuple[DataFrame, bool]:
    """A summary as a written table, and whether it has few enough rows (SMALL) to be sent to every task."""
    path = new_path(df.sparkSession, "summary")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out, out.limit(SMALL + 1).count() <= SMALL


def with_bins(df: DataFrame, x: str, by: list[str], name: str, bins: int = BINS) -> DataFrame:
    """df with a bin of x, 0 to bins - 1, that grows with x within its group. Values are spread by the inverse hyperbolic
    sine of their distance from the median in quartile widths, so outliers do not crowd the rest into one bin. Nulls get
    none; not-a-number sorts last."""
    finite = ~F.isnan(x) & (F.abs(F.col(x)) < float("inf"))
    y = F.when(finite, F.col(x).cast("double"))
    s = df.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by))).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.percentile_approx(y, [0.25, 0.5, 0.75], 1000).alias("_q"))  # one row a group
    scale = F.greatest(F.col("_q")[2] - F.col("_q")[0], (F.col("_hi") - F.col("_lo")) * 1e-6)
    spread = lambda c: F.asinh(F.try_divide(c - F.col("_q")[1], scale))
    part = F.coalesce(F.try_divide(spread(y) - spread(F.col("_lo")), spread(F.col("_hi")) - spread(F.col("_lo"))), F.lit(0.0))
    place = F.when(finite, F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(part * bins)))).when(F.col(x) < 0, 0).when(F.col(x).isNotNull(), bins - 1)
    if by:
        s, small = noted(s)
        same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
        joined = df.join(F.broadcast(s) if small else s, reduce(Column.__and__, same))
    else:
        joined = df.crossJoin(F.broadcast(s))  # one row
    return joined.withColumn(name, place.cast("int")).drop("_lo", "_hi", "_q", *(f"_g{i}" for i in range(len(by))))


def quantiles(df: DataFrame, x: str, probs: list[float], by: list[str], name: str = "q", binned: str | None = None) -> DataFrame:
    """by and an array of the exact quantiles (linear between neighbours) of each group; a group without values has none.
    binned names a column that with_bins has set, if there is one.

    Counts by bin find the bins that hold the ranks asked for; only the distinct values of these bins are gathered, about
    one in BINS, so no task holds the values of a group."""
    rows = df.filter(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), *([F.col(binned).alias("_bin")] if binned else []))
    rows = rows if binned else with_bins(rows, "_x", by, "_bin")
    return read_ranks(rows, asked_ranks(rows.groupBy(*by, "_bin").agg(F.count("*").alias("_n")), probs, by), by, name)


def asked_ranks(counts: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """For each quantile and group of counts(by, _bin, _n) the ranks it lies between, with their bins."""
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = counts.withColumns({"_upto": F.sum("_n").over(whole.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(whole)})  # BINS rows a group
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("_i"), (F.lit(float(p)) * (F.col("_all") - 1)).alias("_at")) for i, p in enumerate(probs))))
    asked = run.select("*", at.alias("_p")).select(*by, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", "_p.*")
    return asked.select("*", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_k")).filter((F.col("_k") >= F.col("_before")) & (F.col("_k") < F.col("_upto")))


def read_ranks(rows: DataFrame, asked: DataFrame, by: list[str], name: str) -> DataFrame:
    """The quantiles from rows(by, _bin, _x), of which only those in asked bins are looked at."""
    keys = [*by, "_bin"]
    asked, small = noted(asked)
    wanted = asked.select(*(F.col(c).alias(f"_w{i}") for i, c in enumerate(keys))).distinct()
    some = rows.join(F.broadcast(wanted) if small else wanted, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_w{i}")) for i, c in enumerate(keys)]), "left_semi")
    return values_at(some.groupBy(*keys, "_x").agg(F.count("*").alias("_c")), asked, by, name)


def values_at(inside: DataFrame, asked: DataFrame, by: list[str], name: str) -> DataFrame:
    """The quantiles from inside(by, _bin, _x, _c), the distinct values of the asked bins with their counts."""
    keys = [*by, "_bin"]
    ranked = inside.withColumn("_to", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)))
    hit = asked.alias("a").join(ranked.alias("r"), reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys] + [F.col("_k") - F.col("_before") < F.col("_to"), F.col("_k") - F.col("_before") >= F.col("_to") - F.col("_c")]))
    value = hit.groupBy(*(F.col(f"a.{c}").alias(c) for c in by), "_i", "_at").agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    value = value.withColumn("_v", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_at") - F.floor("_at")))
    return value.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias(name))


def ranged(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df as a written table with the range of (by, order) that each row lies in, column _part, in ascending order."""
    spark = df.sparkSession
    path = new_path(spark, "ranges")
    df.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    return spark.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(path)


#: For each kind of running value: the aggregate of a part, how parts are merged, and how a row's is put on what came before.
RUNNING = {
    "sum": (lambda x, _: F.sum(x), F.sum, lambda before, own: F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)),
    "product": (lambda x, _: F.product(x), F.product, lambda before, own: F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before * own)),
    "max": (lambda x, _: F.max(x), F.max, F.greatest),
    "min": (lambda x, _: F.min(x), F.min, F.least),
    "last": (lambda x, order: F.max_by(x, F.when(x.isNotNull(), order)), lambda x: F.last(x, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def with_running(df: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], parts: int | None = None) -> DataFrame:
    """df with running values of its group up to each row, by name: (kind, value), kinds as in RUNNING; nulls do not count.

    Rows are cut into ranges of (by, order). A range's rows run within a task; what its groups carry into it comes from the
    totals of the ranges before, so no task holds a whole group, and only a row a range and group meets in a window."""
    names = list(values)
    rows = ranged(df.withColumns({f"_v{i}": values[n][1] for i, n in enumerate(names)}), by, order, parts)
    at = F.struct(*order)
    totals = rows.groupBy("_part", *by).agg(*(RUNNING[values[n][0]][0](F.col(f"_v{i}"), at).alias(f"_t{i}") for i, n in enumerate(names)))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried, small = noted(totals.select("_part", *by, *(RUNNING[values[n][0]][1](F.col(f"_t{i}")).over(earlier).alias(f"_c{i}") for i, n in enumerate(names))))
    carried = carried.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), *(f"_c{i}" for i in range(len(names))))
    here = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumns({f"_o{i}": RUNNING[values[n][0]][1](F.col(f"_v{i}")).over(here) for i, n in enumerate(names)})
    same = reduce(Column.__and__, [F.col("_part") == F.col("_p"), *(F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by))])
    joined = own.join(F.broadcast(carried) if small else carried, same)
    out = joined.withColumns({n: RUNNING[values[n][0]][2](F.col(f"_c{i}"), F.col(f"_o{i}")) for i, n in enumerate(names)})
    return out.select(*dict.fromkeys([*df.columns, *names]))


def with_halo(df: DataFrame, by: list[str], order: list[str], before: int, parts: int | None = None) -> DataFrame:
    """df cut into ranges of (by, order), column _part, each with copies (_halo) of the `before` rows that precede it. Windows
    over Window.partitionBy("_part", *by).orderBy(*order) that look back no further give each row that is no copy what a
    window over its whole group gives, and no task holds a whole group.

    The ranges are written, so that a row's part is fixed. As many copies as asked for go from a part to the next, and on to
    those after it where parts are smaller than that."""
    rows = ranged(df, by, order, parts)
    size = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}  # a row a part
    goals = []  # (part, later part, rows between them) as far as copies reach
    for p in sorted(size):
        between = 0
        for q in sorted(k for k in size if k > p):
            if between >= before:
                break
            goals.append(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(between).alias("between")))
            between += size[q]
    rows = rows.withColumn("_halo", F.lit(False))
    if not goals:
        return rows
    back = [F.col(c).desc() for c in [*by, *order]]
    tails = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*back))).filter(F.col("_k") <= before)
    to = F.filter(F.array(*goals), lambda g: (g["p"] == F.col("_part")) & (F.col("_k") - 1 + g["between"] < before))
    copies = tails.select(*df.columns, F.explode(F.transform(to, lambda g: g["q"])).alias("_part"), F.lit(True).alias("_halo"))
    return rows.unionByName(copies)


class Spread:
    """Where the bins of a column lie, see with_bins: plain numbers, so that no row is joined with them."""

    def __init__(self, low: float | None, high: float | None, quartiles: list[float] | None, bins: int = BINS):
        self.bins, self.some = bins, low is not None
        if self.some:
            self.middle = quartiles[1]
            self.scale = max(quartiles[2] - quartiles[0], (high - low) * 1e-6)
            self.low, self.high = (math.asinh((x - self.middle) / self.scale) if self.scale else 0.0 for x in (low, high))

    def bin(self, x: Column) -> Column:
        finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
        if not self.some or self.high == self.low:
            place = F.when(finite, 0)
        else:
            z = (x - self.middle) / self.scale
            part = (F.signum(z) * F.asinh(F.abs(z)) - self.low) / (self.high - self.low)  # asinh of the size, as Spark's loses digits below zero
            place = F.when(finite, F.greatest(F.lit(0), F.least(F.lit(self.bins - 1), F.floor(part * self.bins))))
        return place.when(x < 0, 0).when(x.isNotNull(), self.bins - 1).cast("int")


def spreads(df: DataFrame, columns: list[str], bins: int = BINS) -> dict[str, Spread]:
    """The bins of several double columns, from one pass."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns}
    r = df.agg(*(x for c, y in finite.items() for x in (F.min(y).alias(f"{c}_lo"), F.max(y).alias(f"{c}_hi"), F.percentile_approx(y, [0.25, 0.5, 0.75], 1000).alias(f"{c}_q")))).first()
    return {c: Spread(r[f"{c}_lo"], r[f"{c}_hi"], r[f"{c}_q"], bins) for c in columns}


def moment_spreads(df: DataFrame, columns: list[str], r: str) -> tuple[dict[str, Spread], float | None]:
    """(The bins of several double columns, the mean of r) from one pass that Spark compiles: the mean and deviation stand for
    the median and quartiles of spreads, so bins are crowded where few values lie far out."""
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns}
    each = {"lo": F.min, "hi": F.max, "m": F.avg, "s": F.stddev_pop}
    a = df.agg(F.avg(r).alias("_r"), *(f(y).alias(f"{c}_{k}") for c, y in finite.items() for k, f in each.items())).first()
    out = {}
    for c in columns:
        lo, hi, m, s = (a[f"{c}_{k}"] for k in each)
        known = lo is not None and all(map(math.isfinite, (m, s, hi - lo)))
        out[c] = Spread(lo, hi, [m - s / 2, m, m + s / 2]) if known else Spread(None, None, None)
    return out, a["_r"]


def quantile_values(df: DataFrame, columns: dict[str, Column], probs: list[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of several expressions over the whole table, by three passes over df: where the bins lie, counts by
    bin (BINS rows a column reach the driver), and the distinct values of the few bins that hold the ranks asked for."""
    names = {n: f"_x{i}" for i, n in enumerate(columns)}
    rows = df.select(*(c.cast("double").alias(names[n]) for n, c in columns.items()))
    found = spreads(rows, list(names.values()))
    at = {c: s.bin(F.col(c)) for c, s in found.items()}
    cell = lambda c: F.struct(F.lit(c).alias("_name"), at[c].alias("_bin"), F.col(c).alias("_x"))
    counts: dict[str, list[tuple[int, int]]] = {c: [] for c in at}
    cells = F.array(*(F.struct(F.lit(c).alias("_name"), b.alias("_bin")) for c, b in at.items()))
    for r in rows.select(F.inline(cells)).filter("_bin IS NOT NULL").groupBy("_name", "_bin").agg(F.count("*").alias("_n")).collect():
        counts[r["_name"]].append((r["_bin"], r["_n"]))
    asked: dict[str, dict[int, int]] = {}  # the bins to look into, with the rows before each
    ranks: dict[str, list[float]] = {}
    for c, bins in counts.items():
        ranks[c] = [p * (sum(n for _, n in bins) - 1) for p in probs]
        before, asked[c] = 0, {}
        for b, n in sorted(bins):
            if any(before <= k < before + n for x in ranks[c] for k in (math.floor(x), math.ceil(x))):
                asked[c][b] = before
            before += n
    starts = [F.struct(F.lit(c).alias("_name"), F.lit(b).alias("_bin"), F.lit(k).cast("long").alias("_before")) for c, bins in asked.items() for b, k in bins.items()]
    if not starts:
        return dict.fromkeys(columns)
    wanted = [F.when(at[c].isin(list(bins)), cell(c)) for c, bins in asked.items() if bins]
    inside = rows.select(F.inline(F.filter(F.array(*wanted), lambda x: x.isNotNull()))).groupBy("_name", "_bin", "_x").agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_name", "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    first = F.element_at(F.filter(F.array(*starts), lambda s: (s["_name"] == F.col("_name")) & (s["_bin"] == F.col("_bin"))), 1)["_before"]
    ranked = inside.withColumn("_to", upto + first).withColumn("_from", F.col("_to") - F.col("_c"))
    keys = [F.struct(F.lit(c).alias("c"), F.lit(k).cast("long").alias("k")) for c, xs in ranks.items() if asked[c] for k in sorted({f(x) for x in xs for f in (math.floor, math.ceil)})]
    hit = ranked.select("_name", "_x", F.explode(F.filter(F.array(*keys), lambda q: (q["c"] == F.col("_name")) & (q["k"] >= F.col("_from")) & (q["k"] < F.col("_to")))).alias("q"))
    value = {(r["_name"], r["k"]): r["_x"] for r in hit.select("_name", "q.k", "_x").collect()}  # two rows a quantile
    out: dict[str, list[float] | None] = {}
    for n, c in names.items():
        pairs = [(value[c, math.floor(x)], value[c, math.ceil(x)], x - math.floor(x)) for x in ranks[c]] if asked[c] else None
        out[n] = None if pairs is None else [a + (b - a) * f for a, b, f in pairs]
    return out


def average_ranks(df: DataFrame, value: str, name: str = "rank", by: list[str] | None = None, share: bool = False) -> DataFrame:
    """df with ranks from 1 within its group, ties averaged (share: over the number of values)."""
    return with_ranks(df, df, value, name, by, share)


def with_ranks(df: DataFrame, of: DataFrame, value: str, name: str, by: list[str] | None = None, share: bool = False) -> DataFrame:
    """df with the ranks that its values have in `of`. Ranks are found on distinct values with counts, cut into bins; only
    bin totals of a group meet in one task."""
    by = by or []
    values = with_bins(of.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k")), value, by, "_b")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = values.groupBy(*by, "_b").agg(F.sum("_k").alias("_n"))  # BINS rows a group at most
    starts = totals.select(*by, "_b", F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"), F.sum("_n").over(whole).alias("_all"))
    inside = Window.partitionBy(*by, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_b"]
    counted = values.withColumn("_w", F.coalesce(F.sum("_k").over(inside), F.lit(0))).alias("v").join(starts.alias("s"), reduce(Column.__and__, [F.col(f"v.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]))
    rank = F.col("_s") + F.col("_w") + (F.col("_k") + 1) / 2
    ranks = counted.select(*(F.col(f"v.{c}").alias(f"_g{i}") for i, c in enumerate(by)), F.col(f"v.{value}").alias("_v"), (rank / F.col("_all") if share else rank).alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)] + [F.col(value) == F.col("_v")]
    return df.join(ranks, reduce(Column.__and__, same), "left").drop("_v", *(f"_g{i}" for i in range(len(by))))


def log_growth(r: Column) -> Column:
    """The logarithm of 1 + r, minus infinity where all is lost; running sums of it do not overflow as products do."""
    return F.when(1 + r <= 0, float("-inf")).otherwise(F.log1p(r))


def depth(level: Column, peak: Column) -> Column:
    """The drawdown at a logarithm of growth, from the one of its peak; null where nothing was there to lose."""
    return F.when(peak > float("-inf"), F.exp(level - peak) - 1)


def drawdown_parts(trades: DataFrame, by: list[str], r: str, block: str, order: list[str]) -> DataFrame:
    """One row for each group and block with growth, logarithms of growth, peak and trough, and mdd of its trades alone."""
    w = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    walk = trades.withColumn("_l", F.sum(log_growth(F.col(r))).over(w))
    walk = walk.withColumn("_p", F.max("_l").over(w))
    return walk.groupBy(*by, block).agg(F.product(1 + F.col(r)).alias("growth"), F.sum(log_growth(F.col(r))).alias("level"), F.max("_l").alias("peak"), F.min("_l").alias("trough"), F.min(depth(F.col("_l"), F.col("_p"))).alias("mdd"))


def merge_drawdowns(parts: DataFrame, by: list[str], block: str) -> DataFrame:
    """by, growth and mdd over all blocks in order. Within a group the blocks' states are merged pairwise by a fold over
    a sorted array of one entry a block. Growth may leave the range of doubles, the drawdown is found by logarithms."""
    fold = F.aggregate(
        F.sort_array(F.collect_list(F.struct(block, "growth", "level", "peak", "trough", "mdd"))),
        F.struct(F.lit(1.0).alias("growth"), F.lit(0.0).alias("level"), F.lit(None).cast("double").alias("peak"), F.lit(0.0).alias("mdd")),
        lambda a, b: F.struct(
            (a["growth"] * F.coalesce(b["growth"], F.lit(1.0))).alias("growth"),
            (a["level"] + F.coalesce(b["level"], F.lit(0.0))).alias("level"),
            F.greatest(a["peak"], a["level"] + b["peak"]).alias("peak"),
            F.least(a["mdd"], b["mdd"], depth(a["level"] + b["trough"], a["peak"])).alias("mdd"),
        ),
    )
    return parts.groupBy(*by).agg(fold.alias("x")).select(*by, "x.growth", "x.mdd")
