"""Cleaning: dates, sentinels, outliers, categories, duplicates, fills and candidate filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalar import surprise_pct
from tidemark.operators.features import written
from tidemark.plans.prefix import quantile_values, with_running

DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss"]
#: Markers of missing data by kind of column.
PRICE_MARKS, PCT_MARKS, TEXT_MARKS = [-1.0], [-999.0, -9999.0], ["N/A", "FAILED", "Unknown", "", "null", "#N/A"]
DATE_ALIASES = ["report_date", "date", "Date", "earnings_date", "timestamp"]
PRICE_ALIASES = {"open": "open_price", "Open": "open_price", "high": "high_price", "High": "high_price", "low": "low_price", "Low": "low_price", "close": "close_price", "Close": "close_price"}


def parse_date(text: Column, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """The first format that parses; null if none does."""
    return F.to_date(F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)))


def resolve_date(df: DataFrame, aliases: Iterable[str] = DATE_ALIASES, to: str = "report_date") -> DataFrame:
    """Renames the first date alias present; a table without one is an error."""
    for name in aliases:
        if name in df.columns:
            return df.withColumnRenamed(name, to)
    raise ValueError(f"no date column among {list(aliases)}")


def rename_prices(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in PRICE_ALIASES.items() if k in df.columns and v not in df.columns})


def sentinels_to_null(df: DataFrame, prices: Iterable[str] = (), percents: Iterable[str] = (), texts: Iterable[str] = ()) -> DataFrame:
    """Markers become null by kind of column, so a genuine -1 % stays; infinities and NaN become null too."""
    out: dict[str, Column] = {}
    for names, marks in ((prices, PRICE_MARKS), (percents, PCT_MARKS)):
        for c in names:
            x = F.col(c)
            out[c] = F.when(~x.isin(marks) & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), x)
    for c in texts:
        out[c] = F.when(~F.col(c).isin(TEXT_MARKS), F.col(c))
    return df.withColumns(out)


def to_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})


def iqr_outliers(df: DataFrame, columns: list[str], k: float = 3.0) -> DataFrame:
    """column, q1, q3 and the number of values beyond k interquartile ranges: two passes for all columns."""
    q = quantile_values(df, {c: F.col(c) for c in columns}, [0.25, 0.75])
    bound = {c: q[c] for c in columns if q[c] is not None}
    counts = df.agg(*(F.count_if((F.col(c) < b[0] - k * (b[1] - b[0])) | (F.col(c) > b[1] + k * (b[1] - b[0]))).alias(c) for c, b in bound.items()))
    unpivoted = counts.unpivot([], list(bound), "column", "n_outliers")
    edges = F.create_map(*(x for c, b in bound.items() for x in (F.lit(c), F.struct(F.lit(b[0]).alias("q1"), F.lit(b[1]).alias("q3")))))
    return unpivoted.select("column", edges[F.col("column")]["q1"].alias("q1"), edges[F.col("column")]["q3"].alias("q3"), "n_outliers")


def winsorise(df: DataFrame, columns: list[str], low: float = 0.005, high: float = 0.995, k: float = 3.0) -> DataFrame:
    """Clips to two percentiles those columns that have outliers beyond k interquartile ranges."""
    q = quantile_values(df, {c: F.col(c) for c in columns}, [low, 0.25, 0.75, high])
    edges = {c: q[c] for c in columns if q[c] is not None}
    some = df.agg(*(F.max(((F.col(c) < e[1] - k * (e[2] - e[1])) | (F.col(c) > e[2] + k * (e[2] - e[1]))).cast("int")).alias(c) for c, e in edges.items())).first()
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(e[0]), F.least(F.lit(e[3]), F.col(c)))) for c, e in edges.items() if some[c]})


def mad_clip(df: DataFrame, columns: list[str], threshold: float = 3.5, min_rows: int = 10) -> DataFrame:
    """Clips to the median plus or minus threshold * MAD / 0.6745; columns with few values or MAD 0 stay."""
    counts = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    live = [c for c in columns if counts[c] >= max(1, min_rows)]
    middle = {c: q[0] for c, q in quantile_values(df, {c: F.col(c) for c in live}, [0.5]).items()} if live else {}
    mads = quantile_values(df, {c: F.abs(F.col(c) - middle[c]) for c in live}, [0.5]) if live else {}
    span = {c: threshold * mads[c][0] / 0.6745 for c in live if mads[c][0]}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(middle[c] - s), F.least(F.lit(middle[c] + s), F.col(c)))) for c, s in span.items()})


def iqr_clip(df: DataFrame, columns: list[str], k: float = 1.5) -> DataFrame:
    q = quantile_values(df, {c: F.col(c) for c in columns}, [0.25, 0.75])
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(b[0] - k * (b[1] - b[0])), F.least(F.lit(b[1] + k * (b[1] - b[0])), F.col(c)))) for c in columns if (b := q[c]) is not None})


def category(text: Column) -> Column:
    """Upper case without outer blanks; UNKNOWN and NAN become Other, FAILED becomes Missing."""
    c = F.upper(F.trim(text))
    return F.when(c.isin("UNKNOWN", "NAN"), "Other").when(c == "FAILED", "Missing").otherwise(c)


def clean_symbols(df: DataFrame, column: str = "symbol") -> DataFrame:
    return df.withColumn(column, F.regexp_replace(column, "[^A-Z]", "")).filter(F.length(column) > 0)


def last_by_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: each column's last non-null value in the given order. Rows with a null key go."""
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    return df.dropna(subset=keys).groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in rest)).select(df.columns)


def forward_fill(df: DataFrame, columns: list[str], by: str = "symbol", order: list[str] | None = None) -> DataFrame:
    """The last value before within a symbol, then the median over all rows (of the filled values). What is filled is written,
    as the median reads it three times."""
    filled = written(with_running(df, [by], order or ["report_date"], {c: ("last", F.col(c)) for c in columns}))
    return fill_median(filled, columns)


def fill_median(df: DataFrame, columns: list[str]) -> DataFrame:
    m = quantile_values(df, {c: F.col(c) for c in columns}, [0.5])
    return df.fillna({c: m[c][0] for c in columns if m[c] is not None})


def fill_text(df: DataFrame, columns: list[str], value: str = "Other") -> DataFrame:
    return df.fillna(value, subset=columns)


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require(df: DataFrame, required: Iterable[str]) -> DataFrame:
    if gone := missing_columns(df, required):
        raise ValueError(f"missing columns: {gone}")
    return df


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_values, all_null: one pass."""
    return df.agg(*(F.count(c).alias(c) for c in columns)).unpivot([], columns, "column", "n_values").withColumn("all_null", F.col("n_values") == 0)


def range_violations(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """column, n_out: values outside their range, one pass."""
    return df.agg(*(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(c) for c, (lo, hi) in ranges.items())).unpivot([], list(ranges), "column", "n_out")


def window_predicate(day: Column, hour: Column, start: Column, end: Column) -> Column:
    """Reports after the close of the first day or before the open of the last."""
    return ((day == start) & (hour == "amc")) | ((day == end) & (hour == "bmo"))


def candidate_reason(estimate: Column, actual: Column, in_window: Column, cap: Column | None = None, min_cap: float = 0.0, low: float = 1.0, high: float = 600.0, strict_cap: bool = False) -> Column:
    """Why a calendar entry is dropped, the first rule that fails; null for a candidate."""
    s = surprise_pct(actual, estimate)
    out = F.when(estimate.isNull() | actual.isNull(), "missing_eps").when(estimate == 0, "zero_estimate").when(actual < 0, "negative_actual").when(s <= low, "low_surprise").when(s > high, "high_surprise").when(~in_window, "outside_window")
    if cap is not None:
        out = out.when(cap.isNull(), "no_profile").when((cap <= min_cap) if strict_cap else (cap < min_cap), "small_cap")
    return out


def sample_gate(df: DataFrame, day: str = "report_date", min_rows: int = 50, min_days: int = 60) -> DataFrame:
    """n, first and last day, days spanned and whether the table is large enough."""
    out = df.agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return out.withColumn("span_days", F.datediff("last_day", "first_day")).withColumn("enough", (F.col("n") >= min_rows) & (F.col("span_days") > min_days))


def feature_quality(df: DataFrame, columns: list[str], max_missing: float = 0.05, min_distinct: int = 20, max_unique: float = 0.95, approx: bool = False) -> DataFrame:
    """column, missing share, distinct values and whether the column may be a feature. approx counts distinct values
    by a sketch; exact counts come from one grouping of all columns' values, combined in each task before the shuffle."""
    if approx:
        r = df.agg(F.count("*").alias("n"), *(F.struct(F.count(c).alias("k"), F.approx_count_distinct(c).alias("d")).alias(c) for c in columns))
        long = r.select("n", F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c)["k"].alias("k"), F.col(c)["d"].alias("n_distinct")) for c in columns))))
    else:
        values = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
        counts = df.select(values).groupBy("column", "value").agg(F.count("*").alias("c"))
        long = counts.groupBy("column").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("c"))), F.lit(0)).alias("k"), F.count("value").alias("n_distinct"))
        every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # an empty table has a row a column too
        long = every.join(long, "column", "left").fillna(0)
    missing = F.try_divide(F.col("n") - F.col("k"), F.col("n"))
    return long.select("column", missing.alias("missing"), "n_distinct", F.coalesce((missing < max_missing) & (F.col("n_distinct") > min_distinct) & (F.col("n_distinct") < max_unique * F.col("n")), F.lit(False)).alias("usable"))


def target_columns(df: DataFrame, columns: list[str], coverage: float = 0.9, min_std: float = 0.001, max_mean: float = 0.1) -> DataFrame:
    """column, coverage, mean, std and whether it may be the target; `ordinal` keeps the order of preference."""
    r = df.agg(F.count("*").alias("_n"), *(F.struct(F.count(c).alias("k"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.try_divide(F.col(c)["k"], F.col("_n")).alias("coverage"), F.col(c)["mean"].alias("mean"), F.col(c)["std"].alias("std")) for i, c in enumerate(columns)))
    return r.select(F.inline(rows)).withColumn("valid", (F.col("coverage") >= coverage) & (F.col("std") > min_std) & (F.abs("mean") < max_mean))
