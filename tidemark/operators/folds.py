"""Time-aware folds. Bounds come from a table of distinct days with counts (small); rows meet them by day."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_DAYS = 200_000
SCHEMA = "fold int, role string, start date, end date"


def day_counts(df: DataFrame, day: str = "d") -> list[tuple[date, int]]:
    """Distinct days with their rows, in order; calendars are bounded, and checked."""
    rows = df.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n")).orderBy("day").limit(MAX_DAYS + 1).collect()
    if len(rows) > MAX_DAYS:
        raise ValueError(f"more than {MAX_DAYS} distinct days")
    return [(r["day"], r["n"]) for r in rows]


def _table(spark: SparkSession, bounds: list[tuple[int, str, date, date]]) -> DataFrame:
    return spark.createDataFrame(bounds, SCHEMA)


def expanding(df: DataFrame, day: str = "d", splits: int = 3, start: float = 0.6, step: float = 0.08, test: float = 0.15, embargo_days: int = 1, purge_days: int = 0, min_train: int = 50, min_test: int = 10, min_test_days: int = 10) -> DataFrame:
    """Training from the first day to a growing share of the days, then a gap of embargo_days, then the test days;
    the last purge_days before the gap leave the training."""
    days = day_counts(df, day)
    n, out = len(days), []
    for i in range(splits):
        end = int(n * (start + step * i))
        if not 0 < end < n:
            continue
        last = days[end - 1][0] - timedelta(days=purge_days)
        first_test = days[end - 1][0] + timedelta(days=embargo_days)
        later = [(d, k) for d, k in days[end:] if d > first_test][: max(min_test_days, int(n * test))]
        train = sum(k for d, k in days if d <= last)
        if len(later) >= min_test_days and train > min_train and sum(k for _, k in later) > min_test:
            out += [(i, "train", days[0][0], last), (i, "test", later[0][0], later[-1][0])]
    return _table(df.sparkSession, out)


def rolling_rows(n: int, max_folds: int = 4) -> list[tuple[int, str, int, int]]:
    """(fold, role, first position, last position) of n rows in order: below 1000 rows 60 % then 20 %, else rolling
    windows of half the rows and 15 %."""
    if n < 1000:
        a, b = int(n * 0.6), int(n * 0.8)
        return [(0, "train", 0, a - 1), (0, "test", a, b - 1)] + ([(1, "train", 0, b - 1), (1, "test", b, n - 1)] if n - b >= 10 else [])
    train, test, out = int(n * 0.5), int(n * 0.15), []
    for i in range(max_folds):
        first = i * test
        if first + train + test > n:
            break
        out += [(i, "train", first, first + train - 1), (i, "test", first + train, first + train + test - 1)]
    return out


def monthly(df: DataFrame, day: str = "d", initial_days: int = 90, test_days: int = 30, max_folds: int = 6, min_span: int = 180) -> DataFrame:
    """Monthly walk-forward: training from the first day, test windows of test_days; a 70/30 split if the span is short."""
    days = day_counts(df, day)
    if not days:
        return _table(df.sparkSession, [])
    first, last = days[0][0], days[-1][0]
    if (last - first).days < min_span:
        cut = days[min(len(days) - 1, int(len(days) * 0.7))][0]
        return _table(df.sparkSession, [(0, "train", first, cut - timedelta(days=1)), (0, "test", cut, last)])
    out = []
    for i in range(max_folds):
        at = first + timedelta(days=initial_days + test_days * i)
        if at + timedelta(days=test_days - 1) > last:
            break
        out += [(i, "train", first, at - timedelta(days=1)), (i, "test", at, at + timedelta(days=test_days - 1))]
    return _table(df.sparkSession, out)


def assign(df: DataFrame, folds: DataFrame, day: str = "d") -> DataFrame:
    """df with fold and role, a row for each fold that holds its day. The bounds are literals, so no join is needed."""
    bounds = folds.collect()  # two rows a fold
    hits = [F.when(F.col(day).between(F.lit(b["start"]), F.lit(b["end"])), F.struct(F.lit(b["fold"]).alias("fold"), F.lit(b["role"]).alias("role"))) for b in bounds]
    if not hits:
        return df.withColumns({"fold": F.lit(None).cast("int"), "role": F.lit(None).cast("string")}).limit(0)
    return df.select("*", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def spans(folds: DataFrame, day: str = "d") -> tuple[Column, list[tuple[int, int, str]]]:
    """The span of days that a row lies in, and the (span, fold, role) that belong together.

    Days are cut at every bound of a fold, so a span lies whole within a fold's part or outside of it, and a row has one span
    however many folds hold it."""
    bounds = folds.collect()  # two rows a fold
    cuts = sorted({x for b in bounds for x in (b["start"], *([b["end"] + timedelta(days=1)] if b["end"] < date.max else []))})
    at = reduce(Column.__add__, ((F.col(day) >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    return at, [(i + 1, b["fold"], b["role"]) for i, c in enumerate(cuts) for b in bounds if b["start"] <= c <= b["end"]]


def pooled(predictions: DataFrame, key: str = "row_id", value: str = "p", also: tuple[str, ...] = ()) -> DataFrame:
    """Out-of-fold predictions averaged by row, with columns that depend on the key; rows without one get the overall mean."""
    mean = predictions.agg(F.avg(value)).first()[0]
    return predictions.groupBy(key).agg(F.coalesce(F.avg(value), F.lit(mean)).alias(value), *(F.first(c).alias(c) for c in also))
