"""Scalar column expressions of the domain: surprises, business days, times of day, labels, formats.

All take and return Columns. Divisions by zero and missing inputs give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

MISSING = -999.0
SESSION_OPEN, SESSION_MINUTES = 570, 390
#: Edges and names of the return classes, and of the surprise classes.
RETURN_EDGES, RETURN_NAMES = [-0.05, -0.02, -0.005, 0.005, 0.02, 0.05], ["large_down", "med_down", "small_down", "flat", "small_up", "med_up", "large_up"]
SURPRISE_EDGES, SURPRISE_NAMES = [2.0, 5.0, 10.0], ["small", "medium", "large", "huge"]
#: Entry times by timeframe.
BUY_TIMES = {"market_open": "09:30:00", "1min": "09:31:00", "5min": "09:35:00", "15min": "09:45:00", "30min": "10:00:00", "1hr": "10:30:00", "close": "15:59:00"}


def safe_double(text: Column, default: float = 0.0, limit: float | None = 1000.0) -> Column:
    """Text or number as a double; null, words and infinities give the default; clamped to +-limit."""
    x = F.trim(F.lower(text.cast("string"))).try_cast("double")
    x = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(float(default))).otherwise(x)
    return x if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def safe_int(text: Column, default: int = -1) -> Column:
    return F.coalesce(F.trim(text.cast("string")).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def surprise_pct(actual: Column, estimate: Column) -> Column:
    return F.try_divide(actual - estimate, F.abs(estimate)) * 100


def pct_change(old: Column, new: Column) -> Column:
    return F.try_divide(new - old, old) * 100


def prev_business_day(day: Column) -> Column:
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def next_business_day(day: Column) -> Column:
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def is_business_day(day: Column) -> Column:
    return F.weekday(day) < 5


def reaction_date(day: Column, hour: Column) -> Column:
    """The session that reacts: the same day before the open (bmo), the next business day after the close (amc)."""
    return F.when(hour == "amc", next_business_day(day)).otherwise(day)


def week_ranges(start: Column, end: Column) -> Column:
    """Array of (from, to): seven-day ranges from start, the last cut at end."""
    return F.transform(F.sequence(start, end, F.expr("interval 7 days")), lambda d: F.struct(d.cast("date").alias("from"), F.least(F.date_add(d.cast("date"), 6), end).alias("to")))


def last_business_days(day: Column, n: int) -> Column:
    """Array of the n business days before a day, the latest first."""
    span = F.sequence(F.date_sub(day, 1), F.date_sub(day, n // 5 * 7 + 9), F.expr("interval -1 day"))
    return F.slice(F.filter(F.transform(span, lambda d: d.cast("date")), is_business_day), 1, n)


def minutes_since_open(clock: Column) -> Column:
    """HH:MM as minutes after 09:30; null outside 0 to 390 or if malformed."""
    hour, minute = (F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", i).try_cast("int") for i in (1, 2))
    m = hour * 60 + minute - SESSION_OPEN
    return F.when(m.between(0, SESSION_MINUTES), m)


def earnings_time_code(clock: Column) -> Column:
    c = F.lower(F.trim(clock))
    return F.when(c == "bmo", 0).when(c == "amc", 1).otherwise(-1)


def data_source_code(source: Column) -> Column:
    return F.when(F.lower(source) == "alpaca", 1).otherwise(0)


def cut(x: Column, edges: list[float], names: list[str]) -> Column:
    """Right-closed classes: the name of the first edge that x does not exceed, else the last name."""
    out = F.when(x.isNull(), None)
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x <= edge, name)
    return out.otherwise(names[-1])


def equal_width(x: Column, low: Column, high: Column, names: list[str]) -> Column:
    """Classes of equal width over (low, high], the lowest value included."""
    n = len(names)
    at = F.ceil(F.try_divide(x - low, (high - low) / n))
    at = F.when(x.isNotNull() & at.isNull(), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(n), at)))
    return F.when(x.isNotNull(), F.element_at(F.array(*map(F.lit, names)), at.cast("int")))


def _total(parts: list[Column], start: Column) -> Column:
    return reduce(Column.__add__, parts, start)


def row_std(*columns: Column) -> Column:
    """Sample standard deviation across columns, nulls left out; null below two values."""
    n = _total([c.isNotNull().cast("int") for c in columns], F.lit(0))
    mean = F.try_divide(_total([F.coalesce(c, F.lit(0.0)) for c in columns], F.lit(0.0)), n)
    square = _total([F.coalesce((c - mean) * (c - mean), F.lit(0.0)) for c in columns], F.lit(0.0))
    return F.when(n >= 2, F.sqrt(F.try_divide(square, n - 1)))


def row_range(*columns: Column) -> Column:
    return F.greatest(*columns, columns[0]) - F.least(*columns, columns[0])


def positive_share(*columns: Column, default: float = 0.5) -> Column:
    positive = [F.when(c > 0, 1).otherwise(0) for c in columns]
    return F.coalesce(F.try_divide(_total(positive, F.lit(0)), _total([c.isNotNull().cast("int") for c in columns], F.lit(0))), F.lit(default))


def sigmoid(x: Column, low: float = 0.001, high: float = 0.999) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), 1 / (1 + F.exp(-x))))


def effect_label(d: Column) -> Column:
    d = F.abs(d)
    return F.when(d < 0.2, "negligible").when(d < 0.5, "small").when(d < 0.8, "medium").when(d.isNotNull(), "large")


def risk_level(drawdown: Column) -> Column:
    d = F.abs(drawdown)
    return F.when(d < 0.05, "LOW").when(d < 0.10, "MEDIUM").when(d.isNotNull(), "HIGH")


def buy_time(timeframe: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for kv in BUY_TIMES.items() for v in kv)), F.lower(timeframe)), F.lit(BUY_TIMES["market_open"]))


def signed_pct(x: Column) -> Column:
    """+1.23% or N/A."""
    return F.when(x.isNull() | (x == MISSING), "N/A").otherwise(F.format_string("%+.2f%%", x))


def thousands(x: Column) -> Column:
    return F.when(x.isNull() | (x < 0), "N/A").otherwise(F.format_number(x, 0))


def rule_text(feature: Column, direction: Column, threshold: Column) -> Column:
    return F.concat_ws(" ", feature, direction, F.format_string("%.4f", threshold))


def trading_signal(strategy: Column, sharpe: Column, power: Column, p: Column) -> Column:
    """Struct with the action and a confidence: the lesser of power and 1 - p."""
    return F.struct(strategy.alias("strategy"), F.when(sharpe > 0, "BUY").otherwise("SELL").alias("action"), F.least(power, 1 - p).alias("confidence"))
