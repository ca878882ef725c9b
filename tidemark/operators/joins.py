"""Look-ups as joins: profiles, previous closes, reaction sessions, fallbacks, exclusions, gap bins, as-of volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.scalar import prev_business_day, reaction_date

#: A side is broadcast only below this size (Spark's own estimate decides for all other joins).
MAX_BINS = 10_000


def with_profile(calendar: DataFrame, profile: DataFrame) -> DataFrame:
    """Entries with their company profile; entries without one go."""
    return calendar.join(profile, "symbol")


def with_prev_close(candidates: DataFrame, closes: DataFrame, default: float = 0.0) -> DataFrame:
    """candidates with prev_close(symbol, prev_close), the default where there is none."""
    return candidates.join(closes, "symbol", "left").withColumn("prev_close", F.coalesce("prev_close", F.lit(default)))


def on_reaction_day(candidates: DataFrame, sessions: DataFrame, day: str = "day", hour: str = "hour") -> DataFrame:
    """candidates with the session row (symbol, session_day, ...) of the day that reacts."""
    c = candidates.withColumn("session_day", reaction_date(F.col(day), F.col(hour)))
    return c.join(sessions, ["symbol", "session_day"])


def previous_session_close(rows: DataFrame, sessions: DataFrame, day: str = "session_day") -> DataFrame:
    """rows with prev_close: the close of the business day before."""
    before = sessions.select("symbol", F.col("session_day").alias("_day"), F.col("close").alias("prev_close"))
    return rows.withColumn("_day", prev_business_day(F.col(day))).join(before, ["symbol", "_day"], "left").drop("_day")


def asof_close(rows: DataFrame, sessions: DataFrame, day: str = "session_day") -> DataFrame:
    """rows with prev_close: the last close strictly before the day, however long ago. One sort of the union by symbol
    and day; no join."""
    both = rows.withColumns({"_kind": F.lit(0), "_day": F.col(day), "_close": F.lit(None).cast("double")}).unionByName(sessions.select("symbol", F.col("session_day").alias("_day"), F.lit(1).alias("_kind"), F.col("close").alias("_close")), allowMissingColumns=True)
    w = Window.partitionBy("symbol").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("prev_close", F.last("_close", ignorenulls=True).over(w)).filter("_kind = 0").drop("_kind", "_day", "_close")


def with_fallback(rows: DataFrame, primary: DataFrame, fallback: DataFrame, keys: list[str], values: list[str], labels: tuple[str, str] = ("Alpaca", "Finnhub")) -> DataFrame:
    """Values from the primary source, else the fallback, with the source's name (FAILED if neither has the row)."""
    p = primary.select(*keys, F.struct(*values).alias("_p"))
    f = fallback.select(*keys, F.struct(*values).alias("_f"))
    out = rows.join(p, keys, "left").join(f, keys, "left")
    source = F.when(F.col("_p").isNotNull(), labels[0]).when(F.col("_f").isNotNull(), labels[1]).otherwise("FAILED")
    return out.withColumns({v: F.when(F.col("_p").isNotNull(), F.col(f"_p.{v}")).otherwise(F.col(f"_f.{v}")) for v in values} | {"data_source": source}).drop("_p", "_f")


def exclude(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(done.select(*keys), keys, "left_anti")


def match_bin(rows: DataFrame, bins: DataFrame, value: Column) -> DataFrame:
    """rows with the first bin (by ordinal) whose half-open range holds the value; null if none does. Bins are a small
    configured table, at most MAX_BINS rows, held as one array, so no row is multiplied."""
    listed = [r["b"] for r in bins.orderBy("ordinal").select(F.struct("ordinal", "range_min", "range_max", "stop_loss", "target_profit").alias("b")).limit(MAX_BINS + 1).collect()]
    if len(listed) > MAX_BINS:
        raise ValueError(f"more than {MAX_BINS} bins")
    entry = "struct<ordinal:int,range_min:double,range_max:double,stop_loss:double,target_profit:double>"
    table = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in b.asDict().items())).cast(entry) for b in listed)) if listed else F.array().cast(f"array<{entry}>")
    return rows.withColumn("bin", F.try_element_at(F.filter(table, lambda b: (value >= b["range_min"]) & (value < b["range_max"])), F.lit(1)))


def revenue_entry(candidates: DataFrame, calendar: DataFrame) -> DataFrame:
    """candidates(symbol, day) with the first calendar entry of the symbol from one day before to one after."""
    c = candidates.select("symbol", "day").distinct()
    e = calendar.select("symbol", F.explode(F.sequence(F.date_sub("day", 1), F.date_add("day", 1))).alias("probe"), F.struct("day", "entry_id", "revenue_estimate", "revenue_actual").alias("entry"))
    hit = c.join(e, (c["symbol"] == e["symbol"]) & (c["day"] == e["probe"]), "left").groupBy(c["symbol"], c["day"]).agg(F.min("entry").alias("entry"))
    return candidates.join(hit, ["symbol", "day"], "left")


def average_before(rows: DataFrame, sessions: DataFrame, n: int, min_n: int, span_days: int, positive: bool = False, name: str = "avg_volume") -> DataFrame:
    """rows(symbol, session_day) with the mean volume of the n sessions strictly before the day and at most span_days
    back; null below min_n of them. One window over the union of both tables, by symbol and day."""
    s = sessions.filter("volume > 0") if positive else sessions
    days = rows.select("symbol", "session_day").distinct()
    both = s.select("symbol", "session_day", F.lit(1).alias("_kind"), "volume").unionByName(days.select("symbol", "session_day", F.lit(0).alias("_kind"), F.lit(None).cast("double").alias("volume")))
    # the marker of a day sorts before the session of that day; markers carry no volume, so they need no place in the frame
    w = Window.partitionBy("symbol").orderBy(F.datediff("session_day", F.lit("1970-01-01").cast("date"))).rangeBetween(-span_days, -1)
    held = F.sort_array(F.collect_list(F.when(F.col("_kind") == 1, F.struct("session_day", "volume"))).over(w), asc=False)  # span_days entries at most
    last = F.transform(F.slice(held, 1, n), lambda x: x["volume"])
    mean = F.when(F.size(last) >= min_n, F.aggregate(last, F.lit(0.0), lambda a, v: a + v) / F.size(last))
    found = both.withColumn(name, mean).filter("_kind = 0").select("symbol", "session_day", name)
    return rows.join(found, ["symbol", "session_day"], "left")
