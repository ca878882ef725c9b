"""Engineered columns of earnings records. Each group takes and returns one DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.scalar import SURPRISE_EDGES, SURPRISE_NAMES, cut, equal_width, positive_share, row_range, row_std
from tidemark.plans.prefix import noted, quantile_values, row_numbers, with_halo, with_ranks
from tidemark.shared import new_path

INTRADAY = ["pct_1min", "pct_5min", "pct_15min", "pct_30min", "pct_1hr"]
SMALL_GAP, SPIKE_7D, SPIKE_30D = 0.005, 1.5, 2.0
CAP_NAMES = ["XS", "S", "M", "L", "XL"]


def flag(x: Column) -> Column:
    """1 if true, else 0 (null counts as false)."""
    return F.when(x, 1).otherwise(0)


def scalar(df: DataFrame, *columns: Column) -> list:
    """One row of global aggregates, fetched so that it folds into later expressions as literals."""
    return list(df.agg(*columns).first())


def premarket(df: DataFrame) -> DataFrame:
    mid, ref = (F.col("premarket_high") + F.col("premarket_low")) / 2, F.col("reference_prev_close")
    return df.withColumns({"premarket_range": F.try_divide(F.col("premarket_high") - F.col("premarket_low"), ref), "premarket_midpoint": mid, "premarket_gap": F.try_divide(mid - ref, ref), "open_gap": F.try_divide(F.col("open_price") - ref, ref), "premarket_volume_normalized": F.log1p("premarket_volume")})


def market_cap(df: DataFrame) -> DataFrame:
    df = df.withColumns({"market_cap_log": F.log1p(F.coalesce("market_cap", F.lit(0.0))), "market_cap_billions": F.col("market_cap") / 1000})
    low, high = scalar(df, F.min("market_cap_log"), F.max("market_cap_log"))
    return df.withColumn("market_cap_bucket", equal_width(F.col("market_cap_log"), F.lit(low), F.lit(high), CAP_NAMES))


def volume(df: DataFrame) -> DataFrame:
    ratio = lambda avg: F.when(F.col(avg) > 0, F.col("opening_minute_volume") / F.col(avg)).otherwise(1.0)
    df = df.withColumns({"opening_volume_log": F.log1p("opening_minute_volume"), "volume_30d_log": F.log1p("volume_30_day_avg"), "volume_7d_log": F.log1p("volume_7_day_avg"), "volume_ratio_30_day": ratio("volume_30_day_avg"), "volume_ratio_7_day": ratio("volume_7_day_avg")})
    return df.withColumns({"volume_spike_30d": flag(F.col("volume_ratio_30_day") > SPIKE_30D), "volume_spike_7d": flag(F.col("volume_ratio_7_day") > SPIKE_7D)})


def intraday(df: DataFrame) -> DataFrame:
    c = [F.col(x) for x in INTRADAY]
    return df.withColumns({
        "intraday_vol": row_std(*c), "intraday_range": row_range(*c), "early_momentum": F.col("pct_5min") / (F.abs("pct_1min") + 0.001),
        "momentum_acceleration": (F.col("pct_30min") - F.col("pct_5min")) / (F.abs("pct_5min") + 0.001), "direction_consistency": positive_share(*c),
    })


def rolled(df: DataFrame, by: str, order: tuple[str, ...], before: int, add, parts: int | None = None) -> DataFrame:
    """add(rows, window), whose frames look back `before` rows at most, over ranges of each group (see with_halo)."""
    window = Window.partitionBy("_part", by).orderBy(*order)
    out = add(with_halo(df, [by], list(order), before, parts), window)
    return out.filter(~F.col("_halo")).drop("_part", "_halo")


def _regime(frame: int, prob: float):
    def add(rows: DataFrame, window) -> DataFrame:
        w = window.rowsBetween(1 - frame, 0)
        full = F.count("intraday_vol").over(w) == frame
        return rows.withColumn("high_vol_regime", flag(full & (F.col("intraday_vol") > F.percentile("intraday_vol", prob).over(w))))

    return add


def vol_regime(df: DataFrame, frame: int = 20, prob: float = 0.75, parts: int | None = None) -> DataFrame:
    """high_vol_regime: a record's volatility above the rolling percentile of its symbol's last `frame` records."""
    return rolled(df, "symbol", ("report_date", "record_id"), frame - 1, _regime(frame, prob), parts)


def surprise(df: DataFrame) -> DataFrame:
    q = quantile_values(df, {"surprise": F.col("surprise")}, [0.2, 0.8])["surprise"]
    s, r = F.col("surprise"), F.col("revenue_surprise")
    low, high = (F.lit(x) for x in (q or [None, None]))
    magnitude = F.when(F.abs(s) > 0, cut(F.abs(s), SURPRISE_EDGES, SURPRISE_NAMES))  # the lowest edge, 0, is open
    return df.withColumns({"surprise_abs": F.abs(s), "revenue_surprise_abs": F.abs(r), "surprise_large_positive": flag(s > high), "surprise_large_negative": flag(s < low), "surprise_magnitude": magnitude, "combined_surprise": (s + r) / 2, "surprise_mismatch": flag(s * r < 0)})


def timing(df: DataFrame, day: str = "report_date") -> DataFrame:
    d = F.col(day)
    return df.withColumns({
        "earnings_bmo": flag(F.col("earnings_time") == 0), "earnings_amc": flag(F.col("earnings_time") == 1), "month": F.month(d), "quarter": F.quarter(d), "year": F.year(d), "day_of_week": F.weekday(d), "is_monday": flag(F.weekday(d) == 0), "is_friday": flag(F.weekday(d) == 4),
        "earnings_season": flag(F.month(d).isin(1, 4, 7, 10)), "is_month_end": flag(d == F.last_day(d)), "is_quarter_end": flag((d == F.last_day(d)) & F.month(d).isin(3, 6, 9, 12)),
    })


def price_action(df: DataFrame) -> DataFrame:
    h, low, gap = F.col("high_price"), F.col("low_price"), F.col("open_gap")
    return df.withColumns({"high_low_ratio": F.try_divide(h, low), "close_position": F.try_divide(F.col("close_price") - low, h - low), "gap_up": flag(gap > SMALL_GAP), "gap_down": flag(gap < -SMALL_GAP), "gap_magnitude": F.abs(gap), "high_before_low_flag": F.coalesce("high_before_low", F.lit(0))})


def moments(df: DataFrame, columns: list[str], by: str) -> tuple[DataFrame, bool]:
    """Mean and deviation of each column by group, a written table, and whether it may be sent to every task."""
    return noted(df.groupBy(F.col(by).alias("_by")).agg(*(x for i, c in enumerate(columns) for x in (F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}")))))


def with_moments(df: DataFrame, by: str, stats: DataFrame, small: bool) -> DataFrame:
    return df.join(F.broadcast(stats) if small else stats, F.col(by).eqNullSafe(F.col("_by")), "left")


def zscores(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """df with <c>_<by>_zscore, from the moments of its groups that with_moments has set."""
    return df.withColumns({f"{c}_{by}_zscore": (F.col(c) - F.col(f"_m{i}")) / (F.col(f"_s{i}") + 1e-6) for i, c in enumerate(columns)})


def relative(df: DataFrame, columns: list[str], by: str = "sector") -> DataFrame:
    """Rank (ties averaged, over the number of values) and z-score of each column within its group. Ranks come from
    distinct values with counts in bins, so a hot group meets in no task; groups are few, else joined by their key."""
    stats, small = moments(df, columns, by)
    out = df
    for c in columns:
        out = with_ranks(out, df, c, f"{c}_{by}_rank", [by], share=True)
    out = zscores(with_moments(out, by, stats, small), columns, by)
    return out.select(*df.columns, *(f"{c}_{by}_{x}" for c in columns for x in ("rank", "zscore")))


def interactions(df: DataFrame) -> DataFrame:
    pairs = {"surprise_x_volume_ratio_7d": ("surprise", "volume_ratio_7_day"), "surprise_x_volume_ratio_30d": ("surprise", "volume_ratio_30_day"), "surprise_x_premarket_vol": ("surprise", "premarket_volume_normalized"), "surprise_x_market_cap": ("surprise", "market_cap_log"), "surprise_x_gap": ("surprise", "open_gap"), "surprise_x_earnings_time": ("surprise", "earnings_bmo"), "volume_x_gap": ("volume_ratio_7_day", "gap_magnitude"), "volume_x_market_cap": ("volume_ratio_7_day", "market_cap_log"), "premarket_gap_x_volume": ("premarket_gap", "premarket_volume_normalized"), "premarket_range_x_surprise": ("premarket_range", "surprise")}
    return df.withColumns({n: F.col(a) * F.col(b) for n, (a, b) in pairs.items()})


def with_market(df: DataFrame, day: str = "report_date") -> DataFrame:
    """df with the market's mean return of the day, column _market."""
    market, small = noted(df.groupBy(day).agg(F.avg("pct_change_close").alias("_market")))
    return df.join(F.broadcast(market) if small else market, day, "left")


def market_regimes(df: DataFrame) -> DataFrame:
    """high_vol_day, market_return as with_market has set it, and whether that is among the best or worst 40 % of rows."""
    found = quantile_values(df, {c: F.col(c) for c in ("intraday_range", "_market")}, [0.4, 0.6, 0.7])
    vol, q = (found[c] or [None] * 3 for c in ("intraday_range", "_market"))
    return df.withColumns({"market_return": F.col("_market"), "high_vol_day": flag(F.col("intraday_range") > F.lit(vol[2])), "bull_regime": flag(F.col("_market") > F.lit(q[1])), "bear_regime": flag(F.col("_market") < F.lit(q[0]))})


def day_regimes(df: DataFrame, day: str = "report_date") -> DataFrame:
    """high_vol_day, the market's mean return of the day, and whether that is among the best or worst 40 % of rows."""
    return market_regimes(with_market(df, day)).drop("_market")


def top_values(df: DataFrame, column: str, k: int) -> list[str]:
    return [r[0] for r in df.filter(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(k).collect()]


def one_hot(df: DataFrame, sectors: int = 8, industries: int = 6, sources: int = 20) -> DataFrame:
    """0/1 columns for the most frequent sectors and industries, sources and size buckets."""
    wanted = {"sector": top_values(df, "sector", sectors), "industry": top_values(df, "industry", industries), "data_source": top_values(df, "data_source", sources)} | ({"market_cap_bucket": CAP_NAMES} if "market_cap_bucket" in df.columns else {})
    prefix = {"market_cap_bucket": "cap_bucket"}
    return df.withColumns({f"{prefix.get(c, c)}_{v}": flag(F.col(c) == v) for c, values in wanted.items() for v in values})


def _lagged(columns: list[str], frame: int):
    def add(rows: DataFrame, window) -> DataFrame:
        near = window.rowsBetween(1 - frame, 0)
        return rows.withColumns({k: v for c in columns for k, v in ((f"{c}_lag1", F.lag(c).over(window)), (f"{c}_rolling_mean", F.avg(c).over(near)), (f"{c}_rolling_std", F.stddev_samp(c).over(near)))})

    return add


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """<c>_rolling_mean and <c>_rolling_std over two records, from a value and its <c>_lag1."""
    out = {}
    for c in columns:
        x, before = F.col(c), F.col(f"{c}_lag1")
        d = x - before
        out |= {f"{c}_rolling_mean": F.coalesce((before + x) / 2, x, before), f"{c}_rolling_std": F.sqrt(d * (d - d / 2))}
    return df.withColumns(out)


def lags(df: DataFrame, columns: list[str], frame: int = 2, parts: int | None = None) -> DataFrame:
    """<c>_lag1, and rolling mean and deviation over `frame` records of the symbol."""
    return rolled(df, "symbol", ("report_date", "record_id"), max(1, frame - 1), _lagged(columns, frame), parts)


def rolling_moments(df: DataFrame, value: str, frame: int, by: str, order: tuple[str, ...], parts: int | None = None) -> DataFrame:
    """rolling_mean and rolling_std of a value over the group's last `frame` rows."""

    def add(rows: DataFrame, window) -> DataFrame:
        near = window.rowsBetween(1 - frame, 0)
        return rows.withColumns({"rolling_mean": F.avg(value).over(near), "rolling_std": F.stddev_samp(value).over(near)})

    return rolled(df, by, order, frame - 1, add, parts)


def price_returns(df: DataFrame) -> DataFrame:
    """Returns against the open, range and gap against the previous close, volume ratio, as fractions."""
    o, p = F.col("open_price"), F.col("reference_prev_close")
    return df.withColumns({"return_open_close": F.try_divide(F.col("close_price") - o, o), "return_open_high": F.try_divide(F.col("high_price") - o, o), "return_open_low": F.try_divide(F.col("low_price") - o, o), "daily_range": F.try_divide(F.col("high_price") - F.col("low_price"), o), "gap_pct": F.try_divide(o - p, p), "volume_ratio": F.try_divide("opening_minute_volume", "volume_30_day_avg")})


def moving_averages(df: DataFrame, price: str = "close_price", frames: tuple[int, ...] = (5, 10, 20, 50), by: str = "symbol", order: tuple[str, ...] = ("report_date", "record_id"), parts: int | None = None) -> DataFrame:
    """sma_<n> (null below n/2 values) and the price against it."""

    def add(rows: DataFrame, window) -> DataFrame:
        near = {n: window.rowsBetween(1 - n, 0) for n in frames}
        return rows.withColumns({f"sma_{n}": F.when(F.count(price).over(w) >= max(1, n // 2), F.avg(price).over(w)) for n, w in near.items()})

    df = rolled(df, by, order, max(frames) - 1, add, parts)
    return df.withColumns({f"price_vs_sma_{n}": F.try_divide(price, f"sma_{n}") - 1 for n in frames})


def rsi(df: DataFrame, price: str = "close_price", n: int = 14, by: str = "symbol", order: tuple[str, ...] = ("report_date", "record_id"), parts: int | None = None) -> DataFrame:
    """Relative strength from simple means of gains and losses over n changes; null below n changes."""

    def add(rows: DataFrame, window) -> DataFrame:
        rows = rows.withColumn("_d", F.col(price) - F.lag(price).over(window))
        near = window.rowsBetween(1 - n, 0)
        gain, loss = (F.avg(F.when(F.col("_d").isNotNull(), F.greatest(s * F.col("_d"), F.lit(0.0)))).over(near) for s in (1, -1))
        rs = F.when(F.count("_d").over(near) == n, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(gain, loss))))
        return rows.withColumn(f"rsi_{n}", rs).drop("_d")

    return rolled(df, by, order, n, add, parts)  # n changes take one row more


def label_codes(df: DataFrame, column: str = "sector") -> DataFrame:
    """<column>_code: the value's place in alphabetical order, from 0, for any number of values. They are numbered by
    blocks of one beginning."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct().withColumn("_begin", F.substring("_v", 1, 3))
    codes = row_numbers(values, "_begin", ["_v"], "_code").select("_v", F.col("_code").cast("int").alias(f"{column}_code"))
    return df.join(codes, F.col(column) == F.col("_v"), "left").drop("_v")


def small_methods(spark: SparkSession) -> None:
    """Has Spark split generated methods that the JVM would leave to its interpreter for their size, unless the session says
    otherwise. It holds for the rest of the session, as columns are computed when a result is read; results do not change."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def written(df: DataFrame) -> DataFrame:
    path = new_path(df.sparkSession, "features")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def engineer(df: DataFrame, frame: int = 20, prob: float = 0.75, parts: int | None = None, make=lambda rows, also: rows) -> DataFrame:
    """All groups in their order of dependence.

    df has records, or narrower rows that make(rows, also) turns into records one by one, passing on the columns in also. Only
    rows of df are stored and moved. Windows and ranks are found over the few columns they read, under a number of the row's
    own, and meet the rows in one join, whose table is written. All else is read off it, row by row; so are moments of pairs
    and z-scores, which no join carries."""
    small_methods(df.sparkSession)
    ranked, lagged = ["surprise", "market_cap_log", "volume_ratio_7_day"], ["surprise", "volume_ratio_7_day", "pct_change_close"]
    ranks, before = [f"{c}_sector_rank" for c in ranked], [f"{c}_lag1" for c in lagged]
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()))
    some = make(rows, ["_row"])
    names = [c for c in some.columns if c != "_row"]
    for step in (premarket, market_cap, volume, intraday):
        some = step(some)
    stats, small = moments(some, ranked, "sector")
    places = values = some.select("_row", "sector", *ranked)
    for c, rank in zip(ranked, ranks, strict=True):
        places = with_ranks(places, values, c, rank, ["sector"], share=True)
    scores = [f"{c}_sector_zscore" for c in ranked]
    far = [] if small else scores  # many groups: the thin rows meet them
    places = (places if small else zscores(with_moments(places, "sector", stats, small), ranked, "sector")).select("_row", *ranks, *far)
    run = some.select("_row", "symbol", "report_date", "record_id", "intraday_vol", *lagged)
    windows = rolled(run, "symbol", ("report_date", "record_id"), max(1, frame - 1), lambda rows, w: _regime(frame, prob)(rows, w).withColumns({f"{c}_lag1": F.lag(c).over(w) for c in lagged}), parts).select("_row", "high_vol_regime", *before)
    out = make(written(rows.join(places, "_row").join(windows, "_row").drop("_row")), [*ranks, *far, "high_vol_regime", *before])
    out = with_market(with_moments(out, "sector", stats, small) if small else out)  # joined while rows are narrow
    for step in (premarket, market_cap, volume, intraday, surprise, timing, price_action, interactions, market_regimes, one_hot):
        out = step(out)
    out = pair_moments(zscores(out, ranked, "sector") if small else out, lagged)
    last = [f"{c}_{x}" for c in lagged for x in ("lag1", "rolling_mean", "rolling_std")]
    first = [*dict.fromkeys(["report_date", *names]), *(x for pair in zip(ranks, scores, strict=True) for x in pair), "high_vol_regime"]
    joined = ["_market", *(stats.columns if small else [])]
    return out.select(*first, *(c for c in out.columns if c not in {*first, *last, *joined}), *last)
