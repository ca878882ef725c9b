"""Opening and exit signals from a stream of ticks. Every operator takes streaming DataFrames; no order is placed.

Event time is the tick's own time. Late ticks are dropped after DELAY; the first tick is the earliest by event time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.bars import minute_of_day
from tidemark.operators.joins import match_bin
from tidemark.streaming import keyed

DELAY = "10 minutes"
OPEN_SECONDS, LAST_ENTRY, CUTOFF = 570 * 60, 571 * 60 + 30, 933 * 60
TRAIL, DAY_MS = 0.10, 86_400_000
MESSAGE = "type string, data array<struct<s:string,p:double,t:bigint,v:double>>"


def parse_messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """Trade messages (JSON with a data list) as ticks: symbol, t, price, size."""
    m = raw.select(F.from_json(F.col(column).cast("string"), MESSAGE).alias("m")).filter("m.type = 'trade'").select(F.explode("m.data").alias("x"))
    return m.select(F.col("x.s").alias("symbol"), F.timestamp_millis("x.t").alias("t"), F.col("x.p").alias("price"), F.col("x.v").alias("size"))


def tick_files(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unite(*feeds: DataFrame) -> DataFrame:
    """Ticks of all feeds with a watermark."""
    out = feeds[0]
    for f in feeds[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.withWatermark("t", DELAY)


def once_per_session(ticks: DataFrame) -> DataFrame:
    """One tick a symbol and day, whichever feed brings it first."""
    return ticks.withColumn("session", F.to_date("t")).dropDuplicatesWithinWatermark(["symbol", "session"])


def second_of_day(t: Column) -> Column:
    return minute_of_day(t) * 60 + F.second(t)


def opening_ticks(ticks: DataFrame) -> DataFrame:
    """The first tick a symbol and day from the open to LAST_ENTRY: symbol, session, open_price, opened_at."""
    s = second_of_day(F.col("t"))
    w = ticks.filter((s >= OPEN_SECONDS) & (s <= LAST_ENTRY))
    return w.groupBy(F.window("t", "1 day"), "symbol").agg(F.min_by("price", F.struct("t", "tick_id")).alias("open_price"), F.min("t").alias("opened_at")).select("symbol", F.to_date("window.start").alias("session"), "open_price", "opened_at")


def gap_signals(opened: DataFrame, prev_close: DataFrame, bins: DataFrame) -> DataFrame:
    """Entry rows: the gap against the previous close(symbol, session, prev_close) and the bin it falls in."""
    g = opened.join(prev_close, ["symbol", "session"]).withColumn("gap_pct", F.try_divide(F.col("open_price") - F.col("prev_close"), F.col("prev_close")) * 100)
    m = match_bin(g, bins, F.col("gap_pct")).filter(F.col("bin").isNotNull())
    return m.select("symbol", "session", "opened_at", "open_price", "gap_pct", "bin.ordinal", "bin.stop_loss", "bin.target_profit")


def last_prices(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol").agg(F.max_by("price", F.struct("t", "tick_id")).alias("price"), F.max("t").alias("t"))


def bars(ticks: DataFrame, width: str = "1 minute") -> DataFrame:
    """Tumbling OHLCV bars, final once the watermark has passed them."""
    order = F.struct("t", "tick_id")
    return ticks.groupBy(F.window("t", width), "symbol").agg(F.min_by("price", order).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", order).alias("c"), F.sum("size").alias("v")).select("symbol", F.col("window.start").alias("t"), "o", "h", "l", "c", "v")


def status(positions: DataFrame, width: str = "30 seconds") -> DataFrame:
    """Last profit and peak of a position by window, from ticks joined with their entry price."""
    return positions.groupBy(F.window("t", width), "symbol").agg(F.max_by(F.try_divide(F.col("price") - F.col("entry_price"), F.col("entry_price")) * 100, F.struct("t", "tick_id")).alias("pnl_pct"), F.max("price").alias("peak")).select("symbol", F.col("window.start").alias("t"), "pnl_pct", "peak")


EXITS = "symbol string, session string, reason string, exit_at timestamp, exit_price double, pnl_pct double"
STATE = "entry double, stop double, target double, peak double, hit boolean, last double, last_ms bigint, done boolean"


def advance(state: tuple, prices: np.ndarray, trail: float = TRAIL) -> tuple[tuple, int | None, str | None]:
    """A position (entry, stop, target, peak, hit) over its next prices: the state after them or at the exit, the index of
    the exit and its reason, if there is one.

    The exit is the first stop loss or the first fall from the running peak, whichever comes first, a stop before a fall.
    The peak runs from the first price at the target on, or from before if that was reached already."""
    entry, stop, target, peak, hit = state
    n, at = len(prices), np.arange(len(prices))
    first = lambda x: int(x.argmax()) if x.any() else n
    pnl = (prices - entry) / entry * 100
    stopped = first(pnl <= stop)
    start = -1 if hit else first((pnl >= target) & (pnl > stop))
    peaks = np.maximum.accumulate(np.concatenate([[peak if hit else -np.inf], np.where(at >= start, prices, -np.inf)]))  # before each price, and at the end
    with np.errstate(invalid="ignore"):
        fallen = first((at > start) & (prices <= peaks[:-1]) & ((peaks[:-1] - prices) / peaks[:-1] >= trail))
    end = min(stopped, fallen)
    if start < end:
        peak, hit = float(peaks[end]), True
    reason = None if end == n else "STOP_LOSS" if stopped <= fallen else "TRAILING_STOP"
    return (entry, stop, target, peak, hit), None if reason is None else end, reason


class ExitProcessor(StatefulProcessor):
    """Per symbol and session: opens a position on its entry row, follows the ticks in event-time order, and leaves by
    stop loss, trailing stop after the target, or at the cutoff by an event-time timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["t", "kind", "tick_id"], ignore_index=True)
        state = self.position.get() if self.position.exists() else None
        kind, price = events["kind"].to_numpy(), events["price"].to_numpy(float)
        ms = events["t"].to_numpy("datetime64[ns]").astype(np.int64) // 10**6
        out, at = [], 0
        if state is None and (kind == 0).any():
            at = int((kind == 0).argmax())
            e = events.iloc[at]
            state = (float(e["price"]), float(e["stop_loss"]), float(e["target_profit"]), float(e["price"]), False, float(e["price"]), int(ms[at]), False)
            self.handle.registerTimer(int(ms[at]) // DAY_MS * DAY_MS + CUTOFF * 1000)
        if state is not None and not state[7]:
            ticks = np.flatnonzero((kind == 1) & (np.arange(len(kind)) >= at) & (ms % DAY_MS < CUTOFF * 1000))
            core, end, reason = advance(state[:5], price[ticks])
            if len(ticks):
                last = ticks[-1 if end is None else end]
                state = (*core, float(price[last]), int(ms[last]), reason is not None)
                if reason:
                    out.append((key[0], key[1], reason, events["t"].iloc[last], float(price[last]), (float(price[last]) - core[0]) / core[0] * 100))
        if state is not None:
            self.position.update(state)
        yield pd.DataFrame(out, columns=["symbol", "session", "reason", "exit_at", "exit_price", "pnl_pct"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.position.exists():
            s = self.position.get()
            if not s[7]:
                out.append((key[0], key[1], "TIME_EXIT", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"), s[5], (s[5] - s[0]) / s[0] * 100))
            self.position.clear()
        yield pd.DataFrame(out, columns=["symbol", "session", "reason", "exit_at", "exit_price", "pnl_pct"])

    def close(self) -> None: ...


def exits(events: DataFrame) -> DataFrame:
    """Exit rows from events(symbol, session, t, kind 0 entry / 1 tick, tick_id, price, stop_loss, target_profit) with a
    watermark on t."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the processor's driver-side worker has no package path
    return events.groupBy("symbol", "session").transformWithStateInPandas(statefulProcessor=ExitProcessor(), outputStructType=EXITS, outputMode="Append", timeMode="EventTime")


def exits_batch(events: DataFrame) -> DataFrame:
    """The same over a finished table, by aggregates: the first stop loss, the first tick at the target, and from there
    the first fall from the running peak. The peak is carried from hour to hour, so no task holds a session."""
    key = ["symbol", "session"]
    at = F.struct("t", "tick_id", "price")
    entry = events.filter("kind = 0").groupBy(*key).agg(F.min(F.struct("t", "tick_id", "price", "stop_loss", "target_profit")).alias("e"))
    later = (F.col("t") > F.col("e.t")) | ((F.col("t") == F.col("e.t")) & (F.col("kind") == 1))
    ticks = events.filter((F.col("kind") == 1) & (second_of_day(F.col("t")) < CUTOFF)).join(entry, key).filter(later)
    pnl = (F.col("price") - F.col("e.price")) / F.col("e.price") * 100
    first = ticks.groupBy(*key).agg(F.min(F.when(pnl <= F.col("e.stop_loss"), at)).alias("stop"), F.min(F.when((pnl >= F.col("e.target_profit")) & (pnl > F.col("e.stop_loss")), at)).alias("hit"), F.max(at).alias("last"))
    after = ticks.join(first.select(*key, "hit"), key).filter(F.col("hit").isNotNull() & (F.struct("t", "tick_id") >= F.struct("hit.t", "hit.tick_id"))).withColumn("block", F.hour("t"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = after.groupBy(*key, "block").agg(F.max("price").alias("top")).withColumn("carried", F.max("top").over(earlier)).drop("top")  # an entry an hour
    inside = Window.partitionBy(*key, "block").orderBy("t", "tick_id").rowsBetween(Window.unboundedPreceding, 0)
    peaked = after.withColumn("top", F.max("price").over(inside)).join(carried, [*key, "block"]).withColumn("peak", F.greatest("top", "carried"))
    trail = peaked.filter((F.col("peak") - F.col("price")) / F.col("peak") >= TRAIL).groupBy(*key).agg(F.min(at).alias("trail"))
    out = entry.join(first, key, "left").join(trail, key, "left")
    stopped = F.col("stop").isNotNull() & (F.col("trail").isNull() | (F.col("stop") <= F.col("trail")))
    reason = F.when(stopped, "STOP_LOSS").when(F.col("trail").isNotNull(), "TRAILING_STOP").otherwise("TIME_EXIT")
    cutoff = F.date_trunc("day", F.col("e.t")) + F.make_dt_interval(secs=F.lit(CUTOFF))
    exit_at = F.when(stopped, F.col("stop.t")).when(F.col("trail").isNotNull(), F.col("trail.t")).otherwise(cutoff)
    price = F.when(stopped, F.col("stop.price")).when(F.col("trail").isNotNull(), F.col("trail.price")).otherwise(F.coalesce("last.price", "e.price"))
    return out.select(*key, reason.alias("reason"), exit_at.alias("exit_at"), price.alias("exit_price"), ((price - F.col("e.price")) / F.col("e.price") * 100).alias("pnl_pct"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now and writes it as a Parquet table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def to_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """The same for a table of changing rows (see keyed), of which `keyed.current` reads the rows."""

    def save(batch: DataFrame, number: int) -> None:
        keyed.add(batch, number, path, keys)

    stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
