"""Streaming queries over the ticks: each runs its stream over all that is there and returns the sink's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.plans.q_bars import BINS_SQL, bins
from tidemark.plans.registry import Views, query
from tidemark.shared import new_path
from tidemark.streaming import keyed, streams as Z


def ticks(v: Views) -> DataFrame:
    """The events table as a stream of ticks of two feeds."""
    now = v.spark.read.parquet(f"{v.sf_dir}/events.parquet")
    # a stream reads folders: the table's own, or the one that holds its single file
    single = any(f.endswith("/events.parquet") for f in now.inputFiles())
    reader = v.spark.readStream.schema(now.schema)
    e = reader.option("pathGlobFilter", "events.parquet").parquet(v.sf_dir) if single else reader.parquet(f"{v.sf_dir}/events.parquet")
    return Z.unite(*feeds(e))


def feeds(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    t = e.select(F.col("event_id").alias("tick_id"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("t"), (F.col("value") + 50).alias("price"), F.col("user_id").alias("size"), F.when(F.col("event_id") % 2 == 0, "finnhub").otherwise("alpaca").alias("feed"))
    return t.filter("feed = 'finnhub'"), t.filter("feed = 'alpaca'")


def table(v: Views, stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The stream's rows, appended; with keys the current row of each key."""
    out, log = new_path(v.spark, "stream-table"), new_path(v.spark, "stream-log")
    if keys:
        Z.to_updates(stream, out, log, keys)
        return keyed.current(v.spark, out, keys, stream.schema)
    Z.to_table(stream, out, log)
    return v.spark.read.schema(stream.schema).parquet(out)


@query("s9_tick_feeds", "SELECT feed, symbol, count(*) AS n, sum(price) AS total, CASE feed WHEN 'finnhub' THEN date_trunc('milliseconds', max(t)) ELSE max(t) END AS last, CAST(sum(size) AS DOUBLE) AS size FROM ticks GROUP BY 1, 2", "ticks", "total size", 3)
def _(v: Views) -> DataFrame:
    """Two landed feeds as one stream: messages with lists of trades (JSON), and files of ticks."""
    one, two = new_path(v.spark, "messages"), new_path(v.spark, "ticks")
    a, b = (v.ticks.filter(F.col("feed") == f) for f in ("finnhub", "alpaca"))
    trade = F.struct(F.col("symbol").alias("s"), F.col("price").alias("p"), F.unix_millis("t").alias("t"), F.col("size").cast("double").alias("v"))
    a.select(F.to_json(F.struct(F.lit("trade").alias("type"), F.array(trade).alias("data"))).alias("value")).unionByName(v.spark.sql("SELECT '{\"type\":\"ping\"}' AS value")).write.text(one)
    b.select("symbol", "t", "price", F.col("size").cast("double").alias("size")).write.parquet(two)
    first = Z.parse_messages(v.spark.readStream.text(one)).withColumn("feed", F.lit("finnhub"))
    second = Z.tick_files(v.spark, two, "symbol string, t timestamp, price double, size double").withColumn("feed", F.lit("alpaca"))
    return table(v, Z.unite(first, second)).groupBy("feed", "symbol").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.max("t").alias("last"), F.sum("size").alias("size"))


@query("z1_once_per_session", "SELECT symbol, day AS session, least(count(*), 1)::INT AS n FROM ticks GROUP BY 1, 2", "ticks")
def _(v: Views) -> DataFrame:
    s = Z.once_per_session(ticks(v)).select("symbol", "session")
    return table(v, s).groupBy("symbol", "session").agg(F.count("*").cast("int").alias("n"))


_FIRST = "o AS (SELECT symbol, day AS session, arg_min(price, t) AS open_price, min(t) AS opened_at FROM ticks WHERE hour(t) * 3600 + minute(t) * 60 + floor(second(t)) BETWEEN 34200 AND 34290 GROUP BY 1, 2)"


#: A session's row is final once the watermark has passed its day.
_CLOSED = "session + INTERVAL 1 DAY <= (SELECT max(t) FROM ticks) - INTERVAL 10 MINUTE"


def closed(v: Views, rows: DataFrame) -> DataFrame:
    last = v.ticks.agg(F.max("t")).first()[0]
    return rows.filter(F.date_add("session", 1).cast("timestamp") <= F.lit(last) - F.expr(f"interval {Z.DELAY}"))


@query("z2_opening_ticks", f"WITH {_FIRST} SELECT symbol, session, open_price FROM o WHERE {_CLOSED}", "ticks", "open_price", 4)
def _(v: Views) -> DataFrame:
    return closed(v, table(v, Z.opening_ticks(ticks(v))).select("symbol", "session", "open_price"))


@query("z3_gap_signals", f"WITH {_FIRST}, {BINS_SQL}, d AS (SELECT symbol, day, arg_max(price, t) AS c FROM ticks GROUP BY 1, 2), p AS (SELECT symbol, day AS session, lag(c) OVER (PARTITION BY symbol ORDER BY day) AS prev_close FROM d), g AS (SELECT o.symbol, o.session, (open_price - prev_close) / prev_close * 100 AS gap_pct FROM o JOIN p USING (symbol, session) WHERE session + INTERVAL 1 DAY <= (SELECT max(t) FROM ticks) - INTERVAL 10 MINUTE) SELECT symbol, session, gap_pct, min(ordinal) AS ordinal FROM g JOIN bins ON gap_pct >= range_min AND gap_pct < range_max GROUP BY 1, 2, 3", "ticks", "gap_pct", 4)
def _(v: Views) -> DataFrame:
    from tidemark.operators.joins import asof_close
    from tidemark.plans.q_bars import days

    d = days(v)
    prev = asof_close(d.select("symbol", "session_day"), d).select("symbol", F.col("session_day").alias("session"), "prev_close")
    return closed(v, table(v, Z.gap_signals(Z.opening_ticks(ticks(v)), prev, bins(v))).select("symbol", "session", "gap_pct", "ordinal"))


@query("z4_last_prices", "SELECT symbol, arg_max(price, t) AS price, max(t) AS t FROM ticks GROUP BY 1", "ticks", "price", 4)
def _(v: Views) -> DataFrame:
    return table(v, Z.last_prices(ticks(v)), ["symbol"])


def _ends(v: Views, width: str) -> Column:
    """True for windows that the watermark has passed: those that end by the last tick minus the delay."""
    last = v.ticks.agg(F.max("t")).first()[0]
    return F.col("t") + F.expr(f"interval {width}") <= F.lit(last) - F.expr(f"interval {Z.DELAY}")


@query("z8_minute_bars", "WITH b AS (SELECT symbol, date_trunc('minute', t) AS t, arg_min(price, t) AS o, max(price) AS h, min(price) AS l, arg_max(price, t) AS c, CAST(sum(size) AS BIGINT) AS v FROM ticks GROUP BY 1, 2) SELECT * FROM b WHERE t + INTERVAL 1 MINUTE <= (SELECT max(t) FROM ticks) - INTERVAL 10 MINUTE", "ticks", "o h l c", 4)
def _(v: Views) -> DataFrame:
    return table(v, Z.bars(ticks(v))).filter(_ends(v, "1 minute"))


@query("z7_position_status", "WITH w AS (SELECT symbol, time_bucket(INTERVAL 30 SECOND, t) AS b, arg_max((price - 60) / 60 * 100, t) AS pnl_pct, max(price) AS peak FROM ticks GROUP BY 1, 2) SELECT symbol, b AS t, pnl_pct, peak FROM w WHERE b + INTERVAL 30 SECOND <= (SELECT max(t) FROM ticks) - INTERVAL 10 MINUTE", "ticks", "pnl_pct peak", 4)
def _(v: Views) -> DataFrame:
    s = Z.status(ticks(v).withColumn("entry_price", F.lit(60.0)))
    return table(v, s).filter(_ends(v, "30 seconds"))


def exit_events(v: Views, source: DataFrame, stop: float = -20.0, target: float = 30.0) -> DataFrame:
    """Ticks with entry rows: every first tick after the open of a symbol and day opens a position."""
    first = v.ticks.filter("hour(t) * 60 + minute(t) >= 570").groupBy("symbol", F.col("day").cast("string").alias("session")).agg(F.min("t").alias("entry_at"))
    e = source.withColumn("session", F.date_format("t", "yyyy-MM-dd")).join(first, ["symbol", "session"]).filter("t >= entry_at")
    return e.select("symbol", "session", "t", F.when(F.col("t") == F.col("entry_at"), 0).otherwise(1).alias("kind"), "tick_id", "price", F.lit(stop).alias("stop_loss"), F.lit(target).alias("target_profit"))


#: Positions as SQL: the first stop loss, the first tick at the target and the first fall of a tenth from the peak after it.
def _exits(stop: int, target: int) -> str:
    return f"""en AS (SELECT symbol, day, min(t) AS entry_at FROM ticks WHERE hour(t) * 60 + minute(t) >= 570 GROUP BY 1, 2), e AS (SELECT en.*, arg_min(price, tick_id) AS entry FROM en JOIN ticks USING (symbol, day) WHERE t = entry_at GROUP BY ALL),
tk AS (SELECT symbol, day, t, tick_id, price, entry, (price - entry) / entry * 100 AS pnl FROM ticks JOIN e USING (symbol, day) WHERE t > entry_at AND hour(t) * 3600 + minute(t) * 60 + floor(second(t)) < 55980),
fi AS (SELECT e.symbol, e.day, e.entry, min(t) FILTER (WHERE pnl <= {stop}) AS stop_at, min(t) FILTER (WHERE pnl >= {target}) AS hit_at, coalesce(arg_max(price, t), e.entry) AS last FROM e LEFT JOIN tk USING (symbol, day) GROUP BY 1, 2, 3),
pk AS (SELECT tk.symbol, tk.day, t, price, max(price) OVER (PARTITION BY tk.symbol, tk.day ORDER BY t) AS peak FROM tk JOIN fi USING (symbol, day) WHERE t >= hit_at), tr AS (SELECT symbol, day, min(t) AS trail_at FROM pk WHERE (peak - price) / peak >= 0.1 GROUP BY 1, 2),
ex AS (SELECT fi.*, trail_at, CASE WHEN stop_at <= coalesce(trail_at, stop_at) THEN 'STOP_LOSS' WHEN trail_at IS NOT NULL THEN 'TRAILING_STOP' ELSE 'TIME_EXIT' END AS reason FROM fi LEFT JOIN tr USING (symbol, day)),
ou AS (SELECT ex.symbol, CAST(ex.day AS VARCHAR) AS session, reason, CASE reason WHEN 'STOP_LOSS' THEN stop_at WHEN 'TRAILING_STOP' THEN trail_at ELSE CAST(ex.day AS TIMESTAMP) + INTERVAL 55980 SECOND END AS exit_at, CASE reason WHEN 'TIME_EXIT' THEN last ELSE price END AS exit_price, ex.entry FROM ex LEFT JOIN tk ON tk.symbol = ex.symbol AND tk.day = ex.day AND tk.t = CASE reason WHEN 'STOP_LOSS' THEN stop_at ELSE trail_at END)"""


_EXITS = _exits(-20, 30)
_EXIT_ROWS = "SELECT symbol, session, reason, exit_at, exit_price, (exit_price - entry) / entry * 100 AS pnl_pct FROM ou"


@query("z5_exit_signals_batch", f"WITH {_EXITS} {_EXIT_ROWS}", "ticks", "exit_price pnl_pct", 4)
def _(v: Views) -> DataFrame:
    return Z.exits_batch(exit_events(v, v.ticks))


@query("z6_time_exits", f"WITH {_exits(-60, 900)} {_EXIT_ROWS} WHERE reason = 'TIME_EXIT'", "ticks", "exit_price pnl_pct", 4)
def _(v: Views) -> DataFrame:
    """Positions with wide limits, which mostly end at the cutoff."""
    return Z.exits_batch(exit_events(v, v.ticks, -60.0, 900.0)).filter("reason = 'TIME_EXIT'")


_OPEN = "reason <> 'TIME_EXIT' OR exit_at < (SELECT max(t) FROM ticks) - INTERVAL 10 MINUTE"


@query("z5_exit_signals", f"WITH {_EXITS} {_EXIT_ROWS} WHERE {_OPEN}", "ticks", "exit_price pnl_pct", 4)
def _(v: Views) -> DataFrame:
    """The state machine on the stream; sessions whose cutoff the watermark has not reached are still open."""
    return streamed_exits(v)


@query("u3_exit_machine", f"WITH {_EXITS} SELECT symbol, reason, count(*) AS n, avg((exit_price - entry) / entry * 100) AS mean FROM ou WHERE {_OPEN} GROUP BY 1, 2", "ticks", "mean", 4)
def _(v: Views) -> DataFrame:
    return streamed_exits(v).groupBy("symbol", "reason").agg(F.count("*").alias("n"), F.avg("pnl_pct").alias("mean"))


def streamed_exits(v: Views) -> DataFrame:
    key = "spark.sql.streaming.stateStore.providerClass"
    was = v.spark.conf.get(key, None)
    v.spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return table(v, Z.exits(exit_events(v, ticks(v))))
    finally:
        v.spark.conf.set(key, was) if was else v.spark.conf.unset(key)
