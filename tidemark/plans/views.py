"""Event-study views over the test tables: one SQL text each, which both Spark and an ANSI-SQL engine read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TRADES = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS trade_id, CAST(l_shipdate AS DATE) AS d, l_discount - l_tax AS r,
       concat(l_returnflag, l_linestatus) AS strategy, l_returnflag AS sector, l_quantity AS qty, l_extendedprice AS price, l_tax AS tax, l_partkey AS part, l_suppkey AS supp
FROM {lineitem}
"""
#: What records are made of, row by row.
ENTRIES = """SELECT o_orderkey AS k, o_custkey AS cust, CAST(o_orderdate AS DATE) AS report_date, o_orderstatus AS status, o_orderpriority AS prio, o_totalprice AS p, c_mktsegment AS seg, c_acctbal AS cap, 20 + o_totalprice / 5e3 AS prev
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""
RAW_RECORDS = f"""
SELECT k AS record_id, concat('S', cust) AS symbol, seg AS sector, concat('IND', substr(prio, 1, 1)) AS industry,
       CASE WHEN k % 17 = 0 THEN 'FAILED' WHEN k % 3 = 0 THEN 'Finnhub' ELSE 'Alpaca' END AS data_source, report_date,
       CAST(concat(CAST(report_date AS STRING), ' ', lpad(CAST(CAST(floor((k % 1440) / 6e1) AS INT) AS STRING), 2, '0'), ':', lpad(CAST(k % 60 AS STRING), 2, '0'), ':00') AS TIMESTAMP) AS report_timestamp,
       CASE status WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE -1 END AS earnings_time,
       concat(lpad(CAST(CAST(floor((570 + (k * 11) % 391) / 6e1) AS INT) AS STRING), 2, '0'), ':', lpad(CAST((570 + (k * 11) % 391) % 60 AS STRING), 2, '0')) AS high_time,
       concat(lpad(CAST(CAST(floor((570 + (k * 23) % 391) / 6e1) AS INT) AS STRING), 2, '0'), ':', lpad(CAST((570 + (k * 23) % 391) % 60 AS STRING), 2, '0')) AS low_time,
       CASE WHEN (k * 11) % 391 < (k * 23) % 391 THEN 1 ELSE 0 END AS high_before_low,
       CASE WHEN cap > 0 THEN cap ELSE -1e0 END AS market_cap, CASE WHEN k % 19 = 0 THEN -999e0 ELSE (p - 250000) / 25e2 END AS surprise,
       CASE WHEN k % 7 = 0 THEN -999e0 ELSE ((k * 37) % 2001 - 1000) / 1e1 END AS revenue_surprise, prev AS alpaca_prev_close, prev AS reference_prev_close,
       CASE WHEN k % 17 = 0 THEN -1e0 ELSE op END AS open_price, CASE WHEN k % 17 = 0 THEN -1e0 ELSE hi END AS high_price, CASE WHEN k % 17 = 0 THEN -1e0 ELSE lo END AS low_price, CASE WHEN k % 17 = 0 THEN -1e0 ELSE cl END AS close_price,
       CASE WHEN k % 17 = 0 THEN -999e0 ELSE (op - prev) / prev * 100 END AS pct_change_open, CASE WHEN k % 17 = 0 THEN -999e0 ELSE (hi - op) / op * 100 END AS pct_change_high,
       CASE WHEN k % 17 = 0 THEN -999e0 ELSE (lo - op) / op * 100 END AS pct_change_low, CASE WHEN k % 17 = 0 THEN -999e0 ELSE (cl - prev) / prev * 100 END AS pct_change_close,
       CASE WHEN k % 11 = 0 THEN -1e0 ELSE prev * (1 + ((k * 41) % 1009) / 2e4) END AS premarket_high, CASE WHEN k % 11 = 0 THEN -1e0 ELSE prev * (1 - ((k * 43) % 1009) / 2e4) END AS premarket_low,
       CASE WHEN k % 11 = 0 THEN -1 ELSE (k * 47) % 90000 END AS premarket_volume, CASE WHEN k % 17 = 0 THEN -1 ELSE 1000 + (k * 31) % 50000 END AS opening_minute_volume,
       CASE WHEN k % 13 = 0 THEN -1e0 ELSE 20000e0 + (k * 37) % 90000 END AS volume_30_day_avg, CASE WHEN k % 13 = 0 THEN -1e0 ELSE 15000e0 + (k * 59) % 90000 END AS volume_7_day_avg,
       CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN -1e0 ELSE (1000 + (k * 31) % 50000) / (20000e0 + (k * 37) % 90000) END AS volume_ratio_30_day, CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN -1e0 ELSE (1000 + (k * 31) % 50000) / (15000e0 + (k * 59) % 90000) END AS volume_ratio_7_day,
       CASE WHEN k % 17 = 0 THEN -999e0 ELSE ((k * 61) % 401 - 200) / 1e2 END AS pct_1min, CASE WHEN k % 17 = 0 THEN -999e0 ELSE ((k * 67) % 601 - 300) / 1e2 END AS pct_5min, CASE WHEN k % 17 = 0 THEN -999e0 ELSE ((k * 71) % 801 - 400) / 1e2 END AS pct_15min,
       CASE WHEN k % 23 = 0 THEN -999e0 ELSE ((k * 73) % 1001 - 500) / 1e2 END AS pct_30min, CASE WHEN k % 23 = 0 THEN -999e0 ELSE ((k * 79) % 1201 - 600) / 1e2 END AS pct_1hr,
       CASE WHEN k % 17 = 0 THEN -999e0 ELSE (hi - op) / op * 100 END AS sort_key
FROM (SELECT *, lo + (hi - lo) * (((k * 23) % 1009) / 1009e0) AS cl
FROM (SELECT *, op * (1 + ((k * 13) % 1009) / 12e3) AS hi, op * (1 - ((k * 17) % 1009) / 12e3) AS lo
FROM (SELECT *, prev * (1 + (((k * 7) % 1009) / 1e3 - 45e-2) / 1e1) AS op
FROM ({ENTRIES}) a) b) c) e
"""
_PRICES = ["market_cap", "open_price", "high_price", "low_price", "close_price", "premarket_high", "premarket_low", "premarket_volume", "opening_minute_volume", "volume_30_day_avg", "volume_7_day_avg", "volume_ratio_30_day", "volume_ratio_7_day"]
_PERCENTS = ["surprise", "revenue_surprise", "pct_change_open", "pct_change_high", "pct_change_low", "pct_change_close", "pct_1min", "pct_5min", "pct_15min", "pct_30min", "pct_1hr", "sort_key"]
#: Records with the markers of missing data as nulls.
RECORDS = f"""
SELECT record_id, symbol, sector, industry, nullif(data_source, 'FAILED') AS data_source, report_date, report_timestamp, earnings_time, high_time, low_time, high_before_low, alpaca_prev_close, reference_prev_close,
       {", ".join(f"nullif({c}, -1) AS {c}" for c in _PRICES)}, {", ".join(f"nullif({c}, -999) AS {c}" for c in _PERCENTS)}
FROM ({RAW_RECORDS}) raw
"""
TICKS = """
SELECT event_id AS tick_id, event_type AS symbol, CAST(ts AS TIMESTAMP) AS t, CAST(CAST(ts AS TIMESTAMP) AS DATE) AS day, 50 + value AS price, user_id AS size, CASE WHEN event_id % 2 = 0 THEN 'finnhub' ELSE 'alpaca' END AS feed
FROM {events}
"""
#: Calendar entries: every order is a report, its supplier-side numbers the estimates.
CALENDAR = """
SELECT o_orderkey AS entry_id, concat('S', o_custkey) AS symbol, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'bmo' WHEN 'O' THEN 'amc' ELSE '' END AS hour,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 0e0 ELSE ((o_orderkey * 7) % 401 - 100) / 1e2 END AS eps_estimate,
       CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE ((o_orderkey * 11) % 503 - 100) / 1e2 END AS eps_actual,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE ((o_orderkey * 13) % 700) / 1e0 END AS revenue_estimate, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE ((o_orderkey * 17) % 900) / 1e0 END AS revenue_actual
FROM {orders}
"""
PROFILE = """
SELECT concat('S', c_custkey) AS symbol, nullif(greatest(c_acctbal, 0), 0) AS market_cap, c_mktsegment AS industry, n_name AS country, r_name AS region
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""
VIEWS = {"trades": TRADES, "entries": ENTRIES, "raw_records": RAW_RECORDS, "records": RECORDS, "ticks": TICKS, "calendar": CALENDAR, "profile": PROFILE}


def _tables(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def view(spark: SparkSession, sf_dir: str, name: str, parts: dict[str, int] | None = None) -> DataFrame:
    """A view over the folder's tables; those in parts are dealt into so many first, where a file gives too few tasks."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _tables(VIEWS[name])}
    return spark.sql(VIEWS[name], **tables | {t: tables[t].repartition(n, tables[t].columns[0]) for t, n in (parts or {}).items()})


def records_of(entries: DataFrame, also: list[str]) -> DataFrame:
    """The columns named in also, and those of the view records, for each row of the view entries."""
    text = RECORDS.replace(ENTRIES, "SELECT * FROM {entries}")
    for first in ("k AS record_id", "record_id"):  # of the raw records and of the records
        text = text.replace(f"\nSELECT {first},", "\nSELECT " + ", ".join([*also, first]) + ",")
    return entries.sparkSession.sql(text, entries=entries)


def ansi(name: str) -> str:
    """The view's text for an engine in which the tables are registered by name."""
    return re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """sql after a WITH list of the views that it names."""
    body = sql.strip()
    head = ", ".join(f"{n} AS ({ansi(n)})" for n in names)
    return f"WITH {head}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
