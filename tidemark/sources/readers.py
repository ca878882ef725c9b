"""Sources: CSV with fallbacks, nested JSON, calendars, bars, bins."""

from __future__ import annotations

import re
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.clean import require

ENCODINGS, SEPARATORS, MAX_DIALECTS = ["utf-8", "iso-8859-1", "windows-1252"], [",", ";", "\t"], 64
TEXTS = ["symbol", "sector", "industry", "data_source", "high_time", "low_time", "report_date", "report_timestamp"]
INTS = ["earnings_time", "high_before_low"]
#: The columns of an earnings record.
COLUMNS = ["alpaca_prev_close", "close_price", "data_source", "earnings_time", "high_before_low", "high_price", "high_time", "industry", "low_price", "low_time", "market_cap", "open_price", "opening_minute_volume", "pct_15min", "pct_1hr", "pct_1min", "pct_30min", "pct_5min", "pct_change_close", "pct_change_high", "pct_change_low", "pct_change_open", "premarket_high", "premarket_low", "premarket_volume", "reference_prev_close", "report_date", "report_timestamp", "revenue_surprise", "sector", "sort_key", "surprise", "symbol", "volume_30_day_avg", "volume_7_day_avg", "volume_ratio_30_day", "volume_ratio_7_day"]
RECORD = "symbol string, date string, sector string, industry string, market_cap double, surprise double, earnings_time string, open_price double, high_price double, low_price double, close_price double, volume_comparison string"


def record_type(column: str) -> str:
    return "string" if column in TEXTS else "int" if column in INTS else "double"


def dialects(spark: SparkSession, path: str) -> dict[tuple[str, str, str], list[str]]:
    """The files by (encoding, separator, header). The encoding is the first in which every byte of the file decodes (a line
    feed is one byte in all ENCODINGS, and every byte decodes in the second); the separator is the one that splits the
    header most often outside of quotes. One pass over all files; one short row a file reaches the driver, and more than
    MAX_DIALECTS combinations are an error."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"), F.col("value"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    files = lines.groupBy("file").agg(F.bool_and("valid").alias("valid"), F.rtrim(F.min_by("value", "at"), F.lit("\r")).alias("header"))
    bare = F.regexp_replace("header", '"[^"]*"', "")
    splits = F.array(*(F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))).alias("n"), F.lit(-i).alias("turn"), F.lit(s).alias("sep")) for i, s in enumerate(SEPARATORS)))
    kinds = files.select("file", F.when(F.col("valid"), ENCODINGS[0]).otherwise(ENCODINGS[1]).alias("encoding"), F.array_max(splits)["sep"].alias("sep"), "header")
    found = kinds.groupBy("encoding", "sep", "header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("encoding", "sep", "header").limit(MAX_DIALECTS + 1).collect()
    if len(found) > MAX_DIALECTS:
        raise ValueError(f"more than {MAX_DIALECTS} combinations of encoding, separator and header")
    return {(r["encoding"], r["sep"], r["header"]): r["files"] for r in found}


def _listed(uri: str) -> str:
    """A file's address as the readers take it, where some characters would be patterns."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", unquote(uri))


def records_csv(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None) -> DataFrame:
    """Earnings records with declared types; missing required columns are an error, malformed numbers become null. Each
    file of a folder is read in its own encoding and with its own separator and header, unless they are given; columns
    that only some files have are null in the others."""
    if encoding and separator:
        found: list[tuple[str, str, list[str]]] = [(encoding, separator, [path])]
    else:
        found = [(encoding or e, separator or s, list(map(_listed, files))) for (e, s, _), files in dialects(spark, path).items()] or [(ENCODINGS[0], SEPARATORS[0], [path])]
    raw = None
    for e, s, files in found:
        part = require(spark.read.option("header", True).option("encoding", e).option("sep", s).csv(files), COLUMNS)
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    return raw.select(*(F.col(c).try_cast(record_type(c)).alias(c) for c in raw.columns))


def snapshots_json(spark: SparkSession, path: str, record: str = RECORD) -> DataFrame:
    """Nested daily snapshots: one row for each record, with the snapshot's timestamp and date."""
    schema = f"timestamp string, date string, data array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in record.split(','))}>>"
    rows = spark.read.option("multiLine", True).schema(schema).json(path)
    return rows.select(F.col("timestamp").alias("snapshot_at"), F.col("date").alias("snapshot_date"), F.inline("data"))


def calendar_json(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """Calendar entries from landed responses, by date range."""
    entry = "symbol:string,date:date,hour:string,epsEstimate:double,epsActual:double,revenueEstimate:double,revenueActual:double"
    rows = spark.read.option("multiLine", True).schema(f"earningsCalendar array<struct<{entry}>>").json(path).select(F.inline("earningsCalendar"))
    out = rows.withColumnsRenamed({"date": "day", "epsEstimate": "eps_estimate", "epsActual": "eps_actual", "revenueEstimate": "revenue_estimate", "revenueActual": "revenue_actual"})
    if start is not None:
        out = out.filter(F.col("day") >= F.lit(start))
    return out if end is None else out.filter(F.col("day") <= F.lit(end))


def bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    """Bars partitioned by day: the range prunes partitions, the symbols reach the scan as a filter."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("day") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("day") <= F.lit(end))
    return df if symbols is None else df.filter(F.col("symbol").isin(symbols))


def bins_json(spark: SparkSession, path: str) -> DataFrame:
    """Gap bins in the order of the file."""
    rows = spark.read.option("multiLine", True).schema("bins array<struct<range_min:double,range_max:double,stop_loss:double,target_profit:double>>").json(path)
    return rows.select(F.posexplode("bins").alias("ordinal", "b")).select("ordinal", "b.*")
