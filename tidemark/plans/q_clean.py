"""Cleaning, candidates and scalar functions over records and the calendar."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import scalar as S
from tidemark.operators import clean
from tidemark.plans.registry import Views, query
from tidemark.sources import sinks

NUMS = ["market_cap", "surprise", "open_price", "volume_ratio_7_day"]
PRICES = ["market_cap", "open_price", "high_price", "low_price", "close_price", "premarket_high", "premarket_low", "premarket_volume", "opening_minute_volume", "volume_30_day_avg", "volume_7_day_avg", "volume_ratio_30_day", "volume_ratio_7_day"]
PERCENTS = ["surprise", "revenue_surprise", "pct_change_open", "pct_change_high", "pct_change_low", "pct_change_close", "pct_1min", "pct_5min", "pct_15min", "pct_30min", "pct_1hr", "sort_key"]
RANGES = {"market_cap": (0.0, 1e7), "surprise": (-1000.0, 1000.0), "volume_ratio_7_day": (0.0, 100.0), "pct_change_close": (-100.0, 100.0)}


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


@query("s3_required_columns", "SELECT CAST(count(*) AS BIGINT) AS n_columns_missing, CAST(0 AS BIGINT) AS n_extra FROM records WHERE false", "records")
def _(v: Views) -> DataFrame:
    from tidemark.sources.readers import COLUMNS

    r = v.records
    gone = F.size(F.array_except(F.array(*map(F.lit, COLUMNS)), F.array(*map(F.lit, r.columns)))).cast("long")
    return r.agg(F.count("*")).select(gone.alias("n_columns_missing"), F.size(F.array_except(F.array(*map(F.lit, [c for c in r.columns if c != "record_id"])), F.array(*map(F.lit, COLUMNS)))).cast("long").alias("n_extra"))


@query("s4_null_columns", _union([f"SELECT '{c}' AS \"column\", count({c}) AS n_values, count({c}) = 0 AS all_null FROM records" for c in NUMS]), "records")
def _(v: Views) -> DataFrame:
    return clean.null_counts(v.records, NUMS)


@query("s5_range_violations", _union([f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < {lo} OR {c} > {hi}) AS n_out FROM raw_records" for c, (lo, hi) in RANGES.items()]), "raw_records")
def _(v: Views) -> DataFrame:
    return clean.range_violations(v.raw_records, RANGES)


@query("p1_parse_dates", """
SELECT record_id, report_date AS d1, report_date AS d2, report_date AS d3, CAST(NULL AS DATE) AS d4 FROM records""", "records")
def _(v: Views) -> DataFrame:
    d = F.col("report_date")
    return v.records.select("record_id", *(clean.parse_date(x).alias(n) for n, x in {"d1": F.date_format(d, "yyyy-MM-dd"), "d2": F.date_format(d, "yyyy-MM-dd HH:mm:ss"), "d3": F.when(F.dayofmonth(d) > 12, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")), "d4": F.concat(F.lit("x"), d.cast("string"))}.items()))


@query("p3_sentinels", f"SELECT record_id, {', '.join(f'nullif({c}, -1) AS {c}' for c in PRICES)}, {', '.join(f'nullif({c}, -999) AS {c}' for c in PERCENTS)}, nullif(data_source, 'FAILED') AS data_source FROM raw_records", "raw_records", " ".join(PRICES + PERCENTS), 4)
def _(v: Views) -> DataFrame:
    return clean.sentinels_to_null(v.raw_records, PRICES, PERCENTS, ["data_source"]).select("record_id", *PRICES, *PERCENTS, "data_source")


@query("p5_iqr_outliers", _union([f"""SELECT '{c}' AS "column", q1, q3, (SELECT count(*) FROM records WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS n_outliers FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM records) q""" for c in NUMS]), "records", "q1 q3")
def _(v: Views) -> DataFrame:
    return clean.iqr_outliers(v.records, NUMS)


@query("p6_winsorise", """
WITH q AS (SELECT quantile_cont(volume_ratio_7_day, [0.005, 0.25, 0.75, 0.995]) AS v FROM records),
f AS (SELECT v, (SELECT count(*) FROM records WHERE volume_ratio_7_day < v[2] - 3 * (v[3] - v[2]) OR volume_ratio_7_day > v[3] + 3 * (v[3] - v[2])) AS k FROM q)
SELECT record_id, CASE WHEN volume_ratio_7_day IS NULL THEN NULL WHEN k > 0 THEN greatest(v[1], least(v[4], volume_ratio_7_day)) ELSE volume_ratio_7_day END AS volume_ratio_7_day FROM records, f""", "records", "volume_ratio_7_day")
def _(v: Views) -> DataFrame:
    return clean.winsorise(v.records, ["volume_ratio_7_day"]).select("record_id", "volume_ratio_7_day")


@query("p7_mad_clip", """
WITH m AS (SELECT median(volume_ratio_7_day) AS m FROM records), d AS (SELECT m, (SELECT median(abs(volume_ratio_7_day - m)) FROM records) AS mad FROM m)
SELECT record_id, CASE WHEN volume_ratio_7_day IS NULL THEN NULL ELSE greatest(m - 3.5 * mad / 0.6745, least(m + 3.5 * mad / 0.6745, volume_ratio_7_day)) END AS volume_ratio_7_day FROM records, d""", "records", "volume_ratio_7_day")
def _(v: Views) -> DataFrame:
    return clean.mad_clip(v.records, ["volume_ratio_7_day"]).select("record_id", "volume_ratio_7_day")


@query("p8_iqr_clip", """
WITH q AS (SELECT quantile_cont(surprise, 0.25) AS a, quantile_cont(surprise, 0.75) AS b FROM records)
SELECT record_id, CASE WHEN surprise IS NULL THEN NULL ELSE greatest(a - 0.25 * (b - a), least(b + 0.25 * (b - a), surprise)) END AS surprise FROM records, q""", "records", "surprise")
def _(v: Views) -> DataFrame:
    return clean.iqr_clip(v.records, ["surprise"], 0.25).select("record_id", "surprise")


@query("p9_safe_numbers", """
SELECT record_id, CASE WHEN market_cap IS NULL THEN 0e0 ELSE greatest(-1000e0, least(1000e0, market_cap)) END AS clamped, coalesce(surprise, -1e0) AS with_default, CAST(coalesce(premarket_volume, -1) AS BIGINT) AS as_int FROM records""", "records", "clamped with_default")
def _(v: Views) -> DataFrame:
    return v.records.select("record_id", S.safe_double(F.col("market_cap")).alias("clamped"), S.safe_double(F.col("surprise"), -1.0, None).alias("with_default"), S.safe_int(F.col("premarket_volume")).alias("as_int"))


@query("p11_categories", """
SELECT record_id, CASE WHEN upper(trim(data_source)) = 'FAILED' THEN 'Missing' ELSE upper(trim(data_source)) END AS source, regexp_replace(sector, '[^A-Z]', '', 'g') AS symbol FROM raw_records""", "raw_records")
def _(v: Views) -> DataFrame:
    return clean.clean_symbols(v.raw_records.select("record_id", clean.category(F.col("data_source")).alias("source"), F.col("sector").alias("symbol")))


@query("p13_exact_dedup", "SELECT DISTINCT symbol, report_date, sector FROM records", "records")
def _(v: Views) -> DataFrame:
    return v.records.select("symbol", "report_date", "sector").dropDuplicates()


@query("p14_last_by_key", """
SELECT symbol, report_date, arg_max(surprise, report_timestamp + to_microseconds(record_id)) FILTER (WHERE surprise IS NOT NULL) AS surprise,
       arg_max(open_price, report_timestamp + to_microseconds(record_id)) FILTER (WHERE open_price IS NOT NULL) AS open_price FROM records GROUP BY symbol, report_date""", "records", "surprise open_price")
def _(v: Views) -> DataFrame:
    return clean.last_by_key(v.records.select("symbol", "report_date", "surprise", "open_price", "report_timestamp", "record_id"), ["symbol", "report_date"], ["report_timestamp", "record_id"]).select("symbol", "report_date", "surprise", "open_price")


@query("p15_forward_fill", """
WITH f AS (SELECT record_id, last_value(surprise IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY report_date, record_id ROWS UNBOUNDED PRECEDING) AS surprise FROM records)
SELECT record_id, coalesce(surprise, (SELECT median(surprise) FROM f)) AS surprise FROM f""", "records", "surprise")
def _(v: Views) -> DataFrame:
    return clean.forward_fill(v.series("surprise"), ["surprise"], order=["report_date", "record_id"]).select("record_id", "surprise")


@query("p16_fills", "SELECT record_id, coalesce(market_cap, (SELECT median(market_cap) FROM records)) AS market_cap, coalesce(data_source, 'Other') AS data_source FROM records", "records", "market_cap")
def _(v: Views) -> DataFrame:
    return clean.fill_text(clean.fill_median(v.records, ["market_cap"]), ["data_source"]).select("record_id", "market_cap", "data_source")


@query("p18_alias_columns", "SELECT record_id, open_price, close_price FROM records", "records", "open_price close_price")
def _(v: Views) -> DataFrame:
    renamed = v.records.select("record_id", F.col("report_date").alias("date"), F.col("open_price").alias("Open"), F.col("close_price").cast("string").alias("close"))
    out = clean.to_numbers(clean.rename_prices(clean.resolve_date(renamed)), ["open_price", "close_price"])
    return out.select("record_id", "open_price", "close_price")


_CANDIDATE = """
WITH c AS (SELECT cal.*, p.market_cap, (eps_actual - eps_estimate) / nullif(abs(eps_estimate), 0) * 100 AS s,
                  (cal.day = DATE '1997-03-03' AND hour = 'amc') OR (cal.day = DATE '1997-03-04' AND hour = 'bmo') OR cal.day < DATE '1997-03-03' AS w FROM calendar cal LEFT JOIN profile p USING (symbol)),
r AS (SELECT *, CASE WHEN eps_estimate IS NULL OR eps_actual IS NULL THEN 'missing_eps' WHEN eps_estimate = 0 THEN 'zero_estimate' WHEN eps_actual < 0 THEN 'negative_actual' WHEN s <= 1 THEN 'low_surprise' WHEN s > 600 THEN 'high_surprise' WHEN NOT w THEN 'outside_window' WHEN market_cap IS NULL THEN 'no_profile' WHEN market_cap < 1000 THEN 'small_cap' END AS reason FROM c)
"""


def _reasons(v: Views) -> DataFrame:
    day, hour = F.col("day"), F.col("hour")
    a, b = F.lit(date(1997, 3, 3)), F.lit(date(1997, 3, 4))
    inside = clean.window_predicate(day, hour, a, b) | (day < a)
    c = v.calendar.join(v.profile.select("symbol", "market_cap"), "symbol", "left")
    return c.withColumn("reason", clean.candidate_reason(F.col("eps_estimate"), F.col("eps_actual"), inside, F.col("market_cap"), 1000.0)).withColumn("s", S.surprise_pct(F.col("eps_actual"), F.col("eps_estimate")))


@query("p20_candidates", _CANDIDATE + "SELECT entry_id, symbol, day, hour, s AS surprise_pct FROM r WHERE reason IS NULL", "calendar profile", "surprise_pct")
def _(v: Views) -> DataFrame:
    return _reasons(v).filter("reason IS NULL").select("entry_id", "symbol", "day", "hour", F.col("s").alias("surprise_pct"))


@query("p20_reasons", _CANDIDATE + "SELECT coalesce(reason, 'candidate') AS reason, count(*) AS n FROM r GROUP BY 1", "calendar profile")
def _(v: Views) -> DataFrame:
    return _reasons(v).groupBy(F.coalesce("reason", F.lit("candidate")).alias("reason")).agg(F.count("*").alias("n"))


@query("p21_weekly_candidates", """
SELECT entry_id, symbol, CASE WHEN hour = 'amc' THEN day + CAST(CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT) ELSE day END AS session_day
FROM calendar JOIN profile p USING (symbol) WHERE eps_estimate <> 0 AND eps_actual >= 0 AND (eps_actual - eps_estimate) / abs(eps_estimate) * 100 > 1 AND (eps_actual - eps_estimate) / abs(eps_estimate) * 100 <= 600
 AND p.market_cap > 5000 AND day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND symbol NOT IN (SELECT symbol FROM records WHERE data_source IS NULL)""", "calendar profile records")
def _(v: Views) -> DataFrame:
    from tidemark.operators.joins import exclude

    c = v.calendar.join(v.profile.select("symbol", "market_cap"), "symbol")
    inside = F.col("day").between(F.lit(date(1997, 1, 1)), F.lit(date(1997, 12, 31)))
    c = c.filter(clean.candidate_reason(F.col("eps_estimate"), F.col("eps_actual"), inside, F.col("market_cap"), 5000.0, strict_cap=True).isNull())
    c = exclude(c, v.records.filter("data_source IS NULL"), ["symbol"])
    return c.select("entry_id", "symbol", S.reaction_date(F.col("day"), F.col("hour")).alias("session_day"))


@query("p24_sample_gate", "SELECT count(*) AS n, min(report_date) AS first_day, max(report_date) AS last_day, CAST(max(report_date) - min(report_date) AS INT) AS span_days, count(*) >= 50 AND max(report_date) - min(report_date) > 60 AS enough FROM records", "records")
def _(v: Views) -> DataFrame:
    return clean.sample_gate(v.records)


@query("p26_feature_quality", _union([f"""SELECT '{c}' AS "column", 1 - count({c}) / CAST(count(*) AS DOUBLE) AS missing, count(DISTINCT {c}) AS n_distinct, (1 - count({c}) / CAST(count(*) AS DOUBLE) < 0.05) AND count(DISTINCT {c}) > 20 AND count(DISTINCT {c}) < 0.95 * count(*) AS usable FROM records""" for c in [*NUMS, "pct_1min", "earnings_time"]]), "records", "missing")
def _(v: Views) -> DataFrame:
    return clean.feature_quality(v.records, [*NUMS, "pct_1min", "earnings_time"])


_TARGETS = {"r1": "(close_price - open_price) / open_price", "r2": "pct_change_close / 100", "r3": "pct_1hr / 100"}


@query("p27_target_columns", "WITH t AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _TARGETS.items()) + " FROM records) " + _union([f"SELECT {i} AS ordinal, '{n}' AS \"column\", count({n}) / CAST(count(*) AS DOUBLE) AS coverage, avg({n}) AS mean, stddev_samp({n}) AS std, (count({n}) / CAST(count(*) AS DOUBLE) >= 0.9) AND stddev_samp({n}) > 0.001 AND abs(avg({n})) < 0.1 AS valid FROM t" for i, n in enumerate(_TARGETS)]), "records", "coverage mean std")
def _(v: Views) -> DataFrame:
    return clean.target_columns(v.records.select(*(F.expr(e).alias(n) for n, e in _TARGETS.items())), list(_TARGETS))


@query("f1_surprises", "SELECT entry_id, (eps_actual - eps_estimate) / nullif(abs(eps_estimate), 0) * 100 AS eps_surprise, (revenue_actual - revenue_estimate) / nullif(abs(revenue_estimate), 0) * 100 AS revenue_surprise, (eps_actual - eps_estimate) / nullif(eps_estimate, 0) * 100 AS change FROM calendar", "calendar", "eps_surprise revenue_surprise change")
def _(v: Views) -> DataFrame:
    return v.calendar.select("entry_id", S.surprise_pct(F.col("eps_actual"), F.col("eps_estimate")).alias("eps_surprise"), S.surprise_pct(F.col("revenue_actual"), F.col("revenue_estimate")).alias("revenue_surprise"), S.pct_change(F.col("eps_estimate"), F.col("eps_actual")).alias("change"))


@query("f4_business_days", """
SELECT entry_id, day - CAST(CASE isodow(day) WHEN 1 THEN 3 WHEN 7 THEN 2 ELSE 1 END AS INT) AS prev_day, day + CAST(CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT) AS next_day, isodow(day) < 6 AS is_business,
       CASE WHEN hour = 'amc' THEN day + CAST(CASE isodow(day) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END AS INT) ELSE day END AS reaction_day FROM calendar""", "calendar")
def _(v: Views) -> DataFrame:
    d = F.col("day")
    return v.calendar.select("entry_id", S.prev_business_day(d).alias("prev_day"), S.next_business_day(d).alias("next_day"), S.is_business_day(d).alias("is_business"), S.reaction_date(d, F.col("hour")).alias("reaction_day"))


@query("f7_week_ranges", """
WITH b AS (SELECT min(day) AS a, max(day) AS z FROM calendar), w AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 7 DAY)) AS DATE) AS f, z FROM b), n AS (SELECT CAST(f AS DATE) AS f, least(CAST(f AS DATE) + 6, z) AS t FROM w)
SELECT f AS week_from, t AS week_to, (SELECT count(*) FROM calendar WHERE day BETWEEN f AND t) AS n FROM n""", "calendar")
def _(v: Views) -> DataFrame:
    first = v.calendar.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    weeks = first.select(F.inline(S.week_ranges(F.col("a"), F.col("z")))).select(F.col("from").alias("week_from"), F.col("to").alias("week_to"))
    start = first.first()["a"]
    counts = v.calendar.groupBy(F.date_add(F.lit(start), (F.floor(F.datediff("day", F.lit(start)) / 7) * 7).cast("int")).alias("week_from")).agg(F.count("*").alias("n"))
    return weeks.join(counts, "week_from", "left").fillna(0, ["n"]).select("week_from", "week_to", "n")


@query("f8_last_business_days", """
WITH b AS (SELECT max(day) AS z FROM calendar), s AS (SELECT CAST(z - CAST(i AS INT) AS DATE) AS day, i FROM b, generate_series(1, 60) g(i)), k AS (SELECT day FROM s WHERE isodow(day) < 6 ORDER BY day DESC LIMIT 30)
SELECT day, (SELECT count(*) FROM calendar c WHERE c.day = k.day) AS n FROM k""", "calendar")
def _(v: Views) -> DataFrame:
    days = v.calendar.agg(F.max("day").alias("z")).select(F.explode(S.last_business_days(F.col("z"), 30)).alias("day"))
    return days.join(v.calendar.groupBy("day").agg(F.count("*").alias("n")), "day", "left").fillna(0, ["n"])


@query("f9_session_minutes", """
SELECT record_id, CASE WHEN m BETWEEN 0 AND 390 THEN m END AS high_minutes, earnings_time AS time_code, CASE WHEN data_source = 'Alpaca' THEN 1 ELSE 0 END AS source_code
FROM (SELECT record_id, earnings_time, data_source, CAST(split_part(high_time, ':', 1) AS INT) * 60 + CAST(split_part(high_time, ':', 2) AS INT) - 570 AS m FROM records) q""", "records")
def _(v: Views) -> DataFrame:
    time = F.element_at(F.array(F.lit("?"), F.lit("bmo"), F.lit("AMC ")), F.col("earnings_time") + 2)
    return v.records.select("record_id", S.minutes_since_open(F.col("high_time")).alias("high_minutes"), S.earnings_time_code(time).alias("time_code"), S.data_source_code(F.col("data_source")).alias("source_code"))


@query("f12_equal_width", """
WITH x AS (SELECT record_id, ln(1 + coalesce(market_cap, 0)) AS c FROM records), b AS (SELECT min(c) AS lo, max(c) AS hi FROM x)
SELECT record_id, ['XS', 'S', 'M', 'L', 'XL'][CAST(greatest(1, least(5, ceil((c - lo) / ((hi - lo) / 5)))) AS INT)] AS bucket FROM x, b""", "records")
def _(v: Views) -> DataFrame:
    from tidemark.operators.features import market_cap

    return market_cap(v.records).select("record_id", F.col("market_cap_bucket").alias("bucket"))


@query("f20_report_lines", """
SELECT record_id, concat_ws(' | ', symbol, strftime(report_date, '%Y-%m-%d'), 'surprise ' || coalesce(printf('%+.2f%%', surprise), 'N/A'), 'high ' || coalesce(printf('%+.2f%%', pct_change_high), 'N/A'), 'close ' || coalesce(printf('%+.2f%%', pct_change_close), 'N/A'), 'volume ' || coalesce(format('{:,}', CAST(opening_minute_volume AS BIGINT)), 'N/A')) AS line
FROM (SELECT record_id, symbol, report_date, opening_minute_volume, CAST(record_id % 97 - 48 AS DOUBLE) / 4 AS surprise, CASE WHEN pct_change_high IS NULL THEN NULL ELSE CAST(record_id % 41 - 20 AS DOUBLE) / 4 END AS pct_change_high, CASE WHEN pct_change_close IS NULL THEN NULL ELSE CAST(record_id % 53 - 26 AS DOUBLE) / 4 END AS pct_change_close FROM records) q""", "records")
def _(v: Views) -> DataFrame:
    q = lambda m, o: ((F.col("record_id") % m) - o).cast("double") / 4
    r = v.records.withColumns({"surprise": q(97, 48), "pct_change_high": F.when(F.col("pct_change_high").isNotNull(), q(41, 20)), "pct_change_close": F.when(F.col("pct_change_close").isNotNull(), q(53, 26))})
    return sinks.report_lines(r)
