"""URL rules by sort-merge range join, in DataFrame functions only.

A host becomes a canonical key: its labels reversed, each followed by a dot (`com.example.`). A rule's host is then an
interval of keys, [key, key with its last dot raised). The sweep sorts interval bounds and host keys together; a running
value carries the stack of rules open after the latest bound. Distinct hosts (combined before the shuffle) are dealt to
sweeps by hash, each of which holds all bounds, so a common host or domain makes no sweep longer. Pages then join their
host's stack and take the longest rule in it whose path begins theirs.

Defined results: null urls and urls without `://` have empty host and path and fit no rule; no rule gives the default
verdict; repeated rows repeat; equal rules count once; rules tie by length only on one host, where the later path in
byte order wins; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.store import partitions

Rule = tuple[str, str, str]  # verdict, host, path
RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
DEFAULT = "allow"
#: Bounds are copied into every sweep, so rules are few next to hosts: at most this many.
MAX_RULES = 100_000


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def stacks(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(bound, stack): from this key on, until the next bound, the rules in stack are open. Bounds are interval ends of
    the rules; a bound's stack holds the rules whose interval contains it."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    table = spark.createDataFrame(sorted(set(rules)), "verdict string, host string, path string")
    table = table.withColumn("low", key_of(F.col("host"))).withColumn("high", F.concat(F.expr("substring(low, 1, length(low) - 1)"), F.lit("/")))
    bounds = table.select(F.explode(F.array("low", "high")).alias("bound")).distinct()
    # an interval's bounds are prefixes of the keys inside: a rule is open at a bound that begins with its key
    labels = F.split(F.regexp_replace("bound", "[./]$", ""), r"\.", -1)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))
    opened = bounds.select("bound", F.explode(prefixes).alias("low")).join(table, "low").filter((F.col("low") <= F.col("bound")) & (F.col("bound") < F.col("high")))
    entry = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("n_host"), "path", "host", "verdict")
    held = opened.groupBy("bound").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))  # as deep as rules nest
    return bounds.join(held, "bound", "left")


def verdicts(pages: DataFrame, rules: list[Rule] | None = None, default: str = DEFAULT, sweeps: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    spark = pages.sparkSession
    sweeps = sweeps or 2 * partitions(spark)
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = judged.select("host").distinct().select(F.pmod(F.xxhash64("host"), F.lit(sweeps)).alias("sweep"), key_of(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", F.lit(None).cast("array<struct<n:int,n_host:int,path:string,host:string,verdict:string>>").alias("stack"))
    marks = stacks(spark, RULES if rules is None else rules).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(sweeps - 1).cast("bigint"))).alias("sweep"), F.col("bound").alias("key"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.coalesce("stack", F.array().cast("array<struct<n:int,n_host:int,path:string,host:string,verdict:string>>")).alias("stack"))
    order = Window.partitionBy("sweep").orderBy("key", "kind")
    swept = hosts.unionByName(marks).withColumn("open", F.last("stack", ignorenulls=True).over(order)).filter("kind = 1").select("host", "open")
    found = judged.join(swept, "host", "left").withColumn("best", F.try_element_at(F.filter("open", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1)))
    return found.select("page_id", "host", "path", F.concat(F.col("best.host"), F.col("best.path")).alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p
), r(verdict, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, h || pre AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) + length(pre) DESC, length(h) DESC) AS k
  FROM q JOIN r ON (q.host = r.h OR q.host LIKE '%.' || r.h) AND starts_with(q.path, r.pre)
)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id AND m.k = 1
"""
