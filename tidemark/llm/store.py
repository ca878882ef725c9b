"""Tables that every executor can reach, and helpers around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.shared import new_path


def keep(df: DataFrame, what: str) -> DataFrame:
    """df as a written table: cuts the lineage, survives lost executors and gives later joins a known size."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def first_by_hash(df: DataFrame, key: str, k: int, ties: list[str]) -> DataFrame:
    """The k rows of df whose key has the smallest hash. Every task sends its first k rows to one task, so a bound on
    the hash first leaves about 2 k rows in all; it is dropped where fewer than k rows lie below it."""
    n = df.count()
    if n > 4 * k:
        low = df.filter(F.xxhash64(key) < -(1 << 63) + int((1 << 64) * (2 * k / n)))
        if low.count() >= k:
            df = low
    return df.orderBy(F.xxhash64(key), *ties).limit(k)
