"""A corpus from raw documents to token ids: quality rules, near-dedup, substring dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, mixing, nearcopies, quality, simhash, substrings
from tidemark.llm.store import keep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash classes over five-word shingles, joined by the links of texts of five-word similarity 0.8 at least: the
    classes' radius misses most texts with edited words. One document of each group stays."""
    classes = simhash.classes(docs, nearcopies.SHINGLE).select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    return nearcopies.apply(docs, classes)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.apply(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.apply(docs)


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("source mix", source_mix), ("bpe encoding", bpe_encode)]

#: SQL expresses neither fingerprints nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
