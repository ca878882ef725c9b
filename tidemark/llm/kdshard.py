"""K-d tree sharding by bytes.

A node of the tree is split at a weighted median along its widest dimension until every leaf holds the target bytes.
All nodes of a level are split together, and are rows of a table that is joined with the data: one aggregation gives their
extents, then histograms of bytes over ever finer bins (BINS a pass, combined before the shuffle) find each cut exactly.
Of a node one row a pass reaches the driver; more than MAX_LEAVES shards are an error. Rows that tie at a cut stay on one
side as long as that moves it by less than TOLERANCE of a leaf; a larger tie is cut along doc_id.

The dimensions are the size of the text (ties in the order of its checksum) and its checksum, metadata that every table
has; so only equal texts tie, and they share a shard unless they outweigh the tolerance. Defined results: null text has size
1 and the checksum of the empty text; null doc_ids order before all others; repeated rows get slots of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.store import keep

BINS, TOLERANCE, SLOT_BLOCK, SMALL, MAX_LEAVES = 4096, 0.01, 4000, 100_000, 4_000_000


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of nodes, sent to every task unless there are very many."""
    out = spark.createDataFrame(rows, schema)
    return F.broadcast(out) if len(rows) <= SMALL else out


def _found(rows: DataFrame, search: dict[int, Search], dims: list[str]) -> dict[int, tuple[int, int, int]]:
    """For each node the bin of its range in which its bytes reach the goal (else its last): its number, the bytes in it and
    those up to its end. Nodes are joined with the rows; one row a node reaches the driver."""
    nodes = [(n, s.axis, s.dim, s.low, s.high, s.step, s.tie, s.goal - s.below) for n, s in search.items()]
    held = _table(rows.sparkSession, nodes, "node int, axis string, dim string, low bigint, high bigint, step bigint, tie bigint, missing double")
    value = lambda name: F.coalesce(*(F.when(F.col(name) == d, F.col(d)) for d in dims))
    live = rows.join(held, "node").withColumn("value", value("dim"))
    live = live.filter((F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")) & (F.col("tie").isNull() | (value("axis") == F.col("tie"))))
    bins = live.groupBy("node", "missing", F.floor((F.col("value") - F.col("low")) / F.col("step")).alias("bin")).agg(F.sum("size").alias("mass"))
    upto = F.sum("mass").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows a node
    bin_ = F.struct("bin", "mass", "upto")
    chosen = bins.withColumn("upto", upto).groupBy("node").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("missing"), bin_)), F.max(bin_)).alias("b"))
    return {r["node"]: tuple(r["b"]) for r in chosen.collect()}


@dataclass
class Search:
    """Where a node's cut is looked for: a range of a dimension, the bytes below it, and the tie that is cut along doc_id."""

    goal: float
    axis: str
    dim: str
    low: int
    high: int
    below: float = 0.0
    tie: int | None = None

    @property
    def step(self) -> int:
        return -(-(self.high - self.low) // BINS)


def _cuts(rows: DataFrame, goal: dict[int, float], dims: list[str], slack: float) -> dict[int, tuple[str, int, int | None]]:
    """For each node: the dimension, the value v and (None or a doc_id) w, such that the rows with (dim, tie key) below
    the cut hold about goal[node] bytes: dim < v, or dim = v and doc_id < w."""
    extent = {r["node"]: r for r in rows.groupBy("node").agg(*(f(d).alias(f"{k}_{d}") for d in [*dims, "id"] for k, f in (("lo", F.min), ("hi", F.max)))).collect() if r["node"] in goal}
    world = {d: max(1, max(r[f"hi_{d}"] for r in extent.values()) - min(r[f"lo_{d}"] for r in extent.values())) for d in dims}
    out: dict[int, tuple[str, int, int | None]] = {}
    search = {}
    for n, e in extent.items():  # widest relative to the whole table's extent at this level
        axis = max(dims, key=lambda d, e=e: ((e[f"hi_{d}"] - e[f"lo_{d}"]) / world[d], -dims.index(d)))
        search[n] = Search(goal[n], axis, axis, e[f"lo_{axis}"], e[f"hi_{axis}"] + 1)
    while search:
        found, after = _found(rows, search, [*dims, "id"]), {}
        for n, s in search.items():
            bin_, here, upto = found.get(n, (0, 0, 0))
            at, before = s.low + bin_ * s.step, s.below + upto - here
            if s.step > 1 and here:
                after[n] = replace(s, low=at, high=min(s.high, at + s.step), below=before)
                continue
            left, right = abs(s.goal - before), abs(before + here - s.goal)
            cut = at if left <= right else at + 1
            if s.tie is not None:
                out[n] = (s.axis, s.tie, cut)
            elif min(left, right) > slack:
                after[n] = replace(s, dim="id", low=extent[n]["lo_id"], high=extent[n]["hi_id"] + 1, below=before, tie=at)
            else:
                out[n] = (s.dim, cut, None)
        search = after
    return out


def leaves(rows: DataFrame, n_leaves: int, dims: list[str]) -> DataFrame:
    """rows (with size and id) with the column shard: the leaf of each row, 0 to n_leaves - 1."""
    if n_leaves > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} shards")
    rows = keep(rows.withColumn("node", F.lit(0)), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0]
    # a node is named by its first leaf; span holds how many leaves it has
    span, mass = {0: n_leaves}, {0: float(total or 0)}
    while goal := {n: mass[n] * (s // 2) / s for n, s in span.items() if s > 1 and mass[n] > 0}:
        cuts = _cuts(rows, goal, dims, TOLERANCE * total / n_leaves)
        table = _table(rows.sparkSession, [(n, d, v, w, span[n] // 2) for n, (d, v, w) in cuts.items()], "node int, dim string, v bigint, w bigint, half int")
        value = F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in dims))
        over = (value > F.col("v")) | ((value == F.col("v")) & (F.col("w").isNull() | (F.col("id") >= F.col("w"))))
        rows = keep(rows.join(table, "node", "left").withColumn("node", F.col("node") + F.when(over, F.col("half")).otherwise(0)).drop("dim", "v", "w", "half"), "kd-rows")
        span = {k: v for n, s in span.items() for k, v in ({n: s // 2, n + s // 2: s - s // 2} if n in cuts else {n: 1}).items()}
        mass = dict.fromkeys(span, 0.0) | {r["node"]: float(r["m"]) for r in rows.groupBy("node").agg(F.sum("size").alias("m")).collect()}
    return rows.withColumnRenamed("node", "shard")


def slots(rows: DataFrame, block_rows: int = SLOT_BLOCK) -> DataFrame:
    """rows(shard, id, ...) with slot: numbers from 0 in each shard without gaps. Rows are dealt by hash into blocks of
    about block_rows, numbered there, and each block starts after those before it, so no task holds a whole shard."""
    n = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(max(1, math.ceil(n / block_rows)))))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = blocked.groupBy("shard", "block").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    here = Window.partitionBy("shard", "block").orderBy("id", "text_crc32", "size")
    return blocked.withColumn("row", F.row_number().over(here)).join(start, ["shard", "block"]).withColumn("slot", (F.col("start") + F.col("row") - 1).cast("long")).drop("block", "row", "start")


def shards(docs: DataFrame, target_bytes: int | None = None, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. With target_bytes the number of leaves follows from the table's bytes."""
    rows = measured(docs).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 62)))).withColumn("size_order", F.shiftleft("size", 32) + F.col("text_crc32"))
    if target_bytes:
        n_shards = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
    return slots(leaves(rows, n_shards, ["size_order", "text_crc32"])).select("doc_id", "size", "text_crc32", "shard", "slot")
