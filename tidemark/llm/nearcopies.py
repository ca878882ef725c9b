"""Edited copies: texts whose sets of five-word shingles have a Jaccard similarity of NEAR at least.

Candidates share all ROWS minima of one of BANDS bands of a MinHash signature; a pair of similarity 0.8 is missed with
probability (1 - 0.8**ROWS)**BANDS, about 3e-6. Every link is confirmed on the whole shingle sets (64-bit hashes). First
each member of a bucket is compared with the bucket's smallest node, which connects a group of copies however large it
is. Buckets of three or more that are still in several components are then cut into tiles, and all pairs of their
members that are in different components are compared; a task returns a spanning forest of the links it found.

Defined results: white space and ASCII capitals don't matter; texts of fewer than five words are one shingle; null and
empty texts are copies of each other; rows without doc_id stay; two rows with one doc_id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.components import components
from tidemark.llm.simhash import _lower, one_row_each
from tidemark.llm.store import keep

SHINGLE, NEAR, BANDS, ROWS, TILE = 5, (4, 5), 32, 5, 100_000
#: Bytes of text in a slice, and of tile pairs in an Arrow batch: what a task holds at a time.
SLICE, BATCH_BYTES = 1_000_000, 8_000_000
_salts = words.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def sets_of(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of the documents of one slice, ascending in each, and the offsets of the documents."""
    buf = _lower[buf]
    starts, ends, first = words.spans(buf, off)
    n = np.diff(first)
    hashes = words.Spans(buf)(starts, ends)
    at, found = words.windows(hashes, first, k)
    of = np.searchsorted(first, at, "right") - 1
    for short in range(1, k):  # a text of fewer words is one shingle
        begin, h = words.windows(hashes, first, short)
        which = np.searchsorted(first, begin, "right") - 1
        of, found = np.concatenate([of, which[n[which] == short]]), np.concatenate([found, h[n[which] == short]])
    order = np.lexsort((found, of))
    of, found = of[order], found[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])])[: len(of)]
    return found[new], np.searchsorted(of[new], np.arange(len(n) + 1))


def sketch(found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each set its name (a hash of the whole set) and its BANDS keys; an empty set has keys of no meaning."""
    n = len(at) - 1
    some = np.flatnonzero(np.diff(at))
    name, keys = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
    if len(some):
        edge = at[:-1][some]
        name[some] = words.mix(np.add.reduceat(words.mix(found ^ np.uint64(0x5851F42D4C957F2D)), edge))
        for band in range(BANDS):
            key = np.full(len(some), band + 1, np.uint64)
            for salt in _salts[band * ROWS : (band + 1) * ROWS]:
                key = words.mix(key ^ np.minimum.reduceat((found ^ (salt >> np.uint64(7))) * salt, edge))
            keys[some, band] = key
    return name, keys


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in words.slices(batches, limit=SLICE):
        found, at = sets_of(buf, off)
        name, keys = sketch(found, at)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(name.view(np.int64)), pa.array(np.diff(at).astype(np.int64)), bands], ["doc_id", "name", "n", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in words.slices(batches, limit=SLICE):
        found, at = sets_of(buf, off)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([found[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["node", "hashes"])


def near(shared: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements of which so many are shared reach NEAR."""
    return shared * NEAR[1] >= (n + m - shared) * NEAR[0]


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = ((np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True))
        good = [bool(near(np.intersect1d(x, y, assume_unique=True).size, len(x), len(y))) for x, y in pairs]
        yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(good, pa.bool_())) for i in range(2)], ["a", "b"])


def forest(a: list[tuple[int, int, bytes]], b: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """Links between (node, component, set) of a and b that connect whatever all links between them connect."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    held = [np.frombuffer(x[2], np.uint64) for x in b]
    size = np.array([len(x) for x in held], np.int64)
    out = []
    for node, label, raw in a:
        mine = np.frombuffer(raw, np.uint64)
        n, top = len(mine), find(label)
        fit = [j for j in np.flatnonzero(near(np.minimum(size, n), n, size)) if find(b[j][1]) != top]
        if not fit:
            continue
        inside = np.isin(np.concatenate([held[j] for j in fit]), mine)
        shared = np.add.reduceat(inside, np.concatenate([[0], np.cumsum(size[fit])[:-1]]), dtype=np.int64)
        for j in np.array(fit)[near(shared, n, size[fit])]:
            x, y = find(label), find(b[j][1])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((node, b[j][0]))
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            a, b = ([(x["node"], x["label"], x["hashes"]) for x in batch.column(i)[r].as_py()] for i in range(2))
            found = forest(a, b)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], ["a", "b"])


def links(docs: DataFrame) -> DataFrame:
    """A spanning set (a, b) of the links among doc_ids."""
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    sketches = keep(rows.mapInArrow(_sketches, "doc_id bigint, name bigint, n bigint, bands array<bigint>"), "sketches")
    names = keep(sketches.groupBy("name", "n").agg(F.min("doc_id").alias("node")), "names")
    equal = sketches.join(names, ["name", "n"]).filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    once = sketches.join(names.filter("n > 0").select("name", "n", F.col("node").alias("doc_id")), ["name", "n", "doc_id"], "left_semi")
    banded = once.select(F.explode("bands").alias("key"), F.col("doc_id").alias("node"), "n")
    buckets = keep(banded.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("members"), F.sum("n").alias("hashes")).filter("least < most"), "buckets")
    members = keep(banded.join(buckets, "key"), "members")
    sets = keep(rows.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets, "node bigint, hashes binary"), "sets")
    pairs = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    body = [sets.select(F.col("node").alias(x), F.col("hashes").alias(f"hashes_{x}")) for x in "ab"]
    stars = keep(pairs.join(body[0], "a").join(body[1], "b").select("a", "b", "hashes_a", "hashes_b").mapInArrow(_confirm, "a bigint, b bigint"), "stars")
    labels = components(stars.unionByName(equal))
    # a bucket of two is decided; of the others, those in one component are
    labelled = keep(members.filter("members > 2").join(labels, "node", "left").select("key", "node", "hashes", F.coalesce("label", "node").alias("label")), "labelled")
    open_ = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    tile = F.pmod(F.xxhash64("node"), F.ceil(F.col("hashes") / TILE))
    dealt = labelled.join(open_, "key", "left_semi").select("key", tile.alias("tile"), "node", "label")
    tiles = keep(dealt.join(sets, "node").groupBy("key", "tile").agg(F.collect_list(F.struct("node", "label", "hashes")).alias("rows")), "set-tiles")
    a, b = (tiles.select("key", F.col("tile").alias(f"tile_{x}")) for x in "ab")
    tiled = a.join(b, "key").filter("tile_a <= tile_b")
    for x in "ab":
        tiled = tiled.join(tiles.select("key", F.col("tile").alias(f"tile_{x}"), F.col("rows").alias(f"rows_{x}")), ["key", f"tile_{x}"])
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", docs.sparkSession
    usual = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        rest = keep(tiled.select("rows_a", "rows_b").mapInArrow(_compare, "a bigint, b bigint"), "tile-links")
    finally:
        spark.conf.set(key, usual)
    return stars.unionByName(equal).unionByName(rest)


def apply(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One row of each group of copies: that of the smallest doc_id, and of its rows that of the smallest text. Rows
    without doc_id stay. more: further links (a, b) between doc_ids."""
    found = links(docs) if more is None else links(docs).unionByName(more)
    gone = components(found).filter("node <> label").select(F.col("node").alias("doc_id"))
    return one_row_each(docs.filter("doc_id is not null").join(gone, "doc_id", "left_anti").select(docs.columns)).unionByName(docs.filter("doc_id is null"))
