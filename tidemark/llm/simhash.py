"""SimHash near-duplicates by tiled exact comparison.

Each text gets a 64-bit fingerprint: a bit is set if more than half of its shingle hashes have it. Two fingerprints that
differ in at most RADIUS bits agree in one of RADIUS + 1 blocks of bits, so every link lies among the fingerprints of
some block value. These are sorted by the bit counts of their four 16-bit quarters and cut into tiles. A pair of tiles
of one block value whose bit counts differ beyond the radius holds no link and is skipped; the other pairs are compared
whole, with numpy exclusive-or and bit counts. A task returns a spanning forest of the links it found, never all pairs of
a group. No link is lost, and a block value with many fingerprints is spread over many tiles.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows share a fingerprint;
a row with null doc_id gets a fingerprint and no component, and links nothing; rows with one doc_id are one node, and
`apply` keeps the smallest text of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.components import components
from tidemark.llm.store import fresh, keep

SHINGLE, RADIUS, TILE, PER_KEY = 4, 4, 4096, 128
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def fingerprints_of(buf: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The fingerprints of the documents of one slice."""
    buf = _lower[buf]
    starts, ends, first = words.spans(buf, off)
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    if not len(starts):
        return out
    # words joined by one space each, in one piece of memory: every shingle is then one slice
    length = ends - starts
    to = np.concatenate([[0], np.cumsum(length + 1)])
    keep_byte = np.flatnonzero(~words.SPACES[buf])
    joined = np.full(to[-1], 32, np.uint8)
    joined[np.arange(len(keep_byte)) + np.repeat(np.arange(len(length)), length)] = buf[keep_byte]
    text, h = joined.tobytes(), xxhash.xxh64_intdigest
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    total = int(count.sum())
    before = np.concatenate([[0], np.cumsum(count)])
    begin = np.arange(total) + np.repeat(first[:-1] - before[:-1], count)
    end = np.minimum(begin + k, np.repeat(first[1:], count))
    hashes = np.fromiter((h(text[a:b], 42) for a, b in zip(to[begin].tolist(), (to[end] - 1).tolist(), strict=True)), np.uint64, total)
    some = np.flatnonzero(count)
    step = 1 << 16  # shingles whose bits are spread out at once
    sums = np.zeros((len(n), 64), np.int64)
    of = np.repeat(np.arange(len(n)), count)
    for i in range(0, total, step):
        bits = np.unpackbits(hashes[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        d = of[i : i + step]
        edge = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        sums[d[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * sums[some] > count[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in words.slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprints_of(buf, off, shingle).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int32)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts each sorted partition into tiles of one key, named by key and first fingerprint (distinct within a key)."""
    names = ["key", "tile", "n", "low", "high", "fps", "nodes"]

    def tiles(key: np.ndarray, fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        edge = np.unique(np.concatenate([edge, *(np.arange(a, b, TILE) for a, b in zip(edge, np.append(edge[1:], len(key)), strict=True) if b - a > TILE)])).astype(np.int64)
        end = np.append(edge[1:], len(key))
        q = quarters(fp)
        box = [pa.array(f(q, edge, axis=0).tolist(), pa.list_(pa.int32())) for f in (np.minimum.reduceat, np.maximum.reduceat)]
        body = [pa.array([x[a:b].tobytes() for a, b in zip(edge, end, strict=True)], pa.binary()) for x in (fp, node)]
        return pa.RecordBatch.from_arrays([pa.array(key[edge]), pa.array(fp[edge].view(np.int64)), pa.array((end - edge).astype(np.int32)), *box, *body], names)

    held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    for b in batches:
        new = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        held = [np.concatenate([x, y.view(x.dtype)]) for x, y in zip(held, new, strict=True)]
        # the last key may go on in the next batch; of a long one, whole tiles are cut off
        last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        cut = last + (len(held[0]) - last) // TILE * TILE
        if cut:
            yield tiles(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield tiles(*held)


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest one that the edges u-v lead to."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> np.ndarray:
    """Labels of the spanning forest of all links between tiles a and b (nodes: a's entries, then b's)."""
    n = len(a) + len(b)
    u = v = np.zeros(0, np.int64)
    step = max(1, 65536 // max(1, len(b)))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for i in range(0, len(a), step):
        near = np.flatnonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, :]) <= radius)
        if not len(near):
            continue
        x, y = near // len(b) + i, near % len(b)
        if same:
            x, y = x[x < y], y[x < y]
        found.append((x, y + len(a)))
        held += len(x)
        if held > 1_000_000:  # many links: keep only what they connect
            label = spanning(*(np.concatenate([w, *(f[k] for f in found)]) for k, w in enumerate((u, v))), n)
            u = np.flatnonzero(label != np.arange(n))
            v, found, held = label[u], [], 0
    if not found and not len(u):
        return np.arange(n)
    if same:  # entry i of b is entry i of a
        found.append((np.arange(len(a)), np.arange(len(a)) + len(a)))
    return spanning(*(np.concatenate([w, *(f[k] for f in found)]) for k, w in enumerate((u, v))), n)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            at, to, fa, na, fb, nb = (batch.column(i)[r].as_py() for i in range(6))
            nodes = np.concatenate([np.frombuffer(x, np.int64) for x in (na, nb)])
            label = compare(np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64), at == to)
            linked = np.flatnonzero(nodes[label] != nodes)
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], ["a", "b"])


def block_keys(bits: int) -> list[Column]:
    """For each of RADIUS + 1 blocks a key: the block's number and the low bits of its value."""
    width = 64 // (RADIUS + 1) + 1
    blocks = [(i * width, min(width, 64 - i * width)) for i in range(RADIUS + 1)]
    return [F.shiftrightunsigned("fp", at).bitwiseAND((1 << min(bits, w)) - 1) + F.lit(i << width).cast("bigint") for i, (at, w) in enumerate(blocks)]


def links(distinct: DataFrame) -> DataFrame:
    """A spanning set (a, b) of the links among distinct(fp, node), fp without repeats. Keys use as many bits of a block
    as leave about PER_KEY fingerprints to a key."""
    count = distinct.count()
    bits = max(0, (count // PER_KEY).bit_length())
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)) for i in range(4)]
    order = ["key", "q0", "q1", "q2", "q3", "fp"]
    keyed = distinct.select("fp", "node", F.explode(F.array(*block_keys(bits))).alias("key"), *(q.alias(f"q{i}") for i, q in enumerate(quarter)))
    # by range over all of the order, so a key with many fingerprints is dealt to many tasks
    ordered = keyed.repartitionByRange(max(1, -(-count * (RADIUS + 1) // 65536)), *order).sortWithinPartitions(*order)
    tiles = keep(ordered.select("key", "fp", "node").mapInArrow(_tiles, "key bigint, tile bigint, n int, low array<int>, high array<int>, fps binary, nodes binary"), "tiles")
    a, b = (tiles.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("tile", "n", "low", "high"))) for x in "ab")
    # every pair within reach meets at a bit count of the first quarter
    a = a.withColumn("q", F.explode(F.sequence(F.col("low_a")[0] - RADIUS, F.col("high_a")[0] + RADIUS)))
    b = b.withColumn("q", F.explode(F.sequence(F.col("low_b")[0], F.col("high_b")[0])))
    gap = sum((F.greatest(F.lit(0), F.col("low_a")[i] - F.col("high_b")[i], F.col("low_b")[i] - F.col("high_a")[i]) for i in range(4)), F.lit(0))
    pairs = a.join(b, ["key", "q"]).filter((F.col("tile_a") <= F.col("tile_b")) & (gap <= RADIUS) & ((F.col("tile_a") < F.col("tile_b")) | (F.col("n_a") > 1))).select("key", "tile_a", "tile_b").distinct()
    body = [tiles.select("key", F.col("tile").alias(f"tile_{x}"), F.col("fps").alias(f"fps_{x}"), F.col("nodes").alias(f"nodes_{x}")) for x in "ab"]
    both = pairs.join(body[0], ["key", "tile_a"]).join(body[1], ["key", "tile_b"]).select("tile_a", "tile_b", "fps_a", "nodes_a", "fps_b", "nodes_b")
    return both.mapInArrow(_compare, "a bigint, b bigint")


def classes(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id reachable over links of RADIUS bits at most."""
    fps = keep(fingerprints(docs, shingle), "fingerprints")
    first = keep(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    # rows with one doc_id but different fingerprints are one node: they link their fingerprints' nodes
    several = fps.dropna().groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("doc_id")
    ties = fps.join(several, "doc_id", "left_semi").join(first, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = components(links(first.dropna()).unionByName(ties))
    of_fp = first.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return fps.join(of_fp, "fp").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def apply(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row of each class: that of the smallest doc_id, and of its rows that of the smallest text. Rows without doc_id
    stay."""
    ids = classes(docs, shingle).filter("doc_id = component_id").select("doc_id").distinct()
    return one_row_each(docs.filter("doc_id is not null").join(ids, "doc_id", "left_semi").select(docs.columns)).unionByName(docs.filter("doc_id is null"))


def one_row_each(docs: DataFrame) -> DataFrame:
    """Of the rows of each doc_id that of the smallest text (null is the smallest), then the smallest hash of the row."""
    order = F.struct(F.col("text").isNotNull(), F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))
    once = docs.groupBy(F.col("doc_id").alias(fresh(docs, "one_id"))).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return once.select("row.*")
