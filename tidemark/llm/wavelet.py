"""Token shards as wavelet matrices.

A shard file holds the ids of a run of documents as bit planes over the shard's own alphabet (its distinct ids, sorted).
Plane l holds bit l of all codes, in the order that the planes above leave: zeros first, then ones, stably. Every BLOCK
bits of a plane the file holds its ones so far, so a rank takes one sample and the bits of one block, and a select a search
among samples and one block. With these the file answers access, counting and occurrence look-ups where it lies: opening
it reads no plane.

File: a header (magic, numbers of documents n, of ids t, of distinct ids s and of planes p), a mask of null doc_ids, n
doc_ids (8 bytes each), n + 1 offsets (8), s ids (4), p zero counts (8), p times ceil(t / BLOCK) samples (4), then p planes
of ceil(t / 8) bytes, first bit highest. The global start is not inside, so a shard is written before those in front of it
are known; a prefix sum over the table of shards gives it. All integers are little-endian. Files are the binary column of a
Parquet table in the shared folder, since only Spark's writers reach every store.

Defined results: null and empty texts hold the end id alone; null doc_ids come first; rows of one doc_id are
ordered by their texts' hashes; repeated rows follow each other;
an empty table writes no file and gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm import words
from tidemark.llm.bpe import SLICE, default_path, encoder
from tidemark.llm.store import new_path, partitions

END_ID, SHARD_IDS, BLOCK = 2, 1_000_000, 512
_MAGIC, _HEAD = b"TMW2", struct.Struct("<4sqqqq")


def build(doc_ids: list[int | None], offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of one shard."""
    t = len(ids)
    count = np.bincount(ids) if t else np.zeros(0, np.int64)
    alphabet = np.flatnonzero(count)
    code = np.zeros(len(count), np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    x = code[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    n_planes = max(0, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    zeros, samples, planes = [], [], []
    for level in range(n_planes - 1, -1, -1):
        bit = ((x >> x.dtype.type(level)) & x.dtype.type(1)).astype(bool)
        plane = np.packbits(bit)
        planes.append(plane.tobytes())
        ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.uint32)
        samples.append((np.cumsum(ones, dtype="<u4") - ones).astype("<u4").tobytes())
        x = np.concatenate([low := x.take(np.flatnonzero(~bit)), x.take(np.flatnonzero(bit))])
        zeros.append(len(low))
    ids8 = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], bool))
    return b"".join([_HEAD.pack(_MAGIC, len(doc_ids), t, len(alphabet), n_planes), null.tobytes(), ids8.tobytes(), offsets.astype("<i8").tobytes(), alphabet.astype("<u4").tobytes(), np.array(zeros, "<i8").tobytes(), *samples, *planes])


class Shard:
    """A shard file opened for reading."""

    def __init__(self, data: bytes):
        magic, n, self.size, s, self.n_planes = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet shard")
        at = _HEAD.size

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, k, at)
            at += out.nbytes
            return out

        null = np.unpackbits(take("u1", -(-n // 8)), count=n).astype(bool)
        self.doc_ids = [None if z else int(d) for d, z in zip(take("<i8", n), null, strict=True)]
        self.offsets, self.alphabet, self.zeros = take("<i8", n + 1), take("<u4", s), take("<i8", self.n_planes)
        self.samples = [take("<u4", -(-self.size // BLOCK)) for _ in range(self.n_planes)]
        self.planes = [take("u1", -(-self.size // 8)) for _ in range(self.n_planes)]

    def ids(self) -> np.ndarray:
        """All ids in order, by undoing the planes from the last one up."""
        x = np.zeros(self.size, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level, (plane, nought) in enumerate(zip(reversed(self.planes), reversed(self.zeros), strict=True)):
            bit = np.unpackbits(plane, count=self.size).view(bool)
            ones = np.flatnonzero(bit)
            y = np.empty_like(x)
            y[np.flatnonzero(~bit)] = x[:nought]
            y[ones] = x[nought:] | x.dtype.type(1 << level)
            x = y
        return self.alphabet[x] if len(self.alphabet) else np.zeros(0, np.uint32)

    def _rank(self, level: int, at: int) -> int:
        """Ones in plane `level` before position at."""
        block, left = divmod(at, BLOCK)
        if block == len(self.samples[level]):  # the very end, on a block's edge
            return self.size - int(self.zeros[level])
        bits = int.from_bytes(self.planes[level][block * BLOCK // 8 :][: BLOCK // 8].tobytes().ljust(BLOCK // 8, b"\0"))
        return int(self.samples[level][block]) + (bits >> (BLOCK - left)).bit_count()

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        code = 0
        for level in range(self.n_planes):
            ones, bit = self._rank(level, at), self.planes[level][at // 8] >> (7 - at % 8) & 1
            code, at = code << 1 | int(bit), int(self.zeros[level]) + ones if bit else at - ones
        return int(self.alphabet[code])

    def _interval(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences among positions begin to end lie after the last plane."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0
        for level in range(self.n_planes):
            a, b = self._rank(level, begin), self._rank(level, end)
            begin, end = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if code >> (self.n_planes - 1 - level) & 1 else (begin - a, end - b)
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often a token occurs among positions begin to end."""
        a, b = self._interval(token, begin, self.size if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The position of the k-th (from 0) such bit in a plane."""
        before = self.samples[level] if bit else np.arange(len(self.samples[level]), dtype=np.int64) * BLOCK - self.samples[level]
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 :][: BLOCK // 8], count=min(BLOCK, self.size - block * BLOCK))
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def locate(self, token: int) -> list[int]:
        """All positions of a token, in order."""
        begin, end = self._interval(token, 0, self.size)
        code = int(np.searchsorted(self.alphabet, token))
        out = []
        for at in range(begin, end):
            for level in range(self.n_planes - 1, -1, -1):
                bit = code >> (self.n_planes - 1 - level) & 1
                at = self._select(level, bit, at - int(self.zeros[level]) if bit else at)  # noqa: PLW2901
            out.append(at)
        return sorted(out)


def _write(path: str, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        docs, sizes, flats, held, seq = [], [], [], 0, 0

        def file() -> pa.RecordBatch:
            nonlocal docs, sizes, flats, held, seq
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            out = pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([held]), pa.array([build(docs, offsets, np.concatenate(flats))], pa.binary())], ["seq", "n_ids", "file"])
            docs, sizes, flats, held = [], [], [], 0
            seq += 1
            return out

        for rows, _, _ in words.slices(batches, limit=SLICE):
            flat, before = model.encode(rows.column(1))
            ends = np.insert(flat, before[1:], END_ID)  # each document's ids are followed by the end id
            docs += rows.column(0).to_pylist()
            sizes += (np.diff(before) + 1).tolist()
            flats.append(ends)
            held += len(ends)
            if held >= shard_ids:
                yield file()
        if docs:
            yield file()

    return run


def write(docs: DataFrame, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards of docs in ascending doc_id order and returns their table: part, seq, n_ids, file. Shards are
    ordered by part and seq; one is closed by the first slice of documents that fills it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"))  # deals out the rows of one doc_id
    ordered = rows.repartitionByRange(partitions(spark), "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").drop("hash")
    out = new_path(spark, "token-shards")
    table = ordered.mapInArrow(_write(path or default_path(), shard_ids), "seq bigint, n_ids bigint, file binary").select(F.spark_partition_id().alias("part"), "seq", "n_ids", "file")
    table.write.option("compression", "uncompressed").parquet(out)
    return spark.read.schema(table.schema).parquet(out)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in range(b.num_rows):
            shard = Shard(b.column(2)[r].as_py())
            raw = memoryview(shard.ids().astype("<u4").tobytes())
            off = shard.offsets
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(off[:-1], off[1:], strict=True)]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * n, pa.int32()), pa.array([b.column(1)[r].as_py()] * n, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(off[:-1]), pa.array(np.diff(off)), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    begin = shards.select("part", "seq", "n_ids").withColumn("begin", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).drop("n_ids")  # one row a shard
    rows = shards.select("part", "seq", "file").mapInArrow(_read, "part int, seq bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(begin, ["part", "seq"]).select("doc_id", (F.col("begin") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
