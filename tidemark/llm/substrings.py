"""Removal of repeated token windows.

Every window of `window` words gets a Rabin-Karp hash. Windows are counted in Spark: each task lays the distinct hashes
of a block of text (BLOCK bytes) out by hash bucket, Spark shuffles the packed rows, and a group of one bucket finds the
hashes that occur in more than one place. The number of buckets follows from the bytes of text, so a group holds about
GROUP bytes at any size. Within a block a hash is sent once, however often it occurs there, so a hot passage costs one
entry a block. Positions of repeated windows return to their block, merge with the windows repeated inside it into maximal
intervals of words, and a join by document removes them.

Two different windows are taken for equal only if their 61-bit polynomials modulo a prime, three more bits and their
buckets agree, which are independent: about 6e-4 expected pairs among the 9e9 windows of 50 GB of text, and, since the
buckets grow with the table, about two among the 1.6e13 windows of 100 TB.

Defined results: null and empty texts have no words; repeated rows repeat each other's windows, so all of their words in
windows go; a null doc_id is an id like any other; an empty table gives an empty result; other columns are ignored, and
`apply` returns them unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.store import fresh, partitions

WINDOW, BLOCK, GROUP = 35, 2_000_000, 32_000_000


def _pack(hashes: np.ndarray, places: np.ndarray, known: np.ndarray) -> tuple[bytes, bytes]:
    """Hashes in the order of their places, then those known to repeat; the gaps between places as byte planes, which
    compress well."""
    gaps = np.diff(places, prepend=np.uint32(0)).astype("<u4")
    return np.concatenate([hashes, known]).tobytes(), gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _places(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _blocks(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in words.slices(batches, limit=BLOCK):
            starts, ends, first = words.spans(buf, off)
            word = words.Spans(buf)(starts, ends)
            at, key = words.windows(word, first, window)
            if not len(at):
                continue
            # a block is named by what it holds, so a task that runs again names it alike
            ids = rows.column(0).to_pylist()
            name = xxhash.xxh64_intdigest(repr(ids).encode() + buf.tobytes(), 1) - (1 << 63)
            bag = words.bags(word, at, window)
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.ones(len(key), bool)
            new[1:] = sorted_key[1:] != sorted_key[:-1]
            group = np.flatnonzero(new)
            size = np.diff(np.append(group, len(key)))
            twice = order[group[size > 1]]
            mine = np.sort(at[order[np.repeat(size > 1, size)]]).astype(np.uint32)
            single = np.sort(order[group[size == 1]])
            cuts = []
            for some in (single, twice):
                bucket = (bag[some] % np.uint64(buckets)).astype(np.uint32)
                turn = np.argsort(bucket, kind="stable")
                cuts.append((some[turn], np.searchsorted(bucket[turn], np.arange(buckets + 1))))
            (single, edge), (twice, edge2) = cuts
            hashes, place, known = key[single], at[single].astype(np.uint32), key[twice]
            full = np.flatnonzero((np.diff(edge) > 0) | (np.diff(edge2) > 0))
            packed = [_pack(hashes[edge[i] : edge[i + 1]], place[edge[i] : edge[i + 1]], known[edge2[i] : edge2[i + 1]]) for i in full]
            docs = np.array([-1 if i is None else i for i in ids], np.int64)
            head = [docs.tobytes(), rows.column(1).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), first.astype(np.int64).tobytes(), mine.tobytes()]
            # the head travels with one bucket's row, another one for each block
            carrier = name % len(full)
            heads = pa.array([head if i == carrier else None for i in range(len(full))], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), name, np.int64)), pa.array(full.astype(np.int32)), pa.array([h for h, _ in packed]), pa.array([p for _, p in packed]), heads], ["block", "bucket", "hashes", "places", "head"])

    return run


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """The places, by block, of the hashes of one bucket that occur in two or more blocks; heads pass through."""
    parts = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
    again = words.repeated(np.concatenate(parts))
    out, i = [], 0
    for block, part, packed, head in zip(rows["block"], parts, rows["places"], rows["head"], strict=True):
        p = _places(packed)
        p = p[again[i : i + len(p)]]
        if len(p) or head is not None:
            out.append((block, p.tobytes(), head))
        i += len(part)
    return pd.DataFrame(out, columns=["block", "places", "head"], dtype=object)


def _merge(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Intervals [from, to) of words, by document of one block."""
        heads = [h for h in rows["head"] if h is not None]
        docs, keys, first, mine = (np.frombuffer(x, t) for x, t in zip(heads[0], (np.int64, np.int64, np.int64, np.uint32), strict=True))
        twice = len(heads) > 1  # the very same block lies in the table again: all of its windows repeat
        n = int(first[-1])
        starts = words.windows(np.zeros(n, np.uint64), first, window)[0] if twice else np.unique(np.concatenate([mine, *(np.frombuffer(p, np.uint32) for p in rows["places"] if p is not None)])).astype(np.int64)
        gone = words.covered(starts, window, n)
        edge = np.zeros(n + 1, bool)
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[0], edge[-1] = n > 0, n > 0
        edge[first] = True
        cut = np.flatnonzero(edge)
        begin, end = (x[gone[cut[:-1]]] for x in (cut[:-1], cut[1:]))
        doc = np.searchsorted(first, begin, "right") - 1
        base = first[doc]
        some = np.unique(doc)
        lo, hi = np.searchsorted(doc, some), np.searchsorted(doc, some, "right")
        spans = np.column_stack([begin - base, end - base]).astype(np.int32)
        return pd.DataFrame({"doc_id": docs[some], "key": keys[some], "spans": pd.Series([spans[a:b].ravel().tolist() for a, b in zip(lo, hi, strict=True)], dtype=object)})

    return run


def intervals(docs: DataFrame, window: int = WINDOW, buckets: int | None = None) -> DataFrame:
    """(doc_id, key, spans): the maximal removal intervals of each text that has any, as from, to, from, to ... in words.
    key is the text's 64-bit hash; a null doc_id is given as -1."""
    if not buckets:
        # a word of about six bytes begins a window, whose hash and place take ten
        text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(4 * partitions(docs.sparkSession), int(text_bytes * 10 / 6 / GROUP))
    blocks = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(_blocks(window, buckets), "block bigint, bucket int, hashes binary, places binary, head array<binary>")
    found = blocks.groupBy("bucket").applyInPandas(_count, "block bigint, places binary, head array<binary>")
    return found.groupBy("block").applyInPandas(_merge(window), "doc_id bigint, key bigint, spans array<int>").dropDuplicates(["doc_id", "key"])


def with_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with one more column, the last, that holds each row's spans (null: nothing goes)."""
    names = [fresh(docs, n) for n in ("removal_id", "removal_key", "removal_spans")]
    found = intervals(docs, window).toDF(*names)
    keyed = docs.withColumns({names[0]: F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), names[1]: F.xxhash64("text")})
    return keyed.join(found, names[:2], "left").select(*docs.columns, names[2])


def kept_words(text: str | None, spans: list[int] | None) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space."""
    all_words = (text or "").encode().split()
    if not spans:
        return len(all_words), 0, b" ".join(all_words)
    out, at = [], 0
    for begin, end in zip(spans[::2], spans[1::2], strict=True):
        out += all_words[at:begin]
        at = end
    out += all_words[at:]
    return len(all_words), len(all_words) - len(out), b" ".join(out)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, gone, sha = [], [], []
        for text, spans in zip(b.column(1), b.column(2), strict=True):
            x, y, kept = kept_words(text.as_py(), spans.as_py())
            n.append(x)
            gone.append(y)
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = with_spans(docs.select(F.col("doc_id").cast("long"), "text"), window)
    return rows.mapInArrow(_digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = b.schema.get_field_index("text")
        new = [t.as_py() if not s.is_valid else kept_words(t.as_py(), s.as_py())[2].decode() for t, s in zip(b.column(at), b.column(b.num_columns - 1), strict=True)]
        columns = [pa.array(new, b.schema.field(at).type) if i == at else b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1])


def apply(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with the repeated windows taken out of text (kept words joined by one space; other texts stay as they are)
    and n_chars, where there is such a column, set anew."""
    out = with_spans(docs, window).mapInArrow(_rewrite, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
