"""Words and token windows of whole Arrow batches, as numpy arrays over the UTF-8 bytes.

A word is a maximal run of bytes outside a separator table (by default the six ASCII white-space bytes). A byte span is
hashed by the sum of its 8-byte chunks, each spread over 64 bits together with its place in the span, so no structure of
the bytes cancels out. A window of k words is hashed by Rabin-Karp: the polynomial of its words' hashes modulo the prime
2**61 - 1, taken from prefix sums; two different windows agree with a chance of at most k / 2**61. Three more bits of a
window's key, and `bags` for a bucket, come from sums that do not depend on the polynomial. The working memory is about
60 bytes per byte of a slice; slices hold SLICE bytes, or one document if that alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2_000_000
U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: The prime of the window hashes, a base below it, and how many chunks of a span are hashed before long ones are set apart.
PRIME, WORD_BASE, SHORT = (1 << 61) - 1, 0x1342543DE82EF95B, 4
_tables: list[np.ndarray] = []


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**63."""
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for factors below it."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    middle = a1 * b0 + a0 * b1  # times 2**31; 2**62 is 2
    t = (a1 * b1 << U(1)) + (middle >> U(30)) + ((middle & U((1 << 30) - 1)) << U(31)) + _mod(a0 * b0)
    return _mod(t)


def _powers(n: int) -> list[np.ndarray]:
    """WORD_BASE**i and WORD_BASE**-i modulo PRIME for i < n."""
    if not _tables or len(_tables[0]) < n:
        size, out = max(1024, 1 << (n - 1).bit_length()), []
        for x in (WORD_BASE, pow(WORD_BASE, -1, PRIME)):
            a = np.ones(1, U)
            while len(a) < size:
                a = np.concatenate([a, multiply(a, U(pow(x, len(a), PRIME)))])
            out.append(a)
        _tables[:] = out
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U(shift))) * U(factor)
    return x ^ (x >> U(31))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of rows whose column holds at most `limit` bytes; null counts as empty."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + limit, "right")) - 1)
            rows = batch.slice(i, j - i)
            yield rows, *buffer(rows.column(at))
            i = j


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets from 0."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary() if binary else pa.large_string()), b"" if binary else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def spans(buf: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the number of words before it (one entry more than documents)."""
    inside = ~separators[buf]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = off[:-1][off[1:] > off[:-1]]
    begin[edge] = inside[edge]
    edge = off[1:][off[1:] > off[:-1]] - 1
    end[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, off)


class Spans:
    """Hashes of byte spans of one buffer."""

    def __init__(self, buf: np.ndarray):
        held = np.zeros(len(buf) + 8, np.uint8)
        held[: len(buf)] = buf
        self.chunk = np.ndarray(len(buf) + 1, "<u8", held, strides=(1,))  # the 8 bytes from each place on

    def _part(self, at: np.ndarray, left: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Spread chunks of which `left` bytes (1 or more) belong to the span."""
        x = self.chunk[at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - (np.minimum(left, 8) << 3).astype(U)))
        return mix(x ^ mix(np.atleast_1d(np.asarray(place, U)) + U(0x9E3779B97F4A7C15)))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        out = size.astype(U) * U(0xA24BAED4963EE407)
        some = np.flatnonzero(size > 0)
        for place in range(SHORT):
            if not len(some):
                return mix(out)
            out[some] += self._part(starts[some] + 8 * place, size[some] - 8 * place, place)
            some = some[size[some] > 8 * (place + 1)]
        if len(some):
            count = (size[some] - 8 * SHORT + 7) // 8
            before = np.cumsum(count) - count
            place = np.arange(count.sum()) - np.repeat(before, count) + SHORT
            of = np.repeat(some, count)
            out[some] += np.add.reduceat(self._part(starts[of] + 8 * place, size[of] - 8 * place, place), before)
        return mix(out)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Starts of the k-word windows that lie in one document."""
    counts = np.diff(first)
    return np.flatnonzero(np.repeat(first[1:], counts) - np.arange(first[-1]) >= k)


def bags(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each start on, whatever their order."""
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix(hashes ^ U(0x5851F42D4C957F2D)), out=total[1:])
    return mix(total[starts + k] - total[starts])


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-word windows that lie in one document, and their hashes."""
    n, starts = len(hashes), window_starts(first, k)
    power, inverse = _powers(n + 1)
    term = multiply(_mod(hashes & U((1 << 63) - 1)), power[:n])
    # sums of the lower 32 bits and of the rest, of which neither overflows
    low, high = np.zeros(n + 1, U), np.zeros(n + 1, U)
    np.cumsum(term & U(0xFFFFFFFF), out=low[1:])
    np.cumsum(term >> U(32), out=high[1:])
    low, high = (x[starts + k] - x[starts] for x in (low, high))
    sums = _mod((high >> U(29)) + ((high & U((1 << 29) - 1)) << U(32)) + low)
    return starts, mix(multiply(sums, inverse[starts]) | bags(hashes, starts, k) & U(7 << 61))


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a k-word window that begins at one of the (distinct) starts."""
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + k] -= 1
    return np.cumsum(edge[:-1]) > 0


def per_document(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive offsets."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more, the first included."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
