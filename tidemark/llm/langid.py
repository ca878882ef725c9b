"""Language identification with a string kernel.

Two texts are compared by their blended spectra: the sets of n-grams of 1 to ORDERS bytes of the lower-cased text that they
hold at all. The kernel is the number of shared n-grams over the geometric mean of both texts' numbers. A bounded number of
training texts are landmarks (Nyström); a text is its row of kernel values with them. One-versus-rest kernel ridge
regression on these rows gives a value for each language; its normal equations are sums over all training rows, made in
Spark. Rows are scored in batches: presences times landmarks, then kernel values times coefficients.

An n-gram is known by a number of 24 bits, exact up to three bytes and hashed for four. Whole texts count. Learned are text
and lang of rows whose crc32(doc_id) modulo 4 is not 2; lang, source and doc_id are no inputs of a prediction. Every
training row takes part in the regression. Landmarks are at most LANDMARKS distinct texts, as many of each language, the
first by hash; among the SPARE times as many texts of the smallest hashes, those of LANDMARK_BYTES are preferred. Languages
are counted equally in the regression, whatever their shares.

Defined results: a null text, or one without a letter, is `und` with score 0, as is every text where no row can be learned
from; a null doc_id is predicted, never learned from (held_out is null); repeated rows get equal results; of equal values
the alphabetically first language wins; an empty table gives an empty result; other columns are ignored. More than
MAX_LANGUAGES values of lang raise an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm import words
from tidemark.llm.store import keep
from tidemark.llm.toxicity import summed

ORDERS, BITS = 4, 24
#: The first number of each order's n-grams: 256 of one byte, 65,536 of two, the rest of three and four.
FROM = [0, 256, 256 + 65_536, 256 + 65_536 + (1 << BITS), 256 + 65_536 + (2 << BITS)]
FOLDS, HELD_OUT, UNDETERMINED = 4, 2, "und"
LANDMARKS, LANDMARK_BYTES, MAX_LANGUAGES, SPARE = 160, (300, 20_000), 512, 16
RIDGE, BATCH = 1e-4, 128
U = np.uint32


def training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != HELD_OUT


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each document as numbers below FROM[-1] in a row, and where each document's begin."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(off)) << (BITS + 2)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(buf))
    parts, gram = [], np.zeros(len(buf), U)
    for order in range(1, ORDERS + 1):
        m = len(buf) - order + 1
        if m < 1:
            break
        gram = (gram[:m] << U(8)) | buf[order - 1 :]
        number = gram if order < 4 else (gram * U(0x9E3779B1)) >> U(32 - BITS)
        inside = left[:m] >= order
        parts.append(_distinct((doc[:m] + (number + U(FROM[order - 1])))[inside]))
    # each order's numbers are sorted; a document's are brought together
    every = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return every & ((1 << (BITS + 2)) - 1), np.searchsorted(every, np.arange(n + 1, dtype=np.int64) << (BITS + 2))


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with the distinct n-grams of their texts."""
    for rows, _, _ in words.slices(batches, column):
        text = pc.utf8_lower(pc.fill_null(rows.column(rows.schema.get_field_index(column)), ""))
        yield rows, *grams(*words.buffer(text))


class Landmarks:
    """The landmark texts' n-grams: a sorted list of all, and which landmark holds which."""

    def __init__(self, held: list[np.ndarray]):
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *held]))
        self.held = np.zeros((len(self.known), len(held)), bool)
        for j, g in enumerate(held):
            self.held[np.searchsorted(self.known, g), j] = True
        self.size = np.array([len(g) for g in held], float)
        self.table: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.known, np.packbits(self.held, axis=1), self.held.shape[1], self.size

    def __setstate__(self, state: tuple) -> None:
        self.known, bits, m, self.size = state
        self.held, self.table = np.unpackbits(bits, axis=1, count=m).astype(bool), None

    def kernel(self, every: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Kernel values of documents (their n-grams in a row, and where each begins) with the landmarks."""
        if self.table is None:
            self.table = np.full(FROM[-1], -1, np.int32)
            self.table[self.known] = np.arange(len(self.known))
            self.floats = self.held.astype(np.float32)
        n = len(first) - 1
        out = np.zeros((n, len(self.size)), np.float32)
        for a in range(0, n, BATCH):
            b = min(n, a + BATCH)
            size = np.diff(first[a : b + 1])
            at = self.table[every[first[a] : first[b]]]
            hit = at >= 0
            present = np.zeros((b - a, len(self.known)), np.float32)
            present[np.repeat(np.arange(b - a), size)[hit], at[hit]] = 1
            out[a:b] = (present @ self.floats) / np.sqrt(np.maximum(size, 1)[:, None] * np.maximum(self.size, 1))
        return out


def learnable(docs: DataFrame) -> DataFrame:
    """text and lang of the rows to learn from."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))


def choose_landmarks(known: DataFrame, languages: list[str], most: int) -> Landmarks:
    """At most `most` landmarks (one a language at least), the first by hash of each language's preferred texts."""
    each = max(1, most // max(1, len(languages)))
    known = known.withColumn("hash", F.xxhash64("text"))
    fit = F.octet_length("text").between(*LANDMARK_BYTES)
    once = keep(known.groupBy("lang", "hash").agg(F.min("doc_id").alias("doc_id"), F.min((~fit).cast("int")).alias("unfit")), "distinct-texts")  # equal texts count once
    # a bound on the hash leaves SPARE times as many texts a language as are asked for, so no task ranks all of them
    low = {r["lang"]: -(1 << 63) + int((1 << 64) * min(1.0, SPARE * each / r["n"])) - 1 for r in once.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    bound = F.create_map(*(F.lit(x) for pair in low.items() for x in pair))[F.col("lang")] if low else F.lit(None).cast("long")
    ranked = once.filter(F.col("hash") <= bound).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("unfit", "hash"))).filter(F.col("rank") <= each)
    chosen = keep(ranked.select("lang", "doc_id", "hash", "rank"), "landmarks")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, every, first in _batches(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.split(every, first[1:-1]), pa.list_(pa.int64()))], ["lang", "rank", "grams"])

    texts = known.join(F.broadcast(chosen), ["lang", "doc_id", "hash"]).dropDuplicates(["lang", "rank"])  # bounded by `most`
    rows = texts.select("lang", "rank", "text").mapInArrow(held, "lang string, rank int, grams array<bigint>").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending")])
    return Landmarks([np.array(g, np.int64) for g in rows["grams"].to_pylist()])


def kernel_rows(docs: DataFrame, landmarks: Landmarks) -> DataFrame:
    """doc_id, lang, whether the text has a letter, and its kernel values (32-bit floats) with the landmarks."""
    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, every, first in _batches(batches):
            k = shared.value.kernel(every, first)
            letters = pc.fill_null(pc.match_substring_regex(rows.column(2), r"\p{L}"), False)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), letters, pa.array([r.tobytes() for r in k], pa.binary())], ["doc_id", "lang", "letters", "k"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, lang string, letters boolean, k binary")


def _matrix(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), m).astype(float)


def fit(rows: DataFrame, languages: dict[str, int], between: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients of one-versus-rest kernel ridge regression on rows(lang, k): for each language the minimum of
    |k c - y|^2 + ridge n c' K c, where K are the landmarks' kernel values with each other and each language weighs as much
    in all. languages: the number of rows of each."""
    m, names = len(between), sorted(languages)
    at = {x: i for i, x in enumerate(names)}
    weight = {x: 1 / n for x, n in languages.items()}
    upper = np.triu_indices(m)

    def part(b: pa.RecordBatch) -> np.ndarray:
        langs = b.column(0).to_pylist()
        k, w = _matrix(b.column(1), m), np.array([weight[x] for x in langs])
        y = np.zeros((len(langs), len(names)))
        y[np.arange(len(langs)), [at[x] for x in langs]] = 1
        weighed = k * w[:, None]
        return np.concatenate([(k.T @ weighed)[upper], (weighed.T @ y).ravel()])

    total = summed(rows.select("lang", "k"), part, len(upper[0]) + m * len(names))
    kk = np.zeros((m, m))
    kk[upper] = total[: len(upper[0])]
    kk = kk + np.triu(kk, 1).T
    return np.linalg.solve(kk + ridge * len(names) * (between + 1e-6 * np.eye(m)), total[len(upper[0]) :].reshape(m, -1))


def predict(docs: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. score is the share that the winning language's value has in
    the sum of all values, each taken between 0 and 1."""
    known = learnable(docs)
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    names = sorted(counts)
    chosen = choose_landmarks(known, names, landmarks)
    m = len(chosen.size)
    rows = keep(kernel_rows(docs, chosen), "kernel-rows")
    between = (chosen.held.T.astype(float) @ chosen.held) / np.sqrt(np.outer(chosen.size, chosen.size))
    taught = rows.filter(training(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("letters") & F.col("lang").isin(names))
    c = fit(taught, counts, between) if names else np.zeros((0, 0))
    shared = docs.sparkSession.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, letters = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            value = np.clip(_matrix(b.column(2), m) @ shared.value, 0, 1) if names else np.zeros((len(ids), 1))
            best = value.argmax(1) if len(ids) else np.zeros(0, np.int64)
            total = value.sum(1)
            score = np.where(letters & (total > 0), value.max(1, initial=0) / np.maximum(total, 1e-12), 0.0)
            said = [names[i] if ok and names else UNDETERMINED for i, ok in zip(best, letters, strict=True)]
            held = [None if i is None else zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.bool_()), pa.array(said, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.select("doc_id", "letters", "k").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
