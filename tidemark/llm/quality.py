"""Quality rules: an isolation forest over rule statistics, with its threshold calibrated from labelled rows.

Rules give each document a few statistics. The forest isolates documents by random splits; documents with short path
lengths are anomalous. Which path length rejects is read from all labelled rows: the threshold that separates quality 0
from quality 1 best among those that reject at most `max_clean_loss` of the rows labelled 1.

Defined results: null text counts as empty (no words, so it fails the base rules); null doc_ids stay and get a verdict;
repeated rows give equal rows; of several labels of a document the lowest counts; an empty table gives an empty result; without labelled rows of both classes the forest
rejects nothing. Other columns of the input are ignored, except by `apply`, which returns them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.store import first_by_hash, keep

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: The symbols of the base rule.
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "stop_share"]
STATS = ", ".join([f"{c} bigint" for c in BASE] + [f"{c} double" for c in FEATURES])
_symbol, _upper, _mark, _digit, _tail = (np.zeros(256, bool) for _ in range(5))
_symbol[list(SYMBOLS.encode())] = True
_upper[65:91] = True
_mark[list(b"!?.,;:-'\"()[]{}/\\@^_~=+`")] = True
_digit[48:58] = True
_tail[128:192] = True  # bytes that continue a character


def statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """BASE and FEATURES for the documents of one slice."""
    starts, ends, first = words.spans(buf, off)
    n = np.diff(first)
    span = words.Spans(buf)
    hashes = span(starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    sum_of = lambda table: words.per_document(table[buf], off)
    spaces, tails = sum_of(words.SPACES), sum_of(_tail)
    size = np.diff(off)

    at, key = words.windows(hashes, first, REPEAT_WINDOW)
    again = at[words.repeated(key ^ words.mix(doc[at] + 1))]
    repeat = words.per_document(words.covered(again, REPEAT_WINDOW, len(hashes)), first)

    distinct = hashes ^ words.mix(doc + 1)
    order = np.argsort(distinct)
    new = np.ones(len(order), bool)
    new[1:] = distinct[order[1:]] != distinct[order[:-1]]
    distinct_of = np.bincount(doc[order[new]], minlength=len(n))

    breaks = np.flatnonzero(buf == 10)
    line_starts = np.union1d(off[:-1][size > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(buf)]
    of = np.searchsorted(off, line_starts, "right") - 1
    nexts = np.minimum(np.append(line_starts[1:], len(buf)), off[of + 1])
    line_ends = nexts - (buf[nexts - 1] == 10) if len(nexts) else nexts
    ink = np.concatenate([[0], np.cumsum(~words.SPACES[buf])])
    full = np.flatnonzero(ink[line_ends] > ink[line_starts])
    of = of[full]
    lines = span(line_starts[full], line_ends[full]) ^ words.mix(of + 1)
    kept = np.unique(lines, return_index=True)[1]
    n_lines = np.bincount(of, minlength=len(n))
    dup_lines = n_lines - np.bincount(of[kept], minlength=len(n))

    short = words.per_document((ends - starts) <= 3, first)
    word_chars, symbols = size - spaces - tails, sum_of(_symbol)
    some, ink_of = np.maximum(n, 1), np.maximum(word_chars, 1)
    return {
        "n_words": n, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "log_words": np.log1p(n), "word_length": np.minimum(word_chars / some, 100.0), "symbol_share": symbols / ink_of, "dup_line_share": dup_lines / np.maximum(n_lines, 1), "repeat_share": repeat / some,
        "upper_share": sum_of(_upper) / ink_of, "mark_share": sum_of(_mark) / ink_of, "digit_share": sum_of(_digit) / ink_of, "distinct_share": distinct_of / some, "stop_share": short / some,
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in words.slices(batches):
        s = statistics(buf, off)
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(s[c].astype(np.int64)) for c in BASE), *(pa.array(s[c].astype(float)) for c in FEATURES)], ["doc_id", *BASE, *FEATURES])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(_measure, f"doc_id bigint, {STATS}")


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def grow_tree(x: np.ndarray, seed: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, cut, left, right, path length of a leaf) of one isolation tree over the rows of x."""
    rng, nodes = np.random.default_rng(seed), []
    limit = int(np.ceil(np.log2(max(2, len(x)))))

    def expected(n: int) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + expected(len(rows))))
        low, high = rows.min(0), rows.max(0)
        wide = np.flatnonzero(high > low)
        if depth < limit and len(wide):
            f = int(rng.choice(wide))
            cut = float(rng.uniform(low[f], high[f]))
            left = rows[:, f] <= cut
            if left.any() and not left.all():
                nodes[me] = (f, cut, grow(rows[left], depth + 1), grow(rows[~left], depth + 1), 0.0)
        return me

    grow(x, 0)
    return nodes


def _fit_tree(rows: pd.DataFrame) -> pd.DataFrame:
    tree = int(rows["tree"].iloc[0])
    x = rows.sort_values(["order", "doc_id", *FEATURES])[FEATURES].to_numpy()
    f, cut, left, right, leaf = zip(*grow_tree(x, tree), strict=True)
    return pd.DataFrame({"tree": [tree], "f": [list(f)], "cut": [list(cut)], "l": [list(left)], "r": [list(right)], "leaf": [list(leaf)]})


class Forest:
    def __init__(self, trees: list, size: int):
        self.trees = [tuple(np.array(x) for x in (t["f"], t["cut"], t["l"], t["r"], t["leaf"])) for t in trees]
        self.norm = max(1e-9, 2 * (np.log(max(size, 2) - 1 + 1e-9) + 0.5772156649) - 2 * (max(size, 2) - 1) / max(size, 2))

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 to the power of minus the mean path length over its expectation: near 1 is anomalous."""
        total = np.zeros(len(x))
        for f, cut, left, right, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            rows = np.arange(len(x))
            while len(rows):
                node = at[rows]
                rows, node = (a[f[node] >= 0] for a in (rows, node))
                at[rows] = np.where(x[rows, f[node]] <= cut[node], left[node], right[node])
            total += leaf[at]
        return 2.0 ** (-total / max(len(self.trees), 1) / self.norm) if self.trees else np.zeros(len(x))


BINS = 2000


def fit(stats: DataFrame, labels: DataFrame, trees: int = 64, tree_rows: int = 256, max_clean_loss: float = 0.005) -> tuple[Forest, float]:
    """The forest and its threshold. Each tree takes its own tree_rows documents, the first by hash (the subsample that
    the method prescribes, so trees * tree_rows rows at any size); one Spark task grows one tree. The threshold comes
    from a histogram of the scores of all labelled rows."""
    spark = stats.sparkSession
    chosen = first_by_hash(stats, "doc_id", trees * tree_rows, ["doc_id", *FEATURES]).withColumn("order", F.xxhash64("doc_id"))
    grown = chosen.withColumn("tree", F.pmod(F.xxhash64("order", F.lit(7)), F.lit(trees))).groupBy("tree").applyInPandas(_fit_tree, "tree int, f array<int>, cut array<double>, l array<int>, r array<int>, leaf array<double>")
    forest = Forest(sorted(grown.collect(), key=lambda t: t["tree"]), tree_rows)
    if not forest.trees:
        return forest, 1.1
    labelled = stats.filter(~base_failed()).join(labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id")
    scored = labelled.select("doc_id", "quality", *FEATURES).mapInArrow(_scorer(spark, forest, ["doc_id", "quality"]), "doc_id bigint, quality int, anomaly double")
    rows = scored.groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")).agg(F.sum("quality").alias("good"), F.count("*").alias("n")).collect()
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in rows:
        good[r["bin"]] += r["good"]
        bad[r["bin"]] += r["n"] - r["good"]
    if not good.sum() or not bad.sum():
        return forest, 1.1
    lost, caught = np.cumsum(good[::-1])[::-1] / good.sum(), np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(lost <= max_clean_loss, caught - lost, -1)
    best = int(np.argmax(gain))
    return forest, best / BINS if gain[best] > 0 else 1.1


def _scorer(spark, forest: Forest, names: list[str]):
    shared = spark.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in FEATURES])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(shared.value.score(x))], [*names, "anomaly"])

    return run


def verdicts(stats: DataFrame, forest: Forest, threshold: float) -> DataFrame:
    """The statistics with base_failed, anomaly and kept."""
    names = [c for c in stats.columns if c not in FEATURES]
    schema = ", ".join(f"{c} {dict(stats.dtypes)[c]}" for c in names)
    scored = stats.mapInArrow(_scorer(stats.sparkSession, forest, names), f"{schema}, anomaly double")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base statistics, base_failed, anomaly and kept of every document."""
    stats = keep(measure(docs), "quality-stats")
    return verdicts(stats, *fit(stats, labels))


def apply(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns. The model is fitted on all rows first; the second pass
    judges each row where it lies, so no text is shuffled."""
    stats = keep(measure(docs), "quality-stats")
    forest, threshold = fit(stats, labels)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in words.slices(batches):
            s = statistics(buf, off)
            bad = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])
            good = ~bad & (shared.value.score(np.column_stack([s[c] for c in FEATURES])) < threshold)
            yield rows.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
