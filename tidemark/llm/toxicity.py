"""Toxicity by weak supervision.

Voters are words of a base lexicon, word stems and words induced from labelled rows, and surface patterns. Each votes on
every document. A generative label model (two hidden classes, fitted by expectation maximisation over the counted vote
vectors of all documents) estimates each voter's accuracy in either class; pairs of voters that still correlate inside
the classes share their weight. A training row's label, where it has one, is known to the model. Its posteriors over all
training rows train a linear classifier on the voters' counts, by Newton steps whose sums are made in Spark, and that
scores every whole text.

Labels are read only from rows whose crc32(doc_id) modulo 5 is not 0. The lexicon is induced from at most
`labelled_rows` of them, the first by hash: every word or stem whose excess in toxic rows is beyond chance votes. Vote
counts, the label model and the classifier cover all rows. Labels, language, source and doc_id are no inputs of a score,
and a document's votes depend on its own text alone.

Defined results: null and empty texts get the score of a text without votes; null doc_ids are scored, never trained on
(held_out is null); repeated rows get equal scores; of several labels of a document the greatest counts; an empty table gives an empty result; without labelled rows of both
classes, the base lexicon and patterns vote alone with set accuracies.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.store import first_by_hash, keep

FOLDS = 5
#: A base lexicon of English insults.
LEXICON = ["idiot", "idiots", "moron", "morons", "stupid", "trash", "scum", "loser", "losers", "worthless", "pathetic", "disgusting", "clown", "dumb", "imbecile", "filthy", "garbage", "vermin", "degenerate", "bastard", "jerk", "ugly", "hate", "shut"]
PATTERNS = ["shouting", "exclaiming", "masked", "addressed"]
#: A voter's least number of toxic rows, least lift and least likelihood ratio (40: by chance once in 4e9 grams).
MIN_SUPPORT, MIN_LIFT, BEYOND_CHANCE, STEM = 6, 8.0, 40.0, range(3, 10)
LABELLED_ROWS, NEWTON_STEPS = 8_000, 15
_SEPARATORS = np.ones(256, bool)
_SEPARATORS[48:58] = _SEPARATORS[65:91] = _SEPARATORS[97:123] = _SEPARATORS[128:] = False
_upper, _letter, _mask, _bang = (np.zeros(256, bool) for _ in range(4))
_upper[65:91] = True
_letter[65:91] = _letter[97:123] = True
_mask[list(b"*#@$")] = True
_bang[33] = True

Gram = tuple[str, bool]  # text, and whether it is a whole word (else a stem)


def training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0


def _lowered(rows: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    return words.buffer(pa.array([(t or "").lower() for t in rows.column(at).to_pylist()], pa.large_string()))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of either label that hold a word (marked by a final space) or stem, combined in a bounded table."""
    held: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[1] for v in held.values()], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())], ["gram", "pos", "neg"])
        held.clear()
        return b

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").lower().encode().translate(_SPACED).decode()
            seen = set(raw.split(" "))
            for g in {w + " " for w in seen} | {w[:k] for w in seen for k in STEM if len(w) >= k}:
                held.setdefault(g, [0, 0])[label] += 1
            if len(held) > 400_000:
                yield out()
    yield out()


_SPACED = bytes(32 if s else i for i, s in enumerate(_SEPARATORS))


def induce(docs: DataFrame, chosen: DataFrame) -> tuple[list[Gram], np.ndarray, np.ndarray, float]:
    """The voters' words and stems, how often each hits in the chosen rows (see sample_labels) of class 1 and 0, and the
    share of class 1."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")  # bounded by sample_labels
    counts = rows.select("text", "toxic").mapInArrow(_count_grams, "gram string, pos bigint, neg bigint").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    size = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    lift = (F.col("pos") + 0.5) / (p + 1) / ((F.col("neg") + 0.5) / (n + 1))
    # twice the log likelihood ratio of different rates in the classes against one rate
    both = F.col("pos") + F.col("neg")
    term = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    ratio = 2 * (term(F.col("pos"), both * p / (p + n)) + term(F.col("neg"), both * n / (p + n)) + term(p - F.col("pos"), (p + n - both) * p / (p + n)) + term(n - F.col("neg"), (p + n - both) * n / (p + n)))
    # grams of the bounded sample, MIN_SUPPORT rows or more each
    found = counts.filter((F.col("pos") >= MIN_SUPPORT) & (lift >= MIN_LIFT) & (ratio >= BEYOND_CHANCE)).withColumn("gain", F.col("pos") * F.log(lift)).collect() if size.get(1) and size.get(0) else []
    picked: list = []
    for r in sorted(found, key=lambda r: (-r["gain"], -len(r["gram"]), r["gram"])):
        g = r["gram"]
        if not any(g.startswith(q["gram"].rstrip(" ")) or q["gram"].startswith(g.rstrip(" ")) for q in picked):
            picked.append(r)
    hits = {r["gram"]: (r["pos"], r["neg"]) for r in picked}
    for w in LEXICON:
        if not any(w.startswith(g.rstrip(" ")) for g in hits):
            hits[w + " "] = (0, 0)
    grams = [(g.rstrip(" "), g.endswith(" ")) for g in hits]
    pos, neg = (np.array([v[k] for v in hits.values()], float) for k in (0, 1))
    # words that no labelled row holds count as three hits in a hundred toxic rows to one in a thousand others
    prior = np.where(pos + neg == 0, 0.03, 0.0), np.where(pos + neg == 0, 0.001, 0.0)
    base = size.get(1, 0) / (p + n) if size.get(1) and size.get(0) else 0.05
    return grams, pos / p + prior[0], neg / n + prior[1], base


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all training rows."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("toxic")).dropna().filter(training(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    return keep(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "labels")


def sample_labels(known: DataFrame, rows: int) -> DataFrame:
    """At most `rows` of training_labels, half of them of either class where there are enough; the first by hash."""
    first = [first_by_hash(known.filter(F.col("toxic") == k), "doc_id", rows // 2, ["doc_id"]) for k in (0, 1)]
    return keep(first[0].unionByName(first[1]), "labelled")


def _runs(buf: np.ndarray, off: np.ndarray, kinds: list[np.ndarray]) -> np.ndarray:
    """Where a run of bytes of these kinds begins that lies in one document."""
    out = np.zeros(len(buf), bool)
    k = len(kinds)
    if len(buf) >= k:
        out[: len(buf) - k + 1] = np.logical_and.reduce([kind[buf[i : len(buf) - k + 1 + i]] for i, kind in enumerate(kinds)])
        for left in range(1, k):  # fewer than k bytes are left in the document
            at = off[1:] - left
            out[at[at >= 0]] = False
    return out


def _vote(grams: list[Gram]):
    whole = [(i, g.encode()) for i, (g, w) in enumerate(grams) if w]
    stems = [(i, g.encode()) for i, (g, w) in enumerate(grams) if not w]
    you = [b"you", b"your", b"du", b"tu", b"vous", b"usted"]

    def hashes(texts: list[bytes]) -> np.ndarray:
        buf, off = words.buffer(pa.array([t.decode() for t in texts], pa.large_string()))
        return words.Spans(buf)(off[:-1], off[1:])

    def matches(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are wanted, and as which."""
        order = np.argsort(wanted)
        at = np.minimum(np.searchsorted(wanted[order], keys), len(wanted) - 1)
        hit = np.flatnonzero(wanted[order][at] == keys)
        return hit, order[at[hit]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(grams)
        whole_h, you_h = hashes([g for _, g in whole]), hashes(you)
        by_size = {}
        for i, g in stems:
            by_size.setdefault(len(g), []).append((i, g))
        for rows, buf, off in words.slices(batches):
            n = rows.num_rows
            upper, letters = (words.per_document(x, off) for x in (_upper[buf], _letter[buf]))
            marks, masked = (words.per_document(x, off) for x in (_runs(buf, off, [_bang] * 2), _runs(buf, off, [_letter, _mask, _mask, _letter])))
            low, loff = _lowered(rows, 1)
            starts, ends, first = words.spans(low, loff, _SEPARATORS)
            doc = np.repeat(np.arange(n), np.diff(first))
            counts = np.zeros((n, m + len(PATTERNS)), np.int32)
            insult = np.zeros(len(starts), bool)
            span = words.Spans(low)
            full = span(starts, ends)
            if whole:
                at, which = matches(full, whole_h)
                np.add.at(counts, (doc[at], np.array([i for i, _ in whole])[which]), 1)
                insult[at] = True
            for size, own in by_size.items():
                some = np.flatnonzero(ends - starts >= size)
                at, which = matches(span(starts[some], starts[some] + size), hashes([g for _, g in own]))
                np.add.at(counts, (doc[some[at]], np.array([i for i, _ in own])[which]), 1)
                insult[some[at]] = True
            at, _ = matches(full, you_h)
            near = np.zeros(len(at), bool)
            for ahead in (1, 2):  # an insult one or two words on in the same document
                to = np.minimum(at + ahead, max(len(starts) - 1, 0))
                near |= (at + ahead < len(starts)) & (doc[to] == doc[at]) & insult[to]
            near = at[near]
            counts[:, m] = 2 * upper > letters
            counts[:, m + 1] = marks
            counts[:, m + 2] = masked
            counts[:, m + 3] = np.bincount(doc[near], minlength=n)
            hit_words = np.where(counts[:, :m].any(1), np.diff(first), 0)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * counts.shape[1], pa.int32()), pa.array(counts.ravel()))
            bits = np.packbits(counts > 0, axis=1)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(hit_words.astype(np.int64)), flat, pa.array([b.tobytes() for b in bits], pa.binary())], ["doc_id", "n_words", "counts", "votes"])

    return run


def ballots(docs: DataFrame, grams: list[Gram]) -> DataFrame:
    """doc_id, n_words (0 where no word or stem hits), counts (hits by voter) and votes (a bit by voter) of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vote(grams), "doc_id bigint, n_words bigint, counts array<int>, votes binary")


class LabelModel:
    """Accuracies (chance of a vote in class 1 and 0), class share and shared weights of correlated voters."""

    def __init__(self, hit1: np.ndarray, hit0: np.ndarray, base: float):
        self.start = np.clip(hit1, 1e-4, 0.99), np.clip(hit0, 1e-5, 0.99)
        self.hit1, self.hit0, self.base, self.share = *self.start, base, np.ones(len(hit1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on, off = np.log(self.hit1 / self.hit0), np.log((1 - self.hit1) / (1 - self.hit0))
        z = np.log(self.base / (1 - self.base)) + votes @ (self.share * (on - off)) + (self.share * off).sum()
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def soft(self, votes: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The chance of class 1: the label where it is known (not nan), else the posterior."""
        return np.where(np.isnan(known), self.posterior(votes), known)

    def moments(self, votes: np.ndarray, known: np.ndarray, weight: np.ndarray, pairs: bool) -> np.ndarray:
        """Sums by class: documents, votes and, if asked, pairs of votes."""
        q = self.soft(votes, known)
        out = []
        for w in (q * weight, (1 - q) * weight):
            out += [[w.sum()], w @ votes] + ([((votes * w[:, None]).T @ votes).ravel()] if pairs else [])
        return np.concatenate(out)


def summed(df: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of part(batch), `size` numbers at any size of df, over all of its batches; made in Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "x"])

    out = np.zeros(size)
    rows = df.mapInArrow(sums, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    out[rows["at"].to_numpy()] = rows["x"].to_numpy()
    return out


def _bits(column: pa.Array, m: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1), axis=1, count=m).astype(float)


def _known(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null is nan


def fit_label_model(patterns: DataFrame, m: int, model: LabelModel, rounds: int = 6, strength: float = 200.0) -> LabelModel:
    """Expectation maximisation over patterns(votes, toxic, n), where toxic may be null. Sums have a fixed size; the start
    values stay in as `strength` pseudo-documents of either class."""
    for step in range(rounds + 1):
        pairs = step == rounds
        total = summed(patterns, lambda b, model=model, pairs=pairs: model.moments(_bits(b.column(0), m), _known(b.column(1)), b.column(2).to_numpy(zero_copy_only=False).astype(float), pairs), (2 + 2 * m) + (2 * m * m if pairs else 0))
        half = len(total) // 2
        n1, n0, v1, v0 = total[0], total[half], total[1 : m + 1], total[half + 1 : half + m + 1]
        if not n1 + n0:
            return model
        if not pairs:
            # a new model, as the old one is still named by the tasks of its round
            new = LabelModel(model.start[0], model.start[1], float(np.clip(n1 / (n1 + n0), 0.005, 0.5)))
            new.hit1 = np.clip((v1 + strength * model.start[0]) / (n1 + strength), 1e-4, 0.99)
            new.hit0 = np.clip((v0 + strength * model.start[1]) / (n0 + strength), 1e-6, 0.99)
            model = new
        else:
            shared = np.zeros((m, m))
            for n, v, pair in ((n1, v1, total[m + 1 : half]), (n0, v0, total[half + m + 1 :])):
                mean = v / max(n, 1e-9)
                cov = pair.reshape(m, m) / max(n, 1e-9) - np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                shared = np.maximum(shared, np.where(n > 50, cov / np.outer(sd, sd), 0))
            np.fill_diagonal(shared, 0)
            model.share = 1 / (1 + np.where(shared > 0.1, shared, 0).sum(1))
    return model


def inputs(counts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """The classifier's inputs: each voter's count, the number of voters that hit, all hits and their density."""
    lexical = counts[:, : -len(PATTERNS)]
    hits = lexical.sum(1)
    return np.column_stack([np.log1p(counts), (lexical > 0).sum(1), np.log1p(hits), np.minimum(50.0, 100.0 * hits / np.maximum(n_words, 1)), np.ones(len(counts))])


def slopes(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient and Hessian of the logistic loss of soft labels y, in a row."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.concatenate([x.T @ (weight * (p - y)), ((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x).ravel()])


def train_classifier(vectors: DataFrame, m: int, model: LabelModel, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression on the model's posteriors over vectors(counts, n_words, votes, toxic, n), by Newton steps."""
    d = m + 4
    w, penalty = np.zeros(d), np.append(np.full(d - 1, ridge), 1e-6)
    for _ in range(NEWTON_STEPS):

        def part(b: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            return slopes(w, inputs(_counts(b.column(0), m), b.column(1).to_numpy(zero_copy_only=False)), model.soft(_bits(b.column(2), m), _known(b.column(3))), b.column(4).to_numpy(zero_copy_only=False).astype(float))

        total = summed(vectors, part, d + d * d)
        if not total.any():
            break
        step = np.clip(np.linalg.solve(total[d:].reshape(d, d) + np.diag(penalty), total[:d] + penalty * w), -4, 4)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


def _counts(column: pa.Array, m: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, m).astype(np.int64)


def score(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    known = training_labels(labels)
    grams, hit1, hit0, base = induce(docs, sample_labels(known, labelled_rows))
    m = len(grams) + len(PATTERNS)
    table = keep(ballots(docs, grams), "ballots")
    vectors = keep(table.join(known, "doc_id", "left").groupBy("counts", "n_words", "votes", "toxic", F.coalesce(training(F.col("doc_id")), F.lit(False)).alias("training")).agg(F.count("*").alias("n")), "vote-vectors")
    start = LabelModel(np.append(hit1, [0.1, 0.1, 0.02, 0.02]), np.append(hit0, [0.08, 0.08, 0.01, 0.002]), min(max(base, 0.01), 0.3))
    model = fit_label_model(vectors.groupBy("votes", "toxic").agg(F.sum("n").alias("n")), m, start)
    weights = train_classifier(vectors.filter("training").select("counts", "n_words", "votes", "toxic", "n"), m, model)
    shared = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = inputs(_counts(b.column(2), m), b.column(1).to_numpy(zero_copy_only=False)) @ shared.value
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            ids = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else zlib.crc32(str(i).encode()) % FOLDS == 0 for i in ids], pa.bool_()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return table.select("doc_id", "n_words", "counts").mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
