"""The operators against plain versions, on edge cases and on the smallest table."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute, cases
from tidemark.llm import bpe, components, kdshard, mixing, mjpeg, nearcopies, quality, simhash, substrings, toxicity, urls, wavelet, words


@pytest.fixture(scope="module")
def docs(spark):
    return cases.table(spark).persist()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# 1

def shard_checks(df, rows, n):
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts(df).items()}
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert all((r["size"], r["text_crc32"]) == want[r["doc_id"]] for r in rows)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert {r["shard"] for r in rows} <= set(range(n))


def test_shards(spark, docs, documents):
    shard_checks(docs, kdshard.shards(docs).collect(), 16)
    rows = kdshard.shards(documents).collect()
    shard_checks(documents, rows, 16)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 16
    assert len(size) == 16
    assert max(size.values()) < 1.6 * mean  # two hundred documents of up to 18 kB
    assert kdshard.shards(empty(spark)).collect() == []


def test_shards_of_target_bytes(spark):
    rows = [(i, "x" * (i % 90), None, None, 0, 0, "", "", "", None) for i in range(1000)]
    df = cases.table(spark, rows)
    assert len({r["shard"] for r in kdshard.shards(df, target_bytes=16_000).collect()}) == 3


def test_shards_of_equal_texts(spark):
    """A third of the rows are copies: sizes stay near equal, and no other text is split."""
    rows = [(i, "hot text" if i % 3 == 0 else f"text {i} " * 3, None, None, 0, 0, "", "", "", None) for i in range(3000)]
    out = kdshard.shards(cases.table(spark, rows)).collect()
    size = Counter()
    for r in out:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.05 * min(size.values())


# 2

def test_toxicity(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.score(documents, labels).collect()
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(out) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    held = [(r["score"], r["predicted"], toxic[r["doc_id"]]) for r in out if r["doc_id"] in toxic and r["held_out"]]
    pos, neg = ([s for s, _, y in held if y == k] for k in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) > 0.85
    assert np.mean([p == y for _, p, y in held]) > 0.95


def test_toxicity_edges(spark, docs):
    out = toxicity.score(docs, cases.labels(spark)).collect()
    assert len(out) == docs.count()
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[0] == by[1]  # null and empty
    none = toxicity.score(docs, cases.labels(spark, [])).collect()
    assert len(none) == len(out)
    assert toxicity.score(empty(spark), cases.labels(spark)).collect() == []
    assert [r["held_out"] for r in toxicity.score(cases.with_null_id(spark), cases.labels(spark)).filter("doc_id is null").collect()] == [None]


def test_toxicity_learns_without_held_out_labels(spark, documents, sf):
    """Labels of held-out rows change nothing."""
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.score(documents, x).collect()} for x in (labels, other))
    assert a == b


def test_votes_depend_on_one_text_alone(spark):
    """However rows are dealt to batches, a document's score stays."""
    from pyspark.sql import functions as F

    pieces = ["wow!", "!bang", "a*", "*b", "a**b", "see you there", "see you", "idiot", "idiot and moron", "you are an idiot", "", "plain text", "you", "SHOUT", "f#@k", "!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(pieces * 3)], "doc_id long, text string").repartition(1).sortWithinPartitions("doc_id")
    labels = spark.createDataFrame([(i, int(i % 16 in (7, 8, 9))) for i in range(48)], "doc_id long, toxic int")
    runs = []
    for dealt in (df, df.repartition(7, "doc_id"), df.repartition(1).sortWithinPartitions(F.desc("doc_id"))):
        runs.append({r["doc_id"]: round(r["score"], 9) for r in toxicity.score(dealt, labels).collect()})
    assert runs[0] == runs[1] == runs[2]
    grams = [("idiot", True), ("moro", False)]
    m = len(grams)
    votes = {r["doc_id"]: r["counts"] for r in toxicity.ballots(df, grams).collect()}
    for i, t in enumerate(pieces * 3):
        low = [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()]
        hit = [w == "idiot" or w.startswith("moro") for w in low]
        letters = [c for c in t if c.isascii() and c.isalpha()]
        masked = sum(t[j].isalpha() and t[j + 1] in "*#@$" and t[j + 2] in "*#@$" and t[j + 3].isalpha() for j in range(len(t) - 3))
        addressed = sum(w == "you" and any(hit[j + 1 : j + 3]) for j, w in enumerate(low))
        assert votes[i] == [low.count("idiot"), sum(w.startswith("moro") for w in low), int(2 * sum(c.isupper() for c in letters) > len(letters)), sum(t[j : j + 2] == "!!" for j in range(len(t) - 1)), masked, addressed][: m + 4]


def test_label_model(spark):
    """Expectation maximisation and the classifier against plain versions, one document at a time."""
    import itertools
    import math

    m, rng = 6, np.random.default_rng(4)
    truth = rng.random(400) < 0.3
    votes = rng.random((400, m)) < np.where(truth[:, None], 0.6, 0.1)
    votes[:, 1] |= votes[:, 0]  # two voters that copy each other
    known = [int(t) if i % 5 == 0 else None for i, t in enumerate(truth)]
    rows = [(bytearray(np.packbits(v).tobytes()), k, 1) for v, k in zip(votes, known, strict=True)]
    table = spark.createDataFrame(rows, "votes binary, toxic int, n long")
    start = toxicity.LabelModel(np.full(m, 0.5), np.full(m, 0.2), 0.2)
    got = toxicity.fit_label_model(table, m, start)
    a1, a0, base = [0.5] * m, [0.2] * m, 0.2

    def posterior(v, share):
        odds = math.log(base / (1 - base)) + sum(s * math.log((p if x else 1 - p) / (q if x else 1 - q)) for x, p, q, s in zip(v, a1, a0, share, strict=True))
        return 1 / (1 + math.exp(-odds))

    for _ in range(6):
        q = [posterior(v, [1] * m) if k is None else k for v, k in zip(votes, known, strict=True)]
        n1, n0 = sum(q), len(q) - sum(q)
        a1 = [(sum(x for x, v in zip(q, votes, strict=True) if v[j]) + 200 * 0.5) / (n1 + 200) for j in range(m)]
        a0 = [(sum(1 - x for x, v in zip(q, votes, strict=True) if v[j]) + 200 * 0.2) / (n0 + 200) for j in range(m)]
        base = n1 / len(q)
    assert got.hit1 == pytest.approx(a1) and got.hit0 == pytest.approx(a0) and got.base == pytest.approx(base)
    q = np.array([posterior(v, [1] * m) if k is None else k for v, k in zip(votes, known, strict=True)])
    shared = np.zeros((m, m))
    for w in (q, 1 - q):
        for i, j in itertools.permutations(range(m), 2):
            mi, mj = (np.average(votes[:, k], weights=w) for k in (i, j))
            r = (np.average(votes[:, i] & votes[:, j], weights=w) - mi * mj) / math.sqrt(mi * (1 - mi) * mj * (1 - mj))
            shared[i, j] = max(shared[i, j], r)
    share = 1 / (1 + np.where(shared > 0.1, shared, 0).sum(1))
    assert got.share == pytest.approx(share) and share[0] < 0.7
    assert got.posterior(votes.astype(float)) == pytest.approx([posterior(v, share) for v in votes])

    counts = votes.astype(int)
    vectors = spark.createDataFrame([(c.tolist(), 20, *r) for c, r in zip(counts, rows, strict=True)], "counts array<int>, n_words long, votes binary, toxic int, n long").repartition(3)
    w = toxicity.train_classifier(vectors, m, got)
    x, y = toxicity.inputs(counts, np.full(400, 20)), got.soft(votes.astype(float), np.array([np.nan if k is None else k for k in known]))
    slope = x.T @ (1 / (1 + np.exp(-(x @ w))) - y) + np.append(np.full(len(w) - 1, 0.5), 1e-6) * w
    assert np.abs(slope).max() < 0.05  # the optimum


# 3

def test_rake_and_sample(spark, documents):
    out = mixing.sample(documents).collect()
    cells, dims = Counter(), ("source", "lang", "topic")
    for r in out:
        cells[tuple(r[d] for d in dims)] += r["tokens"]
    total, goals = sum(cells.values()), []
    for i, d in enumerate(dims):
        m = Counter()
        for k, v in cells.items():
            m[k[i]] += v
        part = {k: v ** mixing.TEMPER[d] for k, v in m.items()}
        goals.append({k: v / sum(part.values()) * total for k, v in part.items()})
    w = brute.rake(cells, goals)
    for r in out:
        k = tuple(r[d] for d in dims)
        assert r["weight"] == pytest.approx(w[k] / cells[k], rel=1e-3)
    expected = sum(r["tokens"] * r["probability"] for r in out)
    assert expected == pytest.approx(mixing.KEEP_SHARE * total, rel=1e-6)
    kept = sum(r["tokens"] for r in out if r["kept"])
    assert 0.6 < kept / total < 0.9
    assert {r["doc_id"] for r in mixing.apply(documents).collect()} == {r["doc_id"] for r in out if r["kept"]}


def test_forms_of_texts(spark):
    texts = {"prose": [None, "", " \n ", "Plain words, and 12 more."], "numbers": ["12 34 5678", "a1b2c3", "12 of us"], "table": ["a | b | c", "x\ty"], "symbols": ["### title ###", "a=b", "<b>"], "shout": ["HEAR THIS NOW", "ÀÉ AB"]}
    rows = spark.createDataFrame([(t, k) for k, ts in texts.items() for t in ts], "text string, want string").withColumn("got", mixing.topic())
    assert [tuple(r) for r in rows.filter("not got <=> want").collect()] == []


def test_too_many_cells(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    with pytest.raises(ValueError, match="combinations"):
        mixing.sample(documents)


def test_mixing_edges(spark, docs):
    out = mixing.sample(docs).collect()
    assert len(out) == docs.count()
    assert mixing.apply(docs).columns == docs.columns
    assert mixing.sample(empty(spark)).collect() == []
    given = mixing.sample(docs, targets={"lang": {"en": 1.0}}).collect()
    assert len(given) == len(out)


def test_mixing_meets_marginals(spark, documents):
    """The expected shares, not only the weights, meet every target that the tokens allow."""
    for share in (mixing.KEEP_SHARE, 0.3, None):
        rows = mixing.report(documents, share=share).collect()
        out = mixing.sample(documents, share=share).collect()
        kept = sum(r["tokens"] * r["probability"] for r in out)
        for d in mixing.DIMS:
            mine = [r for r in rows if r["dim"] == d]
            for r in mine:
                assert r["expected"] * kept == pytest.approx(sum(x["tokens"] * x["probability"] for x in out if x[d] == r["value"]))
                if not r["reachable"]:  # all it has
                    assert share and r["expected"] * kept == pytest.approx(r["tokens"], rel=1e-4)
            low = [r for r in mine if r["reachable"] and r["expected"] * kept < r["tokens"] * (1 - 1e-4)]
            ratio = [r["expected"] / r["target"] for r in low]  # the others share the rest by their targets
            assert ratio and max(ratio) == pytest.approx(min(ratio), rel=1e-4), (share, d)
            if all(r["reachable"] for r in mine):
                assert ratio == pytest.approx([1] * len(ratio), rel=1e-4)


def test_mixing_within_bounds(spark):
    """One cell is full although every target can be met: its row and column take more from their other cells."""
    rows = [(i, "x" * 400, lang, source) for i, (lang, source) in enumerate([("a", "s")] * 5 + [("a", "t")] * 45 + [("b", "s")] * 25 + [("b", "t")] * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    options = {"share": 0.6, "targets": {"lang": {"a": 0.7, "b": 0.3}, "source": {"s": 0.35, "t": 0.65}}}
    got = {(r["dim"], r["value"]): (round(r["expected"], 4), r["reachable"]) for r in mixing.report(df, **options).collect()}
    assert got == {("lang", "a"): (0.7, True), ("lang", "b"): (0.3, True), ("source", "s"): (0.35, True), ("source", "t"): (0.65, True), ("topic", "prose"): (1.0, True)}


# 4

def test_simhash(docs, documents):
    for df in (docs, documents):
        want = brute.classes(list(texts(df).items()))
        out = simhash.classes(df).collect()
        assert len(out) == df.count()
        for r in out:
            assert (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) == want[r["doc_id"]]


def test_simhash_tiles():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    a[50:100] = a[0] ^ (np.uint64(1) << np.arange(50, dtype=np.uint64) % np.uint64(64))
    label = simhash.compare(a, a, same=True)
    near = [(i, j) for i in range(300) for j in range(i + 1, 300) if int(a[i] ^ a[j]).bit_count() <= 4]
    root = list(range(300))
    for _ in range(300):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    assert label[:300].tolist() == root


def test_simhash_edges(spark, docs):
    assert simhash.classes(empty(spark)).collect() == []
    out = simhash.classes(cases.with_null_id(spark)).filter("doc_id is null").collect()
    assert [r["component_id"] for r in out] == [None]
    kept = simhash.apply(cases.with_null_id(spark))
    want = {c for _, c in brute.classes(list(texts(docs).items())).values()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert None in ids


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (12, 10), (20, 20), (None, 5)] + [(100 + i, 101 + i) for i in range(40)]
    out = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert out == {**dict.fromkeys((1, 2, 3, 4), 1), **dict.fromkeys((10, 11, 12), 10), **dict.fromkeys(range(100, 141), 100)}


def test_edited_copies(spark):
    """Chains and groups of copies with edited words, which SimHash at four bits keeps apart."""
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(12):
        text = [f"w{x}" for x in rng.integers(0, 5000, 300)]
        for _ in range(8):
            rows.append((len(rows), " ".join(text)))
            for at in rng.integers(0, len(text), 4):
                text[at] = f"e{rng.integers(0, 5000)}"
    rows += [(len(rows) + i, t) for i, t in enumerate(["", " ", "one two", "One  two", "one three"])]
    rng.shuffle(order := list(range(len(rows))))
    rows = [(order[i], t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set(brute.jaccard(rows).values())
    by_simhash = {r["doc_id"] for r in simhash.apply(df).collect()}
    assert len(by_simhash) > len(want)
    assert {r["doc_id"] for r in nearcopies.apply(df).collect()} == want
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert {r["doc_id"] for r in stage(spark, df, "").collect()} == brute.near(rows) == want


def test_rows_of_one_doc_id(spark):
    """They are one node, which links what any of them links, and the smallest text stays."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, "b c d e f"), (3, "b c d e f"), (9, text), (9, text + " x"), (9, None), (7, "lone " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.classes(df).collect()}
    assert got == {(5, 3), (3, 3), (9, 3), (7, 7)}
    assert sorted(map(tuple, simhash.apply(df).collect())) == [(3, "b c d e f"), (7, "lone " * 9)]
    assert sorted(map(tuple, simhash.one_row_each(df).collect()), key=str) == [(3, "b c d e f"), (5, "b c d e f"), (7, "lone " * 9), (9, None)]


def test_edited_copies_tiles(spark, documents, monkeypatch):
    monkeypatch.setattr(nearcopies, "TILE", 500)
    want = brute.jaccard([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert {r["doc_id"] for r in nearcopies.apply(documents).collect()} == set(want.values())
    assert nearcopies.apply(empty(spark)).collect() == []


# 5

def test_substrings(spark, docs, documents):
    for df in (docs, documents):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        want = dict(zip([i for i, _ in rows], brute.substrings([t for _, t in rows]), strict=True))
        out = substrings.digest(df).collect()
        assert len(out) == len(rows)
        for r in out:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]


def test_substrings_over_many_blocks(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = dict(zip([i for i, _ in rows], brute.substrings([t for _, t in rows]), strict=True))
    out = substrings.digest(docs.repartition(20, "doc_id")).collect()
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in out)


def test_substrings_edges(spark, docs):
    assert substrings.digest(empty(spark)).collect() == []
    assert len(substrings.digest(cases.with_null_id(spark)).collect()) == docs.count() + 1
    out = substrings.apply(docs)
    assert out.columns == docs.columns
    changed = {r["doc_id"]: r for r in out.collect()}
    assert changed[0]["text"] is None
    assert changed[2]["text"] == " \n\t "  # nothing removed: the text stays as it is


# 6 and 8

@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe(spark, docs, documents, tokenizer):
    for df in (docs, documents):
        t = texts(df)
        out = bpe.digest(df).collect()
        assert len(out) == df.count()
        for r in out:
            ids = tokenizer.encode(t[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(empty(spark)).collect() == []


def test_bpe_composes_before_lower_case(tokenizer):
    """Capitals that compose with a mark only in lower case, alone and beside texts that look like special tokens."""
    model = bpe.encoder(bpe.default_path())
    marked = ["T\u0308est", "H\u0331 x", "W\u030aA.B,", "Y\u030a", "J\u030cabc", "ABC T\u0308", "E\u0301TE\u0301"]
    special = ["<|STARTOFTEXT|> ABC", "a<|endoftext|>B", "<|T\u0308"]
    for batch in (marked, special, marked + special, *([x] for x in marked + special)):
        flat, before = model.encode(pa.array(batch))
        for t, a, b in zip(batch, before[:-1], before[1:], strict=True):
            assert flat[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, (t, batch)


def test_bpe_trees(tokenizer):
    """Every way of cutting awkward texts, joined again, gives the encoding of the whole."""
    model = bpe.encoder(bpe.default_path())
    rng = np.random.default_rng(1)
    alphabet = list("abcdeéÉ's t,.!1 2日本\u0301ß<|>xyz\nİ")
    long = ["don't" * 40, "thereinafter" * 50, "x" * 300, "ab12" * 60, "<|startoftext|>" * 10, "e\u0301" * 100, "".join(rng.choice(alphabet, 400))]
    for text in [*long, *("".join(rng.choice(alphabet, 120)) for _ in range(60))]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        for leaf in (7, 16, 50):
            at = bpe.cuts(text, leaf)
            parts = [bpe.Part.of(model, text, a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
            got = bpe.tree(model, text, parts)
            assert got.ids.tolist() == want, (text, leaf)


MARKS = list("\u0301\u0308\u030a\u030c\u0304\u0306\u0345\u0331\u0323\u0327\u0328\u031b\u05b0\u064b\u0f71\u0f72\u3099\u09be\u0c56\u0653\u0344")
JAMO = list("\u1100\u1112\u1161\u1175\u11a8\u11c2\uac00\uac01\ud7a3")


def test_bpe_cuts_among_marks(tokenizer):
    """Marks of many classes and Hangul, joined at every place where a text may be cut; no other place is ever taken."""
    model = bpe.encoder(bpe.default_path())
    rng = np.random.default_rng(7)
    assert bpe.cuts("a" + "\u030c\u0331" * 20 + "b" * 10, 30) == [0, 41, 51]
    joined = 0
    for n in range(5000):
        letters = [*MARKS, *JAMO, *("aeouyſßÅ " if n % 2 else "a")] if n % 5 else [*MARKS, "a", "\u0915", "\u0f40"]
        text = "".join(rng.choice(letters, rng.integers(2, 40)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        for at in range(1, len(text)):
            if bpe.opens(text[at]):
                parts = [bpe.Part.of(model, text, a, b) for a, b in ((0, at), (at, len(text)))]
                assert bpe.join(model, text, *parts).ids.tolist() == want, (text, at)
                joined += 1
    assert joined > 20_000


def test_bpe_trees_of_long_marked_texts(tokenizer):
    """Parts far longer than a window, so that windows open and end among marks."""
    model = bpe.encoder(bpe.default_path())
    rng = np.random.default_rng(8)
    for n in range(40):
        letters = [MARKS + ["a", "b", " "], JAMO + ["x"], MARKS + JAMO + list("aeou yſ.,'s"), MARKS][n % 4]
        text = "".join(rng.choice(letters, 3000))
        at = bpe.cuts(text, 700)
        assert all(bpe.opens(text[x]) for x in at[1:-1])
        parts = [bpe.Part.of(model, text, a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert bpe.tree(model, text, parts).ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, n


def test_other_tokenizers():
    """A tokenizer whose tokens cross white space is not cut into pieces."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    model, plain = bpe.encoder(path), Tokenizer.from_file(path)
    text = "In  the end, all's well. " * 40 + "\n\n x=1;   y"
    flat, before = model.encode(pa.array([text, None, "a b"]))
    assert [flat[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in (text, "", "a b")]
    parts = [bpe.Part.of(model, text, a, b) for a, b in zip(bpe.cuts(text, 100)[:-1], bpe.cuts(text, 100)[1:], strict=True)]
    assert bpe.tree(model, text, parts).ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_piece_table_starts_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 50)
    model = bpe.Encoder(bpe.default_path())
    for k in range(4):
        batch = [" ".join(f"Wörd{'xyz'[i % 3] * (i % 7)}{k} ßab'{i} Éa{'q' * i}" for i in range(j, j + 9)) for j in range(0, 45, 9)]
        flat, before = model.encode(pa.array(batch))
        assert [flat[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in batch]


def test_bpe_decode(docs, tokenizer):
    t = texts(docs)
    for r in bpe.decode(bpe.encode(docs)).collect():
        assert r["decoded"] == tokenizer.decode(tokenizer.encode(t[r["doc_id"]] or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_wavelet(spark, docs, documents, tokenizer):
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    for df in (docs, documents):
        rows = sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=lambda r: r[0])
        out = wavelet.read(wavelet.write(df, shard_ids=5000)).collect()
        assert sorted(map(tuple, out), key=lambda r: r[1]) == brute.wavelet(rows, encode)
    assert wavelet.read(wavelet.write(empty(spark))).collect() == []


def test_wavelet_of_one_doc_id(spark, tokenizer):
    """Rows of one doc_id or none are dealt to several tasks and keep their order."""
    rows = [(7 if i % 3 else None, f"text {i} " * (i % 5)) for i in range(300)]
    out = sorted(wavelet.read(wavelet.write(spark.createDataFrame(rows, "doc_id long, text string"), shard_ids=100)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None] * 100 + [7] * 200
    assert [r["start"] for r in out] == np.cumsum([0, *(r["n_tokens"] for r in out)]).tolist()[:-1]
    size = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
    assert Counter(r["n_tokens"] for r in out) == Counter(size(t) for _, t in rows)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 1024, 3000])
def test_wavelet_queries(n):
    ids = np.random.default_rng(n).integers(0, 50, n).astype(np.uint32) * 977
    s = wavelet.Shard(wavelet.build([1, None], np.array([0, n // 2, n]), ids))
    assert s.ids().tolist() == ids.tolist()
    assert s.doc_ids == [1, None]
    assert sum(x.nbytes for x in s.samples) == 4 * s.n_planes * -(-n // wavelet.BLOCK)
    assert [s.access(i) for i in range(n)] == ids.tolist()
    for t in {*ids.tolist()[:20], 5}:
        assert s.locate(t) == np.flatnonzero(ids == t).tolist()
        assert s.count(t, n // 4, n // 2) == int((ids[n // 4 : n // 2] == t).sum())


# 7

def test_urls(spark, sf):
    rows = [(None, None), (1, ""), (2, "no scheme"), (3, "http://COM/x"), (4, "https://www.example.com/en/1"), (5, "http://a.www.Example.com/en/"), (6, "http://example.com/en"), (7, "http://xexample.com/en/2"), (8, "ftp://m.net/fr/?q#f"), (9, "http://net/es/a/../b"), (10, "a://b://com/"), (11, "http://example.com?/en/"), (12, "http://example.com./en/"), (13, "http://net:80/es/"), (14, "http:///en/"), (14, "http:///en/"), (15, "http://é.com/\nx"), (16, "http://com#/"), (17, "http://.com/a"), (18, "http://net/fr/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").selectExpr("*", "'c' AS host", "'c' AS path", "'c' AS key")
    for df in (pages, spark.read.parquet(f"{sf}/pages.parquet")):
        want = Counter((r["page_id"], *brute.url(r["url"])) for r in df.collect())
        assert Counter(map(tuple, urls.verdicts(df).collect())) == want
    assert urls.verdicts(pages.limit(0)).collect() == []


def test_url_nesting(spark):
    rules = [("allow", "org", "/"), ("block", "a.org", "/"), ("allow", "b.a.org", "/"), ("block", "b.a.org", "/x/"), ("allow", "a.org", "/x/y/")]
    urls_ = ["http://org/", "http://z.org/", "http://a.org/", "http://q.a.org/x/y/z", "http://b.a.org/", "http://c.b.a.org/x/", "http://b.a.org/x/y/", "http://ba.org/", "http://aorg/"]
    out = urls.verdicts(spark.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string"), rules, "none").orderBy("page_id").collect()
    assert [r["rule"] for r in out] == ["org/", "org/", "a.org/", "a.org/x/y/", "b.a.org/", "b.a.org/x/", "b.a.org/x/", "org/", None]
    assert out[-1]["verdict"] == "none"


def test_url_plan_is_native(spark, sf):
    plan = urls.verdicts(spark.read.parquet(f"{sf}/pages.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# 9

def test_media(spark, docs, documents):
    for df in (docs, documents):
        t = texts(df)
        out = mjpeg.digest(df).collect()
        assert len(out) == df.count()
        same: dict = {}
        for r in out:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == brute.media(t[r["doc_id"]])
            own = (r["media_bytes"], r["media_sha256"], r["feature"])
            assert same.setdefault(t[r["doc_id"]] or "", own) == own
    assert mjpeg.digest(empty(spark)).collect() == []


def test_frames_round_trip():
    rng = np.random.default_rng(0)
    for samples in (rng.integers(0, 256, (40, mjpeg.FRAME), dtype=np.uint8), np.full((2, mjpeg.FRAME), 255, np.uint8), np.tile(np.array([0, 255], np.uint8), (3, mjpeg.FRAME // 2))):
        frames = mjpeg.encode_frames(samples)
        assert (mjpeg.decode_frames(frames) == samples).all()
        data = mjpeg.avi(frames, 17)
        assert int.from_bytes(data[4:8], "little") == len(data) - 8
        assert mjpeg.parse(data) == (frames, 17)


def test_other_huffman_table():
    """A frame with another table: categories 0 to 8 in four bits each."""
    import struct

    lengths, symbols = bytes([0, 0, 0, 9] + [0] * 12), bytes(range(9))
    head = b"\xff\xd8" + mjpeg._segment(0xC3, struct.pack(">BHHBBBB", 8, 2, 2, 1, 1, 0x11, 0)) + mjpeg._segment(0xC4, b"\x00" + lengths + symbols) + mjpeg._segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    bits = ""
    for d in (130 - 128, 3, -5, 0):  # 130 133 / 125 125
        s = abs(d).bit_length()
        bits += f"{s:04b}" + (f"{d if d > 0 else d + (1 << s) - 1:0{s}b}" if s else "")
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    assert mjpeg.decode_frames([head + data + b"\xff\xd9"]).tolist() == [[130, 133, 125, 125]]
    with pytest.raises(ValueError):
        mjpeg.parse(b"RIFFxxxxWAVE")


def test_shots_and_clips(spark):
    still = np.full((20, mjpeg.FRAME), 40, np.uint8)
    video = np.concatenate([still, still + 120, still])
    opens = mjpeg.shots(video, np.array([0, 60]))
    assert np.flatnonzero(opens).tolist() == [0, 20, 40]
    data = mjpeg.avi(mjpeg.encode_frames(video), 1)
    out = mjpeg.clips(spark.createDataFrame([(9, bytearray(data))], "doc_id bigint, media binary")).collect()
    assert [tuple(r) for r in out] == [(9, 0, 0.0, 0.8, 20), (9, 1, 0.8, 1.6, 20), (9, 2, 1.6, 2.4, 20)]


# 10

def test_quality(spark, docs, documents, sf):
    for df, labels in ((docs, cases.labels(spark)), (documents, spark.read.parquet(f"{sf}/labels.parquet"))):
        t = texts(df)
        out = quality.judge(df, labels).collect()
        assert len(out) == df.count()
        for r in out:
            assert tuple(r[c] for c in (*quality.BASE, "base_failed")) == brute.quality(t[r["doc_id"]]), t[r["doc_id"]]
            assert not (r["base_failed"] and r["kept"])
        kept = Counter(r["doc_id"] for r in out if r["kept"])
        applied = quality.apply(df, labels)
        assert applied.columns == df.columns
        assert Counter(r["doc_id"] for r in applied.collect()) == kept


def test_quality_keeps_clean_documents(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    j = quality.judge(documents, labels).join(labels, "doc_id").filter("quality = 1 and not base_failed").collect()
    assert np.mean([r["kept"] for r in j]) >= 0.99


def test_forest_and_threshold(spark, documents, sf):
    """Path lengths row by row, the score, and the threshold by trying every bin, against plain versions."""
    import math

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stats = quality.measure(documents).persist()
    forest, threshold = quality.fit(stats, labels, trees=8, tree_rows=32)
    rows = stats.collect()
    x = np.array([[r[c] for c in quality.FEATURES] for r in rows])
    assert len(forest.trees) == 8
    norm = 2 * (math.log(31) + 0.5772156649) - 2 * 31 / 32

    def depth(tree, row):
        f, cut, left, right, leaf = tree
        at = 0
        while f[at] >= 0:
            at = left[at] if row[f[at]] <= cut[at] else right[at]
        return leaf[at]

    want = [2 ** (-sum(depth(t, row) for t in forest.trees) / 8 / norm) for row in x]
    assert forest.score(x) == pytest.approx(want)
    good = {r["doc_id"]: r["quality"] for r in labels.orderBy("doc_id", "quality").dropDuplicates(["doc_id"]).collect()}
    held = [(math.floor(s * quality.BINS), good[r["doc_id"]]) for s, r in zip(want, rows, strict=True) if r["doc_id"] in good and r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]]
    ones, zeros = sum(q for _, q in held), sum(1 - q for _, q in held)
    best, place = 0.0, None
    for b in range(quality.BINS + 1):
        lost, caught = sum(q for s, q in held if s >= b) / ones, sum(1 - q for s, q in held if s >= b) / zeros
        if lost <= 0.005 and caught - lost > best + 1e-12:
            best, place = caught - lost, b
    assert threshold == (1.1 if place is None else place / quality.BINS)
    out = {r["doc_id"]: r["kept"] for r in quality.verdicts(stats, forest, threshold).collect()}
    for s, r in zip(want, rows, strict=True):
        base = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        if abs(s - threshold) > 1e-9:
            assert out[r["doc_id"]] == (not base and s < threshold)


def test_quality_edges(spark, docs):
    assert quality.judge(empty(spark), cases.labels(spark)).collect() == []
    rows = quality.judge(docs, cases.labels(spark, [])).collect()
    assert all(r["kept"] != r["base_failed"] for r in rows)
    assert len(quality.judge(cases.with_null_id(spark), cases.labels(spark)).filter("doc_id is null").collect()) == 1


# words

def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_periodic_words(spark):
    """Words and lines on which polynomials modulo a power of two collide are told apart."""
    a, b = thue_morse(1024)
    texts_ = [" ".join([a] * 34 + ["x"]), " ".join([b] * 34 + ["x"]), f"{a}\n{b}", " ".join([a, b] * 5), " ".join((a, b)["01101001100101101001011001101001"[i] == "1"] + str(i) for i in range(32))]
    texts_ += [" ".join("ab"[int(c)] for c in bin(i)[2:].zfill(40)) for i in (0x6996966996, 0x9669699669)]
    df = spark.createDataFrame(list(enumerate(texts_)), "doc_id bigint, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.digest(df).collect()}
    assert out == dict(enumerate(brute.substrings(texts_)))
    buf, off = words.buffer(pa.array(texts_))
    s = quality.statistics(buf, off)
    for i, t in enumerate(texts_):
        assert tuple(int(s[c][i]) for c in quality.BASE) == brute.quality(t)[:-1]


def test_window_hashes_are_rabin_karp():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, words.PRIME, 5000, dtype=np.uint64) for _ in range(2))
    a[:3] = b[:3] = words.PRIME - 1
    assert words.multiply(a, b).tolist() == [int(x) * int(y) % words.PRIME for x, y in zip(a, b, strict=True)]
    h, first = rng.integers(0, 2**64, 500, dtype=np.uint64), np.array([0, 100, 100, 102, 500])
    starts, key = words.windows(h, first, 35)
    assert starts.tolist() == [*range(66), *range(102, 466)]
    poly = [sum((int(x) & (2**63 - 1)) % words.PRIME * pow(words.WORD_BASE, i, words.PRIME) for i, x in enumerate(h[s : s + 35])) % words.PRIME for s in starts]
    top = words.bags(h, starts, 35) & np.uint64(7 << 61)
    assert key.tolist() == words.mix(np.array(poly, np.uint64) | top).tolist()


def test_spans_of_any_length():
    rng = np.random.default_rng(1)
    buf = rng.integers(0, 3, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 6000)
    ends = np.minimum(4000, starts + rng.integers(0, 110, 6000))
    seen: dict = {}
    for x, y, h in zip(starts, ends, words.Spans(buf)(starts, ends).tolist(), strict=True):
        assert seen.setdefault(buf[x:y].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_windows_do_not_cross_documents():
    import pyarrow as pa

    buf, off = words.buffer(pa.array(["a b c", None, "", "c a b"]))
    starts, ends, first = words.spans(buf, off)
    assert [bytes(buf[a:b]) for a, b in zip(starts, ends, strict=True)] == [b"a", b"b", b"c", b"c", b"a", b"b"]
    assert first.tolist() == [0, 3, 3, 3, 6]
    at, key = words.windows(words.Spans(buf)(starts, ends), first, 2)
    assert at.tolist() == [0, 1, 3, 4]
    assert key[0] == key[3] and len(set(key.tolist())) == 3


def test_bpe_parts_with_white_space(tokenizer):
    """Parts whose middle is encoded by pieces: ids and held spans are those of the whole encoding."""
    model = bpe.encoder(bpe.default_path())
    rng = np.random.default_rng(2)
    syllables = ["the", "in", "er", "Éa", "don't", "x,", "42", "ß.", "日本"]
    text = " ".join("".join(rng.choice(syllables, rng.integers(1, 6))) for _ in range(2500))
    e = tokenizer.encode(text, add_special_tokens=False)
    p = bpe.Part.of(model, text, 0, len(text))
    assert p.ids.tolist() == e.ids
    assert p.head.tolist() == [list(x) for x in e.offsets[: len(p.head)]]
    assert p.tail.tolist() == [list(x) for x in e.offsets[-len(p.tail) :]]
    for leaf in (1700, 3000):
        at = bpe.cuts(text, leaf)
        parts = [bpe.Part.of(model, text, a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
        assert bpe.tree(model, text, parts).ids.tolist() == e.ids


def test_first_by_hash(spark):
    from pyspark.sql import functions as F

    from tidemark.llm.store import first_by_hash

    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    want = [r[0] for r in df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(50).collect()]
    assert [r[0] for r in first_by_hash(df, "doc_id", 50, ["doc_id"]).collect()] == want
    same = df.withColumn("doc_id", F.lit(7))
    assert first_by_hash(same, "doc_id", 50, ["doc_id"]).count() == 50
