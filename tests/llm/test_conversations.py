"""Prefix trie, role repair and language identification against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm import cases
from tidemark.llm import langid, prefixtrie, rolerepair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, k1 int, gone string, size string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def talks():
    """Null ids, turns, roles and texts, copies, shared starts, repeated rows, one very long conversation, negative ids."""
    rng = random.Random(3)
    rows = [(None, 0, "user", "no id"), (1, None, "user", "null turn."), (1, 0, None, "null role."), (1, 1, "assistant", None), (2, 0, "", ""), (3, 0, "tool", "x"), (3, 0, "tool", "x"), (-7, 0, "user", "a."), (-5, 0, "user", "a."), (9, 5, "system", " \n\t "), (9, 2, "user", "Late!  "), (2**40, 0, "user", "far.")]
    for c in range(10, 150):
        same = c % 3 == 0
        for t in range(rng.randrange(1, 8) if not same else 5):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]) if not same and rng.random() < 0.3 else "ua"[t % 2] + "x"
            rows.append((c, t + rng.randrange(2), role, f"same {t}." if same or rng.random() < 0.4 else rng.choice(["yes.", "no", "É ok?", "", " ", f"own {c} {t}."])))
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"long {t % 90}.") for t in range(700)]
    return rows


def crc(x):
    return zlib.crc32(str(x).encode())


def by_conversation(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn is not None, turn or 0, role or "", len((text or "").encode()), text or ""))
    return out


def plain_trie(rows):
    own = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in by_conversation(rows).items() if c is not None}
    built = {}
    for c, turns in own.items():
        h, block = crc(c) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(block, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("shard", [1, 3, 10_000])
def test_trie(spark, shard):
    rows = talks()
    assert got(prefixtrie.nodes(table(spark, rows), shard), TRIE) == plain_trie(rows)


def test_trie_of_several_partitions(spark):
    rows = talks()
    convs = prefixtrie.rebuilt(table(spark, rows))
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert got(prefixtrie.trie(convs, 2), TRIE) == plain_trie(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_trie_edges(spark):
    assert prefixtrie.nodes(table(spark, [])).count() == 0
    assert prefixtrie.nodes(table(spark, [(None, 0, "user", "x")])).count() == 0
    # conversation 6 takes crc % 9 turns from conversation 5, which is absent
    one = got(prefixtrie.nodes(table(spark, [(6, 0, "user", "x")])), TRIE)
    assert one == plain_trie([(6, 0, "user", "x")]) and one[0][1] == 0


def test_trie_over_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(prefixtrie.nodes(spark.read.parquet(f"{sf}/conversations.parquet")), TRIE) == plain_trie(rows)


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    """Every sequence is found, no slot has two parents, and the array stays near the size of the trie."""
    rng = np.random.default_rng(seed)
    symbols = [3, 40, 4000, 50, 5, 20_000][seed]
    seqs = sorted({tuple(rng.integers(0, symbols, rng.integers(0, 9)).tolist()) for _ in range(1500)})
    turns = pa.array([[{"k1": x // 7 - 3, "k2": x % 7, "size": x} for x in s] for s in seqs], prefixtrie._TURNS_TYPE)
    seqs_sorted = sorted(range(len(seqs)), key=lambda i: [(x // 7 - 3, x % 7) for x in seqs[i]])
    rows = prefixtrie.Sequences(turns.take(pa.array(seqs_sorted)))
    trie = prefixtrie.DoubleArray(rows.keys(), rows.off)
    nodes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert (trie.check[: trie.top] >= 0).sum() == len(nodes) - 1
    assert trie.top <= 2 * len(nodes) + 2 * len(trie.dense) + 64
    found = {}
    for i, key in enumerate(np.split(rows.keys(), rows.off[1:-1])):
        slot = np.zeros(1, np.int64)
        for d, k in enumerate(key):
            slot = trie.step(slot, np.array([k]))
            assert found.setdefault(int(slot[0]), tuple(key[: d + 1])) == tuple(key[: d + 1])
    with pytest.raises((ValueError, IndexError)):
        trie.step(np.zeros(len(trie.dense), np.int64) + trie.top - 1, np.arange(len(trie.dense)))


def cheapest(roles, must_go, cut):
    """The least (cost, audit) of all ways to edit these rows, by trying every one."""
    out = []

    def go(i, made, cost, audit):
        if not re.fullmatch("(s?(ua)*u?)?|s", made):
            return
        if i == len(roles):
            if re.fullmatch("(s?(ua)+)?", made):
                out.append((cost, audit, made))
        else:
            more = 5 if cut[i] else 0
            go(i + 1, made, cost + 2, audit + "D")
            if not must_go[i]:
                go(i + 1, made + roles[i], cost + more, audit + "K")
                go(i + 1, made + "u", cost + 1 + more, audit + "R")
                go(i + 1, made + "a", cost + 1 + more, audit + "R")
        if not audit.endswith("III"):
            go(i, made + "u", cost + 5, audit + "I")
            go(i, made + "a", cost + 5, audit + "I")

    go(0, "", 0, "")
    return min(out)[:2]


def test_cheapest_edits():
    rng = random.Random(1)
    for n in range(5):
        for _ in range(60 if n else 1):
            roles = [rng.choice("suauax") for _ in range(n)]
            must_go, cut = ([rng.random() < p for _ in range(n)] for p in (0.2, 0.4))
            parse = rolerepair.Parse()
            settled = ""
            for r, g, c in zip(roles, must_go, cut, strict=True):
                parse.row(r, g, c)
                settled += parse.settled()
            cost, audit = parse.best()
            assert (cost, settled + audit) == cheapest(roles, must_go, cut), (roles, must_go, cut)


def plain_repair(rows):
    """Each conversation damaged and repaired with the whole audits of four states in hand."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        code = crc(f"{' ' if c is None else c}:{' ' if turn is None else turn}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        convs[c] += [(turn is not None, turn or 0, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for c, v in convs.items():
        v.sort()
        turns = [t for ok, t, _, _ in v if ok]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, blank, dup, cut = set(), [], [], []
        for _, _, role, text in v:
            words = re.sub("[\x20\x09-\x0d]+$", "", text)
            blank.append(not words)
            dup.append((role, text) in seen and not blank[-1])
            cut.append(not blank[-1] and (role, text) not in seen and words[-1] not in ".!?")
            seen.add((role, text))
        first = [role[:1] for _, _, role, _ in v]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(first))
        best = {"": (0, "", "")}
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

        def closed(states):
            for _ in range(3):
                for s, (cost, audit, text) in list(states.items()):
                    for x, role in (("u", "user"), ("a", "assistant")):
                        if (s, x) in step:
                            new = (cost + 5, audit + "I", text + "\n" * (s != "") + role + ":")
                            states[step[s, x]] = min(states.get(step[s, x], new), new)
            return states

        best = closed(best)
        for (_, _, role, text), b, d, t in zip(v, blank, dup, cut, strict=True):
            new = {}
            for s, (cost, audit, made) in best.items():
                ways = [(s, cost + 2, "D", made)]
                if not b and not d:
                    for x, name, price, edit in ((role[:1], role, 0, "K"), ("u", "user", 1, "R"), ("a", "assistant", 1, "R")):
                        if (s, x) in step:
                            ways.append((step[s, x], cost + price + 5 * t, edit, made + "\n" * (s != "") + name + ":" + text))
                for to, price, edit, made_to in ways:
                    new[to] = min(new.get(to, (10**9,)), (price, audit + edit, made_to))
            best = closed(new)
        cost, audit, text = min(best[s] for s in ("", "a") if s in best)
        out.append((c, gaps, sum(blank), sum(dup), sum(cut), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_repair(spark):
    rows = talks()
    want = plain_repair(rows)
    # deleting a row is cheaper than an insertion everywhere in these rows; test_cheapest_edits tries insertions too
    assert {"K", "R", "D"} == set("".join(r[7] for r in want))
    assert got(rolerepair.repaired(table(spark, rows)), REPAIR) == want


def test_repair_edges(spark):
    assert rolerepair.repaired(table(spark, [])).count() == 0
    lost = next(c for c in range(100) if crc(f"{c}:0") % 20 == 0)
    assert got(rolerepair.repaired(table(spark, [(lost, 0, "user", "gone.")])), REPAIR) == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repair_over_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(rolerepair.repaired(spark.read.parquet(f"{sf}/conversations.parquet")), REPAIR) == plain_repair(rows)


@pytest.mark.parametrize("name", ["prefixtrie", "rolerepair"])
def test_sql_over_edge_cases(spark, name):
    module, columns = {"prefixtrie": (prefixtrie, TRIE), "rolerepair": (rolerepair, REPAIR)}[name]
    rows = [r for r in talks() if r[0] != 500]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({module.ORACLE})").fetchall()
    f = prefixtrie.nodes if name == "prefixtrie" else rolerepair.repaired
    assert got(f(table(spark, rows)), columns) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_grams():
    texts = ["", "a", "abcabc", "ÉÉ", "x" * 50, "a b"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *(len(t.encode()) for t in texts)])
    every, first = langid.grams(buf, off)

    def number(g):
        x = int.from_bytes(g, "big")
        return langid.FROM[len(g) - 1] + (x if len(g) < 4 else (x * 0x9E3779B1 % 2**32) >> 8)

    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        raw = t.encode()
        assert every[a:b].tolist() == sorted({number(raw[i : i + n]) for n in range(1, 5) for i in range(len(raw) - n + 1)})


def plain_kernel(a, b):
    grams = [{(n, t.lower().encode()[i : i + n]) for n in range(1, 5) for i in range(len(t.lower().encode()) - n + 1)} for t in (a, b)]
    return len(grams[0] & grams[1]) / max(1, len(grams[0]) * len(grams[1])) ** 0.5


def test_kernel_and_regression(spark):
    """Kernel values, coefficients and predictions against plain sums and a plain solution."""
    rng = random.Random(4)
    parts = {"de": ["sch", "ung", "ei", "ch"], "en": ["the", "ing", "on", "sh"], "fr": ["eau", "oi", "ré", "que"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(40)), lang) for i, lang in enumerate(rng.choices(list(parts), [1, 4, 2], k=90))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    known = langid.learnable(docs)
    counts = Counter(lang for i, _, lang in rows if crc(i) % 4 != 2)
    marks = langid.choose_landmarks(known, sorted(counts), 12)
    assert len(marks.size) == 12
    found = {r["doc_id"]: np.frombuffer(r["k"], np.float32) for r in langid.kernel_rows(docs, marks).collect()}
    texts = {}
    for j in range(12):  # each landmark is the row whose kernel value with it is 1
        texts[j] = next(t for i, t, _ in rows if found[i][j] > 0.99999)
    k = {i: np.array([plain_kernel(t, texts[j]) for j in range(12)]) for i, t, _ in rows}
    assert all(np.abs(k[i] - found[i]).max() < 1e-5 for i in k)
    taught = [(k[i], lang) for i, _, lang in rows if crc(i) % 4 != 2]
    x, w = np.array([t[0] for t in taught]), np.array([1 / counts[t[1]] for t in taught])
    y = np.array([[t[1] == n for n in sorted(counts)] for t in taught], float)
    between = np.array([[plain_kernel(texts[a], texts[b]) for b in range(12)] for a in range(12)])
    c = np.linalg.solve((x.T * w) @ x + langid.RIDGE * 3 * (between + 1e-6 * np.eye(12)), (x.T * w) @ y)
    for r in langid.predict(docs, 12).collect():
        value = np.clip(k[r["doc_id"]] @ c, 0, 1)
        assert r["lang_pred"] == sorted(counts)[value.argmax()]
        assert abs(r["score"] - value.max() / value.sum()) < 1e-2
        assert r["held_out"] == (crc(r["doc_id"]) % 4 == 2)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_reads_no_held_out_label(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(langid.training(F.col("doc_id")), F.col("lang")).otherwise("xx")).withColumn("source", F.lit("other"))
    assert got(langid.predict(docs), ["doc_id", "lang_pred", "score"]) == got(langid.predict(other), ["doc_id", "lang_pred", "score"])


def test_language_edges(spark):
    columns = ["doc_id", "held_out", "lang_pred", "score"]
    rows = got(langid.predict(cases.with_null_id(spark)), columns)
    texts = {r[0]: r[1] for r in cases.rows()}
    assert len(rows) == len(cases.rows()) + 1
    for i, held, lang, score in rows:
        assert held is None if i is None else held == (crc(i) % 4 == 2)
        letters = i is None or any(c.isalpha() for c in texts[i] or "")
        assert lang == ("en" if letters else "und") and 0 <= score <= 1
    assert langid.predict(cases.table(spark, [])).count() == 0
    unknown = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert got(langid.predict(unknown), columns) == [(1, crc(1) % 4 == 2, "und", 0.0), (2, crc(2) % 4 == 2, "und", 0.0)]
