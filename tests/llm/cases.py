"""Documents with every edge case: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, size string, key string, removal_id string, mix_topic string"


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(["alpha", "Beta", "gamma,", "ÉTÉ", "naïve", "x", "delta.", "42", "don't", "zeta-eta", "日本", "İx"]) + str(rng.randrange(300)) for _ in range(n)]


def rows() -> list[tuple]:
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    base = words(rng, 400)
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", "a b c", "a b c d", "a\u00a0b c\u2003d"]
    texts += [" ".join(words(rng, rng.randrange(5, 120))) for _ in range(25)]
    texts += [" ".join(base)] * 4
    texts += [" ".join(base[:i] + ["changed"] + base[i + 1 :]) for i in (3, 200, 390)]
    texts += [" ".join(words(rng, 30)) + " " + passage + "  \n" + " ".join(words(rng, 30)) for _ in range(3)]
    texts += ["again " * 80, "line one\nline one\n\nline two\nline one", "### $$$ %%% *** &&& | | < >", "x" * 50_000, " ".join(words(rng, 12_000)), "no-space-" * 6000]
    out = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", None, 7, "clash", "clash", "clash", None) for i, t in enumerate(texts)]
    out += [out[10], out[10]]  # repeated rows
    return out


def table(spark, which=None):
    r = rows() if which is None else which
    return spark.createDataFrame(r, SCHEMA).repartition(3)


def with_null_id(spark):
    return spark.createDataFrame([*rows(), (None, "a text without an id", "en", "src0", 1, 1, "", "", "", None)], SCHEMA)


def labels(spark, r=None):
    return spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, 1 if i % 4 == 0 else 0) for i in range(45)] if r is None else r, "doc_id bigint, quality int, toxic int")
