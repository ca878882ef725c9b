"""The pipeline against plain versions of its exact stages, and its queries' registration."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest

from tests.llm import brute, cases
from tidemark.llm import mixing, queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        from tidemark.llm.store import keep

        out = keep(stage(spark, docs, sf), "stage")
        rows = {r["doc_id"]: r for r in out.collect()}
        assert len(rows) == out.count() > 0
        assert set(rows) <= set(seen)
        if name == "simhash near-dedup":
            assert set(rows) == set(brute.near([(i, r["text"]) for i, r in seen.items()]))
        if name == "substring dedup":
            ids = list(seen)
            want = brute.substrings([seen[i]["text"] for i in ids])
            assert set(rows) == set(ids)
            for i, (n, gone, _) in zip(ids, want, strict=True):
                if not gone:
                    assert rows[i]["text"] == seen[i]["text"]
                else:
                    assert len(brute.WORD.findall(rows[i]["text"])) == n - gone
                assert rows[i]["n_chars"] == len(rows[i]["text"])
        if name == "source mix":
            assert set(rows) == {r["doc_id"] for r in mixing.sample(docs).collect() if r["kept"]}
        if name == "bpe encoding":
            from tidemark.llm import bpe
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(bpe.default_path())
            for i, r in rows.items():
                assert np.frombuffer(r["ids"], "<u4").tolist() == t.encode(seen[i]["text"] or "", add_special_tokens=False).ids
                assert r["n_tokens"] == len(r["ids"]) // 4
        else:
            assert out.columns == columns
        docs, seen = out, rows


def test_stages_on_edge_cases(spark, tmp_path):
    folder = str(tmp_path)
    cases.labels(spark).write.parquet(f"{folder}/labels.parquet")
    for df in (cases.with_null_id(spark), spark.createDataFrame([], cases.SCHEMA)):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, folder)
            assert docs.columns == df.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "source mix", "bpe encoding"]


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize(("name", "table"), [("op7_url_rules", "pages"), ("op12_prefix_trie", "conversations"), ("op13_role_repair", "conversations")])
def test_oracle(spark, sf, name, table):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = queries.queries()[name](spark, sf)
    columns = ["page_id", "host", "path", "rule", "verdict"] if table == "pages" else df.columns
    want = sorted(map(str, con.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()))
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want
