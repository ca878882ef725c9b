"""What the review of round 4 found: whole records that fill the disk; against plain versions."""

from __future__ import annotations

import statistics

import pytest
from pyspark.sql import functions as F


def table(df):
    value = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted(str([value(r[c]) for c in sorted(df.columns)]) for r in df.collect())


def test_entries_make_the_records(spark, sf):
    from tidemark.plans.views import records_of, view

    entries = view(spark, sf, "entries").withColumn("_more", F.col("k") * 2)
    got, want = records_of(entries, ["_more"]), view(spark, sf, "records")
    assert got.columns == ["_more", *want.columns] and got.filter("_more <> record_id * 2").isEmpty()
    assert table(got.drop("_more")) == table(want)


@pytest.mark.parametrize("few", [True, False])
def test_only_entries_are_stored(spark, sf, monkeypatch, few):
    """What e0 writes has the columns that records are made of, not the records'; the result is that of whole records, also where
    groups are too many to be sent to every task; F1."""
    from tidemark.operators import features as E
    from tidemark.plans import prefix
    from tidemark.plans.catalog import QUERIES
    from tidemark.plans.views import view

    want = E.engineer(view(spark, sf, "records"))
    widths, whole = [], E.written
    monkeypatch.setattr(E, "written", lambda df: (widths.append(len(df.columns)), whole(df))[1])
    if not few:
        monkeypatch.setattr(prefix, "SMALL", 1)
    got = QUERIES["e0_all_features"](spark, sf)
    assert got.columns == want.columns and got.count() == 1500
    assert len(widths) == 2 and max(widths) <= 20
    assert table(got) == table(want)


def test_moments_of_pairs_are_those_of_windows(spark):
    from tidemark.operators import features as E

    values = [1.0, None, 2.5, 7.25, None, None, 0.1, 0.1]
    df = spark.createDataFrame([(i, "a", f"2024-01-{1 + i:02d}", v) for i, v in enumerate(values)], "record_id long, symbol string, day string, x double").withColumn("report_date", F.to_date("day"))
    want = E.lags(df, ["x"])
    got = E.pair_moments(want.drop("x_rolling_mean", "x_rolling_std"), ["x"])
    assert table(got.select(want.columns)) == table(want)


def test_row_statistics_leave_out_nulls(spark):
    from tidemark.functions import scalar as S

    rows = [(1.5, None, -2.0, 0.25), (None, 3.0, None, None), (None, None, None, None), (-0.0, 0.0, 1e300, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    c = [F.col(x) for x in "abcd"]
    out = df.select(S.row_std(*c), S.row_range(*c), S.positive_share(*c)).collect()
    for row, r in zip(rows, out, strict=True):
        x = [v for v in row if v is not None]
        assert r[0] == (pytest.approx(statistics.stdev(x)) if len(x) > 1 and max(x) < 1e200 else r[0] if len(x) > 1 else None)
        assert r[1] == (max(x) - min(x) if x else None) and r[2] == (sum(v > 0 for v in x) / len(x) if x else 0.5)
    plan = df.select(S.row_std(*c))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan  # no function that Spark only interprets, per element
