"""Splits by date, ranks without one-task windows, macro columns and the composed strategies."""

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemill.operators import models, splits
from tidemill.plans import pipelines
from tidemill.sources.store import kept, report

DATA = "/root/testdata/sf0.001"
day = lambda k: date(2020, 1, 1) + timedelta(days=k)


def brute_auc(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("bins", [1, 3, 4096])
def test_auc_equals_all_pairs(spark, bins):
    pairs = [((k * 7 % 11) / 11, float(k * 5 % 3 == 0)) for k in range(60)]
    rows = spark.createDataFrame(pairs, "score double, y double")
    assert models.auc(rows, bins=bins).first()["auc"] == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_auc_of_one_score_and_of_one_class(spark):
    assert models.auc(spark.createDataFrame([(0.5, 1.0), (0.5, 0.0)], "score double, y double")).first()["auc"] == 0.5
    assert models.auc(spark.createDataFrame([(0.5, 1.0), (0.7, 1.0)], "score double, y double")).first()["auc"] is None


def test_elapsed_is_the_percent_rank_by_date(spark):
    rows = spark.createDataFrame([(day(k // 3), str(k)) for k in range(10)] + [(day(9), "x")], "date date, ticker string")
    got = {(r["date"], r["ticker"]): r["p"] for r in splits.elapsed(rows, "p").collect()}
    assert len(got) == 11
    for (d, _), p in got.items():
        assert p == pytest.approx(sum(e < d for e, _ in got) / 10)


def test_spans_keep_labels_inside_their_part(spark):
    rows = spark.createDataFrame([(day(k), t) for k in range(100) for t in "AB"], "date date, ticker string")
    train, valid, live = pipelines.spans(rows, 5, 0.5, 0.2)
    ends = lambda df: df.agg(F.min("date"), F.max("date")).first()
    a, b = ends(train), ends(valid)
    assert a[0] == day(0) and a[1] + timedelta(days=5) < b[0] and b[1] + timedelta(days=5) < live
    assert train.count() == 2 * 44 and live == day(69)


def test_macro_columns_have_a_prefix_and_no_gaps(spark):
    rows = spark.createDataFrame([(day(k), "A") for k in range(4)], "date date, ticker string")
    macro = spark.createDataFrame([(day(0), None, 1.0), (day(1), 2.0, None), (day(2), None, 3.0), (day(3), 4.0, None)], "date date, infl double, other double")
    got, names = pipelines.with_macro(rows, macro)
    assert names == ["m_infl"] and [r["m_infl"] for r in got.orderBy("date").collect()] == [2.0, 2.0, 2.0, 4.0]


def test_kept_tables_go_with_the_block(spark):
    with kept(spark) as keep:
        rows = keep(spark.range(5))
        path = Path(rows.inputFiles()[0].removeprefix("file:"))
        out = report(rows.agg(F.sum("id").alias("s")))
        assert path.exists()
    assert not path.exists() and out.first()["s"] == 10


def test_strategies_end_with_all_figures(spark):
    """Both in one session, with nothing left cached."""
    first = {r["metric"]: r["value"] for r in pipelines.production(spark, DATA).collect()}
    second = {r["metric"]: r["value"] for r in pipelines.two_stage(spark, DATA, rounds=2).collect()}
    assert len(second) == 8 and set(first) - set(second) == {"IC factor", "IC regressor", "IC classifier", "IC score"}
    assert all(v is not None for v in [*first.values(), *second.values()]) and abs(first["IC score"]) <= 1
