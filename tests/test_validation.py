"""Checked samples, split scores, pruned searches, price sources and the synthetic panel."""

import random
import statistics
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import features, metrics, models, splits, validation
from tidemill.sources import prices, synthetic

day = lambda k: date(2020, 1, 1) + timedelta(days=k)


def table(spark, n=120, names="ABCD"):
    rng = random.Random(1)
    rows = []
    for k in range(n):
        for t in names:
            x = rng.random()
            rows.append((day(k), t, x, rng.random(), x + rng.random() / 4, float(x > 0.5)))
    return spark.createDataFrame(rows, "date date, ticker string, x double, z double, y double, up double")


def samples(rows):
    return validation.samples_of(rows, features.event_ends(rows.select("date").distinct(), 3))


def test_samples_are_checked(spark):
    rows = spark.createDataFrame([(day(0), "A"), (day(1), "A")], "date date, ticker string")
    ends = lambda *x: spark.createDataFrame(x, "date date, t1 date")
    assert validation.samples_of(rows, ends((day(0), day(1)), (day(1), day(2)))).count() == 2
    for wrong, word in ((ends((day(0), day(1))), "without"), (ends((day(0), day(1)), (day(1), day(0))), "before"), (ends((day(0), day(1)), (day(1), day(2)), (day(1), day(3))), "repeated")):
        with pytest.raises(ValueError, match=word):
            validation.samples_of(rows, wrong)
    with pytest.raises(ValueError, match="t1"):
        validation.check_samples(rows)


def test_split_scores_equal_one_fit_at_a_time(spark):
    rows = table(spark).cache()
    roles = splits.cpcv(samples(rows), 4, 2).cache()
    fit = lambda part: models.fit_linear(part, ["x", "z"])
    got = {r.split: r for r in validation.evaluate(rows, roles, fit, least=(10, 10)).collect()}
    assert sorted(got) == list(range(6))
    for s in (0, 5):
        train, test = (roles.where(f"split = {s} and role = '{role}'").select("date", "ticker").join(rows, ["date", "ticker"]) for role in ("train", "test"))
        assert (got[s].n_train, got[s].n_test) == (train.count(), test.count())
        assert got[s].score == pytest.approx(models.information_coefficient(fit(train).predict(test)).first()["ic"])
    one = validation.spread(spark.createDataFrame([(r.score,) for r in got.values()], "score double")).first()
    scores = [r.score for r in got.values()]
    assert one.splits == 6 and one["std"] == pytest.approx(statistics.pstdev(scores)) and (one["min"], one["max"]) == (min(scores), max(scores))
    fewest = min(r.n_train for r in got.values())
    assert validation.evaluate(rows, roles, fit, least=(fewest + 1, 10)).count() == sum(r.n_train > fewest for r in got.values())
    assert validation.evaluate(rows, roles, fit).count() == 0


def test_median_rule():
    rule = validation.MedianRule(startup=2, warmup=1)
    rule.done([0.5, 0.6])
    assert not rule.hopeless([0.1, 0.1])
    rule.done([0.7, 0.8])
    assert not rule.hopeless([0.1]) and rule.hopeless([0.1, 0.2]) and not rule.hopeless([0.1, 0.7]) and not rule.hopeless([0.8, 0.2]) and not rule.hopeless([0, 0, 0])


def test_draws_stay_inside(spark):
    rng = random.Random(0)
    for _ in range(50):
        one = validation.draw({"a": [1, 5], "b": (2, 4), "c": (0.5, 1.0)}, rng)
        assert one["a"] in (1, 5) and one["b"] in (2, 3, 4) and isinstance(one["b"], int) and 0.5 <= one["c"] <= 1


def test_searches(spark):
    rows = table(spark).cache()
    found = validation.search(rows, splits.purged_kfold(samples(rows), 2), ["x", "z"], {"maxIter": [2], "maxDepth": (1, 2)}, 2, label="up", metric="auc").collect()
    assert [r.state for r in found] == ["complete"] * 2 and all(r.folds == 2 and r.score > 0.9 for r in found)
    scored = rows.withColumns({"p_base": F.col("x"), "ok": (F.col("z") > 0.4).cast("double")})
    folds = lambda long: splits.purged_kfold(samples(long), 2)
    calls = validation.search_calls(scored, folds, ["x", "z", "p_base"], {"maxIter": [2], "minInstancesPerNode": (1, 5)}, 2, label="ok", calls=(50, 20), least=(20, 20)).collect()
    assert all(r.state == "complete" and 0.5 <= r.threshold <= 0.7 and r.score > 0.9 for r in calls)
    assert all(r.state == "pruned" and r.score is None and r.folds == 0 for r in validation.search_calls(scored, folds, ["x"], {}, 2, label="ok", calls=(10_000, 1)).collect())


def test_describe(spark):
    xs = [3.0, 1.0, None, 2.0, 10.0]
    rows = spark.createDataFrame([(x, None if x is None else -x) for x in xs], "a double, `b c` double")
    got = {r.name: r for r in metrics.describe(rows, ["a"]).collect()}["a"]
    known = [x for x in xs if x is not None]
    assert (got.n, got.low, got.high) == (4, 1.0, 10.0) and got["std"] == pytest.approx(np.std(known, ddof=1))
    assert [got.p25, got.p50, got.p75] == np.percentile(known, [25, 50, 75]).tolist()
    assert metrics.describe(rows, ["a"], exact=False).first().n == 4 and metrics.describe(rows.limit(0), ["a"]).count() == 0


class Counting:
    """A source that notes its requests and fails on one ticker."""

    def __init__(self, path, bad):
        self.inner, self.bad, self.asked = prices.ParquetSource(path), bad, []

    def fetch(self, spark, tickers, start, end):
        self.asked.append(tickers)
        if self.bad in tickers:
            raise ConnectionError(self.bad)
        return self.inner.fetch(spark, tickers, start, end)


def test_fetch_fills_the_cache(spark, tmp_path):
    path, cache = str(tmp_path / "source"), str(tmp_path / "cache")
    spark.createDataFrame([(day(k), t, float(k)) for k in range(400) for t in ("A", "B-X", "C")], "date date, ticker string, close double").write.parquet(path)
    source = Counting(path, "C")
    get = lambda names, a, b: prices.fetch_prices(spark, source, names, day(a), day(b), cache, batch=1, pause=0)
    with pytest.raises(RuntimeError):
        get(["C"], 0, 380)
    source.asked.clear()
    rows = get(["B.X", "A", "C"], 0, 380)
    assert source.asked == [["A"], ["B-X"], ["C"]] and {r.ticker for r in rows.collect()} == {"A", "B.X"} and rows.agg(F.max("date")).first()[0] == day(379)
    source.asked.clear()
    few = get(["A", "B.X"], 5, 7)
    assert source.asked == [] and sorted(r.date for r in few.where("ticker = 'A'").collect()) == [day(5), day(6), day(7)]
    source.bad = ""
    assert get(["C", "A"], 0, 10).where("ticker = 'C'").count() == 10 and source.asked == [["C"]]


def test_synthetic_panel_does_not_depend_on_tasks(spark):
    got = synthetic.synthetic_panel(spark, 300, 5, 7).orderBy("ticker", "i").toPandas()
    again = synthetic.synthetic_panel(spark.newSession(), 300, 5, 7).repartition(3).orderBy("ticker", "i").toPandas()
    assert len(got) == 1500 and (got == again).all().all() and (got.high >= got.close).all() and (got.low <= got.close).all()
    moves = got.pivot(index="i", columns="ticker", values="close").pct_change().dropna()
    other = synthetic.synthetic_panel(spark, 300, 1, 8).toPandas()
    assert moves.corr().to_numpy().min() > 0.05 and 0.005 < moves.std().mean() < 0.05 and other.close[9] != got.close[9]
