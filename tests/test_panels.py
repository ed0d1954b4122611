"""Panel operators: hand-checked values, invariants, and a day loop against the segment backtest."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.functions import exprs
from tidemill.operators import backtest, clusters, features, metrics, models, portfolio, regime, splits
from tidemill.sources import panels

D0 = date(2020, 1, 1)
day = lambda k: D0 + timedelta(days=k)


def panel(spark, columns):
    """A dense panel of {ticker: closes}."""
    rows = [(k + 1, day(k), t, None if c is None else float(c)) for t, cs in columns.items() for k, c in enumerate(cs)]
    return spark.createDataFrame(rows, "i long, date date, ticker string, close double")


def values(df, column, by="date"):
    return [r[column] for r in df.orderBy(by).collect()]


def near(got, want):
    assert len(got) == len(want) and all((a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9)) for a, b in zip(got, want)), (got, want)


def test_returns_with_and_without_padding(spark):
    p = panel(spark, {"A": [1, 2, None, 4, None, None]})
    near(values(features.with_returns(p), "ret"), [None, 1, 0, 1, 0, 0])
    near(values(features.with_returns(p, "none"), "ret"), [None, 1, None, None, None, None])


def test_pct_rank_ema_and_normal(spark):
    x = spark.createDataFrame([(1, k, v) for k, v in enumerate([3.0, 1.0, 1.0, None, 2.0])], "g int, date int, x double")
    near(values(x.withColumn("r", exprs.pct_rank("x", "g")), "r"), [1.0, 0.375, 0.375, None, 0.75])
    e = spark.createDataFrame([(0, 1.0), (1, 0.4), (2, 0.7)], "date int, x double")
    near(values(e.withColumn("y", exprs.ema("x", 3, "date")), "y"), [1, 0.7, 0.7])
    p = spark.createDataFrame([(0.5,), (0.6,), (0.75,), (0.9,)], "p double").withColumn("b", models.bet_size(F.col("p")))
    assert np.allclose(values(p, "b", "p"), [0, 0.161744, 0.436297, 0.817578], atol=1e-6)


def test_moments_are_bias_corrected(spark):
    xs = np.random.default_rng(0).normal(size=40) ** 3
    got = spark.createDataFrame([(float(x),) for x in xs], "x double").agg(exprs.skewness("x").alias("s"), exprs.kurtosis("x").alias("k")).first()
    import pandas as pd

    assert math.isclose(got.s, pd.Series(xs).skew()) and math.isclose(got.k, pd.Series(xs).kurt())


def test_clean(spark):
    p = panel(spark, {"A": [1, 1.1, 0, 1.2], "B": [1, 9, 9, 9], "C": [None] * 4, "D": [1, None, None, None]})
    assert {r.ticker for r in panels.clean(p).collect()} == {"A", "D"} and {r.ticker for r in panels.clean(p, history=3).collect()} == {"A"}
    assert values(panels.clean(p).where("ticker = 'A'"), "close")[2] is None


def test_asof_clamps_to_the_first_snapshot(spark):
    dates = spark.createDataFrame([(day(k),) for k in (0, 5, 9, 10, 20)], "date date")
    snaps = spark.createDataFrame([(day(5),), (day(10),)], "snap_date date")
    assert values(panels.asof_snapshot(dates, snaps), "snap_date") == [day(5), day(5), day(5), day(10), day(10)]


def test_cache(spark, tmp_path):
    (tmp_path / "m.csv").write_text('date,tickers\n2020-02-01,"B,C"\n2020-01-01,"A,B"\n')
    assert [r.tickers for r in panels.read_membership(spark, str(tmp_path / "m.csv")).collect()] == [["A", "B"], ["B", "C"]]
    wide = spark.createDataFrame([(day(0), 1.0, 2.0), (day(1), 3.0, None)], "date date, `Close|A` double, `Close|B` double")
    wide.write.parquet(str(tmp_path / "wide"))
    long = panels.read_wide_cache(spark, str(tmp_path / "wide"))
    assert {(r.date, r.ticker, r.Close) for r in long.collect()} == {(day(0), "A", 1), (day(0), "B", 2), (day(1), "A", 3), (day(1), "B", None)}
    panels.write_long_cache(long, str(tmp_path / "long"))
    assert spark.read.parquet(str(tmp_path / "long")).count() == 4
    old, new = panel(spark, {"A": [1, 2]}), panel(spark, {"A": [9], "B": [5]})
    assert values(panels.merged_cache(old, new).where("ticker = 'A'"), "close") == [9, 2]
    assert [r.ticker for r in panels.missing_tickers(new, old).collect()] == ["B"]
    assert panels.pick_field(new.withColumn("adj_close", F.lit(7.0))).first().close == 7
    with pytest.raises(KeyError):
        panels.pick_field(new.drop("close"))
    (tmp_path / "g.csv").write_text("ISO3,year,infl,rGDP,other\nUSA,2001,2.5,10,x\nFRA,2001,1,1,x\nUSA,2000,1.5,9,x\n")
    assert [tuple(r) for r in panels.read_macro(spark, str(tmp_path / "g.csv")).collect()] == [(2000, 1.5, 9.0), (2001, 2.5, 10.0)]


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(1)
    closes = {t: list(100 * np.exp(np.cumsum(rng.normal(0, 0.01, 330)))) for t in "ABCDE"}
    full = features.build(panel(spark, closes), panels.market(panel(spark, closes)))
    short = {t: c[:300] for t, c in closes.items()}
    cut = features.build(panel(spark, short), panels.market(panel(spark, short)))
    assert len(cut.columns) == len(full.columns)
    a = {(r.date, r.ticker): r for r in full.where(F.col("date") <= day(299)).collect()}
    for r in cut.collect():
        near([x for x in r[2:]], [x for x in a[r.date, r.ticker][2:]])


def test_triple_barrier(spark):
    rng = np.random.default_rng(3)
    closes = {t: [None if rng.random() < 0.05 else float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 90)))] for t in "AB"}
    got = {(r.ticker, r.date): r.label for r in features.triple_barrier(panel(spark, closes), 10, 1.0, 1.0, 5).collect()}
    for t, c in closes.items():
        filled = [next((x for x in reversed(c[: k + 1]) if x is not None), None) for k in range(len(c))]
        ret = [None] + [b / a - 1 if a and b else None for a, b in zip(filled, filled[1:])]
        for k in range(len(c)):
            w = ret[max(0, k - 4) : k + 1]
            want = None
            if k + 10 < len(c) and c[k] is not None and len(w) == 5 and None not in w:
                s, hit = np.std(w, ddof=1), None
                for j in range(1, 11):
                    r = None if c[k + j] is None else c[k + j] / c[k] - 1
                    if r is not None and (r >= s or r <= -s):
                        hit = 1.0 if r >= s else -1.0
                        break
                want = hit if hit is not None else 0.0 if c[k + 10] is None else float(np.sign(c[k + 10] / c[k] - 1))
            assert got[t, day(k)] == want, (t, k)


def test_uniqueness_weights(spark):
    rows = spark.createDataFrame([(day(k), "A") for k in range(5)], "date date, ticker string")
    near(values(features.uniqueness_weights(rows), "w"), [1.0] * 5)
    w = values(features.uniqueness_weights(rows, half_life=1.0), "w")
    assert math.isclose(sum(w), 5) and math.isclose(w[1] / w[0], 2)


def test_splits(spark):
    combos, paths = splits.cpcv_paths(4, 2)
    assert len(combos) == 6 and paths == [[0, 0, 1, 2], [1, 3, 3, 4], [2, 4, 5, 5]]
    assert len(splits.cpcv_paths(6, 2)[0]) == 15 and len(splits.cpcv_paths(6, 2)[1]) == 5
    rows = [(day(k // 3), f"T{k % 3}", day(k // 3 + 4)) for k in range(103)]
    samples = spark.createDataFrame(rows, "date date, ticker string, t1 date")
    for made, n in ((splits.purged_kfold(samples, 5, 0.02), 5), (splits.cpcv(samples, 5, 2, 0.02), 10)):
        held = made.collect()
        assert len(held) == 103 * n
        for s in range(n):
            part = [r for r in held if r.split == s]
            test = [r for r in part if r.role == "test"]
            spans, last = [], None
            for r in sorted(test, key=lambda r: r.row_id):
                if last is None or r.row_id != last + 1 or (len(spans[-1]) == 21):
                    spans.append([])
                spans[-1].append(r)
                last = r.row_id
            for r in part:
                if r.role == "train":
                    assert not any(rows[r.row_id][2] >= min(x.date for x in sp) and r.date <= max(rows[x.row_id][2] for x in sp) for sp in spans)
    assert [len(c) for c in np.array_split(np.arange(103), 5)] == [sum(r.role == "test" for r in splits.purged_kfold(samples, 5).where(f"split = {s}").collect()) for s in range(5)]


def loop(closes, targets, capital=1000.0, cost=0.001):
    """The backtest day by day: {date number: {ticker: weight}} targets over equal-length closes."""
    names = sorted(closes)
    n = len(closes[names[0]])
    held, cash, out = dict.fromkeys(names, 0.0), capital, []
    for k in range(n):
        if k:
            for t in names:
                a, b = closes[t][k - 1], closes[t][k]
                if a is not None and b is not None:
                    held[t] *= b / a
        nav = cash + sum(held.values())
        if k in targets:
            w = {t: targets[k].get(t, 0.0) if closes[t][k] is not None else 0.0 for t in names}
            tot = sum(w.values())
            if tot > 1:
                w = {t: x / tot for t, x in w.items()}
            nav -= cost * nav * sum(abs(w[t] - held[t] / nav) for t in names)
            held = {t: w[t] * nav for t in names}
            cash = nav - sum(held.values())
        out.append(nav)
    return out


def run(spark, closes, targets, capital=1000.0):
    p = panel(spark, closes)
    t = spark.createDataFrame([(day(k), n, float(w)) for k, ws in targets.items() for n, w in ws.items()], "rebal date, ticker string, w double")
    r = spark.createDataFrame([(day(k),) for k in targets], "rebal date")
    made = backtest.parts(p, t, r)
    return made, values(backtest.equity(p, made, capital), "equity")


def test_backtest_by_hand(spark):
    made, nav = run(spark, {"A": [100, 110, 110], "B": [50, 50, 55]}, {0: {"A": 0.5, "B": 0.5}, 1: {"A": 1.0, "B": 0.0}})
    assert np.allclose(nav, [999, 1047.951, 1047.951], atol=1e-3)
    assert math.isclose(values(backtest.turnover(made), "turnover", "rebal")[1], 0.952381, rel_tol=1e-5)


@pytest.mark.parametrize("seed", [0, 1])
def test_backtest_as_the_day_loop(spark, seed):
    rng = np.random.default_rng(seed)
    closes = {t: [None if rng.random() < 0.06 or (t == "D" and k > 40) else float(x) for k, x in enumerate(100 * np.exp(np.cumsum(rng.normal(0, 0.03, 60))))] for t in "ABCD"}
    targets = {k: {t: float(w) for t, w in zip("ABCD", rng.dirichlet(np.ones(4)) * rng.choice([0.8, 1.0, 1.3]))} for k in (3, 11, 12, 30, 45)} | {50: {}}
    made, nav = run(spark, closes, targets)
    assert np.allclose(nav, loop(closes, targets), rtol=1e-10)
    gross = backtest.weights(made).groupBy("date").agg(F.sum("w").alias("g"), F.min("w").alias("m")).agg(F.max("g"), F.min("m")).first()
    assert gross[0] <= 1.001 and gross[1] >= -1e-9


def curve(spark, equity):
    e = spark.createDataFrame([(day(k), float(x)) for k, x in enumerate(equity)], "date date, equity double")
    return backtest.returns(e)


def test_metrics_by_hand(spark):
    c = curve(spark, [100, 110, 99, 104.5, 111, 100, 90, 112])
    low = metrics.max_drawdown(c).first()
    assert math.isclose(low.depth, -0.189189, rel_tol=1e-5) and (low.peak, low.trough) == (day(4), day(6))
    assert metrics.drawdown_duration(c).first().duration == 2
    r = spark.createDataFrame([(day(k), 1.0, x) for k, x in enumerate([0.01, -0.02, 0.03, 0.0])], "date date, equity double, ret double")
    got = {x.metric: x.value for x in metrics.summary(r).collect()}
    near([got["Annualized Return"], got["Sharpe"], got["Sortino"]], [2.374695, 3.812933, 7.937254])
    assert metrics.drawdown_duration(curve(spark, [1, 2, 3])).first().duration == 0


def test_portfolio_correlation_as_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 4)) + rng.normal(size=(80, 1))
    rets = spark.createDataFrame([(k + 1, day(k), t, float(x[k, j])) for k in range(80) for j, t in enumerate("ABCD")], "i long, date date, ticker string, ret double")
    w = [0.1, 0.2, 0.3, 0.2]
    weights = spark.createDataFrame([(day(k), t, w[j]) for k in range(80) for j, t in enumerate("ABCD")], "date date, ticker string, w double")
    got = values(metrics.portfolio_correlation(weights, rets, 20, 5), "ipc")
    for k in range(80):
        t = k - k % 5
        if t < 20:
            assert got[k] is None
            continue
        c, p = np.corrcoef(x[t - 19 : t + 1].T), np.array(w) / sum(w)
        off = np.outer(p, p) * (1 - np.eye(4))
        assert math.isclose(got[k], (c * off).sum() / off.sum(), rel_tol=1e-9)


def test_bootstrap_is_repeatable(spark):
    c = curve(spark, 100 * np.exp(np.cumsum(np.random.default_rng(2).normal(0.001, 0.01, 120))))
    a, b = (metrics.block_bootstrap(c, 20, 50).agg(F.avg("sharpe"), F.count(F.lit(1))).first() for _ in range(2))
    assert a == b and a[1] == 50


def test_brake_and_regimes(spark):
    dd = [0, 0.03, 0.06, 0.09, 0.12, 0.20]
    e = spark.createDataFrame([(day(k), 100.0 * (1 - x)) for k, x in enumerate(dd)], "date date, equity double")
    near(values(portfolio.drawdown_brake(e, e.select(F.col("date").alias("rebal"))), "brake", "rebal"), [1, 1, 1, 0.75, 0.5, 0.5])
    m = spark.createDataFrame([(day(0), 9.0, -1.0, -2.0), (day(1), 1.0, 1.0, 1.0), (day(2), None, 1.0, 1.0)], "date date, infl double, rGDP_growth double, yield_spread double")
    near(values(regime.macro_scale(m), "scale"), [0.5, 1.0, 0.5 + 0.5 * 2 / 3])
    near(values(regime.macro_scale(m.select("date")), "scale"), [1.0] * 3)
    f = spark.createDataFrame([(day(0), -0.02), (day(1), -0.0075), (day(2), 0.005)], "date date, value double")
    near(values(regime.forecast_scale(f, f.select("date")), "scale"), [0.7, 0.85, 1.0])
    y = spark.createDataFrame([(2023, 1.0)], "year int, infl double")
    days = spark.createDataFrame([(date(2024, 4, 30),), (date(2024, 5, 1),)], "date date")
    assert values(regime.macro_daily(y, days), "infl") == [None, 1.0]


def test_capped_top_n_as_a_greedy_pass(spark):
    rng = np.random.default_rng(4)
    scores = [(day(d), f"T{k:02d}", float(rng.normal())) for d in range(5) for k in range(20)]
    group = {f"T{k:02d}": int(rng.integers(0, 5)) for k in range(20)}
    s = spark.createDataFrame(scores, "rebal date, ticker string, score double")
    c = spark.createDataFrame([(day(d), t, g) for d in range(5) for t, g in group.items()], "rebal date, ticker string, cluster int")
    got = {(r.rebal, r.ticker) for r in portfolio.capped_top_n(s, c, 7, 2).collect()}
    want = set()
    for d in range(5):
        full, n = {}, 0
        for _, t, x in sorted((x for x in scores if x[0] == day(d)), key=lambda x: -x[2]):
            if n < 7 and full.get(group[t], 0) < 2:
                want.add((day(d), t))
                full[group[t]], n = full.get(group[t], 0) + 1, n + 1
    assert got == want


def test_blend_and_errors(spark):
    a = spark.createDataFrame([("A", 0.6), ("B", 0.4)], "ticker string, w double")
    b = spark.createDataFrame([("B", 0.5), ("C", 0.5)], "ticker string, w double")
    assert {r.ticker: round(r.w, 6) for r in portfolio.blended(a, b, 0.5, 2).collect()} == {"B": 0.6, "A": 0.4}
    with pytest.raises(ValueError):
        portfolio.rebalances(a, "year")
    with pytest.raises(ValueError):
        models.ensemble(a, {"w": 0.0})
    with pytest.raises(ValueError):
        features.triple_barrier(a, 0)


def test_clusters_and_risk_parity(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(120, 1)), rng.normal(size=(120, 1))
    x = np.hstack([a + 0.1 * rng.normal(size=(120, 3)), b + 0.1 * rng.normal(size=(120, 3))])
    assert len({*clusters.cut(clusters.agglomerate(clusters.distances(x), "average"), 6, 2)[:3]}) == 1
    two = np.stack([rng.normal(size=200), 2 * rng.normal(size=200)], 1)
    v = two.var(axis=0, ddof=1)
    assert np.allclose(clusters.hrp(two), [v[1] / v.sum(), v[0] / v.sum()])
    w = clusters.hrp(x)
    assert np.isclose(w.sum(), 1) and (w >= 0).all()
    held = spark.createDataFrame([(day(0), f"T{j}", day(k), float(x[k, j])) for k in range(120) for j in range(6)], "rebal date, ticker string, date date, ret double")
    rows = clusters.correlation_clusters(held, 2).collect()
    assert len({r.cluster for r in rows}) == 2 and len({r.cluster for r in rows if r.ticker in ("T0", "T1", "T2")}) == 1
    bets = spark.createDataFrame([(day(0), f"T{j}", 0.5 - 0.1 * j) for j in range(6)], "rebal date, ticker string, score double")
    out = {r.ticker: r.w for r in clusters.select_and_allocate(bets, held, 4).collect()}
    assert set(out) == {"T0", "T1", "T2", "T3"} and np.isclose(sum(out.values()), 1)
    assert clusters.hrp_weights(held.limit(0)).count() == 0


def test_linear_models_in_closed_form(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 2)) * [1, 5] + 3
    y = x @ [0.5, -0.2] + rng.normal(size=200)
    rows = spark.createDataFrame([(day(k), "A", float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(x, y))], "date date, ticker string, a double, b double, y double")
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    fitted = models.fit_linear(rows, ["a", "b"])
    assert np.allclose(fitted.model.coefficients.toArray(), want, rtol=1e-6)
    assert np.allclose(values(fitted.predict(rows), "score"), z @ want + y.mean(), rtol=1e-6)


def test_two_stage(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(day(k % 40), f"T{k // 40}", float(a := rng.normal()), float(rng.normal()), float(a + rng.normal() > 0)) for k in range(800)], "date date, ticker string, a double, b double, y double")
    cut = rows.where(F.col("date") < day(28)), rows.where(F.col("date") >= day(28))
    made = models.fit_two_stage(*cut, ["a", "b"], maxIter=3, minInstancesPerNode=5)
    bets = made.bets(cut[1])
    assert bets.where("bet < 0 or bet > 1").count() == 0 and bets.where("base_side = 0 and bet <> 0").count() == 0
    report = models.classification_report(made.base.predict(cut[1])).first()
    assert report.auc > 0.6
    assert models.importances(made.base)[0][0] == "a"


def test_window_functions_prune(spark):
    p = features.raw_features(panel(spark, {"A": [1.0] * 5}))
    plan = p.select("date", "mom_1m")._jdf.queryExecution().executedPlan().toString()
    assert "stddev" not in plan and Window is not None
