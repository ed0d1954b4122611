"""The composed strategies: scores to monthly weights to a backtest.

Rebalances are a few dozen dates whose weights depend on the weights before, so a driver loop walks them; everything
that depends on the size of the panel (features, scores, windows, backtest) is a plan of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import bfill, ffill
from ..operators import backtest, clusters, features, metrics, models, portfolio, regime
from ..sources import panels
from ..sources.store import kept, report


@dataclass(frozen=True)
class StrategyConfig:
    """Settings of the production strategy; panels of fewer names use smaller ones."""

    horizon: int = 21
    top_n: int = 30
    clusters: int = 8
    cap: int = 5
    target_vol: float = 0.16
    window: int = 252
    vol_window: int = 63
    smooth: float = 0.5
    power: float = 2.0
    brake_start: float = 0.06
    brake_most: float = 0.5
    least_candidates: int = 35
    least_selected: int = 10
    shares: tuple[float, float] = (0.45, 0.15)
    rounds: int = 60
    half_life: float = 756.0


#: For the panel of 25 brands.
BRANDS = StrategyConfig(top_n=10, clusters=5, cap=3, least_candidates=8, least_selected=4, rounds=10)
# The weights of the components, and the macro figures that the models take.
BLEND = {"factor": 0.5, "classifier": 0.3, "regressor": 0.2}
MACRO = ("infl", "unemp", "cbrate", "ltrate", "yield_spread", "rGDP_growth", "M2_growth", "real_rate", "infl_dev5y", "unemp_dev5y")


def blend_step(before: dict[str, float], new: dict[str, float], share: float, n: int) -> dict[str, float]:
    """One step of turnover smoothing: the n largest of the mixed weights, renormalised."""
    if not before:
        return dict(new)
    mixed = {t: share * before.get(t, 0.0) + (1 - share) * new.get(t, 0.0) for t in before.keys() | new.keys()}
    kept = dict(sorted(mixed.items(), key=lambda x: (-x[1], x[0]))[:n])
    total = sum(kept.values())
    return {t: w / total for t, w in kept.items()} if total > 0 else {}


def scaled(weights: dict[str, float], window: dict[str, list[float | None]], target: float, least: int = 60) -> dict[str, float]:
    """Weights scaled to the target volatility over a window of returns, by the variance of their weighted sum."""
    full = {t: window[t] for t in weights if t in window and None not in window[t]}
    rows = max((len(v) for v in full.values()), default=0)
    if rows < least or len(full) < 2:
        return weights
    sums = [sum(weights[t] * v[k] for t, v in full.items()) for k in range(rows)]
    mean = sum(sums) / rows
    var = sum((x - mean) ** 2 for x in sums) / (rows - 1)
    scale = min(target / (var * 252) ** 0.5, 1.0 / max(sum(weights.values()), 1e-9)) if var > 0 else 1.0
    return {t: w * scale for t, w in weights.items()}


def monthly_weights(scores: DataFrame, panel: DataFrame, scale: DataFrame, config: StrategyConfig, keep: Callable[[DataFrame], DataFrame] = DataFrame.cache) -> tuple[DataFrame, DataFrame]:
    """(weights (rebal, ticker, w), all rebalances): cluster, capped top names, score over volatility, smoothing, volatility target, regime scale.

    The candidates and windows of each rebalance come from plans; the loop holds one rebalance's few names at a time.
    """
    spark = panel.sparkSession
    rebals = keep(portfolio.rebalances(panel.select("date").distinct()).join(scores.select(F.col("date").alias("rebal")).distinct(), "rebal", "left_semi"))
    at = scores.select(F.col("date").alias("rebal"), "ticker", "score").join(F.broadcast(rebals), "rebal").where("score > 0")
    rets = keep(features.with_returns(panel))
    held = keep(portfolio.windows(rets, rebals, config.window))
    grouped = clusters.correlation_clusters(held.join(at.select("rebal", "ticker"), ["rebal", "ticker"], "left_semi"), config.clusters)
    chosen = portfolio.capped_top_n(at, grouped, config.top_n, config.cap).select("rebal", "ticker", "score")
    raw = keep(portfolio.inverse_vol_tilt(keep(chosen), portfolio.windows(rets, rebals, config.vol_window), config.top_n, config.power))
    names = at.groupBy("rebal").agg(F.count(F.lit(1)).alias("n"))
    series = held.join(raw.select("ticker").distinct(), "ticker", "left_semi").groupBy("rebal", "ticker").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "ret"))), lambda x: x["ret"]).alias("rets"))
    by = raw.groupBy("rebal").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "w"))).alias("w"))
    spans = series.groupBy("rebal").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "rets"))).alias("window"))
    factor = scale.select(F.col("date").alias("rebal"), "scale")
    plan = rebals.join(names, "rebal", "left").join(by, "rebal", "left").join(spans, "rebal", "left").join(factor, "rebal", "left").orderBy("rebal")
    before: dict[str, float] = {}
    out, dates = [], []
    for r in plan.toLocalIterator():
        dates.append((r.rebal,))
        new = r.w or {}
        if (r.n or 0) < config.least_candidates or len(new) < config.least_selected:
            before = {}
            continue
        mixed = scaled(blend_step(before, new, config.smooth, config.top_n), r.window or {}, config.target_vol)
        before = {t: w * (1.0 if r.scale is None else r.scale) for t, w in mixed.items()}
        out += [(r.rebal, t, float(w)) for t, w in before.items()]
    return spark.createDataFrame(out, "rebal date, ticker string, w double"), spark.createDataFrame(dates, "rebal date")


def finished(panel: DataFrame, weights: DataFrame, rebals: DataFrame, config: StrategyConfig, keep: Callable[[DataFrame], DataFrame] = DataFrame.cache) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(curve, backtest parts) after the drawdown brake: a first run gives the drawdowns that scale the weights of the second."""
    first = keep(backtest.equity(panel, backtest.parts(panel, weights, rebals)))
    brake = portfolio.drawdown_brake(first, rebals, config.brake_start, 0.06, config.brake_most)
    braked = weights.join(F.broadcast(brake), "rebal").select("rebal", "ticker", (F.col("w") * F.col("brake")).alias("w"))
    parts = backtest.parts(panel, braked, rebals)
    return backtest.returns(backtest.equity(panel, parts)), parts


def with_macro(rows: DataFrame, macro: DataFrame, prefix: str = "m_") -> tuple[DataFrame, list[str]]:
    """(rows with a date's macro figures under prefixed names, those names); gaps are filled forward, then back. The macro table is date-level."""
    days = Window.orderBy("date")
    names = [c for c in MACRO if c in macro.columns]
    filled = macro.select("date", *(F.coalesce(ffill(c, days), bfill(c, days)).alias(prefix + c) for c in names))
    return rows.join(F.broadcast(filled), "date", "left"), [prefix + c for c in names]


def spans(rows: DataFrame, horizon: int, share: float, valid: float) -> tuple[DataFrame, DataFrame, date]:
    """(training rows, validation rows, first live date): by dates, the first `share`, the next `valid`, the rest. A label looks `horizon` dates ahead, so rows whose label ends in the next part go."""
    dates = rows.select("date").distinct()
    ends = features.event_ends(dates, horizon)
    low, high = dates.agg(F.percentile(F.unix_date("date"), F.array(F.lit(share), F.lit(share + valid))).alias("p")).select(*(F.date_from_unix_date(F.floor(F.col("p")[k]).cast("int")).alias(f"d{k}") for k in (0, 1))).first()
    known = rows.join(F.broadcast(ends), "date")  # date-level
    train = known.where(F.col("t1") < F.lit(low)).drop("t1")
    return train, known.where((F.col("date") >= F.lit(low)) & (F.col("t1") < F.lit(high))).drop("t1"), high


def component_ics(scored: DataFrame, target: DataFrame, names: tuple[str, ...] = ("factor", "regressor", "classifier", "score")) -> DataFrame:
    """(metric, value): the pooled information coefficient of each component, over the rows whose target is known."""
    rows = scored.join(target.select("date", "ticker", "y"), ["date", "ticker"])
    one = [models.information_coefficient(rows, n).select(F.lit(f"IC {n}").alias("metric"), F.col("ic").alias("value")) for n in names]
    return reduce(DataFrame.unionByName, one)


def production_scores(px: DataFrame, market: DataFrame, macro: DataFrame, config: StrategyConfig, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, date]:
    """(date, ticker and the components and score of each live row; first live date).

    Four regressors compete on validation rows, the leaders are fitted again on training and validation rows together,
    as is the classifier of the upper half, whose rows are weighted by age.
    """
    feats, more = with_macro(features.build(px, market).select("date", "ticker", *features.CURATED), macro)
    feats, names = keep(feats), [*features.CURATED, *more]
    y = features.rank_target(px, config.horizon).join(features.median_target(px, config.horizon).select("date", "ticker", F.col("y").alias("up")), ["date", "ticker"])
    rows = keep(feats.join(y, ["date", "ticker"]).na.drop())
    train, valid, live = spans(rows, config.horizon, *config.shares)
    board, _ = models.compare(train, valid, names, maxIter=config.rounds)
    both = keep(features.uniqueness_weights(train.unionByName(valid), config.horizon, config.half_life))
    used = models.leaders(board)
    scored = feats.where(F.col("date") >= F.lit(live))
    for name in used:
        scored = models.fit_named(both, names, name, maxIter=config.rounds).predict(scored, f"s_{name}")
    scored = models.fit_boosted(both, names, "up", classify=True, weight="w", maxIter=config.rounds).predict(scored, "s_up")
    parts = scored.select(
        "date", "ticker", models.factor_rank(list(features.FACTORS)).alias("factor"),
        models.rank_mean({"s_up": 1.0}).alias("classifier"), models.rank_mean({f"s_{n}": 1.0 for n in used}).alias("regressor"),
    )
    return keep(parts.withColumn("score", sum((F.col(c) * w for c, w in BLEND.items()), F.lit(0.0)))), live


def production(spark: SparkSession, sf_dir: str, config: StrategyConfig = BRANDS) -> DataFrame:
    """(metric, value) of the production strategy: models and factor ranks, blended, over clustered monthly books with regime scales and the brake; then each component's information coefficient."""
    with kept(spark) as keep:
        px = keep(panels.px_smooth(spark, sf_dir))
        market = keep(panels.market(px))
        macro = keep(regime.macro_daily(regime.macro_derived(panels.macro_year(spark, sf_dir)), market.select("date")))
        scored, start = production_scores(px, market, macro, config, keep)
        scale = regime.composed(regime.trend_scale(market, 100, 126, 0.06, 3), regime.macro_scale(macro))
        weights, rebals = monthly_weights(scored, px, scale, config, keep)
        curve, _ = finished(keep(px.where(F.col("date") >= F.lit(start))), weights, rebals, config, keep)
        return report(metrics.summary(keep(curve)).unionByName(component_ics(scored, features.rank_target(px, config.horizon))))


def two_stage(spark: SparkSession, sf_dir: str, n: int = 8, target_vol: float = 0.12, rounds: int = BRANDS.rounds) -> DataFrame:
    """(metric, value) of the earlier strategy: triple-barrier labels, a direction and a meta model, bets by risk parity, a volatility target."""
    with kept(spark) as keep:
        px = keep(panels.px_smooth(spark, sf_dir))
        names = ["mom_1m", "mom_3m", "vol_63", "ma_50_200"]
        feats = keep(features.lagged(features.raw_features(px), names))
        labels = features.triple_barrier(px).where("label is not null").select("date", "ticker", (F.col("label") == 1).cast("double").alias("y"))
        rows = keep(feats.join(labels, ["date", "ticker"]).na.drop())
        train, valid, start = spans(rows, BRANDS.horizon, 0.4, 0.2)
        model = models.fit_two_stage(train, valid, names, maxIter=rounds)
        live = keep(px.where(F.col("date") >= F.lit(start)))
        bets = keep(model.bets(feats.where(F.col("date") >= F.lit(start)).na.drop()).select(F.col("date").alias("rebal"), "ticker", F.col("bet").alias("score")))
        rebals = keep(portfolio.rebalances(live.select("date").distinct()))
        held = keep(portfolio.windows(features.with_returns(px), rebals, 252))
        weights = keep(clusters.select_and_allocate(bets.join(F.broadcast(rebals), "rebal"), held, n))
        book = keep(portfolio.vol_scale(weights, held, target_vol))
        curve = keep(backtest.returns(backtest.equity(live, backtest.parts(live, book, rebals))))
        return report(metrics.summary(curve))


def uplift(curve: DataFrame, market_curve: DataFrame) -> DataFrame:
    """One row: the Sharpe ratio of a curve over that of the market."""
    a, b = metrics.moments(curve).select(F.col("sharpe").alias("a")), metrics.moments(market_curve).select(F.col("sharpe").alias("b"))
    return a.join(F.broadcast(b)).select((F.col("a") / F.nullif("b", F.lit(0.0))).alias("uplift"))  # one row each


def equal_weight_correlation(panel: DataFrame, window: int = 64, names: int = 200, seed: int = 0) -> DataFrame:
    """(date, ipc): the mean pairwise correlation of at most `names` tickers, picked by a hash of the seed: a sampling report by design."""
    pick = Window.partitionBy("date").orderBy(F.xxhash64(F.lit(seed), "ticker"), "ticker")
    panel = panel.cache()
    picked = panel.where("close is not null").withColumn("__n", F.row_number().over(pick)).where(F.col("__n") <= names)
    weights = picked.select("date", "ticker", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("date"))).alias("w"))
    return metrics.portfolio_correlation(weights.cache(), features.with_returns(panel).cache(), window, 1)


def universe_size(panel: DataFrame) -> DataFrame:
    """One row: mean, smallest and largest number of priced names a day."""
    return panel.where("close is not null").groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("mean"), F.min("n").alias("low"), F.max("n").alias("high"))


def trailing_forecast(market: DataFrame, rebals: DataFrame, window: int = 1260, least: int = 252, ahead: int = 21) -> DataFrame:
    """(date, value): for each rebalance the return that a straight line through the log closes strictly before it gives `ahead` rows on; 0 with too little history. A linear stand-in for a forecasting library."""
    m = market.select("date", "i", F.log("close").alias("y"), F.col("i").cast("double").alias("x"))
    w = Window.orderBy("date").rowsBetween(-window, -1)
    n = F.count("y").over(w)
    slope = (F.avg(F.col("x") * F.col("y")).over(w) - F.avg("x").over(w) * F.avg("y").over(w)) / F.nullif(F.avg(F.col("x") * F.col("x")).over(w) - F.avg("x").over(w) * F.avg("x").over(w), F.lit(0.0))
    made = m.select("date", F.when(n >= least, F.exp(slope * ahead) - 1).otherwise(0.0).alias("value"))
    return made.join(F.broadcast(rebals.select(F.col("rebal").alias("date"))), "date", "left_semi")


__all__ = ["BRANDS", "StrategyConfig", "component_ics", "equal_weight_correlation", "finished", "monthly_weights", "production", "trailing_forecast", "two_stage", "universe_size", "uplift"]
