"""Selection and weights. Scores are (rebal, ticker, score); weights are (rebal, ticker, w)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, pct_rank, safe_div


def rebalances(dates: DataFrame, freq: str = "month") -> DataFrame:
    """The first trading date of each month, week or quarter, as rebal."""
    if freq not in ("month", "week", "quarter"):
        raise ValueError(f"unknown frequency {freq}")
    return dates.groupBy(F.date_trunc(freq, "date").alias("p")).agg(F.min("date").alias("rebal")).select("rebal")


def top_n(scores: DataFrame, n: int, *group: str) -> DataFrame:
    """The n best of each group, ties by ticker."""
    w = Window.partitionBy(*(group or ("rebal",))).orderBy(F.col("score").desc(), "ticker")
    return scores.where(F.col("score").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def capped_top_n(scores: DataFrame, clusters: DataFrame, n: int, cap: int = 2) -> DataFrame:
    """The n best overall among the `cap` best of each cluster: what a greedy pass with full clusters skipped selects."""
    joined = scores.join(clusters, ["rebal", "ticker"]).na.drop(subset=["score", "cluster"])
    return top_n(top_n(joined, cap, "rebal", "cluster").drop("rank"), n)


def rank_gate(scores: DataFrame, share: float = 0.40) -> DataFrame:
    """The names whose rank of the date is in the top share."""
    return scores.withColumn("rank_pct", pct_rank("score", "rebal")).where(F.col("rank_pct") >= 1 - share)


def equal_weight(chosen: DataFrame, gross: float = 1.0) -> DataFrame:
    return chosen.select("rebal", "ticker", (F.lit(gross) / F.count(F.lit(1)).over(Window.partitionBy("rebal"))).alias("w"))


def windows(returns: DataFrame, rebals: DataFrame, rows: int) -> DataFrame:
    """(rebal, ticker, date, ret): the last `rows` dates up to each rebalance. Returns carry i, the date's number; rebalances are few and broadcast."""
    at = returns.select("date", "i").distinct().join(F.broadcast(rebals), F.col("date") == F.col("rebal")).select("rebal", F.col("i").alias("__at"))
    spread = at.select("rebal", F.explode(F.sequence(F.greatest(F.col("__at") - rows + 1, F.lit(1)), F.col("__at"))).alias("i"))
    return returns.select("i", "date", "ticker", "ret").join(F.broadcast(spread), "i").select("rebal", "ticker", "date", "ret")


def complete(held: DataFrame) -> DataFrame:
    """The names without a gap in their window."""
    n = F.count(F.lit(1))
    return held.groupBy("rebal", "ticker").agg(n.alias("rows"), F.count("ret").alias("known"), F.stddev_samp("ret").alias("sigma")).where(F.col("rows") == F.col("known"))


def inverse_variance(held: DataFrame) -> DataFrame:
    """Weights by 1 / variance of the window's returns."""
    var = held.groupBy("rebal", "ticker").agg(F.var_samp("ret").alias("v")).where(F.col("v") > 0)
    return var.select("rebal", "ticker", ((1 / F.col("v")) / F.sum(1 / F.col("v")).over(Window.partitionBy("rebal"))).alias("w"))


def inverse_vol_tilt(scores: DataFrame, held: DataFrame, n: int, power: float = 1.0, least: int = 10) -> DataFrame:
    """Weights by score ** power / sigma among the n best positive scores with a complete window; by the score alone where windows are short, equal where that leaves nothing."""
    top = top_n(scores.where(F.col("score") > 0), n)
    both = top.join(complete(held), ["rebal", "ticker"])
    s = F.pow("score", F.lit(power))
    raw = F.when(F.col("rows") < least, s).otherwise(F.coalesce(safe_div(s, F.col("sigma")), F.lit(0.0)))
    w = Window.partitionBy("rebal")
    both = both.withColumn("raw", raw).withColumn("total", F.sum("raw").over(w))
    return both.select("rebal", "ticker", F.when(F.col("total") > 0, F.col("raw") / F.col("total")).otherwise(1.0 / F.count(F.lit(1)).over(w)).alias("w"))


def vol_scale(weights: DataFrame, held: DataFrame, target: float = 0.15, max_gross: float = 1.0, least: int = 60) -> DataFrame:
    """Weights scaled to a target of annual volatility. The variance of the weighted returns' sum is the quadratic form of their covariance, so no matrix is built."""
    fine = complete(held).join(weights, ["rebal", "ticker"]).select("rebal", "ticker", "w", "rows")
    names = fine.groupBy("rebal").agg(F.count(F.lit(1)).alias("names"), F.max("rows").alias("rows"))
    series = held.join(fine.select("rebal", "ticker", "w"), ["rebal", "ticker"]).groupBy("rebal", "date").agg(F.sum(F.col("w") * F.col("ret")).alias("r"))
    var = series.groupBy("rebal").agg(F.var_samp("r").alias("v")).join(names, "rebal")
    gross = Window.partitionBy("rebal")
    at = weights.join(var, "rebal", "left").withColumn("gross", F.sum("w").over(gross))
    usable = (F.col("rows") >= least) & (F.col("names") >= 2) & (F.col("v") > 0)
    scale = F.when(usable, F.least(F.lit(target) / F.sqrt(F.col("v") * 252), F.lit(max_gross) / F.greatest("gross", F.lit(1e-9)))).otherwise(F.lit(max_gross))
    return at.select("rebal", "ticker", (F.col("w") * scale).alias("w"))


def drawdown_brake(equity: DataFrame, rebals: DataFrame, start: float = 0.06, depth: float = 0.06, most: float = 0.5) -> DataFrame:
    """(rebal, brake): full exposure down to a drawdown of `start`, then linearly less."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    dd = equity.select("date", (F.col("equity") / F.max("equity").over(w) - 1).alias("dd"))
    return dd.join(rebals, F.col("date") == F.col("rebal")).select("rebal", (1 - most * clip((-F.col("dd") - start) / depth, 0.0, 1.0)).alias("brake"))


def blended(before: DataFrame, new: DataFrame, share: float = 0.5, n: int = 30) -> DataFrame:
    """share of the old and the rest of the new weights, the n largest, renormalised: one step of turnover smoothing."""
    both = before.select("ticker", F.col("w").alias("o")).join(new.select("ticker", F.col("w").alias("x")), "ticker", "full")
    mixed = both.select("ticker", (share * F.coalesce("o", F.lit(0.0)) + (1 - share) * F.coalesce("x", F.lit(0.0))).alias("w"))
    kept = mixed.orderBy(F.col("w").desc(), "ticker").limit(n)
    return kept.select("ticker", (F.col("w") / F.sum("w").over(Window.partitionBy())).alias("w"))
