"""Features, targets, labels and sample weights of a dense panel (i, date, ticker, close, high, low, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import by_date, by_ticker, change, ffill, pct_rank, roll, safe_div

# Names of features.
RANKED = ("mom_1m", "mom_3m", "mom_6m", "mom_12m_1m", "mom_1w_rev", "vol_22", "vol_63", "vol_252", "dev_22", "ma_50_200", "resid_mom_12m_1m", "idio_vol_63", "mom_acc_3_12", "vol_change")
CONSENSUS = ("mom_12m_1m", "resid_mom_12m_1m", "mom_3m", "vol_252", "idio_vol_63")
#: The features that the production models take.
CURATED = (
    "mom_1m_xsrank", "mom_3m_xsrank", "mom_6m_xsrank", "mom_12m_1m_xsrank", "resid_mom_12m_1m_xsrank", "mom_1w_rev_xsrank", "ma_50_200_xsrank",
    "dev_22_xsrank", "vol_252_xsrank", "idio_vol_63_xsrank", "mom_12m_1m_xsrank_dev63", "resid_mom_12m_1m_xsrank_dev63", "vol_change_xsrank", "mom_acc_3_12_xsrank",
)
#: The ranks that the factor sum adds up.
FACTORS = ("mom_1m_xsrank", "mom_3m_xsrank", "mom_12m_1m_xsrank", "resid_mom_12m_1m_xsrank")


def with_returns(panel: DataFrame, fill: str = "pad") -> DataFrame:
    """Adds filled (the close carried forward) and ret, across gaps ("pad") or null at gaps ("none")."""
    out = panel.withColumn("filled", ffill("close"))
    return out.withColumn("ret", change("filled") if fill == "pad" else change("close"))


def raw_features(panel: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """All unlagged features that need one ticker's history (and the market's). Unused ones are pruned by the optimizer."""
    p = with_returns(panel)
    w = by_ticker()
    c = F.col("close")
    p = p.withColumns({f"mom_{n}": change("filled", k) for n, k in (("1m", 21), ("3m", 63), ("6m", 126), ("1w_rev", 5))})
    p = p.withColumn("mom_12m_1m", safe_div(F.lag(c, 21).over(w), F.lag(c, 252).over(w)) - 1)
    p = p.withColumns({f"vol_{n}": roll(F.stddev_samp, "ret", n) for n in (22, 63, 252)})
    p = p.withColumns({f"dev_{n}": safe_div(c - roll(F.avg, c, n), c) for n in (5, 22, 63, 252)})
    p = p.withColumn("ma_50_200", safe_div(roll(F.avg, c, 50) - roll(F.avg, c, 200), c))
    if "volume" in panel.columns:
        p = p.withColumn("dollar_volume_22", roll(F.avg, c * F.col("volume"), 22)).withColumn("log_dvol_22", F.log1p("dollar_volume_22"))
    if {"high", "low"} <= set(panel.columns):
        p = p.withColumn("hl_range_22", roll(F.avg, safe_div(F.col("high") - F.col("low"), c), 22))
    p = p.withColumns({
        "vol_ratio_22_252": safe_div(F.col("vol_22"), F.col("vol_252")),
        "mom_acc_3_12": F.col("mom_3m") - F.col("mom_12m_1m") / 4.0,
        "vol_change": safe_div(F.col("vol_22"), F.col("vol_63")),
    })
    return with_beta(p, market) if market is not None else p


def with_beta(p: DataFrame, market: DataFrame) -> DataFrame:
    """beta_252 (each day's returns centred on their own trailing means), residual momentum and idiosyncratic volatility. The market is a date-level table and is broadcast."""
    d = Window.orderBy("date")
    m = market.select("date", ffill("close", d).alias("__mc")).withColumn("mkt", change("__mc", 1, d))
    m = m.select("date", "mkt", (F.col("mkt") - roll(F.avg, "mkt", 252, over=d)).alias("mkt_dev"), roll(F.var_samp, "mkt", 252, over=d).alias("mkt_var"))
    p = p.join(F.broadcast(m), "date", "left")
    p = p.withColumn("__prod", (F.col("ret") - roll(F.avg, "ret", 252)) * F.col("mkt_dev"))
    p = p.withColumn("beta_252", safe_div(roll(F.avg, "__prod", 252), F.col("mkt_var")))
    p = p.withColumn("resid", F.col("ret") - F.col("beta_252") * F.col("mkt"))
    p = p.withColumn("__sum", roll(F.sum, "resid", 231)).withColumn("idio_vol_63", roll(F.stddev_samp, "resid", 63))
    return p.withColumn("resid_mom_12m_1m", F.lag("__sum", 21).over(by_ticker())).drop("__prod", "__sum")


def with_ranks(p: DataFrame, names: tuple[str, ...] = RANKED) -> DataFrame:
    """Cross-sectional ranks over each date. A date's names are unpivoted, so one window sorts (date, feature) groups instead of one window for each feature."""
    have = [n for n in names if n in p.columns]
    long = p.select("date", "ticker", F.explode(F.array(*(F.struct(F.lit(n).alias("f"), F.col(n).alias("x")) for n in have))).alias("s")).select("date", "ticker", "s.f", "s.x")
    ranked = long.select("date", "ticker", "f", pct_rank("x", "date", "f").alias("r"))
    wide = ranked.groupBy("date", "ticker").agg(*(F.max(F.when(F.col("f") == n, F.col("r"))).alias(f"{n}_xsrank") for n in have))
    return p.join(wide, ["date", "ticker"])


def with_consensus(p: DataFrame, names: tuple[str, ...] = CONSENSUS) -> DataFrame:
    """A rank less its trailing mean of 63 rows, at least 21 of them known."""
    have = [n for n in names if f"{n}_xsrank" in p.columns]
    return p.withColumns({f"{n}_xsrank_dev63": F.col(f"{n}_xsrank") - roll(F.avg, f"{n}_xsrank", 63, 21) for n in have})


def lagged(p: DataFrame, names: list[str]) -> DataFrame:
    """date, ticker and each feature as known the day before; rows without any are dropped."""
    out = p.select("date", "ticker", *(F.lag(n, 1).over(by_ticker()).alias(n) for n in names))
    return out.where(F.coalesce(*(F.col(n) for n in names)).isNotNull())


def build(panel: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """The whole feature panel: raw features, ranks and deviations, lagged one row."""
    p = with_consensus(with_ranks(raw_features(panel, market)))
    skip = {*panel.columns, "filled", "ret", "mkt", "mkt_dev", "mkt_var", "resid"}
    return lagged(p, [c for c in p.columns if c not in skip])


# Targets and labels


def forward_return(h: int = 21):
    return safe_div(F.lead("close", h).over(by_ticker()), F.col("close")) - 1


def residual_target(panel: DataFrame, h: int = 21) -> DataFrame:
    f = panel.select("date", "ticker", forward_return(h).alias("fwd"))
    return f.withColumn("y", F.col("fwd") - F.avg("fwd").over(by_date()))


def rank_target(panel: DataFrame, h: int = 21) -> DataFrame:
    return panel.select("date", "ticker", forward_return(h).alias("fwd")).withColumn("y", pct_rank("fwd", "date"))


def median_target(panel: DataFrame, h: int = 21) -> DataFrame:
    """1 above the date's median forward return, 0 at or below, null where unknown."""
    f = panel.select("date", "ticker", forward_return(h).alias("fwd"))
    return f.withColumn("y", F.when(F.col("fwd").isNotNull(), (F.col("fwd") > F.median("fwd").over(by_date())).cast("double")))


def triple_barrier(panel: DataFrame, horizon: int = 21, pt: float = 2.0, sl: float = 2.0, vol_window: int = 22, vertical_sign: bool = True) -> DataFrame:
    """1 or -1 by the barrier met first within the horizon, 0 if both are met at once, else the final return's sign. The last rows, and rows without price or volatility, are null."""
    if horizon < 1:
        raise ValueError("horizon must be 1 or more")
    p = with_returns(panel).withColumn("sigma", roll(F.stddev_samp, "ret", vol_window))
    ahead = by_ticker().rowsBetween(1, horizon)
    p = p.withColumn("path", F.collect_list(F.struct((F.col("i")).alias("k"), F.col("close").alias("c"))).over(ahead))
    p = p.withColumn("__n", F.max("i").over(Window.partitionBy("ticker")))
    r = lambda x: safe_div(x["c"], F.col("close")) - 1
    first = lambda hit: F.array_min(F.transform(F.filter("path", hit), lambda x: x["k"]))
    p = p.withColumns({
        "__up": F.coalesce(first(lambda x: r(x) >= pt * F.col("sigma")), F.lit(1 << 40)),
        "__down": F.coalesce(first(lambda x: r(x) <= -sl * F.col("sigma")), F.lit(1 << 40)),
        "__end": safe_div(F.lead("close", horizon).over(by_ticker()), F.col("close")) - 1,
    })
    none = F.coalesce(F.signum("__end"), F.lit(0.0)) if vertical_sign else F.lit(0.0)
    label = F.when(F.col("__up") < F.col("__down"), 1.0).when(F.col("__down") < F.col("__up"), -1.0).when(F.col("__up") < F.lit(1 << 40), 0.0).otherwise(none)
    known = F.col("close").isNotNull() & F.col("sigma").isNotNull() & (F.col("i") + horizon <= F.col("__n"))
    return p.select("date", "ticker", F.when(known, label).alias("label"))


def event_ends(dates: DataFrame, horizon: int = 21) -> DataFrame:
    """(date, t1): the date `horizon` rows later on the calendar, the last one at its end. A date-level table."""
    w = Window.orderBy("date")
    last = F.max("date").over(Window.partitionBy())
    return dates.select("date", F.coalesce(F.lead("date", horizon).over(w), last).alias("t1"))


def uniqueness_weights(samples: DataFrame, horizon: int = 21, half_life: float | None = None) -> DataFrame:
    """Weights of mean 1 that halve with every `half_life` calendar days of age."""
    newest = samples.agg(F.max("date").alias("__last"))
    aged = samples.join(F.broadcast(newest))  # one row
    w = F.lit(1.0 / horizon) * (F.pow(F.lit(0.5), F.date_diff("__last", "date") / float(half_life)) if half_life else F.lit(1.0))
    aged = aged.withColumn("w", w)
    mean = aged.agg(F.avg("w").alias("__mean"))
    return aged.join(F.broadcast(mean)).withColumn("w", F.col("w") / F.col("__mean")).drop("__mean", "__last")
