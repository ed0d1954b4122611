"""Long-only backtest in closed form.

Between two rebalances the book is bought and held, so the value of a segment is its cash plus each weight times the
product of its growth since the segment began; costs depend on drifted weights, which do not depend on the value of
the book. So the whole backtest is running products over segments, and no recursion over days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPITAL, COST = 20_000_000.0, 0.001


def _growth(prices: DataFrame) -> DataFrame:
    """(date, ticker, close, g): growth of the day, 1 unless today's and yesterday's prices are known."""
    before = F.lag("close").over(Window.partitionBy("ticker").orderBy("date"))
    return prices.select("date", "ticker", "close", F.coalesce(F.col("close") / F.nullif(before, F.lit(0.0)), F.lit(1.0)).alias("g"))


def parts(prices: DataFrame, targets: DataFrame, rebals: DataFrame | None = None) -> dict[str, DataFrame]:
    """segments (k, rebal, tot), book (k, ticker, w), held (k, date, ticker, value), values (k, date, v), drifted (k, rebal, ticker, w_new, w_old).

    `rebals` lists all rebalances; one without targets sells everything. A target of a name without a price is dropped,
    and targets above one in sum are scaled down.
    """
    dates = (rebals or targets).select("rebal").distinct()
    k = dates.select("rebal", F.row_number().over(Window.orderBy("rebal")).alias("k"))  # rebalances: a date-level table
    priced = targets.join(prices.select(F.col("date").alias("rebal"), "ticker", "close"), ["rebal", "ticker"]).where(F.col("close").isNotNull() & (F.col("w") != 0))
    tot = F.sum("w").over(Window.partitionBy("rebal"))
    book = priced.withColumn("w", F.col("w") / F.greatest(tot, F.lit(1.0))).join(F.broadcast(k), "rebal").select("k", "rebal", "ticker", "w")
    segments = k.join(book.groupBy("rebal").agg(F.sum("w").alias("tot")), "rebal", "left").select("k", "rebal", F.coalesce("tot", F.lit(0.0)).alias("tot"))
    days = prices.select("date").distinct().join(F.broadcast(k), F.col("date") == F.col("rebal"), "left")
    # the segment whose return a day earns: the rebalances before it
    days = days.select("date", F.coalesce(F.max("k").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("k"))
    grown = _growth(prices).join(F.broadcast(days), "date").join(book.select("k", "ticker", "w"), ["k", "ticker"])
    run = Window.partitionBy("k", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = grown.select("k", "date", "ticker", (F.col("w") * F.exp(F.sum(F.log("g")).over(run))).alias("value"))
    worth = held.groupBy("k", "date").agg(F.sum("value").alias("assets"))
    values = days.join(F.broadcast(segments.select("k", "tot")), "k", "left").join(worth, ["k", "date"], "left")
    values = values.select("k", "date", (1 - F.coalesce("tot", F.lit(0.0)) + F.coalesce("assets", F.lit(0.0))).alias("v"))
    ends = segments.select(F.col("k").alias("k_new"), "rebal")
    old = held.join(F.broadcast(ends), held.date == ends.rebal).join(values.select("k", "date", "v"), ["k", "date"]).select(F.col("k_new").alias("k"), "rebal", "ticker", (F.col("value") / F.col("v")).alias("w_old"))
    drifted = book.select("k", "rebal", "ticker", F.col("w").alias("w_new")).join(old, ["k", "rebal", "ticker"], "full").na.fill(0.0, ["w_new", "w_old"])
    return {"segments": segments, "book": book, "held": held, "values": values, "drifted": drifted}


def turnover(p: dict[str, DataFrame]) -> DataFrame:
    """(rebal, turnover): the sum of absolute weight changes, both sides."""
    moved = p["drifted"].groupBy("k").agg(F.sum(F.abs(F.col("w_new") - F.col("w_old"))).alias("t"))
    return p["segments"].join(moved, "k", "left").select("k", "rebal", F.coalesce("t", F.lit(0.0)).alias("turnover"))


def trades(p: dict[str, DataFrame]) -> DataFrame:
    return p["drifted"].select("rebal", "ticker", (F.col("w_new") - F.col("w_old")).alias("weight_change")).where(F.abs("weight_change") > 1e-9)


def equity(prices: DataFrame, p: dict[str, DataFrame], capital: float = CAPITAL, cost: float = COST) -> DataFrame:
    """(date, equity), after the costs of the day."""
    t = turnover(p)
    ends = p["values"].join(F.broadcast(t.select(F.col("k").alias("k_new"), "rebal", "turnover")), F.col("date") == F.col("rebal"), "left")
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    keep = F.when(F.col("rebal").isNotNull(), F.log(F.col("v")) + F.log(1 - cost * F.col("turnover"))).otherwise(0.0)
    ran = ends.withColumn("base", F.sum(keep).over(so_far))  # a date-level table
    return ran.select("date", (capital * F.exp(F.col("base") + F.when(F.col("rebal").isNull(), F.log("v")).otherwise(0.0))).alias("equity"))


def weights(p: dict[str, DataFrame]) -> DataFrame:
    """(date, ticker, w): the drifted weight at the end of each day, after the day's trades."""
    hold = p["held"].join(p["values"], ["k", "date"]).select("date", "ticker", (F.col("value") / F.col("v")).alias("w"))
    on = p["segments"].select(F.col("rebal").alias("date"))
    return hold.join(F.broadcast(on), "date", "left_anti").unionByName(p["book"].select(F.col("rebal").alias("date"), "ticker", "w"))


def benchmark(market: DataFrame, capital: float = CAPITAL) -> DataFrame:
    """(date, equity) of buying and holding the market."""
    first = F.first("close", ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return market.where(F.col("close").isNotNull()).select("date", (capital * F.col("close") / first).alias("equity"))


def returns(curve: DataFrame) -> DataFrame:
    """(date, equity, ret), the first return 0."""
    return curve.select("date", "equity", F.coalesce(F.col("equity") / F.lag("equity").over(Window.orderBy("date")) - 1, F.lit(0.0)).alias("ret"))
