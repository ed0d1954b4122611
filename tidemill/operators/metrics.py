"""Performance statistics of a curve (date, equity, ret): date-level tables, so windows may be one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import kurtosis, norm_cdf, roll, safe_div, skewness

YEAR = 252


def _past():
    return Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def annual_return(ret, n):
    """Of a group: the product of 1 + ret to the power of a year; -1 where all is lost."""
    whole = F.product(1 + ret)
    return F.when(whole > 0, F.pow(whole, YEAR / n) - 1).when(n > 0, F.lit(-1.0))


def drawdown(curve: DataFrame) -> DataFrame:
    return curve.select("date", "equity", F.max("equity").over(_past()).alias("peak")).select("date", "equity", "peak", (F.col("equity") / F.col("peak") - 1).alias("dd"))


def max_drawdown(curve: DataFrame) -> DataFrame:
    """One row: depth, the trough's date (first on ties), and the date of the peak before it."""
    d = drawdown(curve)
    low = d.agg(F.min_by(F.struct("dd", "date", "peak"), F.struct("dd", "date")).alias("x")).select("x.*").withColumnsRenamed({"dd": "depth", "date": "trough", "peak": "__top"})
    top = curve.join(F.broadcast(low), (F.col("equity") == F.col("__top")) & (F.col("date") <= F.col("trough")))
    return top.groupBy("depth", "trough").agg(F.min("date").alias("peak"))


def drawdown_duration(curve: DataFrame) -> DataFrame:
    """One row: the longest run of rows below the peak so far."""
    d = drawdown(curve).withColumn("under", F.col("equity") < F.col("peak"))
    runs = d.withColumn("run", F.sum((~F.col("under")).cast("int")).over(_past())).where("under").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return runs.agg(F.coalesce(F.max("n"), F.lit(0)).alias("duration"))


def moments(curve: DataFrame) -> DataFrame:
    """One row: n, mean, sd, skew and excess kurtosis (bias-corrected), and the annualised Sharpe ratio."""
    return curve.agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), skewness("ret").alias("skew"), kurtosis("ret").alias("kurt"),
    ).withColumn("sharpe", safe_div(F.col("mean"), F.col("sd")) * F.sqrt(F.lit(float(YEAR))))


def summary(curve: DataFrame, rf: float = 0.0) -> DataFrame:
    """(metric, value): the eight figures of a curve."""
    r, n = F.col("ret"), F.count("ret")
    one = curve.agg(
        annual_return(r, n).alias("ar"), (F.stddev_samp("ret") * F.sqrt(F.lit(float(YEAR)))).alias("av"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"),
        F.sqrt(F.avg(F.pow(F.least(r - rf / YEAR, F.lit(0.0)), F.lit(2.0)))).alias("down"),
        (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total"),
    )
    one = one.join(F.broadcast(max_drawdown(curve).select("depth"))).join(F.broadcast(drawdown_duration(curve)))  # one row each
    root = F.sqrt(F.lit(float(YEAR)))
    rows = {
        "Annualized Return": F.col("ar"), "Annualized Vol": F.col("av"), "Sharpe": safe_div(F.col("m") - rf / YEAR, F.col("s")) * root,
        "Sortino": safe_div(F.col("m") - rf / YEAR, F.col("down")) * root, "Calmar": safe_div(F.col("ar"), F.abs("depth")),
        "Max Drawdown": F.col("depth"), "Max DD Duration (days)": F.col("duration").cast("double"), "Total Return": F.col("total"),
    }
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in rows.items()))).alias("x")).select("x.*")


def rolling_sharpe(curve: DataFrame, n: int = 126) -> DataFrame:
    d = Window.orderBy("date")
    return curve.select("date", (safe_div(roll(F.avg, "ret", n, over=d), roll(F.stddev_samp, "ret", n, over=d)) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"))


def probabilistic_sharpe(curve: DataFrame, benchmark: float = 0.0) -> DataFrame:
    """The probability that the true ratio exceeds the benchmark, with the annualised ratio and excess kurtosis over four."""
    m = moments(curve)
    sr = F.col("sharpe")
    z = (sr - benchmark) * F.sqrt(F.col("n") - 1.0) / F.sqrt(1 - F.col("skew") * sr + F.col("kurt") / 4 * sr * sr)
    return m.select(sr.alias("sharpe"), norm_cdf(z).alias("psr"))


def deflated_sharpe(curve: DataFrame, trials: int = 15) -> DataFrame:
    """As probabilistic_sharpe(), against the ratio expected of the best of some trials, sqrt(2 ln N) standard errors."""
    m = moments(curve)
    sr = F.col("sharpe")
    se = F.sqrt((1 - F.col("skew") * sr + F.col("kurt") / 4 * sr * sr) / (F.col("n") - 1.0))
    best = F.sqrt(2 * F.log(F.lit(float(trials)))) * se
    return m.select(best.alias("expected_max"), norm_cdf((sr - best) / se).alias("dsr"))


def portfolio_correlation(weights: DataFrame, returns: DataFrame, window: int = 63, thin: int = 5, active: float = 1e-6) -> DataFrame:
    """(date, ipc): the weighted mean pairwise correlation of the held names, renewed on every `thin`-th row and carried on.

    With weights of sum one and standardised returns z, the sum of all pairs is the variance of the weighted z less the
    squares of the weights, so no pair is formed. Returns carry i (from 1) and count as 0 where unknown.
    """
    at = returns.select("i", "date").distinct().where((F.col("i") > window) & ((F.col("i") - 1) % thin == 0))
    held = weights.where(F.col("w") > active).join(F.broadcast(at), "date").select(F.col("date").alias("at"), F.col("i").alias("top"), "ticker", "w")
    sums = held.groupBy("at").agg(F.sum("w").alias("sw"), F.count(F.lit(1)).alias("names"))
    held = held.join(F.broadcast(sums), "at").where("names >= 2").select("at", "top", "ticker", (F.col("w") / F.col("sw")).alias("w"))
    spread = held.select("at", "ticker", "w", F.explode(F.sequence(F.col("top") - window + 1, F.col("top"))).alias("i"))
    long = spread.join(returns.select("i", "ticker", F.coalesce("ret", F.lit(0.0)).alias("r")), ["i", "ticker"])
    g = Window.partitionBy("at", "ticker")
    z = long.withColumn("z", safe_div(F.col("r") - F.avg("r").over(g), F.stddev_pop("r").over(g)))
    # one chain of groups: the weighted sum of each row, then its variance; a name without variance leaves a date unknown
    rows = z.groupBy("at", "i").agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"), (F.count("z") < F.count(F.lit(1))).alias("flat"))
    some = rows.groupBy("at").agg(F.var_pop("s").alias("v"), F.max("q").alias("q"), F.max("flat").alias("flat"))
    some = some.select("at", F.when(~F.col("flat"), (F.col("v") - F.col("q")) / (1 - F.col("q"))).alias("x"))
    days = returns.select("i", "date").distinct().join(F.broadcast(some), F.col("date") == F.col("at"), "left").join(F.broadcast(sums.select(F.col("at").alias("__a"), "names")), F.col("date") == F.col("__a"), "left")
    renewed = (F.col("i") > window) & ((F.col("i") - 1) % thin == 0)
    value = F.when(renewed, F.when(F.coalesce("names", F.lit(0)) < 2, F.lit(0.0)).otherwise(F.col("x")))
    return days.select("date", F.last(value, ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("ipc"))


def block_bootstrap(curve: DataFrame, block: int = 20, boots: int = 2000, seed: int = 0) -> DataFrame:
    """(boot, sharpe): the ratio of resampled blocks, whose starts are hashes of (seed, boot, block). The curve has one row per day and is broadcast."""
    rows = curve.select((F.row_number().over(Window.orderBy("date")) - 1).alias("row"), "ret")
    n = curve.count()
    blocks = -(-n // block)
    starts = curve.sparkSession.range(boots).select(F.col("id").alias("boot"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    starts = starts.select("boot", "b", F.pmod(F.xxhash64(F.lit(seed), "boot", "b"), F.lit(max(1, n - block + 1))).alias("s"))
    drawn = starts.select("boot", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"), "b", "s").where(F.col("b") * block + F.col("k") < n).select("boot", (F.col("s") + F.col("k")).alias("row"))
    return drawn.join(F.broadcast(rows), "row").groupBy("boot").agg((safe_div(F.avg("ret"), F.stddev_pop("ret")) * F.sqrt(F.lit(float(YEAR)))).alias("sharpe"))


def constraints(curve: DataFrame, weights: DataFrame) -> DataFrame:
    """(check, passed) of the limits on drawdown, duration, total return and gross exposure."""
    m = summary(curve).groupBy().pivot("metric", ["Max Drawdown", "Max DD Duration (days)", "Total Return"]).agg(F.first("value"))
    g = weights.groupBy("date").agg(F.sum("w").alias("g")).agg(F.coalesce(F.max("g"), F.lit(0.0)).alias("gross"))
    both = m.join(F.broadcast(g))
    rows = {"max_drawdown": F.col("Max Drawdown") > -0.20, "duration": F.col("Max DD Duration (days)") < 126, "total_return": F.col("Total Return") > 0, "gross": F.col("gross") <= 1.001}
    return both.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in rows.items()))).alias("x")).select("x.*")


def describe(rows: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row per column: count, mean, sample deviation, min, quartiles, max of the values that are known. Exact quartiles (interpolated) hold the distinct values of a column in memory; `exact=False` takes bounded sketches."""
    shares = F.array(*(F.lit(x) for x in (0.25, 0.5, 0.75)))
    long = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "name", "value").where(F.col("value").isNotNull())
    quartiles = F.percentile("value", shares) if exact else F.percentile_approx("value", shares, 10000)
    found = long.groupBy("name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("low"), quartiles.alias("q"), F.max("value").alias("high"))
    return found.select("name", "n", "mean", "std", "low", *(F.col("q")[k].alias(f"p{p}") for k, p in enumerate((25, 50, 75))), "high")
