"""Exposure scales from the market's trend, macro figures and forecasts, and as-of joins of macro figures. All tables are date-level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import change, clip, ema, roll


def _day():
    return Window.orderBy("date")


def trend_scale(market: DataFrame, sma: int = 200, dd_window: int = 252, dd: float = 0.08, smooth: int = 5) -> DataFrame:
    """(date, scale): 0.4, and 0.3 each for a price above its mean and near its peak, smoothed."""
    c = F.col("close")
    above = F.coalesce(c > roll(F.avg, c, sma, sma // 2, _day()), F.lit(False))
    near = F.coalesce(c / roll(F.max, c, dd_window, dd_window // 2, _day()) - 1 > -dd, F.lit(False))
    raw = market.select("date", (0.4 + 0.3 * above.cast("double") + 0.3 * near.cast("double")).alias("raw"))
    return raw.select("date", clip(ema("raw", smooth, "date") if smooth > 1 else F.col("raw"), 0.0, 1.0).alias("scale"))


def macro_scale(macro: DataFrame, infl_high: float = 5.0, rgdp_low: float = 0.005, spread_low: float = -1.0) -> DataFrame:
    """(date, scale): 0.5 to 1 by three flags. A missing column is fine; a null value is adverse."""
    def flag(name: str, test) -> Column:
        return F.coalesce(test(F.col(name)).cast("double"), F.lit(0.0)) if name in macro.columns else F.lit(1.0)

    flags = flag("infl", lambda x: x < infl_high) + flag("rGDP_growth", lambda x: x > rgdp_low) + flag("yield_spread", lambda x: x > spread_low)
    return macro.select("date", clip(0.5 + 0.5 * flags / 3.0, 0.5, 1.0).alias("scale"))


def forecast_scale(forecast: DataFrame, dates: DataFrame, low: float = -0.02, high: float = 0.005, floor: float = 0.7) -> DataFrame:
    """(date, scale): a ramp from `floor` to 1 over the last forecast (date, value) at or before each date."""
    at = asof(dates, forecast.select("date", F.struct("value").alias("row")))
    return at.select("date", (floor + (1 - floor) * clip((F.col("row.value") - low) / (high - low), 0.0, 1.0)).alias("scale"))


def composed(*scales: DataFrame) -> DataFrame:
    """The product of scales, missing ones 1, within 0 and 1."""
    out = scales[0].select("date", F.col("scale").alias("s0"))
    for k, s in enumerate(scales[1:], 1):
        out = out.join(s.select("date", F.col("scale").alias(f"s{k}")), "date", "left")
    product = F.lit(1.0)
    for k in range(len(scales)):
        product = product * F.coalesce(f"s{k}", F.lit(1.0))
    return out.select("date", clip(product, 0.0, 1.0).alias("scale"))


def asof(dates: DataFrame, rows: DataFrame) -> DataFrame:
    """The last row (date, row: a struct) at or before each date, taken as it is, nulls included."""
    both = dates.select("date", F.lit(False).alias("mark"), F.lit(None).cast(rows.schema["row"].dataType).alias("row")).unionByName(rows.select("date", F.lit(True).alias("mark"), "row"))
    w = Window.orderBy("date", F.col("mark").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("row", F.last(F.when(F.col("mark"), F.col("row")), ignorenulls=True).over(w)).where(~F.col("mark")).select("date", "row")


def macro_derived(year: DataFrame) -> DataFrame:
    """Growth rates, yield spread, deviations from five-year means and the real rate, as far as their inputs are there."""
    y = Window.orderBy("year")
    out = year
    have = set(year.columns)
    for c in ("rGDP", "rGDP_pc", "M2", "HPI", "CPI"):
        if c in have:
            out = out.withColumn(f"__{c}", F.last(c, ignorenulls=True).over(y.rowsBetween(Window.unboundedPreceding, 0))).withColumn(f"{c}_growth", change(f"__{c}", 1, y)).drop(f"__{c}")
    if {"ltrate", "cbrate"} <= have:
        out = out.withColumn("yield_spread", F.col("ltrate") - F.col("cbrate")).withColumn("yc_inverted", F.coalesce((F.col("yield_spread") < 0).cast("double"), F.lit(0.0)))
    for c in ("infl", "unemp", "cbrate", "ltrate", "yield_spread"):
        if c in out.columns:
            out = out.withColumn(f"{c}_dev5y", F.col(c) - roll(F.avg, c, 5, 2, y))
    if {"cbrate", "infl"} <= have:
        out = out.withColumn("real_rate", F.col("cbrate") - F.col("infl"))
    return out


def macro_daily(year: DataFrame, dates: DataFrame, lag_months: int = 4) -> DataFrame:
    """Each date's last published year: a year's figures are known `lag_months` after its end."""
    names = [c for c in year.columns if c != "year"]
    known = year.select(F.add_months(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), lag_months).alias("date"), F.struct("year", *names).alias("row"))
    return asof(dates, known).select("date", "row.*")
