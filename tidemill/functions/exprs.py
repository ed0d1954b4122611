"""Column expressions for panels: strict rolling windows, tie-averaged ranks, padded returns and a few scalar functions.

`by_ticker()` orders a ticker's rows by date; a panel is dense (every ticker has a row on every calendar date), so a
lag of k rows is a lag of k trading days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Coefficients of Abramowitz and Stegun 7.1.26 for erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def by_date() -> WindowSpec:
    return Window.partitionBy("date")


def trailing(n: int, over: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, the current one included."""
    return (over or by_ticker()).rowsBetween(-(n - 1), 0)


def roll(agg: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None, over: WindowSpec | None = None) -> Column:
    """A trailing aggregate that is null unless the window holds `least` values (n by default)."""
    x = F.col(x) if isinstance(x, str) else x
    w = trailing(n, over)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def ffill(x: Column | str, over: WindowSpec | None = None) -> Column:
    return F.last(x, ignorenulls=True).over((over or by_ticker()).rowsBetween(Window.unboundedPreceding, 0))


def bfill(x: Column | str, over: WindowSpec | None = None) -> Column:
    return F.first(x, ignorenulls=True).over((over or by_ticker()).rowsBetween(0, Window.unboundedFollowing))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def change(x: Column | str, k: int = 1, over: WindowSpec | None = None) -> Column:
    """x over its value k rows ago, less one; x must be filled already where padding is wanted."""
    x = F.col(x) if isinstance(x, str) else x
    return safe_div(x, F.lag(x, k).over(over or by_ticker())) - 1


def clip(x: Column, low: float, high: float) -> Column:
    """Bounds that keep nulls, which least() and greatest() alone would not."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def pct_rank(x: Column | str, *group: str) -> Column:
    """Rank over the non-null count, ties at their average; null stays null. One sort serves rank and peers."""
    x = F.col(x) if isinstance(x, str) else x
    parts = Window.partitionBy(*group)
    order = parts.orderBy(x.asc_nulls_last())
    peers = F.count(x).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(order) + (peers - 1) / 2.0) / F.count(x).over(parts))


def zscore(x: Column | str, *group: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(*group)
    return safe_div(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


def norm_cdf(x: Column) -> Column:
    """The normal distribution function by a polynomial for erf; its error is below 2e-7."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.when(x < 0, -erf).otherwise(erf))


def norm_cdf_sql(x: str) -> str:
    """norm_cdf() as SQL text."""
    z = f"(abs({x}) / sqrt(2.0))"
    t = f"(1 / (1 + {ERF_P} * {z}))"
    poly = "0.0"
    for a in reversed(ERF_A):
        poly = f"(({poly} + {a}) * {t})"
    return f"(0.5 * (1 + CASE WHEN {x} < 0 THEN -1 ELSE 1 END * (1 - {poly} * exp(-{z} * {z}))))"


def ema(x: str, span: int, order: str) -> Column:
    """Exponential mean without adjustment, of a whole date-level series (a fold over each row's history)."""
    alpha = 2.0 / (span + 1)
    past = F.collect_list(x).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return F.aggregate(F.slice(past, F.lit(2), F.size(past)), F.get(past, F.lit(0)), lambda acc, v: acc * (1 - alpha) + v * alpha)


def skewness(x: Column | str) -> Column:
    """Bias-corrected sample skewness of a group."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(x: Column | str) -> Column:
    """Bias-corrected sample excess kurtosis of a group."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))
