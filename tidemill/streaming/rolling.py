"""Streaming forms of panel inputs: daily bars of ticks with late data, as the batch panel makes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bars(ticks: DataFrame, late: str = "2 days") -> DataFrame:
    """(date, ticker, close mean, high, low, volume) of ticks (ts, ticker, price, volume); a day is final once the watermark is past it."""
    day = F.window("ts", "1 day")
    bars = ticks.withWatermark("ts", late).groupBy(day.alias("d"), "ticker").agg(F.avg("price").alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("volume").alias("volume"))
    return bars.select(F.to_date("d.start").alias("date"), "ticker", "close", "high", "low", "volume")
