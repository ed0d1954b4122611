"""Price sources behind one interface, and the fetch that fills a cache with the tickers it lacks."""

from __future__ import annotations

import time
from collections.abc import Iterable
from datetime import date, timedelta
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panels import keep_last, normalise_ticker

SCHEMA = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double"
FIELDS = ["open", "high", "low", "close", "adj_close", "volume"]


class PriceSource(Protocol):
    """Where prices come from. `end` is exclusive; tickers are in the source's spelling (`-` for `.`); columns of SCHEMA that it lacks are null."""

    def fetch(self, spark: SparkSession, tickers: list[str], start: date, end: date) -> DataFrame: ...


class ParquetSource:
    """A source over long Parquet rows (date, ticker, ...). Network sources have the same one method."""

    def __init__(self, path: str):
        self.path = path

    def fetch(self, spark: SparkSession, tickers: list[str], start: date, end: date) -> DataFrame:
        rows = spark.read.parquet(self.path)
        return rows.where(F.col("date").between(F.lit(start), F.lit(end - timedelta(days=1))) & F.col("ticker").isin(tickers))


def _cached(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(SCHEMA + ", year int").parquet(path)


def _batch(spark: SparkSession, source: PriceSource, names: list[str], start: date, end: date) -> DataFrame:
    """One request, with the names that were asked for and the columns of SCHEMA."""
    asked = spark.createDataFrame([(n,) for n in names], "name string").select("name", normalise_ticker("name").alias("ticker"))
    rows = source.fetch(spark, sorted({n.replace(".", "-") for n in names}), start, end)
    fields = [(F.col(c) if c in rows.columns else F.lit(None)).cast("double").alias(c) for c in FIELDS]
    named = rows.join(F.broadcast(asked), "ticker").select(F.to_date("date").alias("date"), F.col("name").alias("ticker"), *fields)  # one batch of names
    return keep_last(named, ["date", "ticker"], F.coalesce("volume", F.lit(0.0)))


def fetch_prices(spark: SparkSession, source: PriceSource, tickers: Iterable[str], start: date, end: date, cache: str, batch: int = 50, pause: float = 0.5) -> DataFrame:
    """Rows of the tickers from `start` to `end` inclusive. Tickers that the cache lacks are requested first, with `end` exclusive.

    Requests have at most `batch` tickers and lie `pause` seconds apart. A request that fails is reported and skipped; its
    tickers stay missing, so the next call asks again. Rows of a request are appended to the cache at once: a call that
    is cut off keeps what it has. Fails if there is neither a cache nor a row. The tickers are a list of the caller's.
    """
    wanted = sorted(set(tickers))
    held = _cached(spark, cache)
    have = set() if held is None else {r.ticker for r in held.select("ticker").distinct().where(F.col("ticker").isin(wanted)).collect()}
    lacking = [t for t in wanted if t not in have]
    for k in range(0, len(lacking), batch):
        if k:
            time.sleep(pause)
        names = lacking[k : k + batch]
        try:
            rows = _batch(spark, source, names, start, end).withColumn("year", F.year("date"))
            rows.write.mode("append").partitionBy("year").parquet(cache)
        except Exception as e:  # whatever a source raises
            print(f"{len(names)} tickers skipped from {names[0]}: {type(e).__name__}")
    held = _cached(spark, cache)
    if held is None or (not have and held.limit(1).count() == 0):
        raise RuntimeError("no price could be fetched")
    inside = F.col("date").between(F.lit(start), F.lit(end)) & F.col("year").between(start.year, end.year)
    return held.where(inside & F.col("ticker").isin(wanted)).drop("year")
