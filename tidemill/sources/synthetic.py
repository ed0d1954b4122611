"""A synthetic price panel: one market factor, drifting names, returns that remember the day before."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "i long, date date, ticker string, close double, high double, low double, volume double"
# The distributions of the model.
START = date(2018, 1, 2)
MARKET = (0.0004, 0.012)
BETA = (0.5, 1.6)
NOISE = (0.01, 0.025)
MEMORY = 0.05
DRIFT = 0.0005
SPREAD = 0.005
VOLUME = (15.0, 0.5)


def series(asset: int, days: int, seed: int) -> pd.DataFrame:
    """One asset's columns. The market's generator depends on the seed alone, the asset's on seed and asset, so any task makes the same rows."""
    market = np.random.default_rng(seed).normal(*MARKET, size=days)
    rng = np.random.default_rng((seed, asset + 1))
    shock = rng.uniform(*BETA) * market + rng.normal(0, rng.uniform(*NOISE), size=days)
    moves = np.empty(days)
    last = 0.0
    for t in range(days):
        last = moves[t] = shock[t] + MEMORY * last
    # half of each day's step of the drift's random walk, the first day without one
    steps = rng.normal(0, DRIFT, size=days)
    steps[:1] = 0.0
    close = 100 * np.exp(np.cumsum(moves + steps / 2))
    up, down = np.abs(rng.normal(0, SPREAD, size=(2, days)))
    return pd.DataFrame({
        "i": np.arange(1, days + 1), "date": pd.bdate_range(START, periods=days).date, "ticker": f"S{asset:03d}",
        "close": close, "high": close * (1 + up), "low": close * (1 - down), "volume": rng.lognormal(*VOLUME, size=days),
    })


def synthetic_panel(spark: SparkSession, days: int = 2016, assets: int = 60, seed: int = 0) -> DataFrame:
    """A dense panel of `assets` names over `days` business days; a task holds one asset's rows at a time."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for asset in batch["id"]:
                yield series(int(asset), days, seed)

    return spark.range(assets).mapInPandas(make, SCHEMA)
