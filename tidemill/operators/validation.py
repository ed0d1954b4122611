"""Models over cross-validation splits: checked samples, scores by split, their spread, and a search that stops hopeless trials."""

from __future__ import annotations

import random
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from statistics import median

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import kept
from . import models

KEY = ["date", "ticker"]


def samples_of(rows: DataFrame, ends: DataFrame, on: list[str] | None = None) -> DataFrame:
    """(date, ticker, t1): the rows' keys with their event ends. Rows with no end, a second one, an end before their date, or a repeated key are errors."""
    on = on or (KEY if "ticker" in ends.columns else ["date"])
    both = rows.select(*KEY).join(ends.select(*on, "t1"), on, "left").select(*KEY, "t1")
    check_samples(both)
    return both


def check_samples(samples: DataFrame) -> None:
    """Raises ValueError unless samples have date, ticker and t1, each key once, and t1 at or after the date."""
    absent = [c for c in (*KEY, "t1") if c not in samples.columns]
    if absent:
        raise ValueError(f"samples lack {absent}")
    keys = samples.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("t1").alias("low"), F.count("t1").alias("known"))
    one = keys.agg(F.count_if(F.col("n") > 1), F.count_if(F.col("known") < F.col("n")), F.count_if(F.col("low") < F.col("date")), F.count_if(F.col("date").isNull() | F.col("ticker").isNull())).first()
    wrong = {what: n for what, n in zip(("repeated keys", "keys without an event end", "ends before the date", "null keys"), one) if n}
    if wrong:
        raise ValueError(f"samples do not fit their events: {wrong}")


def score_of(scored: DataFrame, label: str, metric: str) -> float | None:
    """ic, auc, or the f1 of calls above one half."""
    if metric == "ic":
        return models.information_coefficient(scored, target=label).first()["ic"]
    if metric == "auc":
        return models.auc(scored.where(F.col("score").isNotNull() & F.col(label).isNotNull()), label=label).first()["auc"]
    return models.classification_report(scored, label=label).first()["f1"] or 0.0


def evaluate(rows: DataFrame, roles: DataFrame, fit: Callable[[DataFrame], models.Fitted], metric: str = "ic", label: str = "y", least: tuple[int, int] = (5000, 500), threads: int = 4) -> DataFrame:
    """(split, n_train, n_test, score) of the splits whose training and test rows number at least `least`; the rest are left out.

    `roles` is a splitter's (split, date, ticker, role). The joined rows are stored once, and up to `threads` splits are fitted at a time.
    """
    spark = rows.sparkSession
    with kept(spark) as keep:
        both = keep(roles.where("role in ('train', 'test')").select("split", *KEY, "role").join(rows, KEY).sortWithinPartitions("split"))
        sizes = both.groupBy("split").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b"))
        todo = [(r.split, r.a, r.b) for r in sizes.orderBy("split").collect() if r.a >= least[0] and r.b >= least[1]]  # a few splits

        def one(item: tuple[int, int, int]) -> tuple:
            split, a, b = item
            part = both.where(F.col("split") == split)
            fitted = fit(part.where("role = 'train'"))
            return int(split), a, b, score_of(fitted.predict(part.where("role = 'test'")), label, metric)

        with ThreadPool(max(1, min(threads, len(todo) or 1))) as pool:
            out = pool.map(inheritable_thread_target(spark)(one), todo, chunksize=1)
    return spark.createDataFrame(out, "split int, n_train long, n_test long, score double")


def spread(scores: DataFrame) -> DataFrame:
    """One row: number of splits, mean, population deviation, least and greatest score."""
    return scores.agg(F.count("score").alias("splits"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"))


class MedianRule:
    """Stops a trial whose best running mean so far lies below the median of what finished trials had at the same step, once `startup` have finished and `warmup` steps are over."""

    def __init__(self, startup: int = 5, warmup: int = 0):
        self.startup, self.warmup, self.finished = startup, warmup, []

    def hopeless(self, means: list[float]) -> bool:
        step = len(means) - 1
        others = [m[step] for m in self.finished if len(m) > step]
        return len(self.finished) >= self.startup and step >= self.warmup and bool(others) and max(means) < median(others)

    def done(self, means: list[float]) -> None:
        self.finished.append(means)


def draw(space: dict, rng: random.Random) -> dict:
    """A choice for each setting: from a list, or from (low, high), whole where both are."""
    pick = lambda v: rng.choice(v) if isinstance(v, list) else rng.randint(*v) if all(isinstance(x, int) for x in v) else rng.uniform(*v)
    return {name: pick(values) for name, values in space.items()}


def folds_of(rows: DataFrame, roles: DataFrame, least: tuple[int, int]) -> list[DataFrame]:
    """The rows of each split with their role, where training and test rows number at least `least`."""
    sizes = roles.groupBy("split").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b")).orderBy("split").collect()  # a few splits
    return [roles.where(F.col("split") == r.split).select(*KEY, "role").join(rows, KEY) for r in sizes if r.a >= least[0] and r.b >= least[1]]


def trial(folds: list[DataFrame], fit: Callable[[DataFrame], models.Fitted], metric: str, label: str, rule: MedianRule) -> tuple[int, float | None, str]:
    """(folds scored, mean score, state): fold after fold until the rule gives up. An unknown score counts as 0; without a fold the trial is pruned."""
    means: list[float] = []
    for part in folds:
        found = score_of(fit(part.where("role = 'train'")).predict(part.where("role = 'test'")), label, metric) or 0.0
        means.append(((means[-1] if means else 0.0) * len(means) + found) / (len(means) + 1))
        if rule.hopeless(means):
            return len(means), None, "pruned"
    if not means:
        return 0, None, "pruned"
    rule.done(means)
    return len(means), means[-1], "complete"


def search(rows: DataFrame, roles: DataFrame, features: list[str], space: dict, trials: int = 30, seed: int = 42, label: str = "y", metric: str = "ic", least: tuple[int, int] = (1, 1), rule: MedianRule | None = None) -> DataFrame:
    """Settings of boosted trees by seeded uniform draws: (trial, params, folds, score, state), the score a mean over splits. metric ic is for regressors, auc and f1 for classifiers."""
    rng, rule, out = random.Random(seed), rule or MedianRule(), []
    with kept(rows.sparkSession) as keep:
        folds = folds_of(keep(rows), keep(roles), least)
        for number in range(trials):
            params = draw(space, rng)
            out.append((number, repr(params), *trial(folds, lambda t, p=params: models.fit_boosted(t, features, label, classify=metric != "ic", **p), metric, label, rule)))
    return rows.sparkSession.createDataFrame(out, "trial int, params string, folds int, score double, state string")


def search_calls(scored: DataFrame, roles: Callable[[DataFrame], DataFrame], features: list[str], space: dict, trials: int = 25, seed: int = 42, label: str = "y", thresholds: tuple[float, float] = (0.5, 0.7), calls: tuple[int, int] = (200, 50), least: tuple[int, int] = (100, 30), rule: MedianRule | None = None) -> DataFrame:
    """Settings of the meta model together with the base model's threshold: (trial, threshold, params, folds, score, state).

    `scored` holds p_base. Each trial draws a threshold and settings, keeps the long calls, and scores the F1 of "the call
    comes true" over the splits that `roles` makes of the calls. A trial with fewer calls or true ones than `calls`, without a
    split of at least `least` rows, or that the rule gives up, is pruned. Draws are seeded and uniform.
    """
    rng, rule, out = random.Random(seed), rule or MedianRule(warmup=1), []
    with kept(scored.sparkSession) as keep:
        base = keep(scored)
        for number in range(trials):
            threshold, params = rng.uniform(*thresholds), draw(space, rng)
            long = models.meta_features(base, threshold).where("base_side = 1").withColumn("__meta", F.col(label).cast("double"))
            n, true = long.agg(F.count(F.lit(1)), F.coalesce(F.sum("__meta"), F.lit(0.0))).first()
            folds = folds_of(long := keep(long), keep(roles(long)), least) if n >= calls[0] and true >= calls[1] else []
            out.append((number, threshold, repr(params), *trial(folds, lambda t, p=params: models.fit_boosted(t, features, "__meta", classify=True, **p), "f1", "__meta", rule)))
    return scored.sparkSession.createDataFrame(out, "trial int, threshold double, params string, folds int, score double, state string")
