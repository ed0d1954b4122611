"""Models on pyspark.ml, their scores and their evaluation."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import norm_cdf, pct_rank
from .splits import elapsed

#: Presets of boosted trees: rounds, depth, rate, share of rows, of columns, least rows of a leaf.
PRESETS = {
    "xgb": {"maxIter": 60, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 80, "seed": 42},
    "lgbm": {"maxIter": 60, "maxDepth": 5, "stepSize": 0.08, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 40, "seed": 43},
    "ranker": {"maxIter": 60, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "seed": 42},
}


@dataclass
class Fitted:
    """A fitted model with the features that it needs; predict() adds `score`."""

    name: str
    features: list[str]
    model: object
    seconds: float = 0.0
    scaling: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame, column: str = "score") -> DataFrame:
        known = rows.na.drop(subset=self.features)
        ready = _assembled(_scaled(known, self.scaling), self.features)
        made = self.model.transform(ready)
        value = vector_to_array("probability")[1] if "probability" in made.columns else F.col("prediction")
        drop = [c for c in ("__x", "rawPrediction", "probability", "prediction") if c in made.columns]
        kept = made.withColumn(column, value).drop(*drop)
        if not self.scaling:
            return kept
        return kept.withColumns({c: F.col(c) * s + m for c, (m, s) in self.scaling.items()})


def _assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x").transform(rows)


def _scaled(rows: DataFrame, scaling: dict) -> DataFrame:
    return rows.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaling.items()}) if scaling else rows


def standardised(rows: DataFrame, features: list[str]) -> dict:
    """(mean, population deviation) of each feature."""
    one = rows.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(features))).first()
    return {c: (one[f"m{k}"], one[f"s{k}"] or 1.0) for k, c in enumerate(features)}


def fit_boosted(rows: DataFrame, features: list[str], label: str = "y", preset: str = "xgb", classify: bool = False, weight: str | None = None, validation: str | None = None, **more) -> Fitted:
    """Boosted trees; `validation` names a boolean column of rows to stop on."""
    began = time.time()
    known = _assembled(rows.na.drop(subset=[*features, label]), features)
    maker = (GBTClassifier if classify else GBTRegressor)(featuresCol="__x", labelCol=label, **(PRESETS[preset] | more))
    if weight:
        maker = maker.setWeightCol(weight)
    if validation:
        maker = maker.setValidationIndicatorCol(validation)
    return Fitted(preset, features, maker.fit(known), time.time() - began)


def fit_linear(rows: DataFrame, features: list[str], label: str = "y", alpha: float = 1.0, l1_ratio: float = 0.0) -> Fitted:
    """Ridge (alpha as a penalty on the sum of squares) or, with l1_ratio, elastic net (on the mean) over standardised features.

    The library divides penalties by the label's deviation, so they are multiplied by it here.
    """
    began = time.time()
    known = rows.na.drop(subset=[*features, label])
    scaling = standardised(known, features)
    n, sd = known.agg(F.count(F.lit(1)), F.stddev_pop(label) if not l1_ratio else F.stddev_samp(label)).first()
    if not l1_ratio:
        maker = LinearRegression(featuresCol="__x", labelCol=label, solver="normal", regParam=alpha / n * sd, elasticNetParam=0.0, standardization=False)
    else:
        lam = alpha * (l1_ratio + (1 - l1_ratio) * sd)
        maker = LinearRegression(featuresCol="__x", labelCol=label, solver="l-bfgs", maxIter=500, tol=1e-10, regParam=lam, elasticNetParam=alpha * l1_ratio / lam, standardization=False)
    model = maker.fit(_assembled(_scaled(known, scaling), features))
    return Fitted("elastic_net" if l1_ratio else "ridge", features, model, time.time() - began, scaling)


def information_coefficient(scored: DataFrame, score: str = "score", target: str = "y", mode: str = "pooled") -> DataFrame:
    """One row: the correlation of daily ranks, pooled, or averaged over days."""
    both = scored.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select("date", pct_rank(score, "date").alias("a"), pct_rank(target, "date").alias("b"))
    def corr():
        va, vb = F.var_pop("a"), F.var_pop("b")
        return F.when((va > 0) & (vb > 0), F.covar_pop("a", "b") / F.sqrt(va * vb))
    if mode == "pooled":
        return both.agg(corr().alias("ic"))
    return both.groupBy("date").agg(corr().alias("ic")).agg(F.avg("ic").alias("ic"))


def rank_mean(weights: dict[str, float]):
    """The weighted mean of the daily ranks of columns; those of weight 0 are left out."""
    used = {c: w for c, w in weights.items() if w}
    if not used:
        raise ValueError("no model has a weight")
    return sum((pct_rank(c, "date") * w for c, w in used.items()), F.lit(0.0)) / sum(used.values())


def factor_rank(plus: list[str]):
    """The daily rank of the sum of columns, missing ones left out."""
    some = F.coalesce(*plus).isNotNull()
    total = sum((F.coalesce(c, F.lit(0.0)) for c in plus), F.lit(0.0))
    return pct_rank(F.when(some, total), "date")


def ensemble(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted mean of the daily ranks of score columns; columns of weight 0 are left out."""
    return scored.select("date", "ticker", rank_mean(weights).alias("score"))


def factor_score(ranked: DataFrame, plus: list[str]) -> DataFrame:
    """The rank of the sum of feature ranks, missing ones left out."""
    return ranked.select("date", "ticker", factor_rank(plus).alias("score"))


def blend(rows: DataFrame, parts: dict[str, float]) -> DataFrame:
    return rows.select("date", "ticker", sum((F.col(c) * w for c, w in parts.items()), F.lit(0.0)).alias("score"))


def fit_named(rows: DataFrame, features: list[str], name: str, label: str = "y", **more) -> Fitted:
    """The regressor of that name; `more` are settings of boosted trees."""
    if name == "ridge":
        return fit_linear(rows, features, label)
    return fit_linear(rows, features, label, 0.001, 0.3) if name == "elastic_net" else fit_boosted(rows, features, label, name, **more)


def compare(train: DataFrame, valid: DataFrame, features: list[str], names: tuple[str, ...] = ("ridge", "elastic_net", "xgb", "lgbm"), label: str = "y", **more) -> tuple[DataFrame, dict[str, Fitted]]:
    """(leaderboard: model, train_ic, val_ic, fit_time_s; the fitted models)."""
    fits, rows = {}, []
    for name in names:
        fits[name] = fit_named(train, features, name, label, **more)
        ics = [information_coefficient(fits[name].predict(part), target=label).first()["ic"] for part in (train, valid)]
        rows.append((name, *ics, fits[name].seconds))
    return train.sparkSession.createDataFrame(rows, "model string, train_ic double, val_ic double, fit_time_s double"), fits


def leaders(board: DataFrame, gap: float = 0.005) -> list[str]:
    """The best model by validation, and the second where it is less than `gap` behind."""
    top = board.orderBy(F.col("val_ic").desc_nulls_last(), "model").limit(2).collect()
    return [r["model"] for k, r in enumerate(top) if k == 0 or (top[0]["val_ic"] or 0) - (r["val_ic"] or 0) < gap]


def meta_features(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds base_side and the daily rank of p_base."""
    return scored.withColumn("base_side", (F.col("p_base") > threshold).cast("double")).withColumn("p_base_rank", pct_rank("p_base", "date"))


def bet_size(p, eps: float = 1e-6):
    """2 * Phi((p - 1/2) / sqrt(p (1 - p))) - 1, not below 0: how much to bet on a probability."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    z = (q - 0.5) / F.sqrt(q * (1 - q))
    return F.when(p.isNotNull(), F.greatest(2 * norm_cdf(z) - 1, F.lit(0.0)))


@dataclass
class TwoStage:
    """A direction model and a model of whether its calls come true."""

    base: Fitted
    meta: Fitted
    threshold: float = 0.5

    def bets(self, rows: DataFrame, gate: float | None = None) -> DataFrame:
        """Adds p_base, p_meta and bet: the size where the base model says long, or where the rank of p_meta is in the top share `gate`."""
        scored = self.meta.predict(meta_features(self.base.predict(rows, "p_base"), self.threshold), "p_meta")
        size = bet_size(F.col("p_meta"))
        if gate is None:
            return scored.withColumn("bet", F.when(F.col("base_side") == 1, size).otherwise(0.0))
        return scored.withColumn("__r", pct_rank("p_meta", "date")).withColumn("bet", F.when(F.col("__r") >= 1 - gate, size).otherwise(0.0)).drop("__r")


def fit_two_stage(train: DataFrame, valid: DataFrame, features: list[str], label: str = "y", threshold: float = 0.5, **more) -> TwoStage:
    """The base model on `train`; the meta model on the long calls of `valid`, or all of it where they are fewer than 50, with an early-stopping tail of the dates after four fifths of the rows."""
    base = fit_boosted(train, features, label, classify=True, **more)
    scored = meta_features(base.predict(valid, "p_base"), threshold).withColumn("__meta", ((F.col("base_side") == 1) & (F.col(label) == 1)).cast("double"))
    calls = scored.where("base_side = 1")
    used = calls if calls.limit(50).count() >= 50 else scored
    used = elapsed(used, "__share").withColumn("__tail", F.col("__share") > 0.8).drop("__share").cache()  # every round of the fit reads it
    meta = fit_boosted(used, [*features, "p_base", "base_side", "p_base_rank"], "__meta", classify=True, validation="__tail", **more)
    used.unpersist()
    return TwoStage(base, meta, threshold)


def auc(known: DataFrame, score: str = "score", label: str = "y", bins: int = 4096) -> DataFrame:
    """One row: the share of (1, 0) pairs in the right order, ties as halves. Rows are counted by score, and scores ranked inside equal bins of their range, whose totals alone share a window."""
    x = F.col(score).cast("double")
    groups = known.groupBy(x.alias("s")).agg(F.sum(label).cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))
    ends = groups.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    place = F.coalesce(F.floor((F.col("s") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(0))
    binned = groups.join(F.broadcast(ends)).select("s", "p", (F.col("n") - F.col("p")).alias("m"), place.alias("b"))  # one row
    ahead = lambda w: F.coalesce(F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    firsts = binned.groupBy("b").agg(F.sum("m").alias("m")).select("b", ahead(Window.orderBy("b")).alias("first"))  # at most bins + 1 rows
    inside = binned.withColumn("below", ahead(Window.partitionBy("b").orderBy("s")))
    right = F.sum(F.col("p") * (F.col("first") + F.col("below") + F.col("m") / 2))
    return inside.join(F.broadcast(firsts), "b").agg((right / F.nullif(F.sum("p") * F.sum("m"), F.lit(0.0))).alias("auc"))


def classification_report(scored: DataFrame, score: str = "score", label: str = "y", threshold: float = 0.5) -> DataFrame:
    """One row: auc (by ranks), accuracy, precision, recall and f1."""
    known = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    hit = (F.col(score) > threshold).cast("double")
    pos, n = F.sum(label), F.count(F.lit(1))
    tp = F.sum(hit * F.col(label))
    rest = known.agg(
        F.avg((hit == F.col(label)).cast("double")).alias("accuracy"),
        (tp / F.nullif(F.sum(hit), F.lit(0.0))).alias("precision"), (tp / F.nullif(pos, F.lit(0.0))).alias("recall"),
        (2 * tp / F.nullif(F.sum(hit) + pos, F.lit(0.0))).alias("f1"),
    )
    return auc(known, score, label).join(F.broadcast(rest))  # one row each


def importances(fitted: Fitted) -> list[tuple[str, float]]:
    return sorted(zip(fitted.features, fitted.model.featureImportances.toArray().tolist()), key=lambda x: -x[1])
