"""Weighted logistic models of all folds, fitted together.

Every fold has one model per class (that class against the rest). A Newton round is one aggregation over (fold, class) of
the gradient and the curvature; the driver solves the small systems of all models at once and hands the coefficients to the
next round. Rows never leave the executors, and there is one pass a round however many folds there are.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.scoring import SCORINGS, fold_scores
from tickframe.session import materialize

#: Models that one fit may have (folds x classes); what is broadcast and what comes to the driver is bounded by it.
MAX_MODELS = 100_000
#: Largest log odds that enter the curvature, so that no row's weight reaches 0.
_MOST = 30.0


class FoldModels(NamedTuple):
    """``table``: (fold_id, scale, models), one row per fold, with the mean and deviation of every feature in the
    training rows and (class, coefficients) of every class, intercept first."""

    features: list[str]
    table: DataFrame


def _standard(features: list[str]) -> list[Column]:
    """1 and the features as multiples of their deviation in the fold's training rows; a missing or constant one is 0."""
    def scaled(i: int, name: str) -> Column:
        mean, deviation = F.col("scale")[i]["mean"], F.col("scale")[i]["deviation"]
        return F.coalesce(F.when(deviation > 0, (F.col(name) - mean) / deviation), F.lit(0.0))

    return [F.lit(1.0), *[scaled(i, name) for i, name in enumerate(features)]]


def _odds(coefficients: Column, z: list[Column]) -> Column:
    return sum((coefficients[i] * z[i] for i in range(1, len(z))), coefficients[0])


def fit_folds(train: DataFrame, features: list[str], rounds: int = 8, ridge: float = 1.0) -> FoldModels:
    """Fit every fold of ``train`` (fold_id, y, weight and features; a row once per fold it trains).

    Features are standardized per fold without weights, as a pipeline's first steps are; the fit is weighted. ``ridge`` is the
    penalty on squared coefficients other than the intercept, in units of weight (half of it times their sum). ``rounds``
    Newton steps from zero are made.
    """
    rows = materialize(train.select("fold_id", F.col("y").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"),
                                    *[F.col(c).cast("double").alias(c) for c in features]))
    spark = rows.sparkSession
    scale = rows.groupBy("fold_id").agg(F.array(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation")) for c in features]).alias("scale"))
    classes = rows.groupBy("fold_id", "y").agg(F.count("*").alias("n"))
    folds = materialize(scale.join(classes, "fold_id").select("fold_id", "y", "scale"))
    n_models = folds.limit(MAX_MODELS + 1).count()
    if n_models > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models: fewer folds or classes, please.")
    known = sorted((r["fold_id"], r["y"]) for r in folds.select("fold_id", "y").collect())
    width = len(features) + 1
    z = _standard(features)
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    beta = np.zeros((len(known), width))
    penalty = np.diag([0.0] + [ridge] * (width - 1))

    def table() -> DataFrame:
        models = spark.createDataFrame([(f, y, b.tolist()) for (f, y), b in zip(known, beta)], "fold_id long, y double, b array<double>")
        return folds.join(models.withColumn("fold_id", F.col("fold_id").cast(folds.schema["fold_id"].dataType)), ["fold_id", "y"]) \
            .groupBy("fold_id").agg(F.any_value("scale").alias("scale"), F.sort_array(F.collect_list(F.struct("y", "b"))).alias("models"))

    for _ in range(rounds):
        # At most MAX_MODELS short rows are broadcast.
        placed = rows.join(F.broadcast(table()), "fold_id").select(
            "fold_id", "y", "weight", F.array(*z).alias("z"), F.explode("models").alias("m"))
        zs = [F.col("z")[i] for i in range(width)]
        odds = F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), _odds(F.col("m.b"), zs)))
        p = 1 / (1 + F.exp(-odds))
        slope = F.col("weight") * ((F.col("y") == F.col("m.y")).cast("double") - p)
        bend = F.col("weight") * p * (1 - p)
        sums = placed.withColumns({"slope": slope, "bend": bend}).groupBy("fold_id", F.col("m.y").alias("c")).agg(
            F.array(*[F.sum(F.col("slope") * x) for x in zs]).alias("g"),
            F.array(*[F.sum(F.col("bend") * zs[i] * zs[j]) for i, j in pairs]).alias("h"))
        found = {(r["fold_id"], r["c"]): r for r in sums.collect()}
        g = np.array([found[key]["g"] for key in known]).reshape(-1, width)
        h = np.zeros((len(known), width, width))
        for at, (i, j) in enumerate(pairs):
            h[:, i, j] = h[:, j, i] = [found[key]["h"][at] for key in known]
        beta = beta + np.linalg.solve(h + penalty, (g - beta @ penalty)[..., None])[..., 0]
    return FoldModels(features, table())


def predict_folds(models: FoldModels, test: DataFrame) -> DataFrame:
    """``test`` rows (fold_id, y and features) with ``p_y``, the share that the model of y has in the sum over the fold's
    classes (0 for a class it never saw), and ``prediction``, the class of the largest share, the smallest among equals."""
    z = F.array(*_standard(models.features))
    shares = F.transform("models", lambda m: F.struct(
        (1 / (1 + F.exp(-_odds(m["b"], [F.col("_z")[i] for i in range(len(models.features) + 1)])))).alias("p"), (-m["y"]).alias("less")))
    placed = test.join(F.broadcast(models.table), "fold_id").withColumn("_z", z).withColumn("_shares", shares)
    total = F.aggregate("_shares", F.lit(0.0), lambda a, s: a + s["p"])
    own = F.aggregate(F.filter("_shares", lambda s: s["less"] == -F.col("y")), F.lit(0.0), lambda a, s: a + s["p"])
    return placed.withColumn("p_y", own / total).withColumn("prediction", -F.array_max("_shares")["less"]).drop("_z", "_shares", "scale", "models")


def fitted_fold_scores(samples: DataFrame, folds: DataFrame, features: list[str], scoring: str = "neg_log_loss",
                       rounds: int = 8, ridge: float = 1.0) -> DataFrame:
    """(fold_id, score): every fold's model fitted on its training rows and scored on its test rows, both weighted.

    ``samples``: symbol, event_id, y, weight and ``features``; ``folds``: (fold_id, symbol, event_id, role) of any splitter.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {SCORINGS}, got {scoring!r}.")
    cast = folds.select("fold_id", "symbol", "event_id", "role").join(
        samples.select("symbol", "event_id", "y", "weight", *features), ["symbol", "event_id"])
    models = fit_folds(cast.filter("role = 'train'"), features, rounds, ridge)
    return fold_scores(predict_folds(models, cast.filter("role = 'test'")), scoring)
