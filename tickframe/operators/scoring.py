"""Weighted fitting and scoring over folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scoring names (fixed values).
SCORINGS = ("neg_log_loss", "accuracy")
_EPS = 2.220446049250313e-16  # double precision epsilon, the clip of a probability


def weighted_pipeline(stages: list, weight_col: str):
    """A Pipeline whose last stage alone receives the sample weights."""
    from pyspark.ml import Pipeline

    return Pipeline(stages=[*stages[:-1], stages[-1].copy({stages[-1].getParam("weightCol"): weight_col})])


def fold_scores(predictions: DataFrame, scoring: str = "neg_log_loss", by: list[str] | None = None) -> DataFrame:
    """One raw score per fold; nothing is averaged over folds.

    ``predictions``: fold_id, y, weight and ``p_y`` (probability the model gave the true class, taken
    from the fitted model's own class list) for log loss, or ``prediction`` for accuracy.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {SCORINGS}, got {scoring!r}.")
    if scoring == "neg_log_loss":
        value = F.ln(F.least(F.greatest(F.col("p_y"), F.lit(_EPS)), F.lit(1 - _EPS)))
    else:
        value = (F.col("prediction") == F.col("y")).cast("double")
    return predictions.groupBy("fold_id", *(by or [])).agg(
        F.try_divide(F.sum(value * F.col("weight")), F.sum("weight")).alias("score")
    )


def estimator_predictor(estimator, features: str = "features", scoring: str = "neg_log_loss") -> Callable:
    """Turn a pyspark.ml classifier or Pipeline into ``predict(train, test)`` for :func:`cv_score`."""
    last = estimator.getStages()[-1] if hasattr(estimator, "getStages") else estimator
    if scoring == "neg_log_loss" and not hasattr(last, "getProbabilityCol"):
        raise AttributeError("neg_log_loss needs an estimator with class probabilities")

    def predict(train: DataFrame, test: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        # The classes are those of the training rows, whatever their numbers; the estimator sees their places.
        classes = [r["y"] for r in train.select("y").distinct().orderBy("y").collect()]
        place = F.try_element_at(F.create_map(*[F.lit(x) for k, y in enumerate(classes) for x in (y, float(k))]), F.col("y"))
        label = last.getLabelCol()
        scored = estimator.fit(train.withColumn("_y", F.col("y")).withColumn(label, place)).transform(test)
        if scoring == "accuracy":
            named = F.element_at(F.array(*map(F.lit, classes)), (F.col("prediction") + 1).cast("int"))
            return scored.withColumn("prediction", named)
        probability = vector_to_array(last.getProbabilityCol())
        return scored.withColumn("p_y", F.coalesce(
            F.try_element_at(probability, (place + 1).cast("int")), F.lit(0.0)))

    return predict


def class_share_predictor(train: DataFrame, test: DataFrame) -> DataFrame:
    """``predict`` for :func:`cv_score` with a closed form: every class has its share of the training weight, the one of
    the largest share (of the smallest label among equals) is predicted. One row per class is broadcast."""
    shares = train.groupBy("y").agg(F.sum("weight").alias("_w"))
    total = shares.agg(F.sum("_w").alias("_total"), F.max(F.struct("_w", (-F.col("y")).alias("_least"))).alias("_top"))
    known = shares.join(F.broadcast(total), F.lit(True)).select(
        "y", (F.col("_w") / F.col("_total")).alias("p_y"), (-F.col("_top._least")).alias("prediction"))
    top = known.select("prediction").limit(1)
    return test.join(F.broadcast(known.select("y", "p_y")), "y", "left").fillna(0.0, ["p_y"]).join(F.broadcast(top), F.lit(True), "left")


def cv_score(samples: DataFrame, folds: DataFrame, predict: Callable[[DataFrame, DataFrame], DataFrame],
             scoring: str = "neg_log_loss") -> DataFrame:
    """(fold_id, score): fit on each fold's training rows and score its test rows, both weighted.

    ``samples``: symbol, event_id, y, weight and feature columns. ``folds``: any frame of (fold_id,
    symbol, event_id, role), so every splitter fits. ``predict(train, test)`` returns the test rows
    with predictions. The loop is over folds, not rows; each fit is a distributed job.
    """
    if scoring not in SCORINGS:
        raise ValueError(f"scoring must be one of {SCORINGS}, got {scoring!r}.")
    cast = folds.select("fold_id", "symbol", "event_id", "role").join(samples, ["symbol", "event_id"])
    scored = None
    for fold_id in sorted(row.fold_id for row in folds.select("fold_id").distinct().collect()):
        one = cast.filter(F.col("fold_id") == fold_id)
        tested = predict(one.filter("role = 'train'"), one.filter("role = 'test'"))
        score = fold_scores(tested, scoring)
        scored = score if scored is None else scored.unionByName(score)
    return scored
