"""Models of all folds fitted together, against Newton steps fold by fold."""

import math
import random

import numpy as np
import pytest

from tickframe.operators import fitting


def newton(rows, classes, rounds, ridge):
    x = np.array([[r["a"], r["b"]] for r in rows])
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    scale = lambda v: np.column_stack((np.ones(len(v)), np.where(deviation > 0, (v - mean) / np.where(deviation > 0, deviation, 1), 0)))
    z, w = scale(x), np.array([r["weight"] for r in rows])
    penalty, models = np.diag([0.0, ridge, ridge]), {}
    for c in classes:
        t, beta = np.array([r["y"] == c for r in rows], float), np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-z @ beta))
            beta = beta + np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (w * (t - p)) - penalty @ beta)
        models[c] = beta
    return scale, models


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(4)
    samples, folds = [], []
    for i in range(240):
        y = float(draw.choice([-1, 0, 1]))
        samples.append({"symbol": "st"[i % 2], "event_id": i, "y": y if i else 7.0, "weight": draw.random() + 0.2,
                        "a": y + draw.gauss(0, 1), "b": 5.0 if i % 3 == 0 else draw.gauss(3, 100)})
        for fold in range(3):
            if draw.random() < 0.9:
                folds.append((fold, "st"[i % 2], i, "test" if i % 3 == fold else "train"))
    folds = [f for f in folds if f[2] != 0] + [(0, "s", 0, "test")]
    return samples, folds, spark.createDataFrame(samples, "symbol string, event_id long, y double, weight double, a double, b double"), \
        spark.createDataFrame(folds, "fold_id int, symbol string, event_id long, role string")


@pytest.mark.parametrize("scoring", ["neg_log_loss", "accuracy"])
def test_scores_equal_fold_by_fold(data, scoring):
    samples, folds, sample_frame, fold_frame = data
    got = {r.fold_id: r.score for r in fitting.fitted_fold_scores(sample_frame, fold_frame, ["a", "b"], scoring, rounds=6, ridge=0.7).collect()}
    assert set(got) == {0, 1, 2}
    for fold in got:
        part = lambda role: [samples[i] for f, _, i, r in folds if f == fold and r == role]
        train, test = part("train"), part("test")
        classes = sorted({r["y"] for r in train})
        scale, models = newton(train, classes, 6, 0.7)
        total = weight = 0.0
        for r in test:
            z = scale(np.array([[r["a"], r["b"]]]))[0]
            p = {c: 1 / (1 + math.exp(-z @ models[c])) for c in classes}
            if scoring == "accuracy":
                value = float(max(classes, key=lambda c: (p[c], -c)) == r["y"])
            else:
                value = math.log(min(max(p.get(r["y"], 0) / sum(p.values()), 2.220446049250313e-16), 1 - 2.220446049250313e-16))
            total, weight = total + value * r["weight"], weight + r["weight"]
        assert got[fold] == pytest.approx(total / weight, abs=1e-9)


def test_one_pass_a_round_whatever_the_folds(data, monkeypatch):
    """No plan or job per fold: the number of aggregations is that of the rounds."""
    _, _, sample_frame, fold_frame = data
    calls = []
    monkeypatch.setattr(np.linalg, "solve", lambda h, g, f=np.linalg.solve: calls.append(h.shape) or f(h, g))
    fitting.fitted_fold_scores(sample_frame, fold_frame, ["a"], rounds=3)
    assert calls == [(9, 2, 2)] * 3


def test_limits(data, monkeypatch):
    _, _, sample_frame, fold_frame = data
    monkeypatch.setattr(fitting, "MAX_MODELS", 8)
    with pytest.raises(ValueError):
        fitting.fitted_fold_scores(sample_frame, fold_frame, ["a"])
    with pytest.raises(ValueError):
        fitting.fitted_fold_scores(sample_frame, fold_frame, ["a"], "roc")
