"""Tree folds of user functions, packed incidence, and the newest rows of many partitions."""

import random
from datetime import timedelta

import pandas as pd
import pytest
from conftest import START

from tickframe.operators.batches import fold_batches
from tickframe.operators.indicators import latest_window
from tickframe.operators.weights import bars_of_masks, concurrency, incidence_masks, shared_bars


@pytest.fixture
def letters():
    def joined(frame, tail=""):  # local, so that workers get it by value
        return pd.DataFrame({"text": ["".join(frame["letter"]) + tail], "n": [len(frame)]})

    return joined


@pytest.mark.parametrize("rows, fan_in", [(1, 2), (3, 2), (7, 32), (1000, 2)])
def test_fold_keeps_the_order_of_the_batches(spark, letters, rows, fan_in):
    draw = random.Random(rows)
    text = "".join(draw.choices("abcdef", k=101))
    atoms = spark.createDataFrame([(i, c) for i, c in enumerate(text)], "seq long, letter string").repartition(5)
    joined = fold_batches(atoms, letters, lambda a, b: pd.DataFrame({"text": a["text"] + b["text"], "n": a["n"] + b["n"]}), "text string, n long", rows,
                          fan_in=fan_in)
    assert [tuple(r) for r in joined.collect()] == [(text, 101)]

    def extend(left, right):
        left["text"] = left["text"] + right["text"]
        left["n"] = left["n"] + right["n"]

    in_place = fold_batches(atoms, letters, extend, "text string, n long", rows, fan_in=fan_in, tail="|")
    assert in_place.first().text.replace("|", "") == text and in_place.first().text.count("|") == -(-101 // rows)


def test_fold_of_gaps_and_of_nothing(spark, letters):
    atoms = spark.createDataFrame([(5, "a"), (70_000, "b"), (70_001, "c")], "seq long, letter string")
    add = lambda a, b: pd.DataFrame({"text": a["text"] + b["text"], "n": a["n"] + b["n"]})
    assert fold_batches(atoms, letters, add, "text string, n long", 10, fan_in=3).collect() == [("abc", 3)]
    assert fold_batches(atoms.limit(0), letters, add, "text string, n long", 10).collect() == []
    with pytest.raises(ValueError):
        fold_batches(atoms, letters, add, "text string, n long", 0)


def test_masks_hold_every_bar_of_a_span(spark, spans_frame):
    draw = random.Random(2)
    pairs = [(a, a + draw.choice([0, 1, 5, 62, 63, 64, 65, 300])) for a in draw.sample(range(400), 60)] + [(0, 63), (64, 127), (63, 64)]
    spans = spans_frame({"s": pairs, "t": pairs[:5]})
    masks = incidence_masks(spans).cache()
    assert masks.groupBy("symbol", "event_id", "block").count().filter("count > 1").isEmpty()
    assert masks.count() == sum(b // 64 - a // 64 + 1 for a, b in pairs + pairs[:5])
    grid = spark.createDataFrame([(s, i) for s in "st" for i in range(800)], "symbol string, bar_seq long")
    counted = {(r.symbol, r.bar_seq): r.co_events for r in concurrency(grid, spans).filter("co_events > 0").collect()}
    assert {(r.symbol, r.bar_seq): r.co_events for r in bars_of_masks(masks).collect()} == counted
    asked = [("s", i, j) for i in range(0, 60, 7) for j in range(0, 60, 5)]
    got = {(r.event_id, r.other_id): r.shared for r in shared_bars(
        masks, spark.createDataFrame(asked, "symbol string, event_id long, other_id long")).collect()}
    assert got == {(i, j): max(0, min(pairs[i][1], pairs[j][1]) - max(pairs[i][0], pairs[j][0]) + 1) for _, i, j in asked}


def test_newest_rows_of_many_partitions(spark):
    rows = [("hot" if i % 7 else "cold", START + timedelta(minutes=i)) for i in range(3000)]
    candles = spark.createDataFrame(rows, "symbol string, timestamp timestamp").repartition(500)
    window = latest_window(candles, 20)
    got = sorted((r.symbol, r.timestamp, r.bar_seq) for r in window.collect())
    want = [(s, t, i) for s in ("cold", "hot") for i, t in enumerate(sorted(t for k, t in rows if k == s)[-20:])]
    assert got == want
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4  # before and behind the shuffle of both steps
