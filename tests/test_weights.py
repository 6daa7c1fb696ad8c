import math
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickframe.functions.configs import WeightConfig
from tickframe.operators.bootstrap import _draw, sequential_bootstrap
from tickframe.operators.folds import combinatorial_purged_kfold, embargo_times, purge, purged_kfold
from tickframe.operators.volatility import with_log_returns
from tickframe.operators.weights import (
    average_uniqueness, concurrency, event_incidence, incidence_uniqueness, normalize_weights,
    return_attribution, time_decay,
)
from tickframe.plans.weighting import sample_weights

N = 60


def grid_of(closes_frame, n):
    return closes_frame([100 * 1.1 ** i for i in range(n)])


def test_concurrency_known_answer(closes_frame, spans_frame):
    got = concurrency(grid_of(closes_frame, 5), spans_frame([(1, 3), (2, 4)])).orderBy("bar_seq").collect()
    assert [r.co_events for r in got] == [0, 1, 2, 2, 1]


def test_unresolved_or_off_grid_spans_fail(spark, closes_frame, spans_frame):
    open_span = spark.createDataFrame([("s", 0, 1, None)], "symbol string, event_id long, t0_seq long, t1_seq long")
    with pytest.raises(Exception, match="must be resolved"):
        concurrency(grid_of(closes_frame, 5), open_span).collect()
    with pytest.raises(Exception, match="bars of the grid"):
        concurrency(grid_of(closes_frame, 5), spans_frame([(1, 9)])).collect()
    counted = concurrency(grid_of(closes_frame, 5), spans_frame([(1, 3)]))
    with pytest.raises(Exception, match="bars of the grid"):
        average_uniqueness(counted, spans_frame([(1, 9)])).collect()


def test_uniqueness_and_attribution_known_answers(closes_frame, spans_frame):
    grid, spans = grid_of(closes_frame, 5), spans_frame([(0, 2), (1, 3)])
    got = average_uniqueness(concurrency(grid, spans), spans).collect()
    assert [r.avg_uniqueness for r in got] == pytest.approx([2 / 3, 2 / 3])
    one = spans_frame([(1, 3)])
    returns = with_log_returns(grid).drop("chunk")
    got = return_attribution(concurrency(returns, one), one).first()
    assert got.attribution == pytest.approx(3 * math.log(1.1))


def test_normalized_weights_sum_to_their_number(spark):
    rows = [("a", i, i, float(i)) for i in range(1, 4)] + [("z", i, i, 0.0) for i in range(2)]
    frame = spark.createDataFrame(rows, "symbol string, event_id long, t0_seq long, w double")
    got = normalize_weights(frame, "w", "n").collect()
    assert sum(r.n for r in got if r.symbol == "a") == pytest.approx(3)
    assert [r.n for r in got if r.symbol == "z"] == [0.0, 0.0]


@pytest.mark.parametrize("c, expected", [
    (1.0, [1, 1, 1]), (0.5, [0.6, 0.75, 1]), (0.0, [0.2, 0.5, 1]), (-0.5, [0, 0, 1]), (-1.0, [None] * 3)])
def test_time_decay(spark, c, expected):
    rows = [("s", i, 5 * i, u) for i, u in enumerate([0.2, 0.3, 0.5])]
    frame = spark.createDataFrame(rows, "symbol string, event_id long, t0_seq long, avg_uniqueness double")
    got = [r.decay for r in time_decay(frame, c).orderBy("t0_seq").collect()]
    assert got == (expected if c == -1 else pytest.approx(expected))


def random_spans(seed, n=N, events=40):
    rng = np.random.default_rng(seed)
    start = np.sort(rng.integers(0, n - 1, events))
    return [(int(a), int(min(a + w, n - 1))) for a, w in zip(start, rng.integers(0, 12, events))]


def naive_weights(closes, spans, c):
    counts, returns = np.zeros(len(closes)), np.append(0, np.diff(np.log(closes)))
    for a, b in spans:
        counts[a:b + 1] += 1
    unique = np.array([np.mean(1 / counts[a:b + 1]) for a, b in spans])
    raw = np.array([abs(np.sum(returns[a:b + 1] / counts[a:b + 1])) for a, b in spans])
    cum = np.cumsum(unique)
    slope = (1 - c) / cum[-1] if c >= 0 else 1 / ((c + 1) * cum[-1])
    return unique, raw * len(raw) / raw.sum() * np.maximum(1 - slope * cum[-1] + slope * cum, 0)


@pytest.mark.parametrize("chunk_rows, c", [(1, 0.5), (8, -0.5), (None, 0.5)])
def test_sample_weights_equal_naive_loops(closes_frame, spans_frame, chunk_rows, c):
    rng = np.random.default_rng(1)
    closes = {s: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, N))) for s in "ab"}
    pairs = {s: random_spans(i) for i, s in enumerate("ab")}
    labels = spans_frame(pairs).withColumn("t1", F.lit(None).cast("timestamp"))
    got = {(r.symbol, r.event_id): r for r in
           sample_weights(closes_frame(closes), labels, WeightConfig(c), chunk_rows).collect()}
    for s in "ab":
        unique, weight = naive_weights(closes[s], pairs[s], c)
        assert [got[s, i].avg_uniqueness for i in range(40)] == pytest.approx(unique)
        assert [got[s, i].weight for i in range(40)] == pytest.approx(weight)


def test_two_ways_to_uniqueness_agree(closes_frame, spans_frame):
    for pairs in ([(0, 3), (2, 5), (4, 7)], random_spans(9)):
        spans = spans_frame(pairs)
        one = average_uniqueness(concurrency(grid_of(closes_frame, N), spans), spans).orderBy("event_id").collect()
        two = incidence_uniqueness(grid_of(closes_frame, N), spans).orderBy("event_id").collect()
        cells = event_incidence(spans)
        counts = cells.groupBy("symbol", "bar_seq").agg(F.count("*").alias("c"))
        three = cells.join(counts, ["symbol", "bar_seq"]).groupBy("event_id").agg(F.avg(1 / F.col("c")).alias("u")).orderBy("event_id").collect()
        for other in ([r.avg_uniqueness for r in two], [r.u for r in three]):
            assert [r.avg_uniqueness for r in one] == pytest.approx(other)


def naive_draw(pairs, draws, seed, n):
    rng, drawn, picks = np.random.default_rng(seed), np.zeros(n), []
    for _ in range(draws):
        u = np.array([np.mean(1 / (drawn[a:b + 1] + 1)) for a, b in pairs])
        pick = rng.choice(len(pairs), p=u / u.sum())
        drawn[pairs[pick][0]:pairs[pick][1] + 1] += 1
        picks.append(pick)
    return picks


def test_bootstrap_equals_naive_draws_and_favours_low_overlap(spans_frame):
    pairs = [(0, 1), (10, 19), (11, 19), (10, 18), (11, 18)]
    starts, ends = np.array(pairs).T
    hits = [_draw(starts, ends, 5, seed) for seed in range(150)]
    assert np.mean(np.concatenate(hits) == 0) > 0.23
    assert hits[3].tolist() == naive_draw(pairs, 5, 3, 20)
    got = sequential_bootstrap(spans_frame(pairs), [3, 4]).orderBy("replicate", "draw").collect()
    assert [r.event_id for r in got[:5]] == hits[3].tolist() and len(got) == 10


def test_bootstrap_of_a_long_series_is_no_square():
    starts = np.arange(40_000) * 3
    begun = time.monotonic()
    picks = _draw(starts, starts + 8, len(starts), 7)
    assert time.monotonic() - begun < 30  # above a minute when every draw looked at every span
    assert len(np.unique(picks)) > len(starts) * 0.5
    assert np.diff(np.sort(picks)).max() < 200


def test_bootstrap_equals_naive_draws_on_mixed_spans():
    rng = np.random.default_rng(2)
    starts = rng.integers(0, 300, 120)
    ends = starts + rng.integers(0, 40, 120)
    assert _draw(starts, ends, 200, 5).tolist() == naive_draw(list(zip(starts, ends)), 200, 5, 400)


def naive_folds(pairs, n, groups, members, pct):
    step, parts, out = int(n * pct), np.array_split(np.arange(len(pairs)), groups), set()
    ends = [min(max(pairs[t][1] for t in part) + step, n - 1) for part in parts]
    for fold, combo in enumerate(members):
        out |= {(fold, int(i), "test") for g in combo for i in parts[g]}
        out |= {(fold, i, "train") for i, (a, b) in enumerate(pairs)
                if all(a > ends[g] or b < pairs[parts[g][0]][0] for g in combo)}
    return out


def rows_of(folds):
    return {(r.fold_id, r.event_id, r.role) for r in folds.collect()}


def trains(folds):
    out = {}
    for fold, event, role in rows_of(folds):
        if role == "train":
            out.setdefault(fold, set()).add(event)
    return out


def test_embargo_times(closes_frame):
    rows = embargo_times(grid_of(closes_frame, 10), 0.2).orderBy("bar_seq").collect()
    assert [r.embargo_seq for r in rows] == [2, 3, 4, 5, 6, 7, 8, 9, 9, 9]
    with pytest.raises(ValueError):
        embargo_times(grid_of(closes_frame, 10), 1.0)


def test_known_folds(closes_frame, spans_frame):
    bars, points = grid_of(closes_frame, 12), spans_frame([(i, i) for i in range(12)])
    assert trains(purged_kfold(points, bars, 3))[0] == set(range(4, 12))
    assert trains(purged_kfold(points, bars, 3, 0.2)) == {
        0: set(range(6, 12)), 1: {0, 1, 2, 3, 10, 11}, 2: set(range(8))}
    combo = list(combinations(range(4), 2)).index((0, 2))
    assert trains(combinatorial_purged_kfold(points, bars, 4, 2, 0.2))[combo] == {5, 11}
    with pytest.raises(Exception, match="fewer events"):
        purged_kfold(spans_frame([(0, 0)]), bars, 3).collect()


@pytest.mark.parametrize("chunk_rows", [1, 8, None])
def test_folds_with_wide_spans(closes_frame, spans_frame, chunk_rows):
    pairs = random_spans(4, events=41)
    bars, spans = grid_of(closes_frame, N), spans_frame(pairs)
    assert rows_of(purged_kfold(spans, bars, 4, 0.1, chunk_rows)) == naive_folds(
        pairs, N, 4, [(k,) for k in range(4)], 0.1)
    members = list(combinations(range(5), 2))
    assert rows_of(combinatorial_purged_kfold(spans, bars, 5, 2, 0.05, chunk_rows)) == naive_folds(
        pairs, N, 5, members, 0.05)


@pytest.mark.parametrize("pair, kept", [
    ((0, 4), True), ((0, 5), False), ((5, 6), False), ((8, 12), False), ((9, 12), True), ((0, 19), False)])
def test_purge_overlaps(spark, closes_frame, spans_frame, pair, kept):
    test = spark.createDataFrame([("s", 5, 8)], "symbol string, i_seq long, j_seq long")
    assert (purge(grid_of(closes_frame, 20), spans_frame([pair]), test).count() == 1) is kept


def test_purge_with_many_test_spans(spark, closes_frame, spans_frame):
    pairs, tests = random_spans(5), random_spans(6, events=6)
    frame = spark.createDataFrame([("s", a, b) for a, b in tests], "symbol string, i_seq long, j_seq long")
    got = {r.event_id for r in purge(grid_of(closes_frame, N), spans_frame(pairs), frame, 8).collect()}
    assert got == {i for i, (a, b) in enumerate(pairs) if all(a > d or b < c for c, d in tests)}
