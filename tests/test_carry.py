"""Carry maps against plain simulation."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickframe.operators.events import _arm_map, _exits_from_zero, _run_arms
from tickframe.scan.carry import apply_map, compose, resolve_entries, simplify
from tickframe.scan.prefix import decay_block, decayed_sums

values = st.lists(st.tuples(st.integers(-5, 5), st.integers(1, 9)), min_size=1, max_size=30)


def run_arm(steps, entry):
    u, resets = float(entry), 0
    for y, h in steps:
        u = max(0.0, u + y)
        if u > h:
            u, resets = 0.0, resets + 1
    return u, resets


def map_of(steps):
    return _arm_map(np.array([float(y) for y, _ in steps]), np.array([float(h) for _, h in steps]))


@settings(max_examples=200, deadline=None)
@given(values, st.integers(0, 12))
def test_arm_map_equals_simulation(steps, entry):
    assert apply_map(map_of(steps), float(entry)) == run_arm(steps, entry)


@settings(max_examples=200, deadline=None)
@given(values, values, st.integers(0, 12))
def test_composition_equals_concatenation(first, second, entry):
    joined = compose(map_of(first), map_of(second))
    assert apply_map(joined, float(entry)) == run_arm(first + second, entry)
    assert joined == simplify(joined)


@settings(max_examples=100, deadline=None)
@given(values)
def test_exits_from_zero(steps):
    total = np.cumsum([float(y) for y, _ in steps])
    exits = _exits_from_zero(total, np.array([float(h) for _, h in steps]))
    for row in range(len(steps)):
        assert exits[row] == run_arm(steps[row:], 0)


def test_only_the_breached_arm_resets():
    # h falls so that both arms exceed it on row 2: the lower arm fires, the upper one a row later.
    y = np.array([0.05, -0.04, 0.0, 0.0])
    h = np.array([9.0, 9.0, 0.005, 0.005])
    low, fired = _run_arms(y, h, 0.0, 0.0)
    assert low.tolist() == [False, False, True, False]
    assert fired.tolist() == [False, False, True, True]


def test_entries_over_several_levels(spark):
    rng = np.random.default_rng(0)
    steps = [(int(y), int(h)) for y, h in zip(rng.integers(-4, 6, 120), rng.integers(2, 9, 120))]
    rows, expected, entry, before = [], [], 0.0, 0
    for chunk in range(40):
        part = steps[chunk * 3:chunk * 3 + 3]
        rows += [("s", chunk * 1000, *piece) for piece in map_of(part)]  # gaps between chunk numbers
        expected.append((chunk * 1000, entry, before))
        entry, more = run_arm(part, entry)
        before += more
    pieces = spark.createDataFrame(
        rows, "symbol string, chunk long, lo double, out double, is_shift boolean, resets long")
    got = resolve_entries(pieces, None, "double", group=3).orderBy("chunk").collect()
    assert [(r.chunk, r.entry, r.before) for r in got] == expected


def test_decayed_sums_carry_over_flat_blocks(spark):
    """A value keeps its weight over whole blocks of zeros, for a fast and a slow factor together."""
    q = {"a": 0.8, "b": 0.93}
    block = decay_block(list(q.values()))
    rows = [("s", i, i // block, 1.0 if i in (3, 4 * block + 5) else 0.0) for i in range(5 * block)]
    rows += [("t", i, i // block, 1.0) for i in range(2 * block)]
    frame = spark.createDataFrame(rows, "symbol string, bar_seq long, chunk long, x double")
    got = {(r.symbol, r.bar_seq): r for r in decayed_sums(frame, {n: (F.col("x"), f) for n, f in q.items()}, "bar_seq").collect()}
    assert len(got) == len(rows)
    for n, f in q.items():
        y = {"s": 0.0, "t": 0.0}
        for symbol, i, _, x in rows:
            y[symbol] = f * y[symbol] + x
            assert got[symbol, i][n] == pytest.approx(y[symbol], rel=1e-9, abs=1e-300)
