import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickframe.functions.configs import LabelConfig
from tickframe.operators.barriers import first_touch, get_bins, get_events, vertical_barriers
from tickframe.operators.events import _run_arms, cusum_events
from tickframe.operators.volatility import ewma_vol, ewma_vol_latest, signal_metadata, with_log_returns
from tickframe.plans.labeling import triple_barrier_labels


def events_at(spark, rows):
    return spark.createDataFrame(rows, "symbol string, t0_seq long, trgt double")


def touch(spark, closes_frame, closes, hp, trgt=0.02, at=0, side=1, pt_sl=(1.0, 1.0)):
    bets = events_at(spark, [("s", at, trgt)]).withColumn("side", F.lit(side))
    row = first_touch(closes_frame(closes), bets, *pt_sl, hp).first()
    return row.t1_seq, row.barrier


def fired(spark, closes_frame, closes, h, chunk_rows=None):
    series = with_log_returns(closes_frame(closes)).withColumn("h", F.lit(h)).drop("chunk")
    return sorted(r.t0_seq for r in cusum_events(series, chunk_rows).collect())


def test_cusum_known_answers(spark, closes_frame):
    assert fired(spark, closes_frame, [100, 100, 103], 0.02) == [2]
    assert fired(spark, closes_frame, [100, 103, 100, 103], 0.02) == [1, 2, 3]
    assert fired(spark, closes_frame, [100, 100, 100], 0.02) == []


@pytest.mark.parametrize("chunk_rows", [1, 7, None])
def test_cusum_constant_growth_keeps_its_phase(spark, closes_frame, chunk_rows):
    # Equal returns: chunks never forget their entry value.
    closes = [100 * math.exp(0.01 * i) for i in range(100)]
    assert fired(spark, closes_frame, closes, 0.035, chunk_rows) == list(range(4, 100, 4))


def test_null_threshold_accumulates_but_never_fires(spark):
    rows = [("s", 1, 0.05, None), ("s", 2, 0.0, 0.02), ("s", 3, 0.03, float("nan")), ("s", 4, 0.0, 0.02)]
    series = spark.createDataFrame(rows, "symbol string, bar_seq long, log_diff double, h double")
    assert sorted(r.t0_seq for r in cusum_events(series).collect()) == [2, 4]


def test_vertical_barrier(spark, closes_frame):
    events = events_at(spark, [("s", 2, 0.1), ("s", 6, 0.1), ("s", 7, 0.1)])
    rows = vertical_barriers(closes_frame(range(1, 11)), events, 3).orderBy("t0_seq").collect()
    assert [r.t1_seq for r in rows] == [5, 9, None]
    with pytest.raises(ValueError):
        vertical_barriers(closes_frame([1, 2]), events, 0)


@pytest.mark.parametrize("closes, hp, kwargs, expected", [
    ([100, 101, 103, 103, 103], 4, {}, (2, 1)),
    ([100, 99, 97, 97, 97], 4, {}, (2, -1)),
    ([100, 99, 97, 97, 97], 4, {"side": -1}, (2, 1)),
    ([100, 100.5, 101, 100.5, 100], 4, {}, (4, 0)),
    ([100, 100.5, 103], 2, {}, (2, 1)),
    ([100, 100, 100, 100, 100], 5, {"at": 2}, (None, None)),
    ([100, 101, 103], 2, {"pt_sl": (0.0, 1.0)}, (2, 0)),
    ([100, 102, 100], 2, {"trgt": 102 / 100 - 1}, (2, 0)),
])
def test_first_touch(spark, closes_frame, closes, hp, kwargs, expected):
    assert touch(spark, closes_frame, closes, hp, **kwargs) == expected


def test_bins_and_sides(spark, closes_frame):
    bars = closes_frame({"up": [100, 103], "down": [100, 97], "flat": [100, 100]})
    events = events_at(spark, [(s, 0, 0.5) for s in ("up", "down", "flat")])
    plain = get_bins(get_events(bars, events, 1.0, 1.0, 1))
    assert {r.symbol: r.bin for r in plain.collect()} == {"up": 1, "down": -1, "flat": 0}
    assert "side" not in plain.columns
    side = events.select("symbol", "t0_seq", F.lit(-1).alias("side"))
    meta = {r.symbol: (r.bin, round(r.ret, 4)) for r in
            get_bins(get_events(bars, events, 1.0, 1.0, 1, side=side)).collect()}
    assert meta == {"up": (0, -0.03), "down": (1, 0.03), "flat": (0, 0.0)}
    with pytest.raises(Exception, match="no side for event"):
        get_events(bars, events, 1.0, 1.0, 1, side=side.filter("symbol = 'up'")).collect()


def test_target_filter_is_strict_and_drops_nan(spark, closes_frame):
    bars = closes_frame([100, 101, 102, 103, 104])
    events = events_at(spark, [("s", 0, 0.01), ("s", 1, float("nan")), ("s", 2, None), ("s", 3, 0.02)])
    assert [r.t0_seq for r in get_events(bars, events, 1.0, 1.0, 1, 0.01).collect()] == [3]


@pytest.mark.parametrize("span, n", [(2, 900), (20, 60), (5, 5)])
def test_ewma_vol_equals_pandas(closes_frame, span, n):
    # span 2 has blocks of 256 rows, so 900 rows cross several of them.
    rng = np.random.default_rng(span)
    series = {k: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))) for k in "ab"}
    got = ewma_vol(closes_frame(series), span).toPandas()
    for symbol, closes in series.items():
        s = pd.Series(closes)
        want = np.log(s / s.shift(1)).ewm(span=span, min_periods=span).std()
        mine = got[got.symbol == symbol].sort_values("bar_seq").vol.to_numpy(dtype="float64")
        np.testing.assert_allclose(mine, want.to_numpy(), rtol=1e-9, atol=1e-15)


def test_latest_vol_and_metadata(closes_frame):
    bars = closes_frame({"short": [100, 101], "flat": [100] * 30})
    vols = ewma_vol(bars, 5)
    assert {r.symbol: float(r.ewma_vol) for r in ewma_vol_latest(vols).collect()} == {"short": 0.0, "flat": 0.0}
    assert all(set(r.metadata) == {"ewma_vol"} for r in signal_metadata(vols).collect())
    with pytest.raises(ValueError):
        ewma_vol(bars, 1)


def sequential_labels(closes, config):
    s = pd.Series(closes)
    vol = np.log(s / s.shift(1)).ewm(span=config.ewma_span, min_periods=config.ewma_span).std()
    first = vol.first_valid_index()
    y = np.log(s).diff().iloc[first + 1:].to_numpy()
    _, hits = _run_arms(y, (config.kappa * vol).iloc[first + 1:].to_numpy(), 0.0, 0.0)
    out = []
    for e in (first + 1 + i for i in np.flatnonzero(hits)):
        if not vol[e] > config.min_ret:
            continue
        found = None
        for j in range(e, min(e + config.max_hp, len(s) - 1) + 1):
            r = s[j] / s[e] - 1
            code = 1 if r > config.pt_mult * vol[e] else -1 if r < -config.sl_mult * vol[e] else None
            if code:
                found = (j, code)
                break
        if found is None and e + config.max_hp < len(s):
            found = (e + config.max_hp, 0)
        if found:
            out.append((e, *found, round(vol[e], 9), round(s[found[0]] / s[e] - 1, 9)))
    return out


@pytest.mark.parametrize("chunk_rows", [1, 16, None])
def test_labels_equal_sequential_wiring(closes_frame, chunk_rows):
    rng = np.random.default_rng(3)
    series = {f"s{k}": 100 * np.exp(np.cumsum(rng.normal(0.002 * k, 0.01, 150))) for k in range(3)}
    config = LabelConfig(1.5, 10, 1.0, 1.0, 7, 0.0)
    got = {}
    for r in triple_barrier_labels(closes_frame(series), config, chunk_rows=chunk_rows).orderBy("t0_seq").collect():
        got.setdefault(r.symbol, []).append((r.t0_seq, r.t1_seq, r.barrier, round(r.trgt, 9), round(r.ret, 9)))
    assert got == {s: sequential_labels(c, config) for s, c in series.items()}


def test_no_spurious_event_at_the_first_volatility(closes_frame):
    closes = np.append(100.0, 100 * np.exp(np.cumsum([0.003] * 6 + [0.0001] * 23)))
    labels = triple_barrier_labels(closes_frame(closes), LabelConfig(1.0, 5, 1.0, 1.0, 10, 0.0))
    assert 5 not in [r.t0_seq for r in labels.collect()]


@pytest.mark.parametrize("max_hp", [1, 15, 16, 37, 255, 300])
def test_first_touch_by_extrema_equals_walking(spark, closes_frame, max_hp):
    """Sparse touches, so that events climb the index and descend; both sides, targets that are never met among them."""
    rng = np.random.default_rng(max_hp)
    series = {s: np.round(100 * np.exp(np.cumsum(rng.normal(0, 0.002, n))), 4) for s, n in (("a", 700), ("b", 256), ("c", 1))}
    bets = [(s, t, float(rng.choice([0.001, 0.01, 0.03, 0.2])), int(rng.choice([-1, 1])), f"x{t}")
            for s, closes in series.items() for t in range(len(closes)) if t % 3 == 0 or t > len(closes) - 20]
    events = spark.createDataFrame(bets, "symbol string, t0_seq long, trgt double, side byte, note string")
    got = {(r.symbol, r.t0_seq): (r.t1_seq, r.barrier, r.note) for r in first_touch(closes_frame(series), events, 1.0, 1.5, max_hp).collect()}
    codes = set()
    for s, t, trgt, side, note in bets:
        closes, want = series[s], (None, None)
        for p in range(t, min(t + max_hp, len(closes) - 1) + 1):
            r = (closes[p] / closes[t] - 1) * side
            if r > trgt or r < trgt * -1.5:
                want = (p, 1 if r > 0 else -1)
                break
        else:
            if t + max_hp < len(closes):
                want = (t + max_hp, 0)
        codes.add(want[1])
        assert got[s, t] == (*want, note)
    assert len(got) == len(bets) and codes == {-1, 0, 1, None}


def test_first_touch_meets_one_row_a_step(spark, closes_frame):
    """No row is multiplied: all joins are keyed, and nothing but the top level of the index is exploded."""
    events = events_at(spark, [("s", 2, 0.1)]).withColumn("side", F.lit(1).cast("byte"))
    plan = first_touch(closes_frame(range(1, 50)), events, 1.0, 1.0, 2000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 5 and plan.count("Generate ") <= 1 and "Cross" not in plan
