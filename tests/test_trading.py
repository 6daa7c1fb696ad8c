from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from conftest import START
from pyspark.sql import functions as F

from tickframe.operators.indicators import (
    crossover, latest_signals, latest_window, number_candles, risk_reward, signals, take_profit, with_indicators,
)
from tickframe.operators.risk import SystemState, gate_view, kill_switch_due, validate, with_state
from tickframe.plans.trading import audit
from tickframe.schema import CANDLES

D = Decimal


def choppy_fall(n):
    """Falls by 20 every two candles with swings of about 100, so that RSI stays moderate."""
    return [42000 - 10 * i + (100 if i % 2 else 0) for i in range(n)]


@pytest.fixture(scope="session")
def candles_of(spark):
    def build(series):
        rows = []
        for symbol, closes in series.items():
            for i, close in enumerate(closes):
                c, v = close if isinstance(close, tuple) else (close, 100)
                c = None if c is None else D(str(round(c, 8)))
                low, high = (None, None) if c is None else (c - 50, c + 50)
                rows.append((symbol, "15m", START + timedelta(minutes=15 * i), c, high, low, c, D(v)))
        return spark.createDataFrame(rows, CANDLES)

    return build


def averages(closes):
    """Sequential averages in decimals: {position: value} for both EMAs and the RSI."""
    closes = [D(str(round(c, 8))) for c in closes]
    out = {}
    for n in (9, 21):
        m, ema = D(2) / D(n + 1), sum(closes[:n]) / D(n)
        out[n] = {n - 1: ema}
        for i in range(n, len(closes)):
            ema = closes[i] * m + ema * (1 - m)
            out[n][i] = ema
    steps = [b - a for a, b in zip(closes, closes[1:])]
    up, down = [max(s, D(0)) for s in steps], [max(-s, D(0)) for s in steps]
    gain, loss, out["rsi"] = sum(up[:14]) / 14, sum(down[:14]) / 14, {}
    for i in range(14, len(closes)):
        if i > 14:
            gain, loss = (gain * 13 + up[i - 1]) / 14, (loss * 13 + down[i - 1]) / 14
        rsi = D(100) if loss == 0 else 100 - 100 / (1 + gain / loss)
        out["rsi"][i] = rsi.quantize(D("0.01"), rounding=ROUND_HALF_UP)
    return out


def test_indicators_equal_sequential_decimals(candles_of):
    rng = np.random.default_rng(2)
    series = {s: list(42000 + np.cumsum(rng.normal(0, 100, n))) for s, n in (("a", 1500), ("b", 40))}
    frame = with_indicators(number_candles(candles_of(series), 64))
    for symbol, closes in series.items():
        want = averages(closes)
        rows = frame.filter(F.col("symbol") == symbol).orderBy("bar_seq").collect()
        assert [r.bar_seq for r in rows] == list(range(len(closes)))
        for r in rows:
            for name, key, back in (("ema_fast", 9, 0), ("ema_slow", 21, 0), ("prev_fast", 9, 1), ("prev_slow", 21, 1)):
                expected = want[key].get(r.bar_seq - back)
                assert (r[name] is None) == (expected is None)
                assert expected is None or abs(r[name] - expected) < D("3e-8")
            assert r.rsi == want["rsi"].get(r.bar_seq)


def test_flat_rising_and_falling_series(candles_of):
    frame = with_indicators(number_candles(candles_of(
        {"flat": [100] * 40, "up": range(100, 140), "down": range(200, 160, -1)})))
    last = {r.symbol: r for r in frame.filter("bar_seq = 39").collect()}
    assert last["flat"].ema_fast == last["flat"].ema_slow == last["flat"].prev_slow == 100
    assert (last["up"].rsi, last["down"].rsi) == (100, 0)
    assert last["flat"].volume_ratio == 1
    assert last["up"].swing_low == 135 - 50 and last["up"].swing_high == 139 + 50


def test_crossover_is_strict(spark):
    rows = [(99, 100, 101, 100), (101, 100, 99, 100), (100, 100, 101, 100), (99, 100, 100, 100)]
    frame = spark.createDataFrame(rows, "prev_fast int, prev_slow int, ema_fast int, ema_slow int")
    assert [r[0] for r in frame.select(crossover()).collect()] == ["bullish", "bearish", None, None]


def test_price_levels(spark):
    one = spark.range(1).select(
        take_profit(F.lit(D(42000)), F.lit(D(41000)), F.lit("long")).alias("long"),
        take_profit(F.lit(D(42000)), F.lit(D(43000)), F.lit("short")).alias("short"),
        risk_reward(F.lit(D(42000)), F.lit(D(41000)), F.lit(D(44000))).alias("rr"),
        risk_reward(F.lit(D(42000)), F.lit(D(42000)), F.lit(D(44000))).alias("none")).first()
    assert (one.long, one.short, one.rr, one.none) == (44000, 40000, 2, 0)


def test_gate_needs_history_crossover_and_volume(candles_of):
    jump = choppy_fall(45)[-1] + 750
    quiet = choppy_fall(45) + [(jump, 100)]
    short_history = choppy_fall(25) + [(jump + 200, 150)]
    frame = candles_of({"go": choppy_fall(45) + [(jump, 150)], "quiet": quiet, "short": short_history, "flat": [42000] * 50})
    found = latest_signals(frame).collect()
    assert [(r.symbol, r.direction) for r in found] == [("go", "long")]
    signal = found[0]
    assert signal.stop_loss == 42000 - 440 - 50 and signal.risk_reward == 2
    assert signal.take_profit == signal.entry_price + 2 * (signal.entry_price - signal.stop_loss)
    everywhere = signals(with_indicators(number_candles(frame))).collect()
    assert [r.symbol for r in everywhere] == ["go"]


def test_latest_window_is_seeded_at_its_start(candles_of):
    rng = np.random.default_rng(8)
    closes = list(42000 + np.cumsum(rng.normal(0, 100, 150)))
    row = with_indicators(latest_window(candles_of({"s": closes}))).filter("bar_seq = 99").first()
    want = averages(closes[-100:])
    assert row.rsi == want["rsi"][99] and abs(row.ema_slow - want[21][99]) < D("3e-8")


STATE = SystemState(D(10000), D(10000))


def judged(spark, state=STATE, entry="42000", stop="41500", target="43000", direction="long"):
    cells = [None if v is None else D(v) for v in (entry, stop, target)]
    frame = spark.createDataFrame([(*cells, direction)], "entry_price decimal(20,8), stop_loss decimal(20,8), "
                                  "take_profit decimal(20,8), direction string")
    return validate(with_state(frame, state)).first()


@pytest.mark.parametrize("state, signal, reason", [
    ({"kill_switch_active": True}, {}, "kill_switch_active"),
    ({"daily_pnl_pct": -0.05}, {}, "kill_switch_active"),
    ({"daily_pnl_pct": -0.0499}, {"stop": "41000", "target": "45000"}, None),
    ({"open_positions": 3}, {}, "max_positions_reached"),
    ({"open_positions": 2}, {"stop": "41000", "target": "45000"}, None),
    ({}, {"entry": None}, "invalid_signal"),
    ({}, {"stop": "0"}, "invalid_signal"),
    ({}, {"direction": ""}, "invalid_signal"),
    ({}, {"stop": "42000"}, "invalid_signal"),
    ({}, {"target": "42600"}, "invalid_risk_reward"),
    ({}, {"target": "42750"}, None),
    ({}, {"stop": "41990", "target": "42100"}, "insufficient_capital"),
    ({"kill_switch_active": True, "open_positions": 9}, {"entry": None}, "kill_switch_active"),
    ({"open_positions": 3}, {"entry": None}, "max_positions_reached"),
])
def test_risk_rules(spark, state, signal, reason):
    row = judged(spark, SystemState(D(10000), D(10000), **state), **signal)
    assert row.rejection_reason == reason and row.approved == (reason is None)
    assert (row.rejection_message is None) == (reason is None)


def test_size_and_rounding(spark):
    row = judged(spark)
    assert (row.position_size, row.risk_amount) == (D("0.20000000"), D("100.00"))
    # 1/8 cent of risk: half to even.
    row = judged(spark, SystemState(D("10000.5"), D(10 ** 9)), "10", "9", "20")
    assert row.risk_amount == D("100.00") and row.position_size == D("100.00500000")


def test_rejection_messages(spark):
    assert judged(spark, target="42600").rejection_message == "Risk/reward ratio 1.20 is below minimum 1.5."
    assert judged(spark, SystemState(D(1), D(1), daily_pnl_pct=-0.061)).rejection_message == \
        "Daily drawdown limit reached: -6.1%. Limit is 5.0%."
    assert judged(spark, SystemState(D(1), D(1), open_positions=4)).rejection_message == \
        "Maximum concurrent positions reached: 4/3."
    assert judged(spark, stop="41990", target="42100").rejection_message == \
        "Required capital $420000.00 exceeds available $10000.00."


def test_kill_switch_and_view(spark):
    frame = spark.createDataFrame([(-0.05,), (-0.049,)], "daily_pnl_pct double")
    assert [r[0] for r in frame.select(kill_switch_due()).collect()] == [True, False]
    view = gate_view(with_state(spark.createDataFrame([(1, 2, 3, "long", 4)], "entry_price int, stop_loss int, "
                                                      "take_profit int, direction string, x int"), STATE))
    assert view.columns == ["entry_price", "stop_loss", "take_profit", "direction"]


def test_audit_has_one_row_per_symbol(spark, candles_of):
    go = choppy_fall(45) + [(choppy_fall(45)[-1] + 750, 150)]
    frame = candles_of({"go": go, "flat": [42000] * 50, "broken": [42000] * 39 + [None]})
    symbols = spark.createDataFrame([("go",), ("flat",), ("broken",), ("absent",)], "symbol string")
    rows = {r.symbol: r for r in audit(frame, symbols, STATE).collect()}
    assert {s: r.status for s, r in rows.items()} == {
        "go": "approved", "flat": "no_signal", "broken": "error", "absent": "no_signal"}
    assert rows["go"].position_size is not None and "prices present" in rows["broken"].error
    blocked = audit(frame, symbols, SystemState(D(10000), D(10000), open_positions=3))
    assert {r.symbol: r.rejection_reason for r in blocked.collect()}["go"] == "max_positions_reached"
