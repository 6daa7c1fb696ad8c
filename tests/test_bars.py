import random
from datetime import timedelta
from decimal import Decimal

import pytest
from conftest import START

from tickframe.operators.bars import bars_to_float, dollar_bars
from tickframe.schema import BARS, TRADES
from tickframe.sources.trades import normalize_trades


def trades_of(spark, rows):
    """rows: (symbol, ts ms, seq, price, amount)"""
    return spark.createDataFrame(
        [(s, START + timedelta(milliseconds=ms), seq, Decimal(p), Decimal(a)) for s, ms, seq, p, a in rows], TRADES)


def sequential(rows, threshold):
    out = {}
    for s, ms, seq, p, a in sorted(rows, key=lambda r: r[:3]):
        p, a = Decimal(p), Decimal(a)
        bars = out.setdefault(s, [])
        if not bars or bars[-1]["value"] >= threshold:
            bars.append({"open": p, "high": p, "low": p, "value": Decimal(0), "volume": Decimal(0), "n": 0, "start": ms})
        bar = bars[-1]
        bar.update(high=max(bar["high"], p), low=min(bar["low"], p), close=p, value=bar["value"] + p * a,
                   volume=bar["volume"] + a, n=bar["n"] + 1, end=ms)
    return {
        (s, i): (b["open"], b["high"], b["low"], b["close"], b["volume"], b["value"], b["n"],
                 START + timedelta(milliseconds=b["start"]), START + timedelta(milliseconds=b["end"]),
                 b["value"] >= threshold)
        for s, bars in out.items() for i, b in enumerate(bars)
    }


def collected(bars):
    return {(r.symbol, r.bar_seq): (r.open, r.high, r.low, r.close, r.volume, r.dollar_volume, r.num_ticks,
                                    r.bar_start_ts, r.bar_end_ts, r.is_complete) for r in bars.collect()}


def test_crossing_trade_closes_the_bar(spark):
    rows = [("s", 1, 1, "80", "7"), ("s", 2, 2, "100", "5")]
    bar = dollar_bars(trades_of(spark, rows), 1000).collect()
    assert len(bar) == 1
    assert (bar[0].open, bar[0].high, bar[0].low, bar[0].close) == (80, 100, 80, 100)
    assert bar[0].dollar_volume == 1060 and bar[0].is_complete


def test_exact_threshold_closes_and_resets(spark):
    rows = [("s", 1000, 1, "500", "1"), ("s", 2000, 2, "500", "1"), ("s", 3000, 3, "1000", "1")]
    bars = dollar_bars(trades_of(spark, rows), 1000).orderBy("bar_seq").collect()
    assert [b.num_ticks for b in bars] == [2, 1]
    assert bars[1].bar_start_ts == START + timedelta(seconds=3)


def test_partial_bar_is_flagged_or_left_out(spark):
    rows = [("s", 1, 1, "600", "1"), ("s", 2, 2, "600", "1"), ("s", 3, 3, "5", "1")]
    trades = trades_of(spark, rows)
    assert [b.is_complete for b in dollar_bars(trades, 1000).orderBy("bar_seq").collect()] == [True, False]
    assert dollar_bars(trades, 1000, include_partial=False).count() == 1


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        dollar_bars(trades_of(spark, [("s", 1, 1, "1", "1")]), 0)


def random_rows(seed, n=400):
    rng = random.Random(seed)
    symbols = ["hot"] * 6 + ["b", "c"]  # one symbol holds most rows
    return [(rng.choice(symbols), rng.randrange(60), i, f"{rng.choice([1, 9.99, 100.00000001])}",
             f"{rng.choice(['0', '0.00000001', '1', '3.5'])}") for i in range(n)]


@pytest.mark.parametrize("chunk_rows", [1, 8, None])
@pytest.mark.parametrize("threshold", ["0.00000005", "137.5", "100000"])
def test_equals_sequential_accumulator(spark, chunk_rows, threshold):
    rows = random_rows(7)
    got = collected(dollar_bars(trades_of(spark, rows), Decimal(threshold), chunk_rows=chunk_rows))
    assert got == sequential(rows, Decimal(threshold))


def test_equal_trades_never_forget_the_phase(spark):
    # Boundaries from different entry values never meet: every chunk depends on all before it.
    rows = [("s", i, i, "1", "1") for i in range(300)]
    got = collected(dollar_bars(trades_of(spark, rows), 7, chunk_rows=4))
    assert got == sequential(rows, Decimal(7))


def test_stored_form_and_normalized_trades(spark):
    raw = spark.createDataFrame([("s", 1704067200123, 1, 10.5, 2.0)],
                                "symbol string, ts_ms long, seq long, price double, amount double")
    trades = normalize_trades(raw)
    assert trades.schema.simpleString() == TRADES.simpleString()
    stored = bars_to_float(dollar_bars(trades, 1))
    assert stored.schema.simpleString() == BARS.simpleString()
    assert stored.first().bar_end_ts == START + timedelta(milliseconds=123)
