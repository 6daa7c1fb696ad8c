"""Landed pages: what is decoded, what fails a series, and that it fails no other."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tickframe.sources import candles, landed

NOW = datetime(2024, 1, 31)
PAGES = "symbol string, timeframe string, page_seq long, body string, error string"


def ms(days_ago):
    return int(((NOW - timedelta(days=days_ago)) - datetime(1970, 1, 1)).total_seconds() * 1000)


def row(days_ago, close=1.5):
    return f"[{ms(days_ago)}, 1.1, 2, \"0.5\", {close}, 10]"


@pytest.mark.parametrize("body, reason", [
    ("[[1,2,3,4,5,6]]", None), ("[]", None), (" [ ] ", None), ("", "not JSON"), ("[[1,2,3,4,5,6]", "not JSON"), (None, "no body"), ("{}", "not a list"),
    ("7", "not a list"), ("null", "not a list"), ("[[1,2,3,4,5]]", "record 0 cannot be read"), ("[[1,2,3,4,5,6,7]]", "record 0 cannot be read"),
    ("[[1,2,3,4,5,6],[2,3,4,5,6,\"x\"]]", "record 1 cannot be read"), ("[[1,2,3,4,5,null]]", "record 0 cannot be read"),
    ("[null]", "record 0 cannot be read"), ("[{\"a\": 1}]", "record 0 cannot be read"), ("[[1,2,3,4,5,6], 3]", "record 1 cannot be read"),
])
def test_what_can_be_read(spark, body, reason):
    pages = spark.createDataFrame([("s", "1h", 0, body, None)], PAGES)
    good, status = landed.candle_pages(pages)
    found = [r.reason for r in status.collect()]
    assert found == ([reason] if reason or "[[" in body else [])
    assert good.count() == (1 if reason is None and "[[" in body else 0)


def test_records_keep_their_numbers(spark):
    pages = spark.createDataFrame([("s", "1h", 3, "[[1704067200123, 0.1, 12345678901.12345678, \"7.5\", 1e2, 0]]", None)], PAGES)
    r = landed.candle_pages(pages)[0].first()
    assert r.timestamp == datetime(2024, 1, 1, 0, 0, 0, 123000)
    assert (r.open, r.high, r.low, r.close, r.volume) == tuple(map(Decimal, ("0.1", "12345678901.12345678", "7.5", "100", "0")))


def test_the_first_bad_page_is_named_and_fails_its_series_alone(spark):
    pages = spark.createDataFrame([
        ("a", "1h", 0, f"[{row(3)}]", None), ("a", "1h", 2, "oops", None), ("a", "1h", 1, f"[{row(2)}, [1]]", None),
        ("a", "15m", 0, f"[{row(1)}]", None), ("b", "1h", 0, f"[{row(1)}]", "late"), ("b", "1h", 1, f"[{row(1)}]", None)], PAGES)
    good, status = landed.candle_pages(pages)
    assert {(r.symbol, r.timeframe): (r.records, r.reason) for r in status.collect()} == {
        ("a", "1h"): (0, "record 1 cannot be read"), ("a", "15m"): (1, None), ("b", "1h"): (0, "late")}
    assert [(r.symbol, r.timeframe) for r in good.collect()] == [("a", "15m")]


def test_two_phases_store_what_is_new_and_go_on_after_a_failure(spark, tmp_path):
    path = f"{tmp_path}/candles"
    pages = spark.createDataFrame([
        ("a", "1h", 0, f"[{row(1)},{row(20)},{row(40)}]", None), ("a", "1h", 1, f"[{row(20, 9)}]", None), ("a", "15m", 0, f"[{row(1)},{row(8)}]", None),
        ("b", "1h", 0, None, "network"), ("b", "15m", 0, f"[{row(2)}]", None), ("c", "1h", 0, f"[{row(1)}]", None)], PAGES)
    load = lambda: {(r.symbol, r.timeframe): (r.candles, r.reason) for r in landed.load_two_phases(
        pages, path, NOW, ["a", "b", "none"], months=1).collect()}
    assert load() == {("a", "1h"): (2, None), ("a", "15m"): (1, None), ("b", "1h"): (0, "network"), ("b", "15m"): (1, None),
                      ("none", "1h"): (0, None), ("none", "15m"): (0, None)}
    assert set(load().values()) == {(0, None), (0, "network")}
    stored = candles.read_candles(spark, path)
    assert stored.count() == 4 and stored.filter("close = 9").count() == 0


def test_trade_pages(spark):
    pages = spark.createDataFrame([
        ("x", 0, '[{"timestamp": 5, "price": 0.1, "amount": "2", "side": "buy"}, {"timestamp": 5, "price": 3, "amount": 1}]'),
        ("x", 1, '[{"timestamp": 6, "price": "7", "amount": 1}]'), ("y", 0, '[{"timestamp": 5, "price": 1}]'), ("z", 0, "[]")],
        "symbol string, page_seq long, body string")
    good, status = landed.trade_pages(pages)
    assert [(r.seq, r.price, r.amount) for r in good.orderBy("seq").collect()] == [
        (0, Decimal("0.1"), 2), (1, 3, 1), (1000, 7, 1)]
    assert {r.symbol: r.reason for r in status.collect()} == {"x": None, "y": "record 0 cannot be read"}
