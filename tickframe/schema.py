"""Declared schemas of the frames the operators exchange."""

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 8)
PRICE = T.DecimalType(20, 8)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
_B, _BOOL = T.ByteType(), T.BooleanType()

TRADES = _struct(symbol=_S, ts=_TS, seq=_L, price=AMOUNT, amount=AMOUNT)
BARS = _struct(
    symbol=_S, bar_seq=_L, bar_start_ts=_TS, bar_end_ts=_TS, open=_D, high=_D, low=_D, close=_D,
    volume=_D, dollar_volume=_D, num_ticks=_L, is_complete=_BOOL,
)
CANDLES = _struct(
    symbol=_S, timeframe=_S, timestamp=_TS, open=PRICE, high=PRICE, low=PRICE, close=PRICE,
    volume=PRICE,
)
RAW_CANDLES = _struct(
    symbol=_S, timeframe=_S, ts_ms=_L, open=_D, high=_D, low=_D, close=_D, volume=_D, ingest_seq=_L
)
TICKERS = _struct(symbol=_S, bid=PRICE, ask=PRICE, last=PRICE, volume_24h=PRICE, timestamp=_TS)
LABELS = _struct(
    symbol=_S, t0_seq=_L, t1_seq=_L, t0=_TS, t1=_TS, trgt=_D, ret=_D, bin=_B, barrier=_B
)
SYSTEM_STATE = _struct(
    total_capital=PRICE, available_capital=PRICE, open_positions=_L, daily_pnl_pct=_D,
    kill_switch_active=_BOOL,
)
REVIEWER_SESSIONS = _struct(
    signal_id=_L, symbol=_S, direction=_S, confidence=T.DecimalType(6, 4), recommended_size=PRICE,
    sent_at=_TS, decided_at=_TS, decision=_S, decision_latency_seconds=T.DecimalType(8, 3),
    hour_of_day=T.IntegerType(), is_override=_BOOL,
)
IDEAS = _struct(
    signal_ref=_S, symbol=_S, direction=_S, conviction=T.DecimalType(4, 3), provenance=_S,
    submitted_at=_TS,
)
CONSUMED = _struct(signal_ref=_S, consumed_at=_TS)
