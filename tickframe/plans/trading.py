"""Candles -> signals -> risk gate -> one audit row per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.validate import quarantine
from tickframe.operators.indicators import LATEST_CANDLES, latest_signals
from tickframe.operators.risk import SystemState, validate, with_state

_AUDIT = ["direction", "entry_price", "stop_loss", "take_profit", "risk_reward", "rsi", "confidence",
          "position_size", "risk_amount", "rejection_reason", "rejection_message"]


def candle_rules():
    """What a candle must satisfy to be judged."""
    present = [F.col(c).isNotNull() for c in ("open", "high", "low", "close", "volume")]
    return {"prices present": present[0] & present[1] & present[2] & present[3] & present[4]}


def audit(candles: DataFrame, symbols: DataFrame, state: SystemState, size: int = LATEST_CANDLES) -> DataFrame:
    """One row per symbol of ``symbols``: its newest candle's outcome.

    status is 'error' (unreadable candles), 'no_signal', 'rejected' or 'approved'. A bad candle
    fails its own symbol only.
    """
    good, bad = quarantine(candles, candle_rules())
    failed = bad.groupBy("symbol").agg(F.min("broken_rules").alias("_rules"))
    judged = validate(with_state(latest_signals(good, size), state))
    # The prefix is a fixed value.
    error = F.when(F.col("_rules").isNotNull(),
                   F.concat(F.lit("Candle fetch failed: "), F.array_join("_rules", ", ")))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("approved").isNull(), "no_signal") \
        .when(F.col("approved"), "approved").otherwise("rejected")
    row = (
        symbols.select("symbol").distinct().join(failed, "symbol", "left").join(judged, "symbol", "left")
        .withColumn("error", error).withColumn("status", status)
    )
    shown = [F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in _AUDIT]
    return row.select("symbol", "status", *shown, "error")
