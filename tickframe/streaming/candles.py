"""Idempotent top-up of the candle table from a stream of landed candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tickframe.sources.candles import store_candles


def stream_candles(candles: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every candle whose key is not stored yet; replays and overlaps change nothing."""
    return (
        candles.writeStream.foreachBatch(lambda batch, _: store_candles(batch, path))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
