"""Trades from landed feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def normalize_trades(raw: DataFrame) -> DataFrame:
    """Epoch-millisecond trade records (symbol, ts_ms, price, amount, seq) as typed trades.

    ``seq`` is the arrival number; it breaks ties between equal timestamps.
    """
    return raw.select(
        "symbol",
        F.timestamp_millis("ts_ms").alias("ts"),
        F.col("seq").cast("long").alias("seq"),
        F.col("price").cast("decimal(18,8)").alias("price"),
        F.col("amount").cast("decimal(18,8)").alias("amount"),
    )


def trades_from_events(events: DataFrame) -> DataFrame:
    """The event feed as trades: one series per event type."""
    size = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.lit(1000) + F.col("value")).cast("decimal(18,8)").alias("price"),
        ((size + 1) / 100).cast("decimal(18,8)").alias("amount"),
    )


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def read_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_from_events(read_events(spark, sf_dir))
