"""Candles and tickers: typing landed records, assembling ranges, storing without duplicates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tickframe.functions.exprs import time_order
from tickframe.functions.validate import require
from tickframe.schema import CANDLES, PRICE
from tickframe.session import materialize

# Defaults of the feed (fixed values).
SYMBOLS = ("BTC/USD", "ETH/USD")
TIMEFRAMES = ("15m", "1h", "4h", "1d")
DEEP_TIMEFRAME, LIVE_TIMEFRAME = "1h", "15m"
LIVE_DAYS = 7
MONTH_DAYS = 30
KEY = ["symbol", "timeframe", "timestamp"]
_PRICES = ["open", "high", "low", "close", "volume"]


def normalize_candles(raw: DataFrame) -> DataFrame:
    """Landed [ms, o, h, l, c, v] records (see schema.RAW_CANDLES) as typed UTC candles."""
    return raw.select(
        "symbol", "timeframe", F.timestamp_millis("ts_ms").alias("timestamp"),
        *[F.col(c).cast(PRICE).alias(c) for c in _PRICES],
        *(["ingest_seq"] if "ingest_seq" in raw.columns else []),
    )


def first_seen(candles: DataFrame) -> DataFrame:
    """One candle per (symbol, timeframe, timestamp): the one with the lowest ``ingest_seq``.

    A min_by hash aggregation rather than a window, so copies are dropped before the shuffle and a
    key with very many copies stays cheap.
    """
    earliest = F.min(F.struct("ingest_seq", *_PRICES)).alias("_first")  # whole rows, ties by their prices
    return candles.groupBy(*KEY).agg(earliest).select(*KEY, *[f"_first.{c}" for c in _PRICES])


def candle_range(candles: DataFrame, since, until) -> DataFrame:
    """Overlapping landed pages as one clean range, both bounds inclusive."""
    return first_seen(candles.filter(F.col("timestamp").between(F.lit(since), F.lit(until))))


def allow_list(symbols=SYMBOLS, timeframes=TIMEFRAMES) -> dict[str, Column]:
    return {"symbol": F.col("symbol").isin(*symbols), "timeframe": F.col("timeframe").isin(*timeframes)}


def require_supported(candles: DataFrame, symbols=SYMBOLS, timeframes=TIMEFRAMES) -> DataFrame:
    """Fail the job on a symbol or timeframe outside the lists."""
    return require(candles, allow_list(symbols, timeframes))


def normalize_tickers(raw: DataFrame) -> DataFrame:
    """Landed ticker snapshots; a missing 24 h volume is 0."""
    return raw.select(
        "symbol",
        *[F.col(c).cast(PRICE).alias(c) for c in ("bid", "ask", "last")],
        F.coalesce(F.col("base_volume"), F.lit(0)).cast(PRICE).alias("volume_24h"),
        F.timestamp_millis("ts_ms").alias("timestamp"),
    )


def latest_tickers(tickers: DataFrame) -> DataFrame:
    """The newest snapshot of each symbol."""
    fields = [c for c in tickers.columns if c not in ("symbol", "timestamp")]
    newest = F.max(F.struct("timestamp", *fields)).alias("_last")  # whole rows, ties by their values
    return tickers.groupBy("symbol").agg(newest).select("symbol", *[f"_last.{c}" for c in fields], "_last.timestamp")


def new_candles(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The incoming candles whose key is not stored yet, each key once."""
    seen = incoming if "ingest_seq" in incoming.columns else incoming.withColumn("ingest_seq", F.lit(0).cast("long"))
    once = first_seen(seen)
    return once.join(stored.select(*KEY), KEY, "left_anti")


#: Days that are looked up one by one; a batch of more days reads all from its first to its last.
LISTED_DAYS = 1_000
_STORED = StructType([*CANDLES.fields, StructField("day", DateType())])


def read_candles(spark: SparkSession, path: str) -> DataFrame:
    """The candle table, or a typed empty frame where nothing is stored yet."""
    return _read_or_empty(spark, path, _STORED).select(*CANDLES.fieldNames())


def stored_beside(incoming: DataFrame, path: str) -> DataFrame:
    """The stored candles of the days that ``incoming`` has candles of. The table is partitioned by day, so the files of all
    other days stay closed, however long the history is."""
    day = F.to_date("timestamp").alias("day")
    touched = incoming.select(day).distinct()
    days = [r["day"] for r in touched.limit(LISTED_DAYS + 1).collect()]
    stored = _read_or_empty(incoming.sparkSession, path, _STORED)
    if len(days) > LISTED_DAYS:
        first, last = touched.agg(F.min("day"), F.max("day")).first()
        return stored.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return stored.filter(F.col("day").isin(days)) if days else stored.filter(F.lit(False))


def append_candles(fresh: DataFrame, path: str) -> None:
    """Add candles that are known to be new; a large day is written by several tasks."""
    placed = fresh.select(*CANDLES.fieldNames(), F.to_date("timestamp").alias("day")).hint("rebalance", "day")
    placed.sortWithinPartitions("day", *KEY).write.mode("append").partitionBy("day").parquet(path)


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def store_candles(incoming: DataFrame, path: str) -> int:
    """Append the candles not stored yet and return how many were; safe to repeat. Only the stored days that the incoming
    candles touch are read."""
    fresh = materialize(new_candles(incoming, stored_beside(incoming, path)))
    # Counted on the materialized rows: in Spark 4.1 an Observation in the session makes the models of
    # pyspark.ml unserializable afterwards.
    inserted = fresh.count()
    if inserted:
        append_candles(fresh, path)
    return inserted


def history_window(until: datetime, months: int = 6) -> tuple[datetime, datetime]:
    """A month counts 30 days."""
    return until - timedelta(days=months * MONTH_DAYS), until


def recent_window(until: datetime, days: int = LIVE_DAYS) -> tuple[datetime, datetime]:
    return until - timedelta(days=days), until


def load_series(landed: DataFrame, path: str, symbol: str, timeframe: str, since, until) -> int:
    """Load one series of a landing area into the candle table."""
    one = landed.filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
    return store_candles(candle_range(one, since, until), path)


def two_phase(landed: DataFrame, until: datetime, months: int = 6, days: int = LIVE_DAYS,
              deep: str = DEEP_TIMEFRAME, live: str = LIVE_TIMEFRAME) -> DataFrame:
    """Deep history at one timeframe and recent candles at another, for all symbols in one job."""
    ts, tf = F.col("timestamp"), F.col("timeframe")
    wanted = ((tf == deep) & ts.between(*map(F.lit, history_window(until, months)))) | (
        (tf == live) & ts.between(*map(F.lit, recent_window(until, days))))
    return first_seen(landed.filter(wanted))


def load_counts(loaded: DataFrame, symbols: list[str], timeframes: list[str]) -> DataFrame:
    """(symbol, timeframe, candles) for every pair asked for, 0 where nothing came."""
    asked = loaded.sparkSession.createDataFrame(
        [(s, t) for s in symbols for t in timeframes], "symbol string, timeframe string")
    counts = loaded.groupBy("symbol", "timeframe").agg(F.count("*").alias("candles"))
    return asked.join(counts, ["symbol", "timeframe"], "left").fillna(0, ["candles"])


def series_extent(candles: DataFrame, asked: DataFrame) -> DataFrame:
    """(symbol, timeframe, candles, earliest, latest) for every pair of ``asked``; 0 and NULL where nothing is stored."""
    pairs = asked.select("symbol", "timeframe").distinct()
    return pairs.join(seed_report(candles), ["symbol", "timeframe"], "left").fillna(0, ["candles"])


def candle_count(candles: DataFrame, symbol: str, timeframe: str) -> int:
    return candles.filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)).count()


def date_range(candles: DataFrame, symbol: str, timeframe: str) -> tuple:
    """(earliest, latest), (None, None) when there is none."""
    one = candles.filter((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe))
    return tuple(one.agg(F.min("timestamp"), F.max("timestamp")).first())


def seed_report(candles: DataFrame) -> DataFrame:
    """Per symbol and timeframe: count, earliest and latest candle."""
    return candles.groupBy("symbol", "timeframe").agg(
        F.count("*").alias("candles"), F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
    )


def candles_from_trades(trades: DataFrame, timeframe: str, seconds: int) -> DataFrame:
    """Time-bucketed candles of a trade feed."""
    bucket = F.timestamp_seconds(F.floor(F.unix_micros("ts") / (seconds * 1_000_000)) * seconds)
    order = time_order()
    return trades.groupBy("symbol", bucket.alias("timestamp")).agg(
        F.min_by("price", order).cast(PRICE).alias("open"),
        F.max("price").cast(PRICE).alias("high"),
        F.min("price").cast(PRICE).alias("low"),
        F.max_by("price", order).cast(PRICE).alias("close"),
        F.sum("amount").cast(PRICE).alias("volume"),
    ).select("symbol", F.lit(timeframe).alias("timeframe"), "timestamp", *_PRICES)


# Columns served to clients (fixed values).
CANDLE_VIEW = ["id", "symbol", "timeframe", "timestamp", "open", "high", "low", "close", "volume"]
SIGNAL_VIEW = [
    "id", "symbol", "direction", "entry_price", "stop_loss", "take_profit", "position_size",
    "risk_amount", "risk_reward_ratio", "status", "technical_summary", "coordinator_summary",
    "created_at", "expires_at",
]
TRADE_VIEW = [
    "id", "signal_id", "mode", "symbol", "direction", "entry_price", "exit_price", "position_size",
    "pnl", "pnl_pct", "status", "opened_at", "closed_at",
]


def client_view(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.select(*columns)
