"""The driver's tables seen as the frames the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.scan.chunks import ordered_chunks
from tickframe.scan.prefix import dense_position
from tickframe.sources import landed
from tickframe.sources.trades import read_events


def event_size() -> object:
    """The integer k of an event's JSON props."""
    return F.get_json_object("props", "$.k").cast("long")


def reviewer_outcomes(events: DataFrame) -> DataFrame:
    """Every event as one reviewer outcome; a third each approved, cancelled and timed out."""
    third = F.pmod("event_id", F.lit(3))
    k = event_size()
    return events.select(
        F.col("event_id").alias("signal_id"),
        F.col("event_type").alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "long").otherwise("short").alias("direction"),
        F.least((k + 1) / 100, F.lit(1.0)).cast("decimal(6,4)").alias("confidence"),
        (F.col("value") / 100).cast("decimal(20,8)").alias("position_size"),
        (third == 0).alias("approved"),
        (third == 2).alias("timed_out"),
        F.when(third == 2, 90.0).otherwise((k % 90) / 4).alias("latency_seconds"),
        F.col("ts").cast("timestamp").alias("at"),
    )


def ideas_from_events(events: DataFrame) -> DataFrame:
    """Every event as a submitted idea; some directions and convictions are invalid on purpose."""
    return events.select(
        F.col("event_id").cast("string").alias("signal_ref"),
        F.col("event_type").alias("symbol"),
        F.element_at(F.array(F.lit("long"), F.lit("short"), F.lit("flat")),
                     (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("direction"),
        ((event_size() % 14) / 10).cast("decimal(4,3)").alias("conviction"),
        F.lit("human").alias("provenance"),
        F.col("ts").cast("timestamp").alias("submitted_at"),
    )


def deals(events: DataFrame) -> DataFrame:
    """Every event as a signal with its trade; every third is closed."""
    value, ts = F.col("value"), F.col("ts").cast("timestamp")
    closed = F.pmod("event_id", F.lit(3)) == 0
    return events.select(
        F.col("event_id").alias("id"), (F.col("event_id") + 1).alias("signal_id"), "user_id",
        F.when(F.col("user_id") % 2 == 0, "paper").otherwise("live").alias("mode"), F.col("event_type").alias("symbol"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "long").otherwise("short").alias("direction"), (1000 + value).alias("entry_price"),
        (990 + value).alias("stop_loss"), (1020 + value).alias("take_profit"), F.when(closed, 1010 + value).alias("exit_price"),
        value.alias("position_size"), (2 * value).alias("risk_amount"), F.lit(2.0).alias("risk_reward_ratio"),
        F.when(closed, "closed").otherwise("open").alias("status"), F.col("props").alias("technical_summary"),
        F.lit(None).cast("string").alias("coordinator_summary"), ts.alias("created_at"),
        F.timestamp_micros(F.unix_micros(ts) + 900_000_000).alias("expires_at"), F.when(closed, 10 * value).alias("pnl"),
        F.when(closed, 0.5).alias("pnl_pct"), ts.alias("opened_at"),
        F.when(closed, F.timestamp_micros(F.unix_micros(ts) + 3_600_000_000)).alias("closed_at"))


def sent_signals(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("signal_id"), F.col("event_type").alias("symbol"),
                         F.col("ts").cast("timestamp").alias("sent_at"))


def reviewer_responses(events: DataFrame) -> DataFrame:
    """Two callbacks per event, 2k and 3(user_id mod 60) + 1 seconds later, with opposite answers."""
    first = F.when(F.pmod("event_id", F.lit(2)) == 0, "approve").otherwise("cancel")
    second = F.when(F.pmod("event_id", F.lit(2)) == 0, "cancel").otherwise("approve")
    answers = F.array(
        F.struct((event_size() * 2).alias("delay"), first.alias("response")),
        F.struct((F.pmod("user_id", F.lit(60)) * 3 + 1).alias("delay"), second.alias("response")),
    )
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.explode(answers).alias("a")).select(
        F.col("event_id").alias("signal_id"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("a.delay") * 1_000_000).alias("responded_at"),
        F.col("a.response").alias("response"),
    )


def landed_candles(candles: DataFrame) -> DataFrame:
    """Candles as landed pages that overlap: every fourth hour of the day arrives twice, later and altered."""
    again = F.pmod(F.hour("timestamp"), F.lit(8)) == 0
    copies = F.when(again, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return candles.withColumn("_copy", F.explode(copies)).select(
        "symbol", "timeframe", F.unix_millis("timestamp").alias("ts_ms"), "open", "high", "low",
        (F.col("close") + F.col("_copy")).alias("close"), "volume",
        (F.unix_millis("timestamp") + F.col("_copy") * 1_000_000_000).alias("ingest_seq"),
    )


def landed_pages(candles: DataFrame) -> DataFrame:
    """Candles as pages of a day each. One page of error/15m is cut off, one of signup/4h has a record with a word in it, and
    the fetch of one page of view/15m failed."""
    day = F.datediff(F.col("timestamp").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    fields = [F.unix_millis("timestamp"), *[F.col(c) for c in ("open", "high", "low", "close", "volume")]]
    pages = landed.pages_of(candles, ["symbol", "timeframe"], day, "timestamp", fields, listed=True)
    series, page = F.concat_ws("/", "symbol", "timeframe"), F.col("page_seq")
    cut = (series == "error/15m") & (page == 27)
    worded = (series == "signup/4h") & (page == 12)
    return pages.withColumns({
        "body": F.when(cut, F.expr("left(body, length(body) - 9)")).when(worded, F.regexp_replace("body", "^\\[\\[([0-9]+),[^,]*", '[[$1,"none"'))
        .otherwise(F.col("body")),
        "error": F.when((series == "view/15m") & (page == 28), "timed out")})


def landed_trade_pages(trades: DataFrame) -> DataFrame:
    """Trades as pages of records with a time in milliseconds, cut at every thousandth arrival number; one page of error is no list."""
    page = F.floor(F.col("seq") / landed.TRADE_PAGE)
    fields = [F.unix_millis("ts").alias("timestamp"), F.col("price").cast("double").alias("price"), F.col("amount").cast("string").alias("amount")]
    pages = landed.pages_of(trades, ["symbol"], page, "seq", fields, listed=False)
    return pages.withColumn("body", F.when((F.col("symbol") == "error") & (F.col("page_seq") == 0), F.lit('{"error": "busy"}')).otherwise(F.col("body")))


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as one series per priority: dense bar_seq by (date, key), close = price, and a span width."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("bar_end_ts"),
        F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("close"),
        F.pmod("o_custkey", F.lit(20)).alias("width"),
    )
    return dense_position(ordered_chunks(orders, ["bar_end_ts", "event_id"]), "bar_seq", "n")


def order_spans(series: DataFrame) -> DataFrame:
    """One span per order: from its position over ``width`` further orders, inside the series.

    Spans start where the series' rows are, so they keep its order columns.
    """
    return series.select(
        "symbol", "event_id", F.col("bar_seq").alias("t0_seq"),
        F.least(F.col("bar_seq") + F.col("width"), F.col("n") - 1).alias("t1_seq"), "pos", "chunk",
    )


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a file stream."""
    schema = read_events(spark, sf_dir).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
