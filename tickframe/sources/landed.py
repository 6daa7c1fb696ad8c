"""Landed pages: the JSON text of a feed's answers, decoded without failing the job.

A page is one row (keys, page_seq, body) and optionally ``error``, what the fetch failed with. A page that failed, is no JSON
list or holds a record that cannot be read fails its own series (the keys) and no other: the series counts 0 records and
keeps the reason of its first bad page. Bodies are parsed once, as VARIANT, in the scan; nothing is shuffled but one row a
series.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.schema import PRICE
from tickframe.session import materialize
from tickframe.sources import candles as candle_ops

SERIES = ["symbol", "timeframe"]
#: What a candle record lists, in this order, and what a trade record names (fixed values of the feed).
CANDLE_FIELDS = {"ts_ms": "bigint", "open": PRICE, "high": PRICE, "low": PRICE, "close": PRICE, "volume": PRICE}
TRADE_FIELDS = {"timestamp": "bigint", "price": "decimal(18,8)", "amount": "decimal(18,8)"}
#: Records that a trade page can hold; arrival numbers leave that much room a page.
TRADE_PAGE = 1_000


def _type(kind) -> str:
    return kind if isinstance(kind, str) else kind.simpleString()


def decode_pages(pages: DataFrame, keys: list[str], fields: dict, listed: bool) -> DataFrame:
    """(keys, page_seq, pos, fields, reason): one row per record, or one row with a reason and pos NULL for a page
    that cannot be read. A record is a list of exactly ``fields`` if ``listed``, else an object with these names; it has
    a reason if one of them is missing or not of its type. An empty list gives no row."""
    body = F.try_parse_json(F.col("body"))
    failed = F.col("error") if "error" in pages.columns else F.lit(None).cast("string")
    parsed = pages.select(*keys, "page_seq", failed.alias("_error"), F.col("body").isNull().alias("_none"), body.alias("_json"))
    records = parsed.withColumn("_records", F.try_variant_get("_json", "$", "array<variant>"))
    broken = F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("_none"), "no body").when(
        F.col("_json").isNull(), "not JSON").when(F.col("_records").isNull(), "not a list")
    opened = records.select(*keys, "page_seq", broken.alias("_broken"), F.posexplode_outer(
        F.when(broken.isNull(), F.col("_records"))).alias("pos", "_record")).filter("_broken IS NOT NULL OR pos IS NOT NULL")
    path = lambda i, name: f"$[{i}]" if listed else f"$.{name}"
    typed = opened.select(
        *keys, "page_seq", "pos", "_broken",
        (F.size(F.try_variant_get("_record", "$", "array<variant>")) if listed else F.lit(len(fields))).alias("_width"),
        *[F.try_variant_get("_record", path(i, name), _type(kind)).alias(name) for i, (name, kind) in enumerate(fields.items())])
    unread = F.lit(False)
    for name in fields:
        unread = unread | F.col(name).isNull()
    bad = F.coalesce(F.col("_width") != len(fields), F.lit(True)) | unread
    reason = F.coalesce("_broken", F.when(bad, F.concat(F.lit("record "), F.col("pos").cast("string"), F.lit(" cannot be read"))))
    return typed.select(*keys, "page_seq", "pos", *fields, reason.alias("reason"))


def series_status(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, records, reason): what each series brought; a series with a bad page counts 0 and names the first one."""
    first_bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("page_seq", "pos", "reason")))["reason"]
    return decoded.groupBy(*keys).agg(F.count("pos").alias("_n"), first_bad.alias("reason")).select(
        *keys, F.when(F.col("reason").isNull(), F.col("_n")).otherwise(0).alias("records"), "reason")


def good_series(decoded: DataFrame, status: DataFrame, keys: list[str]) -> DataFrame:
    """The records of the series without a bad page."""
    return decoded.join(status.filter("reason IS NOT NULL").select(*keys), keys, "left_anti").drop("reason")


def candle_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candles of the good series with their arrival order, status of every series) from pages of (symbol, timeframe)."""
    decoded = materialize(decode_pages(pages, SERIES, CANDLE_FIELDS, listed=True))
    status = series_status(decoded, SERIES)
    good = good_series(decoded, status, SERIES).withColumn("ingest_seq", F.struct("page_seq", "pos"))
    return candle_ops.normalize_candles(good), status


def trade_pages(pages: DataFrame, page_size: int = TRADE_PAGE) -> tuple[DataFrame, DataFrame]:
    """(trades of the good symbols, status of every symbol) from pages of (symbol); ``seq`` follows page and place."""
    decoded = materialize(decode_pages(pages, ["symbol"], TRADE_FIELDS, listed=False))
    status = series_status(decoded, ["symbol"])
    seq = F.col("page_seq") * page_size + F.col("pos")
    return good_series(decoded, status, ["symbol"]).select(
        "symbol", F.timestamp_millis("timestamp").alias("ts"), seq.cast("long").alias("seq"), "price", "amount"), status


def load_two_phases(pages: DataFrame, path: str, until: datetime, symbols: list[str], months: int = 6, days: int = candle_ops.LIVE_DAYS,
                    deep: str = candle_ops.DEEP_TIMEFRAME, live: str = candle_ops.LIVE_TIMEFRAME) -> DataFrame:
    """Load deep history and recent candles of all symbols from landed pages into the candle table at ``path``.

    Returns (symbol, timeframe, candles, reason) for both timeframes of every symbol asked for: the candles stored now, and
    why there are none if the series failed. A failed series leaves the others, also the symbol's other timeframe, alone.
    """
    wanted = pages.filter(F.col("symbol").isin(*symbols) & F.col("timeframe").isin(deep, live))
    good, status = candle_pages(wanted)
    chosen = candle_ops.two_phase(good, until, months, days, deep, live)
    chosen = materialize(chosen)
    fresh = materialize(candle_ops.new_candles(chosen, candle_ops.stored_beside(chosen, path)))
    candle_ops.append_candles(fresh, path)
    return candle_ops.load_counts(fresh, symbols, [deep, live]).join(status.select(*SERIES, "reason"), SERIES, "left")


def pages_of(records: DataFrame, keys: list[str], page_seq: Column, order: str, fields: list[Column], listed: bool) -> DataFrame:
    """The opposite way, for export and tests: (keys, page_seq, body) with the records of a page in ``order``."""
    record = F.concat(F.lit("["), F.concat_ws(",", *[f.cast("string") for f in fields]), F.lit("]")) if listed else F.to_json(F.struct(*fields))
    rows = records.select(*keys, page_seq.alias("page_seq"), F.struct(F.col(order).alias("at"), record.alias("text")).alias("_r"))
    texts = F.transform(F.sort_array(F.collect_list("_r")), lambda r: r["text"])
    return rows.groupBy(*keys, "page_seq").agg(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")).alias("body"))
