"""Moving averages, RSI, volume ratio and the signals built from them, over candles.

Every function takes candles of one timeframe; the series key is the symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickframe.functions.exprs import half_up
from tickframe.scan.chunks import ordered_chunks, with_halo
from tickframe.scan.prefix import decay_block, decayed_sums, dense_position
from tickframe.session import materialize

# Strategy constants (fixed values).
EMA_FAST = 9
EMA_SLOW = 21
RSI_PERIOD = 14
VOLUME_PERIOD = 20
SWING_LOOKBACK = 5
REWARD_MULTIPLE = 2
RSI_OVERBOUGHT = 70
RSI_OVERSOLD = 30
RSI_HIGH_CONFIDENCE = (40, 60)
MIN_CANDLES = 35
LATEST_CANDLES = 100
#: Partitions whose newest candles meet in one task.
TOP_FAN_IN = 64

_PRICE = "decimal(20,8)"


def number_candles(candles: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Candles with ``bar_seq``, their dense position from the start of the series."""
    return dense_position(ordered_chunks(candles, ["timestamp"], chunk_rows), "bar_seq").drop("pos", "chunk")


def latest_window(candles: DataFrame, size: int = LATEST_CANDLES) -> DataFrame:
    """The newest ``size`` candles of each symbol, numbered from the oldest of them.

    row_number <= size is limited in every partition, then in groups of ``TOP_FAN_IN`` partitions, then in the symbol: no task
    of the first step sees more than size * TOP_FAN_IN rows of a symbol, and the last one sees size rows a group.
    """
    newest = lambda *by: F.row_number().over(Window.partitionBy("symbol", *by).orderBy(F.col("timestamp").desc()))
    grouped = candles.withColumn("_group", F.floor(F.spark_partition_id() / TOP_FAN_IN))
    nearly = grouped.withColumn("_rn", newest("_group")).filter(F.col("_rn") <= size).drop("_group")
    kept = nearly.withColumn("_rn", newest()).filter(F.col("_rn") <= size)
    oldest = Window.partitionBy("symbol")
    return kept.withColumn("bar_seq", (F.max("_rn").over(oldest) - F.col("_rn")).cast("long")).drop("_rn")


def _smoothing(value: Column, seed: Column, first: int, weight: float) -> Column:
    """Increments of y <- (1-weight)*y + weight*value that starts from ``seed`` at position ``first``."""
    return F.when(F.col("bar_seq") == first, seed).when(F.col("bar_seq") > first, value * weight).otherwise(0.0)


def with_indicators(numbered: DataFrame) -> DataFrame:
    """Add ema_fast, ema_slow (and their previous values), rsi, volume_sma, volume_ratio, swing_low
    and swing_high; an indicator is NULL before its warm-up is complete.

    Averages are seeded with the simple mean of their first period and kept at 8 decimals, so equal
    averages compare as equal. One shuffle serves the row frames and the decayed sums.
    """
    fast, slow, wilder = 2 / (EMA_FAST + 1), 2 / (EMA_SLOW + 1), 1 / RSI_PERIOD
    block = decay_block([1 - fast, 1 - slow, 1 - wilder])
    w = Window.partitionBy("symbol", "chunk").orderBy("bar_seq")
    change = F.col("close") - F.lag("close").over(w)
    last = lambda n: w.rowsBetween(1 - n, 0)
    framed = (
        with_halo(numbered, "bar_seq", block, before=EMA_SLOW)
        .withColumn("_change", change)
        .withColumns({
            "_gain": F.greatest(F.col("_change"), F.lit(0)).cast("double"),
            "_loss": F.greatest(-F.col("_change"), F.lit(0)).cast("double"),
        })
        .withColumns({
            "_seed_fast": F.avg("close").over(last(EMA_FAST)).cast("double"),
            "_seed_slow": F.avg("close").over(last(EMA_SLOW)).cast("double"),
            "_seed_gain": F.avg("_gain").over(last(RSI_PERIOD)),
            "_seed_loss": F.avg("_loss").over(last(RSI_PERIOD)),
            "volume_sma": F.avg("volume").over(last(VOLUME_PERIOD)),
            "swing_low": F.min("low").over(last(SWING_LOOKBACK)),
            "swing_high": F.max("high").over(last(SWING_LOOKBACK)),
        })
        .filter(~F.col("is_halo")).drop("is_halo", "_change")
    )
    price = F.col("close").cast("double")
    smooth = decayed_sums(framed, {
        "_fast": (_smoothing(price, F.col("_seed_fast"), EMA_FAST - 1, fast), 1 - fast),
        "_slow": (_smoothing(price, F.col("_seed_slow"), EMA_SLOW - 1, slow), 1 - slow),
        "_up": (_smoothing(F.col("_gain"), F.col("_seed_gain"), RSI_PERIOD, wilder), 1 - wilder),
        "_down": (_smoothing(F.col("_loss"), F.col("_seed_loss"), RSI_PERIOD, wilder), 1 - wilder),
    }, "bar_seq")

    def ready(column: Column, first: int) -> Column:
        return F.when(F.col("bar_seq") >= first, column.cast(_PRICE))

    strength = 100 - 100 / (1 + F.try_divide(F.col("_up"), F.col("_down")))
    rsi = F.when(F.col("_down") == 0, F.lit(100.0)).otherwise(strength)
    ratio = F.when(F.col("volume_sma") > 0, F.try_divide(F.col("volume"), F.col("volume_sma"))).otherwise(0)
    with_averages = smooth.withColumns({
        "ema_fast": ready(F.col("_fast"), EMA_FAST - 1),
        "ema_slow": ready(F.col("_slow"), EMA_SLOW - 1),
        "rsi": F.when(F.col("bar_seq") >= RSI_PERIOD, half_up(rsi.cast("decimal(20,10)"), 2)).cast("decimal(5,2)"),
        "volume_ratio": ratio.cast("decimal(28,8)"),
    }).drop("chunk", "_fast", "_slow", "_up", "_down", "_gain", "_loss",
            "_seed_fast", "_seed_slow", "_seed_gain", "_seed_loss")
    # The values before a candle are those kept for the candle before, to the last decimal.
    kept = materialize(with_averages)
    before = kept.select("symbol", (F.col("bar_seq") + 1).alias("bar_seq"), F.col("ema_fast").alias("prev_fast"),
                         F.col("ema_slow").alias("prev_slow"))
    return kept.join(before, ["symbol", "bar_seq"], "left")


def crossover(prev_fast="prev_fast", prev_slow="prev_slow", fast="ema_fast", slow="ema_slow") -> Column:
    """'bullish', 'bearish' or NULL; strict on both sides, so touching is not crossing."""
    pf, ps, cf, cs = map(F.col, (prev_fast, prev_slow, fast, slow))
    return F.when((pf < ps) & (cf > cs), "bullish").when((pf > ps) & (cf < cs), "bearish")


def stop_loss(direction: Column) -> Column:
    return F.when(direction == "long", F.col("swing_low")).otherwise(F.col("swing_high"))


def take_profit(entry: Column, stop: Column, direction: Column) -> Column:
    reward = F.abs(entry - stop) * REWARD_MULTIPLE
    return F.when(direction == "long", entry + reward).otherwise(entry - reward).cast(_PRICE)


def risk_reward(entry: Column, stop: Column, target: Column) -> Column:
    """|target - entry| / |entry - stop| at 2 decimals half up, 0 when there is no risk."""
    ratio = F.try_divide(F.abs(target - entry), F.abs(entry - stop))
    return F.coalesce(half_up(ratio, 2), F.lit(0)).cast("decimal(10,2)")


def signals(indicators: DataFrame) -> DataFrame:
    """Candles that pass the gate: enough history, a crossover, RSI and volume confirmation."""
    direction = F.when(crossover() == "bullish", "long").when(crossover() == "bearish", "short")
    low, high = RSI_HIGH_CONFIDENCE
    d = F.col("direction")
    confirmed = ((d == "long") & (F.col("rsi") < RSI_OVERBOUGHT)) | ((d == "short") & (F.col("rsi") > RSI_OVERSOLD))
    entry, stop = F.col("close"), F.col("stop_loss")
    return (
        indicators.filter(F.col("bar_seq") >= MIN_CANDLES - 1)
        .withColumn("direction", direction).filter(d.isNotNull() & confirmed)
        # The ratio exceeds 1 exactly when the volume exceeds its average.
        .filter((F.col("volume_sma") > 0) & (F.col("volume") > F.col("volume_sma")))
        .withColumn("entry_price", entry)
        .withColumn("stop_loss", stop_loss(d))
        .withColumn("take_profit", take_profit(entry, stop, d))
        .withColumn("risk_reward", risk_reward(entry, stop, F.col("take_profit")))
        .withColumn("confidence", F.when(F.col("rsi").between(low, high), "high").otherwise("medium"))
        .select("symbol", "timeframe", "timestamp", "direction", "entry_price", "stop_loss", "take_profit",
                "risk_reward", "ema_fast", "ema_slow", "rsi", "volume_ratio", "confidence")
    )


def latest_signals(candles: DataFrame, size: int = LATEST_CANDLES) -> DataFrame:
    """The signal, if any, of each symbol's newest candle, with averages seeded at the window start."""
    window = latest_window(candles, size)
    newest = window.groupBy("symbol").agg(F.max("timestamp").alias("timestamp"))
    return signals(with_indicators(window)).join(newest, ["symbol", "timestamp"], "left_semi")
