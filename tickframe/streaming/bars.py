"""Dollar bars from a trade stream, equal to the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickframe.operators.bars import aggregate_bars, assign_bars
from tickframe.session import materialize

# The open bar of each symbol and the last trade applied to it. bar_seq is the open bar's number;
# its value is 0 and its prices are NULL when the last trade just closed a bar.
STATE = (
    "symbol string, bar_seq long, bar_start_ts timestamp, bar_end_ts timestamp, open decimal(18,8), "
    "high decimal(18,8), low decimal(18,8), close decimal(18,8), volume decimal(28,8), "
    "dollar_volume decimal(38,16), num_ticks long, last_us long, last_seq long"
)
_BAR = ["symbol", "bar_seq", "bar_start_ts", "bar_end_ts", "open", "high", "low", "close", "volume",
        "dollar_volume", "num_ticks"]


def advance(trades: DataFrame, state: DataFrame, threshold) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply one batch of trades: (completed bars, new state, late trades).

    A trade at or before the last applied one of its symbol is late and changes nothing. The scan is
    the chunked batch operator, so a symbol that dominates a batch is still split over tasks.
    """
    seen = trades.join(state.select("symbol", "last_us", "last_seq"), "symbol", "left")
    us = F.unix_micros("ts")
    is_late = F.coalesce(F.struct(us, F.col("seq")) <= F.struct("last_us", "last_seq"), F.lit(False)) \
        & F.col("last_us").isNotNull()
    marked = materialize(seen.withColumn("_late", is_late).drop("last_us", "last_seq"))
    late, fresh = marked.filter("_late").drop("_late"), marked.filter("NOT _late").drop("_late")
    limit = F.lit(str(threshold)).cast("decimal(38,16)")
    partial = aggregate_bars(assign_bars(fresh, threshold, open_bars=state)).select(*_BAR, F.lit(1).alias("_part"))
    held = state.filter("num_ticks > 0").select(*_BAR, F.lit(0).alias("_part"))
    merged = materialize(held.unionByName(partial).groupBy("symbol", "bar_seq").agg(
        F.min("bar_start_ts").alias("bar_start_ts"), F.max("bar_end_ts").alias("bar_end_ts"),
        F.min_by("open", "_part").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "_part").alias("close"),
        F.sum("volume").cast("decimal(28,8)").alias("volume"),
        F.sum("dollar_volume").cast("decimal(38,16)").alias("dollar_volume"),
        F.sum("num_ticks").alias("num_ticks"),
    ))
    done = merged.filter(F.col("dollar_volume") >= limit).select(*_BAR)
    open_ = merged.filter(F.col("dollar_volume") < limit)
    last = fresh.groupBy("symbol").agg(F.max(F.struct(us.alias("us"), F.col("seq").alias("seq"))).alias("l"))
    newest = last.select("symbol", F.col("l.us").alias("last_us"), F.col("l.seq").alias("last_seq"))
    known = state.select("symbol", "last_us", "last_seq").unionByName(newest).groupBy("symbol").agg(
        F.max(F.struct("last_us", "last_seq")).alias("l"))
    next_seq = done.groupBy("symbol").agg((F.max("bar_seq") + 1).alias("_next"))
    kept_seq = state.select("symbol", F.col("bar_seq").alias("_kept"))
    zero = F.lit(0).cast("decimal(38,16)")
    new_state = (
        known.join(open_, "symbol", "left").join(next_seq, "symbol", "left").join(kept_seq, "symbol", "left")
        .select(
            "symbol", F.coalesce("bar_seq", "_next", "_kept", F.lit(0).cast("long")).alias("bar_seq"),
            "bar_start_ts", "bar_end_ts", "open", "high", "low", "close", "volume",
            F.coalesce("dollar_volume", zero).alias("dollar_volume"),
            F.coalesce("num_ticks", F.lit(0).cast("long")).alias("num_ticks"),
            F.col("l.last_us").alias("last_us"), F.col("l.last_seq").alias("last_seq"),
        )
    )
    return done, new_state, late


def stream_dollar_bars(trades: DataFrame, threshold, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run the stream into ``root``: ``bars``, ``state`` and ``late``, one folder per micro-batch.

    Batch n reads the state of batch n-1 and overwrites its own folders, so a repeated batch gives
    the same files: each bar is stored exactly once.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            state = spark.createDataFrame([], STATE)
        else:
            state = spark.read.schema(STATE).parquet(f"{root}/state/batch={number - 1}")
        done, new_state, late = advance(batch, state, threshold)
        done.write.mode("overwrite").parquet(f"{root}/bars/batch={number}")
        late.write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        new_state.write.mode("overwrite").parquet(f"{root}/state/batch={number}")

    return (
        trades.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def completed_bars(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/bars").select(*_BAR)


def late_trades(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/late").drop("batch")
