"""The bounded wait for a reviewer as a stream-stream interval join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickframe.operators.review import APPROVAL_SECONDS


def matched_responses(signals: DataFrame, responses: DataFrame, seconds: int = APPROVAL_SECONDS,
                      delay: str = "30 seconds") -> DataFrame:
    """Signals with each response in time; a signal without any comes out once, when its wait is over.

    Both streams carry a watermark of ``delay``, so the join state holds no more than the signals and
    responses of the last ``seconds`` plus that delay.
    """
    sent = signals.withWatermark("sent_at", delay)
    answered = responses.filter(F.col("response").isin("approve", "cancel")).select(
        F.col("signal_id").alias("_id"), "responded_at", "response").withWatermark("responded_at", delay)
    in_time = (
        (F.col("signal_id") == F.col("_id")) & (F.col("responded_at") >= F.col("sent_at"))
        & (F.col("responded_at") < F.col("sent_at") + F.expr(f"interval {seconds} seconds"))
    )
    return sent.join(answered, in_time, "left_outer").drop("_id")


def stream_approvals(signals: DataFrame, responses: DataFrame, path: str, checkpoint: str,
                     seconds: int = APPROVAL_SECONDS, delay: str = "30 seconds", **trigger) -> StreamingQuery:
    return (
        matched_responses(signals, responses, seconds, delay).writeStream.format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def resolved(spark: SparkSession, path: str, signals: DataFrame | None = None) -> DataFrame:
    """(signal_id, decision, decided_at): the first response of each signal, else 'timeout'. With the sent ``signals`` those
    whose wait was not over when the stream stopped are there too, as 'pending'."""
    done = spark.read.parquet(path).groupBy("signal_id").agg(
        F.min(F.when(F.col("response").isNotNull(), F.struct("responded_at", "response"))).alias("_r")
    ).select("signal_id", F.coalesce("_r.response", F.lit("timeout")).alias("decision"),
             F.col("_r.responded_at").alias("decided_at"))
    if signals is None:
        return done
    return signals.select("signal_id").join(done, "signal_id", "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))
