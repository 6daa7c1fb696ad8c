"""A decision log whose rows carry the drift metrics of their moment."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickframe.operators.review import HISTORY_DAYS, classify, snapshot_metrics
from tickframe.session import materialize
from tickframe.sources.catalog import _exists

_HISTORY = ["signal_id", "at", "decided_at", "is_override"]


def log_batch(outcomes: DataFrame, root: str, number: int) -> None:
    """Classify one batch and store it with its snapshot metrics; repeating a batch overwrites it."""
    spark = outcomes.sparkSession
    fresh = materialize(classify(outcomes))
    first = fresh.agg(F.min("at")).first()[0]
    if first is None:
        return
    history = fresh.select(*_HISTORY)
    if _exists(spark, root):
        stored = spark.read.parquet(root).filter(F.col("batch") < number)
        # Older rows are outside every window of this batch.
        recent = stored.filter(F.col("decided_at") >= F.lit(first - timedelta(days=HISTORY_DAYS)))
        history = history.unionByName(recent.select(*_HISTORY))
    metrics = snapshot_metrics(history).select(
        "signal_id", F.col("mean").alias("historical_override_rate"),
        F.round("z_score", 3).alias("deviation_z_score"), F.col("escalate").alias("escalation_flag"))
    fresh.join(metrics, "signal_id").write.mode("overwrite").parquet(f"{root}/batch={number}")


def stream_decisions(outcomes: DataFrame, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    return (
        outcomes.writeStream.foreachBatch(lambda batch, number: log_batch(batch, root, number))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def decision_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).drop("batch")
