"""Discretionary ideas: an append-only idea table and an append-only consumption log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.exprs import direction_rule, unit_interval_rule
from tickframe.functions.validate import require
from tickframe.schema import CONSUMED, IDEAS
from tickframe.sources.candles import _read_or_empty


def idea_rules():
    return {"direction": direction_rule(), "conviction": unit_interval_rule("conviction")}


def new_ideas(submitted: DataFrame) -> DataFrame:
    """Validated idea rows from (symbol, direction, conviction[, submitted_at]), each with its own ref."""
    at = F.col("submitted_at") if "submitted_at" in submitted.columns else F.current_timestamp()
    return require(submitted, idea_rules()).select(
        F.expr("uuid()").alias("signal_ref"), "symbol", "direction",
        F.col("conviction").cast("decimal(4,3)").alias("conviction"),
        F.lit("human").alias("provenance"), at.alias("submitted_at"))


def submit_ideas(submitted: DataFrame, path: str) -> None:
    new_ideas(submitted).write.mode("append").parquet(path)


def read_ideas(spark, path: str) -> DataFrame:
    return _read_or_empty(spark, path, IDEAS)


def read_consumed(spark, path: str) -> DataFrame:
    return _read_or_empty(spark, path, CONSUMED)


def pending_ideas(ideas: DataFrame, consumed: DataFrame, symbol: str | None = None) -> DataFrame:
    """Ideas without an entry in the consumption log."""
    wanted = ideas if symbol is None else ideas.filter(F.col("symbol") == symbol)
    return wanted.join(consumed.select("signal_ref"), "signal_ref", "left_anti")


def mark_consumed(refs: DataFrame, path: str) -> None:
    """Log (signal_ref) as consumed now; an unknown ref matches no idea and changes nothing."""
    refs.select("signal_ref", F.current_timestamp().alias("consumed_at")).write.mode("append").parquet(path)


def with_consumption(ideas: DataFrame, consumed: DataFrame) -> DataFrame:
    """Ideas with meta_label_consumed and the first consumption time."""
    first = consumed.groupBy("signal_ref").agg(F.min("consumed_at").alias("consumed_at"))
    return ideas.join(first, "signal_ref", "left").withColumn(
        "meta_label_consumed", F.col("consumed_at").isNotNull())
