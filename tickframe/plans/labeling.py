"""Volatility -> sampled events -> barriers -> labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.configs import LabelConfig
from tickframe.operators.barriers import get_bins, get_events
from tickframe.operators.events import cusum_events
from tickframe.operators.volatility import ewma_vol
from tickframe.session import materialize


def sampled_events(bars: DataFrame, config: LabelConfig, chunk_rows: int | None = None) -> DataFrame:
    """(symbol, t0_seq, trgt, log_diff) of the sampled events.

    Volatility is computed once and serves as threshold and target. Sampling starts at the first bar
    with a volatility, so the first return used is the one after it.
    """
    vols = materialize(ewma_vol(bars.select("symbol", "bar_seq", "close"), config.ewma_span)
                       .select("symbol", "bar_seq", "log_diff", "vol"))
    sampled = vols.filter(F.col("bar_seq") > config.ewma_span).withColumn("h", F.col("vol") * config.kappa)
    fired = cusum_events(sampled, chunk_rows)
    target = vols.select("symbol", F.col("bar_seq").alias("t0_seq"), F.col("vol").alias("trgt"), "log_diff")
    return fired.join(target, ["symbol", "t0_seq"])


def triple_barrier_labels(bars: DataFrame, config: LabelConfig, side: DataFrame | None = None,
                          chunk_rows: int | None = None) -> DataFrame:
    """Labels of every symbol. ``bars``: symbol, bar_seq (dense from 0), bar_end_ts, close."""
    events = sampled_events(bars, config, chunk_rows)
    touched = get_events(bars, events, config.pt_mult, config.sl_mult, config.max_hp, config.min_ret, side)
    return get_bins(touched)
