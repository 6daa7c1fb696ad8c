"""Sample weights of a label set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.configs import WeightConfig
from tickframe.operators.volatility import with_log_returns
from tickframe.operators.weights import (
    concurrency,
    normalize_weights,
    ordered_spans,
    time_decay,
    uniqueness_and_attribution,
)
from tickframe.session import materialize


def sample_weights(bars: DataFrame, labels: DataFrame, config: WeightConfig,
                   chunk_rows: int | None = None) -> DataFrame:
    """(symbol, t0_seq, t1_seq, avg_uniqueness, weight, t1).

    weight = normalized attribution x decay, not normalized again. Concurrency is counted once and
    feeds both measures.
    """
    keys = ["symbol", "t0_seq", "t1_seq", "t1"] + (["event_id"] if "event_id" in labels.columns else [])
    spans = ordered_spans(labels.select(*keys), chunk_rows)
    grid = with_log_returns(bars.select("symbol", "bar_seq", "close"), chunk_rows).drop("chunk")
    counted = concurrency(grid.select("symbol", "bar_seq", "log_diff"), spans, chunk_rows)
    measured = materialize(uniqueness_and_attribution(counted, spans, chunk_rows))
    weighted = time_decay(normalize_weights(measured, "attribution", "_norm"), config.decay_c)
    return weighted.withColumn("weight", F.col("_norm") * F.col("decay")).select(
        *keys[:3], "avg_uniqueness", "weight", *keys[3:]
    )
