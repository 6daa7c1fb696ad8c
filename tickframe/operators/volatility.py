"""Log returns and exponentially weighted volatility over bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickframe.functions.exprs import rounded_vol
from tickframe.scan.chunks import with_halo
from tickframe.scan.prefix import decay_block, decayed_sums

DEFAULT_SPAN = 20
# Below this share of the mean square a variance is rounding noise of the two sums.
_NOISE = 1e-14


def with_log_returns(bars: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Add ``chunk``, ``log_ratio`` = ln(p/prev) and ``log_diff`` = ln p - ln prev.

    The two spellings differ in the last place: volatility uses the first, event sampling and
    attribution the second. Both are NULL on the first bar of a symbol.
    """
    previous = F.lag("close").over(Window.partitionBy("symbol", "chunk").orderBy("bar_seq"))
    return (
        with_halo(bars, "bar_seq", chunk_rows, before=1)
        .withColumn("_previous", previous)
        .withColumn("log_ratio", F.ln(F.col("close") / F.col("_previous")))
        .withColumn("log_diff", F.ln("close") - F.ln("_previous"))
        .filter(~F.col("is_halo"))
        .drop("is_halo", "_previous")
    )


def _decay(span: int) -> float:
    if span < 2:
        raise ValueError(f"span must be >= 2, got {span}.")
    return 1 - 2 / (span + 1)


def ewma_std(returns: DataFrame, value: str, span: int, name: str = "vol") -> DataFrame:
    """Add the bias-corrected EWMA standard deviation of ``value`` (NULL for the first ``span`` bars).

    ``returns`` is chunked as :func:`ewma_vol` does. Weights are q^k with q = 1 - 2/(span+1). With S0 =
    sum of weights, S1 and S2 the weighted sums of x and x^2, and Q the sum of squared weights, the
    variance is (S2/S0 - (S1/S0)^2) * S0^2 / (S0^2 - Q).
    """
    q = _decay(span)
    x = F.coalesce(F.col(value), F.lit(0.0))
    seen = F.when(F.col(value).isNull(), 0.0).otherwise(1.0)
    sums = decayed_sums(
        returns,
        {"_s0": (seen, q), "_s1": (x, q), "_s2": (x * x, q), "_w2": (seen, q * q)},
        "bar_seq",
    )
    mean_square = F.try_divide("_s2", "_s0")
    mean = F.try_divide("_s1", "_s0")
    spread = mean_square - mean * mean
    correction = F.try_divide(F.col("_s0") * F.col("_s0"), F.col("_s0") * F.col("_s0") - F.col("_w2"))
    variance = F.when(spread > mean_square * _NOISE, spread * correction).otherwise(0.0)
    return sums.withColumn(name, F.when(F.col("bar_seq") >= span, F.sqrt(variance))).drop(
        "_s0", "_s1", "_s2", "_w2"
    )


def ewma_vol(bars: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Bars with ``log_ratio``, ``log_diff`` and ``vol``; closes must be positive.

    One shuffle of the bars serves the lag and the decayed sums.
    """
    q = _decay(span)
    returns = with_log_returns(bars, decay_block([q, q * q]))
    return ewma_std(returns, "log_ratio", span).drop("chunk")


def ewma_vol_latest(vols: DataFrame) -> DataFrame:
    """Per symbol the last defined volatility at 8 decimals, 0 where there is none."""
    latest = F.max_by("vol", F.when(F.col("vol").isNotNull(), F.col("bar_seq")))
    return vols.groupBy("symbol").agg(
        F.coalesce(rounded_vol(latest), F.lit(0).cast("decimal(18,8)")).alias("ewma_vol")
    )


def signal_metadata(vols: DataFrame) -> DataFrame:
    """Per symbol the metadata map a signal packet carries."""
    return ewma_vol_latest(vols).select(
        "symbol", F.create_map(F.lit("ewma_vol"), F.col("ewma_vol")).alias("metadata")
    )


def packet_rules() -> dict[str, Column]:
    """Contract of a signal packet (side, confidence, metadata): rule name to condition."""
    return {
        "side": F.col("side").isin(1, -1),
        "confidence": F.col("confidence").between(0, 1),
        "metadata": F.coalesce(F.forall(F.map_values("metadata"), lambda v: v.isNotNull()), F.lit(False)),
    }
