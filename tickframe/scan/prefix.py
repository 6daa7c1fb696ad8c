"""Distributed running sums: local window per chunk plus the totals of earlier chunks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

EXACT = T.DecimalType(28, 18)   # term type for sums that must not depend on the chunking
_WIDE = T.DecimalType(37, 18)


def exact(column: Column) -> Column:
    """A double as a fixed-point term, so that running sums have no rounding drift."""
    return column.cast(EXACT)


def running_sums(df: DataFrame, sums: dict[str, Column], order: list[str],
                 totals: dict[str, Column] | None = None) -> DataFrame:
    """Add inclusive running sums over each symbol, for a frame with a ``chunk`` column.

    ``totals`` adds sums over the whole symbol in the same pass. The windows over rows see one chunk
    each; the second level sees one row per chunk, i.e. the row count divided by the chunk size. The
    frame is read twice, so pass a materialized or stored one.
    """
    upto = (
        Window.partitionBy("symbol", "chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    earlier = (
        Window.partitionBy("symbol").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("symbol")
    totals = totals or {}
    per_chunk = df.groupBy("symbol", "chunk").agg(
        *[F.sum(column).alias(f"__off_{name}") for name, column in {**sums, **totals}.items()]
    )
    offsets = per_chunk.select(
        "symbol", "chunk",
        *[F.sum(f"__off_{name}").over(earlier).alias(f"__off_{name}") for name in sums],
        *[F.sum(f"__off_{name}").over(whole).alias(name) for name in totals],
    )
    local = df.select("*", *[F.sum(column).over(upto).alias(name) for name, column in sums.items()])
    joined = local.join(offsets, ["symbol", "chunk"])
    for name in sums:
        kind = local.schema[name].dataType
        zero = F.lit(0).cast(kind)
        wide = _WIDE if isinstance(kind, T.DecimalType) else kind
        joined = joined.withColumn(name, F.coalesce(F.col(name), zero).cast(wide)
                                   + F.coalesce(F.col(f"__off_{name}"), zero).cast(wide))
    return joined.drop(*[f"__off_{name}" for name in sums])


def dense_position(df: DataFrame, name: str, size: str | None = None) -> DataFrame:
    """0-based position within the symbol, and optionally the symbol's row count, for a frame from
    ``ordered_chunks``."""
    one = F.lit(1).cast("long")
    counted = running_sums(df, {name: one}, ["pos"], {size: one} if size else None)
    return counted.withColumn(name, F.col(name) - 1)


def decay_block(factors: list[float]) -> int:
    """Rows per chunk for :func:`decayed_sums`: the largest power of two that keeps every factor's
    inverse power below about 1e130."""
    return 1 << max(1, math.floor(math.log2(300 / max(-math.log(q) for q in factors))))


def decayed_sums(df: DataFrame, sums: dict[str, tuple[Column, float]], position: str) -> DataFrame:
    """Add y_t = q*y_(t-1) + x_t per symbol (y before the first row is 0) over a dense position.

    ``df`` has ``chunk`` = position / decay_block(factors), e.g. from ``with_halo``, whose shuffle is
    reused. Inside a chunk y is ``q^i * sum(x * q^-i)``, one ordinary window sum; what came before a chunk reaches it by
    key from the blocks before, so no window spans a series. Chunks grow with the memory of the decay, never with the
    series.
    """
    m = decay_block([q for _, q in sums.values()])
    i = (F.col(position) - F.col("chunk") * m).cast("double")
    base = df.withColumn("_i", i)
    upto = (
        Window.partitionBy("symbol", "chunk").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    scaled = {n: (x * F.pow(F.lit(q), -F.col("_i")), q) for n, (x, q) in sums.items()}
    totals = base.groupBy("symbol", "chunk").agg(
        *[(F.sum(x) * F.lit(q ** (m - 1))).alias(f"__off_{n}") for n, (x, q) in scaled.items()]
    )
    # Every block's total goes to the blocks behind it, as far as its weight is a double above zero (e^-745): that is the
    # whole carry, and a bounded number of blocks for any series.
    reach = 1 + max(math.ceil(745 / (-math.log(q) * m)) for _, q in scaled.values())
    sent = totals.select("symbol", F.explode(F.array(*[
        F.struct((F.col("chunk") + k).alias("chunk"), *[
            (F.col(f"__off_{n}") * F.lit(q ** (m * (k - 1)))).alias(f"__off_{n}") for n, (_, q) in scaled.items()])
        for k in range(1, reach + 1)])).alias("_s")).select("symbol", "_s.*")
    carries = sent.groupBy("symbol", "chunk").agg(*[F.sum(f"__off_{n}").alias(f"__off_{n}") for n in scaled])
    local = base.select(
        "*",
        *[(F.sum(x).over(upto) * F.pow(F.lit(q), F.col("_i"))).alias(n)
          for n, (x, q) in scaled.items()],
    )
    joined = local.join(carries, ["symbol", "chunk"], "left").fillna(0.0, [f"__off_{n}" for n in scaled])
    for n, (_, q) in scaled.items():
        joined = joined.withColumn(
            n, F.col(n) + F.pow(F.lit(q), F.col("_i") + 1) * F.col(f"__off_{n}")
        )
    return joined.drop("_i", *[f"__off_{n}" for n in scaled])
