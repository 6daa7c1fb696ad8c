"""Concurrency, uniqueness, return attribution and time decay of labelled spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.scan.chunks import ordered_chunks, position_chunk
from tickframe.scan.prefix import exact, running_sums
from tickframe.session import materialize


def _checked(spans: DataFrame) -> DataFrame:
    """Spans whose ends are present and in order; the job fails on any other."""
    good = (F.col("t0_seq") >= 0) & (F.col("t0_seq") <= F.col("t1_seq"))
    error = F.raise_error(F.lit("spans must be resolved: 0 <= t0_seq <= t1_seq")).cast("long")
    return spans.withColumn("t1_seq", F.when(good, F.col("t1_seq")).otherwise(error))


def concurrency(grid: DataFrame, spans: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Grid rows with ``chunk`` and ``co_events``, the number of spans covering the bar.

    +1 where a span starts, -1 behind its end, then a running sum: spans are never expanded to the
    bars they cover, and equal starts are summed before the join. The job fails when a span starts or ends on a position
    that is not a bar of the grid.
    """
    steps = (
        _checked(spans).select("symbol", F.explode(F.array(
            F.struct(F.col("t0_seq").alias("bar_seq"), F.lit(1).alias("step")),
            F.struct((F.col("t1_seq") + 1).alias("bar_seq"), F.lit(-1).alias("step")),
        )).alias("s"))
        .groupBy("symbol", "s.bar_seq").agg(F.sum("s.step").alias("_step"))
    )
    stepped = grid.join(steps, ["symbol", "bar_seq"], "left").withColumn(
        "chunk", position_chunk("bar_seq", chunk_rows)
    )
    sums = {"co_events": F.coalesce("_step", F.lit(0).cast("long"))}
    counted = running_sums(stepped, sums, ["bar_seq"]).drop("_step")
    ends = spans.select("symbol", F.explode(F.array("t0_seq", "t1_seq")).alias("bar_seq")).filter("bar_seq IS NOT NULL").distinct()
    outside = ends.join(grid.select("symbol", "bar_seq"), ["symbol", "bar_seq"], "left_anti")
    error = F.raise_error(F.lit("spans must start and end on bars of the grid"))
    return counted.unionByName(outside.select(*[
        (error.cast("long") if f.name == "bar_seq" else F.lit(None)).cast(f.dataType).alias(f.name) for f in counted.schema]))


def _over_span(grid: DataFrame, spans: DataFrame, terms: dict[str, Column],
               chunk_rows: int | None) -> DataFrame:
    """Spans with the exact sum of each per-bar term over t0..t1, by two point lookups.

    The job fails when a span starts or ends on a position that is not a bar of the grid.
    """
    base = grid.select("symbol", "bar_seq", position_chunk("bar_seq", chunk_rows).alias("chunk"),
                       *[exact(c).alias(f"_x_{n}") for n, c in terms.items()])
    # Both frames are narrow, one row per bar, and read twice; recomputing them costs more.
    sums = materialize(running_sums(materialize(base), {f"_s_{n}": F.col(f"_x_{n}") for n in terms}, ["bar_seq"]))
    before = sums.select("symbol", F.col("bar_seq").alias("t0_seq"),
                         *[(F.col(f"_s_{n}") - F.col(f"_x_{n}")).alias(f"_a_{n}") for n in terms])
    upto = sums.select("symbol", F.col("bar_seq").alias("t1_seq"),
                       *[F.col(f"_s_{n}").alias(f"_b_{n}") for n in terms])
    joined = spans.join(before, ["symbol", "t0_seq"], "left").join(upto, ["symbol", "t1_seq"], "left")
    error = F.raise_error(F.lit("spans must start and end on bars of the grid")).cast("double")
    return joined.withColumns({
        n: F.coalesce((F.col(f"_b_{n}") - F.col(f"_a_{n}")).cast("double"), error) for n in terms
    }).drop(*[f"_{s}_{n}" for n in terms for s in "ab"])


def _inverse(co_events: str = "co_events") -> Column:
    return F.when(F.col(co_events) > 0, 1 / F.col(co_events)).otherwise(0.0)


def average_uniqueness(counted: DataFrame, spans: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Spans with ``avg_uniqueness``, the mean of 1/co_events over their bars.

    ``counted`` is a :func:`concurrency` frame; it is never recomputed here.
    """
    summed = _over_span(counted, spans, {"_u": _inverse()}, chunk_rows)
    return summed.withColumn(
        "avg_uniqueness", F.col("_u") / (F.col("t1_seq") - F.col("t0_seq") + 1)
    ).drop("_u")


def return_attribution(counted: DataFrame, spans: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Spans with ``attribution`` = abs(sum of log_diff/co_events); the missing first return counts 0."""
    term = F.coalesce(F.col("log_diff") * _inverse(), F.lit(0.0))
    return _over_span(counted, spans, {"_r": term}, chunk_rows).withColumn(
        "attribution", F.abs("_r")).drop("_r")


def uniqueness_and_attribution(counted: DataFrame, spans: DataFrame,
                               chunk_rows: int | None = None) -> DataFrame:
    """Both per-span measures from one pass over the grid."""
    terms = {"_u": _inverse(), "_r": F.coalesce(F.col("log_diff") * _inverse(), F.lit(0.0))}
    return _over_span(counted, spans, terms, chunk_rows).withColumns({
        "avg_uniqueness": F.col("_u") / (F.col("t1_seq") - F.col("t0_seq") + 1),
        "attribution": F.abs("_r"),
    }).drop("_u", "_r")


def ordered_spans(spans: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Spans in (t0_seq, event_id) order with ``pos`` and ``chunk``; unchanged if they have them.

    Order the spans before measuring them: the columns travel along, and no later step orders again.
    """
    if "chunk" in spans.columns and "pos" in spans.columns:
        return spans
    order = ["t0_seq", "event_id"] if "event_id" in spans.columns else ["t0_seq"]
    return ordered_chunks(spans.drop("chunk"), order, chunk_rows)


def normalize_weights(spans: DataFrame, weight: str, name: str, chunk_rows: int | None = None) -> DataFrame:
    """Add ``name``: the weight scaled so that each symbol's weights sum to their number."""
    measured = exact(F.coalesce(F.col(weight), F.lit(0.0)))
    summed = running_sums(ordered_spans(spans, chunk_rows), {}, ["pos"],
                          {"_total": measured, "_n": F.lit(1).cast("long")})
    total = F.col("_total").cast("double")
    scaled = F.when(total == 0, F.col(weight)).otherwise(F.col(weight) * F.try_divide(F.col("_n"), total))
    return summed.withColumn(name, scaled).drop("_total", "_n")


def time_decay(spans: DataFrame, decay_c: float, chunk_rows: int | None = None) -> DataFrame:
    """Add ``decay``: a factor linear in cumulative uniqueness (not in time), 1 for the newest span.

    c >= 0: the line runs from c at zero uniqueness to 1. c < 0: the oldest share is cut to 0. At
    c = -1 the line is undefined and the factor is NULL. Equal starts are ordered by event_id.
    """
    measured = exact(F.col("avg_uniqueness"))
    summed = running_sums(ordered_spans(spans, chunk_rows), {"_cum": measured}, ["pos"], {"_total": measured})
    total, cum = F.col("_total").cast("double"), F.col("_cum").cast("double")
    if decay_c >= 0:
        slope = F.try_divide(F.lit(1.0 - decay_c), total)
    else:
        slope = F.try_divide(F.lit(1.0), F.lit(decay_c + 1.0) * total)
    line = 1 - slope * total + slope * cum
    return summed.withColumn(
        "decay", F.when(line < 0, 0.0).otherwise(line)).drop("_cum", "_total")


def event_incidence(spans: DataFrame) -> DataFrame:
    """(symbol, bar_seq, event_id) for every bar a span covers: as many rows as the spans have bars. No operator here needs
    it; it is for looking at few spans."""
    return spans.select(
        "symbol", F.explode(F.sequence("t0_seq", "t1_seq")).alias("bar_seq"), "event_id"
    )


#: Bars of one mask.
MASK_BARS = 64


def incidence_masks(spans: DataFrame) -> DataFrame:
    """(symbol, event_id, block, mask): the bars a span covers, 64 to a row: bit i of ``mask`` is bar 64 * block + i."""
    block = lambda c: F.shiftright(c, 6)
    opened = _checked(spans).select("symbol", "event_id", "t0_seq", "t1_seq", F.explode(F.sequence(block("t0_seq"), block("t1_seq"))).alias("block"))
    base = F.col("block") * MASK_BARS
    low, high = F.greatest(F.col("t0_seq") - base, F.lit(0)).cast("int"), F.least(F.col("t1_seq") - base, F.lit(MASK_BARS - 1)).cast("int")
    ones = F.lit(-1).cast("long")
    # Ones from the low bit on, less those behind the high bit.
    upto = F.call_function("shiftrightunsigned", ones, (MASK_BARS - 1 - high).cast("int"))
    return opened.select("symbol", "event_id", "block", F.call_function("shiftleft", ones, low).bitwiseAND(upto).alias("mask"))


def bars_of_masks(masks: DataFrame) -> DataFrame:
    """(symbol, bar_seq, co_events): how many spans cover each bar that is covered at all, counted from the masks. A bar
    gets one row per block, not one per span."""
    bit = lambda i: F.sum(F.call_function("shiftrightunsigned", F.col("mask"), F.lit(i)).bitwiseAND(F.lit(1).cast("long")))
    counted = masks.groupBy("symbol", "block").agg(F.array(*[bit(i) for i in range(MASK_BARS)]).alias("counts"))
    return counted.select("symbol", "block", F.posexplode("counts").alias("i", "co_events")).filter("co_events > 0").select(
        "symbol", (F.col("block") * MASK_BARS + F.col("i")).alias("bar_seq"), "co_events")


def shared_bars(masks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(symbol, event_id, other_id, shared): how many bars both spans of each pair cover; ``pairs``: symbol, event_id, other_id."""
    other = masks.select("symbol", F.col("event_id").alias("other_id"), "block", F.col("mask").alias("_other"))
    met = pairs.join(masks, ["symbol", "event_id"]).join(other, ["symbol", "other_id", "block"]).groupBy("symbol", "event_id", "other_id").agg(
        F.sum(F.bit_count(F.col("mask").bitwiseAND(F.col("_other")))).alias("shared"))
    return pairs.join(met, ["symbol", "event_id", "other_id"], "left").fillna(0, ["shared"])


def incidence_uniqueness(grid: DataFrame, spans: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """(symbol, event_id, avg_uniqueness): per event the mean of 1/concurrency over its own bars, within the given events
    only. Counted on the grid, so spans are not expanded to their bars."""
    chosen = spans.select("symbol", "event_id", "t0_seq", "t1_seq")
    counted = concurrency(grid.select("symbol", "bar_seq"), chosen, chunk_rows)
    return average_uniqueness(counted, chosen, chunk_rows).select("symbol", "event_id", "avg_uniqueness")
