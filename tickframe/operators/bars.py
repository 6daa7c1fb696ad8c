"""Dollar bars: trades grouped until their value reaches a threshold, then reset to zero."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.scan.carry import piece_schema, resolve_entries, simplify
from tickframe.scan.chunks import MAX_CHUNKS, chunk_bits, map_slices, ordered_chunks
from tickframe.schema import BARS

SCALE = 16                     # price and amount have 8 decimals each
HALF = 10 ** (SCALE // 2)
UNIT = 10 ** SCALE
UNITS_TYPE = "decimal(38,0)"   # dollar value in units of 10^-16


def units_of(value) -> int:
    """An exact number of 10^-16 dollars."""
    return int(Decimal(value).scaleb(SCALE).to_integral_exact())


def _prefix(whole: np.ndarray, frac: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact running sum of whole + frac/10^16 as a normalized pair, with a leading zero."""
    low = np.cumsum(frac % HALF)
    high = np.cumsum(frac // HALF) + low // HALF
    total = np.cumsum(whole) + high // HALF
    rest = (high % HALF) * HALF + low % HALF
    return np.concatenate([[0], total]), np.concatenate([[0], rest])


def _first_reaching(prefix, targets) -> np.ndarray:
    """For every target the first row whose running sum is at least the target (n if none)."""
    rows = len(prefix[0]) - 1
    wanted = len(targets[0])
    is_row = np.concatenate([np.zeros(wanted, "int64"), np.ones(rows, "int64")])
    order = np.lexsort((
        is_row,
        np.concatenate([targets[1], prefix[1][1:]]),
        np.concatenate([targets[0], prefix[0][1:]]),
    ))
    rank = np.empty(wanted + rows, "int64")
    rank[order] = np.cumsum(is_row[order])
    return rank[:wanted]


def _closings(prefix, threshold: int) -> np.ndarray:
    """For every row the row that closes a bar starting there."""
    frac = prefix[1][:-1] + threshold % UNIT
    return _first_reaching(prefix, (prefix[0][:-1] + threshold // UNIT + frac // UNIT, frac % UNIT))


def _slice_prefix(table: pa.Table):
    return _prefix(table["whole"].to_numpy(), table["frac"].to_numpy())


def _bar_map(table: pa.Table, threshold: int) -> pa.Table:
    """What one slice does to the value of the bar that is open when the slice begins."""
    prefix = _slice_prefix(table)
    rows = table.num_rows
    closing = _closings(prefix, threshold)
    # Follow "bar starting at i -> next bar's start" to the bar left open at the end, by doubling.
    start = np.append(np.where(closing < rows, closing + 1, np.arange(rows)), rows)
    bars = (start != np.arange(rows + 1)).astype("int64")
    while (start[start] != start).any():
        bars, start = bars + bars[start], start[start]
    value = [int(w) * UNIT + int(f) for w, f in
             zip(prefix[0][: closing[0] + 2], prefix[1][: closing[0] + 2])]
    total = int(prefix[0][-1]) * UNIT + int(prefix[1][-1])
    pieces = [] if closing[0] < rows else [(0, total, True, 0)]
    for row in range(min(int(closing[0]) + 1, rows)):
        if value[row + 1] > value[row]:
            left = int(start[row + 1])
            out = total - (int(prefix[0][left]) * UNIT + int(prefix[1][left]))
            pieces.append((max(0, threshold - value[row + 1]), out, False, 1 + int(bars[row + 1])))
    pieces = simplify(pieces)
    number = pa.decimal128(38, 0)
    return pa.table({
        "symbol": pa.array([table["symbol"][0].as_py()] * len(pieces), pa.string()),
        "chunk": pa.array([table["chunk"][0].as_py()] * len(pieces), pa.int64()),
        "lo": pa.array([Decimal(p[0]) for p in pieces], number),
        "out": pa.array([Decimal(p[1]) for p in pieces], number),
        "is_shift": pa.array([p[2] for p in pieces], pa.bool_()),
        "resets": pa.array([p[3] for p in pieces], pa.int64()),
    })


def _assign(table: pa.Table, threshold: int) -> pa.Table:
    """Add the bar number of every trade of one slice, given its entry value."""
    prefix = _slice_prefix(table)
    rows = table.num_rows
    closing = _closings(prefix, threshold)
    missing = threshold - int(table["entry"][0].as_py())
    first = _first_reaching(prefix, (np.array([missing // UNIT]), np.array([missing % UNIT])))
    opens = np.zeros(rows, "int64")
    row = int(first[0]) + 1
    while row < rows:
        opens[row] = 1
        row = int(closing[row]) + 1
    numbers = table["before"].to_numpy() + np.cumsum(opens)
    kept = table.select(["symbol", "pos", "ts", "price", "amount"])
    return kept.append_column("bar_seq", pa.array(numbers, pa.int64()))


def assign_bars(trades: DataFrame, threshold, chunk_rows: int | None = None,
                open_bars: DataFrame | None = None) -> DataFrame:
    """Number every trade with its bar: (symbol, pos, ts, price, amount, bar_seq)."""
    limit = units_of(threshold)
    if limit <= 0:
        raise ValueError(f"threshold must be positive, got {threshold!r}")
    rows = trades.count()
    chunked = ordered_chunks(trades.select("symbol", "ts", "seq", "price", "amount"), ["ts", "seq"], chunk_rows, rows)
    value = F.col("price") * F.col("amount")
    whole = F.floor(value).cast("long")
    valued = chunked.withColumn("whole", whole).withColumn(
        "frac", ((value - F.floor(value)) * F.lit(UNIT).cast("decimal(17,0)")).cast("long")
    )
    zero = F.lit(0).cast(UNITS_TYPE)
    initial = None if open_bars is None else open_bars.select(
        "symbol", (F.col("dollar_volume") * F.lit(UNIT).cast("decimal(17,0)")).cast(UNITS_TYPE).alias("entry"),
        F.col("bar_seq").alias("before"),
    )
    pieces = map_slices(
        valued.select("symbol", "chunk", "whole", "frac"),
        lambda table: _bar_map(table, limit), piece_schema(UNITS_TYPE), edges_only=initial is None,
    )
    entries = resolve_entries(pieces, initial, UNITS_TYPE)
    if initial is None:
        # A slice with anything before it is the first slice of its chunk, so what is left here has at most one row per
        # chunk and the chunk count is bounded by MAX_CHUNKS.
        first = entries.groupBy("symbol").agg(F.min("chunk").alias("first"))
        entries = entries.join(first, "symbol").filter("chunk > first").drop("first")
        bounded = True
    else:
        bounded = open_bars.count() <= MAX_CHUNKS
    filled = {"entry": F.coalesce("entry", zero), "before": F.coalesce("before", F.lit(0).cast("long"))}
    if bounded:
        placed = valued.join(F.broadcast(entries), ["symbol", "chunk"], "left").withColumns(filled)
    else:
        placed = (
            valued.join(entries, ["symbol", "chunk"], "left").withColumns(filled)
            .repartition("symbol", "chunk").sortWithinPartitions("symbol", "chunk", "pos")
        )
    return map_slices(
        placed.select("symbol", "chunk", "pos", "ts", "price", "amount", "whole", "frac", "entry", "before"),
        lambda table: _assign(table, limit),
        "symbol string, pos long, ts timestamp, price decimal(18,8), amount decimal(18,8), bar_seq long",
    )


def aggregate_bars(numbered: DataFrame) -> DataFrame:
    """One row per (symbol, bar_seq), exact decimals; also keeps the edge positions."""
    return numbered.groupBy("symbol", "bar_seq").agg(
        F.min("ts").alias("bar_start_ts"),
        F.max("ts").alias("bar_end_ts"),
        F.min_by("price", "pos").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "pos").alias("close"),
        F.sum("amount").alias("volume"),
        F.sum(F.col("price") * F.col("amount")).alias("dollar_volume"),
        F.count("*").alias("num_ticks"),
    )


def dollar_bars(trades: DataFrame, threshold, include_partial: bool = True,
                chunk_rows: int | None = None) -> DataFrame:
    """Dollar bars of every symbol.

    A bar closes on the first trade that brings its value to at least ``threshold``; the whole
    crossing trade belongs to it and the next bar starts from zero. The trailing bar of a symbol
    may be below the threshold: it has ``is_complete`` false, or is left out with
    ``include_partial=False``. Amounts must not be negative.
    """
    bars = aggregate_bars(assign_bars(trades, threshold, chunk_rows)).withColumn(
        "is_complete", F.col("dollar_volume") >= F.lit(str(threshold)).cast("decimal(38,16)")
    )
    return bars if include_partial else bars.filter("is_complete")


def bars_to_float(bars: DataFrame) -> DataFrame:
    """The stored form of bars: decimals become doubles only after aggregation."""
    return bars.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in BARS.fields])
