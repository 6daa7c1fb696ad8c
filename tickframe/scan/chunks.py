"""Cutting ordered series into bounded chunks.

A series (one ``symbol``) may hold a large share of all rows, so nothing here gives a whole
series to one task. Two ways of cutting:

* :func:`ordered_chunks` for rows that only have an order: one range shuffle on
  (symbol, order...), which also splits a hot symbol or a hot timestamp, then a materialized
  row position. Chunks are slices of that position and are physically contiguous, so
  :func:`map_slices` can process them without another shuffle.
* :func:`position_chunk` / :func:`with_halo` for rows that already carry a dense position.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.session import materialize

MIN_CHUNK_ROWS = 1 << 18       # rows per chunk for ordered_chunks on ordinary inputs
MAX_CHUNKS = 1 << 20           # chunks grow instead of becoming more numerous than this
PARTITION_ROWS = 4_000_000     # rows per shuffle partition before the cap below
MAX_PARTITIONS = 50_000
POSITION_CHUNK_ROWS = 1 << 14  # rows per chunk for densely numbered series


def _bits(rows: int) -> int:
    return max(0, math.ceil(math.log2(rows)))


def chunk_bits(rows: int, chunk_rows: int | None = None) -> int:
    """Log2 of the chunk size for a frame of ``rows`` rows."""
    return _bits(chunk_rows or max(MIN_CHUNK_ROWS, math.ceil(rows / MAX_CHUNKS)))


def ordered_chunks(df: DataFrame, order: list[str], chunk_rows: int | None = None,
                   rows: int | None = None, reread: bool = True) -> DataFrame:
    """Sort by (symbol, order...) and add ``pos`` and ``chunk``.

    ``pos`` increases along (symbol, order...) over the whole frame, with gaps between
    partitions. ``chunk`` is a slice of ``pos`` with at most ``chunk_rows`` rows (rounded up to
    a power of two); there are at most MAX_CHUNKS + MAX_PARTITIONS of them at any input size.
    (symbol, order...) must be a total order. The result is materialized, because the range
    bounds are sampled and must be the same for every later reader. Sampling reads the input once
    more, so call this on stored or materialized rows; ``rows`` saves a count where it is known. A
    frame that fits in one chunk is sorted without sampling and has chunk 0 only; with
    ``reread=False`` it is not materialized, for callers that read it once.
    """
    rows = df.count() if rows is None else rows
    bits = chunk_bits(rows, chunk_rows)
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = max(
        1,
        math.ceil(rows / PARTITION_ROWS),
        min(cores, math.ceil(rows / (1 << bits))),
    )
    columns = ["symbol", *order]
    ordered = (
        df.repartitionByRange(min(partitions, MAX_PARTITIONS), *columns)
        .sortWithinPartitions(*columns)
        .withColumn("pos", F.monotonically_increasing_id())
        .withColumn("chunk", F.shiftright("pos", bits))
    )
    return materialize(ordered) if reread or partitions > 1 else ordered


def map_slices(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str,
               edges_only: bool = False) -> DataFrame:
    """Apply ``fn`` to every (symbol, chunk) slice of an :func:`ordered_chunks` frame in place.

    Slices are contiguous within a partition, so no shuffle or sort is planned. ``edges_only`` skips
    slices that are neither the first nor the last of their chunk: their series lies inside the chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at_edge in _slices(batches):
            if at_edge or not edges_only:
                yield from fn(table).to_batches()

    return df.mapInArrow(run, schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal ((symbol, chunk), rows) in every batch."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        table = pa.Table.from_batches([batch])
        symbol, chunk = table["symbol"].combine_chunks(), table["chunk"].combine_chunks()
        moved = pc.or_(
            pc.not_equal(symbol.slice(1), symbol.slice(0, rows - 1)),
            pc.not_equal(chunk.slice(1), chunk.slice(0, rows - 1)),
        )
        cuts = [0, *(pc.add(pc.indices_nonzero(moved), 1).to_pylist()), rows]
        for start, stop in zip(cuts, cuts[1:]):
            yield (symbol[start].as_py(), chunk[start].as_py()), table.slice(start, stop - start)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool]]:
    """(slice, whether it is the first or last slice of its chunk)."""
    before = None
    held: tuple[tuple, list[pa.Table]] | None = None
    for head, rows in _pieces(batches):
        if held and held[0] == head:
            held[1].append(rows)
            continue
        if held:
            chunk = held[0][1]
            yield pa.concat_tables(held[1]), chunk != before or chunk != head[1]
            before = chunk
        held = (head, [rows])
    if held:
        yield pa.concat_tables(held[1]), True


def position_chunk(position: str | Column, chunk_rows: int | None = None) -> Column:
    """Chunk number of a dense position: at most ``chunk_rows`` (a power of two) rows each."""
    column = F.col(position) if isinstance(position, str) else position
    return F.shiftright(column, _bits(chunk_rows or POSITION_CHUNK_ROWS))


def with_halo(df: DataFrame, position: str, chunk_rows: int | None = None,
              before: int = 0, after: int = 0) -> DataFrame:
    """Add ``chunk`` and copy edge rows to the neighbours that look at them.

    Every chunk also receives the ``before`` rows ahead of it and the ``after`` rows behind it,
    marked ``is_halo``, so that lag, lead and row frames of that reach are computed per
    (symbol, chunk). Drop the halo rows afterwards.
    """
    bits = _bits(chunk_rows or POSITION_CHUNK_ROWS)
    p = F.col(position)
    home = F.shiftright(p, bits)
    first = F.shiftright(F.greatest(p - after, F.lit(0)), bits)
    last = F.shiftright(p + before, bits)
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "is_halo", F.col("chunk") != home
    )


def spread_join(big: DataFrame, small: DataFrame, on: str = "symbol") -> DataFrame:
    """Join per-symbol (or per-day, ...) rows to a chunked frame on (on, chunk) instead of ``on``.

    ``small`` has one row per ``on`` value. It is first joined to the distinct (on, chunk) list, so
    the large join is balanced even when one value holds most rows, and no side is broadcast on
    trust.
    """
    chunks = big.select(on, "chunk").distinct()
    return big.join(chunks.join(small, on), [on, "chunk"])
