"""Carrying a resetting accumulator across chunks.

An accumulator that adds, resets and counts (a bar filling up, a CUSUM arm) turns the value it
holds on entering a chunk into the value it holds on leaving it. That function is a list of
pieces over the entry value: on most pieces the result is a constant, because a reset inside
the chunk forgot the entry value; on at most one kind of piece nothing reset and the result is
entry + shift. Such maps compose, so chunks are summarized independently, the summaries are
composed in groups, and every chunk gets its exact entry value without walking the series.

A piece row is (symbol, chunk, lo, out, is_shift, resets): it holds for entry values from ``lo``
up to the next piece's ``lo``.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickframe.session import materialize

GROUP = 256  # summaries composed by one task


def piece_schema(number: str) -> str:
    return f"symbol string, chunk long, lo {number}, out {number}, is_shift boolean, resets long"


def simplify(pieces: list[tuple]) -> list[tuple]:
    """Sort (lo, out, is_shift, resets) by lo and join equal neighbours."""
    kept: list[tuple] = []
    for piece in sorted(pieces, key=lambda p: p[0]):
        if not kept or kept[-1][1:] != piece[1:]:
            kept.append(piece)
    return kept


def apply_map(pieces: list[tuple], entry) -> tuple:
    """(exit value, resets) of one map."""
    _, out, is_shift, resets = pieces[max(0, bisect_right(pieces, entry, key=lambda p: p[0]) - 1)]
    return (entry + out if is_shift else out), resets


def _least_entry(lo, shift):
    """The least entry that the shift takes to ``lo`` or above; a float difference may round below it."""
    entry = lo - shift
    return math.nextafter(entry, math.inf) if isinstance(entry, float) and entry + shift < lo else entry


def compose(first: list[tuple], second: list[tuple]) -> list[tuple]:
    """The map of two neighbouring chunks as one."""
    joined = []
    for k, (lo, out, is_shift, resets) in enumerate(first):
        if not is_shift:
            value, more = apply_map(second, out)
            joined.append((lo, value, False, resets + more))
            continue
        hi = first[k + 1][0] if k + 1 < len(first) else None
        for j, (lo2, out2, shift2, resets2) in enumerate(second):
            start = lo if j == 0 else max(lo, _least_entry(lo2, out))
            stop = _least_entry(second[j + 1][0], out) if j + 1 < len(second) else None
            if (stop is not None and start >= stop) or (hi is not None and start >= hi):
                continue
            joined.append((start, out + out2 if shift2 else out2, shift2, resets + resets2))
    return simplify(joined)


def resolve_entries(pieces: DataFrame, initial: DataFrame | None, number: str,
                    group: int = GROUP) -> DataFrame:
    """Entry value and resets so far of every summarized chunk.

    ``pieces`` holds the map rows; they are materialized here, because every level reads them and
    they are small next to the rows they summarize. ``initial`` optionally gives (symbol, entry, before) at the
    start of a series (default 0, 0). Returns (symbol, chunk, entry, before). A task composes at
    most ``group`` maps; the number of levels is the logarithm of the chunk count.
    """
    # Chunk numbers may have wide gaps; the distinct ones, far fewer than the rows, are numbered
    # densely so that the number of levels follows the chunk count.
    pieces = materialize(pieces)
    number_chunks = Window.orderBy("chunk")
    ranks = pieces.select("chunk").distinct().withColumn("rank", F.row_number().over(number_chunks) - 1)
    top = pieces.select(F.count_distinct("chunk")).first()[0] - 1
    pieces = pieces.join(ranks, "chunk").select(
        "symbol", F.col("rank").cast("long").alias("chunk"), "lo", "out", "is_shift", "resets"
    )
    levels = 1
    while group ** levels <= top:
        levels += 1
    from_cell, to_cell = (float, float) if number == "double" else (int, Decimal)

    def maps(frame: pd.DataFrame, by: str):
        for chunk, rows in frame.sort_values([by, "lo"]).groupby(by, sort=True):
            yield chunk, simplify([
                (from_cell(lo), from_cell(out), bool(is_shift), int(resets))
                for lo, out, is_shift, resets in rows[["lo", "out", "is_shift", "resets"]]
                .itertuples(index=False)
            ])

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for _, one in maps(frame, "chunk"):
            total = one if total is None else compose(total, one)
        rows = [
            (frame.symbol.iloc[0], frame.chunk_group.iloc[0], to_cell(lo), to_cell(out), *rest)
            for lo, out, *rest in total
        ]
        return pd.DataFrame(rows, columns=["symbol", "chunk", "lo", "out", "is_shift", "resets"])

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        entry, before = from_cell(frame.entry.iloc[0]), int(frame.before.iloc[0])
        rows = []
        for chunk, one in maps(frame, "chunk"):
            rows.append((frame.symbol.iloc[0], chunk, to_cell(entry), before))
            entry, more = apply_map(one, entry)
            before += more
        return pd.DataFrame(rows, columns=["symbol", "chunk", "entry", "before"])

    def grouped(frame: DataFrame) -> DataFrame:
        return frame.withColumn("chunk_group", F.floor(F.col("chunk") / group))

    stack = [pieces]
    for _ in range(levels - 1):
        stack.append(
            grouped(stack[-1]).groupBy("symbol", "chunk_group").applyInPandas(fold, piece_schema(number))
        )
    zero = F.lit(0).cast(number)
    entries = pieces.select("symbol").distinct().withColumn("chunk_group", F.lit(0).cast("long"))
    if initial is None:
        entries = entries.withColumns({"entry": zero, "before": F.lit(0).cast("long")})
    else:
        entries = entries.join(initial.select("symbol", "entry", "before"), "symbol", "left").withColumns(
            {"entry": F.coalesce("entry", zero), "before": F.coalesce("before", F.lit(0).cast("long"))}
        )
    entry_schema = f"symbol string, chunk long, entry {number}, before long"
    for level in reversed(stack):
        entries = (
            grouped(level).join(entries, ["symbol", "chunk_group"])
            .groupBy("symbol", "chunk_group").applyInPandas(walk, entry_schema)
            .withColumnRenamed("chunk", "chunk_group")
        )
    return entries.withColumnRenamed("chunk_group", "rank").join(ranks, "rank").drop("rank")
