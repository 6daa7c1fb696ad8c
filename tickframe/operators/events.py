"""Symmetric CUSUM event sampling."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.scan.carry import piece_schema, resolve_entries, simplify
from tickframe.scan.chunks import position_chunk


def _arm_map(step: np.ndarray, limit: np.ndarray) -> list[tuple]:
    """How one arm, u <- max(0, u + step), back to 0 when above limit, changes over a slice.

    Without a reset the arm entering at u is at total_t + max(u, floor_t), where floor_t is how far
    the running total has dipped below its start. So u resets first at the first row whose
    ``limit - total`` is below u; a later row matters only if it lowers that bar.
    """
    rows = len(step)
    total = np.cumsum(step)
    floor = np.maximum.accumulate(np.maximum(0.0, -total))
    bar = limit - total
    zero_resets = np.flatnonzero(floor > bar)
    stop = int(zero_resets[0]) if len(zero_resets) else rows
    exits = _exits_from_zero(total, limit)
    pieces = []
    lowest = np.inf
    for row in np.flatnonzero(bar[:stop] < np.minimum.accumulate(np.append(np.inf, bar[:stop]))[:-1]):
        out, more = exits[row + 1]
        pieces.append((float(np.nextafter(bar[row], np.inf)), float(out), False, 1 + int(more)))
        lowest = bar[row]
    if stop < rows:
        out, more = exits[stop + 1]
        pieces.append((0.0, float(out), False, 1 + int(more)))
    else:
        pieces.append((0.0, float(total[-1] + floor[-1]), False, 0))
        if floor[-1] < lowest:
            pieces.append((float(np.nextafter(floor[-1], np.inf)), float(total[-1]), True, 0))
    return simplify(pieces)


def _exits_from_zero(total: np.ndarray, limit: np.ndarray) -> list[tuple]:
    """(exit value, resets) of an arm that is 0 just before row s, for every s."""
    rows = len(total)
    base = np.append(0.0, total)
    # An arm at 0 before row s resets at r if some base in s..r lies below total_r - limit_r. The
    # latest such base is found on a stack of bases that no later base undercuts.
    reset_at = np.full(rows + 1, rows, "int64")
    stack: list[int] = []
    heights: list[float] = []
    for row in range(rows):
        while heights and heights[-1] >= base[row]:
            stack.pop()
            heights.pop()
        stack.append(row)
        heights.append(base[row])
        below = bisect_left(heights, total[row] - limit[row])
        if below:
            latest = stack[below - 1]
            reset_at[latest] = min(reset_at[latest], row)
    reset_at = np.minimum.accumulate(reset_at[::-1])[::-1]
    low_after = np.minimum.accumulate(base[::-1])[::-1]
    exits: list[tuple] = [(0.0, 0)] * (rows + 2)
    for row in range(rows - 1, -1, -1):
        reset = reset_at[row]
        if reset == rows:
            exits[row] = (base[-1] - low_after[row], 0)
        else:
            out, more = exits[reset + 1]
            exits[row] = (out, more + 1)
    return exits


def _run_arms(y: np.ndarray, h: np.ndarray, up: float, down: float) -> tuple[np.ndarray, np.ndarray]:
    """The filter on one slice: fired flags of (lower arm, any arm).

    Between two firings both arms are a running total less its running extreme, so a block of rows is worked out
    at once and the filter jumps from firing to firing. Blocks double while nothing fires.
    """
    rows = len(y)
    low_fired, fired = np.zeros(rows, bool), np.zeros(rows, bool)
    at, block = 0, 64
    while at < rows:
        total = np.cumsum(y[at:at + block])
        limit = h[at:at + block]
        upper = total - np.minimum(np.minimum.accumulate(total), -up)
        lower = total - np.maximum(np.maximum.accumulate(total), -down)
        hits = np.flatnonzero((lower < -limit) | (upper > limit))
        if not len(hits):
            up, down = float(upper[-1]), float(lower[-1])
            at += block
            block *= 2
            continue
        first = int(hits[0])
        below = bool(lower[first] < -limit[first])
        low_fired[at + first], fired[at + first] = below, True
        up = float(upper[first]) if below else 0.0
        down = 0.0 if below else float(lower[first])
        at += first + 1
        block = max(64, 2 * (first + 1))
    return low_fired, fired


def _sorted_arrays(frame: pd.DataFrame):
    frame = frame.sort_values("bar_seq")
    limit = frame["h"].astype("float64").fillna(np.inf)
    return frame, frame["log_diff"].to_numpy("float64"), limit.to_numpy()


def _summaries(chunked: DataFrame, arm: str) -> DataFrame:
    def summarize(frame: pd.DataFrame) -> pd.DataFrame:
        frame, y, h = _sorted_arrays(frame)
        if arm == "upper":
            # Where the lower arm fires the upper one is not tested.
            low_fired, _ = _run_arms(y, h, 0.0, -float(frame["entry"].iloc[0]))
            pieces = _arm_map(y, np.where(low_fired, np.inf, h))
        else:
            pieces = _arm_map(-y, h)
        return pd.DataFrame([(frame.symbol.iloc[0], frame.chunk.iloc[0], *p) for p in pieces],
                            columns=["symbol", "chunk", "lo", "out", "is_shift", "resets"])

    return chunked.groupBy("symbol", "chunk").applyInPandas(summarize, piece_schema("double"))


def cusum_events(series: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """(symbol, t0_seq) of every bar where the filter fires.

    ``series``: symbol, bar_seq, log_diff, h, one row per bar. The upper arm is
    max(0, s + y), the lower min(0, s + y). The lower arm is tested first (s < -h), the upper only if
    the lower one did not fire (s > h); only the arm that fired returns to 0. A NULL h never fires.
    Rows with a NULL return are skipped.

    Chunks are summarized for the lower arm, then for the upper arm given the lower one's firings,
    and finally replayed with both true entry values; pass a materialized series, it is read by each
    of these steps.
    """
    chunked = series.filter("log_diff IS NOT NULL").select(
        "symbol", "bar_seq", "log_diff", F.nanvl(F.col("h").cast("double"), F.lit(None).cast("double")).alias("h")
    ).withColumn("chunk", position_chunk("bar_seq", chunk_rows))
    keys = ["symbol", "chunk"]
    lower = resolve_entries(_summaries(chunked, "lower"), None, "double").drop("before")
    entered = chunked.join(lower, keys)
    upper = resolve_entries(_summaries(entered, "upper"), None, "double").select(*keys, F.col("entry").alias("entry_up"))
    entered = entered.join(upper, keys)

    def replay(frame: pd.DataFrame) -> pd.DataFrame:
        frame, y, h = _sorted_arrays(frame)
        _, fired = _run_arms(y, h, float(frame["entry_up"].iloc[0]), -float(frame["entry"].iloc[0]))
        return frame.loc[fired, ["symbol", "bar_seq"]].rename(columns={"bar_seq": "t0_seq"})

    return entered.groupBy("symbol", "chunk").applyInPandas(replay, "symbol string, t0_seq long")
