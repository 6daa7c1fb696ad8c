"""Sequential bootstrap: many seeded replicates, each drawn in its own task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWS = "symbol string, replicate long, draw long, event_id long"


def _draw(starts: np.ndarray, ends: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Positions drawn one after another, each with chance proportional to its uniqueness given
    everything drawn before (with multiplicity).

    A draw changes the uniqueness of the spans that share a bar with it and of no other, so only these are
    reckoned anew. Sums over blocks of about sqrt(spans) find the position of a uniform number.
    """
    rng = np.random.default_rng(seed)
    spans = len(starts)
    bars = np.unique(np.concatenate([starts, ends + 1]))
    first, last = np.searchsorted(bars, starts), np.searchsorted(bars, ends + 1)
    width = np.diff(bars).astype("float64")
    covered = np.zeros(len(width), "int64")
    length = (ends - starts + 1).astype("float64")
    by_first = np.argsort(first, kind="stable")
    opened = first[by_first]
    longest = int((last - first).max())
    size = 1 << (max(1, spans - 1).bit_length() + 1) // 2
    blocks = -(-spans // size)
    weight = np.zeros((blocks, size))
    flat = weight.reshape(-1)
    flat[:spans] = 1.0
    block_sums = weight.sum(1)
    picks = np.empty(draws, "int64")
    for k in range(draws):
        chance = np.cumsum(block_sums)
        aim = rng.random() * chance[-1]
        block = min(int(chance.searchsorted(aim, "right")), blocks - 1)
        inner = np.cumsum(weight[block])
        left = aim - (chance[block - 1] if block else 0.0)
        pick = block * size + int(inner.searchsorted(min(left, np.nextafter(inner[-1], 0)), "right"))
        picks[k] = pick
        a, b = first[pick], last[pick]
        covered[a:b] += 1
        low, high = opened.searchsorted((a - longest + 1, b))
        near = by_first[low:high]
        near = near[last[near] > a]
        begin, end = first[near], last[near]
        base = int(begin.min())
        share = np.zeros(int(end.max()) - base + 1)
        np.cumsum(width[base:base + len(share) - 1] / (covered[base:base + len(share) - 1] + 1), out=share[1:])
        flat[near] = (share[end - base] - share[begin - base]) / length[near]
        lowest, highest = int(near.min()) // size, int(near.max()) // size
        some = slice(lowest, highest + 1) if highest - lowest < 4 else np.unique(near // size)
        block_sums[some] = weight[some].sum(1)
    return picks


def sequential_bootstrap(spans: DataFrame, seeds: list[int], draws: int | None = None) -> DataFrame:
    """(symbol, replicate, draw, event_id): ``draws`` events per symbol and seed (default: as many as
    the symbol has spans).

    Drawing is sequential by definition, so the unit of work is one replicate of one symbol. A draw costs the
    spans that overlap the drawn one and the square root of all, so short spans make it nearly linear; where
    every span overlaps every other it is O(draws x spans).
    """
    replicates = F.explode(F.array(*[F.lit(int(s)).cast("long") for s in seeds])).alias("replicate")
    copies = spans.select("symbol", "event_id", "t0_seq", "t1_seq", replicates)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("event_id")
        count = len(frame) if draws is None else draws
        picks = _draw(frame.t0_seq.to_numpy(), frame.t1_seq.to_numpy(), count, int(frame.replicate.iloc[0]))
        return pd.DataFrame({
            "symbol": frame.symbol.iloc[0], "replicate": frame.replicate.iloc[0],
            "draw": np.arange(count), "event_id": frame.event_id.to_numpy()[picks],
        })

    return copies.groupBy("symbol", "replicate").applyInPandas(run, DRAWS)
