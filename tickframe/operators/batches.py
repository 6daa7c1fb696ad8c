"""Apply a user function to batches of rows and combine the results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_batches(atoms: DataFrame, func: Callable[..., pd.DataFrame], schema: str, rows: int,
                  seq: str = "seq", **kwargs) -> DataFrame:
    """Call ``func(batch, **kwargs)`` on batches of neighbouring positions, ``rows`` at most, and concatenate.

    ``seq`` is a position without repeats. Batches do not grow with the table, their number does; row order of the result
    is not defined.
    """
    if rows < 1:
        raise ValueError(f"rows must be >= 1, got {rows}.")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return func(frame.drop(columns="_batch").sort_values(seq), **kwargs)

    return atoms.withColumn("_batch", F.floor(F.col(seq) / rows)).groupBy("_batch").applyInPandas(run, schema)


def fold_batches(atoms: DataFrame, func: Callable[..., pd.DataFrame], combine: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame | None],
                 schema: str, rows: int, seq: str = "seq", fan_in: int = 32, **kwargs) -> DataFrame:
    """``combine`` folded over the batches' results in the order of their positions: one result, or none of an empty table.

    ``combine(left, right)`` takes the results of two neighbouring runs of batches and returns that of both, or None if it
    changed ``left`` in place. It must be associative; it need not be commutative. Results are combined ``fan_in`` neighbours
    at a time, level by level, so that no task holds more than that many and none reaches the driver.
    """
    if rows < 1 or fan_in < 2:
        raise ValueError(f"rows must be >= 1 and fan_in >= 2, got {rows} and {fan_in}.")
    names = [f.name for f in atoms.sparkSession.createDataFrame([], schema).schema]
    numbered = f"_run long, {schema}"

    def start(frame: pd.DataFrame) -> pd.DataFrame:
        made = func(frame.drop(columns="_run").sort_values(seq), **kwargs)
        return made.assign(_run=frame["_run"].iloc[0])[["_run", *names]]

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = None
        for _, one in frame.groupby("_part", sort=True):
            one = one[names].reset_index(drop=True)
            if total is None:
                total = one
            else:
                made = combine(total, one)
                total = total if made is None else made
        return total.assign(_run=frame["_run"].iloc[0])[["_run", *names]]

    placed = atoms.withColumn("_run", F.floor(F.col(seq) / rows).cast("long"))
    ends = placed.agg(F.min("_run"), F.max("_run")).first()
    runs = placed.groupBy("_run").applyInPandas(start, numbered)
    if ends[0] is None:
        return runs.drop("_run")
    first, last = ends
    while first != last:
        level = runs.withColumnsRenamed({"_run": "_part"}).withColumn("_run", F.floor(F.col("_part") / fan_in))
        runs = level.groupBy("_run").applyInPandas(merge, numbered)
        first, last = first // fan_in, last // fan_in
    return runs.drop("_run")


def reduce_batches(results: DataFrame, *aggregates) -> DataFrame | None:
    """Fold the concatenated results with aggregate expressions; None when there is no row."""
    return None if results.isEmpty() else results.agg(*aggregates)
