"""Purged, embargoed and combinatorial cross-validation folds over labelled spans.

Folds come out as rows (fold_id, symbol, event_id, role). Every bar a span ends on is a bar of the
grid, so the embargo is plain arithmetic on bar positions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.operators.weights import ordered_spans
from tickframe.scan.chunks import position_chunk, spread_join
from tickframe.scan.prefix import dense_position, running_sums
from tickframe.session import materialize


def _check_embargo(embargo_pct: float) -> None:
    if not 0 <= embargo_pct < 1:
        raise ValueError(f"embargo_pct must be in [0, 1), got {embargo_pct!r}.")


def _embargo_step(bars: str, embargo_pct: float) -> Column:
    return F.floor(F.col(bars) * F.lit(float(embargo_pct))).cast("long")


def _grid_sizes(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count("*").alias("n_bars"))


def embargo_times(bars: DataFrame, embargo_pct: float, chunk_rows: int | None = None) -> DataFrame:
    """Every bar with the bar ``int(n * embargo_pct)`` positions ahead, at most the last one."""
    _check_embargo(embargo_pct)
    grid = bars.select("symbol", "bar_seq", "bar_end_ts").withColumn(
        "chunk", position_chunk("bar_seq", chunk_rows))
    target = F.col("bar_seq") + _embargo_step("n_bars", embargo_pct)
    ahead = grid.select("symbol", F.col("bar_seq").alias("_ahead"), F.col("bar_end_ts").alias("_ahead_ts"))
    sizes = bars.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max_by("bar_end_ts", "bar_seq").alias("_last_ts"))
    # Bars at the end all have the last bar ahead: its time comes with the size, and their own keys meet nothing.
    placed = spread_join(grid, sizes).withColumn("_ahead", F.when(target < F.col("n_bars"), target).otherwise(-1 - F.col("bar_seq")))
    return placed.join(ahead, ["symbol", "_ahead"], "left").select(
        "symbol", "bar_seq", "bar_end_ts",
        F.when(F.col("_ahead") < 0, F.col("n_bars") - 1).otherwise(F.col("_ahead")).alias("embargo_seq"),
        F.when(F.col("_ahead") < 0, F.col("_last_ts")).otherwise(F.col("_ahead_ts")).alias("embargo_ts"))


def purge(bars: DataFrame, spans: DataFrame, test_spans: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """The spans that share no bar with any test span (both ends inclusive).

    A span meets as many test spans as start at or before its end, less those that end before its
    start. Both counts are running sums over the grid, so any number of test spans costs two point
    lookups per span and no range join. ``test_spans``: symbol, i_seq, j_seq.
    """
    marks = (
        test_spans.select("symbol", F.explode(F.array(
            F.struct(F.col("i_seq").alias("bar_seq"), F.lit(1).alias("starts"), F.lit(0).alias("ends")),
            F.struct(F.col("j_seq").alias("bar_seq"), F.lit(0).alias("starts"), F.lit(1).alias("ends")),
        )).alias("m"))
        .groupBy("symbol", "m.bar_seq").agg(F.sum("m.starts").alias("_s"), F.sum("m.ends").alias("_e"))
    )
    grid = bars.select("symbol", "bar_seq").withColumn("chunk", position_chunk("bar_seq", chunk_rows))
    zero = F.lit(0).cast("long")
    counted = materialize(running_sums(
        grid.join(marks, ["symbol", "bar_seq"], "left"),
        {"_started": F.coalesce("_s", zero), "_ended": F.coalesce("_e", zero)}, ["bar_seq"],
    ).withColumn("_ended", F.col("_ended") - F.coalesce("_e", zero)))
    started = counted.select("symbol", F.col("bar_seq").alias("t1_seq"), "_started")
    ended = counted.select("symbol", F.col("bar_seq").alias("t0_seq"), "_ended")
    return (
        spans.join(started, ["symbol", "t1_seq"]).join(ended, ["symbol", "t0_seq"])
        .filter(F.col("_started") - F.col("_ended") == 0).select(*spans.columns)
    )


def tiles(spans: DataFrame, groups: int, chunk_rows: int | None = None) -> DataFrame:
    """Spans in (t0, event_id) order with ``tile``: contiguous, the first n mod groups one longer."""
    keyed = spans if "event_id" in spans.columns else spans.withColumn("event_id", F.col("t0_seq"))
    chunked = ordered_spans(keyed, chunk_rows).select("symbol", "event_id", "t0_seq", "t1_seq", "pos", "chunk")
    placed = dense_position(chunked, "_p", "_n")
    error = F.raise_error(F.concat(F.lit(f"fewer events than {groups} folds for "), F.col("symbol")))
    placed = placed.withColumn("_n", F.when(F.col("_n") < groups, error.cast("long")).otherwise(F.col("_n")))
    base, longer = F.floor(F.col("_n") / groups), F.col("_n") % groups
    edge = longer * (base + 1)
    tile = F.when(F.col("_p") < edge, F.floor(F.col("_p") / (base + 1))).otherwise(
        longer + F.floor((F.col("_p") - edge) / base))
    return placed.withColumn("tile", tile.cast("int")).drop("_p", "_n", "pos")


def embargoed_blocks(tiled: DataFrame, bars: DataFrame, embargo_pct: float) -> DataFrame:
    """One row per tile: its first start and its last end, the end moved forward by the embargo."""
    return (
        tiled.groupBy("symbol", "tile").agg(F.min("t0_seq").alias("i_seq"), F.max("t1_seq").alias("max_t1"))
        .join(_grid_sizes(bars), "symbol")
        .withColumn("j_seq", F.least(F.col("max_t1") + _embargo_step("n_bars", embargo_pct),
                                     F.col("n_bars") - 1))
        .select("symbol", "tile", "i_seq", "j_seq")
    )


def _folds(spans: DataFrame, bars: DataFrame, groups: int, members: list[tuple[int, ...]],
           embargo_pct: float, chunk_rows: int | None) -> DataFrame:
    _check_embargo(embargo_pct)
    tiled = materialize(tiles(spans, groups, chunk_rows))
    blocks = embargoed_blocks(tiled, bars, embargo_pct)
    # One array of at most ``groups`` blocks per symbol; each span is compared with it once, whatever
    # the number of folds.
    listed = blocks.groupBy("symbol").agg(F.collect_list(F.struct("tile", "i_seq", "j_seq")).alias("_blocks"))
    touched = F.transform(
        F.filter("_blocks", lambda b: (F.col("t0_seq") <= b["j_seq"]) & (F.col("t1_seq") >= b["i_seq"])), lambda b: b["tile"])
    # Spans of one tile that touch the same tiles play the same role in every fold: a class. Folds meet classes, not spans.
    placed = spread_join(tiled, listed).withColumn("_touched", F.array_sort(touched)).drop("_blocks")
    fold_tiles = spans.sparkSession.createDataFrame(list(enumerate(map(list, members))), "fold_id long, tiles array<int>")
    role = F.when(F.array_contains("tiles", F.col("tile")), "test").when(~F.arrays_overlap("_touched", "tiles"), "train")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(members) - 1).cast("long")))
    classes = (
        placed.select("tile", "_touched").distinct().withColumn("fold_id", each).join(fold_tiles, "fold_id")
        .withColumn("role", role).filter("role IS NOT NULL")
        .groupBy("tile", "_touched").agg(F.collect_list(F.struct("fold_id", "role")).alias("_roles"))
    )
    return placed.join(classes, ["tile", "_touched"]).select(
        F.explode("_roles").alias("_f"), "symbol", "event_id", "t0_seq", "t1_seq").select(
        F.col("_f.fold_id").cast("int").alias("fold_id"), "symbol", "event_id", "t0_seq", "t1_seq", F.col("_f.role").alias("role"))


def purged_kfold(spans: DataFrame, bars: DataFrame, n_splits: int = 3, embargo_pct: float = 0.0,
                 chunk_rows: int | None = None) -> DataFrame:
    """Contiguous folds per symbol; training spans touching the embargoed test block are purged."""
    return _folds(spans, bars, n_splits, [(k,) for k in range(n_splits)], embargo_pct, chunk_rows)


def combinatorial_purged_kfold(spans: DataFrame, bars: DataFrame, n_groups: int = 6, n_test_groups: int = 2,
                               embargo_pct: float = 0.0, chunk_rows: int | None = None) -> DataFrame:
    """One fold per combination of test groups, in lexicographic order; each block has its own embargo."""
    members = list(combinations(range(n_groups), n_test_groups))
    return _folds(spans, bars, n_groups, members, embargo_pct, chunk_rows)
