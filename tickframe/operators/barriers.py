"""Vertical barrier, first touch and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.exprs import passes_target, sign_label
from tickframe.session import materialize

# Barrier codes (fixed values).
LOWER, VERTICAL, UPPER = -1, 0, 1


def vertical_barriers(bars: DataFrame, events: DataFrame, max_hp: int) -> DataFrame:
    """Events with ``t1_seq``/``t1``: the bar ``max_hp`` bars ahead, NULL past the end of the data."""
    if max_hp < 1:
        raise ValueError(f"max_hp must be >= 1, got {max_hp}.")
    grid = bars.select("symbol", (F.col("bar_seq") - max_hp).alias("t0_seq"),
                       F.col("bar_seq").alias("t1_seq"), F.col("bar_end_ts").alias("t1"))
    return events.join(grid, ["symbol", "t0_seq"], "left")


#: Children of a node of the extrema index.
FAN = 16


def _spot(position: Column, level: int) -> Column:
    """Number of the node of a level that a bar is in."""
    return F.shiftright(position, level * (FAN.bit_length() - 1))


def extrema_index(bars: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes (symbol, node, children) of levels 1..``levels`` over ``bars`` (symbol, bar_seq dense from 0, bar_end_ts, close).

    A node of level k spans FAN^k bars. Its children, in order, are bars (low = high = close, with their time) on level 1 and
    nodes of the level below above that. Nodes of the top level also list the children of the node behind them.
    """
    below = bars.select("symbol", F.col("bar_seq").alias("place"), F.col("close").alias("low"), F.col("close").alias("high"),
                        F.col("bar_end_ts").alias("ts"))
    found = []
    for level in range(1, levels + 1):
        node = _spot(F.col("place"), 1)
        if level == levels:
            node = F.explode(F.array(node, node - 1))
        fields = ["place", "low", "high"] + (["ts"] if level == 1 else [])
        nodes = below.withColumn("node", node).groupBy("symbol", "node").agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias("children"))
        if level < levels:
            nodes = materialize(nodes)
            below = nodes.select("symbol", F.col("node").alias("place"), F.array_min(F.transform("children", lambda c: c["low"])).alias("low"),
                                 F.array_max(F.transform("children", lambda c: c["high"])).alias("high"))
        found.append(nodes)
    return found


def first_touch(bars: DataFrame, events: DataFrame, pt_mult: float, sl_mult: float,
                max_hp: int) -> DataFrame:
    """Which barrier each event touches first, on closes.

    ``events``: symbol, t0_seq (unique per symbol), trgt, side and any further columns. The path is
    the bars t0 .. t0+max_hp. A return strictly above pt_mult*trgt is UPPER, strictly below
    -sl_mult*trgt is LOWER, a multiplier of 0 switches its side off; a horizontal touch wins over
    the vertical barrier on the same bar. With no touch and no bar at t0+max_hp, t1 is NULL.

    Plan: a return rises (or, short, falls) with the close, so a node of the extrema index holds a touch if the return at its
    highest or lowest close is one. An event climbs from its own node to the first node behind it that holds a touch, and
    descends in that to the bar. Every step is an equi-join on (symbol, node) that meets one row, two steps for each power of
    FAN in max_hp, one less at the top; up to FAN - 1 bars it is one join in all.
    """
    if max_hp < 1:
        raise ValueError(f"max_hp must be >= 1, got {max_hp}.")
    levels = 1
    while FAN ** levels <= max_hp:
        levels += 1
    index = extrema_index(bars, levels)

    def ret(close: Column) -> Column:
        return (close / F.col("_close0") - 1) * F.col("side")

    def up(c: Column) -> Column:
        return ret(F.when(F.col("side") > 0, c["high"]).otherwise(c["low"])) > F.col("trgt") * pt_mult if pt_mult > 0 else F.lit(False)

    def down(c: Column) -> Column:
        return ret(F.when(F.col("side") > 0, c["low"]).otherwise(c["high"])) < F.col("trgt") * -sl_mult if sl_mult > 0 else F.lit(False)

    def first(start: Column) -> Column:
        """The first child from a place on, up to the vertical barrier, that holds a touch."""
        return F.get(F.filter("children", lambda c: (c["place"] >= start) & (up(c) | down(c))), F.lit(0))

    t0, end = F.col("t0_seq"), F.col("t0_seq") + max_hp
    at = lambda position: F.get("children", (position - F.col("node") * FAN).cast("int"))
    # A key of its own for rows that look nothing up, so that they spread.
    no_key = -2 - t0
    sought = events.drop("t0").withColumn("node", _spot(t0, 1)).join(index[0], ["symbol", "node"]).withColumn("_start", at(t0)).filter(
        "_start IS NOT NULL").withColumns({"t0": F.col("_start.ts"), "_close0": F.col("_start.low")})
    hit = first(t0)
    near = F.when(hit["place"] <= end, hit)
    state = sought.withColumn("_end", F.coalesce(near, at(end) if levels == 1 else F.lit(None))).drop("children", "node", "_start")
    if levels > 1:
        state = state.withColumns({"_open": F.lit(None).cast("long"), "_level": F.lit(0)})
        for level in range(2, levels + 1):
            seeking = F.col("_end").isNull() & F.col("_open").isNull()
            found = first(_spot(t0, level - 1) + 1)["place"]
            placed = state.withColumn("node", F.when(seeking, _spot(t0, level)).otherwise(no_key)).join(index[level - 1], ["symbol", "node"], "left")
            inside = found <= _spot(end, level - 1)
            state = placed.withColumns({"_open": F.coalesce("_open", F.when(inside, found)),
                                        "_level": F.when(F.col("_open").isNull() & inside, level - 1).otherwise(F.col("_level"))}).drop("children", "node")
        nothing = F.col("_open").isNull()
        state = state.withColumns({"_level": F.when(nothing, 1).otherwise(F.col("_level")), "_open": F.coalesce("_open", _spot(end, 1))})
        for level in range(levels - 1, 0, -1):
            opening = F.col("_end").isNull() & (F.col("_level") == level)
            placed = state.withColumn("node", F.when(opening, F.col("_open")).otherwise(no_key)).join(index[level - 1], ["symbol", "node"], "left")
            if level == 1:
                hit = first(t0)
                state = placed.withColumn("_end", F.coalesce("_end", F.when(hit["place"] <= end, hit), at(end)))
            else:
                child = first(t0 * 0)["place"]
                reached = child <= _spot(end, level - 1)
                state = placed.withColumns({
                    "_open": F.when(opening, F.when(reached, child).otherwise(_spot(end, 1))).otherwise(F.col("_open")),
                    "_level": F.when(opening, F.when(reached, level - 1).otherwise(1)).otherwise(F.col("_level"))})
            state = state.drop("children", "node")
    extras = [c for c in events.columns if c not in ("symbol", "t0_seq", "t0")]
    last = F.struct(F.col("_end.low").alias("low"), F.col("_end.low").alias("high"))
    code = F.when(F.col("_end").isNull(), None).when(up(last), UPPER).when(down(last), LOWER).otherwise(VERTICAL)
    return state.select("symbol", "t0_seq", "t0", "_close0", *extras, F.col("_end.place").alias("t1_seq"), F.col("_end.ts").alias("t1"),
                        F.col("_end.low").alias("_close1"), code.cast("byte").alias("barrier"))


def get_events(bars: DataFrame, targeted: DataFrame, pt_mult: float, sl_mult: float, max_hp: int,
               min_ret: float = 0.0, side: DataFrame | None = None) -> DataFrame:
    """Events above the minimum target with their realized first touch.

    ``targeted``: symbol, t0_seq, trgt. ``side``: (symbol, t0_seq, side) for meta-labels; an event
    without a side is an error. Without ``side`` bets are long and no side column is returned.
    Unresolved events are kept with NULL t1.
    """
    kept = targeted.filter(passes_target("trgt", min_ret)).select("symbol", "t0_seq", "trgt")
    if side is None:
        bets = kept.withColumn("side", F.lit(1).cast("byte"))
    else:
        given = side.select("symbol", "t0_seq", F.col("side").cast("byte").alias("side"))
        missing = F.raise_error(F.concat(F.lit("no side for event at bar "), F.col("t0_seq").cast("string")))
        bets = kept.join(given, ["symbol", "t0_seq"], "left").withColumn(
            "side", F.coalesce("side", missing.cast("byte"))
        )
    walked = first_touch(bars, bets, pt_mult, sl_mult, max_hp)
    return walked.drop("side") if side is None else walked


def _ret(side: Column | None) -> Column:
    simple = F.col("_close1") / F.col("_close0") - 1
    return simple if side is None else simple * side


def get_bins(events: DataFrame) -> DataFrame:
    """Labels of the resolved events: return to the realized t1 and its sign.

    With a side the return is oriented by it and anything not positive becomes 0.
    """
    meta = "side" in events.columns
    ret = _ret(F.col("side") if meta else None)
    bin_ = F.when(F.col("ret") <= 0, F.lit(0).cast("byte")).otherwise(sign_label("ret")) if meta \
        else sign_label("ret")
    columns = ["symbol", "t0_seq", "t1_seq", "t0", "t1", "trgt", "ret", "bin", "barrier"]
    return (
        events.filter("t1_seq IS NOT NULL").withColumn("ret", ret).withColumn("bin", bin_)
        .select(*columns, *(["side"] if meta else []))
    )
