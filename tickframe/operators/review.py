"""Human decisions on signals: classification, resolution and drift of the override rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickframe.functions.exprs import day_key
from tickframe.scan.chunks import ordered_chunks, spread_join
from tickframe.scan.prefix import running_sums
from tickframe.session import materialize

# Review constants (fixed values).
OVERRIDE_CONFIDENCE = 0.70
MIN_HISTORY = 10
ESCALATION_Z = 2
HISTORY_DAYS = 90
SESSION_HOURS = 24
APPROVAL_SECONDS = 90


def classify(outcomes: DataFrame) -> DataFrame:
    """Decision rows from reviewer outcomes.

    ``outcomes``: signal_id, symbol, direction, confidence, position_size, approved, timed_out,
    latency_seconds, at (time of writing).
    """
    decision = F.when(F.col("approved"), "approve").when(F.col("timed_out"), "timeout").otherwise("cancel")
    micros = F.round(F.col("latency_seconds") * 1_000_000).cast("long")
    return outcomes.withColumn("decision", decision).select(
        "signal_id", "symbol", "direction", "confidence",
        F.col("position_size").alias("recommended_size"),
        F.timestamp_micros(F.unix_micros("at") - micros).alias("sent_at"),
        F.when(F.col("decision") != "timeout", F.col("at")).alias("decided_at"),
        "decision",
        F.round(F.col("latency_seconds"), 3).cast("decimal(8,3)").alias("decision_latency_seconds"),
        F.hour("at").alias("hour_of_day"),
        (~F.col("approved") & (F.col("confidence") >= OVERRIDE_CONFIDENCE)).alias("is_override"),
        F.col("at"),
    )


def _since(sessions: DataFrame, now, **back) -> DataFrame:
    return sessions.filter(F.col("decided_at") >= F.lit(now) - F.make_dt_interval(**{
        k: F.lit(v) for k, v in back.items()}))


def _rate() -> Column:
    return F.avg(F.col("is_override").cast("double"))


def session_override_rate(sessions: DataFrame, now, hours: int = SESSION_HOURS) -> DataFrame:
    """Override share of the decisions of the last hours, 0 if there is none."""
    return _since(sessions, now, hours=hours).agg(F.coalesce(_rate(), F.lit(0.0)).alias("override_rate"))


def daily_override_rates(sessions: DataFrame, now, days: int = HISTORY_DAYS) -> DataFrame:
    """(day, decisions, override_rate) of the window; empty below the minimum history."""
    daily = _since(sessions, now, days=days).groupBy(day_key("decided_at").alias("day")).agg(
        F.count("*").alias("decisions"), _rate().alias("override_rate"))
    # One row per calendar day, so the unpartitioned total is over at most ``days`` + 1 rows.
    total = F.sum("decisions").over(Window.partitionBy(F.lit(1)))
    return daily.withColumn("_all", total).filter(F.col("_all") >= MIN_HISTORY).drop("_all")


def drift(sessions: DataFrame, now) -> DataFrame:
    """One row: history_rows, override_rate, mean, stddev, z_score (NULL if undefined), escalate."""
    daily = daily_override_rates(sessions, now).agg(
        F.coalesce(F.sum("decisions"), F.lit(0)).alias("_kept"),
        F.coalesce(F.round(F.avg("override_rate"), 4), F.lit(0.0)).alias("mean"),
        F.coalesce(F.round(F.stddev_samp("override_rate"), 4), F.lit(0.0)).alias("stddev"),
    )
    rows = _since(sessions, now, days=HISTORY_DAYS).agg(F.count("*").alias("history_rows"))
    current = session_override_rate(sessions, now)
    one = daily.withColumn("_k", F.lit(1)).join(rows.withColumn("_k", F.lit(1)), "_k").join(
        current.withColumn("_k", F.lit(1)), "_k")
    return _scored(one).select("history_rows", "override_rate", "mean", "stddev", "z_score", "escalate")


def _scored(df: DataFrame) -> DataFrame:
    enough = F.col("history_rows") >= MIN_HISTORY
    z = F.when(enough & (F.col("stddev") != 0), (F.col("override_rate") - F.col("mean")) / F.col("stddev"))
    return df.withColumn("z_score", z).withColumn(
        "escalate", F.coalesce(F.col("z_score") > ESCALATION_Z, F.lit(False)))


def rolling_override_rate(decisions: DataFrame, hours: int = SESSION_HOURS,
                          chunk_rows: int | None = None) -> DataFrame:
    """Per decision the override share of the decided rows of the hours before it (itself excluded)."""
    counted = _history_counts(decisions, {"_session": hours * 3600}, chunk_rows)
    n = F.col("_now_n") - F.col("_session_n")
    o = F.col("_now_o") - F.col("_session_o")
    return counted.select("signal_id", "at", F.coalesce(F.try_divide(o, n), F.lit(0.0)).alias("override_rate"))


def _history_counts(decisions: DataFrame, windows: dict[str, int], chunk_rows: int | None) -> DataFrame:
    """Per decision, decided rows and overrides strictly before ``at`` and before each window's start.

    Decisions and the time points asked about are put in one time order and counted by one running
    sum; no row is paired with its history.
    """
    asked = [F.struct(F.lit("_now").alias("ask"), F.unix_micros("at").alias("us"), F.lit(0).alias("is_row"))]
    asked += [
        F.struct(F.lit(name).alias("ask"), (F.unix_micros("at") - seconds * 1_000_000).alias("us"),
                 F.lit(0).alias("is_row"))
        for name, seconds in windows.items()
    ]
    row = F.when(F.col("decided_at").isNotNull(), F.struct(
        F.lit("row").alias("ask"), F.unix_micros("decided_at").alias("us"), F.lit(1).alias("is_row")))
    points = decisions.select(
        "signal_id", "at", F.col("is_override").cast("long").alias("_o"),
        F.explode(F.array_compact(F.array(row, *asked))).alias("p"),
    ).select(F.lit("all").alias("symbol"), "signal_id", "at", "p.*", (F.col("_o") * F.col("p.is_row")).alias("_o"))
    # Questions sort before rows of the same instant, so they count strictly earlier rows.
    rows = decisions.count() * (2 + len(windows))  # at most; spares evaluating the points to size them
    chunked = ordered_chunks(points, ["us", "is_row", "signal_id", "ask"], chunk_rows, rows)
    summed = running_sums(chunked, {"n": F.col("is_row").cast("long"), "o": F.col("_o")}, ["pos"])
    names = ["_now", *windows]
    return summed.filter("is_row = 0").groupBy("signal_id").agg(
        F.any_value("at").alias("at"),
        F.max(F.when(F.col("ask") == "_now", F.col("chunk"))).alias("chunk"),
        *[F.max(F.when(F.col("ask") == name, F.col(c))).alias(f"{name}_{c}") for name in names for c in "no"],
    )


def snapshot_metrics(decisions: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """The drift metrics each decision saw when it was written: only decided rows before it count.

    ``decisions``: signal_id (unique), at, decided_at (NULL on timeout), is_override. Daily rates of
    the last 90 days consist of the whole days in between, which are rolled up from one row per day,
    and the parts of the first and the current day, which are differences of running counts.
    """
    day = F.datediff(day_key("at"), F.lit("1970-01-01").cast("date"))
    counted = materialize(_history_counts(
        decisions, {"_session": SESSION_HOURS * 3600, "_history": HISTORY_DAYS * 86400}, chunk_rows
    ).withColumn("day", day))
    full = HISTORY_DAYS - 1
    decided = F.col("decided_at").isNotNull()
    # Rates belong to the day of the decision; days on which something was only asked have none.
    of_decision = F.datediff(day_key("decided_at"), F.lit("1970-01-01").cast("date"))
    none = F.lit(0).cast("long")
    days = decisions.filter(decided).groupBy(of_decision.alias("day")).agg(
        F.count("*").alias("n"), F.count_if("is_override").alias("o")).unionByName(
        decisions.select(day.alias("day")).distinct().select("day", none.alias("n"), none.alias("o"))
    ).groupBy("day").agg(F.sum("n").alias("n"), F.sum("o").alias("o"))
    # One row per calendar day.
    line = Window.partitionBy(F.lit(1)).orderBy("day")
    earlier, whole = line.rowsBetween(Window.unboundedPreceding, -1), line.rangeBetween(-full, -1)
    rate = F.try_divide("o", "n")
    zero = F.lit(0).cast("long")
    rolled = days.select(
        "day",
        F.coalesce(F.sum("n").over(earlier), zero).alias("_start_n"),
        F.coalesce(F.sum("o").over(earlier), zero).alias("_start_o"),
        F.coalesce(F.sum("n").over(whole), zero).alias("_whole_n"),
        F.coalesce(F.sum("o").over(whole), zero).alias("_whole_o"),
        F.count(rate).over(whole).alias("_days"),
        F.coalesce(F.sum(rate).over(whole), F.lit(0.0)).alias("_rates"),
        F.coalesce(F.sum(rate * rate).over(whole), F.lit(0.0)).alias("_squares"),
    )
    joined = spread_join(counted, rolled, "day")
    now_part = F.try_divide(F.col("_now_o") - F.col("_start_o"), F.col("_now_n") - F.col("_start_n"))
    old_part = F.try_divide(
        F.col("_start_o") - F.col("_whole_o") - F.col("_history_o"),
        F.col("_start_n") - F.col("_whole_n") - F.col("_history_n"))
    total = lambda c, f: F.col(c) + f(F.col("_a")) + f(F.col("_b"))
    parts = joined.withColumns({"_a": now_part, "_b": old_part}).withColumns({
        "_m": total("_days", lambda c: F.when(c.isNull(), 0).otherwise(1)),
        "_sum": total("_rates", lambda c: F.coalesce(c, F.lit(0.0))),
        "_sq": total("_squares", lambda c: F.coalesce(c * c, F.lit(0.0))),
        "history_rows": F.col("_now_n") - F.col("_history_n"),
        "override_rate": F.coalesce(F.try_divide(F.col("_now_o") - F.col("_session_o"),
                                                 F.col("_now_n") - F.col("_session_n")), F.lit(0.0)),
    })
    enough = F.col("history_rows") >= MIN_HISTORY
    spread = F.greatest(F.col("_sq") - F.try_divide(F.col("_sum") * F.col("_sum"), F.col("_m")), F.lit(0.0))
    sigma = F.sqrt(F.try_divide(spread, F.when(F.col("_m") > 1, F.col("_m") - 1)))
    return _scored(parts.withColumns({
        "mean": F.when(enough, F.round(F.try_divide("_sum", "_m"), 4)).otherwise(0.0),
        "stddev": F.when(enough, F.coalesce(F.round(sigma, 4), F.lit(0.0))).otherwise(0.0),
    })).select("signal_id", "at", "history_rows", "override_rate", "mean", "stddev", "z_score", "escalate")


def resolve_approvals(signals: DataFrame, responses: DataFrame, seconds: int = APPROVAL_SECONDS) -> DataFrame:
    """Signals with the first approve/cancel within ``seconds`` of sending, else 'timeout'.

    ``signals``: signal_id, sent_at. ``responses``: signal_id, responded_at, response.
    """
    waited = F.unix_micros("responded_at") - F.unix_micros("sent_at")
    valid = responses.filter(F.col("response").isin("approve", "cancel"))
    in_time = (waited >= 0) & (waited < seconds * 1_000_000)
    # The instant with the answer in its last bit: one long to minimize, the earlier answer first.
    code = F.unix_micros("responded_at") * 2 + (F.col("response") == "cancel").cast("long")
    first = signals.select("signal_id", "sent_at").join(valid, "signal_id").filter(in_time).groupBy(
        "signal_id").agg(F.min(code).alias("_code"))
    decision = F.when(F.pmod("_code", F.lit(2)) == 1, "cancel").otherwise("approve")
    return signals.join(first, "signal_id", "left").withColumns({
        "decision": F.when(F.col("_code").isNull(), "timeout").otherwise(decision),
        "decided_at": F.timestamp_micros(F.shiftright("_code", 1)),
    }).drop("_code")
