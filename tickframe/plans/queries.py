"""The registered queries: every operator over the driver's whole tables, with its check SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.configs import LabelConfig, ValidationConfig, WeightConfig
from tickframe.functions.exprs import day_key, half_even, half_up, symbol_key, threshold_key
from tickframe.functions.validate import quarantine, require
from tickframe.operators import bars as bar_ops
from tickframe.operators import batches, folds, ideas, indicators, review, risk, scoring, volatility
from tickframe.operators import weights as weight_ops
from tickframe.operators.barriers import first_touch, get_bins, get_events, vertical_barriers
from tickframe.operators.bootstrap import sequential_bootstrap
from tickframe.operators.fitting import fit_folds, predict_folds
from tickframe.plans import checks as sql
from tickframe.plans.labeling import sampled_events, triple_barrier_labels
from tickframe.plans.output import shown, shown_sql
from tickframe.plans.trading import audit
from tickframe.plans.weighting import sample_weights
from tickframe.session import materialize, scratch_path, use_utc
from tickframe.sources import adapters, candles, catalog, landed
from tickframe.sources.trades import normalize_trades, read_events, read_trades, trades_from_events
from tickframe.streaming import approvals as stream_approvals
from tickframe.streaming import bars as stream_bars
from tickframe.streaming import candles as stream_candles
from tickframe.streaming import decisions as stream_decisions

THRESHOLD = 5000
LABELING = LabelConfig(kappa=1.0, ewma_span=10, pt_mult=1.0, sl_mult=1.0, max_hp=10, min_ret=0.0)
WEIGHTING = WeightConfig(decay_c=0.5)
FOLDING = ValidationConfig(n_splits=4, embargo_pct=0.01, n_groups=5, n_test_groups=2)
ACCOUNT = risk.SystemState(Decimal(10000), Decimal(10000))
NOW = datetime(2024, 1, 31)


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    columns: str
    check: str | None


QUERIES: dict[str, Query] = {}


def query(columns: str, check: str | None = None):
    """Register a query under its function's name. ``check`` ends in a table named ``result``."""

    def register(build):
        QUERIES[build.__name__] = Query(build, columns, check)
        return build

    return register


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(QUERIES[name].build(use_utc(spark), sf_dir), QUERIES[name].columns)


def check_sql(name: str) -> str | None:
    one = QUERIES[name]
    return None if one.check is None else shown_sql(one.check, one.columns)


def _result(base: str, select: str) -> str:
    return f"{base},\nresult AS ({select})" if base else f"result AS ({select})"


# --- shared inputs -----------------------------------------------------------------------------

def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed bars as stored, materialized because several steps read them."""
    trades = read_trades(spark, sf_dir)
    return materialize(bar_ops.bars_to_float(bar_ops.dollar_bars(trades, THRESHOLD, include_partial=False)))


def _labels(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return bars, materialize(triple_barrier_labels(bars, LABELING))


def _label_spans(spark, sf_dir):
    bars, labels = _labels(spark, sf_dir)
    return bars, labels.select("symbol", F.col("t0_seq").alias("event_id"), "t0_seq", "t1_seq", "t1")


def _order_spans(spark, sf_dir):
    series = materialize(adapters.order_series(spark, sf_dir))
    return series, adapters.order_spans(series)


def _candles(spark, sf_dir):
    return candles.candles_from_trades(read_trades(spark, sf_dir), "4h", 4 * 3600)


def _landed(spark, sf_dir):
    return candles.normalize_candles(adapters.landed_candles(_candles(spark, sf_dir)))


def _symbols(frame: DataFrame) -> DataFrame:
    return frame.select("symbol").distinct()


# --- trades and bars ---------------------------------------------------------------------------

@query("symbol:s seq:i ts:t price:f amount:f dollar_volume:f",
       _result(sql.TRADES, "SELECT *, price * amount AS dollar_volume FROM trades"))
def trades(spark, sf_dir):
    return read_trades(spark, sf_dir).withColumn("dollar_volume", F.col("price") * F.col("amount"))


_BAR = ("symbol:s bar_seq:i bar_start_ts:t bar_end_ts:t open:f high:f low:f close:f volume:f "
        "dollar_volume:f num_ticks:i is_complete:b")


@query(_BAR, _result(sql.BARS, "SELECT * FROM all_bars"))
def dollar_bars(spark, sf_dir):
    return bar_ops.bars_to_float(bar_ops.dollar_bars(read_trades(spark, sf_dir), THRESHOLD))


@query(_BAR, _result(sql.BARS, "SELECT * FROM all_bars"))
def dollar_bars_chunked(spark, sf_dir):
    """The same bars from chunks of 64 trades, so that most bars cross chunks."""
    return bar_ops.bars_to_float(bar_ops.dollar_bars(read_trades(spark, sf_dir), THRESHOLD, chunk_rows=64))


@query("symbol:s seq:i ts:t price:f amount:f", _result(sql.TRADES, """
SELECT symbol, seq, make_timestamp(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) * 1000) AS ts, price, amount FROM trades"""))
def normalized_trades(spark, sf_dir):
    """Landed records with times in milliseconds and numbers as text."""
    raw = read_trades(spark, sf_dir).select("symbol", F.unix_millis("ts").alias("ts_ms"), F.col("seq").cast("string").alias("seq"),
                                            F.col("price").cast("string").alias("price"), F.col("amount").cast("string").alias("amount"))
    return normalize_trades(raw)


@query(_BAR, _result(sql.BARS, "SELECT * FROM bars WHERE symbol = 'click'"))
def loaded_bars(spark, sf_dir):
    """One series written to the store and loaded by symbol and threshold."""
    root = scratch_path(spark, "bars")
    catalog.store_bars(_bars(spark, sf_dir), THRESHOLD, root)
    return catalog.load_bars(spark, root, "click", THRESHOLD)


@query(_BAR, _result(sql.BARS, "SELECT * FROM bars"))
def stored_bars(spark, sf_dir):
    """Bars written to the store and read back per series."""
    root = scratch_path(spark, "bars")
    bars = _bars(spark, sf_dir)
    catalog.store_bars(bars, THRESHOLD, root)
    return spark.read.parquet(f"{root}/bars").filter(F.col("thr") == f"thr_{THRESHOLD}")


@query("symbol:s last_trade_ts:t resume_at:t trades_left:i", _result(sql.BARS, """
SELECT l.symbol, last_trade_ts, last_trade_ts + INTERVAL 1 MILLISECOND AS resume_at,
       (SELECT count(*) FROM trades t WHERE t.symbol = l.symbol AND t.ts >= last_trade_ts + INTERVAL 1 MILLISECOND)
         AS trades_left
FROM (SELECT symbol, max(bar_end_ts) AS last_trade_ts FROM bars GROUP BY symbol) l"""))
def resume_points(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    left = catalog.trades_to_resume(read_trades(spark, sf_dir), bars).groupBy("symbol").agg(
        F.count("*").alias("trades_left"))
    return catalog.last_trade_time(bars).join(left, "symbol", "left").fillna(0, ["trades_left"])


@query("symbol:s bar_seq:i bar_start_ts:t bar_end_ts:t open:f high:f low:f close:f volume:f dollar_volume:f num_ticks:i",
       _result(sql.BARS, "SELECT * FROM bars"))
def streamed_bars(spark, sf_dir):
    """The trade stream run to its end; completed bars equal the batch operator's."""
    root = scratch_path(spark, "stream-bars")
    feed = trades_from_events(adapters.events_stream(spark, sf_dir))
    stream_bars.stream_dollar_bars(feed, THRESHOLD, root, f"{root}/checkpoint").awaitTermination()
    return stream_bars.completed_bars(spark, root)


_FED = _result(sql.BARS, """
SELECT symbol, 'bar' AS kind, bar_seq AS number, bar_end_ts AS moment, num_ticks AS ticks, dollar_volume AS amount FROM bars
UNION ALL SELECT symbol, 'late', seq, ts, 1, CAST(price * amount AS DOUBLE) FROM trades
WHERE CAST(ts AS DATE) = (SELECT min(CAST(ts AS DATE)) FROM trades)""")


@query("symbol:s kind:s number:i moment:t ticks:i amount:f", _FED)
def streamed_bars_restarted(spark, sf_dir):
    """The feed landed in six deliveries of many files, each a micro-batch of the stream, which is stopped and started again
    between them; the first day comes again with the fifth. Completed bars equal the batch operator's, and the repeated trades
    are late, each once."""
    root = scratch_path(spark, "stream-feed")
    trades = read_trades(spark, sf_dir)
    first, last = trades.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - first) * 6 / (last - first + 1))
    trades.withColumn("part", part).write.partitionBy("part").parquet(f"{root}/feed")
    feed = spark.read.schema(trades.withColumn("part", part).schema).parquet(f"{root}/feed")
    for delivery in range(6):
        landing = feed.filter(F.col("part") == delivery)
        if delivery == 4:
            landing = landing.unionByName(feed.filter(F.to_date("ts") == F.to_date(F.timestamp_micros(F.lit(first)))))
        landing.drop("part").write.mode("append").parquet(f"{root}/landed")
        source = spark.readStream.schema(trades.schema).parquet(f"{root}/landed")
        stream_bars.stream_dollar_bars(source, THRESHOLD, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    done = stream_bars.completed_bars(spark, f"{root}/out").select(
        "symbol", F.lit("bar").alias("kind"), F.col("bar_seq").alias("number"), F.col("bar_end_ts").alias("moment"),
        F.col("num_ticks").alias("ticks"), F.col("dollar_volume").cast("double").alias("amount"))
    return done.unionByName(stream_bars.late_trades(spark, f"{root}/out").select(
        "symbol", F.lit("late").alias("kind"), F.col("seq").alias("number"), F.col("ts").alias("moment"), F.lit(1).cast("long").alias("ticks"),
        (F.col("price") * F.col("amount")).cast("double").alias("amount")))


# --- volatility, events, labels ----------------------------------------------------------------

@query("symbol:s bar_seq:i log_ratio:f log_diff:f", _result(sql.RETURNS, "SELECT * FROM rets"))
def log_returns(spark, sf_dir):
    return volatility.with_log_returns(_bars(spark, sf_dir))


@query("symbol:s bar_seq:i vol:f", _result(sql.VOL, "SELECT * FROM vols"))
def ewma_vol(spark, sf_dir):
    return volatility.ewma_vol(_bars(spark, sf_dir), LABELING.ewma_span)


@query("symbol:s ewma_vol:f", _result(sql.VOL, """
SELECT symbol, coalesce(round(arg_max(vol, bar_seq) FILTER (vol IS NOT NULL), 8), 0) AS ewma_vol
FROM vols GROUP BY symbol"""))
def ewma_vol_latest(spark, sf_dir):
    return volatility.ewma_vol_latest(volatility.ewma_vol(_bars(spark, sf_dir), LABELING.ewma_span))


@query("symbol:s side:i confidence:f ewma_vol:f", _result(sql.VOL, """
SELECT symbol, 1 AS side, 0.5 AS confidence, round(arg_max(vol, bar_seq) FILTER (vol IS NOT NULL), 8) AS ewma_vol
FROM vols GROUP BY symbol"""))
def signal_packets(spark, sf_dir):
    """Packets that carry the latest volatility in their metadata, checked against the contract."""
    vols = volatility.ewma_vol(_bars(spark, sf_dir), LABELING.ewma_span)
    packets = volatility.signal_metadata(vols).withColumns(
        {"side": F.lit(1), "confidence": F.lit(0.5).cast("decimal(5,4)")})
    return require(packets, volatility.packet_rules()).withColumn("ewma_vol", F.col("metadata")["ewma_vol"])


@query("symbol:s t0_seq:i trgt:f", _result(sql.CUSUM, "SELECT * FROM sampled"))
def cusum_events(spark, sf_dir):
    return sampled_events(_bars(spark, sf_dir), LABELING)


@query("symbol:s t0_seq:i trgt:f", _result(sql.CUSUM, "SELECT * FROM sampled"))
def cusum_events_chunked(spark, sf_dir):
    """The same events from chunks of 64 bars."""
    return sampled_events(_bars(spark, sf_dir), LABELING, chunk_rows=64)


@query("symbol:s t0_seq:i t1_seq:i t1:t", _result(sql.CUSUM, """
SELECT s.symbol, s.t0_seq, b.bar_seq AS t1_seq, b.bar_end_ts AS t1
FROM sampled s LEFT JOIN bars b ON b.symbol = s.symbol AND b.bar_seq = s.t0_seq + 10"""))
def vertical_barrier(spark, sf_dir):
    bars = _bars(spark, sf_dir)
    return vertical_barriers(bars, sampled_events(bars, LABELING), LABELING.max_hp)


@query("symbol:s t0_seq:i t1_seq:i t1:t trgt:f barrier:i",
       _result(sql.touches("1"), "SELECT symbol, t0_seq, t1_seq, t1, trgt, coalesce(barrier, -9) AS barrier FROM touched"))
def barrier_events(spark, sf_dir):
    """Realized first touches; unresolved events stay with barrier -9 shown."""
    bars = _bars(spark, sf_dir)
    found = get_events(bars, sampled_events(bars, LABELING), 1.0, 1.0, LABELING.max_hp)
    return found.withColumn("barrier", F.coalesce(F.col("barrier").cast("int"), F.lit(-9)))


@query("symbol:s t0_seq:i t1_seq:i t1:t barrier:i", sql.ORDER_SPANS + """,
opened AS (
  SELECT symbol, bar_seq AS t0_seq, close AS close0, 0.5 + (event_id % 32) / 8 AS trgt, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS side FROM series),
hits AS (
  SELECT o.symbol, o.t0_seq, min(s.bar_seq) AS seq, arg_min(sign((s.close / close0 - 1) * side), s.bar_seq) AS code FROM opened o
  JOIN series s ON s.symbol = o.symbol AND s.bar_seq BETWEEN o.t0_seq AND o.t0_seq + 2000
  WHERE (s.close / close0 - 1) * side > trgt OR (s.close / close0 - 1) * side < trgt * -0.25 GROUP BY ALL),
result AS (
  SELECT o.symbol, o.t0_seq, b.bar_seq AS t1_seq, b.bar_end_ts AS t1,
    CASE WHEN b.bar_seq IS NULL THEN -9 WHEN h.seq IS NULL THEN 0 ELSE CAST(h.code AS INTEGER) END AS barrier
  FROM opened o LEFT JOIN hits h USING (symbol, t0_seq)
  LEFT JOIN series b ON b.symbol = o.symbol AND b.bar_seq = coalesce(h.seq, o.t0_seq + 2000))""")
def barrier_events_long(spark, sf_dir):
    """First touches within 2,000 orders, long and short, of targets between a half and 4.5."""
    series = materialize(adapters.order_series(spark, sf_dir))
    key = F.col("event_id")
    bets = series.select("symbol", F.col("bar_seq").alias("t0_seq"), (0.5 + (key % 32) / 8).alias("trgt"),
                         F.when(key % 3 == 0, -1).otherwise(1).cast("byte").alias("side"))
    found = first_touch(series, bets, 1.0, 0.25, 2000)
    return found.withColumn("barrier", F.coalesce(F.col("barrier").cast("int"), F.lit(-9)))


_LABEL = "symbol:s t0_seq:i t1_seq:i t0:t t1:t trgt:f ret:f bin:i barrier:i"


@query(_LABEL, _result(sql.LABELS, "SELECT * FROM labels_"))
def labels(spark, sf_dir):
    return triple_barrier_labels(_bars(spark, sf_dir), LABELING)


@query(_LABEL + " side:i", _result(sql.META_LABELS, "SELECT * FROM labels_"))
def meta_labels(spark, sf_dir):
    """Labels of bets in the direction of the last return."""
    bars = _bars(spark, sf_dir)
    sampled = materialize(sampled_events(bars, LABELING))
    side = sampled.select("symbol", "t0_seq", F.when(F.col("log_diff") >= 0, 1).otherwise(-1).alias("side"))
    return get_bins(get_events(bars, sampled, 1.0, 1.0, LABELING.max_hp, 0.0, side))


# --- weights -----------------------------------------------------------------------------------

@query("symbol:s bar_seq:i co_events:i", _result(sql.ORDER_SPANS + sql.COUNTED, "SELECT * FROM counted"))
def concurrency(spark, sf_dir):
    series, spans = _order_spans(spark, sf_dir)
    return weight_ops.concurrency(series.select("symbol", "bar_seq"), spans)


@query("symbol:s event_id:i avg_uniqueness:f", _result(sql.ORDER_SPANS + sql.MEASURED, "SELECT * FROM measured"))
def average_uniqueness(spark, sf_dir):
    series, spans = _order_spans(spark, sf_dir)
    counted = weight_ops.concurrency(series.select("symbol", "bar_seq"), spans)
    return weight_ops.average_uniqueness(counted, spans)


@query("symbol:s event_id:i attribution:f norm:f", _result(sql.ORDER_SPANS + sql.MEASURED, "SELECT * FROM weighted"))
def return_attribution(spark, sf_dir):
    series, spans = _order_spans(spark, sf_dir)
    grid = volatility.with_log_returns(series.select("symbol", "bar_seq", "close")).drop("chunk")
    counted = weight_ops.concurrency(grid.select("symbol", "bar_seq", "log_diff"), spans)
    attributed = materialize(weight_ops.return_attribution(counted, spans))
    return weight_ops.normalize_weights(attributed, "attribution", "norm")


@query("symbol:s event_id:i decay:f", _result(sql.ORDER_SPANS + sql.MEASURED, "SELECT * FROM decayed"))
def time_decay(spark, sf_dir):
    series, spans = _order_spans(spark, sf_dir)
    counted = weight_ops.concurrency(series.select("symbol", "bar_seq"), spans)
    return weight_ops.time_decay(materialize(weight_ops.average_uniqueness(counted, spans)), WEIGHTING.decay_c)


@query("symbol:s t0_seq:i t1_seq:i avg_uniqueness:f weight:f", _result(
    sql.LABEL_SPANS + sql.MEASURED, "SELECT symbol, t0_seq, t1_seq, avg_uniqueness, norm * decay AS weight FROM decayed"))
def label_weights(spark, sf_dir):
    bars, labelled = _labels(spark, sf_dir)
    return sample_weights(bars, labelled, WEIGHTING)


@query("symbol:s event_id:i avg_uniqueness:f", _result(sql.ORDER_SPANS + sql.MEASURED, "SELECT * FROM measured"))
def incidence_uniqueness(spark, sf_dir):
    series, spans = _order_spans(spark, sf_dir)
    return weight_ops.incidence_uniqueness(series, spans)


@query("symbol:s event_id:i n_bars:i next_id:i shared:i", _result(sql.ORDER_SPANS, """
SELECT a.symbol, a.event_id, a.t1_seq - a.t0_seq + 1 AS n_bars, b.event_id AS next_id, greatest(0, least(a.t1_seq, b.t1_seq) - b.t0_seq + 1) AS shared
FROM spans a JOIN spans b ON b.symbol = a.symbol AND b.t0_seq = a.t0_seq + 1"""))
def event_bitmaps(spark, sf_dir):
    """The packed incidence of every span: its bars, and those it shares with the span that starts on the next bar."""
    _, spans = _order_spans(spark, sf_dir)
    masks = materialize(weight_ops.incidence_masks(spans))
    sizes = masks.groupBy("symbol", "event_id").agg(F.sum(F.bit_count("mask")).alias("n_bars"))
    behind = spans.select("symbol", F.col("event_id").alias("other_id"), (F.col("t0_seq") - 1).alias("t0_seq"))
    pairs = spans.select("symbol", "event_id", "t0_seq").join(behind, ["symbol", "t0_seq"]).drop("t0_seq")
    return weight_ops.shared_bars(masks, pairs).join(sizes, ["symbol", "event_id"]).withColumnRenamed("other_id", "next_id")


@query("symbol:s bar_seq:i co_events:i", _result(sql.ORDER_SPANS + sql.COUNTED, "SELECT * FROM counted WHERE co_events > 0"))
def event_incidence(spark, sf_dir):
    """Concurrency counted from the packed incidence."""
    return weight_ops.bars_of_masks(weight_ops.incidence_masks(_order_spans(spark, sf_dir)[1]))


@query("symbol:s replicate:i draw:i event_id:i")
def sequential_draws(spark, sf_dir):
    """Five replicates over every label of every symbol."""
    _, spans = _label_spans(spark, sf_dir)
    return sequential_bootstrap(spans, seeds=[1, 2, 3, 4, 5])


# --- folds and scores --------------------------------------------------------------------------

@query("symbol:s bar_seq:i embargo_seq:i bar_end_ts:t embargo_ts:t", _result(sql.ORDER_SPANS, """
SELECT a.symbol, a.bar_seq, b.bar_seq AS embargo_seq, a.bar_end_ts, b.bar_end_ts AS embargo_ts
FROM series a JOIN series b
  ON b.symbol = a.symbol AND b.bar_seq = least(a.bar_seq + CAST(floor(a.n * 0.01) AS BIGINT), a.n - 1)"""))
def embargo(spark, sf_dir):
    return folds.embargo_times(materialize(adapters.order_series(spark, sf_dir)), 0.01)


_FOLD = "fold_id:i symbol:s event_id:i role:s"


@query("symbol:s event_id:i t0_seq:i t1_seq:i", _result(
    sql.ORDER_SPANS + sql.folds(5, 1, 0.0), "SELECT * FROM folds_ WHERE role = 'train' AND fold_id = 2"))
def purged_spans(spark, sf_dir):
    """Order spans that share no bar with the middle fifth of their series."""
    series, spans = _order_spans(spark, sf_dir)
    tiled = folds.tiles(spans, 5)
    block = folds.embargoed_blocks(tiled, series, 0.0).filter("tile = 2")
    return folds.purge(series, spans, block)


@query(_FOLD, _result(sql.ORDER_SPANS + sql.folds(4, 1, 0.01), "SELECT * FROM folds_"))
def purged_kfold(spark, sf_dir):
    series, spans = _order_spans(spark, sf_dir)
    return folds.purged_kfold(spans, series, FOLDING.n_splits, FOLDING.embargo_pct)


@query(_FOLD, _result(sql.ORDER_SPANS + sql.folds(80, 1, 0.01), "SELECT * FROM folds_"))
def purged_kfold_80(spark, sf_dir):
    series, spans = _order_spans(spark, sf_dir)
    return folds.purged_kfold(spans, series, 80, 0.01)


@query(_FOLD, _result(sql.LABEL_SPANS + sql.folds(5, 2, 0.01), "SELECT * FROM folds_"))
def combinatorial_folds(spark, sf_dir):
    bars, spans = _label_spans(spark, sf_dir)
    return folds.combinatorial_purged_kfold(spans, bars, FOLDING.n_groups, FOLDING.n_test_groups, FOLDING.embargo_pct)


def _samples(bars: DataFrame, labelled: DataFrame) -> DataFrame:
    vols = volatility.ewma_vol(bars, LABELING.ewma_span).select(
        "symbol", F.col("bar_seq").alias("t0_seq"), "log_diff")
    return labelled.join(vols, ["symbol", "t0_seq"]).select(
        "symbol", F.col("t0_seq").alias("event_id"), (F.col("bin") > 0).cast("double").alias("y"),
        (1 + F.abs("ret")).alias("weight"), "trgt", "log_diff")


_SCORED = sql.LABEL_SPANS + sql.folds(4, 1, 0.01) + """,
tested AS (
  SELECT f.fold_id, 1 + abs(l.ret) AS weight, CASE WHEN l.bin > 0 THEN 1 ELSE 0 END AS y,
         CASE WHEN l.t0_seq % 3 = 0 THEN 0.9 ELSE 0.2 END AS p1
  FROM folds_ f JOIN labels_ l ON l.symbol = f.symbol AND l.t0_seq = f.event_id WHERE f.role = 'test')"""


@query("fold_id:i score:f accuracy:f", _result(_SCORED, """
SELECT fold_id, sum(weight * ln(CASE WHEN y = 1 THEN p1 ELSE 1 - p1 END)) / sum(weight) AS score,
       sum(CASE WHEN y = CASE WHEN p1 >= 0.5 THEN 1 ELSE 0 END THEN weight ELSE 0 END) / sum(weight) AS accuracy
FROM tested GROUP BY fold_id"""))
def rule_scores(spark, sf_dir):
    """A fixed rule scored on every fold, both ways."""
    bars, labelled = _labels(spark, sf_dir)
    samples = _samples(bars, labelled)
    spans = labelled.select("symbol", F.col("t0_seq").alias("event_id"), "t0_seq", "t1_seq")
    split = materialize(folds.purged_kfold(spans, bars, FOLDING.n_splits, FOLDING.embargo_pct))
    p1 = F.when(F.col("event_id") % 3 == 0, 0.9).otherwise(0.2)
    tested = split.filter("role = 'test'").join(samples, ["symbol", "event_id"]).withColumns(
        {"p_y": F.when(F.col("y") == 1, p1).otherwise(1 - p1), "prediction": (p1 >= 0.5).cast("double")})
    loss = scoring.fold_scores(tested, "neg_log_loss")
    return loss.join(scoring.fold_scores(tested, "accuracy").withColumnRenamed("score", "accuracy"), "fold_id")


_FITTED = """,
trained AS (
  SELECT f.fold_id, l.bin AS y, sum(1 + abs(l.ret)) AS w FROM folds_ f
  JOIN labels_ l ON l.symbol = f.symbol AND l.t0_seq = f.event_id WHERE f.role = 'train' GROUP BY ALL),
shares AS (SELECT fold_id, y, w / sum(w) OVER (PARTITION BY fold_id) AS p FROM trained),
tops AS (SELECT fold_id, first(y ORDER BY p DESC, y) AS top FROM shares GROUP BY fold_id),
judged AS (
  SELECT f.fold_id, 1 + abs(l.ret) AS w, l.bin AS y, t.top,
         least(greatest(coalesce(s.p, 0), 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p
  FROM folds_ f JOIN labels_ l ON l.symbol = f.symbol AND l.t0_seq = f.event_id JOIN tops t ON t.fold_id = f.fold_id
  LEFT JOIN shares s ON s.fold_id = f.fold_id AND s.y = l.bin WHERE f.role = 'test'),
result AS (
  SELECT fold_id, sum(w * ln(p)) / sum(w) AS score, sum(CASE WHEN y = top THEN w ELSE 0 END) / sum(w) AS accuracy
  FROM judged GROUP BY fold_id)"""


def _fitted(bars, labelled, split):
    samples = materialize(labelled.select(
        "symbol", F.col("t0_seq").alias("event_id"), F.col("bin").cast("double").alias("y"), (1 + F.abs("ret")).alias("weight")))
    split = materialize(split)
    loss = scoring.cv_score(samples, split, scoring.class_share_predictor)
    right = scoring.cv_score(samples, split, scoring.class_share_predictor, "accuracy")
    return loss.join(right.withColumnRenamed("score", "accuracy"), "fold_id")


@query("fold_id:i score:f accuracy:f", sql.LABEL_SPANS + sql.folds(4, 1, 0.01) + _FITTED)
def fitted_scores(spark, sf_dir):
    """A model with a closed form, fitted on the labels -1, 0 and 1 of every purged fold and scored both ways."""
    bars, labelled = _labels(spark, sf_dir)
    spans = labelled.select("symbol", F.col("t0_seq").alias("event_id"), "t0_seq", "t1_seq")
    return _fitted(bars, labelled, folds.purged_kfold(spans, bars, 4, 0.01))


@query("fold_id:i score:f accuracy:f", sql.LABEL_SPANS + sql.folds(5, 2, 0.01) + _FITTED)
def fitted_scores_cpcv(spark, sf_dir):
    bars, labelled = _labels(spark, sf_dir)
    spans = labelled.select("symbol", F.col("t0_seq").alias("event_id"), "t0_seq", "t1_seq")
    return _fitted(bars, labelled, folds.combinatorial_purged_kfold(spans, bars, 5, 2, 0.01))


@query("fold_id:i score:f")
def logistic_scores(spark, sf_dir):
    """A weighted logistic regression fitted and scored on every fold."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    bars, labelled = _labels(spark, sf_dir)
    samples = materialize(_samples(bars, labelled))
    spans = labelled.select("symbol", F.col("t0_seq").alias("event_id"), "t0_seq", "t1_seq")
    split = materialize(folds.purged_kfold(spans, bars, 3, FOLDING.embargo_pct))
    model = scoring.weighted_pipeline([
        VectorAssembler(inputCols=["trgt", "log_diff"], outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features"),
        LogisticRegression(labelCol="y", maxIter=10, regParam=0.01),
    ], "weight")
    return scoring.cv_score(samples, split, scoring.estimator_predictor(model))


_IRLS_ROUNDS = 5


@query("fold_id:i score:f accuracy:f", sql.LABEL_SPANS + sql.folds(5, 2, 0.01) + sql.newton(_IRLS_ROUNDS))
def irls_scores(spark, sf_dir):
    """Weighted logistic models of three classes on two features, fitted on all ten combinatorial folds at once."""
    bars, labelled = _labels(spark, sf_dir)
    changes = volatility.with_log_returns(bars).select("symbol", F.col("bar_seq").alias("t0_seq"), "log_diff")
    samples = labelled.join(changes, ["symbol", "t0_seq"]).select(
        "symbol", F.col("t0_seq").alias("event_id"), F.col("bin").cast("double").alias("y"), (1 + F.abs("ret")).alias("weight"), "trgt", "log_diff")
    spans = labelled.select("symbol", F.col("t0_seq").alias("event_id"), "t0_seq", "t1_seq")
    split = folds.combinatorial_purged_kfold(spans, bars, FOLDING.n_groups, FOLDING.n_test_groups, FOLDING.embargo_pct)
    cast = materialize(split.select("fold_id", "symbol", "event_id", "role").join(samples, ["symbol", "event_id"]))
    models = fit_folds(cast.filter("role = 'train'"), ["trgt", "log_diff"], _IRLS_ROUNDS)
    tested = materialize(predict_folds(models, cast.filter("role = 'test'")))
    accuracy = scoring.fold_scores(tested, "accuracy").withColumnRenamed("score", "accuracy")
    return scoring.fold_scores(tested).join(accuracy, "fold_id")


# --- candles -----------------------------------------------------------------------------------

_CANDLE = "symbol:s timeframe:s timestamp:t open:f high:f low:f close:f volume:f"


@query(_CANDLE, _result(sql.CANDLES, "SELECT * FROM candles"))
def candles_4h(spark, sf_dir):
    return _candles(spark, sf_dir)


@query(_CANDLE + " ingest_seq:i", _result(sql.LANDED, "SELECT * FROM landed"))
def landed_candles(spark, sf_dir):
    return _landed(spark, sf_dir)


@query(_CANDLE, _result(sql.LANDED, """
SELECT symbol, timeframe, timestamp, arg_min(open, ingest_seq) AS open, arg_min(high, ingest_seq) AS high,
       arg_min(low, ingest_seq) AS low, arg_min(close, ingest_seq) AS close, arg_min(volume, ingest_seq) AS volume
FROM landed WHERE timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY ALL"""))
def candle_range(spark, sf_dir):
    return candles.candle_range(_landed(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 25))


@query("symbol:s timeframe:s candles:i", _result(
    sql.CANDLES, "SELECT symbol, timeframe, count(*) AS candles FROM candles GROUP BY ALL"))
def supported_candles(spark, sf_dir):
    """The allow-list check with the feed's own symbols."""
    known = ("view", "click", "signup", "purchase", "error")
    checked = candles.require_supported(_candles(spark, sf_dir), symbols=known)
    return checked.groupBy("symbol", "timeframe").agg(F.count("*").alias("candles"))


@query("symbol:s bid:f ask:f last:f volume_24h:f timestamp:t", _result(sql.TRADES, """
SELECT symbol, arg_max(price, ms) - 1 AS bid, arg_max(price, ms) + 1 AS ask, arg_max(price, ms) AS last,
       arg_max(CASE WHEN seq % 2 = 0 THEN amount ELSE 0 END, ms) AS volume_24h,
       make_timestamp(max(ms) * 1000) AS timestamp
FROM (SELECT *, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ms FROM trades) GROUP BY symbol"""))
def tickers(spark, sf_dir):
    """Each trade as a ticker snapshot with spread 2; odd ones lack a volume."""
    raw = read_trades(spark, sf_dir).select(
        "symbol", (F.col("price") - 1).alias("bid"), (F.col("price") + 1).alias("ask"), F.col("price").alias("last"),
        F.when(F.col("seq") % 2 == 0, F.col("amount")).alias("base_volume"), F.unix_millis("ts").alias("ts_ms"))
    return candles.latest_tickers(candles.normalize_tickers(raw))


@query(_CANDLE, _result(sql.LANDED, """
SELECT symbol, timeframe, timestamp, arg_min(open, ingest_seq) AS open, arg_min(high, ingest_seq) AS high,
       arg_min(low, ingest_seq) AS low, arg_min(close, ingest_seq) AS close, arg_min(volume, ingest_seq) AS volume
FROM landed WHERE timestamp >= TIMESTAMP '2024-01-16' GROUP BY ALL"""))
def candle_upsert(spark, sf_dir):
    """What an upsert of the whole feed adds to a table that holds the first half of the month."""
    landed = materialize(_landed(spark, sf_dir))
    stored = candles.first_seen(landed.filter(F.col("timestamp") < F.lit(datetime(2024, 1, 16))))
    return candles.new_candles(landed, stored)


def _both_candles(spark, sf_dir):
    feed = read_trades(spark, sf_dir)
    return candles.candles_from_trades(feed, "4h", 4 * 3600).unionByName(candles.candles_from_trades(feed, "15m", 900))


@query(_CANDLE, _result(sql.BOTH_CANDLES, "SELECT * FROM both_ ANTI JOIN broken USING (symbol, timeframe)"))
def landed_pages(spark, sf_dir):
    """Candles decoded from pages of JSON text; the series with a bad page are left out."""
    return landed.candle_pages(adapters.landed_pages(_both_candles(spark, sf_dir)))[0]


@query("symbol:s timeframe:s records:i reason:s", _result(sql.BOTH_CANDLES, """
SELECT symbol, timeframe, CASE WHEN reason IS NULL THEN n ELSE 0 END AS records, reason
FROM (SELECT symbol, timeframe, count(*) AS n FROM both_ GROUP BY ALL) LEFT JOIN broken USING (symbol, timeframe)"""))
def landed_status(spark, sf_dir):
    return landed.candle_pages(adapters.landed_pages(_both_candles(spark, sf_dir)))[1]


@query("symbol:s seq:i ts:t price:f amount:f", _result(sql.TRADES, """
SELECT symbol, seq // 1000 * 1000 + row_number() OVER (PARTITION BY symbol, seq // 1000 ORDER BY seq) - 1 AS seq,
  make_timestamp(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) * 1000) AS ts, price, amount FROM trades WHERE symbol <> 'error'"""))
def landed_trades(spark, sf_dir):
    """Trades decoded from pages of JSON objects; the symbol with a page that is no list is left out."""
    return landed.trade_pages(adapters.landed_trade_pages(read_trades(spark, sf_dir)))[0]


@query("symbol:s timeframe:s candles:i reason:s", _result(sql.BOTH_CANDLES, f"""
SELECT symbol, timeframe, CASE WHEN reason IS NULL THEN coalesce(n, 0) ELSE 0 END AS candles, reason
FROM (SELECT * FROM (SELECT DISTINCT symbol FROM both_), (VALUES ('4h'), ('15m')) t(timeframe))
LEFT JOIN broken USING (symbol, timeframe)
LEFT JOIN (
  SELECT symbol, timeframe, count(*) AS n FROM both_
  WHERE timestamp BETWEEN {sql.NOW} - CASE timeframe WHEN '4h' THEN INTERVAL 30 DAYS ELSE INTERVAL 7 DAYS END AND {sql.NOW} GROUP BY ALL)
USING (symbol, timeframe)"""))
def two_phase_load(spark, sf_dir):
    """Deep and recent candles loaded from landed pages, three of the series with a bad page."""
    known = ["view", "click", "signup", "purchase", "error"]
    pages = adapters.landed_pages(_both_candles(spark, sf_dir))
    return landed.load_two_phases(pages, scratch_path(spark, "two-phase"), NOW, known, months=1, deep="4h", live="15m")


@query(_CANDLE, _result(sql.LANDED, """
SELECT symbol, timeframe, timestamp, arg_min(open, ingest_seq) AS open, arg_min(high, ingest_seq) AS high,
       arg_min(low, ingest_seq) AS low, arg_min(close, ingest_seq) AS close, arg_min(volume, ingest_seq) AS volume
FROM landed WHERE timestamp >= TIMESTAMP '2024-01-16' AND timestamp < TIMESTAMP '2024-01-20' GROUP BY ALL"""))
def candle_topup(spark, sf_dir):
    """What twelve days of the feed add to a stored table that ends within them; the stored days before are not read."""
    path = scratch_path(spark, "candles")
    landed_ = materialize(_landed(spark, sf_dir))
    candles.store_candles(landed_.filter(F.col("timestamp") < F.lit(datetime(2024, 1, 16))), path)
    days = landed_.filter(F.col("timestamp").between(F.lit(datetime(2024, 1, 8)), F.lit(datetime(2024, 1, 19, 23, 59, 59))))
    return candles.new_candles(days, candles.stored_beside(days, path))


@query(_CANDLE, _result(sql.LANDED, """
SELECT symbol, timeframe, timestamp, arg_min(open, ingest_seq) AS open, arg_min(high, ingest_seq) AS high,
       arg_min(low, ingest_seq) AS low, arg_min(close, ingest_seq) AS close, arg_min(volume, ingest_seq) AS volume
FROM landed WHERE symbol = 'click' AND timestamp BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY ALL"""))
def loaded_series(spark, sf_dir):
    """One series loaded into the table, twice, and read back."""
    path = scratch_path(spark, "series")
    landed_ = materialize(_landed(spark, sf_dir))
    for _ in range(2):
        candles.load_series(landed_, path, "click", "4h", datetime(2024, 1, 5), datetime(2024, 1, 25))
    return candles.read_candles(spark, path)


@query("symbol:s timeframe:s candles:i earliest:t latest:t", _result(sql.CANDLES, """
SELECT a.symbol, a.timeframe, count(c.symbol) AS candles, min(timestamp) AS earliest, max(timestamp) AS latest
FROM (SELECT * FROM (SELECT DISTINCT event_type AS symbol FROM events), (VALUES ('4h'), ('1d')) t(timeframe)) a
LEFT JOIN candles c ON c.symbol = a.symbol AND c.timeframe = a.timeframe GROUP BY a.symbol, a.timeframe"""))
def series_extent(spark, sf_dir):
    """Count and range of every series asked for, of a timeframe that is stored and one that is not."""
    feed = _candles(spark, sf_dir)
    asked = _symbols(read_trades(spark, sf_dir)).withColumn("timeframe", F.explode(F.array(F.lit("4h"), F.lit("1d"))))
    return candles.series_extent(feed, asked)


@query("symbol:s timeframe:s candles:i earliest:t latest:t", _result(sql.CANDLES, """
SELECT symbol, timeframe, count(*) AS candles, min(timestamp) AS earliest, max(timestamp) AS latest
FROM candles GROUP BY ALL"""))
def seed_report(spark, sf_dir):
    """Count and range of the stored candles, after storing the feed twice."""
    path = scratch_path(spark, "candles")
    landed = materialize(_landed(spark, sf_dir))
    candles.store_candles(landed, path)
    candles.store_candles(landed, path)
    return candles.seed_report(candles.read_candles(spark, path))


@query(_CANDLE, _result(sql.LANDED, """
SELECT symbol, timeframe, timestamp, arg_min(open, ingest_seq) AS open, arg_min(high, ingest_seq) AS high,
       arg_min(low, ingest_seq) AS low, arg_min(close, ingest_seq) AS close, arg_min(volume, ingest_seq) AS volume
FROM landed GROUP BY ALL"""))
def streamed_candles(spark, sf_dir):
    """Landed candles streamed from files into the candle table."""
    root = scratch_path(spark, "stream-candles")
    _landed(spark, sf_dir).write.parquet(f"{root}/landed")
    feed = spark.readStream.schema(spark.read.parquet(f"{root}/landed").schema).parquet(f"{root}/landed")
    stream_candles.stream_candles(feed, f"{root}/table", f"{root}/checkpoint").awaitTermination()
    return candles.read_candles(spark, f"{root}/table")


@query("key:s thr:s rows:i", _result("", """
SELECT upper(replace(o_orderstatus || '/' || o_orderpriority, '/', '_')) AS key,
       'thr_' || CAST(CAST(trunc(o_totalprice / 10000) AS BIGINT) AS VARCHAR) AS thr, count(*) AS rows
FROM orders GROUP BY ALL"""))
def storage_keys(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    name = F.concat(F.col("o_orderstatus"), F.lit("/"), F.col("o_orderpriority"))
    return orders.groupBy(symbol_key(name).alias("key"), threshold_key(F.col("o_totalprice") / 10000).alias("thr")).agg(
        F.count("*").alias("rows"))


@query("id:i " + _CANDLE, _result(sql.CANDLES, "SELECT *, epoch_us(timestamp) AS id FROM candles"))
def candle_view(spark, sf_dir):
    return candles.client_view(_candles(spark, sf_dir).withColumn("id", F.unix_micros("timestamp")), candles.CANDLE_VIEW)


_DEALS = """
deals AS (
  SELECT event_id AS id, event_id + 1 AS signal_id, CASE WHEN user_id % 2 = 0 THEN 'paper' ELSE 'live' END AS mode, event_type AS symbol,
    CASE WHEN event_id % 2 = 0 THEN 'long' ELSE 'short' END AS direction, 1000 + value AS entry_price, 990 + value AS stop_loss, 1020 + value AS take_profit,
    CASE WHEN event_id % 3 = 0 THEN 1010 + value END AS exit_price, value AS position_size, 2 * value AS risk_amount, 2.0 AS risk_reward_ratio,
    CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END AS status, props AS technical_summary, NULL AS coordinator_summary,
    ts AS created_at, ts + INTERVAL 15 MINUTES AS expires_at, CASE WHEN event_id % 3 = 0 THEN 10 * value END AS pnl,
    CASE WHEN event_id % 3 = 0 THEN 0.5 END AS pnl_pct, ts AS opened_at, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS closed_at
  FROM events)"""


@query("id:i symbol:s direction:s entry_price:f stop_loss:f take_profit:f position_size:f risk_amount:f risk_reward_ratio:f status:s "
       "technical_summary:s coordinator_summary:s created_at:t expires_at:t", _result(_DEALS, "SELECT * FROM deals"))
def signal_view(spark, sf_dir):
    return candles.client_view(adapters.deals(read_events(spark, sf_dir)), candles.SIGNAL_VIEW)


@query("id:i signal_id:i mode:s symbol:s direction:s entry_price:f exit_price:f position_size:f pnl:f pnl_pct:f status:s opened_at:t closed_at:t",
       _result(_DEALS, "SELECT * FROM deals"))
def trade_view(spark, sf_dir):
    return candles.client_view(adapters.deals(read_events(spark, sf_dir)), candles.TRADE_VIEW)


@query("entry_price:f stop_loss:f take_profit:f direction:s rows:i", _result(_DEALS, """
SELECT entry_price, stop_loss, take_profit, direction, count(*) AS rows FROM deals GROUP BY ALL"""))
def gate_columns(spark, sf_dir):
    """What the risk gate sees of the signals."""
    seen = risk.gate_view(adapters.deals(read_events(spark, sf_dir)))
    return seen.groupBy(*seen.columns).agg(F.count("*").alias("rows"))


@query("l_quantity:f up:f even:f rows:i", _result("", """
SELECT l_quantity, round(CAST(l_quantity / 8 AS DECIMAL(10,3)), 2) AS up, round_even(l_quantity / 8, 2) AS even,
       count(*) AS rows FROM lineitem GROUP BY l_quantity"""))
def rounding(spark, sf_dir):
    """Eighths at two decimals, half up and half even."""
    eighth = (F.col("l_quantity") / 8).cast("decimal(10,3)")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.groupBy("l_quantity", half_up(eighth, 2).alias("up"), half_even(eighth, 2).alias("even")).agg(
        F.count("*").alias("rows"))


@query("day:s hour:i events:i", _result("", """
SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, count(*) AS events FROM events GROUP BY ALL"""))
def calendar(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return read_events(spark, sf_dir).groupBy(day_key(ts).alias("day"), F.hour(ts).alias("hour")).agg(
        F.count("*").alias("events"))


# --- stored label and weight sets --------------------------------------------------------------

# The recipes as JSON with sorted keys; their identity is the start of its SHA-256.
_LABEL_RECIPE = '{"ewma_span": 10, "kappa": 1.0, "max_hp": 10, "min_ret": 0.0, "pt_mult": 1.0, "schema_version": 1, "sl_mult": 1.0}'
_WEIGHT_RECIPE = '{"decay_c": 0.5, "schema_version": 1}'


@query("symbol:s threshold:f label_hash:s kappa:f ewma_span:i max_hp:i n_labels:i", _result(sql.LABELS, f"""
SELECT symbol, 5000 AS threshold, substr(sha256('{_LABEL_RECIPE}'), 1, 12) AS label_hash, 1.0 AS kappa, 10 AS ewma_span, 10 AS max_hp,
  count(*) AS n_labels FROM labels_ GROUP BY symbol"""))
def label_sets(spark, sf_dir):
    """Label sets stored twice and listed from the catalog."""
    root = scratch_path(spark, "labels")
    _, labelled = _labels(spark, sf_dir)
    for _ in range(2):
        catalog.store_labels(labelled, LABELING, THRESHOLD, root)
    return catalog.list_label_configs(spark, root)


@query(_LABEL, _result(sql.LABELS, "SELECT * FROM labels_ WHERE symbol = 'purchase'"))
def loaded_labels(spark, sf_dir):
    """One stored label set read back by its recipe."""
    root = scratch_path(spark, "labels")
    _, labelled = _labels(spark, sf_dir)
    catalog.store_labels(labelled, LABELING, THRESHOLD, root)
    return catalog.load_labels(spark, LABELING, "purchase", THRESHOLD, root)


@query("symbol:s t0_seq:i t1_seq:i avg_uniqueness:f weight:f", _result(
    sql.LABEL_SPANS + sql.MEASURED, """
SELECT symbol, t0_seq, t1_seq, avg_uniqueness, norm * decay AS weight FROM decayed WHERE symbol = 'view'"""))
def loaded_weights(spark, sf_dir):
    """One stored weight set read back by both recipes."""
    root = scratch_path(spark, "weights")
    bars, labelled = _labels(spark, sf_dir)
    catalog.store_weights(sample_weights(bars, labelled, WEIGHTING), WEIGHTING, LABELING, THRESHOLD, root)
    return catalog.load_weights(spark, WEIGHTING, LABELING, "view", THRESHOLD, root)


@query("symbol:s label_hash:s weight_hash:s decay_c:f n_weights:i", _result(sql.LABELS, f"""
SELECT symbol, substr(sha256('{_LABEL_RECIPE}'), 1, 12) AS label_hash, substr(sha256('{_WEIGHT_RECIPE}'), 1, 12) AS weight_hash, 0.5 AS decay_c,
  count(*) AS n_weights FROM labels_ GROUP BY symbol"""))
def weight_sets(spark, sf_dir):
    root = scratch_path(spark, "weights")
    bars, labelled = _labels(spark, sf_dir)
    catalog.store_weights(sample_weights(bars, labelled, WEIGHTING), WEIGHTING, LABELING, THRESHOLD, root)
    return catalog.list_weight_configs(spark, root)


# --- indicators, signals, risk -----------------------------------------------------------------

@query("symbol:s timestamp:t bar_seq:i ema_fast:e ema_slow:e rsi:f volume_ratio:e swing_low:f swing_high:f",
       _result(sql.EVERY_SIGNAL, """
SELECT symbol, timestamp, bar_seq, CASE WHEN bar_seq >= 8 THEN ema_fast END AS ema_fast,
       CASE WHEN bar_seq >= 20 THEN ema_slow END AS ema_slow, CASE WHEN bar_seq >= 14 THEN rsi END AS rsi,
       volume_ratio, swing_low, swing_high FROM indicated"""))
def candle_indicators(spark, sf_dir):
    return indicators.with_indicators(indicators.number_candles(_candles(spark, sf_dir)))


_SIGNAL = ("symbol:s timestamp:t direction:s entry_price:f stop_loss:f take_profit:f risk_reward:f rsi:f "
           "volume_ratio:e confidence:s")


@query(_SIGNAL, _result(sql.EVERY_SIGNAL, "SELECT * FROM signals_"))
def candle_signals(spark, sf_dir):
    """Signals judged at every candle, averages seeded at the series start."""
    return indicators.signals(indicators.with_indicators(indicators.number_candles(_candles(spark, sf_dir))))


@query(_SIGNAL, _result(sql.LATEST_SIGNAL, "SELECT * FROM latest"))
def latest_signals(spark, sf_dir):
    return indicators.latest_signals(_candles(spark, sf_dir))


_TRIALS = sql.TRADES + """,
trials AS (
  SELECT seq AS signal_id, symbol, price AS entry_price,
         price - CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * CAST((seq % 7) AS DECIMAL(18,8)) * 10 AS stop_loss,
         CASE WHEN seq % 11 = 0 THEN 0 ELSE price + CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END * (seq % 13) * 10 END AS take_profit,
         CASE WHEN seq % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
         CAST(10000 AS DECIMAL(20,8)) AS total_capital, CAST(10000 AS DECIMAL(20,8)) AS available_capital,
         seq % 5 AS open_positions, -((seq % 17) / 300) AS daily_pnl_pct, seq % 19 = 0 AS kill_switch_active
  FROM trades)"""


@query("signal_id:i approved:b rejection_reason:s position_size:e risk_amount:f",
       _result(_TRIALS + sql.gate("trials"), "SELECT * FROM judged"))
def risk_validation(spark, sf_dir):
    """Every trade as a trial signal in varying account states."""
    sign = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    trials = read_trades(spark, sf_dir).select(
        F.col("seq").alias("signal_id"), F.col("price").alias("entry_price"),
        (F.col("price") - sign * (F.col("seq") % 7) * 10).cast("decimal(20,8)").alias("stop_loss"),
        F.when(F.col("seq") % 11 == 0, 0).otherwise(F.col("price") + sign * (F.col("seq") % 13) * 10)
        .cast("decimal(20,8)").alias("take_profit"),
        F.when(F.col("seq") % 2 == 0, "long").otherwise("short").alias("direction"),
        F.lit(10000).cast("decimal(20,8)").alias("total_capital"),
        F.lit(10000).cast("decimal(20,8)").alias("available_capital"),
        (F.col("seq") % 5).alias("open_positions"), (-(F.col("seq") % 17) / 300).alias("daily_pnl_pct"),
        (F.col("seq") % 19 == 0).alias("kill_switch_active"))
    return risk.validate(trials)


_ACCOUNT = """,
staked AS (
  SELECT *, CAST(10000 AS DECIMAL(20,8)) AS total_capital, CAST(10000 AS DECIMAL(20,8)) AS available_capital,
         0 AS open_positions, 0.0 AS daily_pnl_pct, false AS kill_switch_active FROM latest)"""


@query("symbol:s status:s direction:s entry_price:f position_size:e risk_amount:f rejection_reason:s", _result(
    sql.LATEST_SIGNAL + _ACCOUNT + sql.gate("staked"), """
SELECT c.symbol, CASE WHEN j.symbol IS NULL THEN 'no_signal' WHEN approved THEN 'approved' ELSE 'rejected' END AS status,
       direction, entry_price, position_size, risk_amount, rejection_reason
FROM (SELECT DISTINCT symbol FROM candles) c LEFT JOIN judged j ON j.symbol = c.symbol"""))
def symbol_audit(spark, sf_dir):
    """One row per symbol, whatever the outcome."""
    feed = materialize(_candles(spark, sf_dir))
    return audit(feed, _symbols(feed), ACCOUNT)


# --- review ------------------------------------------------------------------------------------

def _sessions(spark, sf_dir):
    return review.classify(adapters.reviewer_outcomes(read_events(spark, sf_dir)))


@query("signal_id:i symbol:s direction:s confidence:f recommended_size:f sent_at:t decided_at:t decision:s "
       "decision_latency_seconds:f hour_of_day:i is_override:b", _result(sql.OUTCOMES, """
SELECT *, make_timestamp(epoch_us(made) - CAST(round(latency * 1000000) AS BIGINT)) AS sent_at,
       latency AS decision_latency_seconds, hour(made) AS hour_of_day FROM sessions"""))
def reviewer_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir)


@query("signal_id:i override_rate:f", _result(sql.OUTCOMES, """
SELECT s.signal_id, coalesce(avg(CAST(h.is_override AS INTEGER)), 0) AS override_rate
FROM sessions s LEFT JOIN sessions h ON h.decided_at < s.made AND h.decided_at >= s.made - INTERVAL 24 HOURS
GROUP BY s.signal_id"""))
def rolling_override_rate(spark, sf_dir):
    return review.rolling_override_rate(_sessions(spark, sf_dir))


@query("day:s decisions:i override_rate:f", _result(sql.OUTCOMES, f"""
SELECT CAST(decided_at AS DATE) AS day, count(*) AS decisions, avg(CAST(is_override AS INTEGER)) AS override_rate
FROM sessions WHERE decided_at >= {sql.NOW} - INTERVAL 90 DAYS GROUP BY 1"""))
def daily_override_rates(spark, sf_dir):
    return review.daily_override_rates(_sessions(spark, sf_dir), NOW)


@query("history_rows:i override_rate:f mean:f stddev:f z_score:f escalate:b", _result(sql.OUTCOMES, f"""
SELECT history_rows, override_rate, mean, stddev, CASE WHEN stddev <> 0 THEN (override_rate - mean) / stddev END AS z_score,
       coalesce((override_rate - mean) / nullif(stddev, 0) > 2, false) AS escalate
FROM (SELECT sum(n) AS history_rows, round(avg(rate), 4) AS mean, round(stddev_samp(rate), 4) AS stddev,
        (SELECT coalesce(avg(CAST(is_override AS INTEGER)), 0) FROM sessions
         WHERE decided_at >= {sql.NOW} - INTERVAL 24 HOURS) AS override_rate
      FROM (SELECT CAST(decided_at AS DATE) AS day, count(*) AS n, avg(CAST(is_override AS INTEGER)) AS rate
            FROM sessions WHERE decided_at >= {sql.NOW} - INTERVAL 90 DAYS GROUP BY 1))"""))
def override_drift(spark, sf_dir):
    return review.drift(materialize(_sessions(spark, sf_dir)), NOW)


_SNAPSHOTS = sql.OUTCOMES + """,
per_day AS (
  SELECT s.signal_id, any_value(s.made) AS made, CAST(h.decided_at AS DATE) AS day, count(h.signal_id) AS n,
         avg(CAST(h.is_override AS INTEGER)) AS rate,
         count(h.signal_id) FILTER (h.decided_at >= s.made - INTERVAL 24 HOURS) AS n24,
         count(h.signal_id) FILTER (h.decided_at >= s.made - INTERVAL 24 HOURS AND h.is_override) AS o24
  FROM sessions s LEFT JOIN sessions h ON h.decided_at < s.made AND h.decided_at >= s.made - INTERVAL 90 DAYS
  GROUP BY s.signal_id, CAST(h.decided_at AS DATE)),
metrics AS (
  SELECT signal_id, sum(n) AS history_rows,
         CASE WHEN sum(n24) = 0 THEN 0 ELSE sum(o24) / sum(n24) END AS override_rate,
         CASE WHEN sum(n) >= 10 THEN round(avg(rate), 4) ELSE 0 END AS mean,
         CASE WHEN sum(n) >= 10 THEN coalesce(round(stddev_samp(rate), 4), 0) ELSE 0 END AS stddev
  FROM per_day GROUP BY signal_id),
scored AS (
  SELECT *, CASE WHEN history_rows >= 10 AND stddev <> 0 THEN (override_rate - mean) / stddev END AS z_score
  FROM metrics)"""


@query("signal_id:i history_rows:i override_rate:f mean:f stddev:f z_score:f escalate:b",
       _result(_SNAPSHOTS, "SELECT *, coalesce(z_score > 2, false) AS escalate FROM scored"))
def snapshot_metrics(spark, sf_dir):
    return review.snapshot_metrics(materialize(_sessions(spark, sf_dir)))


@query("signal_id:i decision:s is_override:b historical_override_rate:f deviation_z_score:f escalation_flag:b",
       _result(_SNAPSHOTS, """
SELECT s.signal_id, s.decision, s.is_override, c.mean AS historical_override_rate,
       round(c.z_score, 3) AS deviation_z_score, coalesce(c.z_score > 2, false) AS escalation_flag
FROM sessions s JOIN scored c ON c.signal_id = s.signal_id"""))
def decision_log(spark, sf_dir):
    """The outcome stream logged with its metrics."""
    root = scratch_path(spark, "decisions")
    feed = adapters.reviewer_outcomes(adapters.events_stream(spark, sf_dir))
    stream_decisions.stream_decisions(feed, f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return stream_decisions.decision_log(spark, f"{root}/log")


@query("signal_id:i decision:s decided_at:t", _result(sql.RESPONSES, "SELECT * FROM resolved"))
def approvals(spark, sf_dir):
    events = read_events(spark, sf_dir)
    return review.resolve_approvals(adapters.sent_signals(events), adapters.reviewer_responses(events))


@query("signal_id:i decision:s decided_at:t", _result(sql.RESPONSES, """
SELECT signal_id, decided_at, CASE WHEN decision = 'timeout' AND NOT epoch_us(sent) + 120000000 <= (SELECT max(epoch_us(ts)) FROM events)
  THEN 'pending' ELSE decision END AS decision
FROM (SELECT r.*, e.ts AS sent FROM resolved r JOIN events e ON e.event_id = r.signal_id)"""))
def streamed_approvals(spark, sf_dir):
    """The approval wait as a stream. A timeout is known once the watermark has passed its wait; till then it is pending."""
    root = scratch_path(spark, "approvals")
    events = adapters.events_stream(spark, sf_dir)
    stream_approvals.stream_approvals(
        adapters.sent_signals(events), adapters.reviewer_responses(events), f"{root}/matched", f"{root}/checkpoint"
    ).awaitTermination()
    return stream_approvals.resolved(spark, f"{root}/matched", adapters.sent_signals(read_events(spark, sf_dir)))


@query("signal_ref:s symbol:s direction:s conviction:f submitted_at:t", _result(sql.IDEAS, "SELECT * FROM good"))
def valid_ideas(spark, sf_dir):
    good, _ = quarantine(adapters.ideas_from_events(read_events(spark, sf_dir)), ideas.idea_rules())
    return good


@query("broken:s ideas:i", _result(sql.IDEAS, """
SELECT concat_ws(',', CASE WHEN direction NOT IN ('long', 'short') THEN 'direction' END,
                 CASE WHEN conviction NOT BETWEEN 0 AND 1 THEN 'conviction' END) AS broken, count(*) AS ideas
FROM ideas WHERE direction NOT IN ('long', 'short') OR conviction NOT BETWEEN 0 AND 1 GROUP BY 1"""))
def rejected_ideas(spark, sf_dir):
    _, bad = quarantine(adapters.ideas_from_events(read_events(spark, sf_dir)), ideas.idea_rules())
    return bad.groupBy(F.array_join("broken_rules", ",").alias("broken")).agg(F.count("*").alias("ideas"))


@query("symbol:s direction:s conviction:f provenance:s submitted_at:t ref_size:i", _result(
    sql.IDEAS, "SELECT *, 'human' AS provenance, 36 AS ref_size FROM good"))
def submitted_ideas(spark, sf_dir):
    """Valid ideas submitted to the idea table and read back, each under a reference of its own."""
    path = scratch_path(spark, "ideas")
    good, _ = quarantine(adapters.ideas_from_events(read_events(spark, sf_dir)), ideas.idea_rules())
    ideas.submit_ideas(good.select("symbol", "direction", "conviction", "submitted_at"), path)
    return ideas.read_ideas(spark, path).withColumn("ref_size", F.length("signal_ref"))


@query("signal_ref:s symbol:s direction:s conviction:f", _result(
    sql.IDEAS, "SELECT * FROM good WHERE NOT (event_id % 4 = 0 AND user_id % 2 = 1)"))
def pending_ideas(spark, sf_dir):
    """Ideas left after some were marked consumed, one mark for an unknown idea included."""
    events = read_events(spark, sf_dir)
    good, _ = quarantine(adapters.ideas_from_events(events), ideas.idea_rules())
    log = scratch_path(spark, "consumed")
    marked = events.filter((F.col("event_id") % 4 == 0) & (F.col("user_id") % 2 == 1))
    ideas.mark_consumed(marked.select(F.col("event_id").cast("string").alias("signal_ref")).unionByName(
        marked.select(F.concat(F.lit("x"), F.col("event_id")).alias("signal_ref"))), log)
    return ideas.pending_ideas(good, ideas.read_consumed(spark, log))


# --- user functions ----------------------------------------------------------------------------

@query("batch:i rows:i total:f", _result(sql.TRADES, """
SELECT seq // 500 AS batch, count(*) AS rows, sum(CAST(price * amount AS DOUBLE)) AS total FROM trades GROUP BY 1"""))
def batch_sums(spark, sf_dir):
    """A user function over batches of 500 positions."""
    def total(frame):
        value = (frame["price"].astype("float64") * frame["amount"].astype("float64")).sum()
        return frame.head(1).assign(batch=frame["seq"] // 500, rows=len(frame), total=value)[["batch", "rows", "total"]]

    atoms = read_trades(spark, sf_dir).select("seq", "price", "amount")
    return batches.apply_batches(atoms, total, "batch long, rows long, total double", 500)


@query("rows:i first:f last:f rise:f", _result(sql.TRADES, """
SELECT count(*) AS rows, arg_min(price, seq) AS first, arg_max(price, seq) AS last, max(price - before) AS rise
FROM (SELECT *, lag(price) OVER (ORDER BY seq) AS before FROM trades)"""))
def batch_fold(spark, sf_dir):
    """A user fold whose order matters, over batches of 500 positions: the largest rise from one trade to the next."""
    def one(frame):
        price = frame["price"].astype("float64")
        return frame.head(1).assign(rows=len(frame), first=price.iloc[0], last=price.iloc[-1], rise=price.diff().max())[["rows", "first", "last", "rise"]]

    def both(left, right):
        step = right["first"].iloc[0] - left["last"].iloc[0]
        left["rise"] = max([x for x in (left["rise"].iloc[0], right["rise"].iloc[0], step) if x == x])
        left["rows"], left["last"] = left["rows"] + right["rows"], right["last"]

    return batches.fold_batches(read_trades(spark, sf_dir).select("seq", "price"), one, both, "rows long, first double, last double, rise double", 500, fan_in=8)
