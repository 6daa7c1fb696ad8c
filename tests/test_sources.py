import hashlib
import json
from datetime import datetime, timedelta
from decimal import Decimal

import pandas as pd
import pytest
from conftest import START
from pyspark.sql import functions as F

from tickframe.functions.configs import LabelConfig, ValidationConfig, WeightConfig
from tickframe.functions.exprs import half_even, half_up, symbol_key, threshold_key
from tickframe.functions.validate import require
from tickframe.operators.batches import apply_batches, reduce_batches
from tickframe.operators.scoring import cv_score, estimator_predictor, fold_scores, weighted_pipeline
from tickframe.operators.volatility import packet_rules
from tickframe.schema import BARS, RAW_CANDLES
from tickframe.sources import candles, catalog

LABELS = LabelConfig(1.0, 20, 1.0, 2.0, 10, 0.0)


def landed(spark, rows):
    raw = spark.createDataFrame([
        (s, tf, int((START.timestamp() + 900 * i) * 1000), 1.0, 2.0, 0.5, float(c), 10.0, seq)
        for seq, (s, tf, i, c) in enumerate(rows)], RAW_CANDLES)
    return candles.normalize_candles(raw)


def test_candle_range_keeps_the_first_copy(spark):
    frame = landed(spark, [("a", "15m", 0, 1), ("a", "15m", 1, 2), ("a", "15m", 1, 99), ("a", "15m", 2, 3), ("a", "15m", 9, 4)])
    got = candles.candle_range(frame, START, START + timedelta(minutes=30)).orderBy("timestamp").collect()
    assert [float(r.close) for r in got] == [1, 2, 3]
    assert frame.schema["close"].dataType.simpleString() == "decimal(20,8)"


def test_store_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "c")
    frame = landed(spark, [("a", "15m", i, i) for i in range(5)] + [("b", "1h", 0, 1), ("b", "1h", 0, 2)])
    assert candles.read_candles(spark, path).count() == 0
    assert candles.store_candles(frame, path) == 6
    assert candles.store_candles(frame, path) == 0
    assert candles.store_candles(landed(spark, [("a", "15m", 4, 99), ("a", "15m", 5, 5)]), path) == 1
    stored = candles.read_candles(spark, path)
    assert candles.candle_count(stored, "a", "15m") == 6
    assert candles.date_range(stored, "a", "15m") == (START, START + timedelta(minutes=75))
    assert candles.date_range(stored, "zz", "15m") == (None, None)
    assert {(r.symbol, r.candles) for r in candles.seed_report(stored).collect()} == {("a", 6), ("b", 1)}
    assert candles.load_series(frame, str(tmp_path / "d"), "a", "15m", START, START + timedelta(minutes=15)) == 2


def test_two_phase_bounds(spark):
    until = datetime(2024, 3, 1)
    assert candles.history_window(until, 2) == (until - timedelta(days=60), until)
    rows = [("a", tf, int((until - timedelta(days=d) - START).total_seconds() / 900), 1)
            for tf in ("1h", "15m", "4h") for d in (0, 5, 8, 31)]
    loaded = candles.two_phase(landed(spark, rows), until, months=1)
    got = {(r.symbol, r.timeframe): r.candles for r in candles.load_counts(loaded, ["a", "b"], ["1h", "15m"]).collect()}
    assert got == {("a", "1h"): 3, ("a", "15m"): 2, ("b", "1h"): 0, ("b", "15m"): 0}


def test_allow_list_and_tickers(spark):
    frame = landed(spark, [("BTC/USD", "15m", 0, 1), ("DOGE/USD", "15m", 0, 1)])
    with pytest.raises(Exception, match="broken rules: symbol"):
        candles.require_supported(frame).collect()
    assert candles.require_supported(frame.filter("symbol = 'BTC/USD'")).count() == 1
    raw = spark.createDataFrame([("s", 1.0, 2.0, 1.5, 7.0, 1000), ("s", 2.0, 3.0, 2.5, None, 2000)],
                                "symbol string, bid double, ask double, last double, base_volume double, ts_ms long")
    row = candles.latest_tickers(candles.normalize_tickers(raw)).first()
    assert (row.last, row.volume_24h) == (Decimal("2.5"), 0)


def test_views(spark):
    wide = spark.range(1).select(*[F.lit(1).alias(c) for c in [*candles.SIGNAL_VIEW, *set(candles.TRADE_VIEW) -
                                   set(candles.SIGNAL_VIEW), "timeframe", "timestamp", "open", "high", "low", "close",
                                   "volume", "hidden"]])
    for view in (candles.SIGNAL_VIEW, candles.TRADE_VIEW, candles.CANDLE_VIEW):
        assert candles.client_view(wide, view).columns == view


def test_recipe_hashes():
    text = json.dumps({"decay_c": 0.5, "schema_version": 1}, sort_keys=True)
    assert WeightConfig(0.5).config_hash() == hashlib.sha256(text.encode()).hexdigest()[:12]
    assert WeightConfig(0).config_hash() != WeightConfig(0.0).config_hash()
    assert LABELS.config_hash() == LabelConfig(min_ret=0.0, max_hp=10, sl_mult=2.0, pt_mult=1.0, ewma_span=20,
                                               kappa=1.0).config_hash()


@pytest.mark.parametrize("build", [
    lambda: LabelConfig(0.0, 20, 1, 1, 10, 0), lambda: LabelConfig(1, 1, 1, 1, 10, 0),
    lambda: LabelConfig(1, 20, -1, 1, 10, 0), lambda: LabelConfig(1, 20, 1, 1, 0, 0),
    lambda: LabelConfig(1, 20, 1, 1, 10, -0.1), lambda: WeightConfig(1.01), lambda: WeightConfig(1, 0),
    lambda: ValidationConfig(1, 0, 2, 1), lambda: ValidationConfig(2, 1, 2, 1), lambda: ValidationConfig(2, 0, 2, 2)])
def test_recipe_bounds(build):
    with pytest.raises(ValueError):
        build()


def test_keys_and_rounding(spark):
    row = spark.range(1).select(
        symbol_key(F.lit("btc/usd")).alias("s"), threshold_key(F.lit(Decimal("500000.99"))).alias("t"),
        half_up(F.lit(Decimal("0.125")), 2).alias("up"), half_even(F.lit(Decimal("0.125")), 2).alias("even")).first()
    assert tuple(row) == ("BTC_USD", "thr_500000", Decimal("0.13"), Decimal("0.12"))
    assert catalog.collides(Decimal("500000.99"), Decimal("500000"))


def test_packet_contract(spark):
    def packet(side, confidence):
        return spark.createDataFrame([(side, confidence)], "side int, confidence double").withColumn(
            "metadata", F.create_map(F.lit("ewma_vol"), F.lit(Decimal("0.01"))))
    assert require(packet(1, 1.0), packet_rules()).count() == 1
    for bad in (packet(0, 0.5), packet(1, 1.1), packet(-1, 0.5).withColumn("metadata", F.lit(None).cast("map<string,decimal(18,8)>"))):
        with pytest.raises(Exception, match="broken rules"):
            require(bad, packet_rules()).collect()


def label_rows(spark, symbol, n):
    return spark.createDataFrame([(symbol, i, float(i)) for i in range(n)], "symbol string, t0_seq long, ret double")


def test_label_store(spark, tmp_path):
    root, t = str(tmp_path), Decimal("1000000")
    with pytest.raises(FileNotFoundError):
        catalog.load_labels(spark, LABELS, "BTC/USD", t, root)
    assert catalog.list_label_configs(spark, root).count() == 0
    catalog.store_labels(label_rows(spark, "BTC/USD", 3), LABELS, t, root)
    catalog.store_labels(label_rows(spark, "ETH/USD", 2), LABELS, t, root)
    assert catalog.load_labels(spark, LABELS, "BTC/USD", t, root).count() == 3
    with pytest.raises(KeyError):
        catalog.load_labels(spark, LabelConfig(2.0, 20, 1, 1, 10, 0), "BTC/USD", t, root)
    with pytest.raises(KeyError):
        catalog.store_labels(label_rows(spark, "BTC/USD", 4), LABELS, t, root, overwrite=False)
    catalog.store_labels(label_rows(spark, "BTC/USD", 4), LABELS, t, root)
    listed = {r.symbol: (r.n_labels, r.kappa, r.ewma_span) for r in catalog.list_label_configs(spark, root).collect()}
    assert listed == {"BTC/USD": (4, 1.0, 20), "ETH/USD": (2, 1.0, 20)}
    with pytest.raises(ValueError, match="shares its key"):
        catalog.store_labels(label_rows(spark, "BTC/USD", 1), LABELS, Decimal("1000000.5"), root)


def test_weight_store_keeps_parents_apart(spark, tmp_path):
    root, t, other = str(tmp_path), Decimal(5000), LabelConfig(2.0, 20, 1.0, 2.0, 10, 0.0)
    weights = WeightConfig(0.5)
    assert catalog.list_weight_configs(spark, root).count() == 0
    catalog.store_weights(label_rows(spark, "s", 3), weights, LABELS, t, root)
    with pytest.raises(KeyError):
        catalog.load_weights(spark, weights, other, "s", t, root)
    catalog.store_weights(label_rows(spark, "s", 2), weights, other, t, root)
    assert {(r.label_hash, r.n_weights) for r in catalog.list_weight_configs(spark, root).collect()} == {
        (LABELS.config_hash(), 3), (other.config_hash(), 2)}
    assert catalog.load_weights(spark, weights, other, "s", t, root).count() == 2


def test_bar_store_and_resume(spark, tmp_path):
    root = str(tmp_path)
    assert catalog.load_bars(spark, root, "s", 1000).schema == BARS
    bars = spark.createDataFrame([("s", 0, START, START, 1.0, 1.0, 1.0, 1.0, 1.0, 1000.0, 1, True)], BARS)
    catalog.store_bars(bars, 1000, root)
    catalog.store_bars(bars, 1000, root)
    assert catalog.load_bars(spark, root, "s", 1000).count() == 1
    trades = spark.createDataFrame([("s", START, 1), ("s", START + timedelta(milliseconds=1), 2), ("n", START, 3)],
                                   "symbol string, ts timestamp, seq long")
    assert {r.seq for r in catalog.trades_to_resume(trades, bars).collect()} == {2, 3}
    assert catalog.trades_to_resume(trades, bars, START).count() == 3


def test_batches(spark):
    atoms = spark.range(10).withColumnRenamed("id", "seq")
    def total(frame, factor): return pd.DataFrame({"n": [len(frame)], "total": [frame.seq.sum() * factor]})
    got = apply_batches(atoms, total, "n long, total long", 3, factor=2)
    assert sorted((r.n, r.total) for r in got.collect()) == [(1, 18), (3, 6), (3, 24), (3, 42)]
    assert reduce_batches(got, F.sum("total").alias("t")).first().t == 90
    assert reduce_batches(got.limit(0), F.sum("total")) is None
    assert apply_batches(atoms, total, "n long, total long", 1, factor=1).count() == 10
    with pytest.raises(ValueError):
        apply_batches(atoms, total, "n long, total long", 0, factor=1)


# x, y and weights of the fixed scoring sample.
Y = [0, 1, 1, 0, 1, 0, 0, 1, 1, 0, 1, 1]
WEIGHT = [0.5 + i / 11 for i in range(12)]


def samples(spark):
    return spark.createDataFrame([("s", i, float(Y[i]), WEIGHT[i], float(i)) for i in range(12)],
                                 "symbol string, event_id long, y double, weight double, x double")


def thirds(spark):
    return spark.createDataFrame([(f, "s", i, "test" if i // 4 == f else "train") for f in range(3) for i in range(12)],
                                 "fold_id int, symbol string, event_id long, role string")


def test_scores_of_a_fixed_classifier(spark):
    import math

    p1 = F.when(F.col("x") % 3 == 0, 0.9).otherwise(0.2)

    def predict(train, test):
        return test.withColumn("p_y", F.when(F.col("y") == 1, p1).otherwise(1 - p1)).withColumn(
            "prediction", (p1 >= 0.5).cast("double"))

    for scoring in ("neg_log_loss", "accuracy"):
        got = {r.fold_id: r.score for r in cv_score(samples(spark), thirds(spark), predict, scoring).collect()}
        for fold in range(3):
            part = range(4 * fold, 4 * fold + 4)
            p = {i: 0.9 if i % 3 == 0 else 0.2 for i in part}
            value = {i: math.log(p[i] if Y[i] else 1 - p[i]) if scoring == "neg_log_loss"
                     else float((p[i] >= 0.5) == bool(Y[i])) for i in part}
            assert got[fold] == pytest.approx(sum(value[i] * WEIGHT[i] for i in part) / sum(WEIGHT[i] for i in part))
    with pytest.raises(ValueError):
        fold_scores(samples(spark), "f1")
    with pytest.raises(ValueError):
        cv_score(samples(spark), thirds(spark), predict, "f1")


def test_weighted_estimator(spark):
    from pyspark.ml.classification import LinearSVC, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    model = weighted_pipeline([VectorAssembler(inputCols=["x"], outputCol="features"),
                               LogisticRegression(labelCol="y", maxIter=5)], "weight")
    assert model.getStages()[-1].getWeightCol() == "weight"
    got = cv_score(samples(spark), thirds(spark), estimator_predictor(model)).collect()
    assert len(got) == 3 and all(r.score < 0 for r in got)
    accuracy = cv_score(samples(spark), thirds(spark), estimator_predictor(model, scoring="accuracy"), "accuracy")
    assert all(0 <= r.score <= 1 for r in accuracy.collect())
    with pytest.raises(AttributeError):
        estimator_predictor(LinearSVC())


def test_top_up_opens_the_touched_days_only(spark, tmp_path):
    """Files of other days are broken after they were stored: storing candles of one day still works and finds its copies."""
    path = str(tmp_path / "table")
    hours = lambda *at: landed(spark, [("a", "1h", 4 * h, h) for h in at])
    assert candles.store_candles(hours(1, 2, 25, 26, 49), path) == 5
    broken = [f for day in ("2024-01-01", "2024-01-03") for f in (tmp_path / "table" / f"day={day}").glob("*.parquet")]
    assert len(broken) >= 2
    for file in broken:
        file.write_bytes(b"not parquet")
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert candles.store_candles(hours(25, 26, 27), path) == 1
    plan = candles.stored_beside(hours(25), path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [day" in plan
    candles_left = spark.read.parquet(str(tmp_path / "table" / "day=2024-01-02"))
    assert sorted(r.timestamp for r in candles_left.collect()) == [START + timedelta(hours=h) for h in (25, 26, 27)]


def test_many_days_are_read_as_a_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(candles, "LISTED_DAYS", 1)
    path = str(tmp_path / "table")
    frame = landed(spark, [("a", "1h", 96 * d, d) for d in range(6)])
    assert candles.store_candles(frame, path) == 6
    assert candles.store_candles(landed(spark, [("a", "1h", 96 * d, d) for d in (1, 3, 7)]), path) == 1
    assert candles.stored_beside(landed(spark, []), path).count() == 0
    extent = candles.series_extent(candles.read_candles(spark, path), spark.createDataFrame([("a", "1h"), ("b", "1h")], "symbol string, timeframe string"))
    assert {r.symbol: (r.candles, r.latest) for r in extent.collect()} == {"a": (7, START + timedelta(days=7)), "b": (0, None)}


def test_a_symbol_without_labels_loses_its_set(spark, tmp_path):
    root, t = str(tmp_path), Decimal(5000)
    both = spark.createDataFrame([("BTC/USD",), ("ETH/USD",)], "symbol string")
    catalog.store_labels(label_rows(spark, "BTC/USD", 3).unionByName(label_rows(spark, "ETH/USD", 2)), LABELS, t, root)
    catalog.store_labels(label_rows(spark, "ETH/USD", 1), LABELS, t, root)
    assert catalog.load_labels(spark, LABELS, "BTC/USD", t, root).count() == 3
    catalog.store_labels(label_rows(spark, "ETH/USD", 4), LABELS, t, root, covered=both)
    assert {r.symbol: r.n_labels for r in catalog.list_label_configs(spark, root).collect()} == {"ETH/USD": 4}
    with pytest.raises(KeyError):
        catalog.load_labels(spark, LABELS, "BTC/USD", t, root)
    catalog.store_labels(label_rows(spark, "BTC/USD", 2), LABELS, t, root, overwrite=False)
    assert catalog.load_labels(spark, LABELS, "BTC/USD", t, root).count() == 2
