import random
from datetime import timedelta
from decimal import Decimal
from glob import glob

from conftest import START

from tickframe.operators.bars import dollar_bars
from tickframe.operators.review import classify, snapshot_metrics
from tickframe.plans import queries
from tickframe.schema import TRADES
from tickframe.sources.trades import read_trades
from tickframe.streaming.approvals import resolved, stream_approvals
from tickframe.streaming.bars import completed_bars, late_trades, stream_dollar_bars
from tickframe.streaming.candles import stream_candles
from tickframe.streaming.decisions import decision_log, stream_decisions


def test_streamed_bars_equal_batch(spark, tmp_path):
    rng, rows = random.Random(5), []
    for i in range(300):
        price = Decimal(rng.randrange(90, 110))
        rows.append((rng.choice("ab"), START + timedelta(seconds=i // 2), i, price, Decimal(rng.randrange(0, 4))))
    for part in range(3):  # one file, and one micro-batch, per hundred trades
        spark.createDataFrame(rows[100 * part:100 * part + 100], TRADES).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "trades"))
        if part == 1:  # a trade older than what was applied already
            spark.createDataFrame([("a", START, -1, Decimal(1), Decimal(1))], TRADES).coalesce(1).write.mode(
                "append").parquet(str(tmp_path / "trades"))
        feed = spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "trades"))
        query = stream_dollar_bars(feed, 1000, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        query.awaitTermination()
    columns = ["symbol", "bar_seq", "bar_start_ts", "bar_end_ts", "open", "high", "low", "close", "volume",
               "dollar_volume", "num_ticks"]
    batch = dollar_bars(spark.createDataFrame(rows, TRADES), 1000, include_partial=False).select(columns)
    streamed = completed_bars(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert [r.seq for r in late_trades(spark, str(tmp_path / "out")).collect()] == [-1]


def test_streamed_candles_are_stored_once(spark, tmp_path):
    schema = "symbol string, timeframe string, timestamp timestamp, open decimal(20,8), high decimal(20,8), " \
             "low decimal(20,8), close decimal(20,8), volume decimal(20,8), ingest_seq long"
    one = Decimal(1)
    rows = [("s", "15m", START + timedelta(minutes=15 * (i % 6)), one, one, one, one, one, i) for i in range(10)]
    for part in (rows[:6], rows[6:]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "landed"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "landed"))
        stream_candles(feed, str(tmp_path / "table"), str(tmp_path / "checkpoint")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 6


def test_streamed_approvals(spark, tmp_path):
    def at(s): return START + timedelta(seconds=s)
    sent, answered = "signal_id long, sent_at timestamp", "signal_id long, responded_at timestamp, response string"
    # The last signal and response only move the watermarks past the waits before them.
    spark.createDataFrame([(1, at(0)), (2, at(1)), (3, at(2)), (9, at(1000))], sent).coalesce(1).write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([(1, at(5), "cancel"), (1, at(9), "approve"), (2, at(95), "approve"), (9, at(1001), "approve")],
                          answered).coalesce(1).write.parquet(str(tmp_path / "r"))
    query = stream_approvals(spark.readStream.schema(sent).parquet(str(tmp_path / "s")),
                             spark.readStream.schema(answered).parquet(str(tmp_path / "r")),
                             str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    got = {r.signal_id: r.decision for r in resolved(spark, str(tmp_path / "out")).collect()}
    assert got == {1: "cancel", 2: "timeout", 3: "timeout", 9: "approve"}


def test_decision_log_over_batches(spark, tmp_path):
    schema = "signal_id long, symbol string, direction string, confidence decimal(6,4), position_size decimal(20,8), " \
             "approved boolean, timed_out boolean, latency_seconds double, at timestamp"
    rng = random.Random(3)
    rows = [(i, "s", "long", Decimal("0.8"), Decimal(1), rng.random() < 0.6, rng.random() < 0.2, 3.0,
             START + timedelta(hours=5 * i)) for i in range(60)]
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_decisions(feed, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    whole = {r.signal_id: (r["mean"], r.escalate) for r in
             snapshot_metrics(classify(spark.createDataFrame(rows, schema))).collect()}
    logged = {r.signal_id: (r.historical_override_rate, r.escalation_flag) for r in
              decision_log(spark, str(tmp_path / "log")).collect()}
    assert logged == whole and len(logged) == 60


def test_every_delivery_is_landed_in_parallel_and_is_one_micro_batch(spark, tmp_path, monkeypatch):
    events = "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "scratch_path", lambda _, label: str(tmp_path / label))
    monkeypatch.setattr(queries, "read_trades", lambda s, d: read_trades(s, d).repartition(4))
    got = queries.run("streamed_bars_restarted", spark, events).filter("kind = 'bar'")
    wanted = dollar_bars(read_trades(spark, events), queries.THRESHOLD, include_partial=False)
    assert sorted((r.symbol, r.number, r.ticks) for r in got.collect()) == sorted((r.symbol, r.bar_seq, r.num_ticks) for r in wanted.collect())
    assert len(glob(str(tmp_path / "stream-feed/landed/*.parquet"))) > 7  # six when each delivery was written by one task
    assert len(glob(str(tmp_path / "stream-feed/out/bars/batch=*"))) == 6
