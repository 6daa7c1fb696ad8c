import statistics
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from conftest import START
from pyspark.sql import functions as F

from tickframe.functions.validate import quarantine, require
from tickframe.operators.ideas import (
    idea_rules, mark_consumed, new_ideas, pending_ideas, read_consumed, read_ideas, submit_ideas, with_consumption,
)
from tickframe.operators.review import (
    classify, daily_override_rates, drift, resolve_approvals, rolling_override_rate, session_override_rate,
    snapshot_metrics,
)

HISTORY = "signal_id long, at timestamp, decided_at timestamp, is_override boolean"


def history(seed=1, n=250):
    rng, at, rows = np.random.default_rng(seed), START, []
    for i in range(n):
        at = (at + timedelta(hours=float(rng.exponential(14 if i % 7 else 0.3)))).replace(microsecond=0)
        rows.append((i, at, None if rng.random() < 0.2 else at, bool(rng.random() < (0.2 if i < n * 0.8 else 0.9))))
    return rows


def as_of(rows, now):
    kept = [(d, o) for _, _, d, o in rows if d is not None and now - timedelta(days=90) <= d < now]
    recent = [o for d, o in kept if d >= now - timedelta(hours=24)]
    rate, mean, sigma, z = (sum(recent) / len(recent) if recent else 0.0), 0.0, 0.0, None
    if len(kept) >= 10:
        days = {}
        for d, o in kept:
            days.setdefault(d.date(), []).append(o)
        rates = [sum(v) / len(v) for v in days.values()]
        mean, sigma = statistics.mean(rates), statistics.stdev(rates) if len(rates) > 1 else 0.0
        mean, sigma = round(mean, 4), round(sigma, 4)
        z = (rate - mean) / sigma if sigma else None
    return len(kept), rate, mean, sigma, z, z is not None and z > 2


def close(got, want):
    # A fifth decimal of exactly 5 may round either way.
    return all(a == b if a is None or b is None else abs(a - b) <= tol
               for a, b, tol in zip(got, want, (0, 1e-9, 1.01e-4, 1.01e-4, 1e-2)))


@pytest.mark.parametrize("chunk_rows", [16, None])
def test_snapshots_equal_brute_force(spark, chunk_rows):
    rows = history()
    got = snapshot_metrics(spark.createDataFrame(rows, HISTORY), chunk_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        want = as_of(rows, r.at)
        assert close((r.history_rows, r.override_rate, r["mean"], r.stddev, r.z_score), want[:5]), (r, want)
    assert any(r.escalate for r in got)
    rolling = {r.signal_id: r.override_rate for r in
               rolling_override_rate(spark.createDataFrame(rows, HISTORY), chunk_rows=chunk_rows).collect()}
    assert all(abs(rolling[r.signal_id] - r.override_rate) < 1e-12 for r in got)


def test_drift_as_of_now(spark):
    rows = [r for r in history() if r[1] < datetime(2024, 4, 20)]
    frame, now = spark.createDataFrame(rows, HISTORY), datetime(2024, 4, 20)
    r = drift(frame, now).first()
    assert close((r.history_rows, r.override_rate, r["mean"], r.stddev, r.z_score), as_of(rows, now)[:5])
    assert daily_override_rates(frame.limit(5), now).count() == 0
    assert session_override_rate(frame, datetime(2030, 1, 1)).first()[0] == 0
    empty = drift(frame.limit(0), now).first()
    assert (empty.history_rows, empty["mean"], empty.z_score, empty.escalate) == (0, 0, None, False)


def test_classification(spark):
    rows = [(1, "s", "long", Decimal("0.75"), True, False, 12.4), (2, "s", "long", Decimal("0.70"), False, False, 44.1),
            (3, "s", "long", Decimal("0.62"), False, False, 1.23456), (4, "s", "long", Decimal("0.75"), False, True, 90.0)]
    frame = spark.createDataFrame(
        [(*r[:4], Decimal("0.1"), *r[4:], START) for r in rows],
        "signal_id long, symbol string, direction string, confidence decimal(6,4), position_size decimal(20,8), "
        "approved boolean, timed_out boolean, latency_seconds double, at timestamp")
    got = {r.signal_id: r for r in classify(frame).collect()}
    assert [got[i].decision for i in range(1, 5)] == ["approve", "cancel", "cancel", "timeout"]
    assert [got[i].is_override for i in range(1, 5)] == [False, True, False, True]
    assert got[4].decided_at is None and got[1].decided_at == START
    assert got[1].sent_at == START - timedelta(seconds=12.4)
    assert got[3].decision_latency_seconds == Decimal("1.235")


def test_approval_resolution(spark):
    signals = spark.createDataFrame([(i, START) for i in range(1, 6)], "signal_id long, sent_at timestamp")
    def at(s): return START + timedelta(seconds=s)
    responses = spark.createDataFrame([
        (1, at(20), "cancel"), (1, at(10), "approve"), (2, at(90), "approve"), (3, at(-1), "approve"),
        (3, at(89.999), "cancel"), (4, at(5), "later"), (9, at(1), "approve")],
        "signal_id long, responded_at timestamp, response string")
    got = {r.signal_id: r.decision for r in resolve_approvals(signals, responses).collect()}
    assert got == {1: "approve", 2: "timeout", 3: "cancel", 4: "timeout", 5: "timeout"}


def test_ideas(spark, tmp_path):
    submitted = spark.createDataFrame([("BTC/USD", "long", Decimal("0.8")), ("ETH/USD", "short", Decimal("0.1"))],
                                      "symbol string, direction string, conviction decimal(4,3)")
    path, log = str(tmp_path / "ideas"), str(tmp_path / "log")
    assert read_ideas(spark, path).count() == 0
    submit_ideas(submitted, path)
    stored = read_ideas(spark, path)
    assert {r.provenance for r in stored.collect()} == {"human"}
    assert pending_ideas(stored, read_consumed(spark, log)).count() == 2
    assert pending_ideas(stored, read_consumed(spark, log), "BTC/USD").count() == 1
    mark_consumed(stored.filter("symbol = 'BTC/USD'").select("signal_ref"), log)
    mark_consumed(spark.createDataFrame([("unknown",)], "signal_ref string"), log)
    assert [r.symbol for r in pending_ideas(stored, read_consumed(spark, log)).collect()] == ["ETH/USD"]
    flags = {r.symbol: r.meta_label_consumed for r in with_consumption(stored, read_consumed(spark, log)).collect()}
    assert flags == {"BTC/USD": True, "ETH/USD": False}


def test_validation_modes(spark):
    frame = spark.createDataFrame([("long", 0.5), ("up", 0.5), (None, 1.5)], "direction string, conviction double")
    good, bad = quarantine(frame, idea_rules())
    assert good.count() == 1
    assert sorted(r.broken_rules for r in bad.collect()) == [["direction"], ["direction", "conviction"]]
    with pytest.raises(Exception, match="broken rules: direction"):
        require(frame.limit(2), idea_rules()).collect()
    with pytest.raises(Exception, match="conviction"):
        new_ideas(spark.createDataFrame([("s", "long", 1.01)], "symbol string, direction string, conviction double")).collect()
    assert require(frame.limit(1), {"always": F.lit(True)}).count() == 1
