"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Each query is timed end to end, from reading the tables to the last row, after one small warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tickframe.plans.queries import run
from tickframe.session import local_session

HEADLINE = [
    "dollar_bars", "ewma_vol", "cusum_events", "labels", "meta_labels", "label_weights", "concurrency",
    "average_uniqueness", "return_attribution", "time_decay", "purged_kfold", "purged_spans",
    "combinatorial_folds", "rule_scores", "candles_4h", "candle_range", "candle_upsert", "candle_signals",
    "latest_signals", "risk_validation", "symbol_audit", "reviewer_sessions", "rolling_override_rate",
    "override_drift", "snapshot_metrics", "approvals", "pending_ideas", "streamed_bars", "batch_sums",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores))
    timed(spark, "batch_sums", sf_dir)
    seconds = {name: timed(spark, name, sf_dir) for name in (sys.argv[1:] or HEADLINE)}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
