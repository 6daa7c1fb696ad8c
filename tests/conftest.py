import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("TZ", "UTC")

from tickframe.session import local_session  # noqa: E402

START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def closes_frame(spark):
    """bars (symbol, bar_seq, bar_end_ts, close) from {symbol: closes} or a list for one symbol."""

    def build(series):
        series = series if isinstance(series, dict) else {"s": series}
        rows = [(s, i, START + timedelta(minutes=15 * i), float(c))
                for s, closes in series.items() for i, c in enumerate(closes)]
        return spark.createDataFrame(rows, "symbol string, bar_seq long, bar_end_ts timestamp, close double")

    return build


@pytest.fixture(scope="session")
def spans_frame(spark):
    """spans (symbol, event_id, t0_seq, t1_seq) from {symbol: pairs} or a list of pairs."""

    def build(spans):
        spans = spans if isinstance(spans, dict) else {"s": spans}
        rows = [(s, i, int(a), int(b)) for s, pairs in spans.items() for i, (a, b) in enumerate(pairs)]
        return spark.createDataFrame(rows, "symbol string, event_id long, t0_seq long, t1_seq long")

    return build
