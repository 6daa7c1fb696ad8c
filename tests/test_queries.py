"""The registered queries against their check SQL at the smallest scale (the driver checks all at sf0.01)."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as contract
from tickframe.operators.folds import purged_kfold
from tickframe.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
FAST = ["trades", "dollar_bars", "labels", "candle_range", "candle_upsert", "seed_report", "risk_validation",
        "reviewer_sessions", "approvals", "pending_ideas", "batch_sums", "storage_keys", "purged_kfold"]


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_equals_check(spark, tables, name):
    frame = contract.queries()[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    got = sorted(tuple(r[c] for c in columns) for r in frame.collect())
    answer = tables.execute(contract.oracle_sql()[name])
    at = [d[0] for d in answer.description]
    assert sorted(at) == columns
    assert got == sorted(tuple(row[at.index(c)] for c in columns) for row in answer.fetchall())


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries()) >= set(QUERIES)


def test_large_joins_are_keyed(spark, closes_frame, spans_frame):
    """No nested loop or cartesian plan in the fold operator, whatever the sizes."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        folds = purged_kfold(spans_frame([(i, i + 2) for i in range(20)]), closes_frame(range(1, 40)), 4, 0.1)
        plan = folds._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "BroadcastHashJoin" not in plan


def test_entry_works_without_the_text_operators(tmp_path):
    """Without tickframe/llm and tests/llm the contract still imports and its queries run, corpus_pipeline.py or not."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "tickframe"), tmp_path / "tickframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(root, name)):
            shutil.copy(os.path.join(root, name), tmp_path)
    code = (f"import __spark_entry__ as c; from tickframe.session import local_session; s = local_session('2', 2)\n"
            f"assert len(c.queries()['storage_keys'](s, '{SF_DIR}').collect()) > 0 and c.oracle_sql()\n"
            f"assert not any(n.startswith('op') or n == 'pipeline' for n in c.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=300, env={**os.environ, "PYTHONPATH": str(tmp_path)})
