"""Shared pieces of the text operators: saved intermediates, joins that bear hot keys, batches from Arrow."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.session import scratch_path

#: ASCII white space as a class for Java and Python patterns; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
#: A key is hot when it has more than this share of all rows, so there are fewer than 1/HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: Spark's setting that removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _shuffles_end(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared scratch folder and read it back: the plan ends here, its shuffle files go, and lost
    executors cost nothing of what came before."""
    path = scratch_path(df.sparkSession, label)
    with _shuffles_end(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def released(*steps: DataFrame) -> None:
    """Delete the files of saved steps that no frame reads any more, as all that was made from them is saved itself."""
    for step in steps:
        path = step.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(step))
        path.getFileSystem(step.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def join_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """Join per-key facts to many rows. ``weight`` is the number of rows with that key and ``total`` of all rows.
    Hot keys, fewer than 1/HOT_SHARE by their definition, are broadcast; the rest is shuffled."""
    hot = facts.filter(F.col(weight) > HOT_SHARE * total).drop(weight)
    cold = facts.filter(F.col(weight) <= HOT_SHARE * total).drop(weight)
    marks = hot.select(key)
    rest = rows.join(F.broadcast(marks), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(
        rest.join(cold, key, how), allowMissingColumns=False)


def batches(source: Iterator[pa.RecordBatch], max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that none holds much more than ``max_bytes``, one row at least."""
    for batch in source:
        step = max(1, batch.num_rows * max_bytes // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
