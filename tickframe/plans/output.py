"""Comparable result columns: one spec drives both the Spark frame and the check SQL.

A spec is "name:kind ..." with kind s string, i integer, f float (6 decimals), e float (8 decimals), t timestamp
(microseconds since the epoch), b boolean (0/1). NULL becomes '', -1 or 0, and the text column ``nulls`` tells which of
the columns, in the spec's order, were NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPARK = {
    "s": lambda c: F.coalesce(c.cast("string"), F.lit("")),
    "i": lambda c: F.coalesce(c.cast("long"), F.lit(-1).cast("long")),
    "f": lambda c: F.coalesce(F.round(c.cast("double"), 6), F.lit(-1.0)) + F.lit(0.0),
    "e": lambda c: F.coalesce(F.round(c.cast("double"), 8), F.lit(-1.0)) + F.lit(0.0),
    "t": lambda c: F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(-1).cast("long")),
    "b": lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long")),
}
_SQL = {
    "s": "coalesce(CAST({c} AS VARCHAR), '')",
    "i": "CAST(coalesce({c}, -1) AS BIGINT)",
    "f": "coalesce(round(CAST({c} AS DOUBLE), 6), -1.0) + CAST(0.0 AS DOUBLE)",
    "e": "coalesce(round(CAST({c} AS DOUBLE), 8), -1.0) + CAST(0.0 AS DOUBLE)",
    "t": "CAST(coalesce(epoch_us({c}), -1) AS BIGINT)",
    "b": "CAST(coalesce({c}, false) AS BIGINT)",
}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def shown(df: DataFrame, spec: str) -> DataFrame:
    flags = [F.when(F.col(name).isNull(), "1").otherwise("0") for name, _ in _columns(spec)]
    return df.select(*[_SPARK[kind](F.col(name)).alias(name) for name, kind in _columns(spec)], F.concat(*flags).alias("nulls"))


def shown_sql(body: str, spec: str) -> str:
    """``body`` is a WITH list that ends in a table named ``result``."""
    columns = ", ".join(f"{_SQL[kind].format(c=name)} AS {name}" for name, kind in _columns(spec))
    flags = " || ".join(f"CASE WHEN result.{name} IS NULL THEN '1' ELSE '0' END" for name, _ in _columns(spec))
    return f"WITH RECURSIVE {body}\nSELECT {columns}, {flags} AS nulls FROM result"
