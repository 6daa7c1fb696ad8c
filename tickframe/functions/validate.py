"""One way of checking rows: fail the job, or split good rows from bad ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)) for name, condition in rules.items()
    ]))


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Fail the job with the names of the broken rules on the first bad row read."""
    names = list(df.columns)
    checked = df.withColumn("_broken", _broken(rules)).withColumn(
        "_broken",
        F.when(F.size("_broken") > 0, F.raise_error(
            F.concat(F.lit("invalid row, broken rules: "), F.array_join("_broken", ", "))
        ).cast("boolean")).otherwise(F.lit(True)),
    )
    return checked.filter("_broken").select(*names)


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``broken_rules``)."""
    marked = df.withColumn("broken_rules", _broken(rules))
    return (
        marked.filter(F.size("broken_rules") == 0).drop("broken_rules"),
        marked.filter(F.size("broken_rules") > 0),
    )
