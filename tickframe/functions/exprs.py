"""Column expressions shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def dollar_volume(price="price", amount="amount") -> Column:
    """Exact decimal product."""
    return _c(price) * _c(amount)


def time_order(ts="ts", seq="seq") -> Column:
    """(ts, seq) as one number, so that min_by and max_by stay hash aggregates; seq is not negative."""
    micros = F.unix_micros(_c(ts)).cast("decimal(18,0)")
    return micros * F.lit(Decimal(10 ** 19)) + _c(seq).cast("decimal(19,0)")


def oriented_return(start, end, side) -> Column:
    """Simple (not log) return in the direction of the bet."""
    return (_c(end) / _c(start) - 1) * _c(side)


def passes_target(target="trgt", min_ret: float = 0.0) -> Column:
    """Strict ``target > min_ret``; NULL and NaN never pass (Spark sorts NaN above every number)."""
    t = _c(target)
    return t.isNotNull() & ~F.isnan(t) & (t > min_ret)


def sign_label(column) -> Column:
    return F.signum(_c(column)).cast("byte")


def half_up(column, digits: int) -> Column:
    """Round half away from zero, e.g. RSI and reward/risk at 2 digits."""
    return F.round(_c(column), digits)


def half_even(column, digits: int) -> Column:
    """Round half to even, e.g. position size at 8 and risk amount at 2 digits."""
    return F.bround(_c(column), digits)


def rounded_vol(column) -> Column:
    return F.round(_c(column), 8).cast("decimal(18,8)")


def day_key(column) -> Column:
    """UTC calendar day (the session zone is UTC)."""
    return F.to_date(_c(column))


def symbol_key(column="symbol") -> Column:
    """'btc/usd' -> 'BTC_USD'."""
    return F.upper(F.replace(_c(column), F.lit("/"), F.lit("_")))


def threshold_key(column) -> Column:
    """500000.99 -> 'thr_500000': truncating, so the catalog keeps the exact threshold as well."""
    return F.concat(F.lit("thr_"), _c(column).cast("bigint").cast("string"))


def direction_rule(column="direction") -> Column:
    return F.coalesce(_c(column).isin("long", "short"), F.lit(False))


def unit_interval_rule(column) -> Column:
    return F.coalesce(_c(column).between(0, 1), F.lit(False))
