"""The risk gate: one ordered decision per signal."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.functions.exprs import half_even

# Risk constants (fixed values).
MAX_RISK_PER_TRADE = Decimal("0.01")
MAX_OPEN_POSITIONS = 3
DAILY_LOSS_LIMIT = 0.05
MIN_REWARD_RISK = Decimal("1.5")

# Rejection reasons (fixed values).
KILL_SWITCH = "kill_switch_active"
MAX_POSITIONS = "max_positions_reached"
RISK_TOO_HIGH = "risk_too_high"  # part of the vocabulary; no rule produces it
INVALID_RISK_REWARD = "invalid_risk_reward"
INSUFFICIENT_CAPITAL = "insufficient_capital"
INVALID_SIGNAL = "invalid_signal"


@dataclass(frozen=True)
class SystemState:
    total_capital: Decimal
    available_capital: Decimal
    open_positions: int = 0
    daily_pnl_pct: float = 0.0
    kill_switch_active: bool = False


def with_state(df: DataFrame, state: SystemState) -> DataFrame:
    """Add the account state as constant columns; join a keyed state table instead if there is one."""
    return df.withColumns({
        "total_capital": F.lit(state.total_capital).cast("decimal(20,8)"),
        "available_capital": F.lit(state.available_capital).cast("decimal(20,8)"),
        "open_positions": F.lit(state.open_positions).cast("long"),
        "daily_pnl_pct": F.lit(state.daily_pnl_pct).cast("double"),
        "kill_switch_active": F.lit(state.kill_switch_active),
    })


def kill_switch_due(daily_pnl_pct="daily_pnl_pct") -> Column:
    """True once the daily loss limit is reached."""
    return F.col(daily_pnl_pct) <= -DAILY_LOSS_LIMIT


def gate_view(signals: DataFrame) -> DataFrame:
    """The columns the gate looks at."""
    return signals.select("entry_price", "stop_loss", "take_profit", "direction")


def _absent(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == 0)


def _money(column: Column, digits: int = 2) -> Column:
    return half_even(column, digits).cast(f"decimal(38,{digits})").cast("string")


def validate(signals: DataFrame) -> DataFrame:
    """Add approved, position_size, risk_amount, rejection_reason and rejection_message.

    ``signals``: entry_price, stop_loss, take_profit, direction and the SystemState columns. The
    first rule that applies decides; a zero price counts as missing.
    """
    entry, stop, target = F.col("entry_price"), F.col("stop_loss"), F.col("take_profit")
    risk = F.abs(entry - stop)
    ratio = F.try_divide(F.abs(target - entry), risk)
    amount = F.col("total_capital") * F.lit(MAX_RISK_PER_TRADE)
    size = F.try_divide(amount, risk)
    needed = size * entry
    # Compared without a division, so that no digit is lost at the edge.
    beyond = F.coalesce(
        amount.try_cast("decimal(19,4)") * entry.try_cast("decimal(18,8)")
        > F.col("available_capital").try_cast("decimal(19,4)") * risk.try_cast("decimal(18,8)"),
        needed > F.col("available_capital"))
    missing = _absent("entry_price") | _absent("stop_loss") | _absent("take_profit") | \
        F.col("direction").isNull() | (F.col("direction") == "")
    percent = lambda c: F.format_string("%.1f%%", c * 100)
    # Message texts (fixed values).
    rules = [
        (F.col("kill_switch_active"), KILL_SWITCH,
         F.lit("System kill switch is active. Manual reset required.")),
        (kill_switch_due(), KILL_SWITCH,
         F.concat(F.lit("Daily drawdown limit reached: "), percent(F.col("daily_pnl_pct")),
                  F.lit(". Limit is "), percent(F.lit(DAILY_LOSS_LIMIT)), F.lit("."))),
        (F.col("open_positions") >= MAX_OPEN_POSITIONS, MAX_POSITIONS,
         F.concat(F.lit("Maximum concurrent positions reached: "), F.col("open_positions").cast("string"),
                  F.lit(f"/{MAX_OPEN_POSITIONS}."))),
        (missing, INVALID_SIGNAL, F.lit("Signal is missing required fields.")),
        (risk == 0, INVALID_SIGNAL, F.lit("Entry price equals stop loss — invalid signal.")),
        (ratio < MIN_REWARD_RISK, INVALID_RISK_REWARD,
         F.concat(F.lit("Risk/reward ratio "), _money(ratio), F.lit(f" is below minimum {MIN_REWARD_RISK}."))),
        (beyond, INSUFFICIENT_CAPITAL,
         F.concat(F.lit("Required capital $"), _money(needed), F.lit(" exceeds available $"),
                  _money(F.col("available_capital")), F.lit("."))),
    ]
    reason, message = F.lit(None).cast("string"), F.lit(None).cast("string")
    for condition, name, text in reversed(rules):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
        message = F.when(condition, text).otherwise(message)
    return (
        signals.withColumn("rejection_reason", reason).withColumn("rejection_message", message)
        .withColumn("approved", F.col("rejection_reason").isNull())
        .withColumn("position_size", F.when(F.col("approved"), half_even(size, 8)).cast("decimal(28,8)"))
        .withColumn("risk_amount", F.when(F.col("approved"), half_even(amount, 2)).cast("decimal(28,2)"))
    )
