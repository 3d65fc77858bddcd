"""Reports on executions, by run: constraint counters, event reasons with capacity totals, trade metrics.

Executions have a row for each bar and name that was to be traded; a constraint column that is missing counts as tradable, not
limited and without target.  A run without trades has zero totals; a run without equity has turnover 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio

#: Reasons that come from capacity.  fixed values
CAPACITY = ("capacity_capped", "capacity_zero")
COSTS = ("commission", "stamp_tax", "slippage_cost")


def constraint_counts(executions: DataFrame, *by: str) -> DataFrame:
    """Eight counters of rows by state, and of rows with a positive target among them."""
    def flag(name: str, missing: bool) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in executions.columns else F.lit(missing)

    target = F.coalesce(F.expr("try_cast(target_weight AS double)") > 0, F.lit(False)) if "target_weight" in executions.columns else F.lit(False)
    states = {"non_tradable": ~flag("tradable_bar", True), "limit_up_open": flag("limit_up_open", False), "limit_down_open": flag("limit_down_open", False)}
    counts = {"execution_row_count": F.count("*"), **{f"{n}_row_count": F.count_if(c) for n, c in states.items()}, "positive_target_row_count": F.count_if(target)}
    counts |= {f"positive_target_{n}_row_count": F.count_if(target & c) for n, c in states.items()}
    return executions.groupBy(*by).agg(*(c.alias(n) for n, c in counts.items()))


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    """Rows (by, reason, n) of events that have a reason."""
    return events.where("reason IS NOT NULL").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def capacity_totals(events: DataFrame, *by: str) -> DataFrame:
    """Desired, executable and unfilled shares and notional of events that capacity limited."""
    desired, can, price = (F.coalesce(F.abs(F.col(c)), F.lit(0)) for c in ("desired_shares", "executable_shares", "reference_price"))
    left = F.greatest(desired - can, F.lit(0))
    sums = {f"capacity_{n}_{u}": F.sum(x * (price if u == "notional" else 1)) for u in ("shares", "notional") for n, x in (("desired", desired), ("executable", can), ("unfilled", left))}
    rows = events.where(F.col("reason").isin(*CAPACITY))
    return rows.groupBy(*by).agg(F.count("*").alias("capacity_limited_event_count"), *(s.cast("long" if n.endswith("shares") else "double").alias(n) for n, s in sums.items()))


def trade_metrics(trades: DataFrame, equity: DataFrame, *by: str) -> DataFrame:
    """Notional by side, costs and turnover over mean equity, for every run that has equity or trades."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("notional"))), F.lit(0.0))
    costs = [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"total_{c}") if c in trades.columns else F.lit(0.0).alias(f"total_{c}") for c in COSTS]
    traded = trades.groupBy(*by).agg(F.count("*").alias("trade_count"), side("buy").alias("buy_notional"), side("sell").alias("sell_notional"), F.coalesce(F.sum("notional"), F.lit(0.0)).alias("gross_traded_notional"), *costs)
    held = equity.groupBy(*by).agg(F.avg("equity").alias("average_equity"))
    out = (held.join(traded, list(by), "full") if by else held.crossJoin(traded)).fillna(0)
    return out.withColumns({"total_transaction_cost": sum((F.col(f"total_{c}") for c in COSTS), F.lit(0.0)), "gross_turnover": F.coalesce(ratio(F.col("gross_traded_notional"), F.col("average_equity")), F.lit(0.0))})


def execution_diagnostics(executions: DataFrame, trades: DataFrame, equity: DataFrame, events: DataFrame | None = None, *, by: tuple[str, ...]) -> DataFrame:
    """One row for each run that has executions: counters, trade metrics, and capacity totals if there are events."""
    keys = list(by)
    out = constraint_counts(executions, *by).join(trade_metrics(trades, equity, *by), keys, "left")
    if events is not None:
        out = out.join(capacity_totals(events, *by), keys, "left")
    return out.fillna(0)
