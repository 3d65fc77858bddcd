"""Registered queries: one for each operator, with the same plan rendered for the comparison engine."""

from __future__ import annotations

from functools import partial

from .functions import comparison as formulas
from .functions import features
from .operators import comparison, independent, registered, registered_gates, research, structures
from .plans.sql import Plan
from .sources import bars

#: Families that need sessions of several bars use hourly bars, the others daily ones.
HOURLY = {"eod_reversal", "same_slot_intraday_memory", "overnight_intraday_tug_of_war", "weak_tape_overnight_gap", "daily_moving_average"}

#: Families of the query that computes several in one plan.
TOGETHER = ("momentum", "conditional_reversal", "regime_conditioned", "event_shock_proxy", "sell_pressure_exhaustion", "lottery_max", "breadth_resilience", "intraday_quality")


def plans() -> dict[str, Plan]:
    daily, hourly = bars.executable(bars.daily()), bars.executable(bars.hourly())
    out = {f"feat_{n}": features.plan(hourly if n in HOURLY else daily, n) for n in features.NAMES}
    out["features_together"] = features.together(daily, TOGETHER)
    return research.plans() | out


def queries() -> dict:
    return {n: partial(research.run, p) for n, p in (plans() | research.whole()).items()} | registered.queries() | structures.queries() | registered_gates.queries() | research.stateful()


def oracle_sql() -> dict[str, str]:
    """SQL of the queries for another engine, written apart from what they run."""
    daily, hourly = bars.executable(bars.daily()), bars.executable(bars.hourly())
    families = formulas.sql({n: hourly if n in HOURLY else daily for n in features.NAMES})
    own = {f"feat_{n}": s for n, s in families.items()} | {"features_together": formulas.together(daily, TOGETHER)}
    return own | independent.sql() | comparison.sql() | structures.sql() | registered_gates.sql()
