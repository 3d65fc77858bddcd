"""The library in SQL: bar panels, the research panel and feature families as temporary views.

    register(spark, folder, families=["momentum"])
    spark.sql("SELECT * FROM feat_momentum JOIN bars_daily USING (bar_time, instrument_id)")

A view is a plan, not data: a query over it is optimised as a whole, and views that no query names cost nothing.  Rolling values
with a parameter, as exponentially weighted means, are called by the table function ``ewm``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions import features
from ..sources import bars as B
from . import research

#: Families that need sessions of several bars use hourly bars, the others daily ones.
HOURLY = frozenset({"eod_reversal", "same_slot_intraday_memory", "overnight_intraday_tug_of_war", "weak_tape_overnight_gap", "daily_moving_average"})


@udtf(returnType="instrument_id string, bar_time timestamp_ntz, value double, ewm double")
class Ewm:
    """Exponentially weighted mean of one instrument's rows in order of time: PARTITION BY and ORDER BY come from the caller.

    One row and three numbers are held at a time.  Arguments: instrument_id, bar_time, value, half-life.
    """

    def __init__(self):
        self.mean, self.gap, self.seen = None, 0, 0

    def eval(self, row, halflife):
        alpha, x = 1 - 0.5 ** (1 / float(halflife)), row["value"]
        if x is None or x != x:
            self.gap += 1
        else:
            past = (1 - alpha) ** (self.gap + 1)
            self.mean = x if self.mean is None else (past * self.mean + alpha * x) / (past + alpha)
            self.gap, self.seen = 0, self.seen + 1
        yield row["instrument_id"], row["bar_time"], x, self.mean if self.seen >= halflife else None


def register(spark: SparkSession, folder: str, families: list[str] | None = None) -> list[str]:
    """Creates views of the folder's bars (bars_daily, bars_hourly, bars_weekly), the panel and feat_<family>; their names."""
    unknown = sorted(set(families or ()) - set(features.NAMES))
    if unknown:
        raise ValueError(f"unknown families: {unknown}")
    daily, hourly = B.executable(B.daily()), B.executable(B.hourly())
    plans = {"bars_daily": daily, "bars_hourly": hourly, "bars_weekly": research.weekly(), "research_panel": research.panel()}
    plans |= {f"feat_{n}": features.plan(hourly if n in HOURLY else daily, n) for n in (features.NAMES if families is None else families)}
    for name, plan in plans.items():
        plan.over(spark, folder).createOrReplaceTempView(name)
    spark.udtf.register("ewm", Ewm)
    return list(plans)
