"""Column expressions of the operators: ranks with average ties, guarded statistics, bounded scaling.

Nulls: a rank or a statistic is taken over non-null values; a zero denominator and a constant side give NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Tasks that timestamps are dealt to where a cross-section is ordered, so that a task holds the rows of few of them.
SECTIONS = 256


def ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def scaled(x: Column, floor: float, ceiling: float) -> Column:
    """0 at the floor, 1 at the ceiling, linear between."""
    return clipped((x - floor) / (ceiling - floor), 0.0, 1.0)


def six_digits(x: Column) -> Column:
    """A double to six digits: scaled, rounded with halves away from zero, and scaled back, without negative zero.

    F.round rounds the decimal text of the double instead, and so the other way where the scaled double is a half or isn't.
    """
    scaled_up = F.abs(x) * 1e6
    whole = F.floor(scaled_up).cast("double")
    whole = F.when(scaled_up < 2.0**52, whole + F.when(scaled_up - whole >= 0.5, 1.0).otherwise(0.0)).otherwise(scaled_up) / 1e6
    return F.when(scaled_up < float("inf"), F.when(x < 0, -whole).otherwise(whole)).otherwise(x) + 0.0


def average_rank(x: str, *part: str, descending: bool = False) -> Column:
    """Rank of a non-null value within its partition; ties share the mean of their places."""
    own = Window.partitionBy(*part, F.col(x).isNull())
    order = F.col(x).desc() if descending else F.col(x).asc()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*part, x))
    return F.when(F.col(x).isNotNull(), F.rank().over(own.orderBy(order)) + (ties - 1) / 2.0)


def percent_rank(x: str, *part: str, descending: bool = False) -> Column:
    return average_rank(x, *part, descending=descending) / F.count(x).over(Window.partitionBy(*part))


def across(df: DataFrame, x: str, time: str, rank: str | None = None, z: str | None = None, nulls_first: bool = False, turn: int = 0) -> DataFrame:
    """Adds the percentile rank of x among its timestamp's values (as percent_rank), or its z-score.

    All of it comes from one sort and one window.  With ``nulls_first`` nulls are ranked too, below all values.  Calls whose
    ``turn`` alternates between 0 and 1 each get a stage of their own, so that a task doesn't hold the sorts of all of them:
    Spark leaves a shuffle out if its rows already lie by the same list of keys, which the repeated key keeps apart.  Timestamps
    are dealt to SECTIONS tasks, whatever the session's number.
    """
    by = Window.partitionBy(time).orderBy(F.col(x).asc_nulls_first() if nulls_first else F.col(x).asc_nulls_last())
    ties, whole = by.rangeBetween(Window.currentRow, Window.currentRow), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = {}
    if rank:
        value = (F.rank().over(by) + (F.count(F.lit(1)).over(ties) - 1) / 2.0) / F.count(x).over(whole)
        out[rank] = value if nulls_first else F.when(F.col(x).isNotNull(), value)
    if z:
        out[z] = ratio(F.col(x) - F.avg(x).over(whole), F.stddev_pop(x).over(whole))
    return df.repartition(SECTIONS, *[time] * (1 + turn % 2)).withColumns(out)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson over rows with both values; NULL below two rows or where a side is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (spread > 1e-14), F.covar_pop(a, b) / spread)


def rolling(agg, x: Column, by: list[str], time: str, size: int, lag: int = 0, least: int | None = None) -> Column:
    """agg of the ``size`` rows that end ``lag`` rows ago, where at least ``least`` (all) of them have a value."""
    w = Window.partitionBy(*by).orderBy(time).rowsBetween(-(size - 1 + lag), -lag)
    return F.when(F.count(x).over(w) >= (size if least is None else least), agg(x).over(w))


def total_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def boolean_text(x: Column) -> Column:
    """False for 0, false, no, n, off and empty text (any case, outer spaces ignored), NULL for NULL, else true."""
    return ~F.lower(F.trim(x)).isin("0", "false", "no", "n", "off", "")
