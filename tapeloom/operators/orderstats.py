"""Quantiles of all earlier values of a series, exact, in n log n.

Values get their places in the order of values once.  The k-th smallest value before a time is then found from the highest
digit of its place to the lowest: within the places that share the digits known so far, running counts in order of time say
how many earlier values have each next digit, so they say which digit the k-th has.  Each digit (base 16) is one sort by
(known digits, time) of the values and the questions together; no row looks at more than its own counts.

For series with one row for each time; equal values have places in order of time, nulls are no values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 4


def expanding_quantile(rows: DataFrame, x: str, q: float, least: int, time: str = "bar_time") -> DataFrame:
    """Adds ``quantile`` of all values before each row, interpolated between neighbours; null below ``least`` (1 or more) values."""
    if not 0 <= q <= 1 or least < 1:
        raise ValueError("a quantile lies in [0, 1] and needs a value")
    value = F.when(~F.isnan(F.col(x).cast("double")), F.col(x).cast("double"))
    series = rows.select(F.col(time).alias("t"), value.alias("v"))
    n = series.agg(F.count("v")).first()[0]
    digits = max(1, -(-max(n - 1, 1).bit_length() // BITS))
    places = series.where("v IS NOT NULL").select("t", "v", (F.row_number().over(Window.orderBy("v", "t")) - 1).cast("long").alias("place"))
    seen = F.count("v").over(Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    asked = series.select("t", (F.lit(q) * (F.when(seen >= least, seen) - 1)).alias("at")).where("at IS NOT NULL").withColumn("share", F.col("at") - F.floor("at"))
    ends = F.array(F.struct(F.lit(0).alias("end"), F.floor("at").alias("k")), F.struct(F.lit(1).alias("end"), F.ceil("at").alias("k")))
    open_ = asked.select("t", "share", F.explode(ends).alias("e")).select("t", "share", "e.end", "e.k", F.lit(0).cast("long").alias("known"))
    for level in range(digits - 1, -1, -1):
        held = places.select("t", F.shiftright("place", BITS * (level + 1)).alias("known"), F.shiftright("place", BITS * level).bitwiseAND((1 << BITS) - 1).alias("digit"), F.lit(1).alias("kind"))
        both = open_.withColumn("kind", F.lit(0)).unionByName(held, allowMissingColumns=True)
        w = Window.partitionBy("known").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # questions come before values of their time
        upto = both.withColumn("upto", F.array(*(F.count_if(F.col("digit") <= d).over(w) for d in range(1 << BITS)))).where("kind = 0")
        digit = F.size(F.filter("upto", lambda c: c <= F.col("k")))
        open_ = upto.withColumn("d", digit).select("t", "share", "end", (F.col("k") - F.when(F.col("d") > 0, F.element_at("upto", F.greatest(F.col("d"), F.lit(1)))).otherwise(0)).alias("k"), (F.col("known") * (1 << BITS) + F.col("d")).alias("known"))
    found = open_.join(places.select("place", "v"), F.col("known") == F.col("place"))
    end = lambda i: F.max(F.when(F.col("end") == i, F.col("v")))
    out = found.groupBy(F.col("t").alias(time)).agg((end(0) + (end(1) - end(0)) * F.max("share")).alias("quantile"))
    return rows.join(out, time, "left")


def daily_switch(states: DataFrame, x: str, q: float, least: int, above: bool = True, time: str = "bar_time") -> DataFrame:
    """Rows (day, state, lagged, quantile, active): yesterday's mean state against the quantile of all days before today.

    A day's state is the mean over its timestamps of the mean over a timestamp's rows; active where yesterday's is at or above
    (or at or below) the quantile, and never while fewer than ``least`` days are known.
    """
    each = states.groupBy(time).agg(F.avg(x).alias("s"))
    days = each.groupBy(F.to_date(time).alias("day")).agg(F.round(F.avg("s"), 12).alias("state"))
    out = expanding_quantile(days.withColumn("lagged", F.lag("state").over(Window.orderBy("day"))), "state", q, least, "day")
    hit = F.col("lagged") >= F.col("quantile") if above else F.col("lagged") <= F.col("quantile")
    return out.withColumn("active", F.coalesce(hit, F.lit(False)))
