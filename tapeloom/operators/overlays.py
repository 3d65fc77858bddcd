"""Overlays: a primary score that a satellite score changes, at all times or under a condition.

Scores are tables (bar_time, instrument_id, score).  All rows of the primary stay; a satellite value that is missing is 0 after
ranking.  With ``ranked`` both scores are percentile ranks of their timestamp less a half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import percent_rank
from .relations import unique_rows

KEYS = ["bar_time", "instrument_id"]
MODES = ("blend", "downside_penalty", "entry_exclusion", "optimizer_risk_penalty")


def overlay(
    primary: DataFrame, satellite: DataFrame, weight: float, mode: str = "blend", condition: DataFrame | None = None, ranked: bool = True, anchored: bool = False, sparse: bool = False, quantile: float = 0.2
) -> DataFrame:
    """Rows (bar_time, instrument_id, score) and, by mode, entry_eligible or risk_penalty_bps.

    blend weighs the two scores.  downside_penalty takes off ``weight`` times how far the satellite lies below its quantile of
    the timestamp.  entry_exclusion leaves the score and marks names below the satellite's ``weight`` quantile as not eligible.
    optimizer_risk_penalty leaves the score and gives the weighted depth below the quantile as a penalty.

    ``condition`` (bar_time, active) switches the weight to 0 where it isn't active.  ``anchored`` replaces an active row's
    primary component by that of its name's first bar of the day, where the day's first timestamp has one; ``sparse`` keeps
    each day's first timestamp and the active ones.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if (anchored or sparse) and condition is None:
        raise ValueError("daily anchors and sparse decisions need a condition")
    deep = weight if mode == "entry_exclusion" else quantile
    if mode != "blend" and not (mode == "entry_exclusion" and weight == 0) and not 0 < deep < 1:
        raise ValueError("the quantile lies between 0 and 1")
    rows = primary.select(*KEYS, F.col("score").alias("__p")).join(satellite.select(*KEYS, F.col("score").alias("__s")), KEYS, "left")
    if ranked:
        rows = rows.withColumns({c: percent_rank(c, "bar_time") - 0.5 for c in ("__p", "__s")})
    rows = rows.fillna(0.0, ["__s"])
    active: Column = F.lit(True)
    if condition is not None:
        rows = rows.join(unique_rows(condition, ["bar_time"]).select("bar_time", F.col("active").alias("__on")), "bar_time", "left")
        active = F.coalesce("__on", F.lit(False))
    first = F.min("bar_time").over(Window.partitionBy(F.to_date("bar_time")))
    if anchored or sparse:
        rows = rows.withColumn("__first", first)
    if anchored:
        anchor = F.max(F.when(F.col("bar_time") == F.col("__first"), F.col("__p"))).over(Window.partitionBy(F.to_date("bar_time"), "instrument_id"))
        rows = rows.withColumn("__a", anchor).withColumn("__p", F.when(active, F.coalesce("__a", "__p")).otherwise(F.col("__p")))
    used = F.when(active, F.lit(float(weight))).otherwise(0.0)
    out = [*KEYS, (1 - used) * F.col("__p") + used * F.col("__s") if mode == "blend" else F.col("__p")]
    if mode != "blend":
        limit = F.percentile("__s", F.lit(float(deep))).over(Window.partitionBy("bar_time"))
        rows = rows.withColumn("__depth", F.greatest(limit - F.col("__s"), F.lit(0.0)))
        if mode == "downside_penalty":
            out[2] = F.col("__p") - used * F.col("__depth")
        elif mode == "entry_exclusion":
            out.append((~((used > 0) & (F.col("__depth") > 0))).alias("entry_eligible"))
        else:
            out.append((used * F.col("__depth")).alias("risk_penalty_bps"))
    if sparse:
        rows = rows.where((F.col("bar_time") == F.col("__first")) | active)
    return rows.select(*KEYS, out[2].alias("score"), *out[3:])


def with_penalty(scores: DataFrame, penalties: DataFrame, column: str, fill: float = 0.0) -> DataFrame:
    """Adds optimizer_risk_penalty_bps, not negative, from a table with one row for each key."""
    p = unique_rows(penalties, KEYS).select(*KEYS, F.col(column).cast("double").alias("__v"))
    return scores.drop("optimizer_risk_penalty_bps").join(p, KEYS, "left").withColumn("optimizer_risk_penalty_bps", F.greatest(F.coalesce("__v", F.lit(fill)), F.lit(0.0))).drop("__v")


def with_weight_cap(scores: DataFrame, caps: DataFrame, column: str = "max_target_weight", fill: float | None = None) -> DataFrame:
    """Adds max_target_weight in [0, 1]; null where there is none and no fill."""
    c = unique_rows(caps, KEYS).select(*KEYS, F.col(column).cast("double").alias("__v"))
    value = F.coalesce("__v", F.lit(fill).cast("double"))
    return scores.drop("max_target_weight").join(c, KEYS, "left").withColumn("max_target_weight", F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)))).drop("__v")
