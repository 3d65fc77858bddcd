"""Gates: exposure or feature scales by timestamp from lagged states of the market, the score or a risk feature.

Tables have one row for each timestamp; look-backs are windows in order of time over such rows.  A window of ``window`` rows ends
``lag`` rows ago, and gives nothing below ``least`` values.  Quantiles are interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import rolling, scaled
from .schedules import combined

TIME = "bar_time"
SELECTORS = ("volatility", "breadth", "volatility_and_weak_breadth", "volatility_or_weak_breadth")
RULES = ("return_positive", "breadth_majority", "return_and_breadth", "monotone_breadth_return")


def _before(c: str, lag: int) -> Column:
    return F.lag(c, lag).over(Window.orderBy(TIME)) if lag else F.col(c)


def _quantile(x: Column, q: float, window: int, least: int) -> Column:
    w = Window.orderBy(TIME).rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(w) >= least, F.percentile(x, F.lit(q)).over(w))


def _scales(state: Column, full: float, reduced: float, blocked: float, warmup: float) -> Column:
    return F.when(state == "full", F.lit(full)).when(state == "reduced", reduced).when(state == "blocked", blocked).otherwise(warmup)


def regime_states(rows: DataFrame, selector: str = SELECTORS[-1], volatility: str = "volatility", breadth: str = "breadth", lag: int = 1, window: int = 26, least: int = 8, high: float = 0.75, low: float = 0.25) -> DataFrame:
    """Adds lagged values, their thresholds, high_volatility, weak_breadth and regime (warmup, stress, normal).

    Stress: lagged volatility at or above its rolling upper quantile, lagged breadth at or below its lower one, both or either,
    as the selector says.  Warm-up is where a threshold that the selector needs is missing.
    """
    if selector not in SELECTORS:
        raise ValueError(f"unknown selector {selector!r}")
    rows = rows.withColumns({"lagged_volatility": _before(volatility, lag), "lagged_breadth": _before(breadth, lag)})
    rows = rows.withColumns({"high_threshold": _quantile(F.col("lagged_volatility"), high, window, least), "low_threshold": _quantile(F.col("lagged_breadth"), low, window, least)})
    wild, weak = F.coalesce(F.col("lagged_volatility") >= F.col("high_threshold"), F.lit(False)), F.coalesce(F.col("lagged_breadth") <= F.col("low_threshold"), F.lit(False))
    known = {"volatility": F.col("lagged_volatility").isNotNull() & F.col("high_threshold").isNotNull(), "breadth": F.col("lagged_breadth").isNotNull() & F.col("low_threshold").isNotNull()}
    stress = {"volatility": wild, "breadth": weak, SELECTORS[2]: wild & weak, SELECTORS[3]: wild | weak}[selector]
    ready = known.get(selector, known["volatility"] & known["breadth"])
    return rows.withColumns({"high_volatility": wild, "weak_breadth": weak, "regime": F.when(~ready, "warmup").when(stress, "stress").otherwise("normal")})


def rolling_gate(
    rows: DataFrame, mode: str = "threshold", window: int = 20, least: int = 5, lag: int = 48, floors: tuple[float, float, float] = (0.0, 0.0, 0.0), blocks: tuple[float, float, float] = (-0.001, -0.001, -0.05),
    spans: tuple[tuple[float, float], ...] = ((-0.001, 0.001), (-0.001, 0.001), (-0.05, 0.05)), budget: tuple[float, float] = (0.25, 1.0), full: float = 1.0, reduced: float = 0.5, blocked: float = 0.0, warmup: float = 1.0,
) -> DataFrame:
    """Adds n_seen, scale, reason and health to rows with top_label, spread and rank_ic.

    threshold: a rolling mean at or below its block limit blocks, one below its floor reduces.  budget: the least of the means'
    scores between their spans runs the scale from one end of the budget to the other.
    """
    if mode not in ("threshold", "budget"):
        raise ValueError(f"unknown mode {mode!r}")
    names = ("top_label", "spread", "rank_ic")
    rows = rows.withColumns({f"r_{c}": rolling(F.avg, F.col(c), [], TIME, window, lag, least) for c in names})
    seen = F.count("top_label").over(Window.orderBy(TIME).rowsBetween(-(window - 1 + lag), -lag))
    rows = rows.withColumn("n_seen", seen)
    ready = F.col("n_seen") >= least
    if mode == "budget":
        health = F.least(*(scaled(F.col(f"r_{c}"), *s) for c, s in zip(names, spans, strict=True)))
        return rows.withColumn("health", F.when(ready, health)).withColumns({"scale": F.when(ready, budget[0] + (budget[1] - budget[0]) * F.col("health")).otherwise(warmup), "reason": F.when(ready, "budget_exposure").otherwise("warmup")})
    hit = lambda limits, test: F.coalesce(F.array_contains(F.array(*(F.coalesce(test(F.col(f"r_{c}"), x), F.lit(False)) for c, x in zip(names, limits, strict=True))), True), F.lit(False))
    state = F.when(~ready, "warmup").when(hit(blocks, lambda a, b: a <= b), "blocked").when(hit(floors, lambda a, b: a < b), "reduced").otherwise("full")
    reason = F.when(state == "warmup", state).otherwise(F.concat(state, F.lit("_exposure")))
    return rows.withColumns({"health": F.lit(None).cast("double"), "scale": _scales(state, full, reduced, blocked, warmup), "reason": reason})


def risk_observations(df: DataFrame, feature: str, how: str | float = "mean") -> DataFrame:
    """Rows (bar_time, risk, n): mean, median or a quantile of a feature at each timestamp that has it."""
    x = F.col(feature)
    value = F.avg(x) if how == "mean" else F.percentile(x, F.lit(0.5 if how == "median" else how))
    return df.where(x.isNotNull()).groupBy(TIME).agg(value.alias("risk"), F.count("*").alias("n"))


def risk_states(rows: DataFrame, window: int = 26, least: int = 8, high: float = 0.6, extreme: float = 0.9, full: float = 1.0, reduced: float = 0.5, blocked: float = 0.0, warmup: float = 1.0) -> DataFrame:
    """Adds thresholds of the rows before, n_seen, state (warmup, full, reduced, blocked) and scale to (bar_time, risk)."""
    rows = rows.withColumn("__past", _before("risk", 1))
    seen = F.count("__past").over(Window.orderBy(TIME).rowsBetween(-(window - 1), 0))
    rows = rows.withColumns({"high_threshold": _quantile(F.col("__past"), high, window, least), "extreme_threshold": _quantile(F.col("__past"), extreme, window, least), "n_seen": seen}).drop("__past")
    state = F.when((F.col("n_seen") < least) | F.col("risk").isNull(), "warmup").when(F.col("risk") <= F.col("high_threshold"), "full").when(F.col("risk") <= F.col("extreme_threshold"), "reduced").otherwise("blocked")
    return rows.withColumn("state", state).withColumn("scale", _scales(F.col("state"), full, reduced, blocked, warmup))


def event_exposure(
    states: DataFrame, blocked: tuple[str, ...], reduced: tuple[str, ...], warm: tuple[str, ...] = ("warmup",), lag: int = 1, base: DataFrame | None = None, scales: tuple[float, float, float, float] = (1.0, 0.5, 0.0, 1.0)
) -> DataFrame:
    """Rows (bar_time, state, effective, event_scale, reason, base_scale, scale) from (bar_time, state), lagged.

    With a base schedule (bar_time, scale) the scale is the smaller one; where the base has no row it is 1.
    """
    rows = states.select(TIME, "state").withColumn("effective", _before("state", lag))
    kind = F.when(F.col("effective").isNull(), "missing").when(F.col("effective").isin(*blocked), "blocked").when(F.col("effective").isin(*reduced), "reduced").when(F.col("effective").isin(*warm), "warmup").otherwise("full")
    reason = F.when(kind == "missing", "lagged_state_missing").otherwise(F.concat(kind, F.lit("_event_state")))
    rows = rows.withColumns({"event_scale": _scales(kind, *scales), "reason": reason})
    if base is None:
        return rows.withColumns({"base_scale": F.lit(1.0), "scale": F.col("event_scale")})
    rows = rows.join(base.select(TIME, F.col("scale").alias("base_scale")), TIME, "left").fillna(1.0, ["base_scale"])
    return rows.withColumn("scale", F.least("event_scale", "base_scale"))


def loss_gate(rows: DataFrame, label: str = "top_label", lag: int = 2, window: int = 8, least: int = 4, loss: float = 0.0, extreme: float = -0.01, full: float = 1.0, reduced: float = 0.5, blocked: float = 0.0, warmup: float = 1.0) -> DataFrame:
    """Adds matured, mean_label, negative_rate, n_seen, state and scale: losses of the top names shrink what chose them."""
    rows = rows.withColumn("matured", _before(label, lag))
    w = Window.orderBy(TIME).rowsBetween(-(window - 1), 0)
    below = F.coalesce(F.col("matured") < 0, F.lit(False)).cast("double")
    rows = rows.withColumns({"n_seen": F.count("matured").over(w), "negative_rate": F.when(F.count("*").over(w) >= least, F.avg(below).over(w)), "mean_label": F.when(F.count("matured").over(w) >= least, F.avg("matured").over(w))})
    state = F.when(F.col("n_seen") < least, "warmup").when(F.col("mean_label") >= loss, "full").when(F.col("mean_label") > extreme, "reduced").otherwise("blocked")
    return rows.withColumn("state", state).withColumn("scale", _scales(F.col("state"), full, reduced, blocked, warmup))


def factor_sleeve(rows: DataFrame, features: list[str], rule: str = RULES[-1], ret: str = "market_return", breadth: str = "market_breadth", full: float = 1.0, reduced: float = 0.5, blocked: float = 0.0, warmup: float = 1.0) -> DataFrame:
    """Rows (bar_time, feature, scale, reason, state, lagged_return, lagged_breadth): features count as the tape allows.

    full where the last return is positive, where breadth is at least a half, or where both hold, as the rule says; the
    monotone rule also reduces where one of them holds; blocked otherwise.
    """
    if rule not in RULES or not features:
        raise ValueError(f"unknown rule {rule!r}" if features else "no feature")
    rows = rows.withColumns({"lagged_return": _before(ret, 1), "lagged_breadth": _before(breadth, 1)})
    up, broad = F.col("lagged_return") > 0, F.col("lagged_breadth") >= 0.5
    whole = {"return_positive": up, "breadth_majority": broad}.get(rule, up & broad)
    state = F.when(F.col("lagged_return").isNull() | F.col("lagged_breadth").isNull(), "warmup").when(whole, "full")
    if rule == "monotone_breadth_return":
        state = state.when(up | broad, "reduced")
    rows = rows.withColumn("state", state.otherwise("blocked"))
    rows = rows.withColumns({"scale": _scales(F.col("state"), full, reduced, blocked, warmup), "reason": F.concat(F.lit("lagged_broad_tape_sleeve:"), F.col("state")), "feature": F.explode(F.array(*map(F.lit, features)))})
    return rows.select(TIME, "feature", "scale", "reason", "state", "lagged_return", "lagged_breadth")


def with_base(sleeve: DataFrame, base: DataFrame, how: str = "min") -> DataFrame:
    """Two schedules (bar_time, feature, scale, reason) as one: min, product or override, cut to [0, 1], reasons listed once."""
    keys = [TIME, "feature"]
    scale = combined(base, sleeve, how).withColumn("scale", F.least(F.greatest("scale", F.lit(0.0)), F.lit(1.0)))
    why = base.select(*keys, F.col("reason").alias("__b")).join(sleeve.select(*keys, F.col("reason").alias("__s")), keys, "full")
    each = F.array_distinct(F.filter(F.split(F.concat_ws(",", "__b", "__s"), ","), lambda x: x != ""))
    return scale.join(why, keys).select(*keys, "scale", F.array_join(each, ",").alias("reason"))
