"""Queries of gates and score forecasts on the weekly panel, and the SQL they are compared with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.sql import Plan
from ..sources import bars as B
from . import comparison, gates, overlays, research
from . import evaluation as E
from .registered import KEYS, X, event_states, panel, scored, tidy


def weeks(spark, folder) -> DataFrame:
    """One row for each week: dispersion, breadth and mean of f1, and the health of the composite score."""
    state = panel(spark, folder).where("f1 IS NOT NULL").groupBy("bar_time").agg(
        F.round(F.stddev_samp("f1"), 9).alias("volatility"), F.round(F.avg((F.col("f1") < 0).cast("double")), 9).alias("breadth"), F.round(F.avg(-F.col("f1")), 9).alias("market_return"),
    )
    each = E.prediction_evaluation(scored(spark, folder), "score", "label").select("bar_time", *(F.round(c, 9).alias(c) for c in ("rank_ic", "top_label", "spread", "all_label")))
    return state.join(each, "bar_time", "left")


def score_health(spark, folder):
    return tidy(weeks(spark, folder))


def regime_state(spark, folder):
    """All four selectors."""
    w = weeks(spark, folder)
    each = [gates.regime_states(w, s).select("bar_time", F.lit(s).alias("selector"), "lagged_volatility", "lagged_breadth", "high_threshold", "low_threshold", "high_volatility", "weak_breadth", "regime") for s in gates.SELECTORS]
    return tidy(reduce(DataFrame.union, each))


GATE = {"window": 8, "least": 4, "lag": 2}


def regime_gate_raw(spark, folder):
    w = weeks(spark, folder)
    one = gates.rolling_gate(w, "threshold", **GATE)
    two = gates.rolling_gate(w, "budget", spans=((-0.02, 0.02), (-0.02, 0.02), (-0.05, 0.05)), **GATE)
    return tidy(one.select("bar_time", F.lit("threshold").alias("mode"), "n_seen", "scale", "reason", "health").union(two.select("bar_time", F.lit("budget"), "n_seen", "scale", "reason", "health")))


def risk_gate_raw(spark, folder):
    """A feature's mean, median and upper decile as risk."""
    each = []
    for name, how in (("mean", "mean"), ("median", "median"), ("p90", 0.9)):
        seen = gates.risk_observations(panel(spark, folder), "f3", how).withColumn("risk", F.round("risk", 9))
        each.append(gates.risk_states(seen).select("bar_time", F.lit(name).alias("how"), "risk", "n", "high_threshold", "extreme_threshold", "n_seen", "state", "scale"))
    return tidy(reduce(DataFrame.union, each))


BLOCKED, REDUCED = ("limit_diffusion_extreme", "shock_extreme"), ("limit_diffusion", "shock_elevated")


def event_exposure(spark, folder):
    """Lagged event states, with exposure of winter months as the base."""
    states = event_states(spark, folder)
    base = states.where(F.month("bar_time").isin(1, 2, 3)).select("bar_time", F.lit(0.7).alias("scale"))
    return tidy(gates.event_exposure(states, BLOCKED, REDUCED, base=base))


def state_shares(spark, folder):
    counted = event_states(spark, folder).groupBy("state").agg(F.count("*").alias("n"))
    return tidy(counted.select("state", "n", (F.col("n") / F.lit(counted.agg(F.sum("n")).scalar())).alias("share")))


def loss_gate(spark, folder):
    return tidy(gates.loss_gate(weeks(spark, folder).select("bar_time", "top_label")))


def factor_sleeve(spark, folder):
    """All four rules."""
    w = weeks(spark, folder).select("bar_time", "market_return", F.col("breadth").alias("market_breadth"))
    return tidy(reduce(DataFrame.union, (gates.factor_sleeve(w, ["f1", "f2"], r).withColumn("rule", F.lit(r)) for r in gates.RULES)))


def sleeve_combined(spark, folder):
    """The sleeve with a base schedule of odd months for f2 and f3."""
    w = weeks(spark, folder).select("bar_time", "market_return", F.col("breadth").alias("market_breadth"))
    base = w.where(F.month("bar_time") % 2 == 1).select("bar_time", F.explode(F.array(F.lit("f2"), F.lit("f3"))).alias("feature"), F.lit(0.6).alias("scale"), F.lit("season,lagged_broad_tape_sleeve:full").alias("reason"))
    sleeve = gates.factor_sleeve(w, ["f1", "f2"])
    return tidy(reduce(DataFrame.union, (gates.with_base(sleeve, base, how).withColumn("how", F.lit(how)) for how in ("min", "product", "override"))))


def regime_shrink(spark, folder):
    """Features other than f3 at half weight in stress."""
    rows = gates.regime_states(weeks(spark, folder)).select("bar_time", "regime", F.explode(F.array(*map(F.lit, X))).alias("feature"))
    return rows.select("bar_time", "feature", F.when((F.col("regime") == "stress") & (F.col("feature") != "f3"), 0.5).otherwise(1.0).alias("scale"))


def hourly_scores(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly moves as primary, mean tick values as satellite (missing for some), and the hours at which it counts."""
    rows = B.executable(B.hourly()).over(spark, folder)
    primary = rows.select(*KEYS, F.round(F.col("close_price") - F.col("open_price"), 9).alias("score"))
    satellite = rows.where("volume % 3 <> 0").select(*KEYS, F.round(F.col("turnover") / F.col("volume"), 9).alias("score"))
    condition = rows.select("bar_time").distinct().withColumn("active", F.hour("bar_time") % 4 != 3)
    return primary, satellite, condition


def overlay_modes(spark, folder):
    """All modes; blend and penalty under the condition, the latter anchored to the day's first hour and sparse."""
    p, s, on = hourly_scores(spark, folder)
    none, flag = F.lit(None).cast("double"), F.lit(True)
    each = [
        overlays.overlay(p, s, 0.3, condition=on).select(*KEYS, F.lit("blend").alias("mode"), "score", flag.alias("entry_eligible"), none.alias("risk_penalty_bps")),
        overlays.overlay(p, s, 0.5, "downside_penalty", on, anchored=True, sparse=True, quantile=0.4).select(*KEYS, F.lit("downside_penalty"), "score", flag, none),
        overlays.overlay(p, s, 0.3, "entry_exclusion").select(*KEYS, F.lit("entry_exclusion"), "score", "entry_eligible", none),
        overlays.overlay(p, s, 25.0, "optimizer_risk_penalty", ranked=False, quantile=0.3).select(*KEYS, F.lit("optimizer_risk_penalty"), "score", flag, "risk_penalty_bps"),
    ]
    return tidy(reduce(DataFrame.union, each))


def overlay_limits(spark, folder):
    """A blend with penalties and weight caps from tables that lack some names."""
    p, s, _ = hourly_scores(spark, folder)
    out = overlays.with_penalty(overlays.overlay(p, s, 0.3), s.withColumn("cost", F.col("score") - 50), "cost", 1.0)
    return tidy(overlays.with_weight_cap(out, s.select(*KEYS, (F.col("score") / 80).alias("cap")), "cap"))


def queries() -> dict:
    return {f.__name__: f for f in (overlay_modes, overlay_limits, score_health, regime_state, regime_gate_raw, risk_gate_raw, event_exposure, state_shares, loss_gate, factor_sleeve, sleeve_combined, regime_shrink)}


# ------------------------------------------------------------------------------------ other engine
def sql() -> dict[str, str]:
    r = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"
    rank = lambda c: f"rank() OVER (PARTITION BY bar_time ORDER BY {c}) + (count(*) OVER (PARTITION BY bar_time, {c}) - 1) / 2.0"
    week = (
        ("k1", "SELECT bar_time, round(stddev_samp(f1), 9) AS volatility, round(avg((f1 < 0)::INT), 9) AS breadth, round(avg(-f1), 9) AS market_return FROM panel WHERE f1 IS NOT NULL GROUP BY bar_time"),
        ("k2", f"SELECT bar_time, label, {rank('score')} AS a, {rank('label')} AS b, row_number() OVER (PARTITION BY bar_time ORDER BY score DESC, instrument_id) AS hi, row_number() OVER (PARTITION BY bar_time ORDER BY score, instrument_id) AS lo FROM scored WHERE label IS NOT NULL"),
        ("k3", "SELECT bar_time, CASE WHEN count(*) >= 2 AND stddev_pop(a) * stddev_pop(b) > 1e-14 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS ic, avg(label) FILTER (hi <= 5) AS t, avg(label) FILTER (lo <= 5) AS o, avg(label) AS al FROM k2 GROUP BY bar_time"),
        ("wk", "SELECT k1.*, round(ic, 9) AS rank_ic, round(t, 9) AS top_label, round(t - o, 9) AS spread, round(al, 9) AS all_label FROM k1 LEFT JOIN k3 ON k1.bar_time = k3.bar_time"),
    )

    def on(base: Plan, *steps: tuple[str, str]) -> str:
        for name, text in steps:
            base = base.then(name, text)
        return base.text()

    scores = research.scores()
    rows = lambda n, lag=0: f"OVER (ORDER BY bar_time ROWS BETWEEN {n - 1 + lag} PRECEDING AND {f'{lag} PRECEDING' if lag else 'CURRENT ROW'})"
    quant = lambda x, q: f"CASE WHEN count({x}) {rows(26)} >= 8 THEN quantile_cont({x}, {q}) {rows(26)} END"
    regime = (
        *week, ("g1", "SELECT *, lag(volatility) OVER (ORDER BY bar_time) AS lv, lag(breadth) OVER (ORDER BY bar_time) AS lb FROM wk"), ("g2", f"SELECT *, {quant('lv', 0.75)} AS hq, {quant('lb', 0.25)} AS lq FROM g1"),
        ("g3", "SELECT *, coalesce(lv >= hq, FALSE) AS hv, coalesce(lb <= lq, FALSE) AS wb, lv IS NOT NULL AND hq IS NOT NULL AS vk, lb IS NOT NULL AND lq IS NOT NULL AS bk FROM g2"),
    )
    kinds = {"volatility": ("vk", "hv"), "breadth": ("bk", "wb"), "volatility_and_weak_breadth": ("vk AND bk", "hv AND wb"), "volatility_or_weak_breadth": ("vk AND bk", "hv OR wb")}
    named = lambda k: f"CASE WHEN NOT ({kinds[k][0]}) THEN 'warmup' WHEN {kinds[k][1]} THEN 'stress' ELSE 'normal' END"
    roll = lambda c: f"CASE WHEN count({c}) {rows(8, 2)} >= 4 THEN avg({c}) {rows(8, 2)} END"
    lin = lambda c, a: f"least(greatest(({c} + {a}) / {2 * a}, 0.0), 1.0)"
    gate = (*week, ("q1", f"SELECT bar_time, count(top_label) {rows(8, 2)} AS n, {roll('top_label')} AS t, {roll('spread')} AS s, {roll('rank_ic')} AS i FROM wk"))
    health = f"least({lin('t', 0.02)}, {lin('s', 0.02)}, {lin('i', 0.05)})"
    state = "CASE WHEN n < 4 THEN 'warmup' WHEN t <= -0.001 OR s <= -0.001 OR i <= -0.05 THEN 'blocked_exposure' WHEN t < 0 OR s < 0 OR i < 0 THEN 'reduced_exposure' ELSE 'full_exposure' END"
    risks = " UNION ALL ".join(f"SELECT bar_time, '{how}' AS how, round({f}, 9) AS risk, count(*) AS n FROM panel WHERE f3 IS NOT NULL GROUP BY bar_time" for how, f in (("mean", "avg(f3)"), ("median", "median(f3)"), ("p90", "quantile_cont(f3, 0.9)")))
    by = "OVER (PARTITION BY how ORDER BY bar_time ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)"
    rq = lambda q: f"CASE WHEN count(p) {by} >= 8 THEN quantile_cont(p, {q}) {by} END"
    scale = lambda s: f"CASE {s} WHEN 'full' THEN 1.0 WHEN 'reduced' THEN 0.5 WHEN 'blocked' THEN 0.0 ELSE 1.0 END"
    events = Plan((("ev", comparison.sql()["event_states"].replace("{", "{{")),))
    exposed = "CASE WHEN e IS NULL THEN 'lagged_state_missing' WHEN e IN ('limit_diffusion_extreme', 'shock_extreme') THEN 'blocked_event_state' WHEN e IN ('limit_diffusion', 'shock_elevated') THEN 'reduced_event_state' WHEN e = 'warmup' THEN 'warmup_event_state' ELSE 'full_event_state' END"
    sleeves = (*week, ("vl", "SELECT bar_time, lag(market_return) OVER (ORDER BY bar_time) AS lr, lag(breadth) OVER (ORDER BY bar_time) AS lb FROM wk"))
    rules = {"return_positive": "lr > 0", "breadth_majority": "lb >= 0.5", "return_and_breadth": "lr > 0 AND lb >= 0.5", "monotone_breadth_return": "lr > 0 AND lb >= 0.5"}
    sleeve = lambda rule: f"CASE WHEN lr IS NULL OR lb IS NULL THEN 'warmup' WHEN {rules[rule]} THEN 'full'" + (" WHEN lr > 0 OR lb >= 0.5 THEN 'reduced'" if rule.startswith("mono") else "") + " ELSE 'blocked' END"
    mixed = {"min": "least(coalesce(b.scale, 1.0), coalesce(s.scale, 1.0))", "product": "coalesce(b.scale, 1.0) * coalesce(s.scale, 1.0)", "override": "coalesce(s.scale, b.scale)"}
    hours = (
        "b AS (SELECT event_type AS i, date_trunc('hour', ts) AS t, first(value ORDER BY ts) AS o, last(value ORDER BY ts) AS c, count(*) AS v, sum(value) AS m FROM events GROUP BY 1, 2), "
        "j AS (SELECT i, t, round(c - o, 9) AS p, CASE WHEN v % 3 <> 0 THEN round(m / v, 9) END AS s, hour(t) % 4 <> 3 AS act, t = min(t) OVER (PARTITION BY CAST(t AS DATE)) AS first_t FROM b), "
        "k AS (SELECT *, (rank() OVER (PARTITION BY t ORDER BY p) + (count(*) OVER (PARTITION BY t, p) - 1) / 2.0) / count(*) OVER (PARTITION BY t) - 0.5 AS rp, "
        "CASE WHEN s IS NULL THEN 0 ELSE (rank() OVER (PARTITION BY t, s IS NULL ORDER BY s) + (count(*) OVER (PARTITION BY t, s) - 1) / 2.0) / count(s) OVER (PARTITION BY t) - 0.5 END AS rs, coalesce(s, 0) AS s0 FROM j), "
        "q AS (SELECT *, quantile_cont(rs, 0.4) OVER (PARTITION BY t) AS q4, quantile_cont(rs, 0.3) OVER (PARTITION BY t) AS q3, quantile_cont(s0, 0.3) OVER (PARTITION BY t) AS q0, max(rp) FILTER (first_t) OVER (PARTITION BY CAST(t AS DATE), i) AS a FROM k)"
    )
    name = "t AS bar_time, i AS instrument_id"
    empty = "TRUE AS entry_eligible, CAST(NULL AS DOUBLE) AS risk_penalty_bps"
    return {
        "overlay_modes": f"WITH {hours} SELECT {name}, 'blend' AS mode, {r('CASE WHEN act THEN 0.7 * rp + 0.3 * rs ELSE rp END', 'score')}, {empty} FROM q"
        f" UNION ALL SELECT {name}, 'downside_penalty', {r('CASE WHEN act THEN coalesce(a, rp) - 0.5 * greatest(q4 - rs, 0) ELSE rp END', 'score')}, {empty} FROM q WHERE act OR first_t"
        f" UNION ALL SELECT {name}, 'entry_exclusion', {r('rp', 'score')}, NOT rs < q3, NULL FROM q UNION ALL SELECT {name}, 'optimizer_risk_penalty', {r('p', 'score')}, TRUE, {r('25 * greatest(q0 - s0, 0)', 'x')} FROM q",
        "overlay_limits": f"WITH {hours} SELECT {name}, {r('0.7 * rp + 0.3 * rs', 'score')}, {r('CASE WHEN s IS NULL THEN 1.0 ELSE greatest(s - 50, 0) END', 'optimizer_risk_penalty_bps')}, {r('CASE WHEN s IS NOT NULL THEN least(greatest(s / 80, 0), 1) END', 'max_target_weight')} FROM q",
        "score_health": on(scores, *week, ("out", f"SELECT bar_time, {', '.join(r(c, c) for c in ('volatility', 'breadth', 'market_return', 'rank_ic', 'top_label', 'spread', 'all_label'))} FROM wk")),
        "regime_state": on(scores, *regime, ("out", " UNION ALL ".join(f"SELECT bar_time, '{k}' AS selector, {r('lv', 'lagged_volatility')}, {r('lb', 'lagged_breadth')}, {r('hq', 'high_threshold')}, {r('lq', 'low_threshold')}, hv AS high_volatility, wb AS weak_breadth, {named(k)} AS regime FROM g3" for k in kinds))),
        "regime_shrink": on(scores, *regime, ("out", f"SELECT bar_time, f AS feature, CASE WHEN f <> 'f3' AND {named('volatility_or_weak_breadth')} = 'stress' THEN 0.5 ELSE 1.0 END AS scale FROM (SELECT *, unnest(['f1', 'f2', 'f3']) AS f FROM g3) x")),
        "regime_gate_raw": on(
            scores, *gate, ("q2", f"SELECT bar_time, n, {state} AS reason, CASE WHEN n >= 4 THEN {health} END AS h FROM q1"),
            ("out", f"SELECT bar_time, 'threshold' AS mode, n AS n_seen, CASE reason WHEN 'blocked_exposure' THEN 0.0 WHEN 'reduced_exposure' THEN 0.5 ELSE 1.0 END AS scale, reason, CAST(NULL AS DOUBLE) AS health FROM q2 UNION ALL SELECT bar_time, 'budget', n, {r('CASE WHEN n >= 4 THEN 0.25 + 0.75 * h ELSE 1.0 END', 'scale')}, CASE WHEN n >= 4 THEN 'budget_exposure' ELSE 'warmup' END, {r('h', 'health')} FROM q2"),
        ),
        "risk_gate_raw": on(
            research.panel(), ("i1", risks), ("i2", "SELECT *, lag(risk) OVER (PARTITION BY how ORDER BY bar_time) AS p FROM i1"), ("i3", f"SELECT *, {rq(0.6)} AS hi, {rq(0.9)} AS ex, count(p) {by} AS seen FROM i2"),
            ("i4", "SELECT *, CASE WHEN seen < 8 THEN 'warmup' WHEN risk <= hi THEN 'full' WHEN risk <= ex THEN 'reduced' ELSE 'blocked' END AS state FROM i3"),
            ("out", f"SELECT bar_time, how, {r('risk', 'risk')}, n, {r('hi', 'high_threshold')}, {r('ex', 'extreme_threshold')}, seen AS n_seen, state, {scale('state')} AS scale FROM i4"),
        ),
        "event_exposure": on(
            events, ("e1", "SELECT bar_time, state, lag(state) OVER (ORDER BY bar_time) AS e FROM ev"), ("e2", f"SELECT *, {exposed} AS reason, CASE WHEN month(bar_time) <= 3 THEN 0.7 ELSE 1.0 END AS base_scale FROM e1"),
            ("e3", "SELECT *, CASE WHEN reason LIKE 'blocked%' THEN 0.0 WHEN reason LIKE 'reduced%' THEN 0.5 ELSE 1.0 END AS event_scale FROM e2"), ("out", "SELECT bar_time, state, e AS effective, event_scale, reason, base_scale, least(event_scale, base_scale) AS scale FROM e3"),
        ),
        "state_shares": on(events, ("out", f"SELECT state, count(*) AS n, {r('count(*) / (SELECT count(*) FROM ev)', 'share')} FROM ev GROUP BY state")),
        "loss_gate": on(
            scores, *week, ("o1", "SELECT bar_time, top_label, lag(top_label, 2) OVER (ORDER BY bar_time) AS m FROM wk"), ("o2", f"SELECT *, count(m) {rows(8)} AS n, count(*) {rows(8)} AS k, avg(m) {rows(8)} AS a, avg(coalesce(m < 0, FALSE)::INT) {rows(8)} AS g FROM o1"),
            ("o3", "SELECT *, CASE WHEN n < 4 THEN 'warmup' WHEN a >= 0 THEN 'full' WHEN a > -0.01 THEN 'reduced' ELSE 'blocked' END AS state FROM o2"),
            ("out", f"SELECT bar_time, {r('top_label', 'top_label')}, {r('m', 'matured')}, n AS n_seen, {r('CASE WHEN k >= 4 THEN g END', 'negative_rate')}, {r('CASE WHEN n >= 4 THEN a END', 'mean_label')}, state, {scale('state')} AS scale FROM o3"),
        ),
        "factor_sleeve": on(scores, *sleeves, ("vs", " UNION ALL ".join(f"SELECT *, '{k}' AS rule, {sleeve(k)} AS state FROM vl" for k in rules)), ("out", f"SELECT bar_time, f AS feature, {scale('state')} AS scale, 'lagged_broad_tape_sleeve:' || state AS reason, state, {r('lr', 'lagged_return')}, {r('lb', 'lagged_breadth')}, rule FROM (SELECT *, unnest(['f1', 'f2']) AS f FROM vs) x")),
        "sleeve_combined": on(
            scores, *sleeves, ("vs", f"SELECT bar_time, unnest(['f1', 'f2']) AS feature, {sleeve('monotone_breadth_return')} AS state FROM vl"), ("s", f"SELECT *, {scale('state')} AS scale FROM vs"),
            ("b", "SELECT bar_time, unnest(['f2', 'f3']) AS feature, 0.6 AS scale FROM vl WHERE month(bar_time) % 2 = 1"),
            ("out", " UNION ALL ".join(f"SELECT coalesce(b.bar_time, s.bar_time) AS bar_time, coalesce(b.feature, s.feature) AS feature, {r(v, 'scale')}, concat_ws(',', CASE WHEN b.scale IS NOT NULL THEN 'season,lagged_broad_tape_sleeve:full' END, CASE WHEN s.state IS NOT NULL AND NOT (s.state = 'full' AND b.scale IS NOT NULL) THEN 'lagged_broad_tape_sleeve:' || s.state END) AS reason, '{k}' AS how FROM b FULL JOIN s ON b.bar_time = s.bar_time AND b.feature = s.feature" for k, v in mixed.items())),
        ),
    }
