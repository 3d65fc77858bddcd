"""Schedules: scales of features, scores or exposure by timestamp, from lagged observations.

A schedule has one small row for each timestamp (and feature); look-backs are windows by feature over such rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, rolling, scaled
from .relations import unique_rows

TIME = "bar_time"


def health(each: DataFrame, window: int = 12, lag: int = 2, least: int = 4, low: float = 0.25, ic: tuple[float, float] = (-0.05, 0.05), spread: tuple[float, float] = (-0.02, 0.02)) -> DataFrame:
    """Adds scale, state and reason to rank_ic and spread by (feature, bar_time), from means that ended ``lag`` rows ago."""
    mean = lambda c: rolling(F.avg, F.col(c), ["feature"], TIME, window, lag, least)
    rows = each.withColumns({"ic_r": mean("rank_ic"), "sp_r": mean("spread")})
    parts = {"rank_ic": scaled(F.col("ic_r"), *ic), "spread": scaled(F.col("sp_r"), *spread)}
    score, warm = F.least(*parts.values()), F.col("ic_r").isNull() | F.col("sp_r").isNull()
    state = F.when(warm, "warmup").when(score >= 0.75, "healthy").when(score >= 0.25, "watch").otherwise("impaired")
    weak = F.array_join(F.array_compact(F.array(*(F.when(x < 0.75, F.lit(n)) for n, x in parts.items()))), ",")
    return rows.withColumns({"scale": F.when(warm, 1.0).otherwise(low + (1 - low) * score), "state": state, "reason": F.when(warm, "warmup").otherwise(weak)})


def by_state(normal: DataFrame, stress: DataFrame, regime: DataFrame, mode: str = "select", threshold: float = 0.999) -> DataFrame:
    """Two health schedules (bar_time, feature, scale) by a regime's scale (bar_time, scale).

    select takes the stress schedule where the regime's scale is below the threshold, blend weighs it by 1 - scale.
    Rows of either schedule stay; missing scales are 1, a missing regime is none.
    """
    if mode not in ("select", "blend"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = [TIME, "feature"]
    a, b = (unique_rows(d, keys).select(*keys, F.col("scale").alias(n)) for d, n in ((normal, "normal_scale"), (stress, "stress_scale")))
    s = F.col("scale")
    weight = (s < threshold).cast("double") if mode == "select" else F.least(F.greatest(1 - s, F.lit(0.0)), F.lit(1.0))
    r = unique_rows(regime, [TIME]).select(TIME, weight.alias("regime_weight"))
    out = a.join(b, keys, "full").join(F.broadcast(r) if r.count() <= 1_000_000 else r, TIME, "left").fillna(1.0, ["normal_scale", "stress_scale"]).fillna(0.0, ["regime_weight"])
    w = F.col("regime_weight")
    mix = F.least(F.greatest(F.col("normal_scale") * (1 - w) + F.col("stress_scale") * w, F.lit(0.0)), F.lit(1.0))
    reason = F.when(w > 0, "state_conditioned_health_memory,stress_health_memory").otherwise("state_conditioned_health_memory")
    return out.withColumns({"scale": mix, "reason": reason})


def combined(one: DataFrame, two: DataFrame, how: str = "min", keys: tuple[str, ...] = (TIME, "feature")) -> DataFrame:
    """Two schedules by outer join, missing scales 1: their minimum or product, or the second where it has a row."""
    a = one.select(*keys, F.col("scale").alias("__a"))
    b = two.select(*keys, F.col("scale").alias("__b"), F.lit(True).alias("__has"))
    x, y = F.coalesce("__a", F.lit(1.0)), F.coalesce("__b", F.lit(1.0))
    value = {"min": F.least(x, y), "product": x * y, "override": F.when(F.col("__has"), y).otherwise(x)}[how]
    return a.join(b, list(keys), "full").select(*keys, value.alias("scale"))


def exposure(base: DataFrame, *others: DataFrame) -> DataFrame:
    """The least of several exposure scales by timestamp; rows of the base, missing scales 1."""
    out = base.select(TIME, "scale")
    for o in others:
        out = out.join(o.select(TIME, F.col("scale").alias("__o")), TIME, "left").select(TIME, F.least("scale", F.coalesce("__o", F.lit(1.0))).alias("scale"))
    return out


def capped_weights(weights: Column, most: float) -> Column:
    """Array of structs (feature, weight): what exceeds ``most`` goes to the others in proportion, then all sum to one.

    Others whose sum is zero share it evenly.  A cap too low for the number of features is an error.
    """
    def least(w: Column) -> Column:
        return F.struct(w["feature"].alias("feature"), F.least(w["weight"], F.lit(most)).alias("weight"))

    def once(held: Column) -> Column:
        excess = F.aggregate(held, F.lit(0.0), lambda t, w: t + F.greatest(w["weight"] - most, F.lit(0.0)))
        under = F.filter(held, lambda w: w["weight"] < most)
        room = F.aggregate(under, F.lit(0.0), lambda t, w: t + w["weight"])
        more = lambda w: F.when(w["weight"] >= most, F.lit(most)).when(room <= 0, w["weight"] + excess / F.size(under)).otherwise(w["weight"] + excess * w["weight"] / room)
        moved = F.transform(held, lambda w: F.struct(w["feature"].alias("feature"), more(w).alias("weight")))
        return F.when(F.exists(held, lambda w: w["weight"] > most), moved).otherwise(held)

    rounds = F.sequence(F.lit(0), F.size(weights))
    capped = F.transform(F.aggregate(rounds, weights, lambda held, _: once(held)), least)
    total = F.aggregate(capped, F.lit(0.0), lambda t, w: t + w["weight"])
    even = F.transform(capped, lambda w: F.struct(w["feature"].alias("feature"), F.when(total > 0, w["weight"] / total).otherwise(F.lit(1.0) / F.size(capped)).alias("weight")))
    low = F.raise_error(F.lit("the cap is too low for the number of features")).cast("array<struct<feature:string,weight:double>>")
    return F.when(F.lit(most) * F.size(weights) < 1.0, low).otherwise(even)


def validated_weights(schedule: DataFrame, features: list[str], most: float | None = None) -> DataFrame:
    """Weights (bar_time, feature, weight) of known features, checked, and capped within a timestamp if ``most`` is given.

    NULL or negative weights, repeated rows and a cap below the even share are errors when the plan runs: the checks are part of
    it, and the input is read once.  Without a cap weights stay as they are; with one they sum to one.
    """
    if most is not None and not 0 < most <= 1:
        raise ValueError("a cap lies in (0, 1]")
    rows = schedule.where(F.col("feature").isin(features)).select(TIME, "feature", F.col("weight").cast("double").alias("weight"))
    held = rows.groupBy(TIME).agg(F.array_sort(F.collect_list(F.struct("feature", "weight"))).alias("w"))  # a row for each feature
    wrong = F.exists("w", lambda w: w["weight"].isNull() | (w["weight"] < 0))
    twice = F.size(F.array_distinct(F.transform("w", lambda w: w["feature"]))) < F.size("w")
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col(TIME).cast("string"))).cast("boolean")
    held = held.where(F.when(wrong, fail("a weight must be a number and not negative: ")).when(twice, fail("repeated rows of a feature: ")).otherwise(True))
    out = F.col("w") if most is None else capped_weights(F.col("w"), most)
    return held.select(TIME, F.explode(out).alias("w")).select(TIME, "w.feature", "w.weight")


def switched(first: DataFrame, second: DataFrame, switches: DataFrame, keys: tuple[str, ...] = (TIME, "instrument_id")) -> DataFrame:
    """Rows of the first score, and of the second at the timestamps that the table switches (bar_time) lists."""
    at = switches.select(TIME).distinct()
    one = first.join(at, TIME, "left_anti").select(*keys, "score", F.lit("first").alias("source"))
    return one.unionByName(second.join(at, TIME, "left_semi").select(*keys, "score", F.lit("second").alias("source")))


def adaptive_quantile(days: DataFrame, quantiles: list[float], months: int = 12, embargo_days: int = 7, least: int = 20) -> DataFrame:
    """For each month the quantile of a lagged state above which the second score did best before.

    ``days``: bar_time, state_rank (0 to 1), edge (second less first).  A month looks at the days of the ``months`` before it,
    up to the embargo; the quantile with the best mean edge of chosen days (ties: the lowest) wins, none without enough days.
    """
    month = F.trunc(F.to_date(TIME), "month")
    all_months = days.select(month.alias("month")).distinct()
    rows = days.where("edge IS NOT NULL AND state_rank IS NOT NULL").select(F.to_date(TIME).alias("day"), "edge", F.explode(F.filter(F.array(*(F.lit(q) for q in quantiles)), lambda q: q <= F.col("state_rank"))).alias("q"))
    first = F.trunc("day", "month")
    ahead = F.sequence(first, F.add_months(first, months), F.expr("INTERVAL 1 MONTH"))
    seen = rows.withColumn("month", F.explode(ahead)).where((F.col("day") < F.date_sub("month", embargo_days)) & (F.col("day") >= F.add_months("month", -months)))
    each = seen.groupBy("month", "q").agg(F.count("*").alias("n"), F.avg("edge").alias("mean_edge"), ratio(F.avg("edge"), F.stddev_samp("edge") / F.sqrt(F.count("*"))).alias("t"))
    best = each.where((F.col("n") >= least) & (F.col("mean_edge") > 0)).groupBy("month").agg(F.max_by(F.struct("q", "n", "mean_edge", "t"), F.struct(F.round("mean_edge", 9), -F.col("q"))).alias("b"))
    return all_months.join(best, "month", "left").select("month", "b.q", "b.n", "b.mean_edge", "b.t")


def regime_weights(pairs: DataFrame, regime: DataFrame, base: dict[str, float], window: int = 26, lag: int = 1, least: int = 8, ridge: float = 0.5, by_regime: bool = True) -> DataFrame:
    """Rows (bar_time, feature, weight, regime, used_regime, history, reason) from trailing feature correlations.

    ``pairs``: (bar_time, a, b, value); ``regime``: (bar_time, regime), a row for each timestamp that counts.  History is the
    ``window`` rows that end ``lag`` rows ago, those of the row's own regime where that has ``least`` of them and isn't
    warmup.  Mean correlations (0 where there is none) give clip((R + ridge I)^-1 base, 0), normalised; the base itself where
    history is short or nothing positive is left.  Means are running sums by regime; the systems of a batch are solved as one stack.
    """
    names = list(base)
    place = {n: i for i, n in enumerate(names)}
    start = np.array([base[n] for n in names], float)
    start = start / start.sum()
    over = Window.orderBy(TIME).rowsBetween(-(window + lag - 1), -lag)  # one row for each timestamp
    same = lambda r: F.count_if(F.col("regime") == r)
    kinds = [r[0] for r in regime.select("regime").where("regime <> 'warmup'").distinct().limit(65).collect()]
    if len(kinds) > 64:
        raise ValueError("more than 64 regimes")
    of_own = lambda value: F.coalesce(*(F.when(F.col("regime") == r, value(r)) for r in kinds), F.lit(None)) if kinds else F.lit(None)
    times = regime.select(TIME, "regime").withColumns({"n_all": F.count("*").over(over), "n_same": F.coalesce(of_own(lambda r: same(r).over(over)), F.lit(0))})
    used = F.lit(by_regime) & (F.col("n_same") >= least)
    times = times.withColumn("used", used).withColumn("history", F.when(F.col("used"), F.col("n_same")).otherwise(F.col("n_all")))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(names) for b in names[i + 1 :]))
    grid = times.withColumn("p", F.explode(each)).select(*times.columns, "p.a", "p.b").join(pairs.select(TIME, "a", "b", "value"), [TIME, "a", "b"], "left")
    past = Window.partitionBy("a", "b").orderBy(TIME).rowsBetween(-(window + lag - 1), -lag)
    of_all = F.avg("value").over(past)
    mean = F.when(F.col("used"), of_own(lambda r: F.avg(F.when(F.col("regime") == r, F.col("value"))).over(past))).otherwise(of_all)
    means = grid.withColumn("mean", F.coalesce(mean, F.lit(0.0)))
    rows = means.groupBy(TIME, "regime", "used", "history").agg(F.collect_list(F.struct("a", "b", "mean")).alias("pairs"))

    def solve(frames):
        for f in frames:
            r = np.broadcast_to(np.eye(len(names)), (len(f), len(names), len(names))).copy()
            for k, ps in enumerate(f["pairs"]):
                for p in ps:
                    i, j = place[p["a"]], place[p["b"]]
                    r[k, i, j] = r[k, j, i] = p["mean"]
            r += ridge * np.eye(len(names))
            fit = (np.linalg.slogdet(r)[0] != 0) & (f["history"].to_numpy() >= least)
            x = np.tile(start, (len(f), 1))
            if fit.any():
                x[fit] = np.clip(np.linalg.solve(r[fit], np.broadcast_to(start[:, None], (int(fit.sum()), len(names), 1)))[..., 0], 0, None)
            total = x.sum(axis=1, keepdims=True)
            x = np.where(total > 0, x / np.where(total > 0, total, 1), start)
            out = f[[TIME, "regime", "used", "history"]].loc[f.index.repeat(len(names))].reset_index(drop=True)
            out.columns = [TIME, "regime", "used_regime", "history"]
            out["reason"] = np.where(out["history"] < least, "insufficient_history", "")
            yield out.assign(feature=np.tile(names, len(f)), weight=x.ravel())

    kind = rows.schema[TIME].dataType.simpleString()
    return rows.mapInPandas(solve, f"{TIME} {kind}, feature string, weight double, regime string, used_regime boolean, history long, reason string")


#: Event states in order of their rules: the last that holds counts.  fixed values
STATES = ("post_shock_stabilization", "shock_elevated", "limit_diffusion", "shock_extreme", "limit_diffusion_extreme", "warmup")


def event_states(rows: DataFrame, limits: tuple[str, str], others: list[str], window: int = 12, least: int = 4, high: float = 0.5, extreme: float = 1.5, most: float = 3.0, calm_after: int = 4) -> DataFrame:
    """Adds intensity and state to one row for each timestamp.

    Each source (``limits``: limit pressure and limit-down imbalance; ``others``) gives a z-score against the rows before;
    intensity is the mean of those that exist, cut to [0, most], and 0 without any.  Limit states look at the limits' z alone.
    """
    z = {}
    for c in (*limits, *others):
        x = F.col(c)
        mean, sd = (rolling(f, x, [], TIME, window, 1, least) for f in (F.avg, F.stddev_samp))
        score = ratio(x - mean, sd)
        z[f"z_{c}"] = F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(-most)), F.lit(most)))
    rows = rows.withColumns(z)
    found = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(most))) for c in z)))
    rows = rows.withColumn("intensity", F.coalesce(ratio(F.aggregate(found, F.lit(0.0), lambda a, b: a + b), F.size(found).cast("double")), F.lit(0.0)))
    before = Window.orderBy(TIME).rowsBetween(-window, -1)
    peak = F.max("intensity").over(Window.orderBy(TIME).rowsBetween(-calm_after, -1))
    rows = rows.withColumns({"__n": F.count("intensity").over(before), "__peak": peak})
    reach = lambda limit: F.coalesce(F.col(f"z_{limits[0]}") >= limit, F.lit(False)) | F.coalesce(F.col(f"z_{limits[1]}") >= limit, F.lit(False))
    up = lambda limit: F.col("intensity") >= limit
    rules = (F.coalesce(F.col("__peak") >= high, F.lit(False)) & ~up(high) & ~reach(high), up(high), reach(high), up(extreme), reach(extreme), F.col("__n") < least)
    state: Column = F.lit("calm")
    for name, rule in zip(STATES, rules, strict=True):
        state = F.when(rule, name).otherwise(state)
    return rows.withColumn("state", state).drop("__n", "__peak")
