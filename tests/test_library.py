"""Library queries against DuckDB on the same tables, and folds against plain calculations."""

import math
import operator
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from tapeloom import queries as library
from tapeloom.functions import features
from tapeloom.operators import costaware, evaluation, folds, learning, portfolio, registered, relations, research, schedules, splits
from tapeloom.plans.sql import Plan
from tapeloom.streaming.bars import tick_bars

DATA = "/root/testdata/sf0.001"
SQL = library.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    return con


def _tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df:
        kinds = set(map(type, df[c].dropna()))
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]) or any(k.__name__ == "Decimal" for k in kinds):
            df = df.assign(**{c: df[c].astype(float)})
        else:
            df = df.assign(**{c: df[c].map(lambda x: "" if x is None or x is pd.NaT else str(pd.Timestamp(x)) if hasattr(x, "year") else str(x))})
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, duck, name):
    ours, theirs = _tidy(library.queries()[name](spark, DATA).toPandas()), _tidy(duck.execute(SQL[name]).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=2e-6, rtol=0)


@pytest.mark.parametrize("panel", ["daily", "hourly"])
def test_families_together_equal_each_alone(duck, panel):
    bars = library.bars.executable(getattr(library.bars, panel)())
    whole = duck.execute(features.together(bars).text()).df().set_index(list(features.KEYS)).sort_index()
    for name in features.NAMES:
        one = duck.execute(features.plan(bars, name).text()).df().set_index(list(features.KEYS)).sort_index()
        pd.testing.assert_frame_equal(whole[one.columns].dropna(how="all").reset_index(), one.reset_index(), check_dtype=False)


def test_families_together_names_what_it_cannot_do():
    bars = library.bars.executable(library.bars.daily())
    for names in (["momentum", "nonsense"], []):
        with pytest.raises(ValueError):
            features.together(bars, names)


def _random_bars(seed=4, names=3, n=40):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(names):
        price = 10.0
        for t in range(n):
            flat = rng.random() < 0.15
            open_ = price if flat else price * (1 + rng.normal(0, 0.01))
            price = open_ if flat else open_ * (1 + rng.normal(0, 0.02))
            volume = float(rng.integers(0, 500))
            rows.append((f"n{i}", pd.Timestamp("2024-01-02") + pd.Timedelta(hours=t % 4, days=t // 4), open_, max(open_, price) + 0.05, min(open_, price) - 0.05, price, volume, volume * (open_ + price) / 2, bool(rng.random() < 0.1), bool(rng.random() < 0.1)))
    d = pd.DataFrame(rows, columns=["instrument_id", "bar_time", "open_price", "high_price", "low_price", "close_price", "volume", "turnover", "limit_up_open", "limit_down_open"])
    return d.assign(trade_date=d.bar_time.dt.date, previous_close=None, session_open=None)


@pytest.fixture(scope="module")
def family(spark):
    d = _random_bars()
    source = spark.createDataFrame(d.drop(columns=["previous_close", "session_open"]))
    bars = Plan((("exec_bars", "SELECT * FROM {mine}"),))

    def run(name, **windows):
        out = features.plan(bars, name, **windows).run(spark, mine=source).toPandas()
        return d.merge(out, on=["instrument_id", "bar_time"], how="left").sort_values(["instrument_id", "bar_time"], ignore_index=True)

    return run


def _by_name(d, x, f):
    return x.groupby(d.instrument_id, group_keys=False).apply(f)


def _returns(d):
    return d.close_price / d.groupby("instrument_id").close_price.shift(1) - 1


def test_price_impact_has_no_factor(family):
    d = family("liquidity_impact")
    want = _returns(d).abs() / d.turnover.where(d.turnover != 0)
    assert np.allclose(d.amihud, want, atol=1e-12, equal_nan=True)


def test_large_trade_cost_is_signed(family):
    d, n = family("intraday_quality"), 6
    vwap = (d.turnover / d.volume.where(d.volume != 0)).where(lambda v: v != 0)
    cost = (np.sign(_returns(d)) * (d.close_price - vwap) / vwap).fillna(0.0)
    big = d.turnover.where(d.turnover >= _by_name(d, d.turnover, lambda v: v.rolling(n).quantile(0.8)), 0.0)
    total = _by_name(d, big, lambda v: v.rolling(n).sum())
    want = _by_name(d, cost * big, lambda v: v.rolling(n).sum()) / total.where(total != 0)
    both = d.large_trade_cost.notna()
    assert both.sum() > 50 and (want[both] < 0).any() and np.allclose(d.large_trade_cost[both], want[both], atol=2e-6)


def test_synchronous_falls_count_falling_names_only(family):
    d, n = family("event_shock_proxy"), 6
    r = _returns(d)
    middle, down = r.groupby(d.bar_time).transform("median"), r.lt(0).astype(float).where(r.notna()).groupby(d.bar_time).transform("mean")
    assert (r == 0).any()
    weight = (middle.clip(upper=0).abs() * down).where((r - middle).notna())
    want = _by_name(d, (r - middle) * weight, lambda v: v.rolling(n).sum()) / _by_name(d, weight, lambda v: v.rolling(n).sum()).where(lambda v: v != 0)
    both = d.event_sync_down_resilience.notna()
    assert both.sum() > 20 and np.allclose(d.event_sync_down_resilience[both], want[both], atol=2e-6)


def test_stress_probability_needs_a_return(family):
    d = family("regime_conditioned")
    assert d.market_regime_stress_probability[_returns(d).isna()].isna().all() and d.market_regime_stress_probability.notna().any()


def test_session_tail_has_its_own_length(family):
    d = family("eod_reversal", k=1, tail=3)
    place = d.groupby(["instrument_id", "trade_date"]).cumcount()
    want = (-1.5 * _returns(d)).where(place >= 1)
    assert np.allclose(d.eod_reversal, want, atol=2e-6, equal_nan=True)


def test_exhaustion_alert_compares_half_windows(family):
    d, n, h = family("microstructure_exhaustion_alert"), 6, 3
    r = _returns(d)
    up, down, fall = r.clip(lower=0), (-r).clip(lower=0), d.turnover.where(r < 0, 0.0)
    roll = lambda x, k: _by_name(d, x, lambda v: v.rolling(k).sum())
    back = lambda x: _by_name(d, x, lambda v: v.shift(h))
    safe = lambda x: x.where(x != 0)
    load = np.log1p((roll(fall, n) / safe(roll(down, n))).clip(lower=0))
    speed = np.log1p((roll(fall, h) / safe(back(roll(fall, h)))).clip(lower=0))
    impact = roll(down, h) / safe(roll(fall, h))
    strain = load * speed * ((impact - back(impact)) / safe(impact + back(impact))).clip(lower=0)
    recovery = roll(up, h) / safe(roll(down, h))
    decay = ((back(recovery) - recovery) / safe(back(recovery).abs() + recovery.abs())).clip(lower=0).fillna(0.0)
    flag = lambda c: d[c].astype(float).groupby(d.bar_time).transform("mean")
    pressure = (flag("limit_down_open") - flag("limit_up_open")).clip(lower=0)
    state = pressure.groupby(d.bar_time).first().rolling(n).mean().shift(1)
    want = strain * (1 + decay) * (1 + pressure + (pressure - d.bar_time.map(state)).clip(lower=0))
    both = d.microstructure_exhaustion_alert.notna()
    assert both.sum() > 10 and np.allclose(d.microstructure_exhaustion_alert[both], want[both], atol=2e-6)


def test_main_board_rule(spark):
    rows = [("600000.SH", "CN"), ("601.sh ", None), ("688001.SH", "CN"), ("000001.SZ", "cn"), ("300001.SZ", None), ("600000.SZ", "CN"), ("600000", "CN"), (None, None), ("002001.SZ", "HK")]
    d = spark.createDataFrame(rows, "s string, m string")
    from pyspark.sql import functions as F

    got = [r[0] for r in d.select(relations.main_board(F.col("s"), F.col("m"))).collect()]
    assert got == [True, True, False, True, False, False, False, False, False]


def test_contribution_caps_use_totals_of_each_pass(spark):
    rows = [(9.0, 1.0, 1.0), (-4.0, 4.0, None), (0.0, 0.0, 5.0), (1.0, 1.0, 1.0)]
    got = portfolio.capped_contributions(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], 0.4, 3).collect()
    for row, out in zip(rows, got):
        now = list(row)
        for _ in range(3):
            total = sum(abs(x or 0) for x in now)
            now = [None if x is None else math.copysign(min(abs(x), 2 / 3 * (total - abs(x))), x) for x in now]
        assert all((a is None and b is None) or math.isclose(a, b, abs_tol=1e-12) for a, b in zip(out, now))


def test_event_states_in_order_of_their_rules(spark):
    events = [(1, 0), (2, 1), (1, 0), (2, 1), (1, 0), (9, 1), (1, 0), (1, 1), (2, 0), (1, 1), (2, 9), (1, 0), (3, 1), (2, 0)]
    rows = spark.createDataFrame([(i, float(v), float(w), None) for i, (v, w) in enumerate(events)], "bar_time long, pressure double, imbalance double, other double")
    got = {r.bar_time: r.state for r in schedules.event_states(rows, ("pressure", "imbalance"), ["other"], 6, 3).collect()}
    z = lambda xs, t: None if t < 3 or np.std(xs[max(0, t - 6) : t], ddof=1) == 0 else float(np.clip((xs[t] - np.mean(xs[max(0, t - 6) : t])) / np.std(xs[max(0, t - 6) : t], ddof=1), -3, 3))
    a, b, level = [x for x, _ in events], [y for _, y in events], []
    for t in range(len(a)):
        zs = [v for v in (z(a, t), z(b, t)) if v is not None]
        level.append(sum(max(v, 0) for v in zs) / len(zs) if zs else 0.0)
        limit = max([v for v in (z(a, t), z(b, t)) if v is not None], default=-9)
        peak = max(level[max(0, t - 4) : t], default=-9)
        state = "warmup" if t < 3 else "limit_diffusion_extreme" if limit >= 1.5 else "shock_extreme" if level[t] >= 1.5 else "limit_diffusion" if limit >= 0.5 else "shock_elevated" if level[t] >= 0.5 else "post_shock_stabilization" if peak >= 0.5 else "calm"
        assert got[t] == state, t
    assert len(set(got.values())) >= 4


def test_guards(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, v double")
    with pytest.raises(ValueError, match="repeated keys"):
        relations.unique(d, ["k"])
    with pytest.raises(ValueError, match="exist already"):
        relations.enriched(d, d, ["k"])
    with pytest.raises(ValueError, match="collide"):
        relations.renamed(d, {"v": "k"})
    with pytest.raises(KeyError):
        relations.select_fields(d, ["nope"])
    with pytest.raises(ValueError, match="outcome"):
        learning.train(d, ["label_1"], "v")
    with pytest.raises(Exception, match="aren't negative"):
        portfolio.target_weights(spark.createDataFrame([(1, "a", -1.0)], "bar_time int, instrument_id string, score double"), 1, method="signal").collect()
    assert relations.leaking(["f1", "label_4", "x_target", "Forward_Return_1"]) == ["label_4", "x_target", "Forward_Return_1"]
    assert relations.periods("2023-11-30", "2024-02-01") == ["2023_11", "2023_12", "2024_01", "2024_02"]


def test_scan_unites_files_by_name(spark, tmp_path):
    spark.createDataFrame([("2024-01-05", 1)], "bar_time string, a int").write.parquet(str(tmp_path / "x"))
    spark.createDataFrame([("2024-02-05", 2, 3), ("2024-03-05", 4, 5)], "bar_time string, a int, b int").write.parquet(str(tmp_path / "y"))
    got = relations.scan(spark, [str(tmp_path / "x"), str(tmp_path / "y")], "2024-01-01", "2024-02-28", fields=["bar_time", "a", "b"]).orderBy("a").collect()
    assert [tuple(r) for r in got] == [("2024-01-05", 1, None), ("2024-02-05", 2, 3)]


def test_written_periods_replace_old_ones(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-05", 1), ("2024-02-05", 2)], "bar_time string, a int")
    relations.write_dataset(rows, str(tmp_path / "d"))
    relations.write_dataset(rows.where("a = 2").withColumn("a", rows["a"] + 5), str(tmp_path / "d"))
    got = relations.scan(spark, str(tmp_path / "d"))
    assert sorted((r.period, r.a) for r in got.collect()) == [("2024_01", 1), ("2024_02", 7)]


@pytest.mark.parametrize("lag,by_regime", [(1, True), (3, True), (1, False)])
def test_regime_weights_solve(spark, lag, by_regime):
    """Against the same rule written with a loop; timestamps without correlations and a singular system among them."""
    rng = np.random.default_rng(3)
    names, times = ["a", "b", "c", "d"], list(range(90))
    state = {t: str(rng.choice(["warmup", "normal", "stress"], p=[0.1, 0.6, 0.3])) for t in times}
    pairs = [(t, x, y, None if rng.random() < 0.3 else float(rng.uniform(-1, 1))) for t in times if t % 11 for i, x in enumerate(names) for y in names[i + 1 :]]
    base = {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    got = schedules.regime_weights(
        spark.createDataFrame(pairs, "bar_time long, a string, b string, value double"), spark.createDataFrame(list(state.items()), "bar_time long, regime string"), base, 20, lag, 6, 0.5, by_regime
    ).toPandas()
    assert len(got) == len(times) * 4
    by, used_any = {(t, x, y): v for t, x, y, v in pairs if v is not None}, 0
    for t, rows in got.groupby("bar_time"):
        past = times[max(0, t - lag + 1 - 20) : max(0, t - lag + 1)]
        alike = [u for u in past if state[u] == state[t]]
        used = by_regime and state[t] != "warmup" and len(alike) >= 6
        past, used_any = alike if used else past, used_any + used
        want = start = np.array(list(base.values()))
        if len(past) >= 6:
            m = np.eye(4) * 1.5
            for i, x in enumerate(names):
                for j in range(i + 1, 4):
                    held = [by[u, x, names[j]] for u in past if (u, x, names[j]) in by]
                    m[i, j] = m[j, i] = np.mean(held) if held else 0.0
            w = np.clip(np.linalg.solve(m, start), 0, None)
            want = w / w.sum() if w.sum() > 0 else start
        assert np.allclose(rows.set_index("feature").weight[names], want, atol=1e-9)
        assert set(rows.used_regime) == {used} and set(rows.history) == {len(past)} and set(rows.reason) == {"" if len(past) >= 6 else "insufficient_history"}
    assert used_any > 10 or not by_regime


def test_weight_caps(spark):
    """Zeros share evenly what is cut, and a cap below the even share is an error."""
    def capped(rows, most):
        df = spark.createDataFrame([(1, f, w) for f, w in rows], "bar_time int, feature string, weight double")
        return {r.feature: round(r.weight, 9) for r in schedules.validated_weights(df, ["a", "b", "c", "d"], most).collect()}

    assert capped([("a", 1.0), ("b", 0.0), ("c", 0.0)], 0.5) == {"a": 0.5, "b": 0.25, "c": 0.25}
    assert capped([("a", 0.2), ("b", 0.1), ("c", 0.1)], 0.5) == {"a": 0.5, "b": 0.25, "c": 0.25}
    assert capped([("a", 3.0), ("b", 1.0), ("c", 1.0)], 0.5) == {"a": 0.333333333, "b": 0.333333333, "c": 0.333333333}
    assert capped([("a", 0.7), ("b", 0.2), ("z", 5.0)], None) == {"a": 0.7, "b": 0.2}
    for rows, most in (([("a", 0.5), ("b", 0.5)], 0.4), ([("a", None)], None), ([("a", 0.1), ("a", 0.2)], None), ([("a", -1.0)], 0.9)):
        with pytest.raises(PySparkException):
            capped(rows, most)
    with pytest.raises(ValueError):
        capped([("a", 1.0)], 1.5)


def test_boosted_trees_learn_and_name_what_they_use(spark):
    rng = np.random.default_rng(1)
    rows = [(f"{1996 + i % 3}-{1 + i % 9:02d}-10", f"{1996 + i % 3}-{1 + i % 9:02d}-17", float(a), float(b), float(a > 0) + 0.01 * float(rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    d = spark.createDataFrame(rows, "bar_time string, exit_time string, a double, b double, y double")
    out, importance = learning.by_fold(d, [("1998", "1998-01-01", "1998-12-31")], ["a", "b"], "y", rounds=5)
    got = out.toPandas()
    assert len(got) == 200 and np.corrcoef(got.prediction, got.y)[0, 1] > 0.9
    assert importance["1998"][0] > 0.9
    assert learning.redundancy(d.withColumn("c", 2 * d["a"]), ["a", "b", "c"])["drop"] == ["c"]


def test_missing_features_are_learnt_and_predicted(spark):
    """A missing value carries the label here; no row is lost, and validation rows stop the boosting."""
    rng = np.random.default_rng(2)
    rows = [(f"{1996 + i % 3}-{1 + i % 9:02d}-10", f"{1996 + i % 3}-{1 + i % 9:02d}-17", None if i % 4 == 0 else float("nan") if i % 4 == 1 else float(a), float(b), float(i % 4 < 2)) for i, (a, b) in enumerate(rng.normal(size=(600, 2)))]
    d = spark.createDataFrame(rows, "bar_time string, exit_time string, a double, b double, y double")
    fold = splits.Fold("1998", "1998-01-01", "1998-12-31", "1997-05-31", "1997-06-01", "1997-12-31")
    got = learning.by_fold(d, [fold], ["a", "b"], "y", rounds=8)[0].toPandas()
    assert len(got) == 200 and np.corrcoef(got.prediction, got.y)[0, 1] > 0.9


def test_ml_predictions_cover_every_fold(spark):
    got = library.queries()["ml_predictions"](spark, DATA).groupBy("fold").count().collect()
    panel = registered.panel(spark, DATA).toPandas()
    year = pd.to_datetime(panel.bar_time).dt.year
    assert {r.fold: r["count"] for r in got} == {str(y): int((year == y).sum()) for y in range(1996, 2002)}


def test_purge_keeps_labels_out_of_later_parts(spark):
    rows = [("1996-12-01", "1996-12-20"), ("1996-12-20", "1996-12-28"), ("1996-12-30", "1997-01-05"), ("1997-02-01", "1997-02-08"), ("1999-01-01", "1999-01-09")]
    d = spark.createDataFrame(rows, "bar_time string, exit_time string")
    got = {r.bar_time: r.part for r in splits.purged_split(d, "1996-12-31", ("1997-01-01", "1998-12-31"), ("1999-01-01", "1999-12-31"), 7).collect()}
    assert got == {"1996-12-01": "train", "1997-02-01": "valid", "1999-01-01": "test"}
    folds = splits.walk_forward(d, [("a", "1997-01-01", "1997-12-31"), ("b", "1999-01-01", "1999-12-31")]).collect()
    assert sorted((r.fold, r.part, r.bar_time) for r in folds if r.fold == "a") == [("a", "test", "1997-02-01"), ("a", "train", "1996-12-01"), ("a", "train", "1996-12-20")]
    assert sum(r.fold == "b" for r in folds) == 5


def test_admission_takes_given_directions(spark):
    p = registered.panel(spark, DATA)
    one = {r.feature: r for r in evaluation.admission(p, ["f1"], "label", limits={"timestamps": 10}).collect()}
    two = {r.feature: r for r in evaluation.admission(p, ["f1"], "label", directions={"f1": -one["f1"].direction}, limits={"timestamps": 10}).collect()}
    assert two["f1"].direction == -one["f1"].direction and one["f1"].role == "alpha_rank"


def test_admission_weighs_checks_by_role(spark):
    """The same failures reject, warn or inform; too few timestamps reject in every role."""
    p = registered.panel(spark, DATA)
    strict = {"timestamps": 10, "ic": 9.0, "spread": 9.0, "years": 99, "coverage": 2.0}
    got = {}
    for role in evaluation.SEVERITY:
        r = evaluation.admission(p, ["f1"], "label", limits=strict, roles={"f1": role}).first()
        got[role] = (r.status, {"ic", "spread", "years", "coverage"} & set(r.failed.split(",")), {"ic", "spread", "years", "coverage"} & set(r.informational.split(",")))
    assert got["alpha_rank"] == ("reject", {"ic", "spread", "years", "coverage"}, set())
    assert got["risk_penalty"] == got["entry_filter"] == ("reject", {"ic", "years", "coverage"}, {"spread"})
    assert got["event_overlay"] == ("reject", {"ic", "years"}, {"spread", "coverage"})
    assert got["state_allocator"] == ("reject", {"coverage"}, {"ic", "spread", "years"})
    easy = strict | {"coverage": 0.0}
    assert evaluation.admission(p, ["f1"], "label", limits=easy, roles={"f1": "state_allocator"}).first().status == "candidate"
    assert evaluation.admission(p, ["f1"], "label", limits=easy | {"timestamps": 10**6}, roles={"f1": "state_allocator"}).first().status == "reject"
    with pytest.raises(ValueError):
        evaluation.admission(p, ["f1"], "label", roles={"f1": "nonsense"})


def test_unknown_family():
    with pytest.raises(ValueError, match="unknown feature family"):
        features.plan(library.bars.hourly(), "nonsense")


def test_hysteresis_waits_and_limits_steps():
    raw = [("warmup", 1.0), ("full", 1.0), ("blocked", 0.0), ("full", 1.0), ("blocked", 0.0), ("blocked", 0.0), ("blocked", 0.0), ("blocked", 0.0)]
    out = list(folds.hysteresis(raw, folds.Gate(confirm=2, up=0.25, down=0.4, deadband=0.0)))
    assert [s for s, _, _ in out] == ["warmup", "full", "full", "full", "full", "blocked", "blocked", "blocked"]
    assert [round(x, 9) for _, x, _ in out] == [1.0, 1.0, 1.0, 1.0, 1.0, 0.6, 0.2, 0.0]


def test_policy_keeps_buffered_names_and_respects_gross():
    p = folds.Buffer(target_count=2, entry_rank=2, exit_rank=3, min_hold=1, turnover=None, name_cap=0.5)
    held = {"a": folds.Held(0.5, 3), "b": folds.Held(0.5, 0)}
    out = folds.decide({"x": (1, 0.9), "y": (2, 0.8), "a": (3, 0.5), "b": (9, 0.1)}, held, p)
    assert out["a"][0] == "hold_buffer" and out["b"][0] == "min_hold_blocked" and "x" not in out
    out = folds.decide({"x": (1, 0.9), "a": (3, 0.5)}, {"a": folds.Held(0.5, 3), "b": folds.Held(0.5, 3)}, p)
    assert out["b"] == ("universe_removed", 0.0) and out["x"] == ("entry", 0.5)


def test_cost_aware_policy_weighs_edge_against_cost():
    p = costaware.Limits(target_count=2, cost=10.0, edge_per_score=100.0, name_cap=0.5, turnover=None)
    held = {"a": folds.Held(0.5, 3), "b": folds.Held(0.5, 3)}
    out = costaware.decide({"x": {"score": 0.35}, "a": {"score": 0.3}, "b": {"score": 0.05}}, held, p)
    assert out["a"][:2] == ("hold", 0.5) and out["b"][:2] == ("exit", 0.0) and out["x"][:2] == ("entry", 0.5)
    assert out["x"][2] == pytest.approx(25.0)
    assert costaware.decide({}, held, p) == {n: ("universe_removed", 0.0, None) for n in "ab"}
    assert costaware.decide({}, {}, p) == {}


def test_cost_aware_policy_keeps_its_budget():
    p = costaware.Limits(target_count=2, cost=0.0, name_cap=0.5, turnover=0.4, band=0.0)
    held = {"a": folds.Held(0.5, 3), "b": folds.Held(0.5, 3)}
    out = costaware.decide({"x": {"score": 0.9}, "y": {"score": 0.8}, "a": {"score": 0.1}, "b": {"score": 0.2}}, held, p)
    assert {n: round(w, 9) for n, (_, w, _) in out.items()} == {"a": 0.3, "b": 0.5, "x": 0.2, "y": 0.0}
    assert out["y"][0] == "turnover_budget_limited"


def test_cost_aware_query_stays_within_limits(spark):
    out = library.queries()["policy_cost_aware"](spark, DATA).toPandas()
    assert set(out.run_id) == set(costaware.RUNS) and out.target_weight.min() >= -1e-9
    assert out.groupby(["run_id", "bar_time"]).target_weight.sum().max() <= 1 + 1e-6


def _bar(time, name, price, target=None, **more):
    return {"exec_time": time, "instrument_id": name, "trade_date": time // 10, "open_price": price, "close_price": price, "capacity": 1e9, "tradable_bar": True, "limit_up_open": False, "limit_down_open": False, "target_weight": target} | more


def test_simulator_settles_a_day_later():
    free = folds.Costs(commission=0.0, least_commission=0.0, stamp=0.0, slip=0.0, cash=100_000.0, capacity=None)
    rows = [_bar(1, "a", 10.0, 0.5), _bar(2, "a", 11.0, 0.0), _bar(11, "a", 12.0, 0.0), _bar(12, "a", 12.0)]
    out = list(folds.simulate(iter(rows), free))
    assert [(x[3], x[4], x[5], x[6]) for x in out] == [(1, 1, 0, 0), (1, 0, 0, 1), (0, 0, 1, 0), (0, 0, 0, 0)]
    assert out[-1][1] == out[-1][2] == 100_000 + 5000 * 2


def test_simulator_blocks_and_caps():
    c = folds.Costs(cash=100_000.0, capacity=0.1)
    out = list(folds.simulate(iter([_bar(1, "a", 10.0, 0.5, limit_up_open=True), _bar(11, "a", 10.0, 0.5, capacity=20_000.0), _bar(21, "a", 10.0, 0.0, limit_down_open=True), _bar(31, "b", 10.0, 0.2)]), c))
    assert [x[3] for x in out] == [0, 1, 1, 2] and out[0][6] == 1 and out[2][6] == 1
    assert list(folds.simulate(iter([]), c)) == []


def test_simulated_runs_conserve_money(spark):
    out = library.queries()["simulate_targets"](spark, DATA).toPandas()
    assert set(out.run_id) == set(folds.SCENARIOS) and (out.cash > -1e-6).all()
    last = out.sort_values("exec_time").groupby("run_id").equity.last()
    assert np.isfinite(last).all()


def test_policy_query_stays_within_limits(spark):
    out = library.queries()["policy_rank_buffer"](spark, DATA).toPandas()
    gross = out.groupby(["run_id", "bar_time"]).target_weight.sum()
    assert len(out) and gross.max() <= 1 + 1e-6 and (out.target_weight >= -1e-9).all()


def _held_after(out, held, weight):
    return {n: folds.Held(x[weight], held[n].bars + 1 if n in held else 0) for n, x in out.items() if x[weight] > 1e-12}


def test_policies_see_all_names(spark):
    """Every scored name of a wide cross-section reaches the decision, held ones at any rank."""
    data = DATA.replace("sf0.001", "sf0.01")
    rows = research.scores().then("out", "SELECT bar_time, instrument_id, score_rank, score FROM scored").over(spark, data).toPandas()
    assert rows.score_rank.max() > 50
    times = [(t, [(r.instrument_id, r.score_rank, r.score) for r in g.itertuples()]) for t, g in rows.groupby("bar_time")]
    q, late = library.queries(), 0
    for name, runs in (("policy_rank_buffer", ("rank_buffer", "slow")), ("hold_buffer", ("hold_buffer",)), ("policy_cost_aware", tuple(costaware.RUNS))):
        want = {}
        for run in runs:
            held = {}
            for t, g in times:
                if name == "policy_cost_aware":
                    out = costaware.decide({n: {"score": s} for n, _, s in g}, held, costaware.RUNS[run])
                else:
                    out = folds.decide({n: (k, s) for n, k, s in g}, held, folds.POLICIES[run])
                rank = {n: k for n, k, _ in g}
                late += sum(x[0] == "exit" and rank[n] > 50 for n, x in out.items())
                want |= {(run, t, n): (x[0], x[1]) for n, x in out.items()}
                held = _held_after(out, held, 1)
        got = {(r.run_id, r.bar_time, r.instrument_id): (r.action, r.target_weight) for r in q[name](spark, data).toPandas().itertuples()}
        assert got.keys() == want.keys()
        assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-8) for k in want)
    assert late


def test_memory_pairs_all_parts(spark, tmp_path):
    """Ids beyond 200, two families and missing values, against all pairs."""
    rng = np.random.default_rng(5)
    parts = [(int(i), f"b{rng.integers(4)}", int(rng.integers(5)), float(rng.integers(0, 8000)) / 100) for i in rng.permutation(np.arange(1, 4000, 13))]
    parts += [(4001, None, 1, 12.0), (4002, None, 1, 14.0), (4003, "b1", None, 30.0), (4004, "b1", None, 34.99), (4005, "b1", None, 35.0), (4006, "b1", 2, None)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    want = {}
    for i, (a, f, k, x) in enumerate(parts):
        for b, g, m, y in parts[i + 1 :]:
            s = 0.3 * (f is not None and f == g) + 0.15 * (k is not None and k == m) + 0.25 * (x is not None and y is not None and abs(x - y) < 5)
            if s >= 0.35:
                want[min(a, b), max(a, b)] = round(s, 6)
    got = library.queries()["research_memory"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {(r.a, r.b): round(r.similarity, 6) for r in got} == want


def test_overlay_blends_all_rows(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    rows = research.scores().then("out", "SELECT bar_time, instrument_id, score, zscore FROM scored").over(spark, data).toPandas()
    by = rows.groupby("bar_time")
    assert by.size().max() > 20
    want = 0.7 * by.score.rank(pct=True) + 0.3 * by.zscore.rank(pct=True).fillna(0.5)
    want = dict(zip(zip(rows.bar_time, rows.instrument_id), want))
    got = library.queries()["overlay_blend"](spark, data).toPandas()
    assert len(got) == len(want)
    assert all(math.isclose(want[r.bar_time, r.instrument_id], r.score, abs_tol=2e-6) for r in got.itertuples())


def test_folds_take_rows_one_by_one(spark):
    """A run's rows don't wait in a list, come in order, and runs that share a task stay apart."""
    df = spark.range(60_000, numPartitions=4).selectExpr("CAST(id % 3 AS STRING) AS run_id", "50000 - id AS t")

    def step(run, rows):
        first = next(rows)
        held = operator.length_hint(rows)  # rows that wait in a list
        last, n, ordered = first["t"], 1, True
        for r in rows:
            ordered, last, n = ordered and r["t"] > last, r["t"], n + 1
        yield run, n, held, ordered

    got = folds.folded(df, "run_id", ["t"], step, "run_id string, n long, held long, ordered boolean").collect()
    assert sorted((r.run_id, r.n, r.ordered) for r in got) == [(str(k), 20_000, True) for k in range(3)]
    assert max(r.held for r in got) <= 10_000


def test_q_values(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 0.1), ("d", None)], "feature string, t_stat double")
    got = {r.feature: (r.p_value, r.q_value) for r in folds.bh_qvalues(df).collect()}
    p = {k: math.erfc(t / math.sqrt(2)) for k, t in (("a", 3.0), ("b", 2.0), ("c", 0.1))}
    assert got.keys() == p.keys() and all(math.isclose(got[k][0], p[k], abs_tol=1e-8) for k in p)
    assert math.isclose(got["a"][1], 3 * p["a"], abs_tol=1e-8) and math.isclose(got["b"][1], 1.5 * p["b"], abs_tol=1e-8)


def test_stream_emits_the_bars_of_the_batch(spark, tmp_path):
    ticks = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type", "value")
    ticks.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    q = tick_bars(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination(120)
    whole = {(r.instrument_id, r.bar_time): r for r in tick_bars(ticks).collect()}
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) > 0.9 * len(whole)
    for r in got:
        w = whole[r.instrument_id, r.bar_time]
        assert (r.volume, r.open_price, r.close_price) == (w.volume, w.open_price, w.close_price)
