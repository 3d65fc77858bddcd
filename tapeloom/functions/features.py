"""Intraday feature families: each is a few steps of column expressions over one shared set of inputs.

``plan(bars, family)`` puts the shared inputs of all instruments in one pass partitioned by instrument, states of the
whole market in one by timestamp, and market-state histories on the table of distinct timestamps, which is joined
back.  Window functions of one step share their sort.
"""

from __future__ import annotations

import re

from ..plans.sql import Plan
from . import expr as E
from .expr import balance, clip, div, high, lag, log1p, low, mean, pos, quantile, softplus, std, tanh, total

R, C, O, H, L, V, T = "r", "close_price", "open_price", "high_price", "low_price", "volume", "turnover"  # noqa: E741


def ret(k: int) -> str:
    return f"({div(C, lag(C, k))} - 1)"


def _halves(n: int):
    """Recent and previous turnover on falling bars, over half a window each, as two steps."""
    h = n // 2
    return {"rec": total("t_dn", h)}, {"prv": lag("rec", h)}


_DECAY = pos(div("prv - rec", "prv + rec"))


def families(n: int = 6, k: int = 3, s: int = 4, l: int = 12, m: int = 8, tail: int = 2) -> dict[str, list[dict[str, str]]]:  # noqa: E741
    """All families: steps of named expressions; names with a leading underscore or not in the last step stay inside.

    n: window, k: look-back, s / m / l: short, middle and long windows, tail: bars at a session's end.
    """
    q = {"q": div(total("r_up", n), total("r_dn", n))}
    f: dict[str, list[dict[str, str]]] = {}
    f["bar_return"] = [{"bar_return": f"{div(C, O)} - 1"}]
    f["reversal"] = [{f"reversal_lb{j}": f"-{ret(j)}" for j in (1, k)}]
    f["cross_sectional_reversal"] = [{"_rk": ret(k)}, {"cross_sectional_reversal": f"-(_rk - {E.at('median', '_rk')})"}]
    f["conditional_reversal"] = [{"_rk": ret(k), "_sd": std(R, n), "_vr": f"{div(V, mean(V, n))} - 1"}, {"_md": f"@PCT(_sd, 0.5) OVER (PARTITION BY bar_time)"}, {"conditional_reversal": "CASE WHEN _rk < 0 AND _sd <= _md AND _vr >= 0 THEN -_rk END"}]
    f["eod_reversal"] = [{"_rk": ret(k), "_left": "row_number() OVER (PARTITION BY instrument_id, trade_date ORDER BY bar_time DESC)"}, {"eod_reversal": f"CASE WHEN _left <= {tail} THEN -1.5 * _rk END"}]
    f["momentum"] = [{f"momentum_lb{j}": ret(j) for j in (k, n)}]
    f["risk_adjusted_momentum"] = [{"risk_adjusted_momentum": div(ret(n), std(R, n))}]
    f["volume_confirmed_momentum"] = [{"volume_confirmed_momentum": f"{ret(n)} * ({div(V, mean(V, n))} - 1)"}]
    f["volatility"] = [{f"volatility_w{j}": std(R, j) for j in (n, l)}]
    f["volatility_state_change"] = [{"_s": std(R, s), "_l": std(R, l)}, {"volatility_state_change": f"{div('_s', '_l')} - 1", "volatility_state_trend": div(f"_s - {lag('_s', s)}", "_l")}]
    f["downside_volatility"] = [{"downside_volatility": f"sqrt({mean('r_dn * r_dn', n)})"}]
    f["negative_return_persistence"] = [{"negative_return_persistence": mean("CASE WHEN r < 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END", n)}]
    f["sell_pressure_absorption"] = [{"sell_pressure_absorption": div(total("CASE WHEN r IS NOT NULL THEN t_dn END", n), total("r_dn", n))}]
    rec, prv = _halves(n)
    f["downside_turnover_decay"] = [{"rec": total("CASE WHEN r IS NOT NULL THEN t_dn END", n // 2)}, prv, {"downside_turnover_decay": div("prv - rec", "prv + rec")}]
    f["sell_pressure_recovery"] = [{"sell_pressure_recovery": f"{div(total('r_up', n), total('r_dn', n))} * {div(total('t_up', n), total(T, n))}"}]
    f["sell_pressure_quality_state"] = [q | {"_a": log1p(pos(div(total("t_dn", n), total("r_dn", n)))), "_tp": clip(f"2 * {mean('weak', n)}", 0, 1)}, {"_b": balance("q")}, {"sell_pressure_absorption_quality": "_a * _b * (1 - _tp)", "false_absorption_risk": "_a * (1 - _b) * (1 + _tp)"}]
    h = n // 2
    f["microstructure_exhaustion_alert"] = [{"_x": div(total("t_dn", n), total("r_dn", n)), "rec": total("t_dn", h), "_i": div(total("r_dn", h), total("t_dn", h)), "_rs": div(total("r_up", h), total("r_dn", h)), "lp_l": f"lp - lp_lag"}, {"prv": lag("rec", h), "_ip": lag("_i", h), "_rsp": lag("_rs", h)}, {"_st": f"{log1p('_x')} * {log1p(pos(div('rec', 'prv')))} * {pos(div('_i - _ip', '_i + _ip'))}", "_rd": f"coalesce({pos(div('_rsp - _rs', 'abs(_rsp) + abs(_rs)'))}, 0)"}, {"microstructure_impact_strain": "_st", "microstructure_exhaustion_alert": f"_st * (1 + _rd) * (1 + lp + {pos('lp_l')})"}]
    f["sell_pressure_exhaustion"] = [q | {"_u": div(total("t_up", n), total(T, n))} | rec, prv, {"sell_pressure_exhaustion": f"{log1p(pos('q'))} * _u * {_DECAY}"}]
    three = [(x, w) for x, w in (("s", s), ("m", m), ("l", l))]
    f["sell_pressure_exhaustion_persistence"] = [{a: b for x, w in three for a, b in ((f"_q{x}", div(total("r_up", w), total("r_dn", w))), (f"_u{x}", div(total("t_up", w), total(T, w))), (f"_r{x}", total("t_dn", w // 2)))}, {f"_p{x}": lag(f"_r{x}", w // 2) for x, w in three}, {f"_e{x}": f"{log1p(pos(f'_q{x}'))} * _u{x} * {pos(div(f'_p{x} - _r{x}', f'_p{x} + _r{x}'))}" for x, _ in three}, {"sell_pressure_exhaustion_persistence": "_el - 0.5 * (_es + _em)"}]
    slot = "PARTITION BY instrument_id, hour(bar_time) ORDER BY bar_time"
    f["same_slot_intraday_memory"] = [{"same_slot_residual_return": mean("r - mr", k, shift=1, by=slot)}]
    gap = {"_g": f"{div('session_open', 'previous_close')} - 1", "_i": f"{div(C, 'session_open')} - 1"}
    f["overnight_intraday_tug_of_war"] = [gap, {"overnight_gap": "_g", "gap_down_recovery": f"{pos('-_g')} * {pos('_i')}", "gap_up_fade": f"{pos('_g')} * {pos('-_i')}", "overnight_intraday_disagreement": "-_g * _i"}]
    f["weak_tape_overnight_gap"] = [gap | {"_s": f"weak_mean + {log1p('100 * down_mean')}"}, {"weak_tape_gap_up_risk": f"{pos('_g')} * _s", "weak_tape_gap_up_fade_risk": f"{pos('_g')} * {pos('-_i')} * (1 + _s)", "weak_tape_gap_down_recovery_risk": f"{pos('-_g')} * {pos('_i')} * _s"}]
    weigh = lambda x, w: div(total(f"({x}) * ({w})", n), total(f"CASE WHEN ({x}) IS NOT NULL THEN ({w}) END", n))
    lnt = log1p(f"greatest({T}, 0.0)")
    f["event_shock_proxy"] = [{"_lt": lnt, "_res": "r - mr", "_w1": "abs(least(mr, 0.0)) * dn", "_w2": f"lu + ld + {pos('lu - lu_lag')} + {pos('ld - ld_lag')}", "_oc": f"{div(C, O)} - 1", "_w4": f"abs({div(O, lag(C))} - 1)"}, {"_w3": f"abs({div('_lt - ' + mean('_lt', n, shift=1), std('_lt', n, shift=1))})"}, {"event_sync_down_resilience": weigh("_res", "_w1"), "event_limit_diffusion_resilience": weigh("_res", "_w2"), "event_turnover_dislocation_recovery": weigh(R, "_w3"), "event_open_jump_recovery_quality": weigh("_oc", "_w4")}]
    f["market_downside_beta"] = [{"_d": "CASE WHEN mr < 0 THEN mr ELSE 0.0 END"}, {"market_downside_beta": div(total("r * _d", n), total("_d * _d", n))}]
    f["market_state"] = [{"market_state_return": "mr", "market_state_downside": pos("-mr"), "market_state_breadth": "up", "market_state_weak_breadth": "weak", "market_state_limit_down_rate": "ld", "market_state_limit_pressure": "lp", "market_state_downside_mean": "down_mean", "market_state_weak_breadth_mean": "weak_mean", "market_state_limit_pressure_mean": "lp_mean"}]
    f["breadth_resilience"] = [{"breadth_resilience": div(total("r * weak", n), total("weak", n))}]
    f["breadth_shock_residual_resilience"] = [{"_w": f"weak + {pos('up_lag - up')}", "_x": "r - mr"}, {"breadth_shock_residual_resilience": div(total("_x * _w", n), total("_w", n))}]
    f["limit_pressure_resilience"] = [{"limit_pressure_resilience": div(total("r * lp", n), total("lp", n))}]
    f["regime_conditioned"] = [{"_rk": ret(k)}, {"_rr": f"-(_rk - {E.at('median', '_rk')})", "_p": f"CASE WHEN r IS NOT NULL THEN ({clip('weak_mean / 0.5', 0, 1)} + {tanh('200 * down_mean')} + {clip('lp_mean / 0.2', 0, 1)}) / 3 END"}, {"market_regime_stress_probability": "_p", "regime_stress_reversal": "_rr * _p", "regime_stress_momentum": "-_rr * _p", "regime_calm_reversal": "_rr * (1 - _p)", "regime_switch_reversal": "_rr * (1 - 2 * _p)"}]
    fix = (n * (n - 1)) ** 0.5 / (n - 2)
    w = E.frame(n)
    f["return_skewness"] = [{"return_skewness": f"CASE WHEN count(r) {w} = {n} AND stddev_samp(r) {w} > 1e-12 THEN @SKEW(r) {w} * (CASE WHEN @SKEWFIX = 1 THEN {fix!r} ELSE 1.0 END) END"}]
    f["lottery_max"] = [{"_x": f"round({high(R, n)}, 10)"}, {"_rank": E.avg_rank("_x", "bar_time, (_x IS NULL)"), "_n": E.at("count", "_x")}, {"lottery_max": "CASE WHEN _x IS NULL THEN NULL WHEN _n = 1 THEN 0.5 ELSE 1 - (_rank - 1) / (_n - 1) END"}]
    f["price_position"] = [{"_lo": low(L, n), "_hi": high(H, n)}, {"range_position": f"{div(C + ' - _lo', '_hi - _lo')} - 0.5"}]
    f["range_volatility"] = [{"_x": f"CASE WHEN {L} > 0 THEN ln({H} / {L}) END"}, {"range_volatility": f"sqrt({mean('_x * _x', n)})"}]
    f["efficiency"] = [{"_d": f"abs({C} - {lag(C)})", "_t": f"abs({C} - {lag(C, n)})"}, {"efficiency_ratio": div("_t", total("_d", n))}]
    f["volume"] = [{"volume_ratio": f"{div(V, mean(V, n))} - 1"}]
    f["volume_distribution_shape"] = [{"_z": f"abs({div(f'{V} - ' + mean(V, n), std(V, n))})", "_b": total(V, h), "_c": div(total(f"{V} * {V}", n), f"{total(V, n)} * {total(V, n)}")}, {"_f": lag("_b", h)}, {"volume_burstiness": "_z", "volume_back_loaded": f"{div('_b', '_f + _b')} - 0.5", "volume_concentration": "_c", "volume_u_shape": "_z + _c"}]
    f["turnover"] = [{"turnover_ratio": f"{div(T, mean(T, n))} - 1", "turnover_zscore": div(f"{T} - {mean(T, n)}", std(T, n))}]
    f["turnover_stability"] = [{"_t": lnt}, {"turnover_stability": div(mean("_t", n), std("_t", n))}]
    f["liquidity_reliability"] = [{"_t": lnt}, {"liquidity_reliability": f"{mean('_t', n)} - {std('_t', n)}"}]
    rel = [{"_t": lnt}, {"_ml": mean("_t", l), "_sl": std("_t", l), "_mc": mean("_t", s), "_q": div(total("r_up", s), total("r_dn", s))}]
    f["liquidity_reliability_recovery"] = [*rel, {"liquidity_reliability_recovery": f"-(_ml - _sl) * {log1p(pos('_mc'))} * {clip(div('_mc', '_ml'), 0, 2)} * {log1p(pos('_q'))}"}]
    f["liquidity_reliability_recovery_balance"] = [*rel, {"_c": div("_mc", "_ml")}, {"liquidity_reliability_recovery_balance": f"{softplus('_sl - _ml')} * {log1p(pos('_mc'))} * {balance('_c')} * {balance('_q')}"}]
    f["microstructure_recovery_speed"] = [{a: b for x, w_ in (("s", s), ("l", l)) for a, b in ((f"_q{x}", div(total("r_up", w_), total("r_dn", w_))), (f"_r{x}", total("t_dn", w_ // 2)))}, {f"_p{x}": lag(f"_r{x}", w_ // 2) for x, w_ in (("s", s), ("l", l))}, {f"_v{x}": f"{log1p(pos(f'_q{x}'))} * (1 + {pos(div(f'_p{x} - _r{x}', f'_p{x} + _r{x}'))})" for x in "sl"}, {"microstructure_recovery_speed": "_vl", "microstructure_recovery_acceleration": "_vs - _vl"}]
    f["liquidity_impact"] = [{"amihud": div("abs(r)", T)}]
    f["intraday_gap"] = [{"gap": f"{div(O, lag(C))} - 1"}]
    f["vwap_deviation"] = [{"vwap_deviation": f"{div(C, div(total(T, n), total(V, n)))} - 1"}]
    f["money_flow"] = [{"_m": f"{V} * {div(f'2 * {C} - {H} - {L}', f'{H} - {L}')}"}, {"money_flow": div(total("_m", n), total(V, n))}]
    f["signed_turnover_imbalance"] = [{"signed_turnover_imbalance": div(total(f"sign(r) * {T}", n), total(T, n))}]
    f["order_flow_toxicity"] = [{"_sv": f"sign(r) * {V}"}, {"_lsv": lag("_sv"), "_ofi": div(total("_sv", n), total(V, n)), "_vp": div(f"abs({total('_sv', n)})", total(V, n))}, {"order_flow_imbalance": "_ofi", "vpin": "_vp", "adverse_selection": E.corr(R, "_lsv", n)}]
    f["intraday_quality"] = [{"_cost": div(f"abs({C} - {div(T, V)})", f"abs({H} - {L})"), "_dp": f"sign(r) * {div(f'{C} - {div(T, V)}', div(T, V))}", "_q8": quantile(T, n, 0.8)}, {"_big": f"CASE WHEN {T} >= _q8 THEN {T} ELSE 0.0 END", "_dc": clip("_cost", 0, 1)}, {"price_efficiency_cost": "_cost", "signed_trade_efficiency": "sign(r) * (1 - _dc)", "large_trade_cost": div(total("coalesce(_dp, 0.0) * _big", n), total("_big", n))}]
    f["return_turnover_correlation"] = [{"return_turnover_correlation": E.corr(R, T, n)}]
    f["daily_moving_average"] = []
    return f


NAMES = tuple(families())
KEYS = ("instrument_id", "bar_time")
#: Values far below 1, which are rounded to more digits.
SMALL = ("amihud",)


def inputs(bars: Plan, n: int = 6) -> Plan:
    """Steps shared by all families, ending in ``inputs``."""
    ts = "ORDER BY bar_time"
    return (
        bars.then("i1", f"SELECT *, {ret(1)} AS r FROM exec_bars")
        .then("i2", f"SELECT *, {E.at('median', 'r')} AS mr, {E.at('avg', 'CASE WHEN r > 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END')} AS up, {E.at('avg', 'CASE WHEN r < 0 THEN 1.0 WHEN r IS NOT NULL THEN 0.0 END')} AS dn, {E.at('avg', 'CASE WHEN coalesce(limit_up_open, TRUE) THEN 1.0 ELSE 0.0 END')} AS lu, {E.at('avg', 'CASE WHEN coalesce(limit_down_open, TRUE) THEN 1.0 ELSE 0.0 END')} AS ld FROM i1")
        .then("i3", f"SELECT *, {pos('0.5 - up')} AS weak, {pos('ld - lu')} AS lp, {pos('r')} AS r_up, {pos('-r')} AS r_dn, CASE WHEN r < 0 THEN {T} ELSE 0.0 END AS t_dn, CASE WHEN r > 0 THEN {T} ELSE 0.0 END AS t_up FROM i2")
        .then("market", f"SELECT bar_time AS mt, max(mr) AS m0, max(weak) AS m1, max(lp) AS m2, max(up) AS m3, max(lu) AS m4, max(ld) AS m5 FROM i3 GROUP BY bar_time".replace("bar_time AS mt", "bar_time"))
        .then("states", f"SELECT bar_time AS mt, {mean(pos('-m0'), n, by=ts)} AS down_mean, {mean('m1', n, by=ts)} AS weak_mean, {mean('m2', n, by=ts)} AS lp_mean, {mean('m2', n, shift=1, by=ts)} AS lp_lag, {mean('m3', n, shift=1, by=ts)} AS up_lag, {mean('m4', 1, shift=1, by=ts)} AS lu_lag, {mean('m5', 1, shift=1, by=ts)} AS ld_lag FROM market")
        .then("inputs", "SELECT * FROM i3 LEFT JOIN states ON i3.bar_time = states.mt")
    )


#: Columns of the daily moving averages from those of the step ``ma3``.
DAILY = {
    "daily_ma_deviation": "dev", "daily_ma_slope": "slope", "daily_ma_spread": "spread", "daily_ma_ribbon_position": "ribbon",
    "daily_ma_ribbon_dispersion": "dispersion", "daily_ma_ribbon_trend_score": "CAST(sign(spread) AS DOUBLE)",
}


def daily_steps(bars: Plan, short: int = 3, long: int = 6) -> Plan:
    """Moving averages of session closes, kept under the following session (mi, md)."""
    day = "PARTITION BY instrument_id ORDER BY trade_date"
    a, b = (mean("session_close", x, by=day) for x in (short, long))
    p = bars.then("ma", f"SELECT *, {a} AS ma_s, {b} AS ma_l FROM closes")
    p = p.then("ma2", f"SELECT *, {div('session_close', 'ma_s')} - 1 AS dev, {div('ma_s', lag('ma_s', by=day))} - 1 AS slope, {div('ma_s', 'ma_l')} - 1 AS spread, {div('session_close', '(ma_s + ma_l) / 2')} - 1 AS ribbon, CASE WHEN ma_s > 0 AND ma_l > 0 THEN abs(ln(ma_s) - ln(ma_l)) / 2 END AS dispersion FROM ma")
    cols = ("dev", "slope", "spread", "ribbon", "dispersion")
    return p.then("ma3", f"SELECT instrument_id AS mi, trade_date AS md, {', '.join(f'{lag(c, by=day)} AS {c}' for c in cols)} FROM ma2")


def daily_ma(bars: Plan) -> Plan:
    """Daily moving averages of completed sessions, attached to the next session's bars."""
    return daily_steps(bars).then("out", f"SELECT {E.out(*KEYS, **DAILY)} FROM exec_bars JOIN ma3 ON instrument_id = mi AND trade_date = md WHERE dev IS NOT NULL")


def _rounded(names: list[str]) -> str:
    small = [f"round(CAST({c} AS DOUBLE), 14) + 0.0 AS {c}" for c in names if c in SMALL]
    return ", ".join([E.out(*KEYS, **{c: c for c in names if c not in SMALL}), *small])


def _own_names(family: str, steps: list[dict[str, str]]) -> list[dict[str, str]]:
    """The steps with inner names that no other family uses."""
    inner = {c for step in steps[:-1] for c in step} | {c for c in steps[-1] if c.startswith("_")}
    if not inner:
        return steps
    word = re.compile(rf"\b({'|'.join(sorted(inner, key=len, reverse=True))})\b")
    own = lambda x: word.sub(rf"{family}__\1", x)
    return [{own(c): own(e) for c, e in step.items()} for step in steps]


def together(bars: Plan, names: tuple[str, ...] | list[str] = NAMES, **windows: int) -> Plan:
    """Rows (instrument_id, bar_time, feature columns) of several families in one plan.

    The shared inputs are computed once, and the i-th steps of all families are one SELECT, whose windows over the same
    partition share a sort.  Rows without any feature are dropped.
    """
    unknown = [x for x in names if x not in NAMES]
    if unknown or not names:
        raise ValueError(f"unknown feature families {unknown!r}" if unknown else "no feature family given")
    steps = [_own_names(x, families(**windows)[x]) for x in dict.fromkeys(names) if x != "daily_moving_average"]
    columns, source = [c for one in steps for c in one[-1]], "inputs"
    p = inputs(bars, windows.get("n", 6))
    for i in range(max((len(one) for one in steps), default=0)):
        layer = [f"{e} AS {c}" for one in steps if i < len(one) for c, e in one[i].items()]
        p, source = p.then(f"f{i}", f"SELECT *, {', '.join(layer)} FROM {source}"), f"f{i}"
    if "daily_moving_average" in names:
        p = daily_steps(p)
        p, source = p.then("averaged", f"SELECT {source}.*, {', '.join(f'{e} AS {c}' for c, e in DAILY.items())} FROM {source} LEFT JOIN ma3 ON instrument_id = mi AND trade_date = md"), "averaged"
        columns += DAILY
    return p.then("out", f"SELECT {_rounded(columns)} FROM {source} WHERE {' OR '.join(f'{c} IS NOT NULL' for c in columns)}")


def plan(bars: Plan, family: str, **windows: int) -> Plan:
    """Rows (instrument_id, bar_time, feature columns) of a family; rows without any feature are dropped."""
    if family not in NAMES:
        raise ValueError(f"unknown feature family {family!r}")
    return daily_ma(bars) if family == "daily_moving_average" else together(bars, [family], **windows)
