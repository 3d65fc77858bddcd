"""DuckDB SQL for queries on bars, written from the raw tables: bars, flags, features, labels and scores are built anew here.

Nothing is shared with the plans that the queries run: names, steps and formulas are this module's own.  Each query lists the
steps that it needs; ``sql`` puts those and what they build on before it.
"""

from __future__ import annotations

import re

_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_PRICES = f"""first(p ORDER BY {_ORDER}) AS o, max(p) AS h, min(p) AS l, last(p ORDER BY {_ORDER}) AS c, CAST(sum(l_quantity) AS DOUBLE) AS v, CAST(sum(l_extendedprice) AS DOUBLE) AS m"""
_LINES = "(SELECT *, CAST(l_extendedprice / l_quantity AS DOUBLE) AS p FROM lineitem WHERE l_quantity > 0)"
_W = "PARTITION BY i ORDER BY t"
_FEATURES = ("f1", "f2", "f3")


def _flags(x: str) -> dict[str, str]:
    return {
        f"{x}_day": f"SELECT i, d, last(c ORDER BY t) AS close_of_day FROM {x} GROUP BY i, d",
        f"{x}_old": f"SELECT i, d, lag(close_of_day) OVER (PARTITION BY i ORDER BY d) AS pc FROM {x}_day",
        f"{x}_x": f"SELECT b.*, y.pc, v <= 0 OR m <= 0 AS halted, coalesce(pc > 0 AND o >= 1.098::DOUBLE * pc, FALSE) AS up, coalesce(pc > 0 AND o <= 0.902::DOUBLE * pc, FALSE) AS down, o > 0 AND c > 0 AND v > 0 AND m > 0 AND NOT st AS ok FROM {x} b JOIN {x}_old y USING (i, d)",
    }


def _place(x: str, part: str, desc: str = "") -> str:
    """Average rank."""
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x} {desc}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


def _pearson(x: str, y: str) -> str:
    return f"CASE WHEN count(*) > 1 AND stddev_pop({x}) * stddev_pop({y}) > 1e-14 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


def _mean(x: str, rows: str, least: int, by: str) -> str:
    return f"CASE WHEN count({x}) OVER ({by} ROWS BETWEEN {rows}) >= {least} THEN avg({x}) OVER ({by} ROWS BETWEEN {rows}) END"


def _lin(x: str, a: float) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN greatest(0.0, least(1.0, (({x}) + {a}) / {2 * a})) END)"


_RANKED = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN {_place(f, f't, {f} IS NULL')} / count({f}) OVER (PARTITION BY t) - 0.5 END AS r{k}, ({f} - avg({f}) OVER (PARTITION BY t)) / nullif(stddev_pop({f}) OVER (PARTITION BY t), 0) AS z{k}" for k, f in enumerate(_FEATURES, 1))
_SHARES = {1: 0.5, 2: 0.3, 3: 0.2}


def _composite(c: str) -> str:
    top, bottom = (" + ".join(f"CASE WHEN {c}{k} IS NULL THEN 0 ELSE {v.format(w=w, x=f'{c}{k}')} END" for k, w in _SHARES.items()) for v in ("{w} * {x}", "{w}"))
    return f"round(({top}) / nullif({bottom}, 0), 10)"


_IC = "PARTITION BY feature ORDER BY t"
_PAST = "13 PRECEDING AND 2 PRECEDING"
STEPS = {
    "wb": f"SELECT CAST(l_suppkey AS VARCHAR) AS i, CAST(date_trunc('week', l_shipdate) AS DATE) AS t, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, FALSE AS st, {_PRICES} FROM {_LINES} GROUP BY 1, 2",
    "db": f"SELECT p_brand AS i, CAST(l_shipdate AS DATE) AS t, CAST(l_shipdate AS DATE) AS d, p_brand LIKE '%5' AS st, {_PRICES} FROM {_LINES} JOIN part ON p_partkey = l_partkey GROUP BY 1, 2",
    "hb": "SELECT event_type AS i, date_trunc('hour', ts) AS t, CAST(min(ts) AS DATE) AS d, FALSE AS st, first(value ORDER BY ts) AS o, max(value) AS h, min(value) AS l, last(value ORDER BY ts) AS c, CAST(count(*) AS DOUBLE) AS v, CAST(sum(value) AS DOUBLE) AS m FROM events GROUP BY 1, 2",
    **_flags("wb"), **_flags("db"),
    "lb": f"SELECT *, lead(c) OVER w AS en, lead(t) OVER w AS ent, lead(c, 2) OVER w / nullif(lead(c) OVER w, 0) - 1 AS y, lead(t, 2) OVER w AS xt, lead(c, 5) OVER w / nullif(lead(c) OVER w, 0) - 1 AS y4, lead(ok) OVER w AS eok, lead(up) OVER w AS eup, lead(ok AND NOT down, 2) OVER w AS xok FROM wb_x WINDOW w AS ({_W})",
    "pn": f"SELECT i, t, c, v, m, xt, round(y, 10) AS y, round(y4, 10) AS y4, round(1 - c / nullif(lag(c) OVER w, 0), 10) AS f1, round(c / nullif(lag(c, 4) OVER w, 0) - 1, 10) AS f2, round(v / nullif({_mean('v', '3 PRECEDING AND CURRENT ROW', 4, _W)}, 0) - 1, 10) AS f3 FROM lb WINDOW w AS ({_W})",
    "ux": " UNION ALL ".join(f"SELECT '{f}' AS feature, i, t, {f} AS x, y, y4 FROM pn WHERE {f} IS NOT NULL" for f in _FEATURES),
    "uy": f"SELECT *, {_place('x', 'feature, t')} AS rx, {_place('y', 'feature, t')} AS ry, row_number() OVER (PARTITION BY feature, t ORDER BY x DESC, i) AS hi, row_number() OVER (PARTITION BY feature, t ORDER BY x, i) AS lo, count(*) OVER (PARTITION BY feature, t) AS n FROM ux WHERE y IS NOT NULL",
    "ic": f"SELECT feature, t, count(*) AS n, {_pearson('x', 'y')} AS ic, {_pearson('rx', 'ry')} AS ric, avg(y) FILTER (hi <= 5) AS top, avg(y) FILTER (lo <= 5) AS bot, avg(y) FILTER (hi <= 5) - avg(y) FILTER (lo <= 5) AS sp FROM uy GROUP BY feature, t",
    "qn": "SELECT feature, t, CAST(ceil(5.0 * lo / n) AS BIGINT) AS b, count(*) AS k, avg(y) AS a FROM uy GROUP BY 1, 2, 3",
    "s0": f"SELECT *, {_RANKED} FROM pn",
    "sc": f"SELECT *, row_number() OVER (PARTITION BY t ORDER BY s DESC, i) AS pl FROM (SELECT *, {_composite('r')} AS s, {_composite('z')} AS z FROM s0) q WHERE s IS NOT NULL",
    "bk": "SELECT *, 1.0 / count(*) OVER (PARTITION BY t) AS w FROM sc WHERE pl <= 5",
    "tm": "SELECT t, lead(t) OVER (ORDER BY t) AS nt FROM (SELECT DISTINCT t FROM sc) q",
    "od": "SELECT t, i, sum(h) AS h, sum(w) AS w, sum(w) - sum(h) AS dl FROM (SELECT t, i, w, 0.0 AS h FROM bk UNION ALL SELECT nt, i, 0.0, w FROM bk JOIN tm USING (t) WHERE nt IS NOT NULL) q GROUP BY t, i",
    "tb": "SELECT t, lead(t) OVER (ORDER BY t) AS xt FROM (SELECT DISTINCT t FROM wb) q",
    "xe": "SELECT tb.xt, od.i, w, dl, e.o, coalesce(ok, FALSE) AS ok, coalesce(up, FALSE) AS up, coalesce(down, FALSE) AS down FROM od JOIN tb ON tb.t = od.t AND tb.xt IS NOT NULL LEFT JOIN wb_x e ON e.t = tb.xt AND e.i = od.i",
    "hl": f"SELECT feature, t, {_mean('ric', _PAST, 4, _IC)} AS a, {_mean('sp', _PAST, 4, _IC)} AS b FROM ic",
    "cb": f"SELECT *, CAST(greatest(1, ceil(5 * {_place('s', 't')} / count(*) OVER (PARTITION BY t))) AS BIGINT) AS b FROM sc",
    "cs": "SELECT t, b, avg(y) AS a, stddev_pop(y) AS sd FROM cb GROUP BY t, b",
    "ce": f"SELECT t, b, {_mean('a', _PAST, 4, 'PARTITION BY b ORDER BY t')} AS edge, {_mean('sd', _PAST, 4, 'PARTITION BY b ORDER BY t')} AS risk FROM cs",
    "bl": f"SELECT *, {_place('s', 't')} / count(*) OVER (PARTITION BY t) AS p1, {_place('z', 't')} / count(z) OVER (PARTITION BY t) AS p2 FROM sc",
    "mw": "SELECT t, stddev_samp(f1) AS vol, avg((coalesce(f1, 0) < 0)::INT) AS br FROM sc GROUP BY t HAVING count(f1) > 0",
    "mv": "SELECT *, lag(vol) OVER (ORDER BY t) AS v, lag(br) OVER (ORDER BY t) AS b FROM mw",
    "mq": "SELECT *, CASE WHEN count(v) OVER k >= 8 THEN quantile_cont(v, 0.75) OVER k END AS v75, CASE WHEN count(b) OVER k >= 8 THEN quantile_cont(b, 0.25) OVER k END AS b25 FROM mv WINDOW k AS (ORDER BY t ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)",
    "mr": "SELECT t, CASE WHEN v75 IS NULL OR b25 IS NULL THEN 'warmup' WHEN round(v, 9) >= round(v75, 9) OR round(b, 9) <= round(b25, 9) THEN 'stress' ELSE 'normal' END AS regime FROM mq",
    "pr": "SELECT t, greatest(-0.2, least(0.2, sum(w * coalesce(y, 0)))) AS ret FROM bk GROUP BY t",
    "eq": "SELECT t, exp(sum(ln(1 + ret)) OVER (ORDER BY t)) AS e FROM pr",
    "dd": "SELECT t, e, e / greatest(1.0, max(e) OVER (ORDER BY t)) - 1 AS dd FROM eq",
    "zz": "SELECT *, row_number() OVER (PARTITION BY t ORDER BY z DESC, i) AS zp FROM sc",
    "di": "SELECT t, y, CASE WHEN pl <= 5 AND zp <= 5 THEN 'both' WHEN pl <= 5 THEN 'removed' ELSE 'added' END AS side FROM zz WHERE pl <= 5 OR zp <= 5",
    "fc": "SELECT *, abs(coalesce(0.5 * r1, 0)) AS c1, abs(coalesce(0.3 * r2, 0)) AS c2, abs(coalesce(0.2 * r3, 0)) AS c3 FROM sc WHERE pl <= 5",
}


def _r(x: str, name: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {name}"


_K = "t AS bar_time, i AS instrument_id"
_REASON = "CASE WHEN o IS NULL THEN 'missing_price' WHEN NOT ok THEN 'non_tradable' WHEN dl > 0 AND up THEN 'limit_up_buy_blocked' WHEN dl < 0 AND down THEN 'limit_down_sell_blocked' WHEN abs(dl) < 0.01 THEN 'below_min_trade_weight' ELSE 'filled' END"
_BARS = f"SELECT {_K}, o AS open_price, h AS high_price, l AS low_price, c AS close_price, {_r('v', 'volume')}, {_r('m', 'turnover')} FROM"
QUERIES = {
    "bars_weekly": f"{_BARS} wb", "bars_daily": f"{_BARS} db", "bars_hourly": f"{_BARS} hb",
    "kline_daily": "SELECT i AS instrument_id, d AS trade_date, first(o ORDER BY t) AS open_price, max(h) AS high_price, min(l) AS low_price, last(c ORDER BY t) AS close_price, round(sum(v), 6) AS volume, round(sum(m), 4) AS turnover, count(*) AS bars FROM hb GROUP BY i, d",
    "max_symbols": f"SELECT {_K}, {_r('c', 'close_price')} FROM wb WHERE (SELECT count(DISTINCT i) FROM wb q WHERE q.i < wb.i) < 10",
    "exec_columns": f"SELECT {_K}, st AS is_st, halted AS suspended_bar, ok AS tradable_bar, ok AND NOT up AS buyable_bar, ok AND NOT down AS sellable_bar FROM db_x",
    "limit_flags": f"SELECT {_K}, up AS limit_up_open, down AS limit_down_open FROM db_x",
    "prev_close": f"SELECT {_K}, pc AS previous_close FROM db_x",
    "active_on": "SELECT o_custkey AS instrument_id, a AS effective_from, CASE WHEN k <= 10 THEN b END AS effective_to FROM (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) AS k FROM orders GROUP BY 1) q WHERE a <= TIMESTAMP '1996-06-01' AND (k > 10 OR b >= TIMESTAMP '1996-06-01')",
    "liquidity_filter": f"SELECT * FROM (SELECT {_K}, {_r(_mean('m', '3 PRECEDING AND CURRENT ROW', 4, _W), 'liquidity')} FROM wb) q WHERE liquidity >= 50000",
    "asof_fundamentals": "SELECT o_custkey AS instrument_id, o_orderdate AS visible_at, CAST(max(o_totalprice) AS DOUBLE) AS value FROM orders q WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders z WHERE z.o_custkey = q.o_custkey AND z.o_orderdate <= TIMESTAMP '1997-01-01') GROUP BY 1, 2",
    "label_forward": f"SELECT {_K}, ent AS entry_time, xt AS exit_time, {_r('y', 'label')} FROM lb WHERE y IS NOT NULL",
    "label_multi": f"SELECT {_K}, {_r('y', 'label')}, {_r('y4', 'label_4')} FROM lb WHERE y IS NOT NULL AND y4 IS NOT NULL",
    "label_rank": f"SELECT {_K}, {_r(_place('y', 't', 'DESC') + ' / count(*) OVER (PARTITION BY t)', 'label_rank')} FROM pn WHERE y IS NOT NULL",
    "entry_exit_filter": f"SELECT {_K}, {_r('y', 'label')} FROM lb WHERE y IS NOT NULL AND eok AND NOT eup AND xok",
    "entry_exit_counts": "SELECT count(*) AS n_rows, count(*) - count(*) FILTER (eok) AS n_entry_blocked, count(*) FILTER (eup) AS n_limit_up, count(*) - count(*) FILTER (xok) AS n_exit_blocked FROM lb WHERE y IS NOT NULL",
    "join_features_labels": f"SELECT {_K}, {', '.join(_r(f, f) for f in _FEATURES)}, {_r('y', 'label')} FROM pn WHERE f1 IS NOT NULL AND y IS NOT NULL",
    "sample_rows": "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS k FROM orders) q WHERE k <= 100",
    "alpha_matrix": f"SELECT {_K}, {', '.join(_r(f, f'm_{f}') for f in _FEATURES)} FROM pn WHERE y IS NOT NULL AND coalesce(f1, f2, f3) IS NOT NULL",
    "ic_by_ts": f"SELECT feature, t AS bar_time, n, {_r('ic', 'ic')}, {_r('ric', 'rank_ic')} FROM ic",
    "topn_spread": f"SELECT feature, t AS bar_time, {_r('top', 'top_label')}, {_r('bot', 'bottom_label')}, {_r('sp', 'spread')} FROM ic",
    "rank_autocorr": f"SELECT feature, t AS bar_time, {_r(_pearson('a', 'b'), 'autocorr')} FROM (SELECT q.feature, q.t, {_place('q.x', 'q.feature, q.t')} AS a, {_place('z.x', 'q.feature, q.t')} AS b FROM uy q JOIN (SELECT feature, t, lag(t) OVER ({_IC}) AS pt FROM ic) k ON k.feature = q.feature AND k.t = q.t JOIN uy z ON z.feature = q.feature AND z.t = k.pt AND z.i = q.i) w GROUP BY 1, 2",
    "quantile_returns": f"SELECT feature, b AS bucket, {_r('avg(a)', 'mean_label')}, {_r('avg(k)', 'mean_size')} FROM qn GROUP BY 1, 2",
    "quantile_long_short": f"SELECT feature, {_r('avg(d)', 'long_short')} FROM (SELECT feature, t, sum(a) FILTER (b = 5) - sum(a) FILTER (b = 1) AS d FROM qn GROUP BY 1, 2) q GROUP BY 1",
    "decay": f"SELECT feature, horizon, {_r('avg(ic)', 'ic_mean')}, {_r('stddev_samp(ic)', 'ic_std')} FROM (SELECT feature, horizon, t, {_pearson('a', 'b')} AS ic FROM (SELECT feature, horizon, t, {_place('x', 'feature, horizon, t')} AS a, {_place('g', 'feature, horizon, t')} AS b FROM (SELECT feature, t, x, unnest(['label', 'label_4']) AS horizon, unnest([y, y4]) AS g FROM ux) q WHERE g IS NOT NULL) z GROUP BY 1, 2, 3) k GROUP BY 1, 2",
    "group_ic": f"SELECT feature, grp, {_r('avg(c)', 'ic_mean')} FROM (SELECT feature, grp, t, {_pearson('a', 'b')} AS c FROM (SELECT feature, t, CAST(i AS BIGINT) % 3 AS grp, {_place('x', 'feature, t, CAST(i AS BIGINT) % 3')} AS a, {_place('y', 'feature, t, CAST(i AS BIGINT) % 3')} AS b FROM uy) q GROUP BY 1, 2, 3) k GROUP BY 1, 2",
    "yearly_ic": "SELECT feature, count(*) AS years, count(*) FILTER (sign(a) = sign(w)) AS stable_years FROM (SELECT feature, year(t) AS yy, avg(ric) AS a, any_value(w) AS w FROM (SELECT *, avg(ric) OVER (PARTITION BY feature) AS w FROM ic) q GROUP BY 1, 2) k GROUP BY 1",
    "opportunity_map": "SELECT feature, CASE WHEN avg(top) > 0 AND avg(ric) > 0 THEN 'long_alpha_candidate' WHEN avg(bot) < 0 THEN 'bottom_avoidance_only' WHEN abs(avg(ric)) >= 0.01 THEN 'risk_gate_only' ELSE 'dead_zone' END AS opportunity FROM ic GROUP BY 1",
    "signal_identity": f"SELECT {_K}, {_r('f1', 'signal')} FROM pn WHERE f1 IS NOT NULL",
    "signal_rank": f"SELECT {_K}, {_r(_place('f1', 't') + ' / count(*) OVER (PARTITION BY t)', 'signal')} FROM pn WHERE f1 IS NOT NULL",
    "weights_equal": f"SELECT {_K}, {_r('w', 'weight')} FROM bk",
    "strategy_topn": f"SELECT {_K}, pl AS book_rank, {_r('s', 'score')}, {_r('w', 'target_weight')} FROM bk",
    "rebalance_orders": f"SELECT {_K}, {_r('h', 'current_weight')}, {_r('w', 'target_weight')}, {_r('dl', 'delta')} FROM od",
    "portfolio_turnover": f"SELECT t AS bar_time, {_r('sum(abs(dl)) / 2', 'turnover')}, count(*) FILTER (dl > 1e-12) AS buys, count(*) FILTER (dl < -1e-12) AS sells FROM od GROUP BY t",
    "composite_rank": f"SELECT {_K}, pl AS score_rank, {_r('s', 'score')} FROM sc",
    "composite_zscore": f"SELECT {_K}, {_r('z', 'zscore')} FROM sc",
    "contribution_diag": f"SELECT t AS bar_time, {_r('sum(c1 + c2 + c3)', 'total')}, {_r('sum(c1) / nullif(sum(c1 + c2 + c3), 0)', 'share_1')}, {_r('greatest(sum(c1), sum(c2), sum(c3)) / nullif(sum(c1 + c2 + c3), 0)', 'largest')} FROM fc GROUP BY t",
    "health_states": "SELECT feature, count(*) AS n, count(*) FILTER (a IS NULL OR b IS NULL) AS warmup FROM hl GROUP BY feature",
    "health_ensemble": "SELECT feature, t AS bar_time, " + ", ".join(_r(f"{f}([coalesce(s6, 1), coalesce(s12, 1), coalesce(s24, 1)])", n) for f, n in (("list_avg", "s_mean"), ("list_min", "s_min"), ("list_max", "s_max"))) + " FROM (SELECT feature, t, " + ", ".join(f"{_lin(_mean('ric', f'{w + 1} PRECEDING AND 2 PRECEDING', 4, _IC), 0.05)} AS s{w}" for w in (6, 12, 24)) + " FROM ic) q",
    "score_calibration": f"SELECT t AS bar_time, b AS bucket, edge IS NULL AS warmup, {_r('10000 * coalesce(edge, 0)', 'edge_bps')}, {_r('10000 * coalesce(risk, 0)', 'risk_bps')} FROM ce",
    "calibration_apply": f"SELECT cb.t AS bar_time, i AS instrument_id, cb.b AS bucket, {_r('10000 * coalesce(edge, 0)', 'edge_bps')} FROM cb JOIN ce ON ce.t = cb.t AND ce.b = cb.b",
    "score_blend": f"SELECT {_K}, {_r('0.7 * p1 + 0.3 * p2', 'score')} FROM bl",
    "overlay_downside": f"SELECT {_K}, {_r('s - 0.2 * greatest(0.2 - p2, 0)', 'score')} FROM bl",
    "overlay_exclusion": f"SELECT {_K}, round(p2, 9) > 0.1 AS entry_eligible FROM bl",
    "overlay_daily_first": f"SELECT {_K}, {_r('c', 'close_price')} FROM (SELECT *, row_number() OVER (PARTITION BY i, d ORDER BY t) AS k FROM hb) q WHERE k = 1",
    "primary_pool": f"SELECT {_K}, row_number() OVER (PARTITION BY t ORDER BY z DESC, i) AS pool_rank, {_r('z', 'zscore')} FROM sc WHERE pl <= 20",
    "every_nth": f"SELECT {_K}, {_r('s', 'score')} FROM sc JOIN (SELECT t, row_number() OVER (ORDER BY t) AS k FROM tm) n USING (t) WHERE k % 4 = 1 AND pl <= 5",
    "next_bar_exec": f"SELECT xt AS exec_time, i AS instrument_id, ok AS tradable_bar, {_r('w', 'target_weight')}, {_r('o', 'open_price')} FROM xe",
    "exec_counts": "SELECT count(*) AS n_rows, count(*) FILTER (NOT ok) AS non_tradable, count(*) FILTER (up AND dl > 0) AS limit_up_buys, count(*) FILTER (down AND dl < 0) AS limit_down_sells, count(*) - count(o) AS missing_price FROM xe",
    "exec_events": f"SELECT {_REASON} AS reason, count(*) AS n, round(sum(abs(dl)), 6) AS amount FROM xe GROUP BY 1",
    "trade_metrics": f"SELECT {_r('sum(greatest(dl, 0))', 'buy')}, {_r('-sum(least(dl, 0))', 'sell')}, {_r('sum(abs(dl))', 'gross')}, {_r('0.0013 * sum(abs(dl))', 'cost')} FROM xe WHERE ok",
    "drawdown": f"SELECT t AS bar_time, {_r('dd', 'drawdown')}, {_r('ln(e)', 'log_equity')} FROM dd",
    "monthly_perf": f"SELECT y, m, {_r('e / coalesce(lag(e) OVER (ORDER BY y, m), 1) - 1', 'ret')}, {_r('w', 'drawdown')} FROM (SELECT year(t) AS y, month(t) AS m, last(e ORDER BY t) AS e, min(dd) AS w FROM dd GROUP BY 1, 2) q",
    "displacement": "WITH g AS (SELECT year(t) AS y, side, y AS v FROM di) " + " UNION ALL ".join(f"SELECT {a} AS y, {b} AS side, count(*) AS n, round(avg(v), 6) + 0.0 AS mean_label FROM g{f' GROUP BY {k}' if k else ''}" for a, b, k in (("NULL", "NULL", ""), ("y", "NULL", "g.y"), ("NULL", "side", "g.side"), ("y", "side", "g.y, g.side"))),
    "set_overlap": f"SELECT t AS bar_time, {_r('avg((side = \'both\')::INT)', 'overlap')} FROM di GROUP BY t",
    "leg_payoff": f"SELECT regime, {_r('avg(y) FILTER (pl <= 5)', 'top_mean')}, {_r('avg(y)', 'all_mean')}, count(*) AS n FROM sc JOIN mr USING (t) WHERE y IS NOT NULL GROUP BY regime",
    "leaderboard": f"SELECT feature, {_r('avg(a)', 'mean_spread')}, {_r('min(a)', 'worst')}, {_r('sum(a)', 'total')}, rank() OVER (ORDER BY round(avg(a), 9) DESC) AS place FROM (SELECT feature, year(t) AS yy, avg(sp) AS a FROM ic GROUP BY 1, 2) q GROUP BY feature",
    "residual_risk": f"SELECT year(t) AS y, {_r('sum(y * v) / nullif(sum(v), 0)', 'weighted_mean')}, {_r('avg((y < 0)::INT)', 'share_below')} FROM sc WHERE pl <= 5 AND y IS NOT NULL GROUP BY year(t)",
    "event_metrics": f"SELECT t AS bar_time, {_r('avg(f3)', 'f_mean')}, {_r('stddev_samp(f3)', 'f_std')}, {_r('quantile_cont(f3, 0.1)', 'f_p10')}, {_r('quantile_cont(f3, 0.9)', 'f_p90')}, {_r('median(f1)', 'r_median')} FROM pn WHERE f1 IS NOT NULL AND f3 IS NOT NULL GROUP BY t",
    "signal_threshold": f"SELECT {_K}, CASE WHEN f1 >= 0.05 THEN 1.0 ELSE -1.0 END AS signal FROM pn",
}


def _needed(text: str) -> list[str]:
    """Steps that a text builds on, in order."""
    found: set[str] = set()
    todo = [text]
    while todo:
        names = {n for n in re.findall(r"(?:FROM|JOIN)\s+(\w+)", todo.pop()) if n in STEPS} - found
        found |= names
        todo += [STEPS[n] for n in names]
    return [n for n in STEPS if n in found]


def with_steps(text: str) -> str:
    """A text with the steps that it builds on before it."""
    head = ",\n".join(f"{n} AS ({STEPS[n]})" for n in _needed(text))
    if not head:
        return text
    return f"WITH {head},\n{text.removeprefix('WITH ')}" if text.startswith("WITH ") else f"WITH {head}\n{text}"


def sql() -> dict[str, str]:
    return {name: with_steps(text) for name, text in QUERIES.items()}
