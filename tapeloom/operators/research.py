"""Research operators on a bar panel: labels, splits, evaluation, scores, schedules, gates and portfolio steps.

All are plans over weekly supplier bars unless noted.  ``PANEL`` holds three features and the forward return of each
(bar_time, instrument_id); evaluation unpivots the features once.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.columns import SECTIONS, across
from ..functions.expr import avg_rank, clip, div, lag, lead, mean, pct_rank
from ..plans.sql import Plan
from ..sources import bars as B

FEATURES = ("f1", "f2", "f3")
TOP = 5
TS = "ORDER BY bar_time"


def weekly() -> Plan:
    return B.executable(B.weekly())


def labelled() -> Plan:
    """Bars with entry one bar ahead and exits one and four bars later, from one window."""
    p = weekly().then("l1", f"SELECT *, {lead('close_price', 1)} AS entry_price, {lead('bar_time', 1)} AS entry_time, {lead('close_price', 2)} AS exit_1, {lead('bar_time', 2)} AS exit_time, {lead('close_price', 5)} AS exit_4, {lead('tradable_bar', 1)} AS entry_tradable, {lead('limit_up_open', 1)} AS entry_limit_up, {lead('sellable_bar', 2)} AS exit_sellable FROM exec_bars")
    return p.then("labels", f"SELECT *, {div('exit_1', 'entry_price')} - 1 AS label, {div('exit_4', 'entry_price')} - 1 AS label_4 FROM l1")


def panel() -> Plan:
    f = {"f1": f"-({div('close_price', lag('close_price'))} - 1)", "f2": f"{div('close_price', lag('close_price', 4))} - 1", "f3": f"{div('volume', mean('volume', 4))} - 1"}
    p = labelled().then("p1", f"SELECT *, {', '.join(f'round({e}, 10) AS {n}' for n, e in f.items())} FROM labels")
    return p.then("panel", "SELECT bar_time, instrument_id, f1, f2, f3, round(label, 10) AS label, round(label_4, 10) AS label_4, exit_time, close_price, volume, turnover, buyable_bar, sellable_bar FROM p1")


def weekly_over(plan: Plan, spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    """A plan over weekly bars alone, whose lines move once; of all instruments or of ``names``."""
    at = [n for n, _ in plan.steps].index("exec_bars")
    return B.weekly_rows(spark, folder, names, plan.steps[at + 1 :])


def unpivoted(label: str = "label") -> Plan:
    """Rows (feature, bar_time, instrument_id, x, y) with both values."""
    each = " UNION ALL ".join(f"SELECT '{f}' AS feature, bar_time, instrument_id, {f} AS x, {label} AS y, volume FROM panel" for f in FEATURES)
    return panel().then("u0", each).then("u", "SELECT * FROM u0 WHERE x IS NOT NULL AND y IS NOT NULL")


_GROUP = "feature, bar_time"


def ranked(label: str = "label") -> Plan:
    return unpivoted(label).then("rk", f"SELECT *, {avg_rank('x', _GROUP)} AS rx, {avg_rank('y', _GROUP)} AS ry, row_number() OVER (PARTITION BY {_GROUP} ORDER BY x DESC, instrument_id) AS top_rank, row_number() OVER (PARTITION BY {_GROUP} ORDER BY x, instrument_id) AS bottom_rank, count(*) OVER (PARTITION BY {_GROUP}) AS n FROM u")


def _corr(x: str, y: str) -> str:
    sd = f"stddev_pop({x}) * stddev_pop({y})"
    return f"CASE WHEN count(*) >= 2 AND {sd} > 1e-14 THEN covar_pop({x}, {y}) / ({sd}) END"


def by_timestamp(label: str = "label") -> Plan:
    """Per feature and timestamp: Pearson and rank IC, top and bottom label means, spread."""
    top, bottom = (f"avg(CASE WHEN {s}_rank <= {TOP} THEN y END)" for s in ("top", "bottom"))
    return ranked(label).then("bt", f"SELECT feature, bar_time, count(*) AS n, {_corr('x', 'y')} AS ic, {_corr('rx', 'ry')} AS rank_ic, {top} AS top_label, {bottom} AS bottom_label, {top} - {bottom} AS spread FROM rk GROUP BY feature, bar_time")


def _turnover(p: Plan) -> Plan:
    """Share of a feature's top names that weren't in its previous top set."""
    p = p.then("times", "SELECT feature, bar_time, lag(bar_time) OVER (PARTITION BY feature ORDER BY bar_time) AS prev FROM (SELECT DISTINCT feature, bar_time FROM rk) d")
    p = p.then("tops", f"SELECT feature, bar_time, instrument_id FROM rk WHERE top_rank <= {TOP}")
    return p.then("tv", "SELECT t.feature, t.bar_time, CASE WHEN max(m.prev) IS NOT NULL THEN 1 - count(o.instrument_id) / CAST(count(*) AS DOUBLE) END AS turnover FROM tops t JOIN times m ON t.feature = m.feature AND t.bar_time = m.bar_time LEFT JOIN tops o ON o.feature = m.feature AND o.bar_time = m.prev AND o.instrument_id = t.instrument_id GROUP BY t.feature, t.bar_time")


def _summary(source: str = "bt", key: str = "feature") -> str:
    return f"SELECT {key}, count(rank_ic) AS n_ts, avg(rank_ic) AS ic_mean, stddev_samp(rank_ic) AS ic_std, {div('avg(rank_ic)', 'stddev_samp(rank_ic)')} AS ir, {div('avg(rank_ic)', 'stddev_samp(rank_ic)')} * sqrt(count(rank_ic)) AS t_stat, avg(CASE WHEN round(rank_ic, 10) > 0 THEN 1.0 WHEN rank_ic IS NOT NULL THEN 0.0 END) AS hit_rate, avg(spread) AS spread_mean FROM {source} GROUP BY {key}"


def scores() -> Plan:
    """Composite of oriented feature ranks with fixed weights over the features a row has."""
    ranks = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN {pct_rank(f, f'bar_time, ({f} IS NULL)')} - 0.5 END AS r_{f}" for f in FEATURES)
    z = ", ".join(f"{div(f'{f} - avg({f}) OVER (PARTITION BY bar_time)', f'nullif(stddev_pop({f}) OVER (PARTITION BY bar_time), 0)')} AS z_{f}" for f in FEATURES)
    w = {"f1": 0.5, "f2": 0.3, "f3": 0.2}
    sum_ = lambda t: div(" + ".join(f"coalesce({w[f]} * {t}_{f}, 0)" for f in FEATURES), " + ".join(f"CASE WHEN {t}_{f} IS NOT NULL THEN {w[f]} ELSE 0 END" for f in FEATURES))
    p = panel().then("s1", f"SELECT *, {ranks}, {z} FROM panel")
    p = p.then("s2", f"SELECT *, round({sum_('r')}, 10) AS score, round({sum_('z')}, 10) AS zscore FROM s1")
    return p.then("scored", "SELECT *, row_number() OVER (PARTITION BY bar_time ORDER BY score DESC, instrument_id) AS score_rank FROM s2 WHERE score IS NOT NULL")


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the step ``scored`` above, with a stage for each feature's ranks and z-scores instead of one for all."""
    rows = panel().over(spark, folder)
    for i, f in enumerate(FEATURES):
        rows = across(rows, f, "bar_time", rank=f"p_{f}", z=f"z_{f}", turn=i).withColumn(f"r_{f}", F.col(f"p_{f}") - 0.5).drop(f"p_{f}")
    after = scores().steps
    s2, last = (next(s for n, s in after if n == name) for name in ("s2", "scored"))
    return Plan((("s1", "SELECT * FROM {s1_rows}"), ("s2", s2), ("s3", f"SELECT /*+ REPARTITION({SECTIONS}, bar_time, bar_time) */ * FROM s2"), ("scored", last.replace("FROM s2", "FROM s3")))).run(spark, s1_rows=rows)


def blended(spark: SparkSession, folder: str, nulls_first: bool = True) -> DataFrame:
    """Scored rows with the percentile ranks p1 of the score and p2 of the z-score; a missing one ranks lowest or has none."""
    return across(across(scored(spark, folder), "score", "bar_time", rank="p1"), "zscore", "bar_time", rank="p2", nulls_first=nulls_first, turn=1)


#: Steps that Spark takes from the functions above; the other engine runs their text.
GIVEN = {"bl": blended, "ov": partial(blended, nulls_first=False), "scored": scored}


def run(plan: Plan, spark: SparkSession, folder: str) -> DataFrame:
    """A plan over the tables of a folder; its scored rows come in several stages."""
    for name, make in GIVEN.items():
        if any(n == name for n, _ in plan.steps):
            plan = plan.given(name, f"{name}_rows")
            tables = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in plan.tables() if t != f"{name}_rows"}
            return plan.run(spark, **tables, **{f"{name}_rows": make(spark, folder)})
    return plan.over(spark, folder)


def weights() -> Plan:
    return scores().then("book", f"SELECT bar_time, instrument_id, score, label, close_price, volume, turnover, 1.0 / count(*) OVER (PARTITION BY bar_time) AS weight FROM scored WHERE score_rank <= {TOP}")


def rebalances() -> Plan:
    """Changes against the previous timestamp's book; names that leave are sold."""
    p = weights().then("bt0", "SELECT DISTINCT bar_time FROM scored").then("bts", f"SELECT bar_time, {lead('bar_time', 1, TS)} AS next_time FROM bt0")
    p = p.then("held", "SELECT b.next_time AS bar_time, k.instrument_id, k.weight FROM book k JOIN bts b ON k.bar_time = b.bar_time WHERE b.next_time IS NOT NULL")
    return p.then("orders", "SELECT coalesce(t.bar_time, h.bar_time) AS bar_time, coalesce(t.instrument_id, h.instrument_id) AS instrument_id, coalesce(h.weight, 0.0) AS current_weight, coalesce(t.weight, 0.0) AS target_weight, coalesce(t.weight, 0.0) - coalesce(h.weight, 0.0) AS delta FROM book t FULL OUTER JOIN held h ON t.bar_time = h.bar_time AND t.instrument_id = h.instrument_id")


def market() -> Plan:
    """One row for each timestamp: return, volatility, breadth and score health."""
    p = scores().then("sr", f"SELECT *, {avg_rank('score', 'bar_time, (label IS NULL)')} AS rs, {avg_rank('label', 'bar_time, (label IS NULL)')} AS rl FROM scored")
    p = p.then("mk", f"SELECT bar_time, avg(-f1) AS m_ret, stddev_samp(f1) AS m_vol, avg(CASE WHEN f1 < 0 THEN 1.0 ELSE 0.0 END) AS breadth, {_corr('CASE WHEN label IS NOT NULL THEN rs END', 'CASE WHEN label IS NOT NULL THEN rl END')} AS score_ic, avg(CASE WHEN score_rank <= {TOP} THEN label END) AS top_label, avg(label) AS all_label FROM sr GROUP BY bar_time")
    return p.then("market_ts", "SELECT *, top_label - all_label AS edge FROM mk WHERE m_ret IS NOT NULL")


def linear(x: str, lo: float, hi: float) -> str:
    return clip(f"(({x}) - ({lo})) / ({hi} - ({lo}))", 0, 1)


def _final(p: Plan, source: str, *keys: str, where: str = "", **cols: str) -> Plan:
    return p.then("out", f"SELECT {E.out(*keys, **cols)} FROM {source}{' WHERE ' + where if where else ''}")


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


def plans() -> dict[str, Plan]:
    q: dict[str, Plan] = {}
    key = ("bar_time", "instrument_id")
    # bars and flags
    for name, p in (("hourly", B.hourly()), ("daily", B.daily()), ("weekly", B.weekly())):
        q[f"bars_{name}"] = _final(p, "bars", *key, "open_price", "high_price", "low_price", "close_price", **_same("volume", "turnover"))
    q["kline_daily"] = B.hourly().then("out", "SELECT instrument_id, trade_date, min_by(open_price, bar_time) AS open_price, max(high_price) AS high_price, min(low_price) AS low_price, max_by(close_price, bar_time) AS close_price, round(sum(volume), 6) AS volume, round(sum(turnover), 4) AS turnover, count(*) AS bars FROM bars GROUP BY instrument_id, trade_date")
    q["max_symbols"] = B.weekly().then("ids", "SELECT DISTINCT instrument_id FROM bars ORDER BY instrument_id LIMIT 10").then("out", f"SELECT {E.out('b.bar_time', 'b.instrument_id', close_price='close_price')} FROM bars b WHERE instrument_id IN (SELECT instrument_id FROM ids)")
    daily = B.executable(B.daily())
    q["exec_columns"] = daily.then("out", "SELECT bar_time, instrument_id, is_st, suspended_bar, tradable_bar, buyable_bar, sellable_bar FROM exec_bars")
    q["limit_flags"] = daily.then("out", "SELECT bar_time, instrument_id, limit_up_open, limit_down_open FROM exec_bars")
    q["prev_close"] = _final(daily, "exec_bars", *key, "previous_close")
    q["active_on"] = Plan((("spans", "SELECT o_custkey AS instrument_id, min(o_orderdate) AS effective_from, CASE WHEN count(*) > 10 THEN NULL ELSE max(o_orderdate) END AS effective_to FROM {orders} GROUP BY o_custkey"), ("out", "SELECT instrument_id, effective_from, effective_to FROM spans WHERE (effective_from IS NULL OR effective_from <= DATE '1996-06-01') AND (effective_to IS NULL OR effective_to >= DATE '1996-06-01')")))
    q["liquidity_filter"] = _final(weekly().then("lq", f"SELECT *, {mean('turnover', 4)} AS liquidity FROM exec_bars"), "lq", *key, where="liquidity >= 50000", liquidity="liquidity")
    # labels and splits
    lab = labelled()
    q["entry_exit_filter"] = _final(lab, "labels", *key, where="label IS NOT NULL AND coalesce(entry_tradable, FALSE) AND NOT coalesce(entry_limit_up, FALSE) AND coalesce(exit_sellable, FALSE)", label="label")
    q["entry_exit_counts"] = lab.then("out", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT coalesce(entry_tradable, FALSE)) AS n_entry_blocked, count(*) FILTER (WHERE coalesce(entry_limit_up, FALSE)) AS n_limit_up, count(*) FILTER (WHERE NOT coalesce(exit_sellable, FALSE)) AS n_exit_blocked FROM labels WHERE label IS NOT NULL")
    q["join_features_labels"] = _final(panel(), "panel", *key, where="f1 IS NOT NULL AND label IS NOT NULL", **_same("f1", "f2", "f3", "label"))
    q["sample_rows"] = Plan((("out", "SELECT o_orderkey, o_custkey FROM {orders} ORDER BY (o_orderkey * 7919) % 10007, o_orderkey LIMIT 100"),))
    # evaluation
    bt = by_timestamp()
    quant = ranked().then("qb", "SELECT *, CAST(least(ceil(CAST(bottom_rank AS DOUBLE) / n * 5), 5) AS BIGINT) AS bucket FROM rk").then("qt", "SELECT feature, bar_time, bucket, count(*) AS size, avg(y) AS m FROM qb GROUP BY feature, bar_time, bucket")
    q["quantile_returns"] = quant.then("out", f"SELECT {E.out('feature', 'bucket', mean_label='avg(m)', mean_size='avg(size)')} FROM qt GROUP BY feature, bucket")
    q["quantile_long_short"] = quant.then("ls", "SELECT feature, bar_time, max(CASE WHEN bucket = 5 THEN m END) - max(CASE WHEN bucket = 1 THEN m END) AS ls FROM qt GROUP BY feature, bar_time").then("out", f"SELECT {E.out('feature', long_short='avg(ls)')} FROM ls GROUP BY feature")
    q["yearly_ic"] = bt.then("yi", "SELECT feature, year(bar_time) AS y, avg(rank_ic) AS ic FROM bt GROUP BY feature, year(bar_time)").then("tot", "SELECT feature, avg(rank_ic) AS ic_all FROM bt GROUP BY feature").then("out", "SELECT yi.feature, count(*) AS years, count(*) FILTER (WHERE sign(ic) = sign(ic_all)) AS stable_years FROM yi JOIN tot ON yi.feature = tot.feature GROUP BY yi.feature")
    q["opportunity_map"] = bt.then("om", "SELECT feature, avg(rank_ic) AS ic, avg(top_label) AS top_label, avg(bottom_label) AS bottom_label FROM bt GROUP BY feature").then("out", f"SELECT feature, CASE WHEN top_label > 0 AND ic > 0 THEN 'long_alpha_candidate' WHEN bottom_label < 0 THEN 'bottom_avoidance_only' WHEN abs(ic) >= 0.01 THEN 'risk_gate_only' ELSE 'dead_zone' END AS opportunity FROM om")
    # signals and portfolios
    sc = scores()
    orders = rebalances()
    q["portfolio_turnover"] = orders.then("out", f"SELECT {E.out('bar_time', turnover='sum(abs(delta)) / 2')}, count(*) FILTER (WHERE delta > 1e-12) AS buys, count(*) FILTER (WHERE delta < -1e-12) AS sells FROM orders GROUP BY bar_time")
    q["composite_zscore"] = _final(sc, "scored", *key, zscore="zscore")
    cap = sc.then("cc", "SELECT *, coalesce(0.5 * r_f1, 0) AS c1, coalesce(0.3 * r_f2, 0) AS c2, coalesce(0.2 * r_f3, 0) AS c3 FROM scored").then("cd", "SELECT *, abs(c1) + abs(c2) + abs(c3) AS tot FROM cc")
    q["contribution_diag"] = cap.then("out", f"SELECT {E.out('bar_time', total='sum(tot)', share_1=div('sum(abs(c1))', 'sum(tot)'), largest=div('greatest(sum(abs(c1)), sum(abs(c2)), sum(abs(c3)))', 'sum(tot)'))} FROM cd WHERE score_rank <= {TOP} GROUP BY bar_time")
    fby = "PARTITION BY feature ORDER BY bar_time"
    health = bt.then("h1", f"SELECT *, {mean('rank_ic', 12, shift=2, least=4, by=fby)} AS ic_r, {mean('spread', 12, shift=2, least=4, by=fby)} AS sp_r FROM bt").then("h2", f"SELECT *, least({linear('ic_r', -0.05, 0.05)}, {linear('sp_r', -0.02, 0.02)}) AS hs FROM h1").then("h3", "SELECT *, CASE WHEN ic_r IS NULL OR sp_r IS NULL THEN 1 ELSE 0.25 + 0.75 * hs END AS scale, CASE WHEN ic_r IS NULL OR sp_r IS NULL THEN 'warmup' WHEN hs >= 0.75 THEN 'healthy' WHEN hs >= 0.25 THEN 'watch' ELSE 'impaired' END AS state FROM h2")
    q["health_states"] = health.then("h4", "SELECT *, round(hs, 9) AS hr FROM h3").then("out", "SELECT feature, count(*) AS n, count(*) FILTER (WHERE state = 'warmup') AS warmup FROM h4 GROUP BY feature")
    ens = bt.then("e1", " UNION ALL ".join(f"SELECT feature, bar_time, {w} AS look, {linear(mean('rank_ic', w, shift=2, least=4, by=fby), -0.05, 0.05)} AS s FROM bt" for w in (6, 12, 24)))
    q["health_ensemble"] = ens.then("out", f"SELECT {E.out('feature', 'bar_time', s_mean='avg(coalesce(s, 1))', s_min='min(coalesce(s, 1))', s_max='max(coalesce(s, 1))')} FROM e1 GROUP BY feature, bar_time")
    mk = market()
    regime = mk.then("rg1", f"SELECT *, {lag('m_vol', 1, TS)} AS v, {lag('breadth', 1, TS)} AS b FROM market_ts").then("rg2", f"SELECT *, {E.quantile('v', 26, 0.75, least=8, by=TS)} AS v75, {E.quantile('b', 26, 0.25, least=8, by=TS)} AS b25 FROM rg1").then("rg3", "SELECT *, CASE WHEN v75 IS NULL OR b25 IS NULL THEN 'warmup' WHEN round(v, 9) >= round(v75, 9) OR round(b, 9) <= round(b25, 9) THEN 'stress' ELSE 'normal' END AS regime FROM rg2")
    cal = sc.then("ca1", f"SELECT *, CAST(greatest(1, least(ceil({pct_rank('score', 'bar_time')} * 5), 5)) AS BIGINT) AS bucket FROM scored").then("ca2", "SELECT bar_time, bucket, avg(label) AS m, stddev_pop(label) AS sd, count(label) AS n FROM ca1 GROUP BY bar_time, bucket").then("ca3", f"SELECT *, {mean('m', 12, shift=2, least=4, by='PARTITION BY bucket ORDER BY bar_time')} AS edge, {mean('sd', 12, shift=2, least=4, by='PARTITION BY bucket ORDER BY bar_time')} AS risk FROM ca2")
    q["score_calibration"] = _final(cal, "ca3", "bar_time", "bucket", "(edge IS NULL) AS warmup", edge_bps="1e4 * coalesce(edge, 0)", risk_bps="1e4 * coalesce(risk, 0)")
    q["calibration_apply"] = cal.then("out", f"SELECT {E.out('a.bar_time', 'a.instrument_id', 'a.bucket', edge_bps='1e4 * coalesce(c.edge, 0)')} FROM ca1 a LEFT JOIN ca3 c ON a.bar_time = c.bar_time AND a.bucket = c.bucket")
    # gates, schedules and switches
    bl = sc.then("bl", f"SELECT *, {pct_rank('score', 'bar_time')} AS p1, {pct_rank('zscore', 'bar_time')} AS p2 FROM scored")
    q["score_blend"] = _final(bl, "bl", *key, score="0.7 * p1 + 0.3 * p2")
    q["overlay_downside"] = _final(bl, "bl", *key, score="score - 0.2 * CASE WHEN p2 <= 0.2 THEN 0.2 - p2 ELSE 0 END")
    q["overlay_exclusion"] = bl.then("out", "SELECT bar_time, instrument_id, (round(p2, 9) > 0.1) AS entry_eligible FROM bl")
    q["overlay_daily_first"] = B.hourly().then("df", "SELECT instrument_id, trade_date, min(bar_time) AS first_time FROM bars GROUP BY instrument_id, trade_date").then("out", f"SELECT {E.out('b.bar_time', 'b.instrument_id', close_price='b.close_price')} FROM bars b JOIN df ON b.instrument_id = df.instrument_id AND b.bar_time = df.first_time")
    q["primary_pool"] = _final(sc.then("pp", "SELECT *, row_number() OVER (PARTITION BY bar_time ORDER BY zscore DESC, instrument_id) AS pool_rank FROM scored WHERE score_rank <= 20"), "pp", *key, "pool_rank", zscore="zscore")
    # execution and reports
    nx = rebalances().then("nb", f"SELECT bar_time, {lead('bar_time', 1, TS)} AS exec_time FROM (SELECT DISTINCT bar_time FROM exec_bars) d").then("ex", "SELECT n.exec_time, o.instrument_id, o.target_weight, o.delta, b.open_price, b.close_price, b.volume, coalesce(b.tradable_bar, FALSE) AS tradable_bar, coalesce(b.limit_up_open, FALSE) AS limit_up, coalesce(b.limit_down_open, FALSE) AS limit_down FROM orders o JOIN nb n ON o.bar_time = n.bar_time LEFT JOIN exec_bars b ON b.bar_time = n.exec_time AND b.instrument_id = o.instrument_id WHERE n.exec_time IS NOT NULL")
    q["next_bar_exec"] = _final(nx, "ex", "exec_time", "instrument_id", "tradable_bar", target_weight="target_weight", open_price="open_price")
    q["exec_counts"] = nx.then("out", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT tradable_bar) AS non_tradable, count(*) FILTER (WHERE limit_up AND delta > 0) AS limit_up_buys, count(*) FILTER (WHERE limit_down AND delta < 0) AS limit_down_sells, count(*) FILTER (WHERE open_price IS NULL) AS missing_price FROM ex")
    reason = "CASE WHEN open_price IS NULL THEN 'missing_price' WHEN NOT tradable_bar THEN 'non_tradable' WHEN limit_up AND delta > 0 THEN 'limit_up_buy_blocked' WHEN limit_down AND delta < 0 THEN 'limit_down_sell_blocked' WHEN abs(delta) < 0.01 THEN 'below_min_trade_weight' ELSE 'filled' END"
    q["exec_events"] = nx.then("out", f"SELECT {reason} AS reason, count(*) AS n, round(sum(abs(delta)), 6) AS amount FROM ex GROUP BY 1")
    q["trade_metrics"] = nx.then("out", f"SELECT {E.out(buy='sum(CASE WHEN delta > 0 THEN delta ELSE 0 END)', sell='sum(CASE WHEN delta < 0 THEN -delta ELSE 0 END)', gross='sum(abs(delta))', cost='sum(abs(delta)) * 0.0013')} FROM ex WHERE tradable_bar")
    eq = weights().then("pr", "SELECT bar_time, sum(weight * coalesce(label, 0)) AS ret FROM book GROUP BY bar_time").then("cr", "SELECT bar_time, least(greatest(ret, -0.2), 0.2) AS ret FROM pr").then("eq", "SELECT bar_time, exp(sum(ln(1 + ret)) OVER (ORDER BY bar_time)) AS equity FROM cr").then("dd", "SELECT *, greatest(max(equity) OVER (ORDER BY bar_time), 1.0) AS peak FROM eq")
    q["drawdown"] = _final(eq, "dd", "bar_time", drawdown="equity / peak - 1", log_equity="ln(equity)")
    q["monthly_perf"] = eq.then("mo", "SELECT year(bar_time) AS y, month(bar_time) AS m, max_by(equity, bar_time) AS e, min(equity / peak - 1) AS dd FROM dd GROUP BY year(bar_time), month(bar_time)").then("mo2", "SELECT *, coalesce(lag(e) OVER (ORDER BY y, m), 1.0) AS e0 FROM mo").then("out", f"SELECT {E.out('y', 'm', ret='e / e0 - 1', drawdown='dd')} FROM mo2")
    disp = sc.then("za", f"SELECT bar_time, instrument_id, label FROM scored WHERE score_rank <= {TOP}").then("zb0", "SELECT *, row_number() OVER (PARTITION BY bar_time ORDER BY zscore DESC, instrument_id) AS zr FROM scored").then("zb", f"SELECT bar_time, instrument_id, label FROM zb0 WHERE zr <= {TOP}").then("di", "SELECT coalesce(a.bar_time, b.bar_time) AS bar_time, coalesce(a.label, b.label) AS label, CASE WHEN a.instrument_id IS NULL THEN 'added' WHEN b.instrument_id IS NULL THEN 'removed' ELSE 'both' END AS side FROM za a FULL OUTER JOIN zb b ON a.bar_time = b.bar_time AND a.instrument_id = b.instrument_id")
    q["displacement"] = disp.then("out", "SELECT year(bar_time) AS y, side, count(*) AS n, round(avg(label), 6) + 0.0 AS mean_label FROM di GROUP BY GROUPING SETS ((), (year(bar_time)), (side), (year(bar_time), side))")
    q["set_overlap"] = disp.then("out", f"SELECT {E.out('bar_time', overlap='count(*) FILTER (WHERE side = {0}both{0}) / CAST(count(*) AS DOUBLE)'.format(chr(39)))} FROM di GROUP BY bar_time")
    q["leg_payoff"] = regime.then("lg", "SELECT r.regime, s.score_rank, s.label FROM scored s JOIN rg3 r ON s.bar_time = r.bar_time WHERE s.label IS NOT NULL").then("out", f"SELECT {E.out('regime', top_mean=f'avg(CASE WHEN score_rank <= {TOP} THEN label END)', all_mean='avg(label)')}, count(*) AS n FROM lg GROUP BY regime")
    q["leaderboard"] = bt.then("lb", "SELECT feature, year(bar_time) AS y, avg(spread) AS s FROM bt GROUP BY feature, year(bar_time)").then("out", f"SELECT {E.out('feature', mean_spread='avg(s)', worst='min(s)', total='sum(s)')}, rank() OVER (ORDER BY round(avg(s), 9) DESC) AS place FROM lb GROUP BY feature")
    q["residual_risk"] = sc.then("out", f"SELECT {E.out('year(bar_time) AS y', weighted_mean=div('sum(label * volume)', 'sum(CASE WHEN label IS NOT NULL THEN volume END)'), share_below='avg(CASE WHEN label < 0 THEN 1.0 ELSE 0.0 END)')} FROM scored WHERE score_rank <= {TOP} AND label IS NOT NULL GROUP BY year(bar_time)")
    q["event_metrics"] = panel().then("out", f"SELECT {E.out('bar_time', f_mean='avg(f3)', f_std='stddev_samp(f3)', f_p10='@PCT(f3, 0.1)', f_p90='@PCT(f3, 0.9)', r_median='@PCT(f1, 0.5)')} FROM panel WHERE f1 IS NOT NULL AND f3 IS NOT NULL GROUP BY bar_time")
    return q


def memory() -> Plan:
    """Pairs of parts whose similarity reaches 0.35, which takes two of family, look and price; copies by membership.

    Parts with equal family, look and price are one class, and its smallest id stands for it.  Rows are the pairs of those
    that stand for classes, and each other part of a class with the one that stands for it: what links the one links all.

    One equality join for each two, so that no family is paired as a whole; prices less than 5 apart lie in the same
    slot of that width or in neighbouring ones.
    """
    p = Plan((("t0", "SELECT p_partkey AS id, p_brand AS family, p_size AS look, p_retailprice AS price, CAST(floor(p_retailprice / 5) AS BIGINT) AS slot FROM {part}"),))
    p = p.then("t", "SELECT min(id) AS id, family, look, price, slot FROM t0 GROUP BY family, look, price, slot")
    p = p.then("near", "SELECT t.*, slot + step AS other FROM t CROSS JOIN (SELECT -1 AS step UNION ALL SELECT 0 UNION ALL SELECT 1) o")
    close, look, family = "abs(a.price - b.price) < 5", "coalesce(a.look = b.look, FALSE)", "coalesce(a.family = b.family, FALSE)"
    same = "a.family IS NOT DISTINCT FROM b.family AND a.look IS NOT DISTINCT FROM b.look AND a.price IS NOT DISTINCT FROM b.price"
    for name, first, second, on in (
        ("fl", "t", "t", "a.family = b.family AND a.look = b.look"),
        ("fp", "near", "t", f"a.family = b.family AND a.other = b.slot AND {close} AND NOT {look}"),
        ("lp", "near", "t", f"a.look = b.look AND a.other = b.slot AND {close} AND NOT {family}"),
        ("copies", "t", "t0", same),
    ):
        p = p.then(name, f"SELECT a.id AS a, b.id AS b, 0.3 * CASE WHEN a.family = b.family THEN 1 ELSE 0 END + 0.15 * CASE WHEN a.look = b.look THEN 1 ELSE 0 END + 0.25 * CASE WHEN {close} THEN 1 ELSE 0 END AS similarity FROM {first} a JOIN {second} b ON {on} AND a.id < b.id")
    return p.then("out", "SELECT a, b, round(CAST(similarity AS DOUBLE), 6) AS similarity FROM (SELECT * FROM fl UNION ALL SELECT * FROM fp UNION ALL SELECT * FROM lp UNION ALL SELECT * FROM copies) s WHERE similarity >= 0.35")


def overlay() -> Plan:
    """Every scored row, blended with its satellite score's rank among the rows that have one; 0.5 where it is missing."""
    second = f"CASE WHEN zscore IS NOT NULL THEN {pct_rank('zscore', 'bar_time, (zscore IS NULL)')} END"
    p = scores().then("ov", f"SELECT *, {pct_rank('score', 'bar_time')} AS p1, {second} AS p2 FROM scored")
    return _final(p, "ov", "bar_time", "instrument_id", score="0.7 * p1 + 0.3 * coalesce(p2, 0.5)")


def whole() -> dict[str, Plan]:
    """Queries whose plan above, and so the SQL they are compared with, holds only a part of the job."""
    return {"overlay_blend": overlay(), "research_memory": memory()}


def stateful() -> dict:
    """Path-dependent operators, run as ordered folds (see folds)."""
    from . import costaware, folds

    return folds.queries() | costaware.queries()
