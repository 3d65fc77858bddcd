"""DuckDB SQL for the queries of the callable operators, written from their rules and apart from their code."""

from __future__ import annotations

from itertools import combinations

from ..plans.sql import Plan
from ..sources import bars as B
from . import independent
from . import research as R

PAIRS = list(combinations(("f1", "f2", "f3"), 2))
WIDE = ("f1", "f2", "f3", "label", "label_4", "close_price", "volume", "turnover")


def _r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name}"


def _c(x: str, y: str) -> str:
    """Pearson over complete pairs, NULL where it isn't defined."""
    a, b = (f"CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN {v} END" for v in (x, y))
    return f"CASE WHEN count({a}) >= 2 AND stddev_pop({a}) * stddev_pop({b}) > 1e-14 THEN covar_pop({a}, {b}) / (stddev_pop({a}) * stddev_pop({b})) END"


def _rank(x: str, part: str = "") -> str:
    by = f"{part}, " if part else ""
    return f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {by}{x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}{x}) - 1) / 2.0 END"


_MARKET = (
    ("mk0", "SELECT bar_time, round(stddev_samp(f1), 10) AS sd FROM panel WHERE f1 IS NOT NULL GROUP BY bar_time"),
    ("mk1", "SELECT bar_time, sd, lag(sd) OVER (ORDER BY bar_time) AS before FROM mk0"),
    ("mkt", "SELECT bar_time, CASE WHEN before > 0.3 THEN 0.5 ELSE 1.0 END AS scale, CASE WHEN before > 0.3 THEN 'stress' ELSE 'normal' END AS regime FROM mk1"),
)


def _on(base: Plan, *steps: tuple[str, str]) -> str:
    for name, sql in steps:
        base = base.then(name, sql)
    return base.text()


def _health(name: str, window: int) -> list[tuple[str, str]]:
    w = f"OVER (PARTITION BY feature ORDER BY bar_time ROWS BETWEEN {window + 1} PRECEDING AND 2 PRECEDING)"
    lin = lambda x, a: f"least(greatest(({x} + {a}) / {2 * a}, 0.0), 1.0)"
    return [
        (f"{name}1", f"SELECT feature, bar_time, CASE WHEN count(rank_ic) {w} >= 4 THEN avg(rank_ic) {w} END AS ic_r, CASE WHEN count(spread) {w} >= 4 THEN avg(spread) {w} END AS sp_r FROM bt"),
        (f"{name}2", f"SELECT *, CASE WHEN ic_r IS NOT NULL AND sp_r IS NOT NULL THEN least({lin('ic_r', 0.05)}, {lin('sp_r', 0.02)}) END AS g FROM {name}1"),
        (name, f"SELECT feature, bar_time, ic_r, coalesce(0.25 + 0.75 * g, 1.0) AS scale, CASE WHEN g IS NULL THEN 'warmup' WHEN g >= 0.75 THEN 'healthy' WHEN g >= 0.25 THEN 'watch' ELSE 'impaired' END AS state FROM {name}2"),
    ]


def _capped(passes: int) -> list[tuple[str, str]]:
    steps, source = [("k0", "SELECT bar_time, instrument_id, 0.5 * round(r_f1, 10) AS c1, 0.3 * round(r_f2, 10) AS c2, 0.2 * round(r_f3, 10) AS c3 FROM s1 WHERE r_f1 IS NOT NULL OR r_f2 IS NOT NULL OR r_f3 IS NOT NULL")], "k0"
    for i in range(1, passes + 1):
        total = " + ".join(f"abs(coalesce(c{j}, 0))" for j in (1, 2, 3))
        cut = ", ".join(f"CASE WHEN c{j} > 0 THEN least(c{j}, 2.0 / 3.0 * (t - c{j})) WHEN c{j} < 0 THEN greatest(c{j}, -2.0 / 3.0 * (t + c{j})) ELSE c{j} END AS c{j}" for j in (1, 2, 3))
        steps.append((f"k{i}", f"SELECT bar_time, instrument_id, {cut} FROM (SELECT *, {total} AS t FROM {source}) x"))
        source = f"k{i}"
    return steps


def _weights(rounds: int) -> list[tuple[str, str]]:
    """What exceeds 0.5 is dealt to the smaller ones, by their shares or evenly where these are zero."""
    steps = [("v0", "SELECT g.bar_time, g.feature, round(abs(coalesce(ic, 0.0)), 9) AS w FROM (SELECT DISTINCT bar_time, unnest(['f1', 'f2', 'f3']) AS feature FROM bt) g LEFT JOIN bt ON g.bar_time = bt.bar_time AND g.feature = bt.feature")]
    for i in range(1, rounds + 1):
        steps.append((f"v{i}", f"SELECT bar_time, feature, CASE WHEN m <= 0.5 THEN w WHEN w >= 0.5 THEN 0.5 WHEN f > 0 THEN w + o * w / f ELSE w + o / k END AS w FROM (SELECT *, max(w) OVER p AS m, sum(greatest(w - 0.5, 0.0)) OVER p AS o, sum(w) FILTER (w < 0.5) OVER p AS f, count(*) FILTER (w < 0.5) OVER p AS k FROM v{i - 1} WINDOW p AS (PARTITION BY bar_time)) x"))
    return steps


_PAST = "OVER (PARTITION BY a, b ORDER BY bar_time ROWS BETWEEN 26 PRECEDING AND 1 PRECEDING)"
_REGIME_WEIGHTS = (
    ("rp", "SELECT m.bar_time, regime, a, b FROM mkt m, (VALUES ('f1', 'f2'), ('f1', 'f3'), ('f2', 'f3')) v(a, b)"),
    ("rc", "SELECT bar_time, " + ", ".join(f"{_c(a, b)} AS {a}{b}" for a, b in PAIRS) + " FROM panel GROUP BY bar_time"),
    ("rv", "SELECT rp.*, CASE WHEN a = 'f2' THEN f2f3 WHEN b = 'f2' THEN f1f2 ELSE f1f3 END AS v FROM rp LEFT JOIN rc ON rp.bar_time = rc.bar_time"),
    ("rh", f"SELECT *, count(*) {_PAST} AS n_all, list({{'r': regime, 'v': v}}) {_PAST} AS past FROM rv"),
    ("ra", "SELECT *, len([p for p in past if p.r = regime]) AS n_same FROM rh"),
    ("rm", "SELECT bar_time, regime, a, b, coalesce(n_same, 0) >= 8 AS used, CASE WHEN coalesce(n_same, 0) >= 8 THEN n_same ELSE n_all END AS history, coalesce(list_avg([p.v for p in past if coalesce(n_same, 0) < 8 OR p.r = regime]), 0) AS c FROM ra"),
    ("rs", "SELECT bar_time, any_value(regime) AS regime, any_value(used) AS used, any_value(history) AS history, max(c) FILTER (b = 'f2') AS x, max(c) FILTER (a = 'f1' AND b = 'f3') AS y, max(c) FILTER (a = 'f2') AS z FROM rm GROUP BY bar_time"),
    ("rd", "SELECT *, greatest(0.5 * (2.25 - z * z) - x * (0.45 - 0.2 * z) + y * (0.3 * z - 0.3), 0) AS w1, greatest(1.5 * (0.45 - 0.2 * z) - 0.5 * (1.5 * x - y * z) + y * (0.2 * x - 0.3 * y), 0) AS w2, greatest(1.5 * (0.3 - 0.3 * z) - x * (0.2 * x - 0.3 * y) + 0.5 * (x * z - 1.5 * y), 0) AS w3 FROM rs"),
    ("out", f"SELECT bar_time, f AS feature, {_r('CASE WHEN history < 8 OR w1 + w2 + w3 <= 0 THEN base ELSE w / (w1 + w2 + w3) END', 'weight')}, regime, used AS used_regime, CAST(history AS BIGINT) AS history, CASE WHEN history < 8 THEN 'insufficient_history' ELSE '' END AS reason FROM (SELECT *, unnest(['f1', 'f2', 'f3']) AS f, unnest([0.5, 0.3, 0.2]) AS base, unnest([w1, w2, w3]) AS w FROM rd) u"),
)

def _on_steps(*steps: tuple[str, str]) -> str:
    """Steps on the bars and scores that independent.py builds from the raw tables."""
    return independent.with_steps("WITH " + ", ".join(f"{n} AS ({t})" for n, t in steps[:-1]) + " " + steps[-1][1])


_RUNS = (
    ("x0", "SELECT 'rank' AS run, t, i, row_number() OVER (PARTITION BY t ORDER BY s DESC, i) AS k FROM sc UNION ALL SELECT 'zscore', t, i, row_number() OVER (PARTITION BY t ORDER BY z DESC, i) FROM sc WHERE z IS NOT NULL"),
    ("x1", "SELECT run, t, i, 1.0 / count(*) OVER (PARTITION BY run, t) AS w FROM x0 WHERE k <= 5"),
    ("xt", "SELECT run, t, lead(t) OVER (PARTITION BY run ORDER BY t) AS nt FROM (SELECT DISTINCT run, t FROM x0) q"),
    ("x2", "SELECT run, t, i, sum(w) AS w, sum(w - h) AS dl FROM (SELECT run, t, i, w, 0.0 AS h FROM x1 UNION ALL SELECT run, nt, i, 0.0, w FROM x1 JOIN xt USING (run, t) WHERE nt IS NOT NULL) q GROUP BY ALL"),
    ("xb", "SELECT x2.run, tb.xt AS xt, x2.i, x2.w, x2.dl, e.o, e.v, coalesce(e.ok, FALSE) AS ok, coalesce(e.up, FALSE) AS up, coalesce(e.down, FALSE) AS down FROM x2 JOIN tb ON tb.t = x2.t AND tb.xt IS NOT NULL LEFT JOIN wb_x e ON e.t = tb.xt AND e.i = x2.i"),
    ("xs", "SELECT *, floor(round(abs(dl) * 1e7 / o, 6)) AS want, least(floor(round(abs(dl) * 1e7 / o, 6)), floor(round(v / 20, 6))) AS can FROM xb WHERE ok AND dl <> 0 AND NOT (dl > 0 AND up) AND NOT (dl < 0 AND down)"),
    ("x3", "SELECT *, CASE WHEN can = 0 THEN 'capacity_zero' WHEN can < want THEN 'capacity_capped' ELSE 'filled' END AS reason FROM xs"),
    ("x4", "SELECT run, avg(1e7 + 1000.0 * (xt - DATE '1995-01-01')) AS eq FROM (SELECT DISTINCT run, xt FROM xb) q GROUP BY run"),
    ("x5", "SELECT run, count(*) AS k, sum(can * o) FILTER (dl > 0) AS b, sum(can * o) FILTER (dl < 0) AS s, sum(can * o) AS g FROM xs WHERE can > 0 GROUP BY run"),
    ("x6", "SELECT run, count(*) AS c, sum(want) AS ds, sum(can) AS cs, sum(want * o) AS dn, sum(can * o) AS cn FROM x3 WHERE reason <> 'filled' GROUP BY run"),
    ("x7", "SELECT run, count(*) AS n, count(*) FILTER (NOT ok) AS nt, count(*) FILTER (up) AS u, count(*) FILTER (down) AS d, count(*) FILTER (w > 0) AS p, count(*) FILTER (w > 0 AND NOT ok) AS pn, count(*) FILTER (w > 0 AND up) AS pu, count(*) FILTER (w > 0 AND down) AS pd FROM xb GROUP BY run"),
)
_DIAGNOSTICS = (
    "SELECT run, n AS execution_row_count, nt AS non_tradable_row_count, u AS limit_up_open_row_count, d AS limit_down_open_row_count, p AS positive_target_row_count, pn AS positive_target_non_tradable_row_count, pu AS positive_target_limit_up_open_row_count, pd AS positive_target_limit_down_open_row_count, "
    + ", ".join(_r(x, n, 3) for x, n in (("eq", "average_equity"), ("coalesce(b, 0)", "buy_notional"), ("coalesce(s, 0)", "sell_notional"), ("coalesce(g, 0)", "gross_traded_notional"), ("coalesce(g * 0.0003, 0)", "total_commission"), ("coalesce(s * 0.0005, 0)", "total_stamp_tax"), ("coalesce(g * 0.0005, 0)", "total_slippage_cost"), ("coalesce(g * 0.0008 + coalesce(s, 0) * 0.0005, 0)", "total_transaction_cost"), ("coalesce(g / eq, 0)", "gross_turnover"), ("coalesce(dn, 0)", "capacity_desired_notional"), ("coalesce(cn, 0)", "capacity_executable_notional"), ("coalesce(dn - cn, 0)", "capacity_unfilled_notional")))
    + ", coalesce(k, 0) AS trade_count, coalesce(c, 0) AS capacity_limited_event_count, CAST(coalesce(ds, 0) AS BIGINT) AS capacity_desired_shares, CAST(coalesce(cs, 0) AS BIGINT) AS capacity_executable_shares, CAST(coalesce(ds - cs, 0) AS BIGINT) AS capacity_unfilled_shares FROM x7 LEFT JOIN x4 USING (run) LEFT JOIN x5 USING (run) LEFT JOIN x6 USING (run)"
)

_KEEP = "0.5 ** (1 / 3.0)"
_QUALITY = (
    ("q0", "SELECT instrument_id, bar_time, 1 - least(greatest(abs(close_price - turnover / nullif(volume, 0)) / nullif(abs(high_price - low_price), 0), 0), 1) AS q, abs(close_price - turnover / nullif(volume, 0)) / nullif(abs(high_price - low_price), 0) AS c FROM exec_bars"),
    ("q1", "SELECT instrument_id, bar_time, CASE WHEN c IS NOT NULL THEN q END AS q, row_number() OVER (PARTITION BY instrument_id ORDER BY bar_time) AS k FROM q0"),
    ("qr(instrument_id, bar_time, k, y, gap, n)", f"SELECT instrument_id, bar_time, k, q, 0, (q IS NOT NULL)::INT FROM q1 WHERE k = 1 UNION ALL SELECT q1.instrument_id, q1.bar_time, q1.k, CASE WHEN q IS NULL THEN y WHEN y IS NULL THEN q ELSE (({_KEEP}) ** (gap + 1) * y + (1 - {_KEEP}) * q) / (({_KEEP}) ** (gap + 1) + 1 - {_KEEP}) END, CASE WHEN q IS NULL THEN gap + 1 ELSE 0 END, n + (q IS NOT NULL)::INT FROM qr JOIN q1 ON qr.instrument_id = q1.instrument_id AND q1.k = qr.k + 1"),
    ("out", f"SELECT instrument_id, bar_time, {_r('y', 'quality')} FROM qr WHERE n >= 3"),
)


def _event(sources: tuple[str, ...]) -> list[tuple[str, str]]:
    """Signed z-scores against the 12 rows before; states from the strongest rule down."""
    w = "OVER (ORDER BY bar_time ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    z = ", ".join(f"CASE WHEN count({c}) {w} >= 4 THEN least(greatest(({c} - avg({c}) {w}) / nullif(stddev_samp({c}) {w}, 0), -3.0), 3.0) * (CASE WHEN {c} IS NULL OR stddev_samp({c}) {w} = 0 THEN NULL ELSE 1 END) END AS z_{c}" for c in sources)
    total, n = " + ".join(f"coalesce(greatest(z_{c}, 0), 0)" for c in sources), " + ".join(f"(z_{c} IS NOT NULL)::INT" for c in sources)
    limit = f"greatest(coalesce(z_{sources[0]}, -9), coalesce(z_{sources[1]}, -9))"
    state = "CASE WHEN k < 4 THEN 'warmup' WHEN m >= 1.5 THEN 'limit_diffusion_extreme' WHEN i >= 1.5 THEN 'shock_extreme' WHEN m >= 0.5 THEN 'limit_diffusion' WHEN i >= 0.5 THEN 'shock_elevated' WHEN peak >= 0.5 THEN 'post_shock_stabilization' ELSE 'calm' END"
    return [
        ("z", f"SELECT *, {z} FROM es"), ("zi", f"SELECT bar_time, coalesce(({total}) / nullif({n}, 0), 0) AS i, {limit} AS m FROM z"),
        ("zs", f"SELECT *, count(i) {w} AS k, max(i) OVER (ORDER BY bar_time ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS peak FROM zi"), ("out", f"SELECT bar_time, round(i, 5) AS intensity, {state} AS state FROM zs"),
    ]


_YEARS = "(VALUES (1996), (1997), (1998), (1999), (2000), (2001)) y(y)"
_TOP = {m: f"SELECT bar_time, avg(label) AS {m} FROM (SELECT *, row_number() OVER (PARTITION BY bar_time ORDER BY {c} DESC, instrument_id) AS k FROM s2 WHERE {c} IS NOT NULL) x WHERE k <= 5 GROUP BY bar_time" for m, c in (("rank", "score"), ("zscore", "zscore"))}


def sql() -> dict[str, str]:
    q: dict[str, str] = {}
    bt, panel, scores = R.by_timestamp(), R.panel(), R.scores()
    tv = R._turnover(bt)
    q["topn_turnover"] = _on(tv, ("out", f"SELECT tv.feature, tv.bar_time, {_r('turnover', 'turnover')}, {_r('spread - turnover * 0.0013', 'cost_adjusted')} FROM tv JOIN bt ON tv.feature = bt.feature AND tv.bar_time = bt.bar_time"))
    q["quantile_summary"] = _on(
        R.ranked(), ("qb", "SELECT *, CAST(ceil(bottom_rank / n * 5) AS BIGINT) AS bucket FROM rk"), ("qt", "SELECT feature, bar_time, bucket, count(*) AS size, avg(y) AS m FROM qb GROUP BY feature, bar_time, bucket"),
        ("out", f"SELECT feature, CAST(bucket AS VARCHAR) AS bucket, {_r('avg(m)', 'mean_label')}, {_r('avg(size)', 'mean_size')} FROM qt GROUP BY feature, bucket UNION ALL SELECT feature, 'long_short', {_r('avg(d)', 'mean_label')}, NULL FROM (SELECT feature, bar_time, max(m) FILTER (bucket = 5) - max(m) FILTER (bucket = 1) AS d FROM qt GROUP BY feature, bar_time) x GROUP BY feature"),
    )
    summary = (
        ("fs", "SELECT feature, count(rank_ic) AS n_ts, avg(rank_ic) AS m, stddev_samp(rank_ic) AS s, avg((round(rank_ic, 10) > 0)::INT) AS h, avg(spread) AS sp, sum(n) AS n_rows FROM bt GROUP BY feature"),
        ("ft", "SELECT feature, avg(turnover) AS tm FROM tv GROUP BY feature"), ("fa", "SELECT count(*) AS n_all FROM panel WHERE label IS NOT NULL"),
    )
    liquid = " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(turnover) AS lq FROM panel WHERE {f} IS NOT NULL AND label IS NOT NULL" for f in R.FEATURES)
    se = "nullif(s / sqrt(n_ts), 0)"
    q["factor_summary"] = _on(tv, *summary, ("fl", liquid), ("out", f"SELECT fs.feature, n_ts, {_r('m', 'ic_mean')}, {_r('s', 'ic_std')}, {_r('h', 'hit_rate')}, {_r('s / sqrt(n_ts)', 'ic_se')}, {_r(f'm / {se}', 't_stat')}, {_r('m / nullif(s, 0)', 'ir')}, {_r('sp', 'spread_mean')}, {_r('tm', 'turnover_mean')}, {_r('n_rows / n_all', 'coverage')}, round(lq, 2) + 0.0 AS liquidity_mean FROM fs JOIN ft ON fs.feature = ft.feature JOIN fl ON fs.feature = fl.feature, fa"))
    checks = {"coverage": "coverage >= 0.95", "timestamps": "n_ts >= 300", "ic": "abs(m) >= 0.001", "t": f"abs(m / {se}) >= 2", "hit": "CASE WHEN direction > 0 THEN h ELSE 1 - h END >= 0.52", "years": "n_years >= 3", "stable_years": "n_stable >= 2", "spread": "cost_adjusted > 0", "turnover": "tm <= 0.95"}
    flags = ", ".join(f"coalesce({e}, FALSE) AS {n}_ok" for n, e in checks.items())
    informs = {"alpha_rank": (), "risk_penalty": ("spread", "turnover"), "state_allocator": tuple(n for n in checks if n not in ("coverage", "timestamps"))}
    told = "coalesce(" + " OR ".join(f"(role = '{r}' AND k IN ({', '.join(map(repr, names))}))" for r, names in informs.items() if names) + ", FALSE)"
    names = "[" + ", ".join(f"CASE WHEN NOT {n}_ok THEN '{n}' END" for n in sorted(checks)) + "]"
    q["admission_checks"] = _on(
        tv, *summary, ("ad", "SELECT fs.*, tm, CASE WHEN m < 0 THEN -1 ELSE 1 END AS direction, n_rows / n_all AS coverage FROM fs JOIN ft ON fs.feature = ft.feature, fa"),
        ("ay", "SELECT x.feature, count(*) AS n_years, count(*) FILTER (sign(x.ic) = ad.direction) AS n_stable FROM (SELECT feature, year(bar_time) AS y, avg(rank_ic) AS ic FROM bt WHERE rank_ic IS NOT NULL GROUP BY ALL) x JOIN ad ON x.feature = ad.feature GROUP BY x.feature"),
        ("ac", f"SELECT *, CASE feature WHEN 'f2' THEN 'risk_penalty' WHEN 'f3' THEN 'state_allocator' ELSE 'alpha_rank' END AS role, {flags} FROM (SELECT ad.*, n_years, n_stable, direction * sp - tm * 0.0013 AS cost_adjusted FROM ad JOIN ay ON ad.feature = ay.feature) x"),
        ("an", f"SELECT feature, k, {told} AS info, k IN ('coverage', 'timestamps', 'ic', 't', 'hit') AS hard FROM (SELECT feature, role, unnest({names}) AS k FROM ac) x WHERE k IS NOT NULL"),
        ("asx", "SELECT feature, coalesce(string_agg(k, ',' ORDER BY k) FILTER (NOT info), '') AS failed, coalesce(string_agg(k, ',' ORDER BY k) FILTER (info), '') AS informational, coalesce(bool_or(hard AND NOT info), FALSE) AS h, coalesce(bool_or(NOT hard AND NOT info), FALSE) AS w FROM an GROUP BY feature"),
        ("out", f"SELECT ac.feature, role, direction, n_years, n_stable, {_r('cost_adjusted', 'cost_adjusted')}, {', '.join(f'{n}_ok' for n in checks)}, coalesce(failed, '') AS failed, coalesce(informational, '') AS informational, CASE WHEN asx.h THEN 'reject' WHEN asx.w THEN 'watchlist' ELSE 'candidate' END AS status FROM ac LEFT JOIN asx ON ac.feature = asx.feature"),
    )
    pairs = list(combinations(WIDE, 2))
    ranks = ", ".join(f"{_rank(f)} AS r_{f}" for f in WIDE)
    long = lambda method, n, v, source, a, b: f"SELECT '{a}' AS a, '{b}' AS b, CAST({n} AS BIGINT) AS n, '{method}' AS method, {_r(v, 'value')} FROM {source}"
    count = lambda a, b: f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)"
    q["feature_corr"] = _on(panel, ("rr", f"SELECT {ranks} FROM panel"), ("out", " UNION ALL ".join(long("spearman", count(f"r_{a}", f"r_{b}"), _c(f"r_{a}", f"r_{b}"), "rr", a, b) for a, b in pairs)))
    each = [(f"m{i}", f"SELECT y, count(*) AS n, {_c('ra', 'rb')} AS c FROM (SELECT y, {_rank(a, 'y')} AS ra, {_rank(b, 'y')} AS rb FROM (SELECT year(bar_time) AS y, {a}, {b} FROM panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL) x) z GROUP BY y") for i, (a, b) in enumerate(pairs)]
    ranked = [long("spearman", "sum(n)", "sum(n * c) / sum(n)", f"m{i} WHERE c IS NOT NULL", a, b) for i, (a, b) in enumerate(pairs)]
    q["mergeable_corr"] = _on(panel, *each, ("out", " UNION ALL ".join([long("pearson", count(a, b), _c(a, b), "panel", a, b) for a, b in pairs] + ranked)))
    oriented = [("f1", "f1", "f2", "(-f2)"), ("f1", "f1", "f3", "f3"), ("f2", "(-f2)", "f3", "f3")]
    q["factor_corr_by_ts"] = _on(panel, ("out", " UNION ALL ".join(f"SELECT bar_time, '{a}' AS a, '{b}' AS b, {count(a, b)} AS n, 'pearson' AS method, {_r(_c(x, y), 'value')} FROM panel GROUP BY bar_time HAVING {count(a, b)} > 0" for a, x, b, y in oriented)))
    q["moments_corr"] = _on(panel, ("out", f"SELECT year(bar_time) AS y, count(*) AS n, {_r(_c('f1', 'f3'), 'corr')} FROM panel WHERE f1 IS NOT NULL AND f3 IS NOT NULL GROUP BY 1"))
    q["prediction_eval"] = _on(
        scores, ("pe", f"SELECT *, {_rank('score', 'bar_time')} AS rs, {_rank('label', 'bar_time')} AS rl, row_number() OVER (PARTITION BY bar_time ORDER BY score DESC, instrument_id) AS hi, row_number() OVER (PARTITION BY bar_time ORDER BY score, instrument_id) AS lo FROM scored WHERE label IS NOT NULL"),
        ("out", f"SELECT bar_time, count(*) AS n, {_r(_c('rs', 'rl'), 'rank_ic')}, {_r('avg(label) FILTER (hi <= 5)', 'top_label')}, {_r('avg(label) FILTER (lo <= 5)', 'bottom_label')}, {_r('avg(label) FILTER (hi <= 5) - avg(label) FILTER (lo <= 5)', 'spread')}, {_r('avg(label)', 'all_label')} FROM pe GROUP BY bar_time"),
    )
    q["yearly_health"] = _on(
        bt, ("yd", "SELECT feature, CASE WHEN avg(rank_ic) < 0 THEN -1 ELSE 1 END AS direction FROM bt GROUP BY feature"),
        ("out", f"SELECT bt.feature, direction, year(bar_time) AS y, {_r('avg(rank_ic)', 'ic')}, {_r('avg(CASE WHEN direction > 0 THEN top_label ELSE bottom_label END)', 'favoured_label')}, avg(rank_ic) * direction > 0 AS stable FROM bt JOIN yd ON bt.feature = yd.feature GROUP BY bt.feature, direction, year(bar_time)"),
    )
    q["purged_split"] = _on(panel, ("out", f"SELECT * FROM (SELECT bar_time, instrument_id, exit_time, CASE WHEN bar_time <= DATE '1996-12-31' AND exit_time < DATE '1996-12-25' THEN 'train' WHEN bar_time >= DATE '1997-01-01' AND bar_time <= DATE '1998-06-30' THEN 'valid' WHEN bar_time >= DATE '1998-07-01' THEN 'test' END AS part, {_r('label', 'label')} FROM panel WHERE label IS NOT NULL) x WHERE part IS NOT NULL"))
    q["walk_forward"] = _on(
        panel, ("wf", f"SELECT p.*, y, make_date(y - 1, 7, 1) AS v0, make_date(y - 1, 12, 31) AS v1 FROM panel p, {_YEARS} WHERE label IS NOT NULL AND bar_time >= DATE '1995-02-01'"),
        ("out", "SELECT bar_time, instrument_id, CAST(y AS VARCHAR) AS fold, 'test' AS part FROM wf WHERE year(bar_time) = y UNION ALL SELECT bar_time, instrument_id, CAST(y AS VARCHAR), 'valid' FROM wf WHERE bar_time >= v0 AND bar_time <= v1 UNION ALL SELECT bar_time, instrument_id, CAST(y AS VARCHAR), 'train' FROM wf WHERE bar_time < v0 AND exit_time < v0 - 10"),
    )
    q["hourly_split"] = _on(
        B.executable(B.hourly()), ("hs", "SELECT bar_time, instrument_id, bar_time + INTERVAL 90 MINUTE AS e, CAST((SELECT min(CAST(bar_time AS DATE)) FROM exec_bars) AS TIMESTAMP) AS d FROM exec_bars"),
        ("out", "SELECT bar_time, instrument_id, part FROM (SELECT *, unnest([CASE WHEN bar_time <= d + INTERVAL 231 HOUR AND e < d + INTERVAL 232 HOUR THEN 'train' END, CASE WHEN bar_time >= d + INTERVAL 14070 MINUTE AND bar_time <= d + INTERVAL 348 HOUR THEN 'valid' END, CASE WHEN bar_time >= d + INTERVAL 342 HOUR AND bar_time <= d + INTERVAL 483 HOUR THEN 'test' END]) AS part FROM hs) x WHERE part IS NOT NULL"),
    )
    q["time_split"] = _on(panel, ("out", "SELECT bar_time, instrument_id, CASE WHEN year(bar_time) >= 1997 THEN 'test' ELSE 'train' END AS part FROM panel WHERE label IS NOT NULL AND (year(bar_time) >= 1997 OR exit_time < DATE '1997-01-01')"))
    q["ml_purge"] = _on(panel, ("out", "SELECT bar_time, instrument_id, exit_time FROM panel WHERE label IS NOT NULL AND bar_time < DATE '1997-01-01' AND exit_time < DATE '1997-01-01'"))
    q["weights_signal"] = _on(
        panel, ("g1", f"SELECT bar_time, instrument_id, round({_rank('f1', 'bar_time')} / count(f1) OVER (PARTITION BY bar_time), 10) AS s FROM panel WHERE f1 IS NOT NULL"), ("g2", "SELECT *, row_number() OVER (PARTITION BY bar_time ORDER BY s DESC, instrument_id) AS k FROM g1"),
        ("out", f"SELECT bar_time, instrument_id, {_r('least(s / sum(s) OVER (PARTITION BY bar_time), 0.21)', 'weight')} FROM g2 WHERE k <= 5"),
    )
    q["t1_constraints"] = _on(
        R.rebalances(), ("sl", "SELECT o.*, CASE WHEN p.sellable_bar THEN 0.15 ELSE 0.0 END AS can FROM orders o LEFT JOIN panel p ON o.bar_time = p.bar_time AND o.instrument_id = p.instrument_id"),
        ("sm", "SELECT *, CASE WHEN delta < -can THEN -can ELSE delta END AS ok FROM sl"),
        ("out", f"SELECT bar_time, instrument_id, CASE WHEN ok > 0 THEN 'buy' WHEN ok < 0 THEN 'sell' WHEN delta < 0 THEN 'blocked' ELSE 'hold' END AS action, {_r('ok', 'allowed')}, {_r('ok - delta', 'blocked')} FROM sm"),
    )
    q["book_diagnostics"] = _on(R.weights(), ("out", f"SELECT bar_time, count(*) AS n, {_r('sum(score)', 'total')}, {_r('min(score)', 'least')}, {_r('max(score)', 'most')} FROM book GROUP BY bar_time"))
    num, den = "coalesce(0.5 * r_f1, 0) + coalesce(0.3 * scale * r_f2, 0) - coalesce(0.2 * r_f3, 0)", "CASE WHEN r_f1 IS NULL THEN 0 ELSE 0.5 END + CASE WHEN r_f2 IS NULL THEN 0 ELSE 0.3 * scale END + CASE WHEN r_f3 IS NULL THEN 0 ELSE 0.2 END"
    q["composite_scaled"] = _on(scores, *_MARKET, ("cs", "SELECT s1.*, coalesce(mkt.scale, 1.0) AS scale FROM s1 LEFT JOIN mkt ON s1.bar_time = mkt.bar_time"), ("out", f"SELECT bar_time, instrument_id, {_r(f'({num}) / nullif({den}, 0)', 'score')} FROM cs WHERE {den} > 0"))
    q["contribution_cap"] = _on(scores, *_capped(3), ("out", "SELECT bar_time, instrument_id, " + ", ".join(_r(f"c{i}", f"capped_{i}") for i in (1, 2, 3)) + " FROM k3"))
    q["contribution_share"] = _on(
        scores, _capped(0)[0], ("ks", "SELECT bar_time, coalesce(sum(abs(c1)), 0) AS a, coalesce(sum(abs(c2)), 0) AS b, coalesce(sum(abs(c3)), 0) AS c FROM k0 GROUP BY bar_time"),
        ("out", f"SELECT bar_time, {_r('a + b + c', 'total')}, {_r('greatest(a, b, c) / nullif(a + b + c, 0)', 'largest_share')}, {_r('(a + b + c - least(a, b, c)) / nullif(a + b + c, 0)', 'top_two_share')} FROM ks"),
    )
    q["factor_health"] = _on(bt, *_health("ha", 12), ("out", f"SELECT feature, bar_time, {_r('scale', 'scale')}, {_r('ic_r', 'ic_r')}, state FROM ha"))
    joined = ("hj", "SELECT ha.bar_time, ha.feature, ha.scale AS n, hb.scale AS s, CASE WHEN mkt.scale < 0.999 THEN 1.0 ELSE 0.0 END AS w, 1 - coalesce(mkt.scale, 1.0) AS v FROM ha JOIN hb ON ha.bar_time = hb.bar_time AND ha.feature = hb.feature LEFT JOIN mkt ON ha.bar_time = mkt.bar_time")
    both = [*_health("ha", 12), *_health("hb", 6), *_MARKET, joined]
    q["state_health"] = _on(bt, *both, ("out", f"SELECT bar_time, feature, {_r('CASE WHEN w = 1 THEN s ELSE n END', 'scale')}, {_r('n', 'normal_scale')}, {_r('s', 'stress_scale')}, 'state_conditioned_health_memory' || CASE WHEN w = 1 THEN ',stress_health_memory' ELSE '' END AS reason FROM hj"))
    q["state_health_blend"] = _on(bt, *both, ("out", f"SELECT bar_time, feature, {_r('n * (1 - v) + s * v', 'scale')} FROM hj"))
    q["schedule_combine"] = _on(
        bt, *_health("ha", 12), *_MARKET, ("sj", "SELECT coalesce(ha.bar_time, t.bar_time) AS bar_time, coalesce(ha.feature, 'f1') AS feature, coalesce(ha.scale, 1.0) AS a, t.scale AS b FROM ha FULL JOIN (SELECT * FROM mkt WHERE scale < 1) t ON ha.bar_time = t.bar_time AND ha.feature = 'f1'"),
        ("out", f"SELECT bar_time, feature, {_r('least(a, coalesce(b, 1.0))', 'min')}, {_r('a * coalesce(b, 1.0)', 'product')}, {_r('coalesce(b, a)', 'override')} FROM sj"),
    )
    q["exposure_combine"] = _on(panel, *_MARKET, ("out", f"SELECT t.bar_time, {_r('least(0.8, coalesce(scale, 1.0))', 'scale')} FROM (SELECT DISTINCT bar_time FROM panel) t LEFT JOIN mkt ON t.bar_time = mkt.bar_time"))
    q["weight_schedule"] = _on(bt, *_weights(4), ("out", f"SELECT bar_time, feature, {_r('coalesce(least(w, 0.5) / nullif(sum(least(w, 0.5)) OVER (PARTITION BY bar_time), 0), 1 / 3.0)', 'weight')} FROM v4"))
    q["regime_weights"] = _on(panel, *_MARKET, *_REGIME_WEIGHTS)
    q["execution_quality"] = "WITH RECURSIVE " + _on(R.weekly(), *_QUALITY).removeprefix("WITH ")
    q["score_switch_ts"] = _on(scores, *_MARKET, ("sx", "SELECT bar_time FROM mkt WHERE regime = 'stress'"), ("out", f"SELECT bar_time, instrument_id, {_r('score', 'score')}, 'first' AS source FROM scored WHERE bar_time NOT IN (SELECT bar_time FROM sx) UNION ALL SELECT bar_time, instrument_id, {_r('zscore', 'score')}, 'second' FROM s2 WHERE zscore IS NOT NULL AND bar_time IN (SELECT bar_time FROM sx)"))
    q["adaptive_switch"] = _on(
        scores, *_MARKET, ("ta", _TOP["rank"]), ("tb", _TOP["zscore"]), ("st", "SELECT bar_time, percent_rank() OVER (ORDER BY before) AS sr FROM mk1 WHERE before IS NOT NULL"),
        ("dy", "SELECT st.bar_time AS d, sr, zscore - rank AS edge FROM st JOIN ta ON st.bar_time = ta.bar_time JOIN tb ON st.bar_time = tb.bar_time"), ("mo", "SELECT DISTINCT CAST(date_trunc('month', d) AS DATE) AS month FROM dy"),
        ("am", "SELECT month, q, count(*) AS n, avg(edge) AS me, avg(edge) / nullif(stddev_samp(edge) / sqrt(count(*)), 0) AS t FROM mo JOIN dy ON d < month - INTERVAL 7 DAY AND d >= month - INTERVAL 12 MONTH JOIN (VALUES (0.0), (0.25), (0.5), (0.75)) qs(q) ON sr >= q WHERE edge IS NOT NULL GROUP BY month, q"),
        ("ab", "SELECT *, row_number() OVER (PARTITION BY month ORDER BY round(me, 9) DESC, q) AS k FROM am WHERE n >= 6 AND me > 0"),
        ("out", f"SELECT mo.month, CAST(q AS DOUBLE) AS q, n, {_r('me', 'mean_edge')}, {_r('t', 't')} FROM mo LEFT JOIN ab ON mo.month = ab.month AND k = 1"),
    )
    sources = ("pressure", "imbalance", "close_price", "volume", "turnover", "high_price")
    spread = ", ".join(f"round(stddev_samp({c}), 6) AS {c}" for c in sources[2:])
    q["event_states"] = _on(B.executable(B.daily(), 100), ("es", f"SELECT bar_time, round(avg(limit_up_open::INT) + avg(limit_down_open::INT), 9) AS pressure, round(avg(limit_down_open::INT) - avg(limit_up_open::INT), 9) AS imbalance, {spread} FROM exec_bars GROUP BY bar_time"), *_event(sources))
    symbol = "(['600', '000', '300', '601', '688'])[CAST(s_suppkey % 5 + 1 AS INT)] || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') || CASE WHEN s_suppkey % 2 = 0 THEN '.sh' ELSE '.SZ ' END"
    q["main_board_filter"] = f"SELECT s_suppkey, symbol FROM (SELECT *, {symbol} AS symbol FROM supplier) x WHERE (regexp_matches(upper(trim(symbol)), '^60[0135].*[.]SH$') OR regexp_matches(upper(trim(symbol)), '^00[0123].*[.]SZ$')) AND s_nationkey % 3 <> 2"
    q["universe_counts"] = _on(panel, ("out", "SELECT 'all' AS rule, count(*) AS n_in, count(*) AS n_out FROM panel UNION ALL SELECT 'rising', count(*), count(*) FILTER (f1 > 0) FROM panel"))
    q["dataset_scan"] = _on(panel, ("out", f"SELECT bar_time, instrument_id, {_r('f1', 'f1')}, {_r('label', 'label')}, strftime(bar_time, '%Y_%m') AS period FROM panel WHERE bar_time >= DATE '1995-02-01' AND bar_time < DATE '1995-05-01'"))
    q["bars_of_names"] = "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey IN (1, 2, 3, 7)"
    q["trade_calendar"] = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS trade_date FROM orders"
    q["reversal_factor"] = _on(
        R.weekly(), ("rv", "SELECT bar_time, instrument_id, 1 - close_price / nullif(lag(close_price, 2) OVER i, 0) AS v, CASE WHEN count(turnover) OVER f = 4 THEN avg(turnover) OVER f END AS lq FROM exec_bars WINDOW i AS (PARTITION BY instrument_id ORDER BY bar_time), f AS (PARTITION BY instrument_id ORDER BY bar_time ROWS 3 PRECEDING)"),
        ("out", f"SELECT bar_time, instrument_id, {_r('v', 'value')}, 'reversal' AS feature FROM rv WHERE v IS NOT NULL AND lq >= 50000"),
    )
    q["core_window"] = _on(panel, ("out", f"SELECT bar_time, instrument_id, {_r('label', 'label')} FROM panel WHERE year(bar_time) = 1995"))
    q["enriched"] = "SELECT o_orderkey, o_custkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
    q["repeated_keys"] = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"
    q["segment_bars"] = _on(R.weekly(), ("sb", "SELECT instrument_id, min(bar_time) AS a FROM exec_bars GROUP BY instrument_id"), ("out", "SELECT b.bar_time, b.instrument_id, CAST(k AS INT) AS segment FROM exec_bars b JOIN sb ON b.instrument_id = sb.instrument_id JOIN range(3) r(k) ON date_diff('day', a, b.bar_time) > 70 * k AND date_diff('day', a, b.bar_time) <= 70 * k + 35"))
    q["holdings_at_times"] = _on(panel, ("out", "SELECT t.bar_time, n_nationkey AS instrument_id FROM (SELECT DISTINCT bar_time FROM panel) t, {nation} WHERE n_nationkey < 5"))
    q["months_compared"] = _on(
        scores, ("ma", _TOP["rank"].replace("SELECT bar_time, avg(label)", "SELECT strftime(bar_time, '%Y-%m') AS month, avg(label)").replace("GROUP BY bar_time", "GROUP BY 1")), ("mb", _TOP["zscore"].replace("SELECT bar_time, avg(label)", "SELECT strftime(bar_time, '%Y-%m') AS month, avg(label)").replace("GROUP BY bar_time", "GROUP BY 1")),
        ("out", f"SELECT coalesce(ma.month, mb.month) AS month, {_r('rank', 'base_ret')}, {_r('zscore', 'other_ret')}, {_r('zscore - rank', 'diff_ret')} FROM ma FULL JOIN mb ON ma.month = mb.month"),
    )
    q["monthly_diagnosis"] = _on(scores, ("out", f"SELECT strftime(bar_time, '%Y-%m') AS month, {_r('avg(score)', 'mean_score')}, {_r('avg((label > 0)::INT)', 'share_rising')}, count(DISTINCT instrument_id) AS names FROM scored GROUP BY 1"))
    gap = lambda f: _r(f"avg({f}) FILTER (label < 0) - avg({f}) FILTER (label > 0)", f"gap_{f}")
    q["residual_tables"] = _on(scores, ("out", f"SELECT year(bar_time) AS y, count(*) AS n, {_r('sum(label * volume) / nullif(sum(volume), 0)', 'weighted_mean')}, {_r('avg((label < 0)::INT)', 'share_below')}, {_r(_c('f1', 'label'), 'corr_f1')}, {gap('f1')}, {_r(_c('f3', 'label'), 'corr_f3')}, {gap('f3')} FROM scored WHERE score_rank <= 20 AND label IS NOT NULL GROUP BY 1"))
    q["exec_diagnostics"] = _on_steps(*_RUNS, ("out", _DIAGNOSTICS))
    q["exec_event_reasons"] = _on_steps(*_RUNS, ("out", "SELECT run, reason, count(*) AS n FROM x3 GROUP BY run, reason"))
    q["worst_weeks"] = _on(bt, ("out", f"SELECT feature, bar_time, {_r('spread', 'spread')} FROM bt WHERE spread IS NOT NULL ORDER BY round(bt.spread, 9), feature, bar_time LIMIT 10"))
    q["ml_weights"] = _on(panel, ("mw", f"SELECT bar_time, instrument_id, {_rank('label', 'bar_time')} / count(label) OVER (PARTITION BY bar_time) AS p FROM panel WHERE label IS NOT NULL"), ("out", "SELECT bar_time, instrument_id, CASE WHEN p <= 0.1 OR p > 0.9 THEN 3.0 ELSE 1.0 END AS sample_weight FROM mw"))
    rules = " UNION ALL ".join(f"SELECT {x} AS q, '{side}' AS side, count(*) AS n, {_r('exp(sum(ln(1 + ret))) - 1', 'total_return')} FROM ms WHERE s {op} (SELECT quantile_cont(s, {x}) FROM ms)" for x in (0.25, 0.5) for side, op in (("below", "<="), ("above", ">=")))
    q["switch_rules"] = _on(scores, ("mn", "SELECT strftime(bar_time, '%Y-%m') AS month, round(stddev_samp(f1), 9) AS sd, round(avg(label), 9) AS ret FROM scored WHERE label IS NOT NULL GROUP BY 1"), ("ms", "SELECT * FROM (SELECT *, lag(sd) OVER (ORDER BY month) AS s FROM mn) x WHERE s IS NOT NULL"), ("out", rules))
    q["ticks_to_bars"] = f"SELECT event_type AS instrument_id, date_trunc('hour', ts) AS bar_time, {_r('arg_min(value, ts)', 'open_price')}, {_r('max(value)', 'high_price')}, {_r('min(value)', 'low_price')}, {_r('arg_max(value, ts)', 'close_price')}, count(*) AS volume, {_r('sum(value)', 'turnover')} FROM events GROUP BY 1, 2"
    words = "string_split(regexp_replace(lower(coalesce(source, '')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    q["text_functions"] = f"SELECT doc_id, array_to_string(list_sort(list_distinct([w for w in {words} if w <> ''])), ',') AS tokens, lower(coalesce(lang, 'No')) NOT IN ('0', 'false', 'no', 'n', 'off', '') AS flag, TRY_CAST(source AS INT) AS number, lang AS back, CAST(len({words}) AS BIGINT) AS n_words FROM documents"
    second = f"CASE WHEN zscore IS NOT NULL THEN {_rank('zscore', 'bar_time')} / count(zscore) OVER (PARTITION BY bar_time) END"
    q["overlay_blend"] = _on(scores, ("ov", f"SELECT bar_time, instrument_id, {_rank('score', 'bar_time')} / count(score) OVER (PARTITION BY bar_time) AS a, {second} AS b FROM scored"), ("out", f"SELECT bar_time, instrument_id, {_r('0.7 * a + 0.3 * coalesce(b, 0.5)', 'score')} FROM ov"))
    alike = "0.3 * coalesce(x.p_brand = y.p_brand, FALSE)::INT + 0.15 * coalesce(x.p_size = y.p_size, FALSE)::INT + 0.25 * coalesce(abs(x.p_retailprice - y.p_retailprice) < 5, FALSE)::INT"
    named = "WITH c AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, p_size, p_retailprice) AS first_one FROM part)"
    which = "x.p_partkey < y.p_partkey AND x.first_one = x.p_partkey AND (y.first_one = y.p_partkey OR y.first_one = x.p_partkey)"
    q["research_memory"] = f"{named} SELECT * FROM (SELECT x.p_partkey AS a, y.p_partkey AS b, round(CAST({alike} AS DOUBLE), 6) AS similarity FROM c x JOIN c y ON {which}) z WHERE similarity >= 0.35"
    return q
