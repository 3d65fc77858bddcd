"""Queries of order statistics, interval joins, universes and research memory, and the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import comparison as formulas
from ..sources import bars as B
from ..sources.scratch import scratch_root
from ..streaming.features import batch_features
from . import intervals, memory, orderstats, relations, research, sinks, views
from .registered import KEYS, bars, tidy


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as research entries: every fourth is active, some name the part at the last multiple of 50."""
    p, key = spark.read.parquet(f"{folder}/part.parquet"), F.col("p_partkey")
    named = F.when(key % 7 == 0, F.array(key - key % 50))
    state = F.element_at(F.array(*map(F.lit, ("active", "watchlist", "reject", "deprecated"))), (key % 4 + 1).cast("int"))
    return p.select(key.alias("id"), F.col("p_brand").alias("family"), F.split("p_name", " ").alias("inputs"), F.col("p_size").alias("look"), memory.keywords(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("keywords"), state.alias("status"), named.alias("similar_to"))


def research_matches(spark, folder):
    """Proposals are the parts whose id is divisible by 50, against all."""
    e = _entries(spark, folder)
    return tidy(memory.research_matches(e.where("id % 50 = 0"), e))


def _instruments(spark: SparkSession, folder: str) -> DataFrame:
    s, k = spark.read.parquet(f"{folder}/supplier.parquet"), F.col("s_suppkey")
    since = F.date_add(F.lit("1992-06-01").cast("date"), (k * 37 % 900).cast("int"))
    return s.select(
        k.cast("string").alias("instrument_id"), F.concat(F.lit("S"), k).alias("canonical_code"), F.when(F.col("s_nationkey") % 3 == 0, "HK").otherwise("CN").alias("market"), F.when(k % 11 == 0, "fund").otherwise("equity").alias("asset_type"),
        F.when(k % 5 != 0, since).alias("effective_from"), F.when(k % 7 != 0, F.date_add(since, 800)).alias("effective_to"),
    )


def universe_members(spark, folder):
    """A static, a resolved and a wildcard universe."""
    known = _instruments(spark, folder)
    built = {
        "static": intervals.universe_members(["S1", "S999999"], spark=spark, market="CN", asset_type="equity", start="1993-01-01"),
        "resolved": intervals.universe_members(["S1", "S2", "S5", "S999999"], known, market="CN", asset_type="equity", start="1993-01-01", end="1994-12-31"),
        "wildcard": intervals.universe_members(["*"], known, market="CN", asset_type="equity", start="1993-06-01"),
    }
    out = None
    for name, rows in built.items():
        rows = rows.select(F.lit(name).alias("kind"), *intervals.MEMBER)
        out = rows if out is None else out.unionByName(rows)
    return out


def universe_bars(spark, folder):
    """Weekly bars of the members of a wildcard universe while they are effective."""
    members = intervals.universe_members(["*"], _instruments(spark, folder), market="CN", asset_type="equity")
    return intervals.in_universe(bars(spark, folder).select(*KEYS), members).select(*KEYS, "symbol")


def hourly_moves(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.executable(B.hourly()).over(spark, folder)
    return rows.select("bar_time", F.abs(F.col("close_price") / F.when(F.col("open_price") != 0, F.col("open_price")) - 1).alias("move"))


def daily_state(spark, folder):
    return tidy(orderstats.daily_switch(hourly_moves(spark, folder), "move", 0.7, 5))


def score_switch_daily(spark, folder):
    """The z-score composite on days after dispersion reached its quantile of all days before, else the rank composite."""
    days = orderstats.daily_switch(research.run(research.market(), spark, folder), "m_vol", 0.7, 12)
    rows = research.scored(spark, folder)
    out = rows.join(days.select(F.col("day"), F.col("active").alias("use_z")), F.to_date(rows["bar_time"]) == F.col("day"))
    return tidy(out.select(*KEYS, "use_z", F.when(F.col("use_z"), F.col("zscore")).otherwise(F.col("score")).alias("score")))


def artifact_table(spark, folder):
    """Writes the reversal factor as a table with a manifest, skips a second time, and reads it back with its hashes checked."""
    root, rows = f"{scratch_root(spark)}/artifacts-{uuid.uuid4().hex}", relations.run_factor(relations.Reversal(2, 4), bars(spark, folder))
    source = sinks.signature(factor="reversal", back=2, window=4)
    for again in (False, True):
        if sinks.write_table(rows, root, "factors", "reversal", source)[1] is again:
            raise RuntimeError("a table with an equal signature was written again, or none was written")
    return tidy(sinks.read_table(spark, root, "factors", "reversal", verify=True))


def score_partitions(spark, folder):
    """Scores of two methods by method and period; one year of one is read back, from its folders alone."""
    root = f"{scratch_root(spark)}/artifacts-{uuid.uuid4().hex}"
    rows = research.scored(spark, folder).select(*KEYS, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("score")) for m, c in (("rank", "score"), ("zscore", "zscore"))))).alias("s")).select(*KEYS, "s.*")
    sinks.write_scores(rows, root, "composite")
    out = sinks.read_table(spark, root, "scores", "composite").where("method = 'zscore' AND period BETWEEN '1995_01' AND '1995_12'")
    return tidy(out.select(*KEYS, "score", "method", "period"))


def sql_surface(spark, folder):
    """SQL alone over the views: two families joined with the bars."""
    views.register(spark, folder, ["momentum", "volatility"])
    return spark.sql("""
      SELECT b.bar_time, b.instrument_id, round(b.close_price, 6) + 0e0 AS close_price, m.momentum_lb3, v.volatility_w12 FROM bars_daily b
      LEFT JOIN feat_momentum m ON m.instrument_id = b.instrument_id AND m.bar_time = b.bar_time
      LEFT JOIN feat_volatility v ON v.instrument_id = b.instrument_id AND v.bar_time = b.bar_time WHERE b.tradable_bar""")


def sql_ewm(spark, folder):
    """SQL alone: the table function over weekly closes, partitioned and ordered by the query."""
    views.register(spark, folder, [])
    return spark.sql("""
      SELECT instrument_id, CAST(bar_time AS DATE) AS bar_time, round(value, 6) + 0e0 AS close_price, round(ewm, 6) + 0e0 AS ewm
      FROM ewm(TABLE(SELECT instrument_id, CAST(bar_time AS TIMESTAMP_NTZ) AS bar_time, close_price AS value FROM bars_weekly) PARTITION BY instrument_id ORDER BY (bar_time), 5)""")


def bar_features(spark, folder):
    """What the stream of ticks emits, of the table of ticks."""
    out = batch_features(spark.read.parquet(f"{folder}/events.parquet"))
    return tidy(out.withColumn("bar_time", F.col("bar_time").cast("timestamp_ntz")))


def bar_dedup(spark, folder):
    """One line for each order and number: even numbers come from the preferred version."""
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").withColumn("version", F.col("l_linenumber") % 2)
    prefer = [F.col(c) for c in ("version", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")]
    return relations.latest_version(rows, ["l_orderkey", "l_linenumber"], prefer).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def queries() -> dict:
    return {f.__name__: f for f in (bar_dedup, research_matches, universe_members, universe_bars, daily_state, score_switch_daily, artifact_table, score_partitions, sql_surface, sql_ewm, bar_features)}


# ------------------------------------------------------------------------------------ other engine
_MATCHES = """
WITH e AS (SELECT p_partkey AS id, p_brand AS family, p_size AS look, (['active', 'watchlist', 'reject', 'deprecated'])[CAST(p_partkey % 4 + 1 AS INT)] AS status,
  list_distinct(string_split(p_name, ' ')) AS ins, [w for w in list_distinct(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_brand), '[^a-z0-9]+')) if len(w) >= 3] AS kw,
  CASE WHEN p_partkey % 7 = 0 THEN p_partkey - p_partkey % 50 END AS named FROM part),
x AS (SELECT p.id AS proposal, e.id AS entry, e.status, CASE WHEN p.family = e.family THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS a,
  0.25::DOUBLE * (len(list_intersect(p.ins, e.ins)) / len(list_distinct(list_concat(p.ins, e.ins)))) AS b, 1 - least(abs(p.look - e.look) / greatest(p.look, e.look, 1), 1) AS k,
  0.2::DOUBLE * (len(list_intersect(p.kw, e.kw)) / len(list_distinct(list_concat(p.kw, e.kw)))) AS c, CASE WHEN e.named = p.id THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS d
  FROM e p JOIN e ON p.id % 50 = 0 AND p.id <> e.id AND e.status <> 'active'),
y AS (SELECT *, CASE WHEN k >= 0.5 THEN 0.15::DOUBLE * k ELSE 0::DOUBLE END AS l FROM x)
SELECT proposal, entry, status, round(a + b + l + c + d, 6) + 0.0 AS similarity,
  concat_ws(',', CASE WHEN a > 0 THEN 'family' END, CASE WHEN b > 0 THEN 'required_inputs' END, CASE WHEN l > 0 THEN 'lookback_bars' END, CASE WHEN c > 0 THEN 'keywords' END, CASE WHEN d > 0 THEN 'similar_to' END) AS matched,
  status <> 'watchlist' AS blocking
FROM y WHERE a + b + l + c + d >= 0.35::DOUBLE
"""
_KNOWN = """SELECT CAST(s_suppkey AS VARCHAR) AS instrument_id, 'S' || s_suppkey AS symbol, CASE WHEN s_nationkey % 3 = 0 THEN 'HK' ELSE 'CN' END AS market, CASE WHEN s_suppkey % 11 = 0 THEN 'fund' ELSE 'equity' END AS asset_type,
  CASE WHEN s_suppkey % 5 <> 0 THEN DATE '1992-06-01' + CAST(s_suppkey * 37 % 900 AS INT) END AS effective_from, CASE WHEN s_suppkey % 7 <> 0 THEN DATE '1992-06-01' + CAST(s_suppkey * 37 % 900 + 800 AS INT) END AS effective_to FROM supplier"""


def sql() -> dict[str, str]:
    def on(base, *steps):
        for name, text in steps:
            base = base.then(name, text)
        return base.text()

    r = lambda x, n: f"round({x}, 6) + 0.0 AS {n}"
    daily = B.executable(B.daily())
    families = ", ".join(f"{n} AS ({t})" for n, t in formulas.sql({"momentum": daily, "volatility": daily}).items())
    return {
        "bar_dedup": "SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem ORDER BY l_orderkey, l_linenumber, l_linenumber % 2, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate",
        "artifact_table": on(research.weekly(), ("av", "SELECT bar_time, instrument_id, 1 - close_price / nullif(lag(close_price, 2) OVER (PARTITION BY instrument_id ORDER BY bar_time), 0) AS v FROM exec_bars"), ("out", f"SELECT bar_time, instrument_id, {r('v', 'value')}, 'reversal' AS feature FROM av WHERE v IS NOT NULL")),
        "score_partitions": on(research.scores(), ("out", f"SELECT bar_time, instrument_id, {r('zscore', 'score')}, 'zscore' AS method, strftime(bar_time, '%Y_%m') AS period FROM scored WHERE year(bar_time) = 1995")),
        "sql_surface": f"WITH {families}, b AS ({daily.then('out', 'SELECT * FROM exec_bars').text()}) SELECT b.bar_time, b.instrument_id, {r('b.close_price', 'close_price')}, momentum_lb3, volatility_w12 FROM b LEFT JOIN momentum m ON m.instrument_id = b.instrument_id AND m.bar_time = b.bar_time LEFT JOIN volatility v ON v.instrument_id = b.instrument_id AND v.bar_time = b.bar_time WHERE b.tradable_bar",
        "sql_ewm": "WITH RECURSIVE " + on(
            research.weekly(), ("k1", "SELECT instrument_id, bar_time, close_price AS x, row_number() OVER (PARTITION BY instrument_id ORDER BY bar_time) AS k FROM exec_bars"),
            ("kr(instrument_id, bar_time, k, x, y)", "SELECT instrument_id, bar_time, k, x, x FROM k1 WHERE k = 1 UNION ALL SELECT k1.instrument_id, k1.bar_time, k1.k, k1.x, 0.5 ** 0.2 * y + (1 - 0.5 ** 0.2) * k1.x FROM kr JOIN k1 ON kr.instrument_id = k1.instrument_id AND k1.k = kr.k + 1"),
            ("out", f"SELECT instrument_id, bar_time, {r('x', 'close_price')}, {r('CASE WHEN k >= 5 THEN y END', 'ewm')} FROM kr"),
        ).removeprefix("WITH "),
        "bar_features": f"""WITH b AS (SELECT event_type AS instrument_id, date_trunc('hour', ts) AS bar_time, arg_min(value, ts) AS o, max(value) AS h, min(value) AS l, arg_max(value, ts) AS c, count(*) AS n, sum(value) AS t FROM events WHERE value IS NOT NULL GROUP BY ALL),
          w AS (SELECT *, count(*) OVER z AS k, avg(c) OVER z AS m, max(h) OVER z AS x, lag(c, 4) OVER (PARTITION BY instrument_id ORDER BY bar_time) AS p FROM b WINDOW z AS (PARTITION BY instrument_id ORDER BY bar_time ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
          SELECT instrument_id, bar_time, {r('o', 'open_price')}, {r('h', 'high_price')}, {r('l', 'low_price')}, {r('c', 'close_price')}, n AS volume, {r('t', 'turnover')}, {r('CASE WHEN k = 4 THEN m END', 'mean_close')}, {r('CASE WHEN k = 4 THEN x END', 'range_high')}, {r('c / nullif(p, 0) - 1', 'return_n')} FROM w""",
        "research_matches": _MATCHES,
        "universe_members": f"WITH k AS ({_KNOWN}) SELECT 'static' AS kind, s AS symbol, s AS instrument_id, 'CN' AS market, 'equity' AS asset_type, DATE '1993-01-01' AS effective_from, CAST(NULL AS DATE) AS effective_to FROM (VALUES ('S1'), ('S999999')) v(s) UNION ALL SELECT 'resolved', symbol, instrument_id, market, asset_type, DATE '1993-01-01', DATE '1994-12-31' FROM k WHERE symbol IN ('S1', 'S2', 'S5', 'S999999') AND market = 'CN' AND asset_type = 'equity' UNION ALL SELECT 'wildcard', symbol, instrument_id, market, asset_type, effective_from, effective_to FROM k WHERE market = 'CN' AND asset_type = 'equity' AND coalesce(effective_from, DATE '1900-01-01') <= DATE '1993-06-01' AND coalesce(effective_to, DATE '2900-01-01') >= DATE '1993-06-01'",
        "universe_bars": on(research.weekly(), ("kn", _KNOWN.replace("FROM supplier", "FROM {supplier}")), ("out", "SELECT b.bar_time, b.instrument_id, k.symbol FROM exec_bars b JOIN kn k ON b.instrument_id = k.instrument_id AND market = 'CN' AND asset_type = 'equity' AND (effective_from IS NULL OR effective_from <= b.bar_time) AND (effective_to IS NULL OR effective_to >= b.bar_time)")),
        "daily_state": on(
            B.executable(B.hourly()), ("d1", "SELECT bar_time, avg(abs(close_price / nullif(open_price, 0) - 1)) AS s FROM exec_bars GROUP BY bar_time"), ("d2", "SELECT CAST(bar_time AS DATE) AS day, round(avg(s), 12) AS state FROM d1 GROUP BY 1"),
            ("d3", "SELECT a.day, any_value(a.state) AS state, CASE WHEN count(b.state) >= 5 THEN quantile_cont(b.state, 0.7) END AS q FROM d2 a LEFT JOIN d2 b ON b.day < a.day GROUP BY a.day"),
            ("d4", "SELECT *, lag(state) OVER (ORDER BY day) AS lagged FROM d3"), ("out", f"SELECT day, {r('state', 'state')}, {r('lagged', 'lagged')}, {r('q', 'quantile')}, coalesce(lagged >= q, FALSE) AS active FROM d4"),
        ),
        "score_switch_daily": on(
            research.market(), ("w1", "SELECT bar_time, round(m_vol, 12) AS v, lag(round(m_vol, 12)) OVER (ORDER BY bar_time) AS lv FROM market_ts"),
            ("w2", "SELECT a.bar_time, any_value(a.lv) AS lv, count(b.v) AS n, quantile_cont(b.v, 0.7) AS ql FROM w1 a LEFT JOIN w1 b ON b.bar_time < a.bar_time GROUP BY a.bar_time"),
            ("w3", "SELECT bar_time, coalesce(n >= 12 AND lv >= ql, FALSE) AS use_z FROM w2"), ("out", f"SELECT s.bar_time, s.instrument_id, use_z, {r('CASE WHEN use_z THEN zscore ELSE score END', 'score')} FROM scored s JOIN w3 ON s.bar_time = w3.bar_time"),
        ),
    }
