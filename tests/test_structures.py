"""Scans, pair moments, order statistics, interval joins and set joins against plain calculations."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tapeloom.operators import intervals, memory, moments, orderstats, recurrence, relations


def _series(n: int, keys: int, seed: int) -> pd.DataFrame:
    """Keys of unequal length (one holds most rows, one is null), values with gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(keys):
        size = n if k == 0 else max(1, n // (7 * k))
        for t in rng.choice(10 * n, size, replace=False):
            rows.append((None if k == 1 else f"k{k}", int(t), None if rng.random() < 0.4 else float(rng.normal(1, 2))))
    return pd.DataFrame(rows, columns=["k", "t", "x"])


@pytest.mark.parametrize("block_rows", [1, 7, 50, 10_000])
def test_ewm_equals_the_recursion(spark, block_rows):
    pdf = _series(300, 5, 1)
    df = spark.createDataFrame(list(pdf.where(pdf.notna(), None).itertuples(index=False, name=None)), "k string, t long, x double").withColumn("other", F.lit(1))
    got = recurrence.ewm_mean(df, ["k"], "t", "x", 3, block_rows=block_rows)
    assert got.columns == ["k", "t", "x", "other", "ewm"]
    have = {(r.k, r.t): r.ewm for r in got.collect()}
    assert len(have) == len(pdf)
    for k, g in pdf.groupby("k", dropna=False):
        want = g.sort_values("t").set_index("t").x.ewm(halflife=3, adjust=False, min_periods=3).mean()
        for t, v in want.items():
            y = have[None if pd.isna(k) else k, t]
            assert (y is None) == pd.isna(v) and (y is None or math.isclose(y, v, rel_tol=1e-9)), (k, t)


def test_a_history_is_spread_over_tasks(spark):
    df = spark.range(2000).selectExpr("'one' AS k", "id AS t", "cast(id % 5 AS double) AS x")
    cut = recurrence.time_blocks(df, ["k"], "t", 100)
    sizes = [r["count"] for r in cut.rows.groupBy("__cell").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 300
    got = recurrence.linear_recurrence(df, ["k"], "t", {"s": (F.lit(0.5), F.col("x"), 4.0), "n": (F.lit(1.0), F.lit(1.0), 0.0)}, 100).orderBy("t").collect()
    y = 4.0
    for i, r in enumerate(got):
        assert math.isclose(r.s_before, y, rel_tol=1e-9) and r.n == i + 1 and r.n_before == i
        y = 0.5 * y + r.x
        assert math.isclose(r.s, y, rel_tol=1e-9)


def test_recurrence_of_an_empty_table(spark):
    assert recurrence.ewm_mean(spark.createDataFrame([], "k string, t long, x double"), ["k"], "t", "x", 2).count() == 0


def _wide(seed=2, rows=400, p=12) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    x = rng.normal(100, 3, (rows, p)) + rng.normal(0, 3, (rows, 1))
    x[:, 3] = np.round(x[:, 3])  # ties
    x[rng.random((rows, p)) < np.linspace(0, 0.4, p)] = np.nan
    x[:, 5] = 7.0  # constant
    out = pd.DataFrame(x, columns=[f"c{i}" for i in range(p)])
    return out.assign(bar_time=np.arange(rows) % 9, instrument_id=np.arange(rows) // 9)


def _frame(spark, pdf):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False, name=None)], ", ".join(f"{c} {'double' if c.startswith('c') else 'long'}" for c in pdf.columns))


def _same(got, want, tol=1e-8):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == pd.isna(v) and (got[k] is None or abs(got[k] - v) < tol), (k, got[k], v)


def test_pair_correlations_with_nulls(spark):
    pdf, names = _wide(), [f"c{i}" for i in range(12)]
    df = _frame(spark, pdf)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    whole = pdf[names].corr(min_periods=2)
    _same({(r.a, r.b): r.value for r in moments.correlations(df, names).collect()}, {(a, b): whole.loc[a, b] for a, b in pairs})
    by = {t: g[names].corr(min_periods=2) for t, g in pdf.groupby("bar_time")}
    _same({(r.bar_time, r.a, r.b): r.value for r in moments.correlations(df, names, ["bar_time"]).collect()}, {(t, a, b): m.loc[a, b] for t, m in by.items() for a, b in pairs})
    n = {(r.a, r.b): r.n for r in moments.pair_moments(df, names).collect()}
    assert n == {(a, b): int((pdf[a].notna() & pdf[b].notna()).sum()) for a, b in pairs}
    parts = moments.merged(moments.pair_moments(df, names, ["bar_time"]))
    assert {(r.a, r.b): int(r.n) for r in parts.collect()} == n


def test_rank_correlations_with_nulls(spark):
    pdf, names = _wide(), [f"c{i}" for i in range(12)]
    df = _frame(spark, pdf)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    ranks = pdf[names].rank().corr(min_periods=2)
    _same({(r.a, r.b): r.value for r in moments.rank_correlations(df, names, ["bar_time", "instrument_id"]).collect()}, {(a, b): ranks.loc[a, b] for a, b in pairs})
    got = {(r.a, r.b): r.value for r in moments.merged_correlations(df, names, ["bar_time", "instrument_id"], F.col("bar_time") % 3).where("method = 'spearman'").collect()}
    want = {}
    for a, b in pairs:
        each = [(len(g), g[a].rank().corr(g[b].rank())) for _, g in pdf.dropna(subset=[a, b]).groupby(pdf.bar_time % 3)]
        each = [(n, c) for n, c in each if not pd.isna(c)]
        if each:
            want[a, b] = sum(n * c for n, c in each) / sum(n for n, _ in each)
    _same(got, want)


def test_copies_of_entries_are_scored_once(spark):
    """A named copy, copies of a proposal and all their pairs, from one pair of classes and its few names."""
    rows = [(i, "f1", ["i0"], 12, ["word1"], "reject", [100] if i in (7, 100) else None) for i in range(150)]
    rows += [(200 + i, None, ["i9"], None, ["word9"], "watchlist", [50] if i % 2 else None) for i in range(4)]  # only a name, below the least
    rows += [(300, "f1", ["i7"], None, ["word2"], "watchlist", [50, 50])]
    e = spark.createDataFrame(rows, "id long, family string, inputs array<string>, look int, keywords array<string>, status string, similar_to array<long>")
    p = e.where("id IN (0, 50, 100)")
    assert memory._candidates(*(t.where("id < 150").withColumn("cls", F.lit(0)).where("id = 0") for t in (p, e)), 0.5, 0.1).count() == 1
    have = memory.research_matches(p, e).collect()
    want = {(a[0], b[0]): _sim(a, b) for a in rows if a[0] in (0, 50, 100) for b in rows if a[0] != b[0]}
    assert len(have) == len({(r.proposal, r.entry) for r in have})
    assert {(r.proposal, r.entry): round(r.similarity, 9) for r in have} == {k: round(v, 9) for k, v in want.items() if v >= 0.35}
    named = {(r.proposal, r.entry): r.matched for r in have if "similar_to" in r.matched}
    assert named == {(100, 7): "family,required_inputs,lookback_bars,keywords,similar_to", (50, 300): "family,similar_to"}


def _sent_scans(df, name):
    """Scans of a stored table's words below a broadcast, other than of its classes' first members."""
    out, above = [], []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth] + [(depth, "BroadcastExchange" in line)]
        if "FileScan" in line and f"/{name}-" in line and "= cls#" not in line and "keywords#" in line and any(sent for _, sent in above):
            out.append(line)
    return out


def test_many_copies_of_entries_are_not_broadcast(spark):
    """Their files are small, but 40,000 rows with their words aren't."""
    words = F.array(*(F.lit(f"word{i}") for i in range(12)))
    e = spark.range(40_000).select("id", F.lit("f1").alias("family"), F.array(F.lit("i0")).alias("inputs"), (F.col("id") % 2).cast("int").alias("look"), words.alias("keywords"), F.lit("reject").alias("status"), F.when(F.col("id") % 7 == 0, F.array(F.lit(50).cast("long"))).alias("similar_to"))
    out = memory.research_matches(e.where("id IN (0, 50)"), e)
    assert not _sent_scans(out, "entries")
    got = {(r.proposal, r.named): (r.n, r.d) for r in out.groupBy("proposal", F.contains("matched", F.lit("similar_to")).alias("named")).agg(F.count("*").alias("n"), F.count_distinct("entry").alias("d")).collect()}
    assert got == {(0, False): (39_999, 39_999), (50, True): (5715, 5715), (50, False): (34_284, 34_284)}


@pytest.mark.parametrize("least", [0.2, 0.35])
def test_shuffled_research_matches_against_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(memory, "SENT", 0)
    monkeypatch.setattr(memory, "DEALT", 40)
    test_research_matches_against_all_pairs(spark, least)
    test_copies_of_entries_are_scored_once(spark)


def test_ranks_with_frequent_values_move_rows_twice(spark):
    rng = np.random.default_rng(12)
    n = 4000
    pdf = pd.DataFrame({"t": np.arange(n) % 3, "a": np.where(rng.random(n) < 0.6, 1.0, rng.normal(size=n)), "b": rng.integers(0, 5, n).astype(float), "c": np.repeat(2.0, n), "d": rng.normal(size=n)})
    pdf["e"] = pdf.a + pdf.d
    pdf.loc[(pdf.t == 1) & (rng.random(n) < 0.3), ["b", "e"]] = np.nan
    pdf.loc[rng.random(n) < 0.2, "d"] = np.nan
    names = list("abcde")
    df = spark.createDataFrame(pdf.to_dict("records"), "t int, a double, b double, c double, d double, e double").select("t", *(F.nanvl(f, F.lit(None)).alias(f) for f in names), F.monotonically_increasing_id().alias("k"))
    whole, merged = moments.rank_correlations(df, names, ["k"]), moments.merged_correlations(df, names, ["k"], F.col("t"))
    for out, most in ((whole, 3), (merged, 6)):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= most
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    ranks = pdf[names].rank().corr(min_periods=2)
    _same({(r.a, r.b): r.value for r in whole.collect()}, {(a, b): ranks.loc[a, b] for a, b in pairs})
    want = {}
    for a, b in pairs:
        each = [(len(g), g[a].rank().corr(g[b].rank())) for _, g in pdf.dropna(subset=[a, b]).groupby("t")]
        each = [(k, v) for k, v in each if not pd.isna(v)]
        if each:
            want[a, b] = sum(k * v for k, v in each) / sum(k for k, _ in each)
    _same({(r.a, r.b): r.value for r in merged.where("method = 'spearman'").collect()}, want)


def test_many_columns_are_one_scan(spark):
    names = [f"c{i}" for i in range(60)]
    df = spark.range(200).select(F.col("id").alias("bar_time"), *(F.rand(i).alias(f) for i, f in enumerate(names)))
    out = moments.correlations(df, names)
    assert out.count() == 60 * 59 // 2
    assert out._jdf.queryExecution().executedPlan().toString().count("Range (0, 200") == 1


@pytest.mark.parametrize("n,q,least", [(1, 0.5, 1), (3, 0.0, 1), (200, 0.7, 5), (300, 1.0, 2), (257, 0.333, 1)])
def test_expanding_quantile(spark, n, q, least):
    rng = np.random.default_rng(n)
    v = [None if rng.random() < 0.2 else float(rng.integers(0, 40)) if rng.random() < 0.5 else float(rng.normal()) for _ in range(n)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "bar_time long, x double")
    got = {r.bar_time: r.quantile for r in orderstats.expanding_quantile(df, "x", q, least).collect()}
    for t in range(n):
        past = [x for x in v[:t] if x is not None]
        assert got[t] is None if len(past) < least else math.isclose(got[t], np.quantile(past, q), rel_tol=1e-9, abs_tol=1e-12), t
    assert orderstats.expanding_quantile(df.limit(0), "x", q, least).count() == 0


def test_interval_join(spark):
    """Open, empty and very long intervals; one key holds most rows."""
    rng = np.random.default_rng(4)
    day = lambda n: pd.Timestamp("2000-01-01") + pd.Timedelta(days=int(n))
    rows = [("hot" if rng.random() < 0.8 else None if rng.random() < 0.2 else f"k{rng.integers(4)}", None if rng.random() < 0.05 else day(rng.integers(0, 3000)), i) for i in range(1500)]
    spans = []
    for i in range(60):
        a = day(rng.integers(0, 3000))
        spans.append(("hot" if i % 3 == 0 else None if i % 20 == 1 else f"k{i % 5}", i, None if rng.random() < 0.1 else a, None if rng.random() < 0.1 else a + pd.Timedelta(days=int(rng.choice([-3, 0, 1, 2, 30, 400, 2500])))))
    bars = spark.createDataFrame([(k, None if t is None else t.to_pydatetime(), i) for k, t, i in rows], "instrument_id string, bar_time timestamp, i long")
    segs = spark.createDataFrame([(k, i, None if a is None else a.to_pydatetime(), None if b is None else b.to_pydatetime()) for k, i, a, b in spans], "instrument_id string, segment long, start timestamp, end timestamp")
    for closed in ((False, True), (True, True), (True, False)):
        got = intervals.interval_join(bars, segs, ["instrument_id"], "bar_time", closed=closed)
        lower, upper = (lambda t, a: t >= a) if closed[0] else (lambda t, a: t > a), (lambda t, b: t <= b) if closed[1] else (lambda t, b: t < b)
        want = sorted((i, s) for k, t, i in rows for m, s, a, b in spans if k is not None and k == m and t is not None and (a is None or b is None or a <= b) and (a is None or lower(t, a)) and (b is None or upper(t, b)))
        assert sorted((r.i, r.segment) for r in got.collect()) == want
    assert relations.in_segments(bars, segs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        intervals.interval_join(bars, segs.withColumn("i", F.lit(1)), ["instrument_id"], "bar_time")


def test_long_buckets_are_dealt_to_several_tasks(spark):
    bars = spark.range(20_000).selectExpr("'one' AS instrument_id", "timestamp_seconds(id * 60) AS bar_time")
    open_ = spark.createDataFrame([("one", 1, None, None)], "instrument_id string, segment long, start timestamp, end timestamp")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in intervals.interval_join(bars, open_, ["instrument_id"], "bar_time").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 10_000


def test_universe_needs_a_table_for_all(spark):
    with pytest.raises(ValueError):
        intervals.universe_members(["*"], spark=spark)
    with pytest.raises(KeyError):
        intervals.universe_members(["*"], spark.range(1))


def _sim(p, e):
    j = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    s = 0.30 if p[1] is not None and p[1] == e[1] else 0.0
    s += 0.25 * j(set(p[2] or ()), set(e[2] or ()))
    if p[3] is not None and e[3] is not None:
        k = 1 - min(abs(p[3] - e[3]) / max(p[3], e[3], 1.0), 1.0)
        s += 0.15 * k if k >= 0.5 else 0.0
    s += 0.20 * j(set(p[4] or ()), set(e[4] or ()))
    return s + (0.30 if p[0] in (e[6] or ()) else 0.0)


@pytest.mark.parametrize("least", [0.2, 0.35, 0.6])
def test_research_matches_against_all_pairs(spark, least):
    rng = np.random.default_rng(11)
    pick = lambda words, most: None if rng.random() < 0.1 else [str(w) for w in rng.choice(words, rng.integers(0, most + 1), replace=False)]
    ins, kws = [f"i{i}" for i in range(8)], [f"word{i}" for i in range(30)]
    rows = [
        (i, None if rng.random() < 0.1 else f"f{rng.integers(12)}", pick(ins, 4), None if rng.random() < 0.1 else int(rng.choice([0, 1, 2, 5, 12, 24, 48, 96])), pick(kws, 6),
         str(rng.choice(["active", "watchlist", "reject", "deprecated"])), None if rng.random() < 0.7 else [int(rng.integers(0, 20) * 50)])
        for i in range(700)
    ]
    rows += [(1000 + i, "f1", ["i0"], 12, ["word1"], "reject", None) for i in range(150)]  # one common set
    e = spark.createDataFrame(rows, "id long, family string, inputs array<string>, look int, keywords array<string>, status string, similar_to array<long>")
    got = memory.research_matches(e.where("id % 50 = 0"), e, least).collect()
    want = {(p[0], x[0]): _sim(p, x) for p in rows if p[0] % 50 == 0 for x in rows if p[0] != x[0] and x[5] != "active"}
    sure, maybe = {k for k, v in want.items() if v >= least + 1e-9}, {k for k, v in want.items() if v >= least - 1e-9}
    have = {(r.proposal, r.entry): r.similarity for r in got}
    assert len(have) == len(got) and sure <= have.keys() <= maybe and len(sure) > 20
    assert all(abs(v - want[k]) < 1e-9 for k, v in have.items())
    with pytest.raises(ValueError):
        memory.research_matches(e, e, 0.1)


def test_unique_rows_fails_when_run(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert relations.unique_rows(df, ["k", "v"]).count() == 3
    with pytest.raises(PySparkException):
        relations.unique_rows(df, ["k"]).collect()


def test_six_digits_round_as_the_sql_engine(spark):
    """Halves of the seventh digit, beside them, negative ones, large and missing values."""
    import duckdb

    from tapeloom.functions.columns import six_digits

    rng = np.random.default_rng(5)
    v = [s / 80 for s in (70.505, 20.075, 39.355, 55.425, 20.115, 47.925)] + [k / 80 for k in np.round(rng.uniform(-90, 90, 400), 3)] + [0.4999999e-6, 5e-7, -5e-7, 0.0, 1e17, -1e300, float("inf"), float("nan"), None]
    rows = [(i, None if x is None else float(x)) for i, x in enumerate(v)]
    got = {r.i: r.y for r in spark.createDataFrame(rows, "i int, x double").select("i", six_digits(F.col("x")).alias("y")).collect()}
    want = dict(duckdb.execute("SELECT unnest(?), unnest(?::DOUBLE[])", [[i for i, _ in rows], [x for _, x in rows]]).fetchall())
    want = {i: None if x is None else duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0::DOUBLE", [x]).fetchone()[0] for i, x in want.items()}
    assert all(repr(got[i]) == repr(want[i]) for i in want), [(v[i], got[i], want[i]) for i in want if repr(got[i]) != repr(want[i])][:5]
    assert sum(math.isfinite(x or 0) and round(x or 0, 6) != got[i] for i, x in rows) > 3


def _peaks(df) -> list[int]:
    """Windows of each stage of a plan, which add up in a task."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    stages = [0]
    for line in text.splitlines():
        if "Exchange " in line:
            stages.append(0)
        elif "Window [" in line:
            stages[-1] += 1
    return stages


def test_ranks_of_features_have_stages_of_their_own(spark):
    from tapeloom.operators import portfolio

    rows = spark.range(600).selectExpr("date_add(date'2020-01-01', int(id % 3)) AS bar_time", "string(id) AS instrument_id", *(f"rand({i}) AS x{i}" for i in range(6)))
    for method in ("rank", "zscore"):
        out = portfolio.composite(rows, {f"x{i}": 1.0 for i in range(6)}, method=method)
        assert max(_peaks(out)) == 1 and out.count() == 600
    folder = "/root/testdata/sf0.001"
    for name in ("overlay_blend", "score_blend", "composite_zscore"):
        from tapeloom import queries

        assert max(_peaks(queries.queries()[name](spark, folder))) <= 2


def test_cross_sections_are_dealt_to_many_tasks(spark):
    """However few partitions a session has and however well rows pack, a task orders only a few timestamps."""
    from tapeloom.functions.columns import across
    from tapeloom.operators import research

    rows = spark.range(40_000).selectExpr("int(id % 200) AS t", "double(id % 7) AS x")
    for turn in (0, 1):
        held = across(rows, "x", "t", rank="r", turn=turn).groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("t").alias("n")).collect()
        assert sum(r.n for r in held) == 200 and max(r.n for r in held) <= 10
    held = research.scored(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("bar_time").alias("n")).collect()
    assert max(r.n for r in held) <= 12


@pytest.mark.parametrize("nulls_first", [False, True])
def test_percentile_ranks_across(spark, nulls_first):
    from tapeloom.functions.columns import across, percent_rank

    rng = np.random.default_rng(9)
    rows = [(None if t == 3 else t, None if rng.random() < 0.2 else float(rng.integers(0, 9)) if t else 1.0) for t in range(5) for _ in range(60 if t < 4 else 1)]
    df = spark.createDataFrame([(t, i, x) for i, (t, x) in enumerate(rows)], "t int, i int, x double")
    out = across(df, "x", "t", rank="r", z="z", nulls_first=nulls_first).withColumn("want", percent_rank("x", "t")).collect()
    assert len(out) == len(rows)
    for t in {r.t for r in out}:
        own = [r for r in out if r.t == t]
        x = [r.x for r in own if r.x is not None]
        nulls = len(own) - len(x)
        for r in own:
            if r.x is None:
                assert r.z is None and (math.isclose(r.r, (nulls + 1) / 2 / len(x)) if nulls_first and x else r.r is None)
                continue
            assert math.isclose(r.r, r.want + (nulls / len(x) if nulls_first else 0))
            assert (r.z is None) == (np.std(x) == 0) and (r.z is None or math.isclose(r.z, (r.x - np.mean(x)) / np.std(x), abs_tol=1e-9))


@pytest.mark.parametrize("seed", [1, 2])
def test_policies_need_only_names_that_can_enter(spark, seed):
    """Runs over all names give what runs over the names that are ever within reach give, universe gaps included."""
    from tapeloom.operators import costaware, folds

    rng = np.random.default_rng(seed)
    times = [pd.Timestamp("2020-01-06") + pd.Timedelta(days=7 * i) for i in range(25)]
    base = {f"n{k}": rng.normal() for k in range(60)}
    rows = []
    for t in times:
        own = sorted(((round(base[n] + rng.normal() * 0.4, 2), n) for n in base if rng.random() < 0.8), key=lambda v: (-v[0], v[1]))
        rows += [(t.date(), n, k + 1, float(s)) for k, (s, n) in enumerate(own)]
    df = spark.createDataFrame(rows, "bar_time date, instrument_id string, score_rank int, score double")

    def whole(module, runs, first):
        held, out = {}, []
        for t in times:
            f = {n: (k, s) if first else {"score": s} for d, n, k, s in rows if d == t.date()}
            said = module.decide(f, held, runs)
            out += [(t.date(), n, v[0], round(v[1], 9)) for n, v in said.items()]
            held = {n: folds.Held(v[1], held[n].bars + 1 if n in held else 0) for n, v in said.items() if v[1] > 1e-12}
        return sorted(out)

    got = folds.policy_targets(df, folds.POLICIES).collect()
    for run, p in folds.POLICIES.items():
        assert sorted((r.bar_time, r.instrument_id, r.action, r.target_weight) for r in got if r.run_id == run) == whole(folds, p, True)
    got = costaware.targets(df.drop("score_rank"), costaware.RUNS).collect()
    for run, p in costaware.RUNS.items():
        assert sorted((r.bar_time, r.instrument_id, r.action, r.target_weight) for r in got if r.run_id == run) == whole(costaware, p, False)


def test_folds_compute_their_rows_once(spark):
    from tapeloom.operators import learning, splits

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    schema = "bar_time date, instrument_id string, exit_time date, x double, label double"
    rows = spark.range(1200).selectExpr("date_add(date'2020-01-01', int(id / 4)) AS bar_time", "string(id % 4) AS instrument_id", "date_add(date'2020-01-03', int(id / 4)) AS exit_time", "double(id % 17) AS x", "double(id % 17) / 10 AS label")
    folds = [splits.Fold(str(m), f"2020-0{m}-01", f"2020-0{m}-28") for m in (4, 6, 8)]
    out, found = learning.by_fold(rows.mapInPandas(count, schema), folds, ["x"], "label", rounds=2, depth=2)
    assert out.count() == 4 * 28 * 3 and len(found) == 3 and seen.value == 1200


def test_memory_of_copies_loses_no_link(spark, tmp_path):
    """Copies are given with the first part of their class only; the links that follow from it are those of all pairs."""
    import duckdb

    from tapeloom import queries

    rng = np.random.default_rng(3)
    kinds = [(f"b{rng.integers(3)}", int(rng.integers(4)), float(rng.integers(0, 3000)) / 100) for _ in range(40)] + [(None, 1, 12.0), ("b1", None, 30.0), ("b1", 2, None), (None, None, None), (None, 2, None)]
    parts = [(i + 1, *kinds[k]) for i, k in enumerate(rng.integers(0, len(kinds), 400))]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.a, r.b): r.similarity for r in queries.queries()["research_memory"](spark, str(tmp_path)).collect()}
    first = {}
    for i, *k in parts:
        first.setdefault(tuple(k), i)
    of = {i: first[tuple(k)] for i, *k in parts}
    assert all(a == of[a] and of[b] in (a, b) for a, b in got) and len(got) < 2000
    assert all((of[i], i) in got for i, f, k, x in parts if of[i] != i and (f is not None) * 0.3 + (k is not None) * 0.15 + (x is not None) * 0.25 >= 0.35)
    for n, (i, f, k, x) in enumerate(parts):
        for j, g, m, y in parts[n + 1 :]:
            s = 0.3 * (f is not None and f == g) + 0.15 * (k is not None and k == m) + 0.25 * (x is not None and y is not None and abs(x - y) < 5)
            key = (of[i], j) if of[i] == of[j] and of[i] != j else tuple(sorted((of[i], of[j])))
            link = got.get((of[j], j) if of[i] == of[j] else key)
            assert (link is None) == (s < 0.35) and (link is None or math.isclose(link, s, abs_tol=1e-6)), (i, j)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert {(a, b): s for a, b, s in con.execute(queries.oracle_sql()["research_memory"]).fetchall()} == got


def _odd_lines(spark, path):
    """Lines with null suppliers and dates, ties, no quantity, and weeks that are missing."""
    rng = np.random.default_rng(21)
    day = pd.Timestamp("1995-01-02")
    rows = []
    for i in range(1200):
        when = None if rng.random() < 0.03 else (day + pd.Timedelta(days=int(rng.integers(0, 120)))).to_pydatetime()
        rows.append((int(i // 3), int(i % 3), int(rng.integers(0, 9)), None if rng.random() < 0.05 else int(rng.integers(0, 12)), None if rng.random() < 0.02 else float(rng.integers(-2, 40)) * 8, float(rng.choice([0, 1, 2, 4])), when))
    rows += rows[:50]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate timestamp_ntz"
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{path}/lineitem.parquet")
    return str(path)


@pytest.mark.parametrize("lines", [1_000_000, 50])
def test_weekly_rows_equal_the_plan(spark, tmp_path, monkeypatch, lines):
    from tapeloom.sources import bars as B

    monkeypatch.setattr(B, "LINES", lines)
    folder = _odd_lines(spark, tmp_path)
    want, got = B.executable(B.weekly()).over(spark, folder), B.weekly_rows(spark, folder)
    assert got.schema.simpleString() == want.schema.simpleString() and got.count() == want.count() > 150
    assert got.where("limit_up_open").count() > 5 and got.where("bar_time IS NULL").count() > 5 and got.where("instrument_id IS NULL").count() > 5
    assert got.exceptAll(want).count() == 0
    some = spark.createDataFrame([("1",), ("7",), ("99",)], "instrument_id string")
    few = B.weekly_rows(spark, folder, some)
    assert few.count() == want.where("instrument_id IN ('1', '7')").count() > 10 and few.exceptAll(want).count() == 0
    weeks = want.select("bar_time").distinct()
    assert B.weeks(spark, folder).count() == weeks.count() and B.weeks(spark, folder).exceptAll(weeks).count() == 0


def test_composites_of_one_stage_equal_each_alone(spark):
    from tapeloom.operators import portfolio, registered

    rows = registered.panel(spark, "/root/testdata/sf0.001").select("bar_time", "instrument_id", "f1", "f2", "f3")
    both = portfolio.composites(rows, registered.WEIGHTS, {"a": "rank", "b": "zscore"}, apart=False)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert both.columns == [*rows.columns, "a", "b"] and plan.count("Exchange hashpartitioning") == 2  # lines, then bars
    for name, method in (("a", "rank"), ("b", "zscore")):
        one = portfolio.composite(rows, registered.WEIGHTS, method=method).withColumn("score", F.round("score", 10))
        assert both.select(*rows.columns, F.round(name, 10)).exceptAll(one).count() == 0


def _line_scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("sf0.001/lineitem.parquet")


@pytest.mark.parametrize("name", ["exec_diagnostics", "exec_event_reasons"])
def test_executions_are_made_once(spark, name):
    from tapeloom.operators import registered

    assert _line_scans(registered.queries()[name](spark, "/root/testdata/sf0.001")) == 0  # they are read from where they were stored


@pytest.mark.parametrize("name", ["adaptive_switch", "months_compared"])
def test_composites_of_a_switch_are_made_once(spark, name):
    from tapeloom.operators import registered

    assert _line_scans(registered.queries()[name](spark, "/root/testdata/sf0.001")) == 0


@pytest.mark.parametrize("name,scans", [("t1_constraints", 1), ("rebalance_orders", 0)])
def test_orders_take_bars_of_their_names_only(spark, name, scans):
    from tapeloom.operators import registered

    out = registered.queries()[name](spark, "/root/testdata/sf0.001")
    assert _line_scans(out) == scans == out._jdf.queryExecution().executedPlan().toString().count("LeftSemi")
