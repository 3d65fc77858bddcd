"""Evaluation of features against labels: functions of (DataFrame, feature columns, label column).

Frames have the keys bar_time and instrument_id.  Features are unpivoted once, by one pass over the frame, and every
statistic is an aggregate or a window by (feature, bar_time).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, correlation, ratio
from .moments import correlations

TIME, NAME = "bar_time", "instrument_id"


def long(df: DataFrame, features: list[str], label: str | None = None, *keep: str) -> DataFrame:
    """Rows (bar_time, instrument_id, keep, y, feature, x) with both values."""
    ids = [TIME, NAME, *keep]
    src = df.select(*ids, *([F.col(label).alias("y")] if label else []), *(F.col(f).cast("double").alias(f) for f in features))
    out = src.unpivot([*ids, *(["y"] if label else [])], features, "feature", "x").where("x IS NOT NULL")
    return out.where("y IS NOT NULL") if label else out


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"rx": average_rank("x", "feature", TIME), "ry": average_rank("y", "feature", TIME)})


def _placed(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("feature", TIME)
    return rows.withColumns({"top": F.row_number().over(w.orderBy(F.desc("x"), NAME)), "bottom": F.row_number().over(w.orderBy("x", NAME))})


def _each(df: DataFrame, features: list[str], label: str, top: int, *keep: str) -> DataFrame:
    """What by_timestamp gives, with the names on top and the sums of further columns, from one unpivoted pass."""
    rows = _placed(_ranked(long(df, features, label, *keep)))
    mean = lambda side: F.avg(F.when(F.col(side) <= top, F.col("y")))
    out = rows.groupBy("feature", TIME).agg(
        F.count("*").alias("n"), correlation(F.col("x"), F.col("y")).alias("ic"), correlation(F.col("rx"), F.col("ry")).alias("rank_ic"), mean("top").alias("top_label"), mean("bottom").alias("bottom_label"),
        F.collect_list(F.when(F.col("top") <= top, F.col(NAME))).alias("tops"), *(f(c).alias(f"{n}_{c}") for c in keep for n, f in (("sum", F.sum), ("count", F.count))),
    )
    out = out.withColumn("spread", F.col("top_label") - F.col("bottom_label"))
    before = F.lag("tops").over(Window.partitionBy("feature").orderBy(TIME))
    return out.withColumn("turnover", F.when(before.isNotNull(), 1 - F.size(F.array_intersect("tops", before)) / F.size("tops")))


def by_timestamp(df: DataFrame, features: list[str], label: str, top: int = 5) -> DataFrame:
    """For each feature and timestamp: n, ic, rank_ic, top_label, bottom_label, spread."""
    return _each(df, features, label, top).select("feature", TIME, "n", "ic", "rank_ic", "top_label", "bottom_label", "spread")


def previous_times(rows: DataFrame) -> DataFrame:
    """For each feature its timestamps and the one before, among those that have valid rows."""
    return rows.select("feature", TIME).distinct().withColumn("before", F.lag(TIME).over(Window.partitionBy("feature").orderBy(TIME)))


def turnover(df: DataFrame, features: list[str], label: str, top: int = 5, cost: float = 0.0013) -> DataFrame:
    """Share of the top names that weren't in the top before, and the spread after that turnover's cost."""
    out = _each(df, features, label, top)
    return out.select("feature", TIME, "turnover", "spread", (F.col("spread") - F.col("turnover") * cost).alias("cost_adjusted"))


def rank_autocorrelation(df: DataFrame, features: list[str], label: str) -> DataFrame:
    rows = long(df, features, label)
    now = rows.join(previous_times(rows), ["feature", TIME])
    old = rows.select("feature", F.col(TIME).alias("before"), NAME, F.col("x").alias("old"))
    pairs = now.join(old, ["feature", "before", NAME])
    ranks = pairs.withColumns({"ra": average_rank("x", "feature", TIME), "rb": average_rank("old", "feature", TIME)})
    return ranks.groupBy("feature", TIME).agg(correlation(F.col("ra"), F.col("rb")).alias("autocorr"))


def bucketed(rows: DataFrame, buckets: int, *part: str) -> DataFrame:
    w = Window.partitionBy(*part)
    place = F.row_number().over(w.orderBy("x", NAME)) / F.count("*").over(w)
    return rows.withColumn("bucket", F.least(F.ceil(place * buckets), F.lit(buckets)).cast("long"))


def quantile_summary(df: DataFrame, features: list[str], label: str, buckets: int = 5) -> DataFrame:
    """Means over timestamps of each bucket's mean label and size, and a row long_short (last minus first bucket)."""
    each = bucketed(long(df, features, label), buckets, "feature", TIME).groupBy("feature", TIME, "bucket").agg(F.count("*").alias("size"), F.avg("y").alias("m"))
    rows = each.groupBy("feature", F.col("bucket").cast("string").alias("bucket")).agg(F.avg("m").alias("mean_label"), F.avg("size").alias("mean_size"))
    end = lambda b: F.max(F.when(F.col("bucket") == b, F.col("m")))
    ends = each.groupBy("feature", TIME).agg((end(buckets) - end(1)).alias("d")).groupBy("feature").agg(F.avg("d").alias("mean_label"))
    return rows.unionByName(ends.select("feature", F.lit("long_short").alias("bucket"), "mean_label", F.lit(None).cast("double").alias("mean_size")))


def _ic_statistics(ic: Column) -> list[Column]:
    return [F.count(ic).alias("n_ts"), F.avg(ic).alias("ic_mean"), F.stddev_samp(ic).alias("ic_std"), F.avg(F.when(ic.isNotNull(), (F.round(ic, 10) > 0).cast("double"))).alias("hit_rate")]


def _ic_ratios(rows: DataFrame) -> DataFrame:
    out = rows.withColumn("ic_se", ratio(F.col("ic_std"), F.sqrt("n_ts")))
    return out.withColumns({"t_stat": ratio(F.col("ic_mean"), F.col("ic_se")), "ir": ratio(F.col("ic_mean"), F.col("ic_std"))})


def ic_summary(each: DataFrame, *by: str) -> DataFrame:
    """Mean, deviation, standard error, t statistic, information ratio and share of positive values of rank_ic."""
    return _ic_ratios(each.groupBy(*by).agg(*_ic_statistics(F.col("rank_ic"))))


def factor_summary(df: DataFrame, features: list[str], label: str, top: int = 5, cost: float = 0.0013, liquidity: str | None = "turnover") -> DataFrame:
    """One row for each feature: IC statistics, coverage, spread, turnover, mean liquidity; the best IC first."""
    keep = {} if liquidity is None else {"__liquidity": F.col(liquidity)}
    return _summarised(df, _each(df.withColumns(keep), features, label, top, *keep), label, bool(keep)).orderBy(F.desc_nulls_last("ic_mean"), "feature")


def _summarised(df: DataFrame, each: DataFrame, label: str, liquid: bool) -> DataFrame:
    more = {"spread_mean": F.avg("spread"), "n_rows": F.sum("n"), "turnover_mean": F.avg("turnover")}
    if liquid:
        more["liquidity_mean"] = ratio(F.sum("sum___liquidity"), F.sum("count___liquidity"))
    ic = F.col("rank_ic")
    out = each.groupBy("feature").agg(*_ic_statistics(ic), *(v.alias(k) for k, v in more.items()))
    out = _ic_ratios(out)
    whole = df.where(F.col(label).isNotNull()).agg(F.count("*").alias("n_all"))
    return out.withColumn("coverage", ratio(F.col("n_rows").cast("double"), whole.scalar()))


def decay(df: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """IC statistics by feature and label; labels are unpivoted as features are."""
    rows = df.select(TIME, NAME, *features, *labels).unpivot([TIME, NAME, *features], labels, "horizon", "y").where("y IS NOT NULL")
    rows = rows.unpivot([TIME, NAME, "horizon", "y"], features, "feature", "x").where("x IS NOT NULL")
    part = ("feature", "horizon", TIME)
    rows = rows.withColumns({"rx": average_rank("x", *part), "ry": average_rank("y", *part)})
    return ic_summary(rows.groupBy(*part).agg(correlation(F.col("rx"), F.col("ry")).alias("rank_ic")), "feature", "horizon")


def group_ic(df: DataFrame, features: list[str], label: str, group: str) -> DataFrame:
    rows, part = long(df, features, label, group), ("feature", TIME, group)
    rows = rows.withColumns({"rx": average_rank("x", *part), "ry": average_rank("y", *part)})
    return rows.groupBy(*part).agg(correlation(F.col("rx"), F.col("ry")).alias("ic")).groupBy("feature", group).agg(F.avg("ic").alias("ic_mean"))


def correlation_by_time(df: DataFrame, features: list[str], directions: dict[str, int] | None = None) -> DataFrame:
    """Rows (bar_time, a, b, n, method, value): correlations of oriented features within each timestamp."""
    sign = lambda c: F.coalesce(*(F.when(F.col(c) == f, d) for f, d in (directions or {}).items()), F.lit(1))
    return correlations(df, features, [TIME]).withColumn("value", F.col("value") * sign("a") * sign("b"))


def moments_correlation(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """Correlation from means of products, so parts can be merged by weighing their means."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    m = both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(F.col(x) * F.col(y)).alias("mxy"), F.avg(F.col(x) ** 2).alias("mxx"), F.avg(F.col(y) ** 2).alias("myy"))
    sd = F.sqrt(F.greatest(F.col("mxx") - F.col("mx") ** 2, F.lit(0.0))) * F.sqrt(F.greatest(F.col("myy") - F.col("my") ** 2, F.lit(0.0)))
    return m.select(*by, "n", F.when(sd > 1e-14, (F.col("mxy") - F.col("mx") * F.col("my")) / sd).alias("corr"))


def prediction_evaluation(df: DataFrame, prediction: str, label: str, top: int = 5) -> DataFrame:
    """For each timestamp: rank IC of predictions and mean labels of all, top and bottom rows."""
    each = by_timestamp(df.withColumn("prediction", F.col(prediction)), ["prediction"], label, top)
    means = df.where(F.col(prediction).isNotNull() & F.col(label).isNotNull()).groupBy(TIME).agg(F.avg(label).alias("all_label"))
    return each.select(TIME, "n", "ic", "rank_ic", "top_label", "bottom_label", "spread").join(means, TIME)


def yearly_health(each: DataFrame) -> DataFrame:
    """For each feature and year: means of rank IC and of the label on the side that the feature's own sign favours."""
    whole = each.groupBy("feature").agg(F.when(F.avg("rank_ic") < 0, -1).otherwise(1).alias("direction"))
    rows = each.join(whole, "feature").withColumn("y", F.year(TIME))
    good = F.when(F.col("direction") > 0, F.col("top_label")).otherwise(F.col("bottom_label"))
    return rows.groupBy("feature", "direction", "y").agg(F.avg("rank_ic").alias("ic"), F.avg(good).alias("favoured_label"), (F.avg("rank_ic") * F.first("direction") > 0).alias("stable"))


#: Admission thresholds.  fixed values
ADMISSION = {"coverage": 0.95, "timestamps": 1000, "ic": 0.001, "t": 2.0, "hit": 0.52, "stable_years": 2, "years": 3, "spread": 0.0, "turnover": 0.95, "cost": 0.0013}
#: What a failed check of each group means by the feature's role.  fixed values
SEVERITY = {
    "alpha_rank": {"coverage": "hard", "rank_ic": "hard", "stability": "soft", "implementation": "soft"},
    "risk_penalty": {"coverage": "hard", "rank_ic": "hard", "stability": "soft", "implementation": "info"},
    "entry_filter": {"coverage": "hard", "rank_ic": "hard", "stability": "soft", "implementation": "info"},
    "event_overlay": {"coverage": "info", "rank_ic": "hard", "stability": "soft", "implementation": "info"},
    "state_allocator": {"coverage": "hard", "rank_ic": "info", "stability": "info", "implementation": "info"},
}
#: The group of each check; too few timestamps are a hard failure in every role.
GROUP = {"coverage": "coverage", "ic": "rank_ic", "t": "rank_ic", "hit": "rank_ic", "years": "stability", "stable_years": "stability", "spread": "implementation", "turnover": "implementation"}


def admission(df: DataFrame, features: list[str], label: str, top: int = 5, directions: dict[str, int] | None = None, limits: dict | None = None, roles: dict[str, str] | None = None) -> DataFrame:
    """Nine checks for each feature, its direction and status: a failed hard check rejects, a soft one puts it on the watchlist.

    How much a check weighs depends on the feature's role (alpha_rank without one); checks that only inform are listed apart.

    The direction is the sign of the mean rank IC unless ``directions`` gives it; hit rate, spread and stable years count in
    that direction.
    """
    lim = ADMISSION | (limits or {})
    each = _each(df, features, label, top)
    base = _summarised(df, each, label, False)
    given = F.coalesce(*(F.when(F.col("feature") == f, d) for f, d in (directions or {}).items()), F.lit(None).cast("int"))
    base = base.withColumn("direction", F.coalesce(given, F.when(F.col("ic_mean") < 0, -1).otherwise(1)))
    years = each.where("rank_ic IS NOT NULL").groupBy("feature", F.year(TIME).alias("y")).agg(F.avg("rank_ic").alias("ic"))
    years = years.join(base.select("feature", "direction"), "feature").groupBy("feature").agg(F.count("*").alias("n_years"), F.count_if(F.signum("ic") == F.col("direction")).alias("n_stable"))
    rows = base.join(years, "feature", "left")
    hit = F.when(F.col("direction") > 0, F.col("hit_rate")).otherwise(1 - F.col("hit_rate"))
    cost_adjusted = F.col("direction") * F.col("spread_mean") - F.col("turnover_mean") * lim["cost"]
    checks = {
        "coverage": F.col("coverage") >= lim["coverage"], "timestamps": F.col("n_ts") >= lim["timestamps"], "ic": F.abs("ic_mean") >= lim["ic"],
        "t": F.abs("t_stat") >= lim["t"], "hit": hit >= lim["hit"], "years": F.col("n_years") >= lim["years"], "stable_years": F.col("n_stable") >= lim["stable_years"],
        "spread": cost_adjusted > lim["spread"], "turnover": F.col("turnover_mean") <= lim["turnover"],
    }
    if unknown := sorted(set((roles or {}).values()) - set(SEVERITY)):
        raise ValueError(f"unknown roles: {unknown}")
    ok = {k: F.coalesce(c, F.lit(False)) for k, c in checks.items()}
    role = F.coalesce(*(F.when(F.col("feature") == f, r) for f, r in (roles or {}).items()), F.lit("alpha_rank"))

    def severity(check: str) -> Column:
        of = {r: v[GROUP[check]] for r, v in SEVERITY.items()} if check in GROUP else dict.fromkeys(SEVERITY, "hard")
        return F.coalesce(*(F.when(role == r, v) for r, v in of.items()))

    def failed(*levels: str) -> Column:
        names = F.array(*(F.when(~c & severity(n).isin(*levels), F.lit(n)) for n, c in ok.items()))
        return F.array_sort(F.array_compact(names))

    status = F.when(F.size(failed("hard")) > 0, "reject").when(F.size(failed("soft")) > 0, "watchlist").otherwise("candidate")
    lists = (F.array_join(failed("hard", "soft"), ",").alias("failed"), F.array_join(failed("info"), ",").alias("informational"))
    return rows.select("feature", role.alias("role"), "direction", "n_years", "n_stable", cost_adjusted.alias("cost_adjusted"), *(c.alias(f"{n}_ok") for n, c in ok.items()), *lists, status.alias("status"))
