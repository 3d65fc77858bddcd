"""Labels, signals, scores, target weights and orders: functions of (DataFrame, columns, parameters)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import across, clipped, percent_rank, ratio, total_of
from .relations import unique

TIME, NAME = "bar_time", "instrument_id"


def forward_labels(bars: DataFrame, horizons: dict[str, int], price: str = "close_price", lag: int = 1, by: str = NAME, time: str = TIME) -> DataFrame:
    """Adds entry_time, and for each (label name, horizon) the return from the entry, ``lag`` bars ahead, and its exit time.

    One window serves all horizons; rows without every label are dropped.
    """
    if lag < 0 or any(h <= 0 for h in horizons.values()):
        raise ValueError("lag must not be negative and horizons must be positive")
    w = Window.partitionBy(by).orderBy(time)
    entry = F.lead(price, lag).over(w)
    out = bars.withColumn("entry_time", F.lead(time, lag).over(w))
    out = out.withColumns({n: ratio(F.lead(price, lag + h).over(w), entry) - 1 for n, h in horizons.items()} | {f"{n}_exit_time": F.lead(time, lag + h).over(w) for n, h in horizons.items()})
    return out.dropna(subset=list(horizons))


def label_rank(df: DataFrame, label: str, descending: bool = True) -> DataFrame:
    return df.where(F.col(label).isNotNull()).withColumn("label_rank", percent_rank(label, TIME, descending=descending))


def feature_matrix(rows: DataFrame, features: list[str], keys: tuple[str, ...] = (TIME, NAME)) -> DataFrame:
    """Long factor rows (keys, feature, value) to one column each; repeated (keys, feature) raise ValueError."""
    return unique(rows, [*keys, "feature"]).groupBy(*keys).pivot("feature", features).agg(F.first("value"))


def signals(df: DataFrame, value: str, kind: str = "identity", threshold: float = 0.0, long: float = 1.0, short: float = -1.0) -> DataFrame:
    """identity and rank drop rows without a value; threshold counts them as short."""
    v = F.col(value)
    if kind == "threshold":
        return df.withColumn("signal", F.when(v >= threshold, F.lit(long)).otherwise(F.lit(short)))
    if kind not in ("identity", "rank"):
        raise ValueError(f"unknown signal {kind!r}")
    return df.where(v.isNotNull()).withColumn("signal", v if kind == "identity" else percent_rank(value, TIME))


def composite(df: DataFrame, weights: dict[str, float], directions: dict[str, int] | None = None, method: str = "rank", scales: DataFrame | None = None) -> DataFrame:
    """Adds score: weighted mean of oriented centred ranks or z-scores over the features a row has.

    ``scales`` (bar_time, feature, scale), one small row for each feature and time, multiplies weights; missing ones are 1.
    """
    return composites(df, weights, {"score": method}, directions, scales)


def composites(df: DataFrame, weights: dict[str, float], methods: dict[str, str], directions: dict[str, int] | None = None, scales: DataFrame | None = None, apart: bool = True) -> DataFrame:
    """Adds a composite for each (name, method), all from one sort for each feature.

    With ``apart`` false all features are ordered in one stage: rows move once, but a task's memory adds up over features.
    """
    sign, names = directions or {}, list(weights)
    if scales is not None:
        wide = unique(scales, [TIME, "feature"]).groupBy(TIME).pivot("feature", names).agg(F.first("scale"))
        df = df.join(wide.select(TIME, *(F.col(f).alias(f"__s_{f}") for f in names)), TIME, "left")
    kinds = {"r" if m == "rank" else "z" for m in methods.values()}
    values, used = {}, {}
    for i, f in enumerate(names):
        df = across(df, f, TIME, rank=f"__r_{f}" if "r" in kinds else None, z=f"__z_{f}" if "z" in kinds else None, turn=i if apart else 0)
        values |= {f"__v{k}_{f}": (F.col(f"__{k}_{f}") - 0.5 if k == "r" else F.col(f"__{k}_{f}")) * sign.get(f, 1) for k in kinds}
        used[f] = F.lit(weights[f]) * (F.coalesce(F.col(f"__s_{f}"), F.lit(1.0)) if scales is not None else F.lit(1.0))
    df = df.withColumns(values)
    for name, method in methods.items():
        v = {f: F.col(f"__v{'r' if method == 'rank' else 'z'}_{f}") for f in names}
        top = total_of([F.coalesce(used[f] * v[f], F.lit(0.0)) for f in names])
        bottom = total_of([F.when(v[f].isNotNull(), used[f]).otherwise(0.0) for f in names])
        df = df.withColumn(name, ratio(top, bottom))
    return df.drop(*values, *(f"__{k}_{f}" for f in names for k in "rzs"))


def ranked(df: DataFrame, score: str = "score") -> DataFrame:
    """Rows with a score and their place: the highest first, ties by name."""
    w = Window.partitionBy(TIME).orderBy(F.desc(score), NAME)
    return df.where(F.col(score).isNotNull()).withColumn("place", F.row_number().over(w))


def target_weights(df: DataFrame, top: int, score: str = "score", method: str = "equal", most: float | None = None) -> DataFrame:
    """Weights of the top names: equal, or by signal (which mustn't be negative); capped at ``most`` without redistribution."""
    rows = ranked(df, score).where(F.col("place") <= top)
    own = Window.partitionBy(TIME)
    if method == "equal":
        weight = 1.0 / F.count("*").over(own)
    elif method == "signal":
        bad = F.raise_error(F.lit("signal weights need scores that aren't negative"))
        s = F.when(F.col(score) < 0, bad.cast("double")).otherwise(F.col(score))
        weight = F.coalesce(ratio(s, F.sum(F.abs(score)).over(own)), F.lit(0.0))
    else:
        raise ValueError(f"unknown weighting {method!r}")
    return rows.withColumn("target_weight", weight if most is None else clipped(weight, -most, most))


def rebalance(book: DataFrame, weight: str = "target_weight", times: DataFrame | None = None) -> DataFrame:
    """Orders against the book of the previous timestamp; names that leave are sold.

    The last timestamp has a following one only if ``times`` (all timestamps) holds it.
    """
    all_times = (book if times is None else times).select(TIME).distinct()
    after = all_times.withColumn("next", F.lead(TIME).over(Window.orderBy(TIME)))  # one row for each timestamp
    held = book.join(after, TIME).where("next IS NOT NULL").select(F.col("next").alias(TIME), NAME, F.col(weight).alias("current_weight"))
    out = book.select(TIME, NAME, F.col(weight).alias("target_weight")).join(held, [TIME, NAME], "full").fillna(0.0, ["current_weight", "target_weight"])
    return out.withColumn("delta", F.col("target_weight") - F.col("current_weight"))


def settle(orders: DataFrame, sellable: DataFrame | None = None) -> DataFrame:
    """Caps sells at the sellable weight (bar_time, instrument_id, sellable_weight; missing: nothing can be sold).

    Adds allowed, blocked and action: buy, sell, blocked (a sell that isn't possible at all) or hold.
    """
    rows = orders if sellable is None else orders.join(sellable.select(TIME, NAME, "sellable_weight"), [TIME, NAME], "left")
    rows = rows.withColumn("sellable_weight", F.coalesce(F.col("sellable_weight") if "sellable_weight" in rows.columns else F.lit(None).cast("double"), F.lit(0.0)))
    allowed = F.when(F.col("delta") < 0, F.greatest("delta", -F.col("sellable_weight"))).otherwise(F.col("delta"))
    rows = rows.withColumn("allowed", allowed)
    action = F.when(F.col("allowed") > 0, "buy").when(F.col("allowed") < 0, "sell").when(F.col("delta") < 0, "blocked").otherwise("hold")
    return rows.withColumns({"blocked": F.col("allowed") - F.col("delta"), "action": action})


def book_diagnostics(df: DataFrame, value: str = "target_weight", *by: str) -> DataFrame:
    """Size, sum and range by timestamp."""
    return df.groupBy(TIME, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))


def every_nth(df: DataFrame, n: int, first: int = 0) -> DataFrame:
    """Rows of every n-th timestamp; only the distinct timestamps are numbered, and joined back."""
    times = df.select(TIME).distinct().withColumn("__i", F.row_number().over(Window.orderBy(TIME)) - 1)
    return df.join(times.where((F.col("__i") - first) % n == 0).select(TIME), TIME, "left_semi")


def capped_contributions(df: DataFrame, columns: list[str], most: float, passes: int = 3) -> DataFrame:
    """Limits each contribution to share ``most`` of a row's absolute sum; totals are taken anew before each pass."""
    if not 0 < most < 1:
        raise ValueError("the share must be between 0 and 1")
    if len([*columns]) < 2:
        return df
    for _ in range(passes):
        df = df.withColumn("__total", total_of([F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in columns]))
        room = lambda c: most / (1 - most) * (F.col("__total") - F.abs(c))
        df = df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), -room(c)), room(c))) for c in columns})
    return df.drop("__total")


def concentration(df: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Largest and two largest shares of the absolute contributions, by timestamp."""
    sums = df.groupBy(TIME, *by).agg(*(F.sum(F.abs(c)).alias(c) for c in columns))
    ordered = F.sort_array(F.array(*(F.coalesce(F.col(c), F.lit(0.0)) for c in columns)), asc=False)
    whole = total_of([F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    top = lambda k: ratio(F.aggregate(F.slice(ordered, 1, k), F.lit(0.0), lambda a, b: a + b), whole)
    return sums.select(TIME, *by, whole.alias("total"), top(1).alias("largest_share"), top(2).alias("top_two_share"))


def monthly_diagnosis(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.groupBy(F.date_format(TIME, "yyyy-MM").alias("month")).agg(*(c.alias(n) for n, c in columns.items()))


def residual_tables(df: DataFrame, label: str, weight: str, drivers: list[str], *by: str) -> DataFrame:
    """Weighted mean, share below 0, and each driver's correlation with the label and mean difference of losers and gainers."""
    rows = df.where(F.col(label).isNotNull())
    from ..functions.columns import correlation

    loss = lambda c, side: F.avg(F.when(F.col(label) < 0 if side else F.col(label) > 0, F.col(c)))
    each = [x for c in drivers for x in (correlation(F.col(c), F.col(label)).alias(f"corr_{c}"), (loss(c, True) - loss(c, False)).alias(f"gap_{c}"))]
    mean = ratio(F.sum(F.col(label) * F.col(weight)), F.sum(weight))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), mean.alias("weighted_mean"), F.avg((F.col(label) < 0).cast("double")).alias("share_below"), *each)
