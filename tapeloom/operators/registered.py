"""Queries of the callable operators on the test panels, and the SQL they are compared with.

The panel (weekly supplier bars with three features and labels) comes from the bar plans.  The operators are DataFrame
functions; the SQL here is written on its own and shares no text with them.
"""

from __future__ import annotations

import uuid
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import boolean_text, clipped, ratio, six_digits
from ..sources import bars as B
from ..sources.scratch import scratch_root, stored
from ..streaming.bars import tick_bars
from . import evaluation as E
from . import execution, learning, moments, portfolio, recurrence, relations, research, schedules, splits

X = ["f1", "f2", "f3"]
#: Columns with more and fewer nulls, for correlations.
WIDE = [*X, "label", "label_4", "close_price", "volume", "turnover"]
COST = 0.0013
KEYS = ("bar_time", "instrument_id")


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without negative zero."""
    return df.select(*(six_digits(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema))


def panel(spark: SparkSession, folder: str) -> DataFrame:
    return research.weekly_over(research.panel(), spark, folder)


def bars(spark: SparkSession, folder: str, names: DataFrame | None = None) -> DataFrame:
    return research.weekly_over(research.weekly(), spark, folder, names)


WEIGHTS = {"f1": 0.5, "f2": 0.3, "f3": 0.2}


def scored(spark: SparkSession, folder: str, method: str = "rank") -> DataFrame:
    out = portfolio.composite(panel(spark, folder), WEIGHTS, method=method)
    return out.withColumn("score", F.round("score", 10)).where("score IS NOT NULL")


def leaders(spark: SparkSession, folder: str, methods: tuple[str, ...] = ("rank",), top: int = 5) -> DataFrame:
    """Stored rows (keys, label, sd, any_f1, a score named by each method) of the first names of each timestamp by any of the methods.

    Lines and then bars move once, for all methods and uses; sd is the dispersion of f1 at the timestamp,
    null below two values, and any_f1 whether it has one.
    """
    rows = panel(spark, folder).select(*KEYS, *X, "label")
    rows = portfolio.composites(rows, WEIGHTS, {m: m for m in methods}, apart=False).withColumns({m: F.round(m, 10) for m in methods})
    own = Window.partitionBy("bar_time")
    rows = rows.withColumns({"sd": F.round(F.stddev_samp("f1").over(own), 10), "any_f1": F.count("f1").over(own) > 0})
    places = {f"__{m}": F.row_number().over(Window.partitionBy("bar_time").orderBy(F.desc_nulls_last(m), "instrument_id")) for m in methods}
    first = [F.col(m).isNotNull() & (F.col(f"__{m}") <= top) for m in methods]
    return stored(rows.withColumns(places).where(reduce(lambda a, b: a | b, first)).select(*KEYS, "label", "sd", "any_f1", *methods), "leaders")


def market(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each timestamp with a regime scale: 0.5 after weeks of wide dispersion."""
    rows = panel(spark, folder).where("f1 IS NOT NULL").groupBy("bar_time").agg(F.round(F.stddev_samp("f1"), 10).alias("sd"))
    return rows.withColumn("before", F.lag("sd").over(Window.orderBy("bar_time"))).select("bar_time", F.when(F.col("before") > 0.3, 0.5).otherwise(1.0).alias("scale"), F.when(F.col("before") > 0.3, "stress").otherwise("normal").alias("regime"))


def book(spark: SparkSession, folder: str) -> DataFrame:
    return portfolio.target_weights(scored(spark, folder), 5)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every timestamp with a score has a book, so the book's timestamps are all there are."""
    return portfolio.rebalance(portfolio.target_weights(leaders(spark, folder), 5, "rank"))


# --------------------------------------------------------------------------------------- the queries
def label_forward(spark, folder):
    out = portfolio.forward_labels(bars(spark, folder), {"label": 1})
    return tidy(out.select(*KEYS, "entry_time", F.col("label_exit_time").alias("exit_time"), "label"))


def label_multi(spark, folder):
    return tidy(portfolio.forward_labels(bars(spark, folder), {"label": 1, "label_4": 4}).select(*KEYS, "label", "label_4"))


def label_rank(spark, folder):
    out = portfolio.forward_labels(bars(spark, folder), {"label": 1}).withColumn("label", F.round("label", 10))
    return tidy(portfolio.label_rank(out, "label").select(*KEYS, "label_rank"))


def alpha_matrix(spark, folder):
    rows = E.long(panel(spark, folder), X, "label").withColumnRenamed("x", "value")
    return tidy(portfolio.feature_matrix(rows, X).select(*KEYS, *(F.col(f).alias(f"m_{f}") for f in X)))


def purged_split(spark, folder):
    out = splits.purged_split(panel(spark, folder).where("label IS NOT NULL"), "1996-12-31", ("1997-01-01", "1998-06-30"), ("1998-07-01", "2100-01-01"), 7)
    return tidy(out.select(*KEYS, "exit_time", "part", "label"))


#: A year of test after half a year of validation; training rows from February 1995 on.
FOLDS = [splits.Fold(str(y), f"{y}-01-01", f"{y}-12-31", f"{y - 1}-06-30", f"{y - 1}-07-01", f"{y - 1}-12-31", "1995-02-01") for y in range(1996, 2002)]


def walk_forward(spark, folder):
    return splits.walk_forward(panel(spark, folder).where("label IS NOT NULL"), FOLDS, embargo=10).select(*KEYS, "fold", "part")


def hourly_split(spark, folder):
    """Bounds within days, an embargo in minutes, and hours that are both validation and test."""
    rows = B.executable(B.hourly()).over(spark, folder).select(*KEYS, (F.col("bar_time") + F.expr("INTERVAL 90 MINUTES")).alias("exit_time"))
    day = rows.agg(F.min(F.to_date("bar_time"))).first()[0]
    at = lambda n, hour: f"{day + timedelta(days=n)} {hour}"
    return splits.purged_split(rows, at(9, "15:00:00"), (at(9, "18:30:00"), at(14, "12:00:00")), (at(14, "06:00:00"), at(20, "03:00:00")), "150 minutes").select(*KEYS, "part")


def time_split(spark, folder):
    return splits.time_split(panel(spark, folder).where("label IS NOT NULL"), "1996-12-31", "1997-01-01", "exit_time").select(*KEYS, "part")


def ml_purge(spark, folder):
    return splits.before(panel(spark, folder).where("label IS NOT NULL"), "1997-01-01").select(*KEYS, "exit_time")


def ic_by_ts(spark, folder):
    return tidy(E.by_timestamp(panel(spark, folder), X, "label").select("feature", "bar_time", "n", "ic", "rank_ic"))


def topn_spread(spark, folder):
    return tidy(E.by_timestamp(panel(spark, folder), X, "label").select("feature", "bar_time", "top_label", "bottom_label", "spread"))


def topn_turnover(spark, folder):
    return tidy(E.turnover(panel(spark, folder), X, "label", 5, COST).select("feature", "bar_time", "turnover", "cost_adjusted"))


def rank_autocorr(spark, folder):
    return tidy(E.rank_autocorrelation(panel(spark, folder), X, "label"))


def quantile_summary(spark, folder):
    return tidy(E.quantile_summary(panel(spark, folder), X, "label"))


def factor_summary(spark, folder):
    out = E.factor_summary(panel(spark, folder), X, "label").drop("n_rows")
    return tidy(out).withColumn("liquidity_mean", F.round("liquidity_mean", 2) + 0.0)


def decay(spark, folder):
    return tidy(E.decay(panel(spark, folder), X, ["label", "label_4"]).select("feature", "horizon", "ic_mean", "ic_std"))


def group_ic(spark, folder):
    rows = panel(spark, folder).withColumn("grp", F.col("instrument_id").cast("long") % 3)
    return tidy(E.group_ic(rows, X, "label", "grp"))


def feature_corr(spark, folder):
    return tidy(moments.rank_correlations(panel(spark, folder), WIDE, list(KEYS)))


def mergeable_corr(spark, folder):
    return tidy(moments.merged_correlations(panel(spark, folder), WIDE, list(KEYS), F.year("bar_time")))


def factor_corr_by_ts(spark, folder):
    return tidy(E.correlation_by_time(panel(spark, folder), X, {"f2": -1}))


def moments_corr(spark, folder):
    return tidy(E.moments_correlation(panel(spark, folder).withColumn("y", F.year("bar_time")), "f1", "f3", "y"))


def prediction_eval(spark, folder):
    return tidy(E.prediction_evaluation(scored(spark, folder), "score", "label").drop("ic"))


def yearly_health(spark, folder):
    return tidy(E.yearly_health(E.by_timestamp(panel(spark, folder), X, "label")))


def admission_checks(spark, folder):
    rows = research.panel().over(spark, folder)  # the plan's text, as this query's nesting is near what the driver's stack takes
    return tidy(E.admission(rows, X, "label", limits={"timestamps": 300}, roles={"f2": "risk_penalty", "f3": "state_allocator"}))


def signal_identity(spark, folder):
    return tidy(portfolio.signals(panel(spark, folder), "f1").select(*KEYS, "signal"))


def signal_rank(spark, folder):
    return tidy(portfolio.signals(panel(spark, folder), "f1", "rank").select(*KEYS, "signal"))


def signal_threshold(spark, folder):
    return tidy(portfolio.signals(panel(spark, folder), "f1", "threshold", 0.05).select(*KEYS, "signal"))


def weights_equal(spark, folder):
    return tidy(book(spark, folder).select(*KEYS, F.col("target_weight").alias("weight")))


def weights_signal(spark, folder):
    rows = portfolio.signals(panel(spark, folder), "f1", "rank").withColumn("signal", F.round("signal", 10))
    return tidy(portfolio.target_weights(rows, 5, "signal", "signal", 0.21).select(*KEYS, F.col("target_weight").alias("weight")))


def strategy_topn(spark, folder):
    return tidy(book(spark, folder).select(*KEYS, F.col("place").alias("book_rank"), "score", "target_weight"))


def rebalance_orders(spark, folder):
    return tidy(orders(spark, folder).select(*KEYS, "current_weight", "target_weight", "delta"))


def t1_constraints(spark, folder):
    traded = orders(spark, folder)
    sellable = bars(spark, folder, traded.select("instrument_id").distinct()).where("sellable_bar").select(*KEYS, F.lit(0.15).alias("sellable_weight"))
    return tidy(portfolio.settle(traded, sellable).select(*KEYS, "action", "allowed", "blocked"))


def book_diagnostics(spark, folder):
    return tidy(portfolio.book_diagnostics(book(spark, folder), "score"))


def composite_rank(spark, folder):
    return tidy(portfolio.ranked(scored(spark, folder)).select(*KEYS, F.col("place").alias("score_rank"), "score"))


def composite_scaled(spark, folder):
    scales = market(spark, folder).select("bar_time", F.lit("f2").alias("feature"), "scale")
    return tidy(portfolio.composite(panel(spark, folder), {"f1": 0.5, "f2": 0.3, "f3": 0.2}, {"f3": -1}, scales=scales).where("score IS NOT NULL").select(*KEYS, "score"))


def every_nth(spark, folder):
    rows = portfolio.ranked(portfolio.every_nth(scored(spark, folder), 4)).where("place <= 5")
    return tidy(rows.select(*KEYS, "score"))


def contributions(spark, folder):
    rows = portfolio.composite(panel(spark, folder), {"f1": 1.0})
    for f in X:
        rows = portfolio.composite(rows, {f: 1.0}).withColumn(f"c_{f}", F.round("score", 10))
    return rows.where("c_f1 IS NOT NULL OR c_f2 IS NOT NULL OR c_f3 IS NOT NULL").select(*KEYS, (0.5 * F.col("c_f1")).alias("c1"), (0.3 * F.col("c_f2")).alias("c2"), (0.2 * F.col("c_f3")).alias("c3"))


def contribution_cap(spark, folder):
    return tidy(portfolio.capped_contributions(contributions(spark, folder), ["c1", "c2", "c3"], 0.4, 3).select(*KEYS, *(F.col(f"c{i}").alias(f"capped_{i}") for i in (1, 2, 3))))


def contribution_share(spark, folder):
    return tidy(portfolio.concentration(contributions(spark, folder), ["c1", "c2", "c3"]))


def execution_quality(spark, folder):
    """Weighted mean of 1 - clipped execution cost by supplier, each history cut into blocks of about 64 weeks."""
    b = bars(spark, folder)
    cost = ratio(F.abs(F.col("close_price") - ratio(F.col("turnover"), F.col("volume"))), F.abs(F.col("high_price") - F.col("low_price")))
    rows = b.select(*KEYS, (1 - clipped(cost, 0.0, 1.0)).alias("q"))
    out = recurrence.ewm_mean(rows, ["instrument_id"], "bar_time", "q", 3, name="quality", block_rows=64)
    return tidy(out.where("quality IS NOT NULL").select(*KEYS, "quality"))


def _health(spark, folder, window: int):
    return schedules.health(E.by_timestamp(panel(spark, folder), X, "label"), window)


def factor_health(spark, folder):
    return tidy(_health(spark, folder, 12).select("feature", "bar_time", "scale", "ic_r", "state"))


def state_health(spark, folder):
    return tidy(schedules.by_state(_health(spark, folder, 12), _health(spark, folder, 6), market(spark, folder)).select("bar_time", "feature", "scale", "normal_scale", "stress_scale", "reason"))


def state_health_blend(spark, folder):
    return tidy(schedules.by_state(_health(spark, folder, 12), _health(spark, folder, 6), market(spark, folder), "blend").select("bar_time", "feature", "scale"))


def schedule_combine(spark, folder):
    one = _health(spark, folder, 12)
    two = market(spark, folder).where("scale < 1").select("bar_time", F.lit("f1").alias("feature"), "scale")
    out = None
    for how in ("min", "product", "override"):
        part = schedules.combined(one, two, how).withColumnRenamed("scale", how)
        out = part if out is None else out.join(part, ["bar_time", "feature"])
    return tidy(out)


def exposure_combine(spark, folder):
    base = panel(spark, folder).select("bar_time").distinct().withColumn("scale", F.lit(0.8))
    return tidy(schedules.exposure(base, market(spark, folder)))


def weight_schedule(spark, folder):
    """Weights by absolute IC with a cap of a half; a feature without one has weight 0."""
    each = E.by_timestamp(panel(spark, folder), X, "label").select("bar_time", "feature", F.round(F.abs("ic"), 9).alias("weight"))
    grid = each.select("bar_time").distinct().withColumn("feature", F.explode(F.array(*map(F.lit, X))))
    return tidy(schedules.validated_weights(grid.join(each, ["bar_time", "feature"], "left").fillna(0.0, ["weight"]), X, 0.5))


def regime_weights(spark, folder):
    pairs = E.correlation_by_time(panel(spark, folder), X)
    return tidy(schedules.regime_weights(pairs, market(spark, folder), {"f1": 0.5, "f2": 0.3, "f3": 0.2}))


def score_switch_ts(spark, folder):
    at = market(spark, folder).where("regime = 'stress'")
    return tidy(schedules.switched(scored(spark, folder), scored(spark, folder, "zscore"), at))


def adaptive_switch(spark, folder):
    first = leaders(spark, folder, ("rank", "zscore"))
    top = lambda m: portfolio.ranked(first, m).where("place <= 5").groupBy("bar_time").agg(F.avg("label").alias(m))
    # a timestamp with a value of f1 has a rank score, and so a first name
    rows = first.groupBy("bar_time").agg(F.first("sd").alias("sd"), F.max("any_f1").alias("any_f1")).where("any_f1").drop("any_f1")
    rows = rows.withColumn("before", F.lag("sd").over(Window.orderBy("bar_time"))).where("before IS NOT NULL")
    rows = rows.withColumn("state_rank", F.percent_rank().over(Window.orderBy("before")))
    days = rows.join(top("rank"), "bar_time").join(top("zscore"), "bar_time").select("bar_time", "state_rank", (F.col("zscore") - F.col("rank")).alias("edge"))
    return tidy(schedules.adaptive_quantile(days, [0.0, 0.25, 0.5, 0.75], least=6))


def event_states(spark, folder):
    rows = B.executable(B.daily(), 100).over(spark, folder).groupBy("bar_time").agg(
        F.avg(F.col("limit_up_open").cast("double")).alias("u"), F.avg(F.col("limit_down_open").cast("double")).alias("d"),
        *(F.stddev_samp(c).alias(c) for c in ("close_price", "volume", "turnover", "high_price")),
    )
    rows = rows.select("bar_time", F.round(F.col("u") + F.col("d"), 9).alias("pressure"), F.round(F.col("d") - F.col("u"), 9).alias("imbalance"), *(F.round(c, 6).alias(c) for c in ("close_price", "volume", "turnover", "high_price")))
    out = schedules.event_states(rows, ("pressure", "imbalance"), ["close_price", "volume", "turnover", "high_price"])
    return out.select("bar_time", F.round("intensity", 5).alias("intensity"), "state")


def main_board_filter(spark, folder):
    s = spark.read.parquet(f"{folder}/supplier.parquet")
    code = F.concat(F.element_at(F.array(*map(F.lit, ("600", "000", "300", "601", "688"))), (F.col("s_suppkey") % 5 + 1).cast("int")), F.lpad((F.col("s_suppkey") % 1000).cast("string"), 3, "0"), F.when(F.col("s_suppkey") % 2 == 0, ".sh").otherwise(".SZ "))
    place = F.when(F.col("s_nationkey") % 3 == 1, "cn").when(F.col("s_nationkey") % 3 == 2, "HK")
    kept, _ = relations.universe(s.withColumns({"symbol": code, "market": place}), relations.main_board(F.col("symbol"), F.col("market")), "main_board")
    return kept.select("s_suppkey", "symbol")


def universe_counts(spark, folder):
    p = panel(spark, folder)
    _, one = relations.universe(p, None, "all")
    _, two = relations.universe(p, F.col("f1") > 0, "rising")
    return relations.united(one, two)


def dataset_scan(spark, folder):
    """Writes the panel by period to the shared folder and reads three months of it back, pruned to their folders."""
    path = f"{scratch_root(spark)}/dataset-{uuid.uuid4().hex}"
    relations.write_dataset(panel(spark, folder).select(*KEYS, "f1", "label"), path)
    return tidy(relations.scan(spark, path, equal={"period": relations.periods("1995-02-10", "1995-04-02")}, fields=[*KEYS, "f1", "label", "period"]))


def asof_fundamentals(spark, folder):
    o = relations.Portal(spark, folder).table("orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_totalprice").alias("v"))
    out = relations.as_of(o, ["o_custkey"], "o_orderdate", "1997-01-01", "v")
    return out.select(F.col("o_custkey").alias("instrument_id"), F.col("o_orderdate").alias("visible_at"), F.col("v").cast("double").alias("value"))


def bars_of_names(spark, folder):
    out = relations.Portal(spark, folder).bars("orders", [1, 2, 3, 7], "o_custkey", time_col="o_orderdate", fields=["o_orderkey", "o_custkey", "o_orderdate"])
    return out.select("o_orderkey", "o_custkey", "o_orderdate")


def trade_calendar(spark, folder):
    return relations.Portal(spark, folder).calendar("orders", "o_orderdate")


def reversal_factor(spark, folder):
    return tidy(relations.run_factor(relations.Reversal(2, 4, 50_000.0), bars(spark, folder)))


def core_window(spark, folder):
    return tidy(relations.core_window(panel(spark, folder), "1995-01-01", "1995-12-31").select(*KEYS, "label"))


def enriched(spark, folder):
    base = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey")
    more = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return relations.enriched(base, more, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_nationkey")


def repeated_keys(spark, folder):
    return relations.repeated(spark.read.parquet(f"{folder}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


def segment_bars(spark, folder):
    spans = bars(spark, folder).groupBy("instrument_id").agg(F.min("bar_time").alias("a"))
    segments = spans.select("instrument_id", F.explode(F.array(*(F.struct(F.lit(k).alias("segment"), F.date_add("a", 70 * k).alias("start"), F.date_add("a", 70 * k + 35).alias("end")) for k in range(3)))).alias("s")).select("instrument_id", "s.*")
    return relations.in_segments(bars(spark, folder), segments).select(*KEYS, "segment")


def holdings_at_times(spark, folder):
    times = panel(spark, folder).select("bar_time").distinct()
    held = spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_nationkey").alias("instrument_id")).where("instrument_id < 5")
    return relations.held_at_all_times(times, held).select("bar_time", "instrument_id")


def months_compared(spark, folder):
    first = leaders(spark, folder, ("rank", "zscore"))
    month = lambda m: portfolio.ranked(first, m).where("place <= 5").groupBy(F.date_format("bar_time", "yyyy-MM").alias("month")).agg(F.avg("label").alias("ret"))
    return tidy(relations.compared(month("rank"), month("zscore"), ["month"], ["ret"]))


def monthly_diagnosis(spark, folder):
    return tidy(portfolio.monthly_diagnosis(scored(spark, folder), {"mean_score": F.avg("score"), "share_rising": F.avg((F.col("label") > 0).cast("double")), "names": F.count_distinct("instrument_id")}))


def residual_tables(spark, folder):
    rows = portfolio.ranked(scored(spark, folder)).where("place <= 20").withColumn("y", F.year("bar_time"))
    return tidy(portfolio.residual_tables(rows, "label", "volume", ["f1", "f3"], "y"))


def executions(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Executions, trades, equity and capacity events of two runs: the rank and the z-score composite, traded a bar later.

    An order of weight on 10 million fills what a twentieth of the bar's volume allows.
    """
    ahead = B.weeks(spark, folder).withColumn("exec_time", F.lead("bar_time").over(Window.orderBy("bar_time")))
    first, runs = leaders(spark, folder, ("rank", "zscore")), None
    for run in ("rank", "zscore"):
        out = portfolio.rebalance(portfolio.target_weights(first, 5, run)).withColumn("run", F.lit(run))
        runs = out if runs is None else runs.unionByName(out)
    b = bars(spark, folder, runs.select("instrument_id").distinct())
    at = b.select(F.col("bar_time").alias("exec_time"), "instrument_id", "open_price", "volume", "tradable_bar", "limit_up_open", "limit_down_open")
    done = runs.join(ahead, "bar_time").where("exec_time IS NOT NULL").join(at, ["exec_time", "instrument_id"], "left")
    done = stored(done, "executions")
    able = F.coalesce("tradable_bar", F.lit(False)) & ~((F.col("delta") > 0) & F.coalesce("limit_up_open", F.lit(False))) & ~((F.col("delta") < 0) & F.coalesce("limit_down_open", F.lit(False)))
    want, room = F.floor(F.round(F.abs("delta") * 1e7 / F.col("open_price"), 6)), F.floor(F.round(F.col("volume") / 20, 6))
    sized = done.where(able).withColumns({"desired_shares": want, "executable_shares": F.least(want, room), "side": F.when(F.col("delta") > 0, "buy").otherwise("sell")}).where("delta <> 0")
    paid = F.col("executable_shares") * F.col("open_price")
    trades = sized.where("executable_shares > 0").select("run", "side", paid.alias("notional"), (paid * 0.0003).alias("commission"), F.when(F.col("side") == "sell", paid * 0.0005).otherwise(0.0).alias("stamp_tax"), (paid * 0.0005).alias("slippage_cost"))
    short = F.when(F.col("executable_shares") == 0, "capacity_zero").when(F.col("executable_shares") < F.col("desired_shares"), "capacity_capped").otherwise("filled")
    events = sized.select("run", short.alias("reason"), "desired_shares", "executable_shares", F.col("open_price").alias("reference_price"))
    equity = done.select("run", "exec_time").distinct().withColumn("equity", 1e7 + 1000.0 * F.datediff("exec_time", F.lit("1995-01-01").cast("date")))
    return done, trades, equity, events


def exec_diagnostics(spark, folder):
    done, trades, equity, events = executions(spark, folder)
    out = execution.execution_diagnostics(done, trades, equity, events, by=("run",))
    return out.select(*((F.round(f.name, 3) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in out.schema))


def exec_event_reasons(spark, folder):
    return execution.event_counts(executions(spark, folder)[3], "run")


def worst_weeks(spark, folder):
    each = E.by_timestamp(panel(spark, folder), X, "label").where("spread IS NOT NULL")
    return tidy(each.orderBy(F.round("spread", 9), "feature", "bar_time").limit(10).select("feature", "bar_time", "spread"))


def ml_weights(spark, folder):
    return tidy(learning.sample_weights(panel(spark, folder).where("label IS NOT NULL").withColumn("label", F.round("label", 10)), "label").select(*KEYS, "sample_weight"))


def _learning_rows(spark, folder) -> DataFrame:
    return panel(spark, folder).select(*KEYS, *X, "label", "exit_time")


def ml_predictions(spark, folder):
    """A prediction for each row of every fold's test, whether its features are there or not."""
    out, _ = learning.by_fold(_learning_rows(spark, folder), FOLDS, X, "label", embargo=10, rounds=5, depth=3)
    return out.select(*KEYS, "fold", "prediction")


def ml_importance(spark, folder):
    _, found = learning.by_fold(_learning_rows(spark, folder), FOLDS, X, "label", embargo=10, rounds=5, depth=3)
    return learning.aggregated_importance(learning.importance_rows(spark, found, X))


def ml_redundancy(spark, folder):
    p = panel(spark, folder)
    got = learning.redundancy(p.withColumn("f1_twice", 2 * F.col("f1")), [*X, "f1_twice"])
    return spark.createDataFrame([(got["effective_rank"], ",".join(got["drop"]), [float(v) for v in got["singular_values"]])], "effective_rank double, drop string, singular_values array<double>")


def switch_rules(spark, folder):
    months = scored(spark, folder).where("label IS NOT NULL").groupBy(F.date_format("bar_time", "yyyy-MM").alias("month")).agg(F.round(F.stddev_samp("f1"), 9).alias("state"), F.round(F.avg("label"), 9).alias("ret"))
    return tidy(learning.switch_rules(months, "state", "ret", [0.25, 0.5]))


def ticks_to_bars(spark, folder):
    out = tick_bars(spark.read.parquet(f"{folder}/events.parquet"))
    return tidy(out.withColumn("bar_time", F.col("bar_time").cast("timestamp_ntz")))


def text_functions(spark, folder):
    o = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "lang")
    words = F.split(F.regexp_replace(F.lower(F.coalesce("source", F.lit(""))), "[^a-z0-9]+", " "), " ")
    return o.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.filter(words, lambda w: w != ""))), ",").alias("tokens"),
        boolean_text(F.concat(F.lit(" "), F.coalesce("lang", F.lit("No")), F.lit(" "))).alias("flag"), F.expr("try_cast(source AS int)").alias("number"),
        F.get_json_object(F.to_json(F.struct(F.col("lang").alias("l"))), "$.l").alias("back"), F.size(words).cast("long").alias("n_words"),
    )


def queries() -> dict:
    named = (
        label_forward, label_multi, label_rank, alpha_matrix, purged_split, walk_forward, hourly_split, time_split, ml_purge, ic_by_ts, topn_spread, topn_turnover, rank_autocorr, quantile_summary,
        factor_summary, decay, group_ic, feature_corr, mergeable_corr, factor_corr_by_ts, moments_corr, prediction_eval, yearly_health, admission_checks, signal_identity, signal_rank,
        signal_threshold, weights_equal, weights_signal, strategy_topn, rebalance_orders, t1_constraints, book_diagnostics, composite_rank, composite_scaled, every_nth, contribution_cap,
        contribution_share, execution_quality, factor_health, state_health, state_health_blend, schedule_combine, exposure_combine, weight_schedule, regime_weights, score_switch_ts, adaptive_switch,
        event_states, main_board_filter, universe_counts, dataset_scan, asof_fundamentals, bars_of_names, trade_calendar, reversal_factor, core_window, enriched,
        repeated_keys, segment_bars, holdings_at_times, months_compared, monthly_diagnosis, residual_tables, exec_diagnostics, exec_event_reasons, worst_weeks, ml_weights, ml_predictions,
        ml_importance, ml_redundancy, switch_rules, ticks_to_bars, text_functions,
    )
    return {f.__name__: f for f in named}
