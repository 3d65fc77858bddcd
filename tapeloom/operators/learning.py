"""Training on feature rows with pyspark.ml: sample weights, boosted trees by fold, importance and redundancy."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import percent_rank
from ..sources.scratch import stored
from .relations import leaking
from .splits import Fold, walk_forward

#: Where a missing feature lies: above all values.
MISSING = 1e300


def sample_weights(df: DataFrame, label: str, tail: float = 0.1, multiplier: float = 3.0) -> DataFrame:
    """Rows whose label is in the top or bottom tail of its timestamp weigh more."""
    rows = df.withColumn("__p", percent_rank(label, "bar_time"))
    inside = (F.col("__p") <= tail) | (F.col("__p") > 1 - tail)
    return rows.withColumn("sample_weight", F.when(inside, F.lit(multiplier)).otherwise(1.0)).drop("__p")


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Adds the vector ``features``; a null or NaN lies above all values, so trees can give it a branch of its own."""
    filled = {f"__x_{f}": F.when(F.col(f).isNull() | F.isnan(F.col(f).cast("double")), F.lit(MISSING)).otherwise(F.col(f).cast("double")) for f in features}
    return VectorAssembler(inputCols=list(filled), outputCol="features").transform(df.withColumns(filled)).drop(*filled)


def train(df: DataFrame, features: list[str], label: str, weight: str | None = None, validation: str | None = None, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 7) -> GBTRegressionModel:
    """Gradient-boosted trees; with a ``validation`` flag column, boosting stops when the error on those rows stops falling.

    Rows without a label take no part; rows with missing features do.
    """
    bad = leaking(features)
    if bad:
        raise ValueError(f"these carry the outcome: {bad}")
    rows = _assembled(df.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))), features)
    options = {k: v for k, v in (("weightCol", weight), ("validationIndicatorCol", validation)) if v}
    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, **options).fit(rows)


def predicted(model: GBTRegressionModel, df: DataFrame, features: list[str]) -> DataFrame:
    """A prediction for every row."""
    return model.transform(_assembled(df, features)).drop("features")


def by_fold(df: DataFrame, folds: Iterable[Fold | tuple], features: list[str], label: str, label_end: str = "exit_time", embargo: str | int = 0, **options) -> tuple[DataFrame, dict[str, list[float]]]:
    """Predictions of every fold's test rows by a model of its purged training rows, and importances by fold.

    A fold with validation rows stops boosting when their error stops falling.  Every test row gets a prediction; a fold
    without test rows is passed over, one without training rows is an error.

    Each fold reads the rows many times, so they are written once, as Parquet in the shared folder, and read from there.
    """
    out, importance = None, {}
    df = stored(df, "folds")
    for fold in folds:
        fold = fold if isinstance(fold, Fold) else Fold(*fold)
        rows = walk_forward(df, [fold], label_end, embargo)
        held = {} if fold.valid_start is None else {"validation": "__valid"}
        seen = {r.part for r in rows.where(F.col("part").isin("train", "valid") & F.col(label).isNotNull() | (F.col("part") == "test")).groupBy("part").count().collect()}
        if "test" not in seen:
            continue
        if "train" not in seen:
            raise ValueError(f"no training rows before the test of fold {fold.name!r}")
        held = held if "valid" in seen else {}
        learn = rows.where(F.col("part").isin("train", "valid") if held else F.col("part") == "train").withColumn("__valid", F.col("part") == "valid")
        model = train(learn, features, label, **held, **options)
        importance[fold.name] = model.featureImportances.toArray().tolist()
        part = predicted(model, rows.where("part = 'test'").drop("part"), features)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold")
    return out, importance


def importance_rows(spark: SparkSession, importance: dict[str, list[float]], features: list[str]) -> DataFrame:
    rows = [(fold, f, float(v)) for fold, vs in importance.items() for f, v in zip(features, vs, strict=True)]
    return spark.createDataFrame(rows, "fold string, feature string, gain double")


def aggregated_importance(rows: DataFrame) -> DataFrame:
    """By feature: folds, mean and deviation of gain, folds with any gain."""
    return rows.groupBy("feature").agg(F.count("*").alias("folds"), F.avg("gain").alias("mean_gain"), F.coalesce(F.stddev_samp("gain"), F.lit(0.0)).alias("std_gain"), F.count_if(F.col("gain") > 0).alias("nonzero_folds"))


def redundancy(df: DataFrame, features: list[str], limit: float = 0.95) -> dict:
    """Singular values and effective rank of the correlation matrix, pairs above the limit, and which features to drop.

    Spark computes the p x p matrix; only that reaches the driver.
    """
    filled = Imputer(inputCols=features, outputCols=[f"{f}__i" for f in features], strategy="mean").fit(df).transform(df)
    rows = VectorAssembler(inputCols=[f"{f}__i" for f in features], outputCol="features").transform(filled).select("features")
    matrix = Correlation.corr(rows, "features").first()[0]
    r = np.nan_to_num(matrix.toArray() if isinstance(matrix, DenseMatrix) else np.asarray(matrix), nan=0.0)
    np.fill_diagonal(r, 1.0)
    values = np.linalg.svd(r, compute_uv=False)
    p = values / values.sum()
    rank = math.exp(-sum(x * math.log(x) for x in p if x > 0))
    pairs = [(features[i], features[j], float(r[i, j])) for i in range(len(features)) for j in range(i + 1, len(features)) if abs(r[i, j]) >= limit]
    drop: list[str] = []
    for a, b, _ in pairs:
        if a not in drop and b not in drop:
            drop.append(b)
    return {"singular_values": values.tolist(), "effective_rank": rank, "pairs": pairs, "drop": drop}


def switch_rules(months: DataFrame, state: str, value: str, quantiles: list[float]) -> DataFrame:
    """Total return of months chosen by last month's state at or below, or at or above, each of its quantiles.

    ``months`` has one row a month; the rules are exploded from a small array.
    """
    from pyspark.sql import Window

    rows = months.withColumn("__s", F.lag(state).over(Window.orderBy("month"))).where("__s IS NOT NULL")
    cuts = rows.agg(*(F.percentile("__s", q).alias(f"q{i}") for i, q in enumerate(quantiles))).first()
    rules = F.array(*(F.struct(F.lit(q).alias("q"), F.lit(cuts[i]).alias("cut"), F.lit(side).alias("side")) for i, q in enumerate(quantiles) for side in ("below", "above")))
    each = rows.select("*", F.explode(rules).alias("r")).where(F.when(F.col("r.side") == "below", F.col("__s") <= F.col("r.cut")).otherwise(F.col("__s") >= F.col("r.cut")))
    return each.groupBy(F.col("r.q").alias("q"), F.col("r.side").alias("side")).agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p(value))) - 1).alias("total_return"))
