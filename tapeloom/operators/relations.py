"""Scans, sinks, guards and joins: functions of DataFrames and column names.

Checks that need data (duplicate keys, row counts) run one aggregate and raise ValueError; the rest is lazy.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import interval_join

#: Names that a feature can't have: they carry the outcome.  fixed values
BLOCKED_PREFIXES, BLOCKED_SUFFIXES = ("label", "forward_return", "target", "exit_", "entry_"), ("_label", "_forward_return", "_target")


# ---------------------------------------------------------------------------------- scans and sinks
def scan(spark: SparkSession, paths: list[str] | str, start=None, end=None, time_col: str = "bar_time", equal: dict | None = None, fields: list[str] | None = None) -> DataFrame:
    """Parquet files or folders united by column name, with predicates that reach the scan.

    ``start`` and ``end`` bound ``time_col`` (both inclusive), ``equal`` holds values or lists by column, ``fields`` selects
    columns and raises KeyError for missing ones.  A folder partitioned by period is pruned by an ``equal`` on it.
    """
    df = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    for bound, test in ((start, lambda c, v: c >= v), (end, lambda c, v: c <= v)):
        if bound is not None:
            df = df.where(test(F.col(time_col), F.lit(bound)))
    for name, value in (equal or {}).items():
        df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df if fields is None else select_fields(df, fields)


def select_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise KeyError(f"missing fields: {missing}")
    return df.select(*fields)


def periods(start: str, end: str) -> list[str]:
    """Months (yyyy_mm) that a range of dates touches: the folders a padded load has to read."""
    (y, m), (y1, m1) = ((int(d[:4]), int(d[5:7])) for d in (start, end))
    out = []
    while (y, m) <= (y1, m1):
        out.append(f"{y:04d}_{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def with_period(df: DataFrame, time_col: str = "bar_time") -> DataFrame:
    return df.withColumn("period", F.date_format(time_col, "yyyy_MM"))


def write_dataset(df: DataFrame, path: str, time_col: str = "bar_time", by: tuple[str, ...] = ()) -> None:
    """One folder for each period (below those of ``by``, as for score methods); written periods replace old ones.

    Rows of a period meet, so folders don't fill with small files; a period beyond the advisory partition size is split into
    several tasks and files.
    """
    keys = [*by, "period"]
    out = with_period(df, time_col).hint("rebalance", *map(F.col, keys))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def latest_version(df: DataFrame, keys: list[str], prefer: list[Column]) -> DataFrame:
    """One row for each key: the first by ``prefer``."""
    w = Window.partitionBy(*keys).orderBy(*prefer)
    return df.withColumn("__pick", F.row_number().over(w)).where("__pick = 1").drop("__pick")


def as_of(df: DataFrame, by: list[str], visible: str, when, value: str) -> DataFrame:
    """The value that was visible last at a point in time."""
    return df.where(F.col(visible) <= F.lit(when)).groupBy(*by).agg(F.max(visible).alias(visible), F.max_by(value, visible).alias(value))


@dataclass(frozen=True)
class Portal:
    """Tables of one folder by what they are asked for."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def bars(self, name: str, ids: list | None = None, id_col: str = "instrument_id", start=None, end=None, time_col: str = "bar_time", fields: list[str] | None = None) -> DataFrame:
        return scan(self.spark, f"{self.folder}/{name}.parquet", start, end, time_col, None if ids is None else {id_col: ids}, fields)

    def calendar(self, name: str, time_col: str) -> DataFrame:
        return self.table(name).select(F.to_date(time_col).alias("trade_date")).distinct()

    def fundamentals_as_of(self, name: str, by: list[str], visible: str, when, value: str) -> DataFrame:
        return as_of(self.table(name), by, visible, when, value)


# ----------------------------------------------------------------------------------------- factors
class Factor(ABC):
    """A named value of bars: subclasses return (bar_time, instrument_id, value), lazily."""

    name: str

    @abstractmethod
    def compute(self, bars: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Reversal(Factor):
    """Minus the return of the last ``back`` bars, where mean turnover of ``window`` bars reaches ``least_turnover``."""

    back: int = 1
    window: int = 4
    least_turnover: float | None = None
    name: str = "reversal"

    def compute(self, bars: DataFrame) -> DataFrame:
        from ..functions.columns import ratio, rolling

        w = Window.partitionBy("instrument_id").orderBy("bar_time")
        value = -(ratio(F.col("close_price"), F.lag("close_price", self.back).over(w)) - 1)
        out = bars.select("bar_time", "instrument_id", value.alias("value"), rolling(F.avg, F.col("turnover"), ["instrument_id"], "bar_time", self.window).alias("liquidity"))
        if self.least_turnover is not None:
            out = out.where(F.col("liquidity") >= self.least_turnover)
        return out.drop("liquidity").where("value IS NOT NULL")


def run_factor(factor: Factor, bars: DataFrame) -> DataFrame:
    """A factor's rows with its name, checked for columns and repeated keys."""
    out = select_fields(factor.compute(bars), ["bar_time", "instrument_id", "value"]).withColumn("feature", F.lit(factor.name))
    return unique(out, ["bar_time", "instrument_id"])


# ------------------------------------------------------------------------------------------ guards
def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, or ValueError with the first keys that repeat."""
    bad = repeated(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"repeated keys {keys}: {[tuple(r)[:-1] for r in bad]}")
    return df


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """df; a repeated key is an error when the plan runs, so nothing is computed beforehand or twice."""
    text = F.concat(F.lit(f"repeated keys {keys}: "), F.to_json(F.struct(*keys)))
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(text).cast("boolean")).otherwise(True)).drop("__n")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Renames columns; ValueError where a new name would cover another column."""
    clash = sorted(n for o, n in names.items() if n != o and n in df.columns and n not in names)
    if clash or len(set(names.values())) < len(names):
        raise ValueError(f"names collide: {clash or sorted(names.values())}")
    return df.withColumnsRenamed(names)


def leaking(columns: list[str], prefixes: tuple[str, ...] = BLOCKED_PREFIXES, suffixes: tuple[str, ...] = BLOCKED_SUFFIXES) -> list[str]:
    return [c for c in columns if c.lower().startswith(prefixes) or c.lower().endswith(suffixes)]


def features_of(df: DataFrame, keys: tuple[str, ...] = ("bar_time", "instrument_id")) -> list[str]:
    """Numeric columns that are neither keys nor outcomes."""
    blocked = {*keys, *leaking(df.columns)}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in blocked]


def core_window(df: DataFrame, start, end, time_col: str = "bar_time") -> DataFrame:
    """Drops the padding that look-backs and look-aheads needed."""
    return df.where(F.col(time_col).between(F.lit(start), F.lit(end)))


def sampled(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """n rows by the lowest seeded hashes of their keys: the same ones at every partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def main_board(symbol: Column, market: Column | None = None, asset: Column | None = None) -> Column:
    """Shanghai and Shenzhen main-board shares by canonical code; a NULL market or type passes."""
    parts = F.split(F.upper(F.trim(F.coalesce(symbol, F.lit("")))), r"\.", 2)
    code, suffix = F.substring(F.get(parts, 0), 1, 3), F.get(parts, 1)
    # fixed values: code prefixes of the main boards
    ok = ((suffix == "SH") & code.isin("600", "601", "603", "605")) | ((suffix == "SZ") & code.isin("000", "001", "002", "003"))
    for column, value, fold in ((market, "CN", F.upper), (asset, "equity", F.lower)):
        if column is not None:
            ok = ok & F.coalesce(fold(column) == value, F.lit(True))
    return F.coalesce(ok, F.lit(False))


def universe(df: DataFrame, keep: Column | None, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that a rule keeps (None: all), and one row that says how many it saw and kept."""
    flagged = df.withColumn("__keep", F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)))
    seen = flagged.agg(F.lit(name).alias("rule"), F.count("*").alias("n_in"), F.count_if("__keep").alias("n_out"))
    return flagged.where("__keep").drop("__keep"), seen


# ------------------------------------------------------------------------------------------- joins
def enriched(base: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """Left join of a table that holds each key once; its columns must be new."""
    clash = sorted((set(base.columns) & set(more.columns)) - set(on))
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    return base.join(unique(more, on), on, "left")


def held_at_all_times(times: DataFrame, holdings: DataFrame) -> DataFrame:
    """Every holding (one small book, broadcast below a counted size) at every timestamp."""
    if holdings.count() > 100_000:
        raise ValueError("a book of current holdings has at most 100,000 names")
    return times.withColumn("__k", F.lit(1)).join(F.broadcast(holdings.withColumn("__k", F.lit(1))), "__k").drop("__k")


def in_segments(bars: DataFrame, segments: DataFrame, time_col: str = "bar_time") -> DataFrame:
    """Bars with start < time <= end of their instrument's segments, for histories and segments of any length."""
    return interval_join(bars, segments.select("instrument_id", "segment", "start", "end"), ["instrument_id"], time_col).drop("start", "end")


def united(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def compared(base: DataFrame, other: DataFrame, on: list[str], values: list[str]) -> DataFrame:
    """Two result tables side by side with differences; keys of either side stay."""
    a = base.select(*on, *(F.col(v).alias(f"base_{v}") for v in values))
    b = other.select(*on, *(F.col(v).alias(f"other_{v}") for v in values))
    out = a.join(b, on, "full")
    return out.withColumns({f"diff_{v}": F.col(f"other_{v}") - F.col(f"base_{v}") for v in values})
