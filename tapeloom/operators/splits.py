"""Time splits of labelled rows that keep outcomes of training rows out of later parts."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIME = "bar_time"


@dataclass(frozen=True)
class Fold:
    """Bounds of one walk-forward window, all inclusive; a bound is a point in time, so a date means its first moment.

    Without ``train_end`` training rows are those before the validation or, without one, before the test.
    """

    name: str
    test_start: str
    test_end: str | None = None
    train_end: str | None = None
    valid_start: str | None = None
    valid_end: str | None = None
    train_start: str | None = None

    def __post_init__(self) -> None:
        if not self.name or not self.test_start:
            raise ValueError("a fold needs a name and the start of its test")


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _parts(fold: Fold, embargo: str | int, label_end: str) -> Column:
    """Array of the parts of a fold that a row belongs to."""
    t, end = F.col(TIME).cast("timestamp"), F.col(label_end).cast("timestamp")
    first = _at(min(fold.valid_start or fold.test_start, fold.test_start))
    gap = F.expr(f"INTERVAL {embargo} DAYS" if isinstance(embargo, int) else f"INTERVAL '{embargo}'" if " " not in embargo else f"INTERVAL {embargo}")
    train = (t < first if fold.train_end is None else t <= _at(fold.train_end)) & (end < first - gap)
    if fold.train_start is not None:
        train = train & (t >= _at(fold.train_start))

    def within(a: str | None, b: str | None) -> Column:
        if a is None:
            return F.lit(False)
        return t >= _at(a) if b is None else t.between(_at(a), _at(b))

    rules = {"train": train, "valid": within(fold.valid_start, fold.valid_end), "test": within(fold.test_start, fold.test_end)}
    if fold.train_start is not None:  # what lies before takes no part at all
        rules = {n: r & (t >= _at(fold.train_start)) for n, r in rules.items()}
    return F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules.items())))


def purged_split(df: DataFrame, train_end: str | None, valid: tuple[str, str | None] | None, test: tuple[str, str | None], embargo: str | int = 0, label_end: str = "exit_time") -> DataFrame:
    """Adds part: train, valid or test; a row in both later parts is given out for each, others are dropped.

    A training row ends by train_end, and its label ends before the first of the later parts less the embargo (days, or
    an interval such as "90 minutes").
    """
    fold = Fold("one", test[0], test[1], train_end, *(valid or (None, None)))
    return df.withColumn("part", F.explode(_parts(fold, embargo, label_end)))


def walk_forward(df: DataFrame, folds: Iterable[Fold | tuple], label_end: str = "exit_time", embargo: str | int = 0) -> DataFrame:
    """Rows of every fold with fold and part, each split as by purged_split; a tuple is (name, test start, test end).

    The folds are a small array of rules, so a row is read once and given out for each fold and part that it belongs to.
    """
    folds = [f if isinstance(f, Fold) else Fold(*f) for f in folds]
    if not folds:
        raise ValueError("no fold")
    each = F.array(*(F.struct(F.lit(f.name).alias("fold"), _parts(f, embargo, label_end).alias("parts")) for f in folds))
    rows = df.withColumn("__f", F.explode(F.filter(each, lambda f: F.size(f["parts"]) > 0)))
    return rows.withColumns({"fold": F.col("__f.fold"), "part": F.explode("__f.parts")}).drop("__f")


def time_split(df: DataFrame, train_end: str, test_start: str, label_end: str | None = None) -> DataFrame:
    """Train up to one date and test from another; rows whose label reaches into the test are purged if its end is known."""
    t = F.to_date(TIME)
    train = t <= F.lit(train_end).cast("date")
    if label_end and label_end in df.columns:
        train = train & (F.to_date(label_end) < F.lit(test_start).cast("date"))
    return df.withColumn("part", F.when(train, "train").when(t >= F.lit(test_start).cast("date"), "test")).where("part IS NOT NULL")


def before(df: DataFrame, start: str, label_end: str = "exit_time") -> DataFrame:
    """Rows that may train a model for what starts then."""
    s = F.lit(start).cast("date")
    return df.where((F.to_date(TIME) < s) & (F.to_date(label_end) < s))
