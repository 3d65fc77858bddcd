"""Joins of timed rows with intervals, and universes whose members come and go.

An interval lies in the buckets of its own scale: the smallest power of two (times a base width) that is not shorter than it, so
it touches two buckets at most, whatever its length.  A timed row is looked up once for each scale that intervals have, and
within a bucket of a key the bounds are compared.  Rows of a key are spread over time; a bucket that is still long is dealt to
several tasks by time, to which its intervals are copied.  So a key that holds all rows, or one interval over all time, is no
hot key.

A null start or end is open.  A null key matches nothing, nor does a null time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The scale of an interval with an open end, and tasks that a bucket's rows are dealt to.
OPEN, SALTS = 63, 16


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def interval_join(rows: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str = "start", end: str = "end", closed: tuple[bool, bool] = (False, True), base_seconds: int = 86_400, salts: int = SALTS) -> DataFrame:
    """Rows with the columns of each interval of their key that holds their time; ``closed`` says which ends belong to it.

    The intervals' own columns (all but ``by``) must not be columns of the rows.  An interval whose start is after its end holds
    nothing.
    """
    clash = sorted((set(rows.columns) & set(intervals.columns)) - set(by))
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    a, b = _seconds(F.col(start)), _seconds(F.col(end))
    length = F.greatest(b - a, F.lit(1)) / float(base_seconds)
    scale = F.when(a.isNull() | b.isNull(), OPEN).otherwise(F.greatest(F.ceil(F.log2(length)), F.lit(0))).cast("int")
    held = intervals.where(F.col(start).isNull() | F.col(end).isNull() | (F.col(start) <= F.col(end))).withColumn("__scale", scale)
    width = F.lit(base_seconds) * F.pow(F.lit(2.0), F.col("__scale"))
    slot = lambda s: F.when(F.col("__scale") == OPEN, F.lit(0)).otherwise(F.floor(s / width)).cast("long")
    held = held.withColumn("__slot", F.explode(F.sequence(slot(a), slot(b))))
    scales = sorted(r[0] for r in held.select("__scale").distinct().collect())  # 64 at most
    if not scales:
        return rows.join(intervals, by).limit(0)
    looked = rows.where(F.col(time).isNotNull()).withColumn("__scale", F.explode(F.array(*map(F.lit, scales)))).withColumn("__slot", slot(_seconds(F.col(time))))
    keys = [*by, "__scale", "__slot"]
    looked = looked.withColumn("__salt", F.pmod(F.xxhash64(time), F.lit(salts)).cast("int"))
    slots = looked.select(*keys, "__salt").distinct().join(held, keys)
    met = looked.join(slots, [*keys, "__salt"])
    t, s, e = F.col(time), F.col(start), F.col(end)
    after = s.isNull() | ((t >= s) if closed[0] else (t > s))
    before = e.isNull() | ((t <= e) if closed[1] else (t < e))
    return met.where(after & before).drop("__scale", "__slot", "__salt")


# --------------------------------------------------------------------------------------- universes
MEMBER = ("symbol", "instrument_id", "market", "asset_type", "effective_from", "effective_to")


def universe_members(
    symbols: list[str], instruments: DataFrame | None = None, spark=None, market: str | None = None, asset_type: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Members (symbol, instrument_id, market, asset_type, effective_from, effective_to) of a universe.

    Without a table of instruments the symbols are the members (static).  With one, they are looked up by canonical_code and
    hold from ``start`` to ``end`` (resolved); the one symbol ``*`` takes all instruments of the market and type that are
    effective at ``start`` (or at ``end``), with their own intervals where the table has them (wildcard).
    """
    day = lambda d: F.lit(d).cast("date")
    if instruments is None:
        if symbols == ["*"]:
            raise ValueError("all instruments can't be listed without a table of them")
        rows = spark.createDataFrame([(s,) for s in symbols], "symbol string")
        return rows.select("symbol", F.col("symbol").alias("instrument_id"), F.lit(market).cast("string").alias("market"), F.lit(asset_type).cast("string").alias("asset_type"), day(start).alias("effective_from"), day(end).alias("effective_to"))
    missing = [c for c in ("instrument_id", "canonical_code", "market", "asset_type") if c not in instruments.columns]
    if missing:
        raise KeyError(f"missing fields: {missing}")
    rows = instruments.withColumnRenamed("canonical_code", "symbol")
    for name, value in (("market", market), ("asset_type", asset_type)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if symbols != ["*"]:
        return rows.where(F.col("symbol").isin(symbols)).withColumns({"effective_from": day(start), "effective_to": day(end)}).select(*MEMBER)
    for name, value in (("effective_from", start), ("effective_to", end)):
        if name not in rows.columns:
            rows = rows.withColumn(name, day(value))
    at = start or end
    return (rows if at is None else active_on(rows, at)).select(*MEMBER)


def active_on(members: DataFrame, date: str) -> DataFrame:
    """Members whose interval holds the date; a missing bound is open."""
    d = F.lit(date).cast("date")
    return members.where((F.col("effective_from").isNull() | (F.col("effective_from") <= d)) & (F.col("effective_to").isNull() | (F.col("effective_to") >= d)))


def in_universe(bars: DataFrame, members: DataFrame, time: str = "bar_time") -> DataFrame:
    """Bars of members while they are effective, both ends included."""
    rows = members.select("instrument_id", "symbol", "effective_from", "effective_to")
    day = bars.withColumn("__day", F.to_date(time))
    return interval_join(day, rows, ["instrument_id"], "__day", "effective_from", "effective_to", (True, True)).drop("__day")
