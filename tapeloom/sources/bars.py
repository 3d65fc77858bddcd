"""Bar panels from raw tables: tick to bar, previous closes, limit and tradability flags."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sql import Plan

LIMIT_BPS = 980
#: Lines that a task orders where their number asks for more tasks than the session's; names that are broadcast.
LINES, FEW = 1_000_000, 100_000


def hourly() -> Plan:
    """Hourly bars by event type."""
    return Plan((("bars", """SELECT event_type AS instrument_id, CAST(date_trunc('hour', ts) AS @TS) AS bar_time, CAST(min(ts) AS DATE) AS trade_date,
  min_by(value, ts) AS open_price, max(value) AS high_price, min(value) AS low_price, max_by(value, ts) AS close_price,
  CAST(count(*) AS DOUBLE) AS volume, CAST(sum(value) AS DOUBLE) AS turnover, FALSE AS is_st
  FROM {events} GROUP BY event_type, date_trunc('hour', ts)"""),))


_WEEK = "CAST(date_trunc('week', l_shipdate) AS DATE)"
_LINE = "@ROW(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"


def _line_bars(instrument: str, time: str, source: str, st: str, order: str = _LINE) -> Plan:
    return Plan((("bars", f"""SELECT CAST({instrument} AS @STR) AS instrument_id, {time} AS bar_time, {time} AS trade_date,
  CAST(min_by(l_extendedprice / l_quantity, {order}) AS DOUBLE) AS open_price, CAST(max(l_extendedprice / l_quantity) AS DOUBLE) AS high_price,
  CAST(min(l_extendedprice / l_quantity) AS DOUBLE) AS low_price, CAST(max_by(l_extendedprice / l_quantity, {order}) AS DOUBLE) AS close_price,
  CAST(sum(l_quantity) AS DOUBLE) AS volume, CAST(sum(l_extendedprice) AS DOUBLE) AS turnover, {st} AS is_st
  FROM {source} WHERE l_quantity > 0 GROUP BY {instrument}, {time}, {st}"""),))


def weekly() -> Plan:
    """Weekly bars by supplier."""
    return _line_bars("l_suppkey", _WEEK, "{lineitem}", "FALSE")


def daily() -> Plan:
    """Daily bars by brand."""
    return _line_bars("p_brand", "CAST(l_shipdate AS DATE)", "{lineitem} JOIN {part} ON l_partkey = p_partkey", "p_brand LIKE '%5'")


def executable(plan: Plan, limit_bps: int | None = LIMIT_BPS, one_bar: bool = False) -> Plan:
    """Adds previous session close, ST, suspension and limit flags, and which bars can trade, be bought or sold.

    With ``one_bar`` a session of an instrument is one bar, so the close before it is taken from the row before, without a join.
    """
    up, down = ("FALSE", "FALSE") if limit_bps is None else (f"coalesce(previous_close > 0 AND open_price >= previous_close * {1 + limit_bps / 1e4}, FALSE)", f"coalesce(previous_close > 0 AND open_price <= previous_close * {1 - limit_bps / 1e4}, FALSE)")
    if one_bar:
        known = "CASE WHEN instrument_id IS NOT NULL AND trade_date IS NOT NULL THEN"
        closes = plan.then("closes", f"SELECT *, {known} lag(CASE WHEN trade_date IS NOT NULL THEN close_price END) OVER (PARTITION BY instrument_id ORDER BY trade_date) END AS previous_close, {known} open_price END AS session_open FROM bars")
        return _tradable(closes.then("flagged", f"SELECT *, {_SUSPENDED}, {up} AS limit_up_open, {down} AS limit_down_open FROM closes"))
    return _tradable(
        plan.then("sessions", "SELECT instrument_id, trade_date, max_by(close_price, bar_time) AS session_close, min_by(open_price, bar_time) AS session_open FROM bars GROUP BY instrument_id, trade_date")
        .then("closes", "SELECT *, lag(session_close) OVER (PARTITION BY instrument_id ORDER BY trade_date) AS previous_close FROM sessions")
        .then("flagged", f"SELECT b.*, c.previous_close, c.session_open, {_SUSPENDED}, {up} AS limit_up_open, {down} AS limit_down_open FROM bars b LEFT JOIN closes c ON b.instrument_id = c.instrument_id AND b.trade_date = c.trade_date")
    )


_SUSPENDED = "(coalesce(volume, 0) <= 0 OR coalesce(turnover, 0) <= 0) AS suspended_bar"


def _tradable(plan: Plan) -> Plan:
    plan = plan.then("tradable", "SELECT *, (coalesce(open_price, 0) > 0 AND coalesce(close_price, 0) > 0 AND NOT suspended_bar AND NOT is_st) AS tradable_bar FROM flagged")
    return plan.then("exec_bars", "SELECT *, (tradable_bar AND NOT limit_up_open) AS buyable_bar, (tradable_bar AND NOT limit_down_open) AS sellable_bar FROM tradable")


def _week_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_quantity > 0")
    return lines.select(F.col("l_suppkey").cast("string").alias("instrument_id"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def weeks(spark: SparkSession, folder: str) -> DataFrame:
    """The timestamps of the weekly bars, without building these."""
    return _week_lines(spark, folder).select(F.expr(_WEEK).alias("bar_time")).distinct()


def weekly_rows(spark: SparkSession, folder: str, names: DataFrame | None = None, after: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """The rows of ``executable(weekly())`` and the steps ``after`` it, of all instruments or of those in ``names`` (instrument_id, once each).

    Each line moves once, as a narrow row, to the task that holds its instrument; bars, flags and later windows by instrument
    are made there.  The plan's text would move both values and ordering of each first and last price, and the bars again.
    """
    lines = _week_lines(spark, folder)
    tasks = math.ceil(lines.count() / LINES)
    if names is not None:
        lines = lines.join(F.broadcast(names) if names.count() <= FEW else names, "instrument_id", "left_semi")
    more = [tasks] if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    # the supplier, which the text orders lines by too, is equal for all lines of a bar
    plan = executable(_line_bars("instrument_id", _WEEK, "{lines}", "FALSE", _LINE.replace("l_suppkey, ", "")), one_bar=True)
    return Plan((*plan.steps, *after)).run(spark, lines=lines.repartition(*more, "instrument_id"))
