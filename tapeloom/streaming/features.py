"""Rolling features of a tick stream: bars that close by event time, and statistics over the last n closed bars.

Each instrument's state is its open bars and the last n closes.  A tick goes to its open bar; a timer at the bar's end closes
it when the watermark has passed, and then its features are emitted from the closes held.  Late ticks count as long as the
watermark hasn't passed their bar's end; later ones are dropped, as Spark drops them.  Bars of an instrument close in order of
time, so features equal those of the batch over the same ticks, and they survive a restart with the checkpoint.

Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

BARS = 4
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BAR = "first_ts long, first_value double, last_ts long, last_value double, high double, low double, n long, total double"
RESULT = "instrument_id string, bar_time timestamp, open_price double, high_price double, low_price double, close_price double, volume long, turnover double, mean_close double, range_high double, return_n double"


class _Rolling(StatefulProcessor):
    def __init__(self, width_ms: int, bars: int):
        self.width, self.bars = width_ms, bars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "begin long", _BAR)
        self.past = handle.getListState("past", "close double, high double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for f in rows:
            f = f.assign(ms=f["ts_us"] // 1000)
            f = f.assign(begin=f["ms"] - f["ms"] % self.width).sort_values(["ts_us", "value"])
            for begin, g in f.groupby("begin"):
                new = (int(g.ts_us.iloc[0]), float(g.value.iloc[0]), int(g.ts_us.iloc[-1]), float(g.value.iloc[-1]), float(g.value.max()), float(g.value.min()), len(g), float(g.value.sum()))
                at = (int(begin),)
                if self.open.containsKey(at):
                    old = tuple(self.open.getValue(at))
                    first, last = min(old[:2], new[:2]), max(old[2:4], new[2:4])
                    new = (*first, *last, max(old[4], new[4]), min(old[5], new[5]), old[6] + new[6], old[7] + new[7])
                else:
                    self.handle.registerTimer(int(begin) + self.width)
                self.open.updateValue(at, new)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        begin = expiredTimerInfo.getExpiryTimeInMs() - self.width
        bar = tuple(self.open.getValue((begin,)))
        self.open.removeKey((begin,))
        held = [tuple(x) for x in self.past.get()] + [(bar[3], bar[4])]
        whole = len(held) > self.bars
        last = held[-self.bars :]
        self.past.put(held[-self.bars :])
        yield pd.DataFrame({
            "instrument_id": [key[0]], "bar_time": [pd.Timestamp(begin, unit="ms")], "open_price": [bar[1]], "high_price": [bar[4]], "low_price": [bar[5]], "close_price": [bar[3]], "volume": [bar[6]], "turnover": [bar[7]],
            "mean_close": [sum(c for c, _ in last) / len(last) if len(last) == self.bars else None], "range_high": [max(h for _, h in last) if len(last) == self.bars else None],
            "return_n": [bar[3] / held[-self.bars - 1][0] - 1 if whole and held[-self.bars - 1][0] else None],
        })

    def close(self) -> None:
        pass


def stream_features(ticks: DataFrame, width_seconds: int = 3600, bars: int = BARS, late: str = "2 hours") -> DataFrame:
    """Features of a stream of ticks (ts, event_type, value); rows are emitted once, when their bar has closed."""
    rows = ticks.where("ts IS NOT NULL AND value IS NOT NULL").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("instrument_id"), F.col("value").cast("double").alias("value"))
    rows = rows.withWatermark("ts", late).withColumn("ts_us", F.unix_micros("ts"))
    return rows.groupBy("instrument_id").transformWithStateInPandas(_Rolling(width_seconds * 1000, bars), RESULT, "Append", "EventTime")


def batch_features(ticks: DataFrame, width_seconds: int = 3600, bars: int = BARS) -> DataFrame:
    """The same features of a table of ticks."""
    rows = ticks.where("ts IS NOT NULL AND value IS NOT NULL").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("instrument_id"), F.col("value").cast("double").alias("value"))
    width = width_seconds * 1_000_000
    at = F.struct("us", "value")
    each = rows.groupBy("instrument_id", (F.col("us") - F.pmod("us", F.lit(width))).alias("begin")).agg(
        F.min_by("value", at).alias("open_price"), F.max("value").alias("high_price"), F.min("value").alias("low_price"), F.max_by("value", at).alias("close_price"), F.count("*").alias("volume"), F.sum("value").alias("turnover"),
    )
    time = Window.partitionBy("instrument_id").orderBy("begin")
    last = time.rowsBetween(1 - bars, 0)
    full = F.count("*").over(last) == bars
    before = F.lag("close_price", bars).over(time)
    return each.select(
        "instrument_id", F.timestamp_micros("begin").alias("bar_time"), "open_price", "high_price", "low_price", "close_price", "volume", "turnover",
        F.when(full, F.avg("close_price").over(last)).alias("mean_close"), F.when(full, F.max("high_price").over(last)).alias("range_high"), F.when(before != 0, F.col("close_price") / F.when(before != 0, before) - 1).alias("return_n"),
    )
