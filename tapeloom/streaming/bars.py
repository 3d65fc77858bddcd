"""Tick streams to bars: tumbling event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars by event type and window of ``width``; works on a stream or a batch.

    On a stream, ticks later than ``late`` are dropped and a bar is emitted (append mode) when the watermark passes its
    end; the state kept is one row for each open window and instrument.
    """
    ticks = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    return ticks.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("instrument_id")).agg(
        F.min_by("value", "ts").alias("open_price"), F.max("value").alias("high_price"), F.min("value").alias("low_price"),
        F.max_by("value", "ts").alias("close_price"), F.count("*").alias("volume"), F.sum("value").alias("turnover"),
    ).select("instrument_id", F.col("w.start").alias("bar_time"), "open_price", "high_price", "low_price", "close_price", "volume", "turnover")
