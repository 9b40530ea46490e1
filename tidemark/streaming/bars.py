"""Bars from a stream of ticks: an extension, with event-time windows and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 day", late: str = "1 hour", instrument: str = "event_type", ts: str = "ts", price: str = "value") -> DataFrame:
    """OHLCV bars of each window; state of a window goes once the watermark has passed it."""
    x = ticks.select(F.col(instrument).alias("instrument_id"), F.col(ts).cast("timestamp").alias("at"), F.col(price).alias("price")).withWatermark("at", late)
    first, last = F.min(F.struct("at", "price")), F.max(F.struct("at", "price"))
    bars = x.groupBy("instrument_id", F.window("at", width)).agg(first["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last["price"].alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("instrument_id", F.col("window.start").cast("timestamp_ntz").alias("ts_utc"), *[F.round(c, 8).alias(c) for c in ("open", "high", "low", "close")], "volume")
