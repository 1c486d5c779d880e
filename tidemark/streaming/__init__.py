"""Bars from a stream of ticks, upserted batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(key, ts, open, high, low, close, volume) of ticks (key, ts, seq, value); late ones beyond ``late`` are left out."""
    v, k = F.col("value"), F.struct("ts", "seq")
    out = ticks.withWatermark("ts", late).groupBy("key", F.window("ts", width)).agg(
        F.min_by(v, k).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, k).alias("close"), F.count("*").alias("volume")
    )
    return out.select("key", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def run_available(bars: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Processes what has landed and stops: the periodic job. ``apply`` upserts one batch and may see it again."""
    query = bars.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
