"""Running volatility and true range of bars from a stream, by state kept for each key.

Ticks go into open bars, one for each stretch of time. A timer stands at each bar's end; once the watermark has passed
it, the bar is closed, and its return and range move the key's state on, in the order of time. So a tick may come late by what the
watermark allows, and batches, their borders and restarts change nothing. State is a few numbers a key and a bar for
each stretch that is still open.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keeps state in a store that transformWithState can use.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "key string, ts timestamp, open double, high double, low double, close double, volume long, log_return double, atr double, next_sigma double"
_COLUMNS = [f.split()[0] for f in SCHEMA.split(", ")]


class Indicators(StatefulProcessor):
    """Bars of ``width`` seconds, their ATR over ``window`` bars and the EWMA volatility after each from the ``warm_up``-th return on."""

    def __init__(self, width: int, window: int = 14, decay: float = 0.94, warm_up: int = 20):
        self.width, self.window, self.decay, self.warm_up = width, window, decay, warm_up

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getMapState("bars", "start long", "first long, first_seq long, open double, high double, low double, last long, last_seq long, close double, volume long")
        self.past = handle.getValueState("past", "close double, n int, variance double, early array<double>, ranges array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: tuple(v) for k, v in self.bars.iterator()}
        fresh: dict[int, tuple] = {}
        for pdf in rows:
            pdf = pdf.sort_values(["at", "seq"])
            for start, own in pdf.groupby(pdf["at"] // (self.width * 1_000_000) * self.width):
                v, ends = own["value"], own[["at", "seq"]].to_numpy()
                bar = (int(ends[0][0]), int(ends[0][1]), float(v.iloc[0]), float(v.max()), float(v.min()), int(ends[-1][0]), int(ends[-1][1]), float(v.iloc[-1]), len(own))
                if a := fresh.get(start, known.get(start)):
                    opens, closes = (bar if bar[:2] < a[:2] else a), (bar if bar[5:7] >= a[5:7] else a)
                    bar = (*opens[:3], max(a[3], bar[3]), min(a[4], bar[4]), *closes[5:8], a[8] + bar[8])
                fresh[int(start)] = bar
        for start, bar in fresh.items():
            if start not in known:
                self.handle.registerTimer((start + self.width) * 1000)
            self.bars.updateValue((start,), bar)
        yield pd.DataFrame([], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All bars that end by now are closed, the earliest first; their own timers then find nothing."""
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        done = sorted((k[0], tuple(v)) for k, v in self.bars.iterator() if (k[0] + self.width) * 1000 <= now)
        out = []
        if done:
            past = self.past.get() if self.past.exists() else (None, 0, None, [], [])
            for start, bar in done:
                self.bars.removeKey((start,))
                past, told = self._step(past, bar[3], bar[4], bar[7])
                out.append((key[0], pd.Timestamp(start, unit="s", tz="UTC"), bar[2], bar[3], bar[4], bar[7], bar[8], *told))
            self.past.update(past)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def _step(self, past: tuple, high: float, low: float, close: float) -> tuple[tuple, tuple]:
        """The state after a closed bar, and its (log_return, atr, next_sigma)."""
        old, n, variance, early, ranges = past
        early, ranges, x = list(early), list(ranges), None
        reach = high - low if old is None else max(high - low, abs(high - old), abs(low - old))
        ranges = [*ranges[-(self.window - 1) :], reach]
        if old is not None and old > 0 and close > 0:
            x = math.log(close) - math.log(old)
            n += 1
            if n < self.warm_up:
                early.append(x)
            else:
                if n == self.warm_up:
                    early.append(x)
                    mean = math.fsum(early) / n
                    variance = math.fsum((e - mean) ** 2 for e in early) / n
                    for e in early[:-1]:
                        variance = self.decay * variance + (1 - self.decay) * e * e
                    early = []
                variance = self.decay * variance + (1 - self.decay) * x * x
        told = x, math.fsum(ranges) / self.window if len(ranges) == self.window else None, None if variance is None else math.sqrt(variance)
        return (close, n, variance, early, ranges), told

    def close(self) -> None:
        pass


def indicators(ticks: DataFrame, width: int = 3600, late: str = "10 minutes", **options) -> DataFrame:
    """(key, ts, open .. volume, log_return, atr, next_sigma) of bars of ``width`` seconds of a stream of ticks (key, ts, seq, value).

    A bar comes out once the watermark, the last tick's time less ``late``, has passed its end. ``seq`` orders ticks of
    one instant. Set ``spark.sql.streaming.stateStore.providerClass`` to ROCKS.
    """
    rows = ticks.withWatermark("ts", late).select("key", "ts", F.unix_micros("ts").alias("at"), F.col("seq").cast("long").alias("seq"), "value")
    rows = rows.filter("key IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND seq IS NOT NULL")
    return rows.groupBy("key").transformWithStateInPandas(Indicators(width, **options), outputStructType=SCHEMA, outputMode="Append", timeMode="EventTime")


def run_to_files(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what has landed, appends it to the table ``out``, each row once also over restarts, and stops."""
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
