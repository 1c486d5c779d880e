"""Operators on bars (key, d, open, high, low, close, volume)."""

from __future__ import annotations

import math
import statistics
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import last_rows, rows_before


def log_returns(closes: DataFrame) -> DataFrame:
    v = F.log("v")
    return closes.select("key", "d", (v - F.lag(v).over(rows_before())).alias("log_return"))


def atr(bars: DataFrame, window: int = 14) -> DataFrame:
    """``bars`` with rn (from 1), tr and atr: the simple mean of the last ``window`` true ranges, null before."""
    prev = F.lag("close").over(rows_before())
    out = bars.withColumn("rn", F.row_number().over(rows_before())).withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    return out.withColumn("atr", F.when(F.col("rn") >= window, F.avg("tr").over(last_rows(window))))


def fractals(bars: DataFrame, wing: int = 3) -> DataFrame:
    """``bars`` with is_high and is_low: the extreme of ``wing`` bars to both sides; ties count."""
    w = rows_before().rowsBetween(-wing, wing)
    full = F.count("*").over(w) == 2 * wing + 1
    return bars.select("*", (full & (F.col("high") == F.max("high").over(w))).alias("is_high"), (full & (F.col("low") == F.min("low").over(w))).alias("is_low"))


def ahead(bars: DataFrame, horizon: int) -> DataFrame:
    """``bars`` with ``f``, the next ``horizon`` bars as an array."""
    w = rows_before().rowsBetween(1, horizon)
    return bars.withColumn("f", F.collect_list(F.struct("high", "low", "close")).over(w))


def triple_barrier(rows: DataFrame, sl: Column, tp: Column, rr: Column, daily_cost: Column | None = None) -> DataFrame:
    """Adds label, outcome_r and held to rows with close, direction and ``f``: which barrier the next bars meet first.

    A stop and a target met by the same bar count as the stop. At the end of time the move counts in units of
    the stop's distance. ``daily_cost``, a share of the entry, is taken for each bar held.
    """
    long, entry = F.col("direction") == "LONG", F.col("close")
    hit = lambda down, dist: F.array_position(F.transform("f", lambda b: F.when(down, b["low"] <= entry - dist).otherwise(b["high"] >= entry + dist)), True)
    out = rows.withColumn("_stop_at", hit(long, sl)).withColumn("_target_at", hit(~long, tp))
    stop = (F.col("_stop_at") > 0) & ((F.col("_target_at") == 0) | (F.col("_stop_at") <= F.col("_target_at")))
    end = F.coalesce(F.try_element_at("f", F.lit(-1))["close"], entry)
    move = F.when(long, end - entry).otherwise(entry - end)
    out = out.withColumn("label", F.when(stop, "SL").when(F.col("_target_at") > 0, "TP").otherwise("TIME"))
    out = out.withColumn("held", F.when(stop, F.col("_stop_at")).when(F.col("_target_at") > 0, F.col("_target_at")).otherwise(F.size("f")).cast("int"))
    gain = F.when(stop, -1.0).when(F.col("_target_at") > 0, rr).otherwise(F.when(sl > 0, move / sl).otherwise(0.0))
    cost = F.lit(0.0) if daily_cost is None else swap_cost(daily_cost, entry, F.col("held"), sl)
    return out.withColumn("outcome_r", gain - cost).drop("_stop_at", "_target_at", "f")


def swap_cost(daily: Column, entry: Column, held: Column, sl: Column) -> Column:
    """Carry over the bars held in units of the stop's distance; 0 without a rate, distance, price or time."""
    return F.when((sl > 0) & (entry > 0) & (held > 0), F.coalesce(daily, F.lit(0.0)) * entry * held / sl).otherwise(0.0)


#: The largest power of ten that a feed may be off by (a fixed value).
MOST_OFF = 3


def _scale(close: float, usual: float, tolerance: float) -> float:
    """The power of ten that brings a close near the usual one; 1 where it is near already or none does."""
    if abs(close - usual) <= tolerance * usual:
        return 1.0
    power = 10.0 ** max(-MOST_OFF, min(MOST_OFF, round(math.log10(usual / close))))
    return power if abs(close * power - usual) <= tolerance * usual else 1.0


def repair_scales(bars: DataFrame, tolerance: float = 0.5, window: int = 15) -> DataFrame:
    """``bars`` with bars that are off by a power of ten put right, and ``factor``.

    A bar is compared with the median of the positive ones among up to ``window`` repaired closes before it,
    if there are three, so a symbol's bars are gone through in order; a task holds one symbol's closes.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d").reset_index(drop=True)
        recent: deque[float] = deque(maxlen=window)
        factors = []
        for close in pdf["close"].tolist():
            known = [x for x in recent if x > 0]
            factors.append(_scale(close, statistics.median(known), tolerance) if close > 0 and len(known) >= 3 else 1.0)
            recent.append(close * factors[-1])
        pdf["factor"] = factors
        prices = ["open", "high", "low", "close"]
        pdf[prices] = pdf[prices].mul(pdf["factor"], axis=0)
        return pdf

    return bars.groupBy("key").applyInPandas(one, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in bars.schema)}, factor double")


def sampled(bars: DataFrame, first: int, step: int) -> Column:
    """Whether a bar with rn is a decision: every ``step`` from the ``first``, counted from 0."""
    return (F.col("rn") - 1 >= first) & ((F.col("rn") - 1 - first) % step == 0)


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("rn", F.row_number().over(rows_before())).withColumn("n_bars", F.count("*").over(Window.partitionBy("key")))
