"""Setups: levels, stops, targets, base rate and publication of the current decision of each instrument."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import r
from ..operators.bars import fractals
from ..sources.shared import materialize
from . import rules
from .panel import gate, outcomes, with_atr
from .scenario import CONE, scenario_rates
from .score import score_instruments


def latest(bars: DataFrame, fingerprints: list[dict], as_of: str | None = None, look_back: int = 180, **defaults) -> DataFrame:
    """The last bar up to ``as_of`` of each instrument with its ATR, its ``rule`` and the swings of the last ``look_back`` bars."""
    bars = bars.filter(F.col("key").isin([f["ticker"] for f in fingerprints]))
    if as_of:
        bars = bars.filter(F.col("d") <= F.lit(as_of).cast("date"))
    b, mean = with_atr(fractals(bars), {rules.rule(f, **defaults)["atr_window"] for f in fingerprints})
    b = b.join(F.broadcast(rules.table(bars.sparkSession, fingerprints, **defaults)), "key").withColumn("atr", mean)
    inside = (F.col("rn") > F.col("n_bars") - look_back + 3) & (F.col("rn") <= F.col("n_bars") - 3)
    swings = lambda mark, level: F.array_sort(F.collect_list(F.when(inside & F.col(mark), F.col(level))))
    out = b.groupBy("key", "instrument").agg(
        F.first("rule").alias("rule"), F.max("n_bars").alias("n_bars"), F.max("d").alias("as_of"), F.min("d").alias("first_day"), F.max_by("close", "rn").alias("entry"), F.max_by("atr", "rn").alias("atr"),
        swings("is_high", "high").alias("highs"), swings("is_low", "low").alias("lows"),
    )
    return out.filter((F.col("n_bars") >= look_back) & (F.col("atr") > 0))


def round_levels(price: Column, n: int = 3) -> Column:
    """Round numbers around a price, a tenth of its order of magnitude apart."""
    step = F.pow(F.lit(10.0), F.floor(F.log10(F.when(price > 0, price))) - 1)
    return F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda k: F.bround((F.bround(price / step) + k) * step, 10))


def nearest(swings: Column, rounds: Column, above: bool, ref: Column) -> Column:
    """The nearest swing on one side of ``ref``; a round number only where there is no swing."""
    side = lambda a: (F.array_min if above else F.array_max)(F.filter(a, lambda x: x > ref if above else x < ref))
    return F.coalesce(side(swings), side(rounds))


def with_levels(rows: DataFrame, sl_atr: float = 1.0, tp_atr: float = 2.0, buffer_atr: float = 0.25, floor_atr: float = 0.5) -> DataFrame:
    """Adds sl, tp, risk, reward and rr to rows with entry, atr, direction, highs, lows."""
    e, a, long = F.col("entry"), F.col("atr"), F.col("direction") == "LONG"
    rounds = round_levels(e)
    up, down = nearest(F.col("highs"), rounds, True, e + 0.3 * a), nearest(F.col("lows"), rounds, False, e - 0.3 * a)
    tp = F.when(long, F.coalesce(up, e + tp_atr * a)).otherwise(F.coalesce(down, e - tp_atr * a))
    below, over = nearest(F.col("lows"), rounds, False, e), nearest(F.col("highs"), rounds, True, e)
    sl = F.when(long, F.least(F.coalesce(below - buffer_atr * a, e - sl_atr * a), e - floor_atr * a)).otherwise(F.greatest(F.coalesce(over + buffer_atr * a, e + sl_atr * a), e + floor_atr * a))
    out = rows.withColumn("tp", tp).withColumn("sl", sl)
    out = out.withColumn("risk", F.when(long, e - F.col("sl")).otherwise(F.col("sl") - e)).withColumn("reward", F.when(long, F.col("tp") - e).otherwise(e - F.col("tp")))
    return out.withColumn("rr", F.when(F.col("risk") > 0, F.col("reward") / F.col("risk")).otherwise(0.0))


def build_setups(env: dict[str, DataFrame], bars: DataFrame, fingerprints: list[dict], panel: DataFrame, as_of: str | None = None, rr_floor: float = 1.5, settled_only: bool = True, simulated: bool = True, **defaults) -> DataFrame:
    """One row per instrument: levels, base rate of this very stop and target, scenario, and why it is not published.

    ``settled_only`` leaves out neighbours whose outcome was not known at the decision. ``simulated`` adds the
    simulated chances and quantiles of the trade; they gate in place of the base rate for instruments with engine
    "scenario". ``defaults`` are settings for the instruments that have none of their own, as for the panel.
    """
    now = latest(bars, fingerprints, as_of, **defaults)
    scored = score_instruments(env, fingerprints, now.select("instrument", "as_of"))
    now = now.join(scored.select("instrument", "score", "grade", "vector", "drivers"), "instrument").withColumn("direction", F.when(F.col("score") >= 0, "LONG").otherwise("SHORT"))
    now = materialize(with_levels(now), "now")  # a row an instrument, used below in several places
    trade = now.select("instrument", F.col("as_of").alias("_now"), F.col("n_bars").alias("_n"), (F.col("risk") / F.col("atr")).alias("_sl"), (F.col("reward") / F.col("atr")).alias("_tp"))
    mine = panel.join(trade, "instrument").filter(~F.col("oos"))
    if settled_only:
        mine = mine.filter(F.col("rn") + F.col("rule.horizon_days") <= F.col("_n"))
    base = gate(now, outcomes(mine, F.col("_sl"), F.col("_tp")), **rules.GATE)
    out = now.join(base.drop("as_of"), "instrument", "left")
    out = out.join(_scenarios(bars, now), "instrument", "left") if simulated else out.select("*", *(F.lit(None).cast("double").alias(c) for c in _SIMULATED))
    by_rate = F.when(~F.coalesce("passes", F.lit(False)), F.concat(F.lit("base rate: "), F.coalesce("reason", F.lit("none"))))
    why = F.concat_ws(
        "; ", F.when(F.col("grade") == "NONE", "no grade"), F.when(F.col("rr") < rr_floor, "reward to risk"),
        F.when(F.col("rule.engine") == "scenario", _scenario_reasons()).otherwise(by_rate),
    )
    years = F.datediff("as_of", "first_day") / 365.25
    return out.select(
        "instrument", F.col("key").alias("ticker"), "as_of", "direction", "grade", "score", *(r(F.col(c), 6).alias(c) for c in ("entry", "sl", "tp", "atr")), r(F.col("rr"), 3).alias("rr"),
        "n", "n_eff", "hit_rate", "expectancy_r", *_SIMULATED, (why == "").alias("published"), why.alias("reject_reason"),
        F.when(years >= 7, "ok").otherwise("short history").alias("data_quality"), r(years, 1).alias("history_years"), "drivers",
    )


_SIMULATED = ["prob_tp", "prob_sl", "prob_time", "sim_expectancy_r", "sim_lo", "sim_hi", *CONE]


def _scenarios(bars: DataFrame, now: DataFrame) -> DataFrame:
    """The simulated chances of each instrument's trade, from its closes up to the decision."""
    trades = now.select("instrument", "key", "as_of", "direction", (F.col("reward") / F.col("entry")).alias("tp"), (F.col("risk") / F.col("entry")).alias("sl"), rules.daily_cost().alias("daily_cost"), F.col("rule.horizon_days").alias("horizon"))
    trades = trades.filter("tp > 0 AND sl > 0")
    at = trades.select(F.col("instrument").alias("name"), "key", F.col("as_of").alias("until"))
    closes = bars.select("key", "d", F.col("close").alias("v")).join(at, "key").filter("d <= until").select(F.col("name").alias("instrument"), "d", "v")
    return scenario_rates(closes, trades.drop("key", "as_of"))


def _scenario_reasons() -> Column:
    p, e = F.col("prob_tp"), F.col("sim_expectancy_r")
    told = F.concat_ws(
        "; ", F.when(p < F.col("rule.min_prob_tp"), "scenario: probability"), F.when(e < F.col("rule.min_expectancy_r"), "scenario: expectancy"),
        F.when(F.col("sim_lo") <= 0, "scenario: expectancy interval"),
    )
    return F.when(p.isNull(), "scenario: too little history").otherwise(F.nullif(told, F.lit("")))


def publish_order(setups: DataFrame) -> DataFrame:
    """Adds ``position``: published first, then by strength. Setups are one row an instrument."""
    w = Window.orderBy(F.desc("published"), F.desc(F.abs("score")), "instrument")
    return setups.withColumn("position", F.row_number().over(w))


def payload(setups: DataFrame, as_of: str, generated: str, version: int = 1) -> str:
    """The published document as JSON; one row per instrument reaches the driver."""
    rows = publish_order(setups).orderBy("position").drop("position").toJSON().collect()
    return json.dumps({"schema_version": version, "generated": generated, "as_of": as_of, "signals": [json.loads(x) for x in rows]}, indent=2, ensure_ascii=False) + "\n"


def changed(old: str | None, new: str) -> bool:
    """Whether a document says something new, besides when it was made."""
    strip = lambda t: {k: v for k, v in json.loads(t).items() if k != "generated"}
    return old is None or strip(old) != strip(new)


def write(document: str, path: str | Path, always: bool = False) -> bool:
    """Writes a document if it says something new, or ``always``; whether it was written. Readers see the old or the new one whole."""
    path = Path(path)
    if not always and not changed(path.read_text() if path.exists() else None, document):
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    fresh = path.with_name(path.name + ".new")
    fresh.write_text(document)
    fresh.replace(path)
    return True
