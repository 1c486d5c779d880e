"""What each instrument's specification says about its base rate and carry, as a column beside its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings of a specification's ``base_rate`` where it has none of its own (fixed values).
DEFAULTS = {
    "horizon_days": 30, "band": 0.1, "min_effective_n": 30, "min_hit_rate_pct": 55.0, "min_expectancy_r": 0.3, "min_prob_tp": 0.5,
    "match_coverage": False, "atr_window": 14, "engine": "analog", "oos_start": None,
}
_FIELDS = "horizon_days int, band double, min_effective_n int, min_hit_rate_pct double, min_expectancy_r double, min_prob_tp double, match_coverage boolean, atr_window int, engine string, oos_start string, swap_long double, swap_short double"
#: The gate's limits as fields of a row's ``rule``.
GATE = {
    "band": "rule.band", "horizon": "rule.horizon_days", "min_effective_n": "rule.min_effective_n", "min_hit_rate_pct": "rule.min_hit_rate_pct",
    "min_expectancy_r": "rule.min_expectancy_r", "match_coverage": "rule.match_coverage",
}


def rule(fingerprint: dict, **defaults) -> dict:
    """All settings of one specification; ``defaults`` hold where it says nothing."""
    own = {k: v for k, v in fingerprint.get("base_rate", {}).items() if k in DEFAULTS}
    swap = fingerprint.get("swap") or {}
    out = DEFAULTS | {k: v for k, v in defaults.items() if v is not None} | own
    out = {k: type(v)(out[k]) if (v := DEFAULTS[k]) is not None else out[k] for k in DEFAULTS}
    out["oos_start"] = None if out["oos_start"] is None else str(out["oos_start"])
    return out | {"swap_long": float(swap.get("long_cost_pct_per_day", 0.0)), "swap_short": float(swap.get("short_cost_pct_per_day", 0.0))}


def table(spark: SparkSession, fingerprints: list[dict], **defaults) -> DataFrame:
    """(key, instrument, rule): a row a specification, so it is small enough to broadcast."""
    rows = [(f["ticker"], f["id"], tuple(rule(f, **defaults).values())) for f in fingerprints]
    return spark.createDataFrame(rows, f"key string, instrument string, rule struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>")


def daily_cost() -> Column:
    """The carry of a row with ``direction`` and ``rule``."""
    return F.when(F.col("direction") == "LONG", F.col("rule.swap_long")).otherwise(F.col("rule.swap_short"))
