"""Out-of-sample checks of panels: predictions from neighbours, gate lift, information coefficients, folds, ablation."""

from __future__ import annotations

import copy

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pearson, r
from . import rules
from .panel import band_sums, gate, mean_of


def judged_rows(panel: DataFrame) -> DataFrame:
    """The out-of-sample rows of each instrument, or all of its rows where it has none."""
    tested = panel.filter("oos").select("instrument").distinct()
    return panel.filter("oos").unionByName(panel.join(tested, "instrument", "left_anti"))


def information_coefficients(panel: DataFrame, outcome: str = "outcome_r") -> DataFrame:
    """(instrument, driver, ic, n): correlation of each driver's score with the outcome, out of sample where there are such rows.

    Outcomes follow the direction of the whole score, so a useful driver that pulled the other way looks bad there;
    with ``forward_return`` as the outcome each driver is held against what the price did.
    """
    each = judged_rows(panel).select("instrument", F.col(outcome).alias("y"), F.explode("vector").alias("driver", "x"))
    return each.groupBy("instrument", "driver").agg(r(pearson(F.col("x"), F.col("y"))).alias("ic"), F.count("*").alias("n"))


def _predicted(rows: DataFrame, train: DataFrame, band: float | str, least: int | str, before: tuple[Column, Column] | None = None) -> DataFrame:
    """(instrument, as_of, actual, predicted) of rows with ``least`` neighbours or more."""
    own = rows.select("instrument", "as_of", F.col("outcome_r").alias("actual"), (F.col(least) if isinstance(least, str) else F.lit(least)).alias("least"))
    out = own.join(band_sums(rows, train, band, before=before), ["instrument", "as_of"]).filter((F.col("n") > 0) & (F.col("n") >= F.col("least")))
    return out.select("instrument", "as_of", "actual", mean_of().alias("predicted"))


def _figures() -> list[Column]:
    p, a = F.col("predicted"), F.col("actual")
    some = lambda x, places=4: r(F.coalesce(x, F.lit(0.0)), places)
    return [
        F.count("predicted").alias("n_predicted"), some(F.avg(((p > 0) == (a > 0)).cast("double"))).alias("sign_agreement"),
        some(F.avg(F.when(p > 0, a))).alias("exp_when_pred_bull"), some(F.avg(F.when(p <= 0, a))).alias("exp_when_pred_bear"),
    ]


def validate(panel: DataFrame, embargo: bool = False, **limits) -> DataFrame:
    """One row per instrument: base figures of the out-of-sample rows, predictions, what the gate lets pass, and driver_ic.

    Limits are those of each row's ``rule`` unless given. ``embargo`` leaves out train rows whose outcome reaches
    into the test period. ``driver_ic`` maps drivers to (ic, n).
    """
    limits = rules.GATE | {"match_coverage": False} | limits
    horizon = F.col(limits["horizon"]) if isinstance(limits["horizon"], str) else F.lit(limits["horizon"])
    train, oos = panel.filter("not oos"), panel.filter("oos")
    if embargo:
        edge = oos.groupBy("instrument").agg(F.min("rn").alias("_edge"))
        train = train.join(edge, "instrument", "left").filter(F.col("_edge").isNull() | (F.col("rn") + horizon < F.col("_edge"))).drop("_edge")
    base = panel.groupBy("instrument").agg(
        F.count(F.when(~F.col("oos"), 1)).alias("n_train"), F.count(F.when(F.col("oos"), 1)).alias("n_oos"),
        r(F.coalesce(F.avg(F.when(F.col("oos"), F.col("hit").cast("double"))), F.lit(0.0))).alias("base_hit"), r(F.coalesce(F.avg(F.when(F.col("oos"), F.col("outcome_r"))), F.lit(0.0))).alias("base_exp"),
    )
    figures = _predicted(oos, train, limits["band"], limits["min_effective_n"]).groupBy("instrument").agg(*_figures())
    passed = gate(oos, train, **limits).filter("passes").join(oos.select("instrument", "as_of", F.col("hit").alias("_hit"), F.col("outcome_r").alias("_r")), ["instrument", "as_of"])
    passed = passed.groupBy("instrument").agg(F.count("*").alias("n_gate_pass"), r(F.avg(F.col("_hit").cast("double"))).alias("gate_hit"), r(F.avg("_r")).alias("gate_exp"))
    ic = information_coefficients(panel).groupBy("instrument").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("driver", F.struct("ic", "n"))))).alias("driver_ic"))
    return base.join(figures, "instrument", "left").join(passed, "instrument", "left").na.fill(0).join(ic, "instrument", "left")


def walk_forward(panel: DataFrame, band: float | str = "rule.band", min_effective_n: int | str = "rule.min_effective_n", embargo_days: int = 0) -> DataFrame:
    """(instrument, fold, n_train, n_test, figures): each year predicted from all rows before it."""
    year = F.year("as_of")
    first = panel.groupBy("instrument").agg(F.min(year).alias("_y0"))
    rows = panel.withColumn("fold", year).join(first, "instrument")
    test = rows.filter(F.col("fold") > F.col("_y0"))
    before = F.year(F.date_add("as_of", embargo_days)), F.year("as_of")
    figures = _predicted(test, panel, band, min_effective_n, before).groupBy("instrument", F.year("as_of").alias("fold")).agg(*_figures())
    counts = rows.groupBy("instrument", "fold").agg(F.count("*").alias("n_test"), F.max("_y0").alias("_y0"))
    earlier = counts.alias("a").join(counts.alias("b"), (F.col("a.instrument") == F.col("b.instrument")) & (F.col("b.fold") < F.col("a.fold"))).groupBy("a.instrument", "a.fold").agg(F.max("a.n_test").alias("n_test"), F.sum("b.n_test").alias("n_train"))
    return earlier.join(figures, ["instrument", "fold"], "left").na.fill(0).drop("exp_when_pred_bear")


def without_driver(fingerprints: list[dict], name: str) -> list[dict]:
    """The instruments that have the driver, without it."""
    out = []
    for f in copy.deepcopy(fingerprints):
        kept = [d for d in f["drivers"] if d["name"] != name]
        if kept and len(kept) < len(f["drivers"]):
            out.append(f | {"drivers": kept})
    return out


def ablation(full: DataFrame, reduced: DataFrame) -> DataFrame:
    """(instrument, base, ablated, delta, better) of two validations' sign agreement."""
    b = reduced.select("instrument", F.col("sign_agreement").alias("ablated"))
    out = full.select("instrument", F.col("sign_agreement").alias("base")).join(b, "instrument")
    return out.withColumn("delta", r(100 * (F.col("ablated") - F.col("base")), 2)).withColumn("better", F.col("ablated") > F.col("base"))


def ablation_summary(deltas: DataFrame) -> DataFrame:
    """(mean_delta, n_better, n): how the instruments of an ablation fared together."""
    return deltas.agg(r(F.avg("delta"), 2).alias("mean_delta"), F.count_if("better").alias("n_better"), F.count("*").alias("n"))
