"""Panels: past decisions with their scores and outcomes, and gates on them.

Each row carries its instrument's ``rule`` (see ``rules``), so that instruments with horizons, bands, limits and
carry of their own go through one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import effective_n, mean_interval, r, wilson
from ..operators import last_rows, scans
from ..operators.bars import ahead, atr, numbered, sampled, triple_barrier
from . import rules
from .score import score_instruments


def with_atr(bars: DataFrame, windows: set[int]) -> tuple[DataFrame, Column]:
    """Numbered ``bars`` with a true-range mean for each window, and the column that picks the one of a row's ``rule``."""
    first, *more = sorted(windows)
    out = atr(bars, first)
    for w in more:
        out = out.withColumn(f"atr_{w}", F.when(F.col("rn") >= w, F.avg("tr").over(last_rows(w))))
    pick = F.col("atr")
    for w in more:
        pick = F.when(F.col("rule.atr_window") == w, F.col(f"atr_{w}")).otherwise(pick)
    return numbered(out), pick


def decisions(bars: DataFrame, fingerprints: list[dict], first: int = 220, step: int = 10, **defaults) -> DataFrame:
    """(instrument, key, rule, as_of, rn, close, atr, f): bars with a full horizon after them, every ``step`` from the ``first``."""
    known = rules.table(bars.sparkSession, fingerprints, **defaults)
    own = [rules.rule(f, **defaults) for f in fingerprints]
    out, mean = with_atr(ahead(bars.filter(F.col("key").isin([f["ticker"] for f in fingerprints])), max(x["horizon_days"] for x in own)), {x["atr_window"] for x in own})
    out = out.filter(sampled(out, first, step)).join(F.broadcast(known), "key")
    out = out.withColumn("atr", mean).withColumn("f", F.slice("f", F.lit(1), F.col("rule.horizon_days")))
    return out.filter((F.col("rn") <= F.col("n_bars") - F.col("rule.horizon_days")) & (F.col("atr") > 0)).select("instrument", "key", "rule", F.col("d").alias("as_of"), "rn", "close", "atr", "f")


def scored_panel(env: dict[str, DataFrame], bars: DataFrame, fingerprints: list[dict], first: int = 220, step: int = 10, **defaults) -> DataFrame:
    """Decisions with score, direction, vector, oos: the part that doesn't depend on stops and targets.

    ``defaults`` are settings (``horizon_days``, ``oos_start`` ...) for the instruments that have none of their own.
    """
    at = decisions(bars, fingerprints, first, step, **defaults)
    scored = score_instruments(env, fingerprints, at.select("instrument", "as_of")).filter("n_ok > 0")
    side = F.when(F.col("score") >= 0, "LONG").otherwise("SHORT")
    oos = F.coalesce(F.col("as_of") >= F.col("rule.oos_start").cast("date"), F.lit(False))
    return at.join(scored.select("instrument", "as_of", "score", "vector"), ["instrument", "as_of"]).select("instrument", "key", "rule", "as_of", "rn", "close", "atr", "score", side.alias("direction"), "vector", oos.alias("oos"), "f")


def outcomes(panel: DataFrame, sl_atr: Column | float = 1.0, tp_atr: Column | float = 2.0) -> DataFrame:
    """The panel with label, outcome_r, held and hit for stops and targets in multiples of the ATR, carry taken off, and the close's plain return over the horizon."""
    panel = panel.withColumn("forward_return", F.try_element_at("f", F.lit(-1))["close"] / F.col("close") - 1)
    sl, tp = (x if isinstance(x, Column) else F.lit(x) for x in (sl_atr, tp_atr))
    rr = F.when(sl != 0, tp / sl).otherwise(0.0)
    return triple_barrier(panel, sl * F.col("atr"), tp * F.col("atr"), rr, rules.daily_cost()).withColumn("hit", F.col("label") == "TP")


def _value(x) -> Column:
    """A number, or a field of the rows."""
    return F.col(x) if isinstance(x, str) else F.lit(x)


#: Scores nearer to an edge of the band than this lie on it. Scores are multiples of GRID.
NEAR, GRID = 1e-9, 1e-4


def _edges(score: Column, band: Column) -> tuple[Column, Column]:
    """Between which scores a neighbour lies, so that scores on the edges are told as ``abs(a - b) <= band`` tells them."""
    out = []
    for sign in (-1, 1):
        edge = score + sign * band
        on_grid = F.round(edge / GRID) / (1 / GRID)
        included = F.abs(on_grid - score) <= band
        out.append(F.when(F.abs(on_grid - edge) < NEAR, on_grid + F.when(included, sign * NEAR).otherwise(-sign * NEAR)).otherwise(edge))
    return out[0], out[1]


def _coverage(match: bool | str) -> Column:
    """What must be equal besides instrument and direction: the set of drivers that have data, where the rule asks for it."""
    drivers = F.array_join(F.array_sort(F.map_keys("vector")), "\n")
    return F.lit("") if match is False else drivers if match is True else F.when(_value(match), drivers).otherwise("")


def band_sums(current: DataFrame, train: DataFrame, band: float | str, match_coverage: bool | str = False, keys: tuple[str, ...] = ("instrument", "as_of"), before: tuple[Column, Column] | None = None) -> DataFrame:
    """(keys, n, hits, total, squares) over the train rows of the same instrument and direction with a score within ``band``.

    No pairs are made: train rows and both edges of each current row's band are sorted by score together, and sums up to
    the edges are taken from each other; sums of decimals are exact, so that differences are. ``band`` and ``match_coverage``
    may be fields of a row, equal for all rows of an instrument. With ``before``, a number of the train rows and
    one of the current rows, such as years, only train rows with a lesser number count: a current row has edges for
    each number before its own.
    """
    group = ["instrument", "direction", "_cov", "_turn"]
    exact = lambda x: x.cast("decimal(30,15)")
    turn, own = (F.lit(0), F.lit(1)) if before is None else before
    t = train.select(
        "instrument", "direction", _coverage(match_coverage).alias("_cov"), turn.alias("_turn"), F.struct(F.col("score").alias("at"), F.lit(0).alias("side")).alias("_at"),
        F.col("hit").cast("long").alias("_hit"), exact(F.col("outcome_r")).alias("_r"), exact(F.col("outcome_r") * F.col("outcome_r")).alias("_q"), F.lit(None).cast(current.select(*keys).schema.simpleString()).alias("_c"),
    )
    lower, upper = _edges(F.col("score"), _value(band))
    both = F.explode(F.array(F.struct(lower.alias("at"), F.lit(-1).alias("side")), F.struct(upper.alias("at"), F.lit(1).alias("side"))))
    c = current.select("instrument", "direction", _coverage(match_coverage).alias("_cov"), own.alias("_own"), both.alias("_at"), F.struct(*keys).alias("_c"))
    turns = train.select("instrument", turn.alias("_turn")).distinct()
    c = c.join(turns, "instrument").filter("_turn < _own").select(*group, "_at", F.lit(None).cast("long").alias("_hit"), *(F.lit(None).cast("decimal(30,15)").alias(x) for x in ("_r", "_q")), "_c")
    rows = scans.cut(t.unionByName(c), F.col("_at.at"), 0.05)
    rows = scans.running(rows, tuple(group), "_at", n=F.when(F.col("_c").isNull(), 1).otherwise(0), hits=F.coalesce("_hit", F.lit(0)), total=F.coalesce("_r", exact(F.lit(0))), squares=F.coalesce("_q", exact(F.lit(0))))
    names = ["n", "hits", "total", "squares"]
    sums = rows.filter("_c IS NOT NULL").groupBy(*(F.col(f"_c.{k}") for k in keys)).agg(*(F.sum(F.when(F.col("_at.side") > 0, F.col(n)).otherwise(-F.col(n))).alias(n) for n in names))
    out = current.select(*keys).join(sums, list(keys), "left")
    return out.select(*keys, *(F.coalesce(F.col(n).cast("long" if n in ("n", "hits") else "double"), F.lit(0)).alias(n) for n in names))


def band_days(current: DataFrame, train: DataFrame, band: float | str, horizon: int | str, match_coverage: bool | str = False, keys: tuple[str, ...] = ("instrument", "as_of")) -> DataFrame:
    """(keys, n_eff): how many days of the band's train rows lie ``horizon`` days apart, counted greedily from the first.

    A fold over the days of the instrument and direction, which are one array of both; it makes no pairs.
    """
    group = ["instrument", "direction", "_cov"]
    days = train.withColumn("_cov", _coverage(match_coverage)).groupBy(*group).agg(F.array_sort(F.collect_set(F.struct(F.col("as_of").alias("day"), F.col("score").alias("at")))).alias("_days"))
    c = current.select(*keys, *(x for x in ("direction",) if x not in keys), "score", _coverage(match_coverage).alias("_cov"), _value(band).alias("_band"), _value(horizon).alias("_h"))
    near = F.filter("_days", lambda x: F.abs(x["at"] - F.col("score")) <= F.col("_band"))
    return c.join(days, group).select(*keys, effective_n(F.transform(near, lambda x: x["day"]), F.col("_h"), ordered=True).alias("n_eff"))


def mean_of(sums: str = "total") -> Column:
    return F.col(sums) / F.nullif(F.col("n"), F.lit(0))


def gate(
    current: DataFrame, train: DataFrame, band: float | str = 0.1, horizon: int | str | None = 30, min_effective_n: int | str = 30,
    min_hit_rate_pct: float | str = 55.0, min_expectancy_r: float | str = 0.3, match_coverage: bool | str = False, keys: tuple[str, ...] = ("instrument", "as_of"),
) -> DataFrame:
    """The base rate of each current row: n, n_eff, hit_rate and expectancy_r with intervals, passes, reason.

    Limits are numbers or fields of the current rows, such as those of ``rules.GATE``.
    """
    limits = {"_least": min_effective_n, "_min_hit": min_hit_rate_pct, "_min_exp": min_expectancy_r}
    agg = current.select(*keys, *(_value(v).alias(k) for k, v in limits.items())).join(band_sums(current, train, band, match_coverage, keys), list(keys))
    if horizon:
        agg = agg.join(band_days(current, train, band, horizon, match_coverage, keys), list(keys), "left").withColumn("n_eff", F.coalesce("n_eff", F.lit(0)))
    else:
        agg = agg.withColumn("n_eff", F.col("n").cast("int"))
    n = F.col("n")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (F.col("squares") - F.col("total") * F.col("total") / n) / (n - 1)))
    hit, mean = F.coalesce(F.col("hits") / F.nullif(n, F.lit(0)), F.lit(0.0)), F.coalesce(mean_of(), F.lit(0.0))
    lo, hi = wilson(hit * F.col("n_eff"), F.col("n_eff"))
    e_lo, e_hi = mean_interval(mean, F.coalesce(variance, F.lit(0.0)), n, F.col("n_eff"))
    some = n > 0
    reasons = F.concat_ws(
        "; ", F.when(~some, "no neighbours in the band"), F.when(some & (F.col("n_eff") < F.col("_least")), "too few independent neighbours"), F.when(some & (lo * 100 < F.col("_min_hit")), "hit rate"),
        F.when(some & (mean < F.col("_min_exp")), "expectancy"), F.when(some & (e_lo <= 0), "expectancy interval"),
    )
    out = agg.select(*keys, n, "n_eff", r(hit).alias("hit_rate"), r(lo).alias("hit_lo"), r(hi).alias("hit_hi"), r(mean).alias("expectancy_r"), r(e_lo).alias("exp_lo"), r(e_hi).alias("exp_hi"), reasons.alias("reason"))
    return out.withColumn("passes", F.col("reason") == "").withColumn("reason", F.when(F.col("reason") == "", "approved").otherwise(F.col("reason")))
