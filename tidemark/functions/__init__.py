"""Column functions: rounding, intervals, option gamma, sample statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r(x: Column, places: int = 4) -> Column:
    """Half-even rounding without a negative zero."""
    return F.bround(x, places) + F.lit(0.0)


def tidy(x: Column, places: int = 4, digits: int = 9) -> Column:
    """``r`` for numbers of any size: large ones keep so many significant digits, as a sum's last ones follow its order."""
    scale = F.pow(F.lit(10.0), F.when(F.abs(x) < 10.0 ** (digits - places), places).otherwise(digits - 1 - F.floor(F.log10(F.abs(x)))))
    return F.bround(x * scale) / scale + F.lit(0.0)


def steady(x: Column, places: int = 4) -> Column:
    """Rounding half up that the last digits of a sum don't sway: weighted means of rounded scores often are halves."""
    return F.floor(x * 10**places + 0.500001) / 10**places + F.lit(0.0)


def sign(bull_when: str) -> float:
    return 1.0 if bull_when == "high" else -1.0


def spread_or_tiny(sd: Column) -> Column:
    """A standard deviation to divide by: nothing becomes 1e-9."""
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1e-9)).otherwise(sd)


def ratio(a: Column, b: Column, otherwise: float | None = None) -> Column:
    return F.when(F.coalesce(b, F.lit(0.0)) != 0, a / b).otherwise(F.lit(otherwise))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval for k of n, within [0, 1]; (0, 0) for none. ``k`` may be fractional."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when(n.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(n.isNull(), 0.0).otherwise(F.least(F.lit(1.0), centre + half))


def mean_interval(mean: Column, variance: Column, n: Column, n_eff: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The mean's interval on the effective number; the mean itself for one value."""
    m = F.when(n_eff > 1, n_eff).otherwise(n)
    half = F.when(n > 1, z * F.sqrt(variance / m)).otherwise(0.0)
    return mean - half, mean + half


def effective_n(days: Column, horizon: int | Column, ordered: bool = False) -> Column:
    """Greedy count of the dates of an array that lie ``horizon`` days or more after the last one counted; ``ordered`` says they ascend."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(None).cast("date").alias("last"))
    step = lambda s, d: F.when(s["last"].isNull() | (F.datediff(d, s["last"]) >= horizon), F.struct((s["n"] + 1).alias("n"), d.alias("last"))).otherwise(s)
    return F.aggregate(days if ordered else F.array_sort(days), empty, step, lambda s: s["n"])


def pearson(x: Column, y: Column) -> Column:
    """Correlation as an aggregate; 0 below five pairs or without variance."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(F.when(x.isNotNull() & y.isNotNull(), 1)) >= 5) & (sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_pop(x, y), sx * sy)).otherwise(0.0)


def option_gamma(spot: Column, strike: Column, years: Column, sigma: Column, rate: Column) -> Column:
    """Black and Scholes' gamma; 0 where an input is not positive."""
    good = (spot > 0) & (strike > 0) & (years > 0) & (sigma > 0)
    s, k, t, v = (F.when(good, c) for c in (spot, strike, years, sigma))
    d1 = (F.log(s / k) + (rate + 0.5 * v * v) * t) / (v * F.sqrt(t))
    return F.coalesce(F.exp(-0.5 * d1 * d1) / math.sqrt(2 * math.pi) / (s * v * F.sqrt(t)), F.lit(0.0))


#: Names and places of the quantiles of a forward distribution (fixed values).
QUANTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def quantile_columns(x: Column, places: int = 4) -> list[Column]:
    """Interpolated quantiles as aggregates, under their names."""
    return [r(F.percentile(x, q), places).alias(n) for n, q in QUANTILES.items()]


def prob_up(x: Column, places: int = 4, above: float = 0.0) -> Column:
    """The share of values above ``above``, as an aggregate."""
    return r(F.avg((x > above).cast("double")), places).alias("prob_up")
