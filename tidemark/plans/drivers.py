"""The drivers: signals in [-1, 1] for probes (key, as_of), positive for bullish.

Each driver is computed once over whole series and brought to the decision dates by an as-of join; only
what lies on or before a date is seen from it. A driver gives (key, as_of, ok, score, value); too few
observations give ok = false and score 0, and keep the row.

Most drivers depend on the rows of their series alone: they give (key, d, ok, score, value), and ``at_probes`` brings any
number of them to the dates together. The others need the dates themselves. Parameters may be a ``Choice`` by key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import r, ratio, sign, spread_or_tiny
from ..operators import asof, expanding, last_rows, last_rows_share, look_back, rows_before, seasonal_baseline, spine_ratio, spine_spread
from ..operators.cases import Choice, pick

REGISTRY: dict[str, Callable[..., DataFrame]] = {}
#: The drivers that depend on the rows of their series alone: what gives their rows.
BY_ROWS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"driver {name} is registered already")
        REGISTRY[name] = fn
        return fn

    return add


def register_rows(name: str):
    """Registers what gives (key, d, ok, score, value), and optionally ``until`` and ``months``, as a driver; see ``at_probes``."""

    def add(fn):
        @register(name)
        @wraps(fn)
        def driver(probes, *args, **params):
            return at_probes(probes, fn(*args, **params)).select("key", "as_of", "ok", "score", "value")

        BY_ROWS[name] = fn
        return driver

    return add


def get_driver(name: str) -> Callable[..., DataFrame]:
    if name not in REGISTRY:
        raise KeyError(f"unknown driver {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name]


def registered() -> list[str]:
    return sorted(REGISTRY)


def _result(df: DataFrame, ok: Column, score: Column, value: Column, places: int = 6, day: str = "as_of", *more: str) -> DataFrame:
    ok = F.coalesce(ok, F.lit(False))
    return df.select("key", day, ok.alias("ok"), F.when(ok, r(score)).otherwise(F.lit(0.0)).alias("score"), F.when(ok, r(value, places)).alias("value"), *more)


def at_probes(probes: DataFrame, rows: DataFrame) -> DataFrame:
    """``probes`` (key, as_of and others) with ok, score and value of the last row (key, d, ...) on or before them.

    A row counts up to its day ``until`` and scores in its ``months`` only, if it has these.
    """
    more = [c for c in ("until", "months") if c in rows.columns]
    out = asof(probes, rows, "as_of", "d", ["ok", "score", "value", *more])
    ok, score = F.coalesce("ok", F.lit(False)), F.col("score")
    if "until" in more:
        ok = ok & F.coalesce(F.col("as_of").cast("date") <= F.col("until"), F.lit(True))
    if "months" in more:
        score = F.when(F.coalesce(F.array_contains("months", F.month("as_of")), F.lit(True)), score).otherwise(0.0)
    return out.select(*probes.columns, ok.alias("ok"), F.when(ok, score).otherwise(F.lit(0.0)).alias("score"), F.when(ok, F.col("value")).alias("value"))


def _tanh(cur: Column, sd: Column) -> Column:
    return F.tanh(cur / spread_or_tiny(sd))


def _percentile(df: DataFrame, bull_when: str | Choice, least: int = 20, day: str = "as_of") -> DataFrame:
    return _result(df, F.col("n") >= least, (2 * F.col("share") - 1) * pick(bull_when, sign), F.col("cur"), 6, day)


def _at(probes: DataFrame, rows: DataFrame, *values: str, **options) -> DataFrame:
    return asof(probes, rows, "as_of", "d", list(values), **options)


@register("level_percentile")
def level_percentile(probes, series, lookback_days=504, bull_when="high"):
    return _percentile(look_back(probes, series, lookback_days), bull_when)


@register("series_spread_percentile")
def series_spread_percentile(probes, minuend, subtrahend, lookback_days=504, bull_when="high"):
    return _percentile(look_back(probes, spine_spread(minuend, subtrahend), lookback_days), bull_when)


def _change(series, change: Callable[[int], Column], horizon: int | Choice, least: int, bull_when: str | Choice):
    rows = series.withColumn("cur", pick(horizon, change)).select("key", "d", "cur", F.stddev_pop("cur").over(expanding()).alias("sd"), F.row_number().over(rows_before()).alias("n"))
    return _result(rows, F.col("n") >= pick(horizon) + least, _tanh(F.col("cur"), F.col("sd")) * pick(bull_when, sign), F.col("cur"), 6, "d")


@register_rows("momentum")
def momentum(series, horizon_days=21, bull_when="high"):
    return _change(series, lambda h: F.col("v") - F.lag("v", h).over(rows_before()), horizon_days, 20, bull_when)


@register_rows("price_momentum")
def price_momentum(closes, horizon_days=20, bull_when="high"):
    old = lambda h: F.lag("v", h).over(rows_before())
    return _change(closes, lambda h: ratio(F.col("v") - old(h), old(h)), horizon_days, 30, bull_when)


@register_rows("price_vs_sma")
def price_vs_sma(closes, window=200, hist=250):
    n, sma = F.row_number().over(rows_before()), pick(window, lambda w: F.avg("v").over(last_rows(w)))
    rows = closes.withColumn("n", n).withColumn("sma", sma).withColumn("cur", F.when(F.col("n") >= pick(window), ratio(F.col("v") - F.col("sma"), F.col("sma"), 0.0)))
    rows = rows.withColumn("sd", pick(hist, lambda h: F.stddev_pop("cur").over(last_rows(h + 1))))
    return _result(rows, F.col("n") >= pick(window) + 1, _tanh(F.col("cur"), F.col("sd")), F.col("cur"), 6, "d")


@register_rows("cot_spec_net_percentile")
def cot_spec_net_percentile(cot, lookback_weeks=156, release_days=3, bull_when="high"):
    net = F.col("long_spec") - F.col("short_spec")
    rows = cot.withColumn("net", F.when(F.coalesce("open_interest", F.lit(0)) != 0, net / F.col("open_interest")).otherwise(net.cast("double")))
    rows = last_rows_share(rows.select("key", "d", F.col("net").alias("v")), lookback_weeks)
    return _percentile(rows.withColumn("d", F.date_add("d", pick(release_days))), bull_when, day="d")


def _z(probes, ratios, least: int, bull_when: str, extra: Column | None = None, places: int = 6):
    """Expanding z-score of a ratio series at the probes."""
    e = expanding()
    rows = ratios.select("key", "d", F.col("v").alias("cur"), F.avg("v").over(e).alias("mean"), F.stddev_pop("v").over(e).alias("sd"), F.count("v").over(e).alias("n"))
    out = _at(probes, rows, "cur", "mean", "sd", "n")
    ok = F.col("n") >= least
    return _result(out, ok if extra is None else ok & extra, _tanh(F.col("cur") - F.col("mean"), F.col("sd")) * pick(bull_when, sign), F.col("cur"), places)


def _counted(probes, **series):
    """The probes with the number of observations of each series up to then."""
    for name, s in series.items():
        probes = _at(probes, s.select("key", "d", F.row_number().over(rows_before()).alias(name)), name)
    return probes


@register("ethanol_parity")
def ethanol_parity(probes, closes, ethanol, fx):
    both = asof(closes, ethanol.withColumnRenamed("v", "e"), "d", "d", ["e"])
    both = asof(both, fx.withColumnRenamed("v", "b"), "d", "d", ["b"]).filter((F.col("v") > 0) & (F.col("b") > 0) & F.col("e").isNotNull())
    enough = (F.col("n_e") >= 20) & (F.col("n_b") >= 1) & (F.col("n_c") >= 20)
    return _z(_counted(probes, n_e=ethanol, n_b=fx, n_c=closes), both.select("key", "d", (F.col("e") / F.col("b") / F.col("v")).alias("v")), 20, "high", enough)


@register("price_ratio")
def price_ratio(probes, numerator, denominator, bull_when="high"):
    enough = (F.col("n_a") >= 30) & (F.col("n_b") >= 30)
    return _z(_counted(probes, n_a=numerator, n_b=denominator), spine_ratio(numerator, denominator), 30, bull_when, enough)


@register("series_ratio")
def series_ratio(probes, numerator, denominator, lookback_days=1825, bull_when="high"):
    ratios = spine_ratio(numerator, denominator).select("key", "d", "v", F.lit(False).alias("probe"))
    both = ratios.unionByName(probes.select("key", F.col("as_of").alias("d"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("probe")))
    inside = lambda f: pick(lookback_days, lambda days: f.over(rows_before(order=F.unix_date("d")).rangeBetween(-days, 0)))
    cur = inside(F.max(F.when(F.col("v").isNotNull(), F.struct("d", "v"))))["v"]
    out = both.select("key", F.col("d").alias("as_of"), "probe", cur.alias("cur"), *(inside(f("v")).alias(n) for n, f in (("n", F.count), ("mean", F.avg), ("sd", F.stddev_pop)))).filter("probe")
    out = _counted(out, n_a=numerator, n_b=denominator)
    return _result(out, (F.col("n") >= 20) & (F.col("n_a") >= 20) & (F.col("n_b") >= 20), _tanh(F.col("cur") - F.col("mean"), F.col("sd")) * pick(bull_when, sign), F.col("cur"))


@register_rows("etf_flow")
def etf_flow(holdings, horizon_days=63, bull_when="high"):
    rows = holdings.withColumn("old", pick(horizon_days, lambda h: F.lag("v", h).over(rows_before()))).withColumn("cur", ratio(F.col("v") - F.col("old"), F.col("old")))
    e = expanding()
    rows = rows.select("key", "d", "old", "cur", F.stddev_pop("cur").over(e).alias("sd"), F.count("cur").over(e).alias("m"), F.row_number().over(rows_before()).alias("n"))
    enough = (F.col("n") >= pick(horizon_days) + 30) & (F.col("old") > 0) & (F.col("m") >= 20)
    return _result(rows, enough, _tanh(F.col("cur"), F.col("sd")) * pick(bull_when, sign), F.col("cur"), 4, "d")


def _season(daily, window: int | Choice, sums: bool, half_width: int | Choice, exclude: int):
    """A rolling sum or minimum against its season: v, z, and whether there is enough."""
    roll = pick(window, lambda n: (F.sum if sums else F.min)("v").over(last_rows(n)))
    rows = seasonal_baseline(daily.filter(F.col("v").isNotNull()).select("key", "d", roll.alias("v")), half_width, exclude)
    return rows.withColumn("z", (F.col("v") - F.col("mean")) / spread_or_tiny(F.col("sd"))).withColumn("enough", (F.col("n_all") >= 365 * 3) & (F.col("n") >= 20))


@register_rows("rainfall_anomaly")
def rainfall_anomaly(weather, window_days=30, seasonal_halfwidth=15, active_months=None):
    rows = _season(weather.select("key", "d", F.col("precip").alias("v")), window_days, True, seasonal_halfwidth, 60)
    months = pick(active_months, lambda m: F.lit(list(m) if m else None).cast("array<int>"))
    return _result(rows.withColumn("months", months), F.col("enough"), F.tanh(F.abs("z") - 1), F.col("z"), 3, "d", "months")


@register_rows("degree_days_anomaly")
def degree_days_anomaly(weather, comfort_base_c=18.0, window_days=14, seasonal_halfwidth=15, bull_when="high"):
    rows = _season(weather.select("key", "d", F.abs((F.col("tmax") + F.col("tmin")) / 2 - pick(comfort_base_c)).alias("v")), window_days, True, seasonal_halfwidth, 30)
    return _result(rows, F.col("enough"), F.tanh("z") * pick(bull_when, sign), F.col("z"), 3, "d")


@register_rows("frost_anomaly")
def frost_anomaly(weather, window_days=10, seasonal_halfwidth=15, abs_cold_gate_c=10.0):
    rows = _season(weather.select("key", "d", F.col("tmin").alias("v")), window_days, False, seasonal_halfwidth, 60)
    return _result(rows, F.col("enough"), F.when(F.col("v") > pick(abs_cold_gate_c), 0.0).otherwise(F.tanh(F.greatest(F.lit(0.0), -F.col("z") - 1))), F.col("v"), 1, "d")


@register("seasonal_anomaly")
def seasonal_anomaly(probes, series, lookback_days=3650, seasonal_halfwidth=10, exclude_rows=30, bull_when="high"):
    """Bounded at both ends (calendar look-back, excluded rows), so a join on the series by day of the year."""
    rows = series.select("key", "d", "v", F.row_number().over(rows_before()).alias("rn"), F.dayofyear("d").alias("doy"))
    now = _at(probes, rows, "d", "v", "rn", "doy").filter(F.col("rn").isNotNull()).withColumn("from", F.date_sub("as_of", pick(lookback_days)))
    near = F.explode(F.transform(F.sequence(-pick(seasonal_halfwidth), pick(seasonal_halfwidth)), lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(366)) + 1))
    past = rows.select("key", F.col("doy").alias("near"), F.col("d").alias("pd"), F.col("v").alias("pv"), F.col("rn").alias("prn"))
    base = now.withColumn("near", near).join(past, ["key", "near"]).filter((F.col("pd") >= F.col("from")) & (F.col("prn") <= F.col("rn") - pick(exclude_rows)))
    base = base.groupBy("key", "as_of").agg(F.avg("pv").alias("mean"), F.stddev_pop("pv").alias("sd"), F.count("*").alias("n"))
    # Observations inside the look-back: the rank now less the rank at its start.
    first = asof(now, rows.select("key", F.date_add("d", 1).alias("d"), F.col("rn").alias("gone")), "from", "d", ["gone"])
    out = probes.join(first.withColumnRenamed("v", "cur").drop("d"), ["key", "as_of"], "left").join(base, ["key", "as_of"], "left")
    held = F.col("rn") - F.coalesce("gone", F.lit(0))
    return _result(out, (held >= 365) & (F.col("n") >= 15), _tanh(F.col("cur") - F.col("mean"), F.col("sd")) * pick(bull_when, sign), F.col("cur"), 1)


@register_rows("gamma_regime")
def gamma_regime(gamma, max_age_days=5, k=8.0):
    rows = gamma.withColumn("until", F.date_add("d", pick(max_age_days)))
    whole = (F.col("spot") > 0) & F.col("gamma_center").isNotNull()
    pull = F.tanh(pick(k) * (F.col("gamma_center") - F.col("spot")) / F.nullif("spot", F.lit(0.0)))
    return _result(rows, whole, F.when(F.col("net_gex") > 0, pull).otherwise(0.0), F.coalesce("net_gex", F.lit(0.0)), 2, "d", "until")


def gamma_snapshot(options: DataFrame) -> DataFrame:
    """(key, d, spot, net_gex, gamma_center) of contracts, each at its own ``rate`` if there is one: calls add and puts take away."""
    from ..functions import option_gamma

    rate = F.coalesce("rate", F.lit(0.0)) if "rate" in options.columns else F.lit(0.0)
    g = option_gamma(F.col("spot"), F.col("strike"), F.col("years"), F.col("iv") / 100.0, rate)
    used = options.filter((F.col("oi") > 0) & (F.col("iv") != 0)).withColumn("g", g).filter("g > 0").withColumn("w", F.col("g") * F.col("oi"))
    out = used.groupBy("key", "d").agg(F.max("spot").alias("spot"), F.sum(F.when(F.col("kind") == "C", F.col("w")).otherwise(-F.col("w"))).alias("net"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("strike")).alias("ws"))
    return out.filter("w > 0").select("key", "d", r(F.col("spot"), 2).alias("spot"), r(F.col("net")).alias("net_gex"), r(F.col("ws") / F.col("w"), 2).alias("gamma_center"))


def parse_instrument(name: Column) -> tuple[Column, Column, Column]:
    """(expiry, strike, kind) of names like 'BTC-26MAR27-105000-C'; nulls for others."""
    good = F.regexp_like(name, F.lit(r"^[^-]+-\d{1,2}[A-Za-z]{3}\d{2}-\d+(\.\d+)?-[^-]+$"))
    part = lambda k: F.when(good, F.split(name, "-")[k])
    day = part(1)
    month = F.initcap(F.regexp_extract(day, "([A-Za-z]{3})", 1))
    text = F.lpad(F.concat(F.regexp_extract(day, r"^(\d+)", 1), month, F.regexp_extract(day, r"(\d+)$", 1)), 7, "0")
    return F.try_to_date(text, "ddMMMyy"), part(2).cast("double"), F.upper(part(3))
