"""Scores and grades of instruments from weighted drivers, and the specification of instruments."""

from __future__ import annotations

from functools import reduce
from inspect import signature

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import r, steady
from ..operators.cases import Choice
from ..sources.shared import materialize
from .drivers import BY_ROWS, at_probes, get_driver

#: Grade limits on the strength of a score (fixed values).
THRESHOLDS = {"A_plus": 0.55, "A": 0.40, "B": 0.25}


def validate_specs(fingerprints: list[dict], known_series: set[str] | None = None) -> None:
    """Raises on unknown drivers, missing keys and, if ``known_series`` is given, series that are not there; ``missing_series`` asks the tables."""
    for f in fingerprints:
        for field in ("id", "ticker", "drivers"):
            if field not in f:
                raise ValueError(f"{f.get('id', '?')}: no {field}")
        for d in f["drivers"]:
            get_driver(d["name"])
            if known_series is not None:
                lost = {v for k, v in d.get("params", {}).items() if k in SOURCES and v not in known_series}
                if lost:
                    raise ValueError(f"{f['id']}, {d['name']}: no series {sorted(lost)}")


#: Parameters of a driver that name a series, and the kind of it.
SOURCES = {
    "series": "macro", "minuend": "macro", "subtrahend": "macro", "symbol": "closes", "market": "cot", "region": "weather", "ticker": "etf",
    "instrument": "gamma", "ethanol_series": "macro", "brl_series": "macro", "numerator": None, "denominator": None,
}
#: Names of a driver's series arguments where they differ from the parameter's.
ARGUMENTS = {"symbol": "closes", "market": "cot", "region": "weather", "ticker": "holdings", "instrument": "gamma", "ethanol_series": "ethanol", "brl_series": "fx"}


#: What kind of series a driver's parameters name where the parameter alone doesn't tell.
KINDS = {"price_ratio": "closes", "series_ratio": "macro"}


def missing_series(env: dict[str, DataFrame], fingerprints: list[dict]) -> DataFrame:
    """(instrument, driver, kind, series) of the specifications' series that the tables of ``env`` don't have."""
    rows = [
        (f["id"], d["name"], SOURCES[k] or KINDS[d["name"]], str(v)) for f in fingerprints for d in f["drivers"] for k, v in d.get("params", {}).items() if k in SOURCES
    ] + [(f["id"], "ticker", "closes", f["ticker"]) for f in fingerprints]
    wanted = next(iter(env.values())).sparkSession.createDataFrame(rows, "instrument string, driver string, kind string, series string").distinct()
    kinds = sorted({r[2] for r in rows})
    there = reduce(DataFrame.unionByName, (env[k].select(F.lit(k).alias("kind"), F.col("key").alias("series")).distinct() for k in kinds))
    return wanted.join(there, ["kind", "series"], "left_anti").select("instrument", "driver", "kind", "series")


def _arguments(env: dict[str, DataFrame], name: str, cases: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """The series arguments of a driver for many cases at once: tables whose keys are the cases' labels."""
    args = {}
    for argument in next(iter(cases.values())):
        labels: dict[str, list[str]] = {}
        for label, series in cases.items():
            labels.setdefault(series[argument], []).append(label)
        to = F.create_map(*(x for k, v in labels.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        df = env[SOURCES[argument] or KINDS[name]].filter(F.col("key").isin(list(labels)))
        args[ARGUMENTS.get(argument, argument)] = df.select(F.explode(to[F.col("key")]).alias("key"), *(c for c in df.columns if c != "key"))
    return args


def _parameters(name: str, cases: dict[str, dict]) -> dict:
    """What a driver is called with: a value, or a ``Choice`` where the cases' values differ; the driver's default where a case has none."""
    defaults = {k: p.default for k, p in signature(get_driver(name)).parameters.items()}
    out = {}
    for param in sorted({p for own in cases.values() for p in own}):
        choice = Choice({label: own.get(param, defaults.get(param)) for label, own in cases.items()})
        out[param] = choice if len(choice.values) > 1 else next(iter(choice.values.values()))[0]
    return out


def driver_table(fingerprints: list[dict]) -> list[tuple[str, int, str, float, str, dict, dict]]:
    """(instrument, driver_idx, name, weight, label, series, params) of the specifications' drivers; equal drivers have one label."""
    rows = []
    for f in fingerprints:
        for i, d in enumerate(f["drivers"]):
            series = {k: v for k, v in d.get("params", {}).items() if k in SOURCES}
            params = {k: v for k, v in d.get("params", {}).items() if k not in SOURCES and k != "tf"}
            label = "/".join([d["name"], *(f"{k}={v}" for k, v in sorted(series.items()) + sorted(params.items()))])
            rows.append((f["id"], i, d["name"], float(d.get("weight", 0.0)), label, series, params))
    return rows


def driver_frame(env: dict[str, DataFrame], fingerprints: list[dict], decisions: DataFrame) -> DataFrame:
    """(instrument, as_of, driver_idx, name, weight, ok, score, value) of all drivers at ``decisions`` (instrument, as_of).

    Drivers of one name are computed in one pass over all their series, whatever their parameters, and equal drivers of
    several instruments once, at all their dates. Those that depend on the rows of their series alone are brought to
    the dates in one as-of join. The dates are used by several drivers, so they are kept as a file.
    """
    table = driver_table(fingerprints)
    spec = decisions.sparkSession.createDataFrame([row[:5] for row in table], "instrument string, driver_idx int, name string, weight double, key string")
    mine = materialize(decisions.select("instrument", "as_of").distinct().join(F.broadcast(spec), "instrument"), "decisions")  # a row a driver of the specifications
    groups: dict[tuple, dict[str, tuple[dict, dict]]] = {}
    for *_, name, _, label, series, params in table:
        groups.setdefault((name, *sorted(series)), {})[label] = (series, params)
    rows, parts = [], []
    for (name, *_), cases in groups.items():
        args, params = _arguments(env, name, {k: s for k, (s, _) in cases.items()}), _parameters(name, {k: p for k, (_, p) in cases.items()})
        if name in BY_ROWS:
            rows.append(BY_ROWS[name](**args, **params))
        else:
            own = mine.filter(F.col("key").isin(list(cases)))
            got = get_driver(name)(own.select("key", "as_of").distinct(), **args, **params)
            parts.append(own.join(got, ["key", "as_of"]))
    if rows:
        own = mine.filter(F.col("name").isin(sorted({name for name, *_ in groups if name in BY_ROWS})))
        parts.append(at_probes(own, reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)))
    return reduce(DataFrame.unionByName, [p.select("instrument", "as_of", "driver_idx", "name", "weight", "ok", "score", "value") for p in parts])


def grade(score: Column, thresholds: dict[str, float] | None = None) -> tuple[Column, Column]:
    """(direction, grade) of a score; below the B limit it is neutral."""
    t, s = thresholds or THRESHOLDS, F.abs(score)
    side = F.when(s < t["B"], "NEUTRAL").when(score > 0, "LONG").otherwise("SHORT")
    return side, F.when(s < t["B"], "NONE").when(s >= t["A_plus"], "A+").when(s >= t["A"], "A").otherwise("B")


def aggregate(frame: DataFrame, method: str = "linear", gamma: float = 1.0) -> DataFrame:
    """(instrument, as_of, raw, score, n_ok, vector, drivers): the weighted mean of the drivers that have data.

    ``agreement`` damps it by how far the drivers pull one way. ``vector`` maps names to scores, the last of
    drivers with one name; ``drivers`` is the trace in the order of the specification.
    """
    ok, w, s = F.col("ok"), F.col("weight"), F.col("score")
    # Sums over sorted entries, so that the order of rows doesn't show in the last digits.
    entry = F.struct("driver_idx", "name", "weight", "ok", "score", "value")
    out = frame.groupBy("instrument", "as_of").agg(F.array_sort(F.collect_list(entry)).alias("drivers"))
    total = lambda f: F.aggregate(F.filter("drivers", lambda d: d["ok"]), F.lit(0.0), lambda a, d: a + f(d))
    out = out.withColumn("_ws", total(lambda d: d["weight"] * d["score"])).withColumn("_w", total(lambda d: d["weight"])).withColumn("_a", total(lambda d: d["weight"] * F.abs(d["score"])))
    raw = F.when(F.col("_w") != 0, F.col("_ws") / F.col("_w")).otherwise(0.0)
    if method == "agreement":
        raw = raw * F.when(F.col("_a") != 0, F.pow(F.abs("_ws") / F.col("_a"), F.lit(float(gamma)))).otherwise(1.0)
    last = F.aggregate(F.filter("drivers", lambda d: d["ok"]), F.create_map().cast("map<string,double>"), lambda m, d: F.map_concat(F.map_filter(m, lambda k, v: k != d["name"]), F.create_map(d["name"], d["score"])))
    return out.withColumn("raw", r(raw, 10)).select("instrument", "as_of", "raw", steady(F.col("raw")).alias("score"), F.size(F.filter("drivers", lambda d: d["ok"])).alias("n_ok"), last.alias("vector"), "drivers")


def score_instruments(env: dict[str, DataFrame], fingerprints: list[dict], decisions: DataFrame) -> DataFrame:
    """Scores with the direction and grade of each instrument's own limits and aggregation."""
    parts = []
    frame = driver_frame(env, fingerprints, decisions)
    styles: dict[tuple, list[dict]] = {}
    for f in fingerprints:
        a = f.get("aggregation", {})
        styles.setdefault((a.get("method", "linear"), float(a.get("gamma", 1.0)), tuple(sorted((f.get("grade_thresholds") or THRESHOLDS).items()))), []).append(f)
    for (method, gamma, limits), group in styles.items():
        out = aggregate(frame.filter(F.col("instrument").isin([f["id"] for f in group])), method, gamma)
        side, letter = grade(F.col("raw"), dict(limits))
        parts.append(out.withColumn("direction", side).withColumn("grade", letter))
    return reduce(DataFrame.unionByName, parts).drop("raw")


def explain(scored: DataFrame) -> DataFrame:
    """(instrument, as_of, trace): the score's trace as JSON."""
    shown = lambda d: F.struct(*(d[c].alias(c) for c in ("name", "ok", "score", "value", "weight")), r(d["weight"] * d["score"]).alias("contribution"))
    trace = F.struct("instrument", F.col("as_of").cast("string").alias("as_of"), "score", "direction", "grade", F.transform("drivers", shown).alias("drivers"))
    return scored.select("instrument", "as_of", F.to_json(trace).alias("trace"))
