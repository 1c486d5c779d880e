"""The drivers' meaning on small series: direction, extremes, visibility, guards."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F
from tidemark.operators import asof, counts_at_most, look_back, seasonal_baseline
from tidemark.operators.cases import Choice
from tidemark.plans import drivers, score

D0 = dt.date(2015, 1, 1)


def day(i):
    return D0 + dt.timedelta(i)


@pytest.fixture(scope="module")
def series(spark):
    def make(values, key="k", step=1):
        return spark.createDataFrame([(key, day(i * step), float(v)) for i, v in enumerate(values) if v is not None], "key string, d date, v double")

    return make


@pytest.fixture(scope="module")
def probe(spark):
    def make(*days, key="k"):
        return spark.createDataFrame([(key, day(i)) for i in days], "key string, as_of date")

    return make


def scores(df):
    return {(r.as_of - D0).days: (r.ok, r.score) for r in df.collect()}


def test_registry():
    assert len(drivers.registered()) == 15
    with pytest.raises(KeyError):
        drivers.get_driver("nothing")
    with pytest.raises(ValueError):
        drivers.register("momentum")(lambda: None)


def test_level_percentile_ends_at_the_probe(series, probe):
    s = series(range(80))
    got = scores(drivers.level_percentile(probe(10, 40, 79, 85, 400), s, lookback_days=50))
    assert got[10] == (False, 0.0) and got[40] == (True, 1.0) and got[79] == (True, 1.0)
    assert got[85] == (True, 1.0) and got[400] == (False, 0.0)  # nothing left in the look-back
    low = scores(drivers.level_percentile(probe(40), s, lookback_days=50, bull_when="low"))
    assert low[40] == (True, -1.0)


def test_later_rows_change_nothing(series, probe):
    r = random.Random(1)
    v = [r.gauss(0, 1) for _ in range(400)]
    for name, kw in (("level_percentile", {}), ("momentum", {}), ("price_momentum", {}), ("price_vs_sma", {"window": 50}), ("etf_flow", {})):
        arg = {"level_percentile": "series", "momentum": "series", "etf_flow": "holdings"}.get(name, "closes")
        base = [100 + x for x in v]
        a = scores(drivers.get_driver(name)(probe(300), **{arg: series(base)}, **kw))
        b = scores(drivers.get_driver(name)(probe(300), **{arg: series(base[:301] + [9e9] * 99).repartition(3)}, **kw))
        assert a == b and a[300][0], name


def test_momentum_against_a_loop(series, probe):
    r = random.Random(2)
    v = [r.gauss(0, 1) for _ in range(120)]
    got = scores(drivers.momentum(probe(40, 41, 119), series(v), horizon_days=21))
    for t in (41, 119):
        c = [v[i] - v[i - 21] for i in range(21, t + 1)]
        assert got[t] == (True, pytest.approx(round(math.tanh(c[-1] / statistics.pstdev(c)), 4)))
    assert got[40] == (True, got[40][1]) and scores(drivers.momentum(probe(39), series(v)))[39] == (False, 0.0)


def test_cot_is_seen_after_release(spark, probe):
    rows = [("k", day(7 * i), 1000 + 100 * i, 500, 5000) for i in range(30)]
    cot = spark.createDataFrame(rows, "key string, d date, long_spec long, short_spec long, open_interest long")
    n = lambda t: scores(drivers.cot_spec_net_percentile(probe(t), cot, lookback_weeks=30))[t]
    assert n(7 * 19 + 2) == (False, 0.0) and n(7 * 19 + 3) == (True, 1.0)


def test_ratio_and_spread_are_carried_forward(series, probe):
    a, b = series([100 + i for i in range(60)]), series([50.0] + [None] * 29 + [25.0] + [None] * 29)
    out = asof(a, b.withColumnRenamed("v", "w"), "d", "d", ["w"]).collect()
    assert {(r.d - D0).days: r.w for r in out}[29] == 50.0 and {(r.d - D0).days: r.w for r in out}[30] == 25.0
    late = asof(a, b.withColumnRenamed("v", "w"), "d", "d", ["w"], lag_days=3, max_age_days=5).collect()
    at = {(r.d - D0).days: r.w for r in late}
    assert at[2] is None and at[3] == 50.0 and at[5] == 50.0 and at[6] is None
    full = series([50.0] * 60)
    assert scores(drivers.price_ratio(probe(59), a, full))[59][1] > 0.5 > scores(drivers.price_ratio(probe(59), a, full, bull_when="low"))[59][1]
    assert scores(drivers.series_spread_percentile(probe(59), a, full))[59] == (True, 1.0)
    assert scores(drivers.series_ratio(probe(59), a, full))[59][1] > 0.5
    assert scores(drivers.ethanol_parity(probe(59), full, a, series([5.0] * 60)))[59][1] > 0.5


def test_look_back_counts_and_shares(spark, series, probe):
    h = look_back(probe(9), series(range(10)), 4).first()
    assert (h.cur, h.n, h.share) == (9.0, 5, 1.0)
    points = series(range(10)).select("key", F.unix_date("d").alias("t"), "v").filter("v >= 5")
    below = counts_at_most(points, spark.createDataFrame([("k", 1, 2**30, 8.0)], "key string, id long, t int, v double")).first()
    assert below.n / h.n == pytest.approx(0.8)


def daily(spark, years=6, last=None, **columns):
    n = 365 * years
    rows = [("k", day(i), *(f(i) if last is None or i < n - last[0] else last[1][c] for c, f in columns.items())) for i in range(n)]
    return spark.createDataFrame(rows, "key string, d date, " + ", ".join(f"{c} double" for c in columns)), n - 1


def test_weather_drivers(spark, probe):
    wave = lambda i: 15 + 10 * math.cos(2 * math.pi * i / 365.25)
    noise = random.Random(4)
    dry, end = daily(spark, last=(30, {"precip": 0.0}), precip=lambda i: 6 + noise.gauss(0, 0.5))
    assert scores(drivers.rainfall_anomaly(probe(end), dry))[end][1] > 0.9
    month = day(end).month
    assert scores(drivers.rainfall_anomaly(probe(end), dry, active_months=[month % 12 + 1]))[end] == (True, 0.0)
    assert scores(drivers.rainfall_anomaly(probe(1000), dry))[1000] == (False, 0.0)
    cold, end = daily(spark, last=(14, {"tmax": -20.0, "tmin": -25.0}), tmax=lambda i: wave(i) + 5 + noise.gauss(0, 1), tmin=lambda i: wave(i) - 5)
    assert scores(drivers.degree_days_anomaly(probe(end), cold))[end][1] > 0.9
    assert scores(drivers.frost_anomaly(probe(end), cold.select("key", "d", "tmin")))[end][1] > 0.9
    cool, end = daily(spark, last=(5, {"tmin": 12.0}), tmin=lambda i: 20 + noise.gauss(0, 0.3))
    assert scores(drivers.frost_anomaly(probe(end), cool))[end] == (True, 0.0)  # odd, but not cold


def test_seasonal_anomaly_against_a_loop(series, probe):
    r = random.Random(6)
    v = [100 * math.sin(2 * math.pi * i / 365.25) + r.gauss(0, 5) for i in range(1500)] + [400.0]
    got = scores(drivers.seasonal_anomaly(probe(900, 1500, 200), series(v), lookback_days=1200, bull_when="low"))
    for t in (900, 1500):
        lo = max(0, t - 1200)
        doy = lambda i: day(i).timetuple().tm_yday
        base = [v[i] for i in range(lo, t - 29) if min(abs(doy(i) - doy(t)), 366 - abs(doy(i) - doy(t))) <= 10]
        z = (v[t] - statistics.fmean(base)) / statistics.pstdev(base)
        assert got[t] == (True, pytest.approx(round(-math.tanh(z), 4), abs=1e-4))
    assert got[200] == (False, 0.0)


def test_seasonal_baseline_leaves_out_the_last_rows(series):
    rows = {(r.d - D0).days: r for r in seasonal_baseline(series(range(800)), 2, 60).collect()}
    want = [i for i in range(740 - 60 + 1) if abs(day(i).timetuple().tm_yday - day(740).timetuple().tm_yday) <= 2]
    assert rows[740].n == len(want) and rows[740].mean == pytest.approx(statistics.fmean(want)) and rows[740].n_all == 741


def test_gamma(spark, probe):
    snap = spark.createDataFrame([("k", day(10), 100.0, 5.0, 110.0), ("k", day(30), 100.0, -5.0, 110.0), ("k", day(50), None, 1.0, 1.0)], "key string, d date, spot double, net_gex double, gamma_center double")
    got = scores(drivers.gamma_regime(probe(9, 10, 15, 16, 31, 51), snap))
    assert got[9] == got[16] == got[51] == (False, 0.0) and got[10] == got[15] == (True, round(math.tanh(0.8), 4)) and got[31] == (True, 0.0)


def test_option_names_and_signs(spark):
    df = spark.createDataFrame([("BTC-02MAR26-65000-C",), ("BTC-2mar26-65000.5-p",), ("nonsense",), ("A-99XXX26-1-C",)], "n string")
    e, k, c = drivers.parse_instrument(F.col("n"))
    got = [tuple(r) for r in df.select(e, k, c).collect()]
    assert got[0] == (dt.date(2026, 3, 2), 65000.0, "C") and got[1] == (dt.date(2026, 3, 2), 65000.5, "P") and got[2] == (None, None, None) and got[3][0] is None
    rows = [("k", day(0), 100.0, kind, oi, 50.0, 0.25, 100.0) for kind, oi in (("C", 10.0), ("P", 4.0), ("P", 0.0))]
    shape = "key string, d date, strike double, kind string, oi double, iv double, years double, spot double"
    s = drivers.gamma_snapshot(spark.createDataFrame(rows, shape)).first()
    assert s.net_gex > 0 and s.gamma_center == 100.0


def test_choices_of_parameters_equal_calls_of_their_own(series, probe):
    r = random.Random(4)
    walk = [100 + sum(r.gauss(0, 1) for _ in range(i % 7)) + i / 9 for i in range(420)]
    both = series(walk, "a").unionByName(series(walk, "b"))
    at = probe(250, 400, key="a").unionByName(probe(250, 400, key="b"))
    apart = {
        "momentum": ("series", "horizon_days", 5, 30), "price_momentum": ("closes", "horizon_days", 5, 30), "price_vs_sma": ("closes", "window", 20, 100),
        "etf_flow": ("holdings", "horizon_days", 10, 60), "level_percentile": ("series", "lookback_days", 40, 300), "seasonal_anomaly": ("series", "exclude_rows", 5, 50),
    }
    for name, (arg, param, one, other) in apart.items():
        fn = drivers.get_driver(name)
        got = {(x.key, x.as_of): (x.ok, x.score, x.value) for x in fn(at, **{arg: both}, **{param: Choice({"a": one, "b": other})}).collect()}
        want = {}
        for key, value in (("a", one), ("b", other)):
            own = fn(at.filter(F.col("key") == key), **{arg: both.filter(F.col("key") == key)}, **{param: value})
            want |= {(x.key, x.as_of): (x.ok, x.score, x.value) for x in own.collect()}
        assert got == want and len(got) == 4, name


def test_specifications_share_plans(spark, series):
    """Parameters of their own make no further passes, and a driver that two instruments share is computed once."""
    closes = series([100 + i % 17 + i / 5 for i in range(400)], "S")
    env = {"closes": closes, "macro": closes.withColumn("key", F.lit("M"))}
    momentum = lambda **p: {"name": "momentum", "weight": 1.0, "params": {"series": "M", **p}}
    specs = [
        {"id": "one", "ticker": "S", "drivers": [momentum(), {"name": "level_percentile", "weight": 0.5, "params": {"series": "M"}}]},
        {"id": "two", "ticker": "S", "drivers": [momentum(horizon_days=50, bull_when="low"), momentum(), momentum(horizon_days=50)]},
    ]
    at = spark.createDataFrame([(i, D0 + dt.timedelta(days=k)) for i in ("one", "two") for k in (60, 399)], "instrument string, as_of date")
    frame = score.driver_frame(env, specs, at)
    got = {(x.instrument, x.driver_idx, (x.as_of - D0).days): (x.ok, x.score) for x in frame.collect()}
    assert len(got) == 10 and got["one", 0, 399] == got["two", 1, 399] and got["one", 0, 60][0] and not got["two", 0, 60][0]
    assert got["two", 0, 399][1] == -got["two", 2, 399][1] != 0
    plans = [score.driver_frame(env, [s], at)._jdf.queryExecution().optimizedPlan().toString().count("Window [") for s in ({"id": "x", "ticker": "S", "drivers": d} for d in ([momentum()], [momentum(), momentum(horizon_days=50)]))]
    assert plans[0] == plans[1]


def test_rows_count_up_to_their_day_and_in_their_months(spark, probe):
    rows = spark.createDataFrame([("k", D0, True, 0.5, 1.0, D0 + dt.timedelta(days=3), [D0.month])], "key string, d date, ok boolean, score double, value double, until date, months array<int>")
    got = scores(drivers.at_probes(probe(0, 3, 4), rows))
    assert got == {0: (True, 0.5), 3: (True, 0.5), 4: (False, 0.0)}
    late = rows.withColumn("until", F.lit(None).cast("date"))
    assert scores(drivers.at_probes(probe(0, 45), late)) == {0: (True, 0.5), 45: (True, 0.0)}
    assert scores(drivers.at_probes(probe(45), late.withColumn("months", F.lit(None).cast("array<int>")))) == {45: (True, 0.5)}
