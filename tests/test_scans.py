"""Scans over sliced series against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import asof, counts_at_most, last_rows_share, look_back, scans
from tidemark.plans import scenario


def day(i):
    return dt.date(2000, 1, 1) + dt.timedelta(days=i)


@pytest.fixture(scope="module")
def series(spark):
    r = random.Random(1)
    rows = []
    for key, n in (("long", 3000), ("short", 5), ("gappy", 400), ("one", 1)):
        at = 0
        for _ in range(n):
            at += r.choice([1, 1, 1, 2, 5]) if key != "gappy" else r.choice([1, 700])
            rows.append((key, day(at % 900_000), r.gauss(0, 1)))
    rows = sorted({(k, d): (k, d, v) for k, d, v in rows}.values())
    df = spark.createDataFrame(rows, "key string, d date, v double").repartition(5)
    return rows, scans.cut(df, F.unix_date("d"), 64)


def by_key(rows):
    out = {}
    for k, d, v in rows:
        out.setdefault(k, []).append((d, v))
    return {k: sorted(v) for k, v in out.items()}


def test_previous_and_running(spark, series):
    rows, df = series
    got = {(x.key, x.d): x for x in scans.running(scans.previous(df, "v", "p"), n=F.lit(1), s=F.col("v")).collect()}
    assert len(got) == len(rows)
    for k, xs in by_key(rows).items():
        total = 0.0
        for i, (d, v) in enumerate(xs):
            total += v
            x = got[k, d]
            assert x.p == (xs[i - 1][1] if i else None) and x.n == i + 1 and x.s == pytest.approx(total, abs=1e-9)


def test_decayed_levels_are_the_recursion(spark, series):
    rows, df = series
    starts = spark.createDataFrame([(k, float(i + 1)) for i, k in enumerate(by_key(rows))], "key string, start double")
    for decay in (0.94, 0.5, 1.0):
        got = {(x.key, x.d): x for x in scans.decayed(df, F.col("v") * F.col("v"), decay, starts).collect()}
        assert len(got) == len(rows)
        for i, (k, xs) in enumerate(by_key(rows).items()):
            level = i + 1.0
            for d, v in xs:
                assert got[k, d].before == pytest.approx(level, rel=1e-10)
                level = decay * level + v * v
                assert got[k, d].after == pytest.approx(level, rel=1e-10)


def test_a_single_series_spreads_over_tasks(spark, series):
    _, df = series
    one = df.filter("key = 'long'")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = scans.previous(one, "v", "p")
        used = len({x.i for x in out.select("p", F.spark_partition_id().alias("i")).collect()})
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert used > 1 and "_slice#" in plan.split("hashpartitioning(", 1)[1][:60]


def test_volatility_is_the_recursion(spark):
    r = np.random.default_rng(3)
    rows, want = [], {}
    for key, n in (("a", 1500), ("b", 12), ("flat", 30), ("flat short", 6)):
        v = np.exp(np.cumsum(r.normal(0, 0.01, n))) if key in "ab" else np.ones(n)
        x = np.diff(np.log(v))
        level = float(np.var(x[:20]))
        if len(x) < 20 and level == 0:
            level = 1e-8
        for i in range(n):
            rows.append((key, day(i), float(v[i])))
            if i:
                want[key, day(i)] = level**0.5
                level = 0.94 * level + 0.06 * x[i - 1] ** 2
        want[key, None] = level**0.5
    got = scenario.histories(spark.createDataFrame(rows, "key string, d date, v double").repartition(3)).collect()
    assert len(got) == len(want) - 4
    last = {}
    for x in got:
        assert x.sigma == pytest.approx(want[x.key, x.d], rel=1e-9, abs=1e-300)
        last[x.key] = max(last.get(x.key, (dt.date.min, 0)), (x.d, x.next_sigma))
    assert {k: v[1] for k, v in last.items()} == pytest.approx({k: want[k, None] for k in last}, rel=1e-9)


def test_sliced_asof_is_the_unsliced_one(spark):
    r = random.Random(4)
    base = dt.datetime(2001, 1, 1)
    for make, name in ((day, "date"), (lambda i: base + dt.timedelta(seconds=7 * i), "timestamp")):
        left = [(r.choice("ab"), make(r.randint(0, 3000)), i) for i in range(400)] + [("none", make(5), 400), ("a", make(0), 401), (None, make(50), 402)]
        right = sorted({(r.choice("ab"), r.randint(200, 2800)) for _ in range(60)})
        right = [(k, make(i), float(i)) for k, i in right] + [(None, make(40), 1.0)]
        a = spark.createDataFrame(left, f"key string, t {name}, i int").repartition(3)
        b = spark.createDataFrame(right, f"key string, d {name}, v double").repartition(2)
        for options in ({}, {"lag_days": 3, "max_age_days": 40}):
            plain = sorted((x.i, x.v) for x in asof(a, b, "t", "d", ["v"], **options).collect())
            for width in (1, 64, 100_000):
                assert sorted((x.i, x.v) for x in asof(a, b, "t", "d", ["v"], width=width, **options).collect()) == plain
        assert len(plain) == len(left)


def test_sliced_asof_spreads_one_key(spark):
    a = spark.createDataFrame([("k", day(i)) for i in range(3000)], "key string, t date")
    b = spark.createDataFrame([("k", day(i), float(i)) for i in range(0, 3000, 400)], "key string, d date, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = [len({x.p for x in asof(a, b, "t", "d", ["v"], width=w).select("v", F.spark_partition_id().alias("p")).collect()}) for w in (None, 128)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks[0] == 1 < tasks[1]


def test_counts_at_most(spark):
    r = random.Random(5)
    points = [(k, r.randint(0, 60), round(r.gauss(0, 1), 1)) for k in "abc" for _ in range({"a": 200, "b": 1, "c": 40}[k])]
    queries = [(k, i, r.randint(-1, 61), round(r.gauss(0, 1), 1)) for i, k in enumerate(r.choices("abcd", k=300))]
    got = {(x.key, x.id): x.n for x in counts_at_most(spark.createDataFrame(points, "key string, t int, v double").repartition(3), spark.createDataFrame(queries, "key string, id long, t int, v double")).collect()}
    for k, i, t, v in queries:
        assert got.get((k, i), 0) == sum(p[0] == k and p[1] <= t and p[2] <= v for p in points)


def test_look_backs_hold_no_arrays(spark, series):
    rows, df = series
    df = df.drop("_slice")
    probes = spark.createDataFrame([(k, day(i)) for k in ("long", "short", "gappy", "absent") for i in range(0, 9000, 311)], "key string, as_of date")
    shares = look_back(probes, df, 700)
    known = by_key(rows)
    for x in shares.collect():
        h = [v for d, v in known.get(x.key, []) if x.as_of - dt.timedelta(700) <= d <= x.as_of]
        assert (x.n, x.cur) == (len(h), h[-1] if h else None) and (x.share is None if not h else x.share == pytest.approx(sum(v <= h[-1] for v in h) / len(h)))
    holes = df.withColumn("v", F.when(F.dayofyear("d") % 3 != 0, F.col("v")))
    by_rows = last_rows_share(holes, 25)
    seen = {}
    for x in holes.orderBy("key", "d").collect():
        seen.setdefault(x.key, []).append((x.d, x.v))
    for x in by_rows.collect():
        at = [d for d, _ in seen[x.key]].index(x.d)
        h = [v for _, v in seen[x.key][max(0, at - 24) : at + 1] if v is not None]
        assert (x.n, x.cur) == (len(h), h[-1] if h else None) and (x.share is None if not h else x.share == pytest.approx(sum(v <= h[-1] for v in h) / len(h)))
    for df in (shares, by_rows):
        assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
