"""Scores, bars, gates, levels, validation and scenarios on small cases."""

import datetime as dt
import json
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark import functions as fn
from tidemark.operators import bars as B
from tidemark.plans import panel, rules, scenario, score, setups, validation

D0 = dt.date(2018, 1, 1)


def day(i):
    return D0 + dt.timedelta(i)


def make_bars(spark, rows, key="S"):
    return spark.createDataFrame([(key, day(i), float(o), float(h), float(low), float(c), 1) for i, (o, h, low, c) in enumerate(rows)], "key string, d date, open double, high double, low double, close double, volume long")


def frame(spark, rows):
    return spark.createDataFrame([("X", D0, i, n, float(w), ok, float(s), None) for i, (n, w, ok, s) in enumerate(rows)], "instrument string, as_of date, driver_idx int, name string, weight double, ok boolean, score double, value double")


def test_missing_drivers_do_not_count(spark):
    r = score.aggregate(frame(spark, [("a", 0.5, True, 0.6), ("b", 0.5, False, 0.0), ("a", 0.25, True, -0.3)])).first()
    assert r.score == 0.3 and r.n_ok == 2 and r.vector == {"a": -0.3}
    assert score.aggregate(frame(spark, [("a", 1, False, 0)])).first().score == 0.0


def test_agreement(spark):
    mixed, same = [("a", 1, True, 0.6), ("b", 1, True, -0.3)], [("a", 1, True, 0.6), ("b", 1, True, 0.3)]
    linear = lambda rows, **k: score.aggregate(frame(spark, rows), **k).first().score
    assert linear(mixed) == 0.15 and linear(mixed, method="agreement") == 0.05 and linear(same, method="agreement") == linear(same)
    assert linear(mixed, method="agreement", gamma=0.0) == 0.15


def test_grades(spark):
    df = spark.createDataFrame([(x,) for x in (0.6, -0.6, 0.45, 0.3, -0.3, 0.2, 0.0)], "s double")
    assert [tuple(r) for r in df.select(*score.grade(F.col("s"))).collect()] == [("LONG", "A+"), ("SHORT", "A+"), ("LONG", "A"), ("LONG", "B"), ("SHORT", "B"), ("NEUTRAL", "NONE"), ("NEUTRAL", "NONE")]


def test_specs_are_checked():
    with pytest.raises(KeyError):
        score.validate_specs([{"id": "x", "ticker": "t", "drivers": [{"name": "nope"}]}])
    with pytest.raises(ValueError):
        score.validate_specs([{"id": "x", "drivers": []}])
    with pytest.raises(ValueError):
        score.validate_specs([{"id": "x", "ticker": "t", "drivers": [{"name": "momentum", "params": {"series": "lost"}}]}], {"there"})


def loop_barrier(rows, i, long, sl, tp, h, rr):
    entry, last = rows[i][3], min(i + h, len(rows) - 1)
    for j in range(i + 1, last + 1):
        _, hi, lo, _ = rows[j]
        if (lo <= entry - sl) if long else (hi >= entry + sl):
            return "SL", -1.0, j - i
        if (hi >= entry + tp) if long else (lo <= entry - tp):
            return "TP", rr, j - i
    move = rows[last][3] - entry
    return "TIME", (move if long else -move) / sl, last - i


def test_barriers_against_a_loop(spark):
    r = random.Random(3)
    rows, c = [], 100.0
    for _ in range(200):
        o, c = c, c + r.gauss(0, 1)
        rows.append((o, max(o, c) + r.random(), min(o, c) - r.random(), c))
    b = B.numbered(B.ahead(make_bars(spark, rows), 8)).withColumn("direction", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    for sl, tp in ((1.5, 2.0), (1.0, 6.0), (50.0, 60.0)):
        out = B.triple_barrier(b, F.lit(sl), F.lit(tp), F.lit(tp / sl)).collect()
        assert len(out) == 400
        for x in out:
            label, gain, held = loop_barrier(rows, x.rn - 1, x.direction == "LONG", sl, tp, 8, tp / sl)
            assert (x.label, x.held) == (label, held) and x.outcome_r == pytest.approx(gain)


def test_swap_is_paid_by_the_bar(spark):
    rows = [(100, 100.1, 99.9, 100)] * 10
    b = B.ahead(make_bars(spark, rows), 5).limit(1).withColumn("direction", F.lit("LONG"))
    x = B.triple_barrier(b, F.lit(2.0), F.lit(4.0), F.lit(2.0), F.lit(0.001)).first()
    assert x.label == "TIME" and x.outcome_r == pytest.approx(-0.001 * 100 * 5 / 2)


def test_outcomes_follow_each_instruments_rule(spark):
    """Carry, horizon and true-range window are the instrument's own."""
    r = random.Random(9)
    rows, c = [], 100.0
    for _ in range(120):
        o, c = c, c + r.gauss(0, 1)
        rows.append((o, max(o, c) + r.random(), min(o, c) - r.random(), c))
    bars = make_bars(spark, rows, "A").unionByName(make_bars(spark, rows, "B"))
    swap = {"long_cost_pct_per_day": 0.0003, "short_cost_pct_per_day": -0.0001}
    specs = [{"id": "a", "ticker": "A", "drivers": []}, {"id": "b", "ticker": "B", "drivers": [], "swap": swap, "base_rate": {"horizon_days": 4, "atr_window": 5}}]
    at = panel.decisions(bars, specs, first=30, step=3, horizon_days=9).withColumn("direction", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    out = panel.outcomes(at, 0.5, 0.8).collect()
    tr = [rows[0][1] - rows[0][2]] + [max(h - low, abs(h - p), abs(low - p)) for (_, h, low, _), (*_, p) in zip(rows[1:], rows, strict=False)]
    for key, h, w, costs in (("a", 9, 14, (0, 0)), ("b", 4, 5, (0.0003, -0.0001))):
        mine = [x for x in out if x.instrument == key]
        assert sorted({x.rn for x in mine}) == list(range(31, 120 - h + 1, 3))
        for x in mine:
            long, atr = x.direction == "LONG", sum(tr[x.rn - w : x.rn]) / w
            label, gain, held = loop_barrier(rows, x.rn - 1, long, 0.5 * atr, 0.8 * atr, h, 1.6)
            assert (x.label, x.held) == (label, held)
            assert x.outcome_r == pytest.approx(gain - costs[not long] * x.close * held / (0.5 * atr))


def test_rules_of_specifications():
    own = rules.rule({"id": "x", "ticker": "t", "base_rate": {"band": 0.2, "oos_start": dt.date(2020, 1, 1), "note": "none"}, "swap": {"long_cost_pct_per_day": 0.1}}, horizon_days=7, band=0.5)
    assert (own["band"], own["horizon_days"], own["oos_start"], own["swap_long"], own["swap_short"], own["min_effective_n"]) == (0.2, 7, "2020-01-01", 0.1, 0.0, 30)


def test_atr_and_fractals(spark):
    rows = [(0, 10 + i % 3, 5 - i % 2, 7 + i % 2) for i in range(20)]
    out = sorted(B.atr(make_bars(spark, rows), 5).collect(), key=lambda x: x.d)
    tr = [max(h - low, abs(h - p), abs(low - p)) for (_, h, low, _), p in zip(rows, [rows[0][2]] + [x[3] for x in rows[:-1]], strict=True)]
    tr[0] = rows[0][1] - rows[0][2]
    assert [x.atr for x in out[:4]] == [None] * 4 and out[10].atr == pytest.approx(sum(tr[6:11]) / 5)
    f = sorted(B.fractals(make_bars(spark, rows), 3).collect(), key=lambda x: x.d)
    assert not any(x.is_high for x in f[:3] + f[-3:]) and all(x.is_high == (rows[i][1] == 12) for i, x in enumerate(f[3:-3], 3))


def test_scale_glitches_are_repaired(spark):
    r = random.Random(5)
    closes = [2000 + r.gauss(0, 10) for _ in range(60)]
    rows = [(c, c + 1, c - 1, c) for c in closes]
    bad = [tuple(x * 0.1 for x in row) if 20 <= i < 40 and i % 2 else row for i, row in enumerate(rows)]
    got = sorted(B.repair_scales(make_bars(spark, bad)).collect(), key=lambda x: x.d)
    assert all(x.close == pytest.approx(c) for x, c in zip(got, closes, strict=True)) and sum(x.factor != 1 for x in got) == 10
    real = rows[:30] + [tuple(x * 0.92 for x in row) for row in rows[30:]]
    assert all(x.factor == 1 for x in B.repair_scales(make_bars(spark, real)).collect())


def test_intervals(spark):
    one = spark.range(1)
    lo, hi = one.select(*fn.wilson(F.lit(8), F.lit(10))).first()
    assert (lo, hi) == (pytest.approx(0.4902, abs=1e-4), pytest.approx(0.9433, abs=1e-4))
    assert tuple(one.select(*fn.wilson(F.lit(0), F.lit(0))).first()) == (0.0, 0.0)
    days = [0, 10, 29, 30, 59, 61, 100]
    got = one.select(fn.effective_n(F.array(*(F.lit(day(i)) for i in reversed(days))), 30)).first()[0]
    assert got == 4
    assert tuple(one.select(*fn.mean_interval(F.lit(1.0), F.lit(0.0), F.lit(1), F.lit(1))).first()) == (1.0, 1.0)


def panel_rows(spark, rows):
    return spark.createDataFrame([("X", day(i), i, float(s), d, float(o), h, oos, {"a": float(s)} | ({"b": 1.0} if i % 2 else {})) for i, s, d, o, h, oos in rows], "instrument string, as_of date, rn int, score double, direction string, outcome_r double, hit boolean, oos boolean, vector map<string,double>")


def test_gate(spark):
    train = panel_rows(spark, [(i * 30, 0.5 + 0.001 * (i % 20), "LONG", 2.0 if i % 10 else -1.0, bool(i % 10), False) for i in range(100)] + [(5, 0.5, "SHORT", -1, False, False), (6, 0.9, "LONG", -1, False, False)])
    now = panel_rows(spark, [(9000, 0.5, "LONG", 0, False, True), (9001, -0.5, "SHORT", 0, False, True), (9002, 0.61, "LONG", 0, False, True)])
    got = {r.as_of: r for r in panel.gate(now, train, band=0.1, horizon=30).collect()}
    a = got[day(9000)]
    assert a.passes and (a.n, a.n_eff, a.hit_rate) == (100, 100, 0.9) and a.expectancy_r == 1.7 and a.reason == "approved"
    assert got[day(9001)].n == 0 and not got[day(9001)].passes
    same = panel.gate(now.limit(1), train, band=0.1, horizon=30, match_coverage=True).first()
    assert same.n == 100  # even days have the one driver
    close = panel.gate(now.limit(1), train, band=0.1, horizon=300).first()
    assert close.n_eff == 10 and "too few" in close.reason


def test_limits_may_be_fields_of_the_rows(spark):
    train = panel_rows(spark, [(i * 30, 0.5 + 0.001 * (i % 20), "LONG", 2.0 if i % 10 else -1.0, bool(i % 10), False) for i in range(100)])
    now = panel_rows(spark, [(9000, 0.5, "LONG", 0, False, True)])
    with_rule = lambda df, **own: df.join(rules.table(spark, [{"id": "X", "ticker": "t", "base_rate": own}]).select("instrument", "rule"), "instrument")
    for own in ({}, {"band": 0.005, "min_effective_n": 10}, {"horizon_days": 300}, {"min_hit_rate_pct": 99.0}, {"match_coverage": True}):
        got = panel.gate(with_rule(now, **own), with_rule(train, **own), **rules.GATE).first()
        limits = {k.replace("horizon_days", "horizon"): v for k, v in own.items()}
        assert got == panel.gate(now, train, **limits).first()


@pytest.mark.parametrize("band", [0.1, 0.15, 0.22, 0.0])
def test_band_sums_equal_all_pairs(spark, band):
    """Also for scores right at the edges of the band, which differences of doubles put now inside, now outside."""
    r = random.Random(7)
    rows = [(i, round(r.choice([r.uniform(-1, 1), 0.01 * r.randint(-40, 40)]), 4), r.choice(["LONG", "SHORT"]), r.gauss(0, 1), r.random() < 0.5, i >= 150) for i in range(300)]
    p = panel_rows(spark, rows)
    near = lambda a: [b for b in rows if not b[5] and a[2] == b[2] and abs(a[1] - b[1]) <= band]
    got = {x.as_of: x for x in panel.band_sums(p.filter("oos"), p.filter("not oos"), band).collect()}
    assert len(got) == 150
    for a in rows[150:]:
        x, own = got[day(a[0])], near(a)
        assert (x.n, x.hits) == (len(own), sum(b[4] for b in own))
        assert (x.total, x.squares) == (pytest.approx(sum(b[3] for b in own), abs=1e-12), pytest.approx(sum(b[3] ** 2 for b in own), abs=1e-12))
    halves = {x.as_of: x.n for x in panel.band_sums(p, p, band, before=(F.col("rn") % 4, F.col("rn") % 4)).collect()}
    for a in rows:
        assert halves[day(a[0])] == sum(a[2] == b[2] and b[0] % 4 < a[0] % 4 and abs(a[1] - b[1]) <= band for b in rows)
    counted = {x.as_of: x.n_eff for x in panel.band_days(p.filter("oos"), p.filter("not oos"), band, 7).collect()}
    for a in rows[150:]:
        n, last = 0, None
        for d in sorted(b[0] for b in near(a)):
            if last is None or d - last >= 7:
                n, last = n + 1, d
        assert counted.get(day(a[0]), 0) == n


def test_gates_make_no_pairs(spark):
    p = panel_rows(spark, [(i, round(0.001 * (i % 900), 4), "LONG", 1.0, True, i % 2 == 0) for i in range(3000)])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = panel.gate(p.filter("oos"), p.filter("not oos"), band=0.5)
        rows.collect()
        metrics = rows._jdf.queryExecution().executedPlan()
        found, work = [], [metrics]
        while work:
            node = work.pop()
            work += [node.children().apply(i) for i in range(node.children().size())]
            if node.metrics().contains("numOutputRows"):
                found.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert rows.count() == 1500 and found and max(found) <= 3 * 3000  # pairs would be over a million


def test_levels(spark):
    row = lambda direction, highs, lows: spark.createDataFrame([("X", direction, 100.0, 2.0, highs, lows)], "instrument string, direction string, entry double, atr double, highs array<double>, lows array<double>")
    x = setups.with_levels(row("LONG", [100.2, 107.0], [95.0, 99.9])).first()
    assert x.tp == 107.0 and x.sl == pytest.approx(99.0) and x.rr == pytest.approx(7.0)  # the stop is half an ATR away at least
    x = setups.with_levels(row("LONG", [], [])).first()
    assert x.tp == 110.0 and x.sl == pytest.approx(90.0 - 0.5)  # round numbers
    x = setups.with_levels(row("SHORT", [103.0], [90.0])).first()
    assert x.tp == 90.0 and x.sl == pytest.approx(103.5)
    assert spark.range(1).select(setups.round_levels(F.lit(1234.0))).first()[0] == [900.0, 1000.0, 1100.0, 1200.0, 1300.0, 1400.0, 1500.0]


def test_payload(spark):
    rows = spark.createDataFrame([("a", False, 0.9), ("b", True, -0.3), ("c", True, 0.5)], "instrument string, published boolean, score double")
    text = setups.payload(rows, "2024-01-01", "now")
    assert [s["instrument"] for s in json.loads(text)["signals"]] == ["c", "b", "a"]
    assert not setups.changed(text, setups.payload(rows, "2024-01-01", "later")) and setups.changed(text, setups.payload(rows.limit(1), "2024-01-01", "now"))


def test_validation(spark):
    rows = [(i, 0.5 if i % 2 else -0.5, "LONG" if i % 2 else "SHORT", 1.0 if i % 2 else -1.0, bool(i % 2), i >= 800) for i in range(1000)]
    p = panel_rows(spark, rows)
    v = validation.validate(p, band=0.1, min_effective_n=10, horizon=1, min_hit_rate_pct=55.0, min_expectancy_r=0.3).first()
    assert (v.n_train, v.n_oos, v.n_predicted, v.sign_agreement, v.exp_when_pred_bull, v.exp_when_pred_bear) == (800, 200, 200, 1.0, 1.0, -1.0)
    assert v.n_gate_pass == 100 and v.gate_hit == 1.0
    assert v.driver_ic == {"a": (1.0, 200), "b": (0.0, 100)}  # of the tested rows; one value only has no variance
    ic = {r.driver: (r.ic, r.n) for r in validation.information_coefficients(p.filter("not oos")).collect()}
    assert ic == {"a": (1.0, 800), "b": (0.0, 400)}  # none tested: of all
    folds = {r.fold: r for r in validation.walk_forward(p, band=0.1, min_effective_n=10).collect()}
    assert set(folds) == {2019, 2020} and folds[2019].n_train == 365 and folds[2020].sign_agreement == 1.0
    less = validation.validate(p, band=0.1, min_effective_n=10, horizon=30, min_hit_rate_pct=55.0, min_expectancy_r=0.3, embargo=True).first()
    assert less.n_predicted == 200
    deltas = spark.createDataFrame([("a", 1.0, True), ("b", -4.0, False)], "instrument string, delta double, better boolean")
    assert tuple(validation.ablation_summary(deltas).first()) == (-1.5, 1, 2)


def test_pearson_guards(spark):
    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(4)], "x double, y double")
    assert df.agg(fn.pearson(F.col("x"), F.col("y"))).first()[0] == 0.0
    r = random.Random(1)
    pts = [(r.random(), r.random()) for _ in range(50)]
    got = spark.createDataFrame(pts, "x double, y double").agg(fn.pearson(F.col("x"), F.col("y"))).first()[0]
    assert got == pytest.approx(statistics.correlation(*zip(*pts, strict=True)))


def random_closes(spark, n=500, keys="a", seed=1, tail=()):
    r = np.random.default_rng(seed)
    rows = [(k, day(i), float(v)) for k in keys for i, v in enumerate(np.append(100 * np.exp(np.cumsum(r.normal(0, 0.01, n))), tail))]
    return spark.createDataFrame(rows, "key string, d date, v double").repartition(3)


def test_simulation(spark):
    closes = random_closes(spark)

    def steps(c, horizon=20):
        known = scenario.histories(c)
        at = known.filter("place = 498").select("key", F.col("d").alias("as_of"), "sigma", "n_pool", F.lit(horizon).alias("horizon"))
        return scenario.simulate(at, known, 300)

    a = {(x.path, x.step): x.shock for x in steps(closes).collect()}
    assert len(a) == 300 * 20
    # The same draws from other partitions, over a shorter horizon, and whatever comes later.
    assert {(x.path, x.step): x.shock for x in steps(closes.repartition(7), 12).collect()} == pytest.approx({k: v for k, v in a.items() if k[1] < 12})
    later = {(x.path, x.step): x.shock for x in steps(random_closes(spark, tail=[9.0] * 30)).collect()}
    assert later == pytest.approx(a)
    trade = lambda tp, sl, cost=0.0, side="LONG": spark.createDataFrame([("a", side, tp, sl, cost)], "key string, direction string, tp double, sl double, daily_cost double")
    run = lambda *t: scenario.barriers(closes, trade(*t)).first()
    out = run(0.03, 0.03)
    assert out.prob_tp + out.prob_sl + out.prob_time == pytest.approx(1) and abs(out.prob_tp - out.prob_sl) < 0.15 and out.exp_lo < out.expectancy_r < out.exp_hi
    assert run(0.01, 0.03).prob_tp > run(0.06, 0.03).prob_tp
    assert run(0.03, 0.03, 0.001).expectancy_r < out.expectancy_r
    c = scenario.cones(closes).first()
    assert c.p05 < c.p25 < c.median < c.p75 < c.p95
    with pytest.raises(Exception, match="distances must be positive"):
        run(0.0, 1.0)


def test_paths_meet_barriers_as_a_loop_says(spark):
    closes = random_closes(spark, seed=6)
    known = scenario.histories(closes)
    at = scenario.last_returns(known).withColumn("horizon", F.lit(20))
    paths = {}
    for x in scenario.simulate(at, known, 150).collect():
        paths.setdefault(x.path, {})[x.step] = x.shock
    for side, tp, sl, cost in (("LONG", 0.02, 0.03, 0.0005), ("SHORT", 0.04, 0.015, 0.0)):
        outcomes, labels = [], []
        for p in paths.values():
            level = np.expm1(np.cumsum([p[t] for t in range(20)])) * (1 if side == "LONG" else -1)
            label, held, gain = "TIME", 20, level[-1] / sl
            for t, v in enumerate(level):
                if v <= -sl or v >= tp:
                    label, held, gain = ("SL", t + 1, -1.0) if v <= -sl else ("TP", t + 1, tp / sl)
                    break
            outcomes.append(gain - cost * held / sl)
            labels.append(label)
        x = scenario.barriers(closes, spark.createDataFrame([("a", side, tp, sl, cost)], "key string, direction string, tp double, sl double, daily_cost double"), paths=150).first()
        assert (x.prob_tp, x.prob_sl) == pytest.approx((labels.count("TP") / 150, labels.count("SL") / 150), abs=1e-4)
        assert x.expectancy_r == pytest.approx(np.mean(outcomes), abs=1e-4)
        assert x.exp_hi - x.exp_lo == pytest.approx(2 * 1.96 * np.std(outcomes, ddof=1) / 150**0.5, abs=2e-4)


def test_blocks_are_runs_of_residuals(spark):
    at = spark.createDataFrame([("a", day(0), 0.01, 50, 20), ("b", day(0), 0.01, 3, 20)], "key string, as_of date, sigma double, n_pool int, horizon int")
    rows = scenario.islands(at, 2000).collect()
    lengths, n = {}, {}
    for x in rows:
        assert 0 <= x.start < x.n_pool and x.length > 0
        lengths[x.key, x.path] = lengths.get((x.key, x.path), 0) + x.length
        n[x.key] = n.get(x.key, 0) + 1
    assert len(lengths) == 4000 and set(lengths.values()) == {20}
    assert n["a"] / 2000 == pytest.approx(1 + 19 / 5, rel=0.03)  # a restart at one step in five
    starts = [x.start for x in rows if x.key == "a"]
    counts = np.bincount(starts, minlength=50)
    assert ((counts - len(starts) / 50) ** 2 / (len(starts) / 50)).sum() < 90  # chi-squared with 49 degrees, 0.9997


def plain_crps(x, y, legacy=False):
    return np.abs(x - y).mean() - (0.25 if legacy else 0.5) * np.abs(x[:, None] - x[None]).mean()


def test_crps_rewards_the_true_spread(spark):
    r = np.random.default_rng(3)
    rows, cases = [], []
    for i in range(200):
        y = r.normal()
        for scale in (0.6, 1.0, 1.6):
            rows += [(f"{scale} {i}", float(v)) for v in r.normal(0, scale, 100)]
            cases.append((f"{scale} {i}", float(y)))
    got = scenario.against_ensembles(spark.createDataFrame(rows, "k string, value double"), spark.createDataFrame(cases, "k string, value double"), "k").collect()
    mean = lambda s: np.mean([x.crps for x in got if x.k.startswith(s)])
    assert mean("1.0") < mean("0.6") and mean("1.0") < mean("1.6")


def test_scores_against_ensembles_of_other_rows(spark):
    r = random.Random(11)
    samples = [(k, round(r.gauss(0, 1), 1)) for k in "ab" for _ in range(40)] + [("a", None)]
    cases = [(k, i, round(r.gauss(0, 1), 1)) for k in "abc" for i in range(20)]
    got = scenario.against_ensembles(spark.createDataFrame(samples, "k string, value double"), spark.createDataFrame(cases, "k string, i int, value double"), "k").collect()
    assert len(got) == len(cases)
    for x in got:
        have = np.array([v for k, v in samples if k == x.k and v is not None])
        if x.k == "c":
            assert x.crps is None and x.pit is None
            continue
        assert x.crps == pytest.approx(plain_crps(have, x.value)) and x.crps_legacy == pytest.approx(plain_crps(have, x.value, True))
        assert x.pit == pytest.approx((have <= x.value).mean())


def test_models_and_routing(spark):
    r = np.random.default_rng(4)
    rows = [(k, day(i), float(v)) for k in "ab" for i, v in enumerate(100 * np.exp(np.cumsum(r.normal(0, 0.01, 700))))]
    closes = spark.createDataFrame(rows, "key string, d date, v double")
    ev = scenario.evaluate(closes, start=520, paths=50)
    assert ev.count() == 2 * 2 * len(range(520, 699 - 20, 20))
    figures = scenario.pit_deviation(ev)
    assert {x.n for x in figures.collect()} == {len(range(520, 679, 20))} and {x.winner for x in scenario.route(figures).collect()} <= {"fhs", "normal"}
    assert scenario.cones(closes).count() == 2
    calm = scenario.cones(closes, pool=np.full(50, 1e-6)).collect()
    assert all(abs(x.p95) < 1e-4 for x in calm)
    rates = scenario.scenario_rates(closes.select(F.col("key").alias("instrument"), "d", "v"), spark.createDataFrame([("a", "LONG", 0.03, 0.03, 0.0, 20), ("b", "SHORT", 0.02, 0.05, 0.001, 10), ("none", "LONG", 0.1, 0.1, 0.0, 5)], "instrument string, direction string, tp double, sl double, daily_cost double, horizon int"))
    found = {x.instrument: x for x in rates.collect()}
    assert set(found) == {"a", "b"} and all(x.prob_tp + x.prob_sl + x.prob_time == pytest.approx(1) and x.p05 < x.median < x.p95 for x in found.values())
    short = scenario.scenario_rates(closes.filter(F.col("d") < day(79)).select(F.col("key").alias("instrument"), "d", "v"), spark.createDataFrame([("a", "LONG", 0.03, 0.03, 0.0, 20)], "instrument string, direction string, tp double, sl double, daily_cost double, horizon int"))
    assert short.count() == 0
    routed = {x.key: x for x in scenario.routed_cones(closes, least_bars=600, paths=50).collect()}
    assert set(routed) == {"a", "b"} and all(x.used == x.winner and x.p05 < x.p95 for x in routed.values())
    assert scenario.routed_cones(closes, least_bars=701, paths=50).count() == 0

    def limited(v, horizon, n):
        assert len(v) == 100
        return np.zeros(n)

    scenario.register_model("own", limited, context=100)
    figures = scenario.pit_deviation(scenario.evaluate(closes, ("fhs", "own"), start=520, paths=50))
    assert {x.model for x in figures.collect()} == {"fhs", "own"}
    flat = closes.withColumn("v", F.when(F.col("d") == day(699), 100.25).otherwise(F.lit(100.0) + F.dayofyear("d") % 2))
    scenario.register_model("own", lambda v, horizon, n: np.zeros(n) if v[-1] != 100.25 else 1 / 0)  # the constant forecast wins, then fails
    x = scenario.routed_cones(flat, ("fhs", "own"), paths=50).first()
    assert (x.winner, x.used) == ("own", "fhs")
    del scenario.MODELS["own"]
    with pytest.raises(ValueError):
        scenario.register_model("fhs", limited)
    pits = spark.createDataFrame([("k", "m", (i + 0.5) / 10, 1.0) for i in range(10)] + [("u", "m", 1.0, 1.0)] * 10, "key string, model string, pit double, crps double")
    assert {x.key: x.pit_uniformity for x in scenario.pit_deviation(pits).collect()} == {"k": 0.0, "u": 1.8}
