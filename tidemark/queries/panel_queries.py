"""Panels, gates, setups, validation and scenarios of the proxy instruments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prob_up, quantile_columns, r, steady
from ..operators.bars import ahead, atr, numbered, repair_scales, triple_barrier
from ..plans import panel as panels
from ..plans import rules, scenario, setups, validation
from ..sources import proxies as P
from ..sources.shared import materialize
from .score_queries import FINGERPRINTS, GRADE, IDS, LAST, LIMITS, VIEWS, environment, scores_sql

H, FIRST, STEP, OOS = 30, 220, 10, LIMITS["oos_start"]

ATR = """bars AS MATERIALIZED (
    SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY key) AS n_bars,
        CASE WHEN row_number() OVER w >= 14 THEN avg(tr) OVER (PARTITION BY key ORDER BY d ROWS 13 PRECEDING) END AS atr,
        CASE WHEN row_number() OVER w >= 10 THEN avg(tr) OVER (PARTITION BY key ORDER BY d ROWS 9 PRECEDING) END AS atr10
    FROM (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w0), 0), coalesce(abs(low - lag(close) OVER w0), 0)) AS tr
        FROM prices WINDOW w0 AS (PARTITION BY key ORDER BY d)) WINDOW w AS (PARTITION BY key ORDER BY d))"""
CARRY = "CASE WHEN direction = 'LONG' THEN carry_long ELSE carry_short END * close * held / sl"


def barrier_sql(source: str, sl: str, tp: str, carry: str = CARRY) -> str:
    """CTE ``out``: label, held and outcome_r of ``source`` (instrument, key, rn, close, atr, direction, h ...)."""
    hit = lambda down, at: f"""(SELECT min(b.rn) FROM bars b WHERE b.key = s.key AND b.rn > s.rn AND b.rn <= s.rn + s.h
    AND CASE WHEN s.direction = '{down}' THEN b.low <= s.close - {at} ELSE b.high >= s.close + {at} END) - s.rn"""  # noqa: E731
    return f"""hits AS (SELECT s.*, {sl} AS sl, {tp} AS tp, {hit('LONG', sl)} AS t_sl, {hit('SHORT', tp)} AS t_tp FROM {source} s),
ends AS (SELECT h.*, least(h.rn + h.h, n.n) AS last_rn FROM hits h JOIN (SELECT key, max(rn) AS n FROM bars GROUP BY 1) n USING (key)),
labelled AS (SELECT e.*, b.close AS last_close,
    CASE WHEN t_sl IS NOT NULL AND (t_tp IS NULL OR t_sl <= t_tp) THEN 'SL' WHEN t_tp IS NOT NULL THEN 'TP' ELSE 'TIME' END AS label
    FROM ends e JOIN bars b ON b.key = e.key AND b.rn = e.last_rn),
held AS (SELECT *, CAST(CASE label WHEN 'SL' THEN t_sl WHEN 'TP' THEN t_tp ELSE last_rn - rn END AS INTEGER) AS held FROM labelled),
out AS MATERIALIZED (SELECT *, CASE label WHEN 'SL' THEN -1.0 WHEN 'TP' THEN tp / sl
    ELSE CASE WHEN direction = 'LONG' THEN last_close - close ELSE close - last_close END / sl END - {carry} AS outcome_r, label = 'TP' AS hit FROM held)"""


DECISIONS = f"""{ATR}, decided AS MATERIALIZED (
    SELECT * EXCLUDE (atr), CASE WHEN atr_w = 10 THEN atr10 ELSE atr END AS atr, d AS as_of FROM bars JOIN {IDS} USING (key)
    WHERE rn - 1 >= {FIRST} AND (rn - 1 - {FIRST}) % {STEP} = 0 AND rn <= n_bars - h AND CASE WHEN atr_w = 10 THEN atr10 ELSE atr END > 0),
decisions AS (SELECT instrument, as_of FROM decided)"""


def panel_sql(fingerprints=FINGERPRINTS) -> str:
    return f"""{DECISIONS}, {scores_sql(fingerprints)}, panel AS MATERIALIZED (
    SELECT d.*, s.score, s.n_ok, CASE WHEN s.score >= 0 THEN 'LONG' ELSE 'SHORT' END AS direction, d.as_of >= DATE '{OOS}' AS oos
    FROM decided d JOIN scores s USING (instrument, as_of) WHERE s.n_ok > 0)"""


def outcome_sql(fingerprints=FINGERPRINTS) -> str:
    return panel_sql(fingerprints) + ", " + barrier_sql("panel", "1.0 * s.atr", "2.0 * s.atr")


#: Base rates of current rows ``cur`` from ``train`` with greedy counting of days a horizon apart.
GATE = """pairs AS MATERIALIZED (
    SELECT c.instrument, c.as_of, t.as_of AS day, t.outcome_r, t.hit FROM cur c
    JOIN train t ON t.instrument = c.instrument AND t.direction = c.direction AND abs(t.score - c.score) <= c.band),
days AS (SELECT instrument, as_of, any_value(h) AS h, list(DISTINCT day ORDER BY day) AS ds FROM pairs JOIN (SELECT DISTINCT instrument, h
    FROM cur) USING (instrument) GROUP BY 1, 2),
eff AS (SELECT instrument, as_of, list_reduce(list_transform(ds, lambda x: {'n': 0, 'last': x}), lambda a, x: CASE WHEN x.last - a.last >= h THEN {'n': a.n + 1,
    'last': x.last} ELSE a END, {'n': 1, 'last': ds[1]}).n AS n_eff FROM days),
agg AS (SELECT c.instrument, c.as_of, any_value(least) AS least_n, any_value(min_hit) AS min_hit, any_value(min_exp) AS min_exp, count(p.outcome_r) AS n,
    any_value(coalesce(e.n_eff, 0)) AS n_eff,
    coalesce(avg(p.hit::INT), 0) AS hr, coalesce(avg(p.outcome_r), 0) AS mean, coalesce(var_samp(p.outcome_r), 0) AS var
    FROM cur c LEFT JOIN pairs p USING (instrument, as_of) LEFT JOIN eff e USING (instrument, as_of) GROUP BY 1, 2),
ci AS (SELECT *, nullif(n_eff::DOUBLE, 0) AS m, CASE WHEN n > 1 THEN 1.96 * sqrt(var / CASE WHEN n_eff > 1 THEN n_eff ELSE n END) ELSE 0 END AS half FROM agg),
wil AS (SELECT *, (hr + 1.96 * 1.96 / (2 * m)) / (1 + 1.96 * 1.96 / m) AS mid,
    1.96 * sqrt(hr * (1 - hr) / m + 1.96 * 1.96 / (4 * m * m)) / (1 + 1.96 * 1.96 / m) AS wide FROM ci),
lim AS (SELECT *, coalesce(greatest(0, mid - wide), 0) AS lo, CASE WHEN m IS NULL THEN 0 ELSE least(1, mid + wide) END AS hi FROM wil),
rate AS MATERIALIZED (
    SELECT instrument, as_of, n, n_eff::INTEGER AS n_eff, round_even(hr, 4) + 0.0 AS hit_rate, round_even(lo, 4) + 0.0 AS hit_lo, round_even(hi, 4) + 0.0 AS hit_hi,
        round_even(mean, 4) + 0.0 AS expectancy_r, round_even(mean - half, 4) + 0.0 AS exp_lo, round_even(mean + half, 4) + 0.0 AS exp_hi,
        CASE WHEN n = 0 THEN 'no neighbours in the band' ELSE concat_ws('; ', CASE WHEN n_eff < least_n THEN 'too few independent neighbours' END,
    CASE WHEN lo * 100 < min_hit THEN 'hit rate' END,
            CASE WHEN mean < min_exp THEN 'expectancy' END, CASE WHEN mean - half <= 0 THEN 'expectancy interval' END) END AS why FROM lim)"""
RATE = "instrument, as_of, n, n_eff, hit_rate, hit_lo, hit_hi, expectancy_r, exp_lo, exp_hi, CASE WHEN why = '' THEN 'approved' ELSE why END AS reason, why = '' AS passes"
SPLIT = "train AS (SELECT * FROM out WHERE NOT oos), cur AS (SELECT * FROM out WHERE oos)"


def _scored(spark, sf_dir, fingerprints=FINGERPRINTS, env=None):
    """The scored panel is the dear part and used in several branches: it is computed once and kept as files."""
    env = environment(spark, sf_dir) if env is None else env
    return materialize(panels.scored_panel(env, env["bars"], fingerprints, FIRST, STEP, **LIMITS), "panel")


def _panel(spark, sf_dir, fingerprints=FINGERPRINTS, env=None):
    return panels.outcomes(_scored(spark, sf_dir, fingerprints, env))


def triple_barriers(spark, sf_dir):
    """Both directions at every bar, also near the end of the history."""
    b = numbered(ahead(atr(P.prices(spark, sf_dir)), H)).filter(F.col("atr").isNotNull() & (F.col("rn") < F.col("n_bars")))
    b = b.select("key", "d", "rn", "close", "atr", "f", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("direction"))
    out = triple_barrier(b, 0.4 * F.col("atr"), 0.6 * F.col("atr"), F.lit(1.5))
    return out.select(F.col("key").alias("symbol"), "d", "direction", "label", "held", r(F.col("outcome_r"), 6).alias("outcome_r"))


def panel_outcomes(spark, sf_dir):
    return _panel(spark, sf_dir).select("instrument", "as_of", "score", "direction", "oos", "label", "held", r(F.col("outcome_r"), 6).alias("outcome_r"), "hit")


def swap_cost_query(spark, sf_dir):
    """What carry takes off the outcome of every decision."""
    rows = _scored(spark, sf_dir)
    free = rows.withColumn("rule", F.col("rule").withField("swap_long", F.lit(0.0)).withField("swap_short", F.lit(0.0)))
    paid, gross = (panels.outcomes(x).select("instrument", "as_of", "direction", "held", "outcome_r") for x in (rows, free))
    both = paid.join(gross.select("instrument", "as_of", F.col("outcome_r").alias("gross_r")), ["instrument", "as_of"])
    return both.select("instrument", "as_of", "direction", "held", r(F.col("gross_r"), 6).alias("gross_r"), r(F.col("outcome_r"), 6).alias("outcome_r"))


def gate_neighbors(spark, sf_dir):
    p = _panel(spark, sf_dir)
    sums = panels.band_sums(p.filter("oos"), p.filter("not oos"), "rule.band")
    return sums.select("instrument", "as_of", "n", r(F.coalesce(panels.mean_of(), F.lit(0.0)), 6).alias("mean_r"))


def gate_full(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return panels.gate(p.filter("oos"), p.filter("not oos"), **rules.GATE)


def gate_wilson(spark, sf_dir):
    from ..functions import wilson

    n = P.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("k"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return n.select("user_id", "n", "k", r(lo, 8).alias("lo"), r(hi, 8).alias("hi"))


def _setups(spark, sf_dir, simulated=False, fingerprints=FINGERPRINTS):
    env = environment(spark, sf_dir)
    return setups.build_setups(env, env["bars"], fingerprints, _scored(spark, sf_dir, fingerprints, env), simulated=simulated, **LIMITS)


def levels(spark, sf_dir):
    now = setups.latest(P.prices(spark, sf_dir), FINGERPRINTS)
    both = now.withColumn("direction", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))
    return setups.with_levels(both).select("instrument", "direction", *(r(F.col(c)).alias(c) for c in ("entry", "sl", "tp", "rr")))


def setups_query(spark, sf_dir):
    return _setups(spark, sf_dir).drop("drivers", *setups._SIMULATED)


def setups_simulated(spark, sf_dir):
    """The same with chances and quantiles by simulation, which gate one of the instruments."""
    other = [f | {"base_rate": f.get("base_rate", {}) | ({"engine": "scenario"} if f["id"] == "OPN" else {})} for f in FINGERPRINTS]
    return _setups(spark, sf_dir, True, other).drop("drivers")


def publish_order(spark, sf_dir):
    return setups.publish_order(_setups(spark, sf_dir)).select("position", "instrument", "published", "score")


def driver_ic(spark, sf_dir):
    return validation.information_coefficients(_panel(spark, sf_dir))


def driver_return_ic(spark, sf_dir):
    """Each driver's scores against the close's plain return."""
    return validation.information_coefficients(_panel(spark, sf_dir), "forward_return")


def validate_ic(spark, sf_dir):
    """The coefficients that a validation reports, a row each."""
    found = validation.validate(_panel(spark, sf_dir)).select("instrument", F.explode("driver_ic").alias("driver", "x"))
    return found.select("instrument", "driver", "x.ic", "x.n")


def validate_oos(spark, sf_dir):
    return validation.validate(_panel(spark, sf_dir)).drop("driver_ic")


def walk_forward(spark, sf_dir):
    return validation.walk_forward(_panel(spark, sf_dir))


def _ablation(spark, sf_dir):
    env, less = environment(spark, sf_dir), validation.without_driver(FINGERPRINTS, "level_percentile")
    full, reduced = (validation.validate(_panel(spark, sf_dir, f, env)) for f in (FINGERPRINTS, less))
    return validation.ablation(full, reduced)


def ablation(spark, sf_dir):
    return _ablation(spark, sf_dir)


def ablation_summary(spark, sf_dir):
    return validation.ablation_summary(_ablation(spark, sf_dir))


def _scores(spark, sf_dir):
    """Every event's value against all values of its user."""
    e = P.table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value")
    return scenario.against_ensembles(e, e, "user_id")


def crps_ensemble(spark, sf_dir):
    return _scores(spark, sf_dir).select("event_id", steady(F.col("crps"), 6).alias("crps"), steady(F.col("crps_legacy"), 6).alias("crps_legacy"), r(F.col("pit"), 6).alias("pit"))


def pit_hist(spark, sf_dir):
    return scenario.pit_deviation(_scores(spark, sf_dir), ("event_type",))


def quantile_cone(spark, sf_dir):
    e = P.table(spark, sf_dir, "events").groupBy("event_type")
    return e.agg(*quantile_columns(F.col("value"), 6), prob_up(F.col("value"), above=50), r(F.avg("value")).alias("expected"))


def ewma_vol(spark, sf_dir):
    """The next day's conditional volatility of each symbol."""
    known = scenario.histories(P.closes(spark, sf_dir))
    return known.groupBy(F.col("key").alias("symbol")).agg(F.count("*").cast("int").alias("n"), r(F.max_by("next_sigma", "d"), 8).alias("next_volatility"))


def clean_glitches(spark, sf_dir):
    """Bars of days whose day of the year is a multiple of 37 scaled by a thousandth, then repaired."""
    b = P.prices(spark, sf_dir)
    off = F.when(F.dayofyear("d") % 37 == 0, 0.001).otherwise(1.0)
    smooth = b.select("key", "d", *((150_000 + F.col(c) / 100).alias(c) * off for c in ("open", "high", "low", "close")), F.col("volume")).toDF(*b.columns)
    return repair_scales(smooth).filter("factor <> 1").select(F.col("key").alias("symbol"), "d", r(F.col("close"), 4).alias("close"), "factor")


def fhs_cone(spark, sf_dir):
    return scenario.cones(P.closes(spark, sf_dir))


def fhs_barrier(spark, sf_dir):
    keys = P.closes(spark, sf_dir).select("key").distinct()
    trades = keys.select("key", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))).alias("direction"), F.lit(0.3).alias("tp"), F.lit(0.2).alias("sl"), F.lit(0.0001).alias("daily_cost"))
    return scenario.barriers(P.closes(spark, sf_dir), trades)


def routed_cones(spark, sf_dir):
    """The forecast of each symbol's best model."""
    return scenario.routed_cones(P.closes(spark, sf_dir), least_bars=400, start=300, paths=100)


def model_scores(spark, sf_dir):
    return scenario.pit_deviation(scenario.evaluate(P.closes(spark, sf_dir), start=300, paths=100))


def route_models(spark, sf_dir):
    return scenario.route(scenario.pit_deviation(scenario.evaluate(P.closes(spark, sf_dir), start=300, paths=100)))


QUERIES = {
    "triple_barrier": triple_barriers, "panel_outcomes": panel_outcomes, "swap_cost": swap_cost_query, "gate_neighbors": gate_neighbors, "gate_wilson": gate_wilson, "gate_full": gate_full,
    "levels": levels, "setups": setups_query, "setups_simulated": setups_simulated, "publish_order": publish_order, "driver_ic": driver_ic, "driver_return_ic": driver_return_ic, "validate_ic": validate_ic, "validate_oos": validate_oos, "walk_forward": walk_forward, "ablation": ablation, "ablation_summary": ablation_summary,
    "crps_ensemble": crps_ensemble, "pit_hist": pit_hist, "quantile_cone": quantile_cone, "ewma_vol": ewma_vol, "clean_glitches": clean_glitches, "fhs_cone": fhs_cone,
    "fhs_barrier": fhs_barrier, "model_scores": model_scores, "route_models": route_models, "routed_cones": routed_cones,
}

FIGURES = "count(predicted) AS n_predicted, round_even(coalesce(avg(((predicted > 0) = (actual > 0))::INT), 0), 4) + 0.0 AS sign_agreement, round_even(coalesce(avg(actual) FILTER (predicted > 0), 0), 4) + 0.0 AS exp_when_pred_bull"
PREDICT = f"""pred AS MATERIALIZED (SELECT c.instrument, c.as_of, any_value(c.outcome_r) AS actual, avg(t.outcome_r) AS predicted
    FROM {{rows}} c JOIN {{train}} t ON t.instrument = c.instrument AND t.direction = c.direction AND abs(t.score - c.score) <= c.band {{more}}
    GROUP BY 1, 2 HAVING count(*) >= any_value(c.least))"""


def _validated(fingerprints, name: str, limits: tuple) -> str:
    """A query for the sign agreement of a panel."""
    return "(" + "WITH " + outcome_sql(fingerprints) + ", " + SPLIT + ", " + PREDICT.format(rows="cur", train="train", more="") + f""" SELECT i.instrument, coalesce(f.sign_agreement, 0) AS sign_agreement FROM (SELECT DISTINCT instrument FROM out) i LEFT JOIN (SELECT instrument, {FIGURES}
    FROM pred GROUP BY 1) f USING (instrument))"""


ABLATION = f"""full_run AS (SELECT * FROM {_validated(FINGERPRINTS, 'a', ())}),
less_run AS (SELECT * FROM {_validated(validation.without_driver(FINGERPRINTS, 'level_percentile'), 'b', ())}),
ablated_runs AS (SELECT instrument, a.sign_agreement AS base, b.sign_agreement AS ablated, round_even(100 * (b.sign_agreement - a.sign_agreement), 2) + 0.0 AS delta,
    b.sign_agreement > a.sign_agreement AS better FROM full_run a JOIN less_run b USING (instrument))"""

#: Bars put right one after the other, each beside the repaired closes before it.
GLITCHES = """off AS (SELECT key, d, (150000 + close / 100) * CASE WHEN dayofyear(d) % 37 = 0 THEN 0.001::DOUBLE ELSE 1 END AS close,
    row_number() OVER (PARTITION BY key ORDER BY d) AS rn FROM prices),
walk AS (
    SELECT key, d, close, rn, 1.0::DOUBLE AS factor, [close] AS recent FROM off WHERE rn = 1
    UNION ALL
    SELECT key, d, close, rn, factor, list_append(recent, close * factor)[-15:] FROM (
        SELECT key, d, close, rn, recent,
    CASE WHEN len(known) >= 3 AND close > 0 AND abs(close - mid) > 0.5 * mid AND abs(close * power - mid) <= 0.5 * mid THEN power ELSE 1 END AS factor FROM (
            SELECT *, pow(10.0, greatest(-3, least(3, round_even(log10(mid / close), 0)))) AS power FROM (
                SELECT *, list_aggregate(known, 'median') AS mid FROM (
                    SELECT o.key, o.d, o.close, o.rn, w.recent, list_filter(w.recent, lambda x: x > 0) AS known
    FROM walk w JOIN off o ON o.key = w.key AND o.rn = w.rn + 1)))))
SELECT key AS symbol, d, round_even(close * factor, 4) + 0.0 AS close, factor FROM walk WHERE factor <> 1"""

#: Last bars with sorted swings and round numbers.
LEVELS = f"""fr AS (SELECT *, high = max(high) OVER c AND count(*) OVER c = 7 AS is_high, low = min(low) OVER c AND count(*) OVER c = 7 AS is_low
    FROM bars WINDOW c AS (PARTITION BY key ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
now AS MATERIALIZED (SELECT i.instrument, key, any_value(h) AS h, any_value(band) AS band, any_value(least) AS least, any_value(min_hit) AS min_hit,
    any_value(min_exp) AS min_exp, max(n_bars) AS n_bars, max(d) AS as_of, min(d) AS first_day, arg_max(close, rn) AS entry, arg_max(atr, rn) AS atr,
    coalesce(list(high) FILTER (is_high AND rn > n_bars - 177 AND rn <= n_bars - 3), []) AS highs,
    coalesce(list(low) FILTER (is_low AND rn > n_bars - 177 AND rn <= n_bars - 3), []) AS lows
    FROM (SELECT * EXCLUDE (atr), CASE WHEN atr_w = 10 THEN atr10 ELSE atr END AS atr FROM fr JOIN {IDS} USING (key)) i GROUP BY 1, 2 HAVING max(n_bars) >= 180),
stepped AS (SELECT *, pow(10.0, floor(log10(entry)) - 1) AS step FROM now),
rounded AS (SELECT *, list_transform(range(-3, 4), lambda k: round_even((round_even(entry / step, 0) + k) * step, 10)) AS rounds FROM stepped)"""


def near_sql(swings: str, above: bool, ref: str) -> str:
    f, op = ("list_min", ">") if above else ("list_max", "<")
    return f"coalesce({f}(list_filter({swings}, lambda z: z {op} {ref})), {f}(list_filter(rounds, lambda z: z {op} {ref})))"


PLACED = f"""placed AS (SELECT *, CASE WHEN direction = 'LONG' THEN coalesce({near_sql('highs', True, 'entry + 0.3 * atr')}, entry + 2 * atr) ELSE coalesce({near_sql('lows',
    False, 'entry - 0.3 * atr')}, entry - 2 * atr) END AS tp,
    CASE WHEN direction = 'LONG' THEN least(coalesce({near_sql('lows', False, 'entry')} - 0.25 * atr, entry - atr),
    entry - 0.5 * atr) ELSE greatest(coalesce({near_sql('highs', True, 'entry')} + 0.25 * atr, entry + atr), entry + 0.5 * atr) END AS sl FROM sided),
ratioed AS MATERIALIZED (SELECT *, abs(entry - sl) AS risk, CASE WHEN direction = 'LONG' THEN tp - entry ELSE entry - tp END AS reward, reward / risk AS rr FROM placed)"""

SETUPS = (
    f"""{panel_sql()}, {LEVELS}, now_decisions AS (SELECT instrument, as_of FROM now),
now_scores AS MATERIALIZED (SELECT * FROM (WITH {LAST}, {scores_sql(name='final')} SELECT * FROM final)),
sided AS (SELECT r.*, s.score, s.raw, CASE WHEN s.score >= 0 THEN 'LONG' ELSE 'SHORT' END AS direction
    FROM rounded r JOIN now_scores s USING (instrument, as_of)), {PLACED}, """
    + f"""mine AS (SELECT p.*, t.risk / t.atr AS sl_m, t.reward / t.atr AS tp_m FROM panel p JOIN ratioed t USING (instrument) WHERE NOT p.oos AND p.rn + p.h <= t.n_bars), """ + barrier_sql("mine", "s.sl_m * s.atr", "s.tp_m * s.atr")
    + f", train AS (SELECT * FROM out), cur AS (SELECT * FROM ratioed), {GATE}, "
    + f"graded AS (SELECT *, {GRADE.replace('AS direction', 'AS side')} FROM ratioed), "
    + "{more}final_rows AS (SELECT g.instrument, g.key AS ticker, g.as_of, g.direction, g.grade, g.score, round_even(entry, 6) AS entry, round_even(sl, 6) AS sl, round_even(tp, 6) AS tp,"
    + """ round_even(atr, 6) AS atr, round_even(rr, 3) AS rr, r.n, r.n_eff, r.hit_rate, r.expectancy_r, {columns}
    concat_ws('; ', CASE WHEN grade = 'NONE' THEN 'no grade' END, CASE WHEN rr < 1.5 THEN 'reward to risk' END, {why}) AS reject_reason,
    CASE WHEN (g.as_of - first_day) / 365.25 >= 7 THEN 'ok' ELSE 'short history' END AS data_quality, round_even((g.as_of - first_day) / 365.25,
    1) AS history_years FROM graded g JOIN rate r USING (instrument, as_of) {join})"""
)
BY_RATE = "CASE WHEN r.why <> '' THEN 'base rate: ' || r.why END"


def _setups_sql(more: str = "", columns: str = "", why: str = BY_RATE, join: str = "") -> str:
    out = SETUPS
    for name, value in (("more", more), ("columns", columns), ("why", why), ("join", join)):
        out = out.replace("{" + name + "}", value)
    return out


#: Returns, volatilities and residuals of each series.
HISTORY = """logs AS (SELECT key, d, ln(v) - ln(lag(v) OVER (PARTITION BY key ORDER BY d)) AS x FROM closes),
placed_returns AS (SELECT key, d, x, row_number() OVER (PARTITION BY key ORDER BY d) - 1 AS place, count(*) OVER (PARTITION BY key) AS n_returns FROM logs WHERE x IS NOT NULL),
starts AS (SELECT key, CASE WHEN count(*) < 20 AND var_pop(x) = 0 THEN 1e-8 ELSE var_pop(x) END AS v0 FROM placed_returns WHERE place < 20 GROUP BY 1),
filtered AS (SELECT p.*, sqrt(pow(0.94, place) * (v0 + coalesce(sum(0.06 * x * x * pow(0.94, -place - 1)) OVER (PARTITION BY key ORDER BY d
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS sigma FROM placed_returns p JOIN starts USING (key)),
residuals AS (SELECT *, CASE WHEN sigma > 0 THEN greatest(-8, least(8, x / sigma)) END AS z FROM filtered),
history AS MATERIALIZED (SELECT *, count(z) OVER (PARTITION BY key ORDER BY d) AS n_pool FROM residuals)"""


def tidy_sql(x: str, places: int) -> str:
    """To so many places, or nine significant digits."""
    scale = f"pow(10.0, CASE WHEN abs({x}) < 1e{9 - places} THEN {places} ELSE 8 - floor(log10(abs({x}))) END)"
    return f"round_even({x} * {scale}, 0) / {scale} + 0.0"


def _digits(part: int) -> str:
    return f"CAST('0x' || substr(m, {8 * part + 1}, 8) AS BIGINT) / 4294967296.0"


def steps_sql(at: str, paths: int) -> str:
    """CTE ``steps``: shocks of each path of ``at`` (key, series, as_of, sigma, n_pool, horizon). A restart holds until the next."""
    return f"""draws AS (SELECT a.*, p.path, t.step, md5(concat_ws('|', a.key, a.as_of, p.path, t.step)) AS m FROM {at} a, range({paths}) p(path), unnest(range(a.horizon)) t(step)),
marked AS (SELECT * EXCLUDE (m), step = 0 OR {_digits(0)} < 0.2 AS begins, CAST(floor({_digits(1)} * n_pool) AS BIGINT) AS start FROM draws),
carried AS (SELECT *, last_value(CASE WHEN begins THEN start - step END IGNORE NULLS) OVER (PARTITION BY key, as_of, path ORDER BY step) AS off FROM marked),
steps AS MATERIALIZED (SELECT c.key, c.as_of, c.path, c.step, h.z * c.sigma AS shock FROM carried c JOIN history h ON h.key = c.series AND h.z IS NOT NULL AND h.n_pool - 1 = (c.off + c.step) % c.n_pool)"""


_Q = ", ".join(f"round_even(quantile_cont(\"end\", {q}), 4) + 0.0 AS {n}" for n, q in (("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95)))
CONE_SQL = f"""{_Q}, round_even(avg(("end" > 0)::INT), 3) + 0.0 AS prob_up, {tidy_sql('avg("end")', 4)} AS expected"""
LAST_RETURN = "(SELECT key, max(d) AS d FROM history GROUP BY 1)"


def chances_sql(trades: str) -> str:
    """CTE ``chances``: what paths of ``steps`` meet first, for ``trades`` (key, direction, tp, sl, cost, horizon)."""
    return f"""levels AS (SELECT t.*, path, step, (exp(sum(shock) OVER (PARTITION BY t.key, t.direction, path ORDER BY step)) - 1) * CASE direction WHEN 'LONG' THEN 1 ELSE -1 END AS level
    FROM {trades} t JOIN steps s ON s.key = t.key AND s.step < t.horizon),
met AS (SELECT key, direction, path, any_value(tp) AS tp, any_value(sl) AS sl, any_value(cost) AS cost, any_value(horizon) AS horizon, min(step) FILTER (level >= tp) AS t_tp,
    min(step) FILTER (level <= -sl) AS t_sl, arg_max(level, step) AS last_level FROM levels GROUP BY 1, 2, 3),
ended AS (SELECT *, CASE WHEN t_sl <= coalesce(t_tp, t_sl) THEN 'SL' WHEN t_tp IS NOT NULL THEN 'TP' ELSE 'TIME' END AS label FROM met),
paid AS (SELECT *, CASE label WHEN 'SL' THEN -1 WHEN 'TP' THEN tp / sl ELSE last_level / sl END - cost * CASE label WHEN 'SL' THEN t_sl + 1 WHEN 'TP' THEN t_tp + 1 ELSE horizon END / sl AS gain FROM ended),
chances AS MATERIALIZED (SELECT key, direction, round_even(avg((label = 'TP')::INT), 4) + 0.0 AS prob_tp, round_even(avg((label = 'SL')::INT), 4) + 0.0 AS prob_sl,
    round_even(avg((label = 'TIME')::INT), 4) + 0.0 AS prob_time, round_even(avg(gain), 4) + 0.0 AS expectancy_r, round_even(avg(gain) - 1.96 * stddev_samp(gain) / sqrt(count(*)), 4) + 0.0 AS exp_lo,
    round_even(avg(gain) + 1.96 * stddev_samp(gain) / sqrt(count(*)), 4) + 0.0 AS exp_hi FROM paid GROUP BY 1, 2)"""


def scores_of_models_sql(start: int, horizon: int, step: int, paths: int) -> str:
    """CTE ``figures``: mean score and calibration of both built-in models by key."""
    return f"""{HISTORY}, decided_at AS MATERIALIZED (SELECT key, key AS series, d AS as_of, sigma, n_pool, {horizon} AS horizon, exp(f.later) - 1 AS value FROM history h JOIN (SELECT key, d,
    sum(x) OVER (PARTITION BY key ORDER BY d ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING) AS later FROM history) f USING (key, d)
    WHERE place >= {start} AND (place - {start}) % {step} = 0 AND place < n_returns - {horizon}),
{steps_sql('decided_at', paths)},
drawn AS (SELECT 'fhs' AS model, key, as_of, path, exp(sum(shock)) - 1 AS "end" FROM steps GROUP BY ALL UNION ALL
    SELECT 'normal', key, as_of, path, exp(sqrt(-2 * ln({_digits(0)} + 1 / 4294967296.0)) * cos(2 * pi() * {_digits(1)}) * sigma * sqrt(horizon)) - 1
    FROM (SELECT a.*, path, md5(concat_ws('|', key, as_of, path, 'normal')) AS m FROM decided_at a, range({paths}) p(path))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model, key, as_of ORDER BY "end") AS i FROM drawn),
scored AS (SELECT model, key, as_of, avg(abs("end" - value)) - sum((2.0 * i - {paths} - 1) * "end") / {paths * paths}.0 AS crps, avg(("end" <= value)::INT) AS pit
    FROM ranked JOIN decided_at USING (key, as_of) GROUP BY 1, 2, 3),
binned AS (SELECT model, key, least(floor(pit * 10), 9) AS bin, count(*) AS c, sum(crps) AS s FROM scored GROUP BY 1, 2, 3),
totals AS (SELECT model, key, CAST(sum(c) AS BIGINT) AS n, sum(s) AS s FROM binned GROUP BY 1, 2),
figures AS MATERIALIZED (SELECT t.key, t.model, n, {tidy_sql('(t.s / n)', 5)} AS mean_crps, round_even(avg(abs(coalesce(c, 0) - n / 10)) / (n / 10), 3) + 0.0 AS pit_uniformity
    FROM totals t CROSS JOIN range(10) k(bin) LEFT JOIN binned b ON b.model = t.model AND b.key = t.key AND b.bin = k.bin GROUP BY t.key, t.model, n, t.s)"""


WINNERS = "winners AS MATERIALIZED (SELECT key, arg_min(model, (mean_crps, model <> 'fhs', model)) AS winner FROM figures GROUP BY 1)"
MODEL_RUN = (300, 20, 20, 100)
ROUTED = f"""{scores_of_models_sql(*MODEL_RUN)}, {WINNERS}, long_series AS (SELECT key FROM closes GROUP BY 1 HAVING count(*) >= 400),
final_at AS (SELECT h.key, h.key AS series, h.d AS as_of, sigma, n_pool, 20 AS horizon, winner FROM history h JOIN {LAST_RETURN} USING (key, d) JOIN winners USING (key) JOIN long_series USING (key)),
{steps_sql('final_at', 100).replace('draws AS', 'draws2 AS').replace('FROM draws)', 'FROM draws2)').replace('marked AS', 'marked2 AS').replace('FROM marked)', 'FROM marked2)').replace('carried AS', 'carried2 AS').replace('FROM carried c', 'FROM carried2 c').replace('steps AS', 'steps2 AS')},
last_drawn AS (SELECT 'fhs' AS used, key, as_of, path, exp(sum(shock)) - 1 AS "end" FROM steps2 GROUP BY ALL UNION ALL
    SELECT 'normal', key, as_of, path, exp(sqrt(-2 * ln({_digits(0)} + 1 / 4294967296.0)) * cos(2 * pi() * {_digits(1)}) * sigma * sqrt(horizon)) - 1
    FROM (SELECT a.*, path, md5(concat_ws('|', key, as_of, path, 'normal')) AS m FROM final_at a, range(100) p(path)))
SELECT key, winner, used, as_of, {CONE_SQL} FROM last_drawn JOIN winners USING (key) WHERE used = winner GROUP BY 1, 2, 3, 4"""

SIMULATED_SETUPS = _setups_sql(
    f"""{HISTORY}, trades AS MATERIALIZED (SELECT r.instrument AS key, r.key AS series, as_of, direction, reward / entry AS tp, risk / entry AS sl,
    CASE WHEN direction = 'LONG' THEN carry_long ELSE carry_short END AS cost, CAST(r.h AS INTEGER) AS horizon FROM ratioed r JOIN {IDS} ON i.instrument = r.instrument WHERE reward > 0 AND risk > 0),
decided_at AS (SELECT t.key, t.series, t.as_of, t.horizon, h.sigma, h.n_pool FROM trades t JOIN history h ON h.key = t.series AND h.d = t.as_of WHERE n_returns >= 79), {steps_sql('decided_at', 2000)}, {chances_sql('trades')},
cone AS MATERIALIZED (SELECT key, {CONE_SQL} FROM (SELECT key, path, exp(sum(shock)) - 1 AS "end" FROM steps GROUP BY 1, 2) GROUP BY 1), """,
    "prob_tp, prob_sl, prob_time, c.expectancy_r AS sim_expectancy_r, c.exp_lo AS sim_lo, c.exp_hi AS sim_hi, p05, p25, median, p75, p95, prob_up, expected,",
    f"""CASE WHEN g.instrument <> 'OPN' THEN {BY_RATE} WHEN prob_tp IS NULL THEN 'scenario: too little history' ELSE nullif(concat_ws('; ',
    CASE WHEN prob_tp < 0.5 THEN 'scenario: probability' END, CASE WHEN c.expectancy_r < g.min_exp THEN 'scenario: expectancy' END, CASE WHEN c.exp_lo <= 0 THEN 'scenario: expectancy interval' END), '') END""",
    "LEFT JOIN chances c ON c.key = g.instrument LEFT JOIN cone ON cone.key = g.instrument",
)

ENSEMBLES = """WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT user_id, sum((2.0 * i - n - 1) * value) / any_value(n::DOUBLE * n) AS pairs FROM x GROUP BY 1),
m AS (SELECT e.event_id, e.event_type, e.user_id, avg(abs(x.value - e.value)) AS near, avg((x.value <= e.value)::INT) AS pit
    FROM events e JOIN x USING (user_id) GROUP BY 1, 2, 3)"""

def ic_sql(outcome: str) -> str:
    return outcome_sql() + f""", each AS (SELECT o.instrument, f.name AS driver, f.score AS x, {outcome} AS y
    FROM out o JOIN frame_scores f USING (instrument, as_of) WHERE f.ok AND (o.oos OR o.instrument NOT IN (SELECT instrument FROM out WHERE oos)))
SELECT instrument, driver, round_even(CASE WHEN count(*) >= 5 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN covar_pop(x,
    y) / nullif(stddev_pop(x) * stddev_pop(y), 0) ELSE 0 END, 4) + 0.0 AS ic, count(*) AS n FROM each GROUP BY 1, 2"""


ORACLE = {
    "triple_barrier": P.with_views("prices", f"""{ATR}, src AS (SELECT key AS instrument, key, d, rn, close, atr, direction, {H} AS h
    FROM bars, (VALUES ('LONG'), ('SHORT')) t(direction) WHERE atr IS NOT NULL AND rn < n_bars), """ + barrier_sql("src", "0.4 * s.atr", "0.6 * s.atr", "0.0") + " SELECT key AS symbol, d, direction, label, held, round_even(outcome_r, 6) + 0.0 AS outcome_r FROM out"),
    "panel_outcomes": P.with_views(VIEWS, outcome_sql() + """ SELECT instrument, as_of, score, direction, oos, label, held, round_even(outcome_r, 6) + 0.0 AS outcome_r, hit FROM out"""),
    "swap_cost": P.with_views(VIEWS, outcome_sql() + f""" SELECT instrument, as_of, direction, held, round_even(outcome_r, 6) + 0.0 AS outcome_r, round_even(outcome_r + {CARRY}, 6) + 0.0 AS gross_r FROM out"""),
    "gate_neighbors": P.with_views(VIEWS, f"""{outcome_sql()}, {SPLIT} SELECT c.instrument, c.as_of, count(t.score) AS n, round_even(coalesce(avg(t.outcome_r), 0), 6) + 0.0 AS mean_r
    FROM cur c LEFT JOIN train t ON t.instrument = c.instrument AND t.direction = c.direction AND abs(t.score - c.score) <= c.band GROUP BY 1, 2"""),
    "gate_wilson": """WITH n AS (SELECT user_id, count(*) AS n, count(*) FILTER (value > 50) AS k FROM events GROUP BY 1),
w AS (SELECT *, k / n::DOUBLE AS p, 1 + 1.96 * 1.96 / n AS s
    FROM n) SELECT user_id, n, k, round_even(greatest(0, (p + 1.96 * 1.96 / (2 * n)) / s - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / s),
    8) + 0.0 AS lo, round_even(least(1, (p + 1.96 * 1.96 / (2 * n)) / s + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / s), 8) + 0.0 AS hi FROM w""",
    "gate_full": P.with_views(VIEWS, f"{outcome_sql()}, {SPLIT}, {GATE} SELECT {RATE} FROM rate"),
    "levels": P.with_views("prices", f"""{ATR}, {LEVELS}, sided AS (SELECT * FROM rounded, (VALUES ('LONG'), ('SHORT')) t(direction)), {PLACED} SELECT instrument, direction, round_even(entry, 4) AS entry,
    round_even(sl, 4) AS sl, round_even(tp, 4) AS tp, round_even(rr, 4) AS rr FROM ratioed"""),
    "setups": P.with_views(VIEWS, _setups_sql() + " SELECT *, reject_reason = '' AS published FROM final_rows"),
    "publish_order": P.with_views(VIEWS, _setups_sql() + """ SELECT CAST(row_number() OVER (ORDER BY reject_reason = '' DESC, abs(score) DESC, instrument) AS INTEGER) AS position, instrument, reject_reason = '' AS published,
    score FROM final_rows"""),
    "driver_ic": P.with_views(VIEWS, ic_sql("o.outcome_r")),
    "validate_ic": P.with_views(VIEWS, ic_sql("o.outcome_r")),
    "driver_return_ic": P.with_views(VIEWS, ic_sql("o.last_close / o.close - 1")),
    "validate_oos": P.with_views(VIEWS, f"{outcome_sql()}, {SPLIT}, {PREDICT.format(rows='cur', train='train', more='')}, {GATE}, " + f"""base AS (SELECT instrument, count(*) FILTER (NOT oos) AS n_train, count(*) FILTER (oos) AS n_oos, round_even(coalesce(avg(hit::INT) FILTER (oos), 0),
    4) + 0.0 AS base_hit, round_even(coalesce(avg(outcome_r) FILTER (oos), 0), 4) + 0.0 AS base_exp FROM out GROUP BY 1),
fig AS (SELECT instrument, {FIGURES}, round_even(coalesce(avg(actual) FILTER (predicted <= 0), 0), 4) + 0.0 AS exp_when_pred_bear FROM pred GROUP BY 1),
good AS (SELECT r.instrument, count(*) AS n_gate_pass, round_even(avg(c.hit::INT), 4) + 0.0 AS gate_hit, round_even(avg(c.outcome_r), 4) + 0.0 AS gate_exp
    FROM rate r JOIN cur c USING (instrument, as_of) WHERE r.why = '' GROUP BY 1)
SELECT instrument, n_train, n_oos, base_hit, base_exp, coalesce(n_predicted, 0) AS n_predicted, coalesce(sign_agreement, 0) AS sign_agreement,
    coalesce(exp_when_pred_bull, 0) AS exp_when_pred_bull, coalesce(exp_when_pred_bear, 0) AS exp_when_pred_bear, coalesce(n_gate_pass, 0) AS n_gate_pass,
    coalesce(gate_hit, 0) AS gate_hit, coalesce(gate_exp, 0) AS gate_exp FROM base LEFT JOIN fig USING (instrument) LEFT JOIN good USING (instrument)"""),
    "walk_forward": P.with_views(VIEWS, f"""{outcome_sql()}, {PREDICT.format(rows='out', train='out', more='AND year(t.as_of) < year(c.as_of)')}, counts AS (SELECT instrument,
    CAST(year(as_of) AS INTEGER) AS fold, count(*) AS m FROM out GROUP BY 1, 2),
fig AS (SELECT instrument, CAST(year(as_of) AS INTEGER) AS fold, {FIGURES}
    FROM pred GROUP BY 1, 2) SELECT a.instrument, a.fold, CAST(any_value(a.m) AS BIGINT) AS n_test, CAST(sum(b.m) AS BIGINT) AS n_train,
    coalesce(any_value(f.n_predicted), 0) AS n_predicted, coalesce(any_value(f.sign_agreement), 0) AS sign_agreement, coalesce(any_value(f.exp_when_pred_bull),
    0) AS exp_when_pred_bull FROM counts a JOIN counts b ON a.instrument = b.instrument AND b.fold < a.fold
    LEFT JOIN fig f ON f.instrument = a.instrument AND f.fold = a.fold GROUP BY 1, 2"""),
    "ablation": P.with_views(VIEWS, f"{ABLATION} SELECT * FROM ablated_runs"),
    "ablation_summary": P.with_views(VIEWS, f"""{ABLATION} SELECT round_even(avg(delta), 2) + 0.0 AS mean_delta, count(*) FILTER (better) AS n_better, count(*) AS n FROM ablated_runs"""),
    "clean_glitches": P.with_views("prices", GLITCHES),
    "crps_ensemble": ENSEMBLES + """ SELECT event_id, floor((near - pairs) * 1000000 + 0.500001) / 1000000 + 0.0 AS crps,
    floor((near - 0.5 * pairs) * 1000000 + 0.500001) / 1000000 + 0.0 AS crps_legacy, round_even(pit, 6) + 0.0 AS pit FROM m JOIN p USING (user_id)""",
    "pit_hist": ENSEMBLES + """, s AS (SELECT event_type, least(floor(pit * 10), 9) AS bin, near - pairs AS crps FROM m JOIN p USING (user_id)),
c AS (SELECT event_type, bin, count(*) AS c, sum(crps) AS s FROM s GROUP BY 1, 2),
t AS (SELECT event_type, sum(c) AS n, sum(s) AS s FROM c GROUP BY 1)
SELECT t.event_type, CAST(n AS BIGINT) AS n, round_even(t.s / n, 5) + 0.0 AS mean_crps, round_even(avg(abs(coalesce(c.c, 0) - n / 10)) / (n / 10),
    3) + 0.0 AS pit_uniformity FROM t CROSS JOIN range(10) b(k) LEFT JOIN c ON c.event_type = t.event_type AND c.bin = b.k GROUP BY t.event_type, n, t.s""",
    "quantile_cone": """SELECT event_type, round_even(quantile_cont(value, 0.05), 6) + 0.0 AS p05, round_even(quantile_cont(value, 0.25), 6) + 0.0 AS p25, round_even(quantile_cont(value,
    0.5), 6) + 0.0 AS median, round_even(quantile_cont(value, 0.75), 6) + 0.0 AS p75, round_even(quantile_cont(value, 0.95), 6) + 0.0 AS p95,
    round_even(avg((value > 50)::INT), 4) + 0.0 AS prob_up, round_even(avg(value), 4) + 0.0 AS expected FROM events GROUP BY 1""",
    "ewma_vol": P.with_views("closes", """x AS (SELECT * FROM (SELECT key, d, ln(v) - ln(lag(v) OVER (PARTITION BY key ORDER BY d)) AS r FROM closes) WHERE r IS NOT NULL),
l AS (SELECT key, list(r ORDER BY d) AS xs FROM x GROUP BY 1), h AS (SELECT key, xs, list_aggregate(xs[1:20], 'var_pop') AS v0 FROM l)
SELECT key AS symbol, CAST(len(xs) AS INTEGER) AS n, round_even(sqrt(list_reduce(xs, lambda a, x: 0.94 * a + 0.06 * x * x, v0)), 8) AS next_volatility FROM h"""),
    "fhs_cone": P.with_views("closes", f"""{HISTORY}, decided_at AS (SELECT key, key AS series, d AS as_of, sigma, n_pool, 20 AS horizon FROM history JOIN {LAST_RETURN} USING (key, d) WHERE n_returns >= 60),
{steps_sql('decided_at', 1000)} SELECT key, as_of, {CONE_SQL} FROM (SELECT key, as_of, path, exp(sum(shock)) - 1 AS "end" FROM steps GROUP BY 1, 2, 3) GROUP BY 1, 2"""),
    "fhs_barrier": P.with_views("closes", f"""{HISTORY}, decided_at AS (SELECT key, key AS series, d AS as_of, sigma, n_pool, 20 AS horizon FROM history JOIN {LAST_RETURN} USING (key, d) WHERE n_returns >= 60),
{steps_sql('decided_at', 2000)}, trades AS (SELECT key, direction, 0.3::DOUBLE AS tp, 0.2::DOUBLE AS sl, 0.0001::DOUBLE AS cost, 20 AS horizon FROM decided_at, (VALUES ('LONG'), ('SHORT')) t(direction)), {chances_sql('trades')} SELECT * FROM chances"""),
    "model_scores": P.with_views("closes", f"{scores_of_models_sql(*MODEL_RUN)} SELECT * FROM figures"),
    "route_models": P.with_views("closes", f"{scores_of_models_sql(*MODEL_RUN)}, {WINNERS} SELECT * FROM winners"),
    "routed_cones": P.with_views("closes", ROUTED),
    "setups_simulated": P.with_views(VIEWS, SIMULATED_SETUPS + " SELECT *, reject_reason = '' AS published FROM final_rows"),
}
