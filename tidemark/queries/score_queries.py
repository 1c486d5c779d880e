"""Scores, grades and traces of three proxy instruments at their last day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import score
from ..sources import proxies as P
from .driver_queries import SD

#: The proxy instruments.
FINGERPRINTS = [
    {"id": "FUL", "ticker": "ORD_F", "drivers": [
        {"name": "momentum", "weight": 0.4, "params": {"series": "A"}},
        {"name": "price_vs_sma", "weight": 0.3, "params": {"symbol": "ORD_F"}},
        {"name": "level_percentile", "weight": 0.3, "params": {"series": "N", "bull_when": "low"}},
    ]},
    {"id": "OPN", "ticker": "ORD_O", "swap": {"long_cost_pct_per_day": 0.0002, "short_cost_pct_per_day": -0.0001}, "drivers": [
        {"name": "momentum", "weight": 0.3, "params": {"series": "R", "horizon_days": 10}},
        {"name": "price_vs_sma", "weight": 0.3, "params": {"symbol": "ORD_O", "window": 50, "hist": 100}},
        {"name": "cot_spec_net_percentile", "weight": 0.2, "params": {"market": "O"}},
        {"name": "etf_flow", "weight": 0.2, "params": {"ticker": "ETF", "bull_when": "low"}},
    ]},
    {"id": "PAR", "ticker": "ORD_P", "drivers": [
        {"name": "momentum", "weight": 0.5, "params": {"series": "N", "bull_when": "low"}},
        {"name": "rainfall_anomaly", "weight": 0.25, "params": {"region": "F"}},
        {"name": "level_percentile", "weight": 0.25, "params": {"series": "A", "lookback_days": 250}},
    ], "base_rate": {"horizon_days": 20, "band": 0.22, "min_effective_n": 8, "min_hit_rate_pct": 30.0, "min_expectancy_r": 0.02, "atr_window": 10}},
]
VIEWS = "prices closes macro cot weather etf"


def environment(spark, sf_dir) -> dict:
    return P.environment(spark, sf_dir)


def driver_sql(name: str, p: dict) -> str:
    """(as_of, ok, score) of one driver at the dates of ``decisions``."""
    sign = -1 if p.get("bull_when") == "low" else 1
    tanh = lambda z, ok: f"SELECT as_of, {ok} AS ok, {sign} * tanh({z}) AS s FROM x"
    dates = "dates AS (SELECT DISTINCT as_of FROM decisions)"
    over = "OVER (ORDER BY d)"
    asof = ", x AS (SELECT p.as_of, q.* FROM dates p ASOF LEFT JOIN q ON p.as_of >= q.d) "
    if name == "momentum":
        h = p.get("horizon_days", 21)
        return f"""WITH {dates}, c AS (SELECT d, v - lag(v, {h}) {over} AS cur, row_number() {over} AS n FROM macro WHERE key = '{p['series']}'),
q AS (SELECT *, stddev_pop(cur) {over} AS sd FROM c)""" + asof + tanh(f"cur / {SD}", f"n >= {h + 20}")
    if name == "price_vs_sma":
        w, h = p.get("window", 200), p.get("hist", 250)
        return f"""WITH {dates}, c AS (SELECT d, v, row_number() {over} AS n, avg(v) OVER (ORDER BY d ROWS {w - 1} PRECEDING) AS sma FROM closes WHERE key = '{p['symbol']}'),
e AS (SELECT *, CASE WHEN n >= {w} THEN (v - sma) / sma END AS cur FROM c),
q AS (SELECT *, stddev_pop(cur) OVER (ORDER BY d ROWS {h} PRECEDING) AS sd FROM e)""" + asof + tanh(f"cur / {SD}", f"n >= {w + 1}")
    if name == "etf_flow":
        return f"""WITH {dates}, c AS (SELECT d, v, lag(v, 63) {over} AS old, row_number() {over} AS n FROM etf),
e AS (SELECT *, (v - old) / nullif(old, 0) AS cur FROM c),
q AS (SELECT *, stddev_pop(cur) {over} AS sd, count(cur) {over} AS m FROM e)""" + asof + tanh(f"cur / {SD}", "n >= 93 AND old > 0 AND m >= 20")
    share = f"SELECT as_of, coalesce(len(h), 0) >= 20 AS ok, {sign} * (2.0 * len(list_filter(h, lambda z: z <= cur)) / len(h) - 1) AS s FROM x"
    if name == "level_percentile":
        return f"""WITH {dates}, x AS (SELECT p.as_of, arg_max(v, d) AS cur, list(v) FILTER (v IS NOT NULL) AS h
    FROM dates p LEFT JOIN macro m ON m.key = '{p['series']}' AND d <= p.as_of AND d >= p.as_of - {p.get('lookback_days', 504)} GROUP BY 1) """ + share
    if name == "cot_spec_net_percentile":
        return f"""WITH {dates}, c AS (SELECT d + 3 AS d, (long_spec - short_spec) / open_interest::DOUBLE AS cur FROM cot WHERE key = '{p['market']}'),
q AS (SELECT *, list(cur) OVER (ORDER BY d ROWS 155 PRECEDING) AS h FROM c)""" + asof + share
    if name == "rainfall_anomaly":
        return f"""WITH {dates}, q AS (SELECT d, sum(precip) OVER (ORDER BY d ROWS 29 PRECEDING) AS v, row_number() {over} AS rn, dayofyear(d) AS doy
    FROM weather WHERE key = '{p['region']}'),
y AS (SELECT p.as_of, q.* FROM dates p ASOF LEFT JOIN q ON p.as_of >= q.d),
x AS (SELECT y.as_of, any_value(y.rn) AS n, any_value(y.v) AS v, avg(o.v) AS mean, stddev_pop(o.v) AS sd, count(o.v) AS m
    FROM y LEFT JOIN q o ON o.rn <= y.rn - 60 AND least(abs(o.doy - y.doy), 366 - abs(o.doy - y.doy)) <= 15 GROUP BY 1) """ + tanh(f"abs((v - mean) / {SD}) - 1", "n >= 1095 AND m >= 20")
    raise KeyError(name)


def scores_sql(fingerprints: list[dict] = FINGERPRINTS, name: str = "scores") -> str:
    """CTEs frame and ``name`` (instrument, as_of, raw, score, n_ok) over ``decisions`` (instrument, as_of)."""
    parts = [
        f"""SELECT d.instrument, d.as_of, {i} AS driver_idx, '{s['name']}' AS name, {s['weight']}::DOUBLE AS weight, coalesce(x.ok, false) AS ok,
    CASE WHEN x.ok THEN round_even(x.s, 4) + 0.0 ELSE 0.0 END AS score
    FROM decisions d JOIN ({driver_sql(s['name'], s.get('params', {}))}) x USING (as_of) WHERE d.instrument = '{f['id']}'"""
        for f in fingerprints for i, s in enumerate(f["drivers"])
    ]
    return f"""frame_{name} AS MATERIALIZED ({' UNION ALL '.join(parts)}), {name} AS MATERIALIZED (SELECT instrument, as_of,
    round_even(coalesce(list_sum(list(weight * score ORDER BY driver_idx) FILTER (ok)) / nullif(list_sum(list(weight ORDER BY driver_idx) FILTER (ok)), 0), 0),
    10) + 0.0 AS raw, floor(raw * 10000 + 0.500001) / 10000 + 0.0 AS score,
    coalesce(abs(sum(weight * score) FILTER (ok)) / nullif(sum(weight * abs(score)) FILTER (ok), 0), 1) AS agreement, count(*) FILTER (ok) AS n_ok
    FROM frame_{name} GROUP BY 1, 2)"""


#: What the instruments without settings of their own go by.
LIMITS = {"horizon_days": 30, "band": 0.15, "min_effective_n": 10, "min_hit_rate_pct": 35.0, "min_expectancy_r": 0.05, "oos_start": "1997-01-01"}


def _rule_sql(f: dict) -> str:
    """The instrument's settings and carry, written out for SQL independently of the library's own table."""
    own, swap = LIMITS | f.get("base_rate", {}), f.get("swap", {})
    numbers = [own["horizon_days"], own["band"], own["min_effective_n"], own["min_hit_rate_pct"], own["min_expectancy_r"], own.get("atr_window", 14), swap.get("long_cost_pct_per_day", 0), swap.get("short_cost_pct_per_day", 0)]
    return f"('{f['id']}', '{f['ticker']}', {', '.join(f'{x}::DOUBLE' for x in numbers)})"


IDS = "(VALUES " + ", ".join(map(_rule_sql, FINGERPRINTS)) + ") i(instrument, key, h, band, least, min_hit, min_exp, atr_w, carry_long, carry_short)"
LAST = f"decisions AS (SELECT instrument, max(d) AS as_of FROM prices JOIN {IDS} USING (key) GROUP BY 1)"
GRADE = "CASE WHEN abs(raw) < 0.25 THEN 'NEUTRAL' WHEN raw > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, CASE WHEN abs(raw) < 0.25 THEN 'NONE' WHEN abs(raw) >= 0.55 THEN 'A+' WHEN abs(raw) >= 0.4 THEN 'A' ELSE 'B' END AS grade"


def last_days(spark, sf_dir):
    return _last(P.closes(spark, sf_dir))


def _last(closes):
    names = F.create_map(*(F.lit(x) for f in FINGERPRINTS for x in (f["ticker"], f["id"])))
    return closes.groupBy("key").agg(F.max("d").alias("as_of")).select(names[F.col("key")].alias("instrument"), "as_of")


def _scored(spark, sf_dir, fingerprints=FINGERPRINTS):
    env = environment(spark, sf_dir)
    return score.score_instruments(env, fingerprints, _last(env["closes"]))


def score_all(spark, sf_dir):
    return _scored(spark, sf_dir).select("instrument", "as_of", "score", "direction", "grade", "n_ok")


def score_drivers(spark, sf_dir):
    env = environment(spark, sf_dir)
    return score.driver_frame(env, FINGERPRINTS, _last(env["closes"])).select("instrument", "as_of", "driver_idx", "name", "weight", "ok", "score")


def score_agreement(spark, sf_dir):
    agree = [f | {"aggregation": {"method": "agreement", "gamma": 2.0}} for f in FINGERPRINTS]
    return _scored(spark, sf_dir, agree).select("instrument", "as_of", "score")


def grades(spark, sf_dir):
    values = P.table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100 - 0.5).alias("s"))
    side, letter = score.grade(F.col("s"))
    return values.select("event_id", side.alias("direction"), letter.alias("grade"))


def explain_json(spark, sf_dir):
    """The trace of each score, field by field: the JSON text parsed again."""
    text = score.explain(_scored(spark, sf_dir))
    trace = "struct<instrument: string, as_of: string, score: double, direction: string, grade: string, drivers: array<struct<name: string, ok: boolean, score: double, value: double, weight: double, contribution: double>>>"
    each = text.select(F.from_json("trace", trace).alias("t")).select("t.*", F.posexplode("t.drivers").alias("driver_idx", "e"))
    return each.select("instrument", "as_of", "score", "direction", "grade", "driver_idx", F.col("e.name").alias("name"), F.col("e.ok").alias("ok"), F.col("e.score").alias("driver_score"), F.col("e.weight").alias("weight"), F.col("e.contribution").alias("contribution"))


QUERIES = {"score_all": score_all, "score_drivers": score_drivers, "score_agreement": score_agreement, "grades": grades, "explain_json": explain_json}
ORACLE = {
    "score_all": P.with_views(VIEWS, f"{LAST}, {scores_sql()} SELECT instrument, as_of, score, {GRADE}, CAST(n_ok AS INTEGER) AS n_ok FROM scores"),
    "score_drivers": P.with_views(VIEWS, f"{LAST}, {scores_sql()} SELECT instrument, as_of, driver_idx, name, weight, ok, score FROM frame_scores"),
    "score_agreement": P.with_views(VIEWS, f"""{LAST}, {scores_sql()} SELECT instrument, as_of, floor(raw * pow(agreement, 2.0) * 10000 + 0.500001) / 10000 + 0.0 AS score FROM scores"""),
    "explain_json": P.with_views(VIEWS, f"""{LAST}, {scores_sql()}, graded AS (SELECT *, {GRADE} FROM scores)
SELECT instrument, CAST(as_of AS VARCHAR) AS as_of, g.score, direction, grade, driver_idx, name, ok, f.score AS driver_score, weight, round_even(weight * f.score,
    4) + 0.0 AS contribution FROM frame_scores f JOIN graded g USING (instrument, as_of)"""),
    "grades": f"SELECT event_id, {GRADE} FROM (SELECT event_id, value / 100 - 0.5 AS raw FROM events)",
}
