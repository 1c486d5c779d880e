"""Bars and the drivers of every series at every trading day."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import r, steady
from ..operators import asof, spine_spread
from ..operators.bars import atr, fractals, log_returns
from ..plans import drivers
from ..sources import proxies as P
from ..sources.shared import session_dir
from ..streaming.indicators import SCHEMA, indicators, run_to_files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day on which a symbol trades."""
    return P.closes(spark, sf_dir).select(F.col("d").alias("as_of")).distinct()


def probes(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return dates(spark, sf_dir).select(F.explode(F.array(*map(F.lit, keys))).alias("key"), "as_of")


DATES = "dates AS (SELECT DISTINCT d AS as_of FROM prices)"


def probes_sql(*keys: str) -> str:
    return f"{DATES}, probes AS (SELECT key, as_of FROM dates, (VALUES {', '.join(f"('{k}')" for k in keys)}) t(key))"


def one(df: DataFrame, key: str, to: str | None = None) -> DataFrame:
    """One series under another key."""
    return df.filter(F.col("key") == key).withColumn("key", F.lit(to or key))


def final(score: str, value: str, ok: str, places: int = 6) -> str:
    return f"""SELECT key, as_of, coalesce({ok}, false) AS ok, CASE WHEN {ok} THEN round_even({score}, 4) + 0.0 ELSE 0.0 END AS score, CASE WHEN {ok} THEN round_even({value},
    {places}) + 0.0 END AS value FROM last_rows"""


SD = "CASE WHEN coalesce(sd, 0) = 0 THEN 1e-9 ELSE sd END"
#: The last row of ``rows`` on or before each probe.
ATTACH = "last_rows AS (SELECT p.key, p.as_of, x.* EXCLUDE (key) FROM probes p ASOF LEFT JOIN rows x ON p.key = x.key AND p.as_of >= x.d)"
#: The values of ``series`` in the look-back of each probe.
LOOK = """last_rows AS (SELECT p.key, p.as_of, arg_max(v, d) AS cur, list(v ORDER BY d) AS h
    FROM probes p LEFT JOIN series s ON s.key = p.key AND s.d <= p.as_of AND s.d >= p.as_of - {days} GROUP BY 1, 2)"""
PCT = final("{sign} * (2.0 * len(list_filter(h, lambda x: x <= cur)) / len(h) - 1)", "cur", "coalesce(len(h), 0) >= 20")

@query("bars_daily", "SELECT key AS symbol, d, open, high, low, close, volume FROM (" + P.SQL["prices"] + ")")
def bars_daily(spark, sf_dir):
    return P.prices(spark, sf_dir).withColumnRenamed("key", "symbol")


@query("bars_hourly", """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value,
    event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def bars_hourly(spark, sf_dir):
    return P.hourly(spark, sf_dir).withColumnRenamed("key", "symbol")


@query("stream_indicators", """WITH t AS (SELECT event_type AS key, ts, event_id, value FROM events WHERE value IS NOT NULL), edge AS (SELECT epoch_ms(max(ts)) - 600000 AS w FROM t),
bars AS (SELECT key, date_trunc('hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM t GROUP BY 1, 2),
shut AS (SELECT * FROM bars, edge WHERE epoch_ms(ts) + 3600000 <= w),
x AS (SELECT *, ln(close) - ln(lag(close) OVER k) AS x, greatest(high - low, coalesce(abs(high - lag(close) OVER k), 0), coalesce(abs(low - lag(close) OVER k), 0)) AS reach
    FROM shut WINDOW k AS (PARTITION BY key ORDER BY ts)),
n AS (SELECT *, count(x) OVER k AS n, CASE WHEN count(*) OVER k >= 14 THEN avg(reach) OVER (PARTITION BY key ORDER BY ts ROWS 13 PRECEDING) END AS atr FROM x WINDOW k AS (PARTITION BY key ORDER BY ts)),
v AS (SELECT key, var_pop(x) AS v0 FROM n WHERE n <= 20 AND x IS NOT NULL GROUP BY 1)
SELECT key AS symbol, ts, open, high, low, close, volume, round_even(x, 8) + 0.0 AS log_return, round_even(atr, 6) + 0.0 AS atr,
    CASE WHEN n >= 20 THEN round_even(sqrt(pow(0.94, n) * v0 + sum(0.06 * x * x * pow(0.94, -n)) OVER (PARTITION BY key ORDER BY ts) * pow(0.94, n)), 6) + 0.0 END AS next_sigma FROM n LEFT JOIN v USING (key)""")
def stream_indicators(spark, sf_dir):
    """The events as a stream of ticks, in one run to the end of what has landed."""
    path = f"{sf_dir}/events.parquet"
    # As a pattern, the path may be a file or a folder; a stream's plain path must be a folder.
    ticks = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    ticks = ticks.select(F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), "value")
    place = f"{session_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_to_files(indicators(ticks), f"{place}/bars", f"{place}/checkpoint")
    rounded = [r(F.col(c), n).alias(c) for c, n in (("log_return", 8), ("atr", 6), ("next_sigma", 6))]
    return spark.read.schema(SCHEMA).parquet(f"{place}/bars").select(F.col("key").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume", *rounded)


@query("log_returns", P.with_views("closes", """SELECT key AS symbol, d, round_even(ln(v) - ln(lag(v) OVER (PARTITION BY key ORDER BY d)), 8) + 0.0 AS log_return FROM closes"""))
def log_returns_query(spark, sf_dir):
    return log_returns(P.closes(spark, sf_dir)).select(F.col("key").alias("symbol"), "d", r(F.col("log_return"), 8).alias("log_return"))


@query("atr14", P.with_views("prices", """t AS (SELECT key, d, row_number() OVER w AS rn, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w),
    0)) AS tr FROM prices WINDOW w AS (PARTITION BY key ORDER BY d))
SELECT key AS symbol, d, round_even(tr, 6) AS true_range, round_even(CASE WHEN rn >= 14 THEN avg(tr) OVER (PARTITION BY key ORDER BY d ROWS 13 PRECEDING) END,
    6) AS atr FROM t"""))
def atr14(spark, sf_dir):
    return atr(P.prices(spark, sf_dir), 14).select(F.col("key").alias("symbol"), "d", r(F.col("tr"), 6).alias("true_range"), r(F.col("atr"), 6).alias("atr"))


@query("fractals", P.with_views("prices", """f AS (SELECT key, d, high, low, max(high) OVER w AS mh, min(low) OVER w AS ml, count(*) OVER w AS n
    FROM prices WINDOW w AS (PARTITION BY key ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT key AS symbol, d, high = mh AS is_high, low = ml AS is_low FROM f WHERE n = 7 AND (high = mh OR low = ml)"""))
def fractals_query(spark, sf_dir):
    return fractals(P.prices(spark, sf_dir), 3).filter("is_high OR is_low").select(F.col("key").alias("symbol"), "d", "is_high", "is_low")


SPREAD = """spread AS (SELECT 'A-N' AS key, a.d, a.v - b.v AS v FROM macro a ASOF JOIN (SELECT last_day(d) AS d, floor(avg(v) * 100 + 0.500001) / 100 AS v
    FROM macro WHERE key = 'N' GROUP BY 1) b ON a.d >= b.d WHERE a.key = 'A')"""


def monthly(spark, sf_dir):
    """A monthly series: the means of a daily one's months, at their last days."""
    return one(P.macro(spark, sf_dir), "N", "A-N").groupBy("key", F.last_day("d").alias("d")).agg(steady(F.avg("v"), 2).alias("v"))


@query("asof_spread", P.with_views("macro", SPREAD + " SELECT d, round_even(v, 7) + 0.0 AS spread FROM spread"))
def asof_spread(spark, sf_dir):
    return spine_spread(one(P.macro(spark, sf_dir), "A", "A-N"), monthly(spark, sf_dir), width=512).select("d", r(F.col("v"), 7).alias("spread"))


@query("asof_events", """SELECT e.event_id, e.value, b.value AS last_purchase, CAST(epoch(date_trunc('second', e.ts)) - epoch(date_trunc('second', b.ts)) AS BIGINT) AS age_seconds
    FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON e.ts >= b.ts""")
def asof_events(spark, sf_dir):
    """Every event beside the last purchase of all users: one series, which slices of a day spread over tasks."""
    events = P.table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.lit("all").alias("key"))
    bought = events.filter("event_type = 'purchase'").groupBy("key", "ts").agg(F.max_by("value", "event_id").alias("bought")).withColumn("at", F.col("ts"))
    out = asof(events.filter("event_type <> 'purchase'"), bought, "ts", "ts", ["bought", "at"], width=86_400)
    return out.select("event_id", "value", F.col("bought").alias("last_purchase"), (F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.col("at").cast("timestamp"))).alias("age_seconds"))


@query("drv_level_pct", P.with_views("prices macro", probes_sql("A", "N", "R") + ", series AS (SELECT * FROM macro), " + LOOK.format(days=504) + PCT.format(sign=-1)))
def drv_level_pct(spark, sf_dir):
    return drivers.level_percentile(probes(spark, sf_dir, "A", "N", "R"), P.macro(spark, sf_dir), bull_when="low")


@query("drv_spread_pct", P.with_views("prices macro", probes_sql("A-N") + f", {SPREAD}, series AS (SELECT * FROM spread), " + LOOK.format(days=504) + PCT.format(sign=1)))
def drv_spread_pct(spark, sf_dir):
    return drivers.series_spread_percentile(probes(spark, sf_dir, "A-N"), one(P.macro(spark, sf_dir), "A", "A-N"), monthly(spark, sf_dir))


def _change_sql(views: str, keys: tuple, source: str, change: str, horizon: int, least: int) -> str:
    return P.with_views(views, probes_sql(*keys) + f""", c AS (SELECT key, d, {change.format(old=f'lag(v, {horizon}) OVER (PARTITION BY key ORDER BY d)')} AS cur,
    row_number() OVER (PARTITION BY key ORDER BY d) AS n FROM {source}),
rows AS (SELECT *, stddev_pop(cur) OVER (PARTITION BY key ORDER BY d) AS sd FROM c), {ATTACH} """ + final(f"tanh(cur / {SD})", "cur", f"n >= {horizon + least}"))


@query("drv_momentum", _change_sql("prices macro", ("A", "N", "R"), "macro", "v - {old}", 21, 20))
def drv_momentum(spark, sf_dir):
    return drivers.momentum(probes(spark, sf_dir, "A", "N", "R"), P.macro(spark, sf_dir))


@query("drv_price_momentum", _change_sql("prices closes", ("ORD_F", "ORD_O", "ORD_P"), "closes", "(v - {old}) / nullif({old}, 0)", 20, 30))
def drv_price_momentum(spark, sf_dir):
    return drivers.price_momentum(probes(spark, sf_dir, "ORD_F", "ORD_O", "ORD_P"), P.closes(spark, sf_dir))


SMA_ROWS = """n AS (SELECT key, d, v, row_number() OVER w AS n, avg(v) OVER (PARTITION BY key ORDER BY d ROWS 199 PRECEDING) AS sma
    FROM closes WINDOW w AS (PARTITION BY key ORDER BY d)),
dev AS (SELECT *, CASE WHEN n >= 200 THEN coalesce((v - sma) / nullif(sma, 0), 0) END AS cur FROM n),
rows AS (SELECT key, d, n, cur, stddev_pop(cur) OVER (PARTITION BY key ORDER BY d ROWS 250 PRECEDING) AS sd FROM dev)"""


@query("drv_price_vs_sma", P.with_views("prices closes", probes_sql("ORD_F", "ORD_O", "ORD_P") + f", {SMA_ROWS}, {ATTACH} " + final(f"tanh(cur / {SD})", "cur", "n >= 201")))
def drv_price_vs_sma(spark, sf_dir):
    return drivers.price_vs_sma(probes(spark, sf_dir, "ORD_F", "ORD_O", "ORD_P"), P.closes(spark, sf_dir))


@query("drv_cot_pct", P.with_views("prices cot", probes_sql("F", "O", "P") + """, nets AS (SELECT key, d + 3 AS d, CASE WHEN open_interest <> 0 THEN (long_spec - short_spec) / open_interest::DOUBLE ELSE long_spec - short_spec END AS net FROM cot),
rows AS (SELECT key, d, list(net) OVER w AS h, net AS cur FROM nets WINDOW w AS (PARTITION BY key ORDER BY d ROWS 155 PRECEDING)), """ + ATTACH + " " + PCT.format(sign=1)))
def drv_cot_pct(spark, sf_dir):
    return drivers.cot_spec_net_percentile(probes(spark, sf_dir, "F", "O", "P"), P.cot(spark, sf_dir))


Z_ROWS = """rows AS (SELECT key, d, v AS cur, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS sd, count(v) OVER w AS n FROM series WINDOW w AS (PARTITION BY key ORDER BY d))"""


@query("drv_ethanol", P.with_views("prices closes macro", probes_sql("X") + f""", series AS (SELECT 'X' AS key, c.d, e.v / b.v / c.v AS v FROM closes c ASOF JOIN (SELECT * FROM macro WHERE key = 'A') e ON c.d >= e.d
ASOF JOIN (SELECT * FROM macro WHERE key = 'R') b ON c.d >= b.d WHERE c.key = 'ORD_O' AND b.v > 0 AND c.v > 0), {Z_ROWS}, {ATTACH} """ + final(f"tanh((cur - mean) / {SD})", "cur", "n >= 20")))
def drv_ethanol(spark, sf_dir):
    m = P.macro(spark, sf_dir)
    return drivers.ethanol_parity(probes(spark, sf_dir, "X"), one(P.closes(spark, sf_dir), "ORD_O", "X"), one(m, "A", "X"), one(m, "R", "X"))


@query("drv_price_ratio", P.with_views("prices closes", probes_sql("F/P") + f""", series AS (SELECT 'F/P' AS key, a.d, a.v / b.v AS v FROM (SELECT * FROM closes WHERE key = 'ORD_F') a ASOF JOIN (SELECT * FROM closes WHERE key = 'ORD_P') b ON a.d >= b.d WHERE b.v <> 0), {Z_ROWS}, {ATTACH} """ + final(f"-tanh((cur - mean) / {SD})", "cur", "n >= 30 AND (SELECT count(*) FROM closes c WHERE c.key = 'ORD_P' AND c.d <= as_of) >= 30")))
def drv_price_ratio(spark, sf_dir):
    c = P.closes(spark, sf_dir)
    return drivers.price_ratio(probes(spark, sf_dir, "F/P"), one(c, "ORD_F", "F/P"), one(c, "ORD_P", "F/P"), bull_when="low")


@query("drv_series_ratio", P.with_views("prices macro", probes_sql("A/R") + """, series AS (SELECT 'A/R' AS key, a.d, a.v / b.v AS v FROM (SELECT * FROM macro WHERE key = 'A') a ASOF JOIN (SELECT *
    FROM macro WHERE key = 'R') b ON a.d >= b.d WHERE b.v <> 0),
last_rows AS (SELECT p.key, p.as_of, arg_max(v, d) AS cur, avg(v) AS mean, stddev_pop(v) AS sd, count(v) AS n
    FROM probes p LEFT JOIN series s ON s.d <= p.as_of AND s.d >= p.as_of - 1825 GROUP BY 1, 2) """ + final(f"tanh((cur - mean) / {SD})", "cur", "n >= 20")))
def drv_series_ratio(spark, sf_dir):
    m = P.macro(spark, sf_dir)
    return drivers.series_ratio(probes(spark, sf_dir, "A/R"), one(m, "A", "A/R"), one(m, "R", "A/R"))


@query("drv_etf_flow", P.with_views("prices etf", probes_sql("ETF") + """, c AS (SELECT key, d, v, lag(v, 63) OVER (PARTITION BY key ORDER BY d) AS old, row_number() OVER (PARTITION BY key ORDER BY d) AS n FROM etf),
c2 AS (SELECT *, (v - old) / nullif(old, 0) AS cur FROM c),
rows AS (SELECT *, stddev_pop(cur) OVER w AS sd, count(cur) OVER w AS m FROM c2 WINDOW w AS (PARTITION BY key ORDER BY d)), """ + ATTACH + " " + final(f"tanh(cur / {SD})", "cur", "n >= 93 AND old > 0 AND m >= 20", 4)))
def drv_etf_flow(spark, sf_dir):
    return drivers.etf_flow(probes(spark, sf_dir, "ETF"), P.etf(spark, sf_dir))


def _season_sql(value: str, roll: str, window: int, exclude: int, score: str, out: str, places: int) -> str:
    return P.with_views("prices weather", probes_sql("F", "O") + f""", s AS (SELECT key, d, {roll}({value}) OVER (PARTITION BY key ORDER BY d ROWS {window - 1} PRECEDING) AS v, row_number() OVER (PARTITION BY key ORDER BY d) AS rn,
    dayofyear(d) AS doy FROM weather),
x AS (SELECT p.key, p.as_of, s.* EXCLUDE (key) FROM probes p ASOF LEFT JOIN s ON p.key = s.key AND p.as_of >= s.d),
last_rows AS (SELECT x.key, x.as_of, any_value(x.v) AS v, any_value(x.rn) AS n_all, avg(o.v) AS mean, stddev_pop(o.v) AS sd, count(o.v) AS n,
    (any_value(x.v) - avg(o.v)) / CASE WHEN coalesce(stddev_pop(o.v), 0) = 0 THEN 1e-9 ELSE stddev_pop(o.v) END AS z
FROM x LEFT JOIN s o ON o.key = x.key AND o.rn <= x.rn - {exclude} AND least(abs(o.doy - x.doy), 366 - abs(o.doy - x.doy)) <= 15 GROUP BY 1, 2) """ + final(score, out, "n_all >= 1095 AND n >= 20", places))


@query("drv_rainfall", _season_sql("precip", "sum", 30, 60, "CASE WHEN month(as_of) IN (3, 4, 5, 6, 7, 8, 9) THEN tanh(abs(z) - 1) ELSE 0 END", "z", 3))
def drv_rainfall(spark, sf_dir):
    return drivers.rainfall_anomaly(probes(spark, sf_dir, "F", "O"), P.weather(spark, sf_dir), active_months=[3, 4, 5, 6, 7, 8, 9])


@query("drv_degree_days", _season_sql("abs((tmax + tmin) / 2 - 18.0)", "sum", 14, 30, "tanh(z)", "z", 3))
def drv_degree_days(spark, sf_dir):
    return drivers.degree_days_anomaly(probes(spark, sf_dir, "F", "O"), P.weather(spark, sf_dir))


@query("drv_frost", _season_sql("tmin", "min", 10, 60, "CASE WHEN v > 10 THEN 0 ELSE tanh(greatest(0.0, -z - 1)) END", "v", 1))
def drv_frost(spark, sf_dir):
    return drivers.frost_anomaly(probes(spark, sf_dir, "F", "O"), P.weather(spark, sf_dir))


@query("drv_seasonal", P.with_views("prices macro", probes_sql("A", "N", "R") + """, s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d) AS rn, dayofyear(d) AS doy FROM macro),
x AS (SELECT p.key, p.as_of, s.* EXCLUDE (key) FROM probes p ASOF JOIN s ON p.key = s.key AND p.as_of >= s.d),
last_rows AS (SELECT p.key, p.as_of, any_value(x.v) AS cur, (SELECT count(*)
    FROM s c WHERE c.key = p.key AND c.d <= p.as_of AND c.d >= p.as_of - 3650) AS held, avg(o.v) AS mean, stddev_pop(o.v) AS sd, count(o.v) AS n
FROM probes p LEFT JOIN x ON x.key = p.key AND x.as_of = p.as_of
    LEFT JOIN s o ON o.key = x.key AND o.rn <= x.rn - 30 AND o.d >= x.as_of - 3650 AND least(abs(o.doy - x.doy), 366 - abs(o.doy - x.doy)) <= 10 GROUP BY 1, 2) """ + final(f"-tanh((cur - mean) / {SD})", "cur", "held >= 365 AND n >= 15", 1)))
def drv_seasonal(spark, sf_dir):
    return drivers.seasonal_anomaly(probes(spark, sf_dir, "A", "N", "R"), P.macro(spark, sf_dir), bull_when="low")


GAMMA = """g AS (SELECT *, (ln(spot / strike) + 0.5 * (iv / 100) * (iv / 100) * years) / ((iv / 100) * sqrt(years)) AS d1
    FROM options WHERE oi > 0 AND iv <> 0 AND strike > 0 AND years > 0),
w AS (SELECT *, exp(-0.5 * d1 * d1) / sqrt(2 * pi()) / (spot * iv / 100 * sqrt(years)) * oi AS w FROM g),
gamma AS (SELECT key, d, round_even(max(spot), 2) AS spot, round_even(sum(CASE WHEN kind = 'C' THEN w ELSE -w END), 4) + 0.0 AS net_gex,
    round_even(sum(w * strike) / sum(w), 2) AS gamma_center FROM w WHERE w > 0 GROUP BY 1, 2)"""


@query("option_gamma", P.with_views("options", GAMMA + " SELECT * FROM gamma"))
def option_gamma_query(spark, sf_dir):
    return drivers.gamma_snapshot(P.options(spark, sf_dir))


@query("drv_gamma", P.with_views("prices options", probes_sql("OPT") + f""", {GAMMA}, rows AS (SELECT * FROM gamma),
last_rows AS (SELECT p.key, p.as_of, x.* EXCLUDE (key) FROM probes p ASOF LEFT JOIN rows x ON p.key = x.key AND p.as_of >= x.d) """ + final("CASE WHEN net_gex > 0 THEN tanh(8 * (gamma_center - spot) / spot) ELSE 0 END", "net_gex", "as_of - d <= 20 AND spot > 0", 2)))
def drv_gamma(spark, sf_dir):
    return drivers.gamma_regime(probes(spark, sf_dir, "OPT"), drivers.gamma_snapshot(P.options(spark, sf_dir)), max_age_days=20)
