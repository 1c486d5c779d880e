"""Ingestion steps on DataFrames: upsert, deduplication, reshaping, parsing, key resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .schemas import conform, schema

#: Columns of the report types' speculators and hedgers (fixed values), in the order in which types are tried.
COT_COLUMNS = {
    "disaggregated": ("mm_long", "mm_short", "comm_long", "comm_short"),
    "ice": ("mm_long", "mm_short", "comm_long", "comm_short"),
    "tff": ("lev_funds_long", "lev_funds_short", "dealer_long", "dealer_short"),
    "legacy": ("noncomm_long", "noncomm_short", "comm_long", "comm_short"),
}
PRICE_SCALE = 100_000


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order``: an aggregate that combines before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_")).select(*keys, "_.*").select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_missing: bool = False, order: str = "_seq", deduplicated: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys; of several new rows that with the greatest ``order`` counts.

    Where ``new`` has no such column, the greatest row counts, as rows themselves have no order. ``keep_missing`` keeps the old
    value of a column where the new one is null, so that a partial write doesn't wipe what it doesn't carry.
    """
    rest = [c for c in old.columns if c not in keys]
    if order in new.columns:
        new = latest(new, keys, order).drop(order)
    elif not deduplicated:
        new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_")).select(*keys, "_.*")
    both = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), keys, "full")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if keep_missing else F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*keys, *(pick(c).alias(c) for c in rest)).select(*old.columns)


def trendbars(df: DataFrame, *more: str) -> DataFrame:
    """Bars from a low and unsigned distances from it, in integers, and minutes since the epoch; columns ``more`` are kept."""
    price = lambda c: ((F.col("low") + F.col(c)) / PRICE_SCALE) if c else F.col("low") / PRICE_SCALE
    return df.select(
        "symbol", F.timestamp_seconds(F.col("utcTimestampInMinutes") * 60).alias("ts"), price("deltaOpen").alias("open"), price("deltaHigh").alias("high"), price(None).alias("low"),
        price("deltaClose").alias("close"), F.col("volume").cast("double").alias("volume"), *more,
    )


def macro_observations(payload: DataFrame, json: str = "payload") -> DataFrame:
    """(.., d, v) from ``{"observations": [{"date", "value"}]}``; values that are no number are left out."""
    shape = "struct<observations: array<struct<date: string, value: string>>>"
    rows = payload.select("*", F.inline(F.from_json(json, shape)["observations"]))
    return rows.select(*(c for c in payload.columns if c != json), F.to_date("date").alias("d"), F.expr("try_cast(value AS double)").alias("v")).filter("v IS NOT NULL")


def energy_observations(payload: DataFrame, json: str = "payload") -> DataFrame:
    """(.., d, v) from ``{"response": {"data": [{"period", "value"}]}}``."""
    shape = "struct<response: struct<data: array<struct<period: string, value: string>>>>"
    rows = payload.select("*", F.inline(F.from_json(json, shape)["response"]["data"]))
    return rows.select(*(c for c in payload.columns if c != json), F.to_date(F.substring("period", 1, 10)).alias("d"), F.expr("try_cast(value AS double)").alias("v")).filter("v IS NOT NULL")


def weather_days(payload: DataFrame, json: str = "payload") -> DataFrame:
    """(.., date, tmax, tmin, precip) from parallel arrays; what a short array lacks is null."""
    shape = "struct<daily: struct<time: array<string>, temperature_2m_max: array<double>, temperature_2m_min: array<double>, precipitation_sum: array<double>>>"
    d = F.from_json(json, shape)["daily"]
    rows = payload.select("*", F.inline(F.arrays_zip(d["time"].alias("t"), d["temperature_2m_max"].alias("tmax"), d["temperature_2m_min"].alias("tmin"), d["precipitation_sum"].alias("precip"))))
    return rows.select(*(c for c in payload.columns if c != json), F.to_date("t").alias("date"), "tmax", "tmin", "precip").filter("date IS NOT NULL")


def option_chain(index: DataFrame, summary: DataFrame) -> DataFrame:
    """Contracts (key, d, strike, kind, oi, iv, years, rate, spot) of an index price (key, d, spot) and a book summary
    (key, instrument_name, open_interest, mark_iv, and interest_rate if known)."""
    from ..plans.drivers import parse_instrument

    expiry, strike, kind = parse_instrument(F.col("instrument_name"))
    rate = F.coalesce(F.col("interest_rate").cast("double"), F.lit(0.0)) if "interest_rate" in summary.columns else F.lit(0.0)
    rows = summary.withColumn("expiry", expiry).withColumn("strike", strike).withColumn("kind", kind).withColumn("rate", rate).filter("expiry IS NOT NULL").join(index, "key")
    return rows.select("key", "d", "strike", "kind", F.col("open_interest").alias("oi"), F.col("mark_iv").alias("iv"), (F.datediff("expiry", "d") / 365.0).alias("years"), "rate", "spot")


def option_payloads(index: DataFrame, summary: DataFrame, day: Column) -> DataFrame:
    """The contracts of two JSON answers (key, payload) each: the index price and the book summary of the day."""
    price = F.from_json("payload", "struct<result: struct<index_price: double>>")["result"]["index_price"]
    book = F.from_json("payload", "struct<result: array<struct<instrument_name: string, open_interest: double, mark_iv: double, interest_rate: double>>>")["result"]
    return option_chain(index.select("key", day.alias("d"), price.alias("spot")).filter("spot IS NOT NULL"), summary.select("key", F.inline(book)))


def dix_csv(lines: DataFrame, line: str = "value") -> DataFrame:
    """(d, dix, gex) from the lines of a CSV date,price,dix,gex; a row must parse as a whole, and fields may be quoted."""
    row = F.from_csv(line, "day string, price string, dix string, gex string", {"mode": "PERMISSIVE"})
    number = lambda c: F.expr(f"try_cast(r.{c} AS double)").alias(c)
    out = lines.select(row.alias("r")).select(F.try_to_date("r.day").alias("d"), number("dix"), number("gex"))
    return out.filter("d IS NOT NULL AND dix IS NOT NULL AND gex IS NOT NULL")


def long_series(wide: DataFrame, ids: list[str], names: dict[str, str]) -> DataFrame:
    """One row per named column of ``wide``: (ids, series_id, v)."""
    out = wide.unpivot(ids, list(names), "column", "v")
    label = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return out.select(*ids, label[F.col("column")].alias("series_id"), "v").filter("v IS NOT NULL")


def cot_normalised(reports: dict[str, DataFrame], markets: dict[str, list[str] | dict[str, list[str]]]) -> DataFrame:
    """cot_positions of the first report type, and in it all contracts, that match a market's candidates.

    A market is a list of candidates, or ``{"contracts": candidates, "types": report types in its own order}``.
    """
    wanted = []
    for market, spec in markets.items():
        own = spec if isinstance(spec, dict) else {"contracts": spec}
        kinds = own.get("types") or list(COT_COLUMNS)
        if unknown := set(kinds) - set(COT_COLUMNS):
            raise ValueError(f"{market}: unknown report types {sorted(unknown)}; there are {list(COT_COLUMNS)}")
        wanted += [(market, c.lower(), i, kind, rank) for rank, kind in enumerate(kinds) for i, c in enumerate(own["contracts"])]
    parts = []
    for kind, (ls, ss, lc, sc) in COT_COLUMNS.items():
        if kind in reports:
            numbers = [F.col(c).cast("long").alias(n) for c, n in ((ls, "long_spec"), (ss, "short_spec"), (lc, "long_comm"), (sc, "short_comm"))]
            parts.append(reports[kind].select(F.lit(kind).alias("report_type"), "contract", F.col("report_date").cast("date"), *numbers, F.col("open_interest").cast("long")))
    if not parts:
        raise ValueError(f"no known report type; there are {list(COT_COLUMNS)}")
    rows = reduce(DataFrame.unionByName, parts)
    # One row a market, candidate and type, from the caller's list: small enough to go to every task.
    spec = rows.sparkSession.createDataFrame(wanted, "market string, candidate string, at int, report_type string, rank int")
    rows = rows.join(F.broadcast(spec), (rows["report_type"] == spec["report_type"]) & F.contains(F.lower("contract"), F.col("candidate"))).drop(spec["report_type"])
    first = rows.groupBy("market").agg(F.min("rank").alias("rank"))
    rows = rows.join(first, ["market", "rank"]).withColumn("_order", F.struct("at", "contract"))
    return latest(rows, ["market", "report_date"], "_order").select(*(f.name for f in schema("cot_positions")))


def as_series(table: DataFrame, series_id: str, day: str, value: str) -> DataFrame:
    """One column of a special table (such as the share of a mix) as a macro series."""
    rows = table.select(F.lit(series_id).alias("series_id"), F.col(day).cast("date").alias("date"), F.col(value).cast("double").alias("value"))
    return conform(rows.filter("date IS NOT NULL AND value IS NOT NULL"), "macro_series")


def resolve(values: DataFrame, candidates: list[str], column: str = "value") -> DataFrame:
    """Values that contain a candidate, whatever the case, with the position of the first."""
    wanted = values.sparkSession.createDataFrame([(c.lower(), i) for i, c in enumerate(candidates)], "candidate string, position int")
    return values.select(column).distinct().join(F.broadcast(wanted), F.lower(column).contains(F.col("candidate"))).groupBy(column).agg(F.min("position").alias("position"))


def key_report(present: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """(column, status): wanted keys that are there or missing."""
    p = present.select(column).distinct().withColumn("_there", F.lit(True))
    return wanted.select(column).distinct().join(p, column, "left").select(column, F.when(F.col("_there"), "present").otherwise("missing").alias("status"))


def depth(bars: DataFrame, key: str = "key", day: str = "d") -> DataFrame:
    """(key, first, last, n, years) of each symbol's history."""
    return bars.groupBy(key).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n")).withColumn("years", F.round(F.datediff("last", "first") / 365.25, 2))


def data_version(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, n, lo, hi, total): a fingerprint of each series that changes when its data do."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(day).alias("lo"), F.max(day).alias("hi"), F.sum(value).alias("total"))


def holdings(df: DataFrame) -> DataFrame:
    """(key, d, v): tonnes where they are known, else shares."""
    v: Column = F.coalesce("tonnes_in_trust", "shares_outstanding")
    return df.select(F.col("ticker").alias("key"), F.col("date").alias("d"), v.alias("v")).filter("v IS NOT NULL")


def seed(source: DataFrame, target: str, keys: list[str] | None = None, key: str | None = None, **columns: Column) -> tuple[DataFrame, Observation]:
    """(rows, counted): a filtered copy of ``source`` in the shape of ``target``, and the count that its one write takes on the way."""
    rows = source.filter(F.col(key).isin(keys)) if keys is not None else source
    rows = conform(rows.withColumns(columns) if columns else rows, target)
    counted = Observation()
    return rows.observe(counted, F.count(F.lit(1)).alias("rows_seeded")), counted


def seed_log(spark: SparkSession, source: str, target: str, rows_seeded: int) -> DataFrame:
    """The audit row of a copy."""
    return spark.range(1).select(
        F.lit(source).alias("source_table"), F.lit(target).alias("target_table"), F.lit("").alias("market"), F.lit(rows_seeded).cast("long").alias("rows_seeded"), F.current_timestamp().alias("seeded_at")
    )
