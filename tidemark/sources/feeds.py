"""What to ask servers for, and what becomes of the answers: series, regions, option chains and CSV files into the store."""

from __future__ import annotations

import datetime as dt
import json
import urllib.parse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest, rest, store
from .shared import materialize

#: Series that are fetched where none are named (fixed values).
DEFAULT_SERIES = ["DGS10", "DGS2", "T10YIE", "DTWEXBGS", "DEXUSEU", "DEXBZUS", "IRLTLT01DEM156N"]
#: Latitude and longitude of the weather regions (fixed values).
REGIONS = {
    "brazil_cs_cane": (-21.17, -47.81), "brazil_sul_minas": (-21.55, -45.43), "us_gas_demand": (41.85, -87.65), "us_cornbelt": (41.59, -93.62),
    "us_wheat_plains": (37.69, -97.34), "west_africa_cocoa": (6.88, -6.45), "us_cotton": (33.58, -101.86),
}
KINDS = ("macro", "energy", "weather", "options", "squeeze")


def _with(url: str, **query) -> str:
    return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(query)}"


def region(name: str) -> tuple[str, float, float]:
    """A known region, or one of one's own as ``name=latitude:longitude``."""
    own, _, place = name.partition("=")
    if place:
        lat, lon = place.split(":")
        return own, float(lat), float(lon)
    if own not in REGIONS:
        raise KeyError(f"unknown region {own}; there are {sorted(REGIONS)}, and name=latitude:longitude")
    return own, *REGIONS[own]


def requests(kind: str, url: str, keys: list[str] | None = None, start: str = "2000-01-01", end: str | None = None, api_key: str | None = None) -> list[tuple[str, str]]:
    """(key, address) of every call. An address with {key} is taken as it is written; otherwise the kind's usual query is added."""
    if kind not in KINDS:
        raise KeyError(f"unknown kind {kind}; there are {KINDS}")
    end = end or dt.date.today().isoformat()
    if kind == "squeeze":
        return [("squeeze", url)]
    if kind == "options":
        base, cash = url.rstrip("/"), keys or ["BTC", "ETH"]
        names = [k.partition("=")[0] for k in cash]
        index = [(f"index/{k}", _with(f"{base}/get_index_price", index_name=f"{k.lower()}_usd")) for k in names]
        return index + [(f"book/{k}", _with(f"{base}/get_book_summary_by_currency", currency=k, kind="option")) for k in names]
    out = []
    for key in keys or {"macro": DEFAULT_SERIES, "energy": list(rest.ENERGY_SERIES), "weather": list(REGIONS)}[kind]:
        if kind == "weather":
            name, lat, lon = region(key) if "{key}" not in url else (key, 0.0, 0.0)
            usual = {"latitude": lat, "longitude": lon, "start_date": start, "end_date": end, "daily": "precipitation_sum,temperature_2m_max,temperature_2m_min", "timezone": "UTC"}
        else:
            name, usual = key, {"series_id": key, "api_key": api_key or "", "file_type": "json", "observation_start": start}
        if "{key}" in url:
            out.append((name, url.replace("{key}", urllib.parse.quote(name)).replace("{start}", start).replace("{end}", end).replace("{api_key}", api_key or "")))
        else:
            out.append((name, rest.energy_url(url, key, api_key or "", start) if kind == "energy" else _with(url, **usual)))
    return out


def answers(spark: SparkSession, calls: list[tuple[str, str]], **options: str) -> DataFrame:
    """(key, payload) of the calls, made as the frame is run. Addresses may hold keys, so the option's name is one that Spark redacts."""
    spark.dataSource.register(rest.JsonRest)
    return spark.read.format("json_rest").options(**{"requests.secret": json.dumps(calls)}, **options).load()


def rows_of(kind: str, payloads: DataFrame, day: str | None = None, keys: list[str] | None = None) -> tuple[str, DataFrame]:
    """The table that a kind's answers belong to, and its rows."""
    if kind in ("macro", "energy"):
        parse = ingest.macro_observations if kind == "macro" else ingest.energy_observations
        return "macro_series", parse(payloads).withColumnsRenamed({"key": "series_id", "d": "date", "v": "value"})
    if kind == "weather":
        return "weather", ingest.weather_days(payloads).withColumnRenamed("key", "region")
    if kind == "squeeze":
        lines = payloads.select(F.explode(F.split("payload", r"\r?\n")).alias("value"))
        series = ingest.long_series(ingest.dix_csv(lines), ["d"], {"dix": "SQZ_DIX", "gex": "SQZ_GEX"})
        return "macro_series", series.withColumnsRenamed({"d": "date", "v": "value"})
    from ..plans.drivers import gamma_snapshot

    names = dict(k.split("=", 1) for k in keys or [] if "=" in k)
    part = lambda name: payloads.filter(F.col("key").startswith(f"{name}/")).withColumn("key", F.substring("key", len(name) + 2, 100))
    taken = F.lit(day or dt.datetime.now(dt.UTC).date().isoformat()).cast("date")
    snapshot = gamma_snapshot(ingest.option_payloads(part("index"), part("book"), taken))
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("key")], F.col("key")) if names else F.col("key")
    return "gamma", snapshot.withColumn("instrument", named).withColumnRenamed("d", "date")


def fetch(spark: SparkSession, root: str, kind: str, url: str, keys: list[str] | None = None, start: str = "2000-01-01", api_key: str | None = None, day: str | None = None) -> int:
    """Asks a server and upserts what it says; the number of rows. Answers are kept first, so no call is made twice."""
    store.create(spark, root)
    payloads = materialize(answers(spark, requests(kind, url, keys, start, api_key=api_key)), "answers")
    target, rows = rows_of(kind, payloads, day, keys)
    rows = materialize(rows, "fetched")
    store.put(spark, root, target, rows, keep_missing=True)
    return rows.count()
