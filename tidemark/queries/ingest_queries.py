"""Ingestion steps over the generic tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import ingest, manifest
from ..sources import proxies as P
from ..sources.shared import session_dir


def upsert_latest(spark, sf_dir):
    """Orders' status by customer in a versioned table: later orders replace earlier ones, and a second feed replaces both."""
    o = P.table(spark, sf_dir, "orders").withColumn("order", F.col("o_orderkey"))
    first = o.select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderstatus", "o_totalprice", "order")
    second = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"), "o_orderkey", F.lit("U").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"), "order")
    shape, path = first.drop("order").schema, f"{session_dir(spark)}/versions-{uuid.uuid4().hex}"
    for feed in (first, second):
        manifest.write_upsert(spark, path, feed, shape, ["key"], "order", keep_missing=True)
    return manifest.read(spark, path, shape)


def unpivot_series(spark, sf_dir):
    w = P.weather(spark, sf_dir)
    return ingest.long_series(w.select("key", "d", "tmax", "tmin"), ["key", "d"], {"tmax": "WX_MAX", "tmin": "WX_MIN"})


def key_diff(spark, sf_dir):
    there = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return ingest.key_report(there, P.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")), "custkey")


def key_resolve(spark, sf_dir):
    return ingest.resolve(P.table(spark, sf_dir, "part").select(F.col("p_type").alias("value")), ["brass", "TIN", "e"])


def depth_probe(spark, sf_dir):
    return ingest.depth(P.prices(spark, sf_dir))


def data_version(spark, sf_dir):
    return ingest.data_version(P.table(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("d"), F.col("l_quantity")), "l_returnflag", "d", "l_quantity")


def trendbars(spark, sf_dir):
    o = P.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    coded = o.select(F.col("o_orderstatus").alias("symbol"), (k * 17 % 1_000_000 + 100_000).alias("low"), (k % 97).alias("deltaOpen"), (k % 97 + k % 31).alias("deltaHigh"), (k % 31).alias("deltaClose"), (k % 1000).alias("volume"), (k * 5 + 28_000_000).alias("utcTimestampInMinutes"))
    return ingest.trendbars(coded)


def event_properties(spark, sf_dir):
    """JSON payloads parsed with bad ones dropped: the mean of a property by type."""
    e = P.table(spark, sf_dir, "events").select("event_type", F.from_json("props", "struct<k: double>")["k"].alias("k")).filter("k IS NOT NULL")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


QUERIES = {
    "upsert_latest": upsert_latest, "unpivot_series": unpivot_series, "key_diff": key_diff, "key_resolve": key_resolve, "depth_probe": depth_probe,
    "data_version": data_version, "trendbars": trendbars, "event_properties": event_properties,
}
ORACLE = {
    "upsert_latest": """WITH a AS (SELECT o_custkey AS key, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, arg_max(o_totalprice,
    o_orderkey) AS o_totalprice FROM orders GROUP BY 1),
b AS (SELECT o_custkey AS key, max(o_orderkey) AS o_orderkey
    FROM orders WHERE o_orderpriority = '1-URGENT'
    GROUP BY 1) SELECT a.key, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CASE WHEN b.key IS NULL THEN a.o_orderstatus ELSE 'U' END AS o_orderstatus,
    a.o_totalprice FROM a LEFT JOIN b USING (key)""",
    "unpivot_series": P.with_views("weather", "SELECT key, d, 'WX_MAX' AS series_id, tmax AS v FROM weather UNION ALL SELECT key, d, 'WX_MIN', tmin FROM weather"),
    "key_diff": "SELECT c_custkey AS custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'present' ELSE 'missing' END AS status FROM customer",
    "key_resolve": """SELECT value, CAST(min(position) AS INTEGER) AS position FROM (SELECT DISTINCT p_type AS value
    FROM part), (VALUES ('brass', 0), ('tin', 1), ('e', 2)) c(candidate, position) WHERE contains(lower(value), candidate) GROUP BY 1""",
    "depth_probe": P.with_views("prices", """SELECT key, min(d) AS first, max(d) AS last, count(*) AS n, round((max(d) - min(d)) / 365.25, 2) AS years FROM prices GROUP BY 1"""),
    "data_version": """SELECT l_returnflag, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi, sum(l_quantity) AS total FROM lineitem GROUP BY 1""",
    "trendbars": """SELECT o_orderstatus AS symbol, make_timestamp((o_orderkey * 5 + 28000000) * 60000000) AS ts,
    (o_orderkey * 17 % 1000000 + 100000 + o_orderkey % 97) / 100000 AS open,
    (o_orderkey * 17 % 1000000 + 100000 + o_orderkey % 97 + o_orderkey % 31) / 100000 AS high, (o_orderkey * 17 % 1000000 + 100000) / 100000 AS low,
    (o_orderkey * 17 % 1000000 + 100000 + o_orderkey % 31) / 100000 AS close, CAST(o_orderkey % 1000 AS DOUBLE) AS volume FROM orders""",
    "event_properties": """SELECT event_type, count(*) AS n, sum(k) AS total FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) WHERE k IS NOT NULL GROUP BY 1""",
}
