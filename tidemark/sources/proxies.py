"""Views of the engine's input tables over the generic tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the orders: a row per status and day, from which prices and positions follow."""
    p, k, urgency = F.col("o_totalprice"), F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("d")).agg(
        F.min_by(p, k).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, k).alias("close"), F.count("*").alias("volume"),
        F.count_if(urgency.isin("1", "2")).alias("long_spec"), F.count_if(urgency.isin("4", "5")).alias("short_spec"),
    )


def lines_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the line items: a row per flag, status and day, from which macro series, weather and holdings follow."""
    q, cents = F.col("l_quantity"), F.round(F.col("l_extendedprice") * 100).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.to_date("l_shipdate").alias("d")).agg(
        F.sum(cents).alias("cents"), F.count("*").alias("n"), F.max(q).alias("tmax"), F.min(q).alias("tmin"), F.sum(q).alias("q")
    )


def prices(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """(key, d, open, high, low, close, volume): a bar per order status and day."""
    daily = orders_daily(spark, sf_dir) if daily is None else daily
    return daily.select(F.concat(F.lit("ORD_"), "status").alias("key"), "d", "open", "high", "low", "close", "volume")


def closes(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    return prices(spark, sf_dir, daily).select("key", "d", F.col("close").alias("v"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ts, open, high, low, close, volume): a bar per event type and hour."""
    v, k = F.col("value"), F.col("event_id")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by(v, k).alias("open"), F.max(v).alias("high"), F.min(v).alias("low"), F.max_by(v, k).alias("close"), F.count("*").alias("volume")
    )


def macro(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    daily = lines_daily(spark, sf_dir) if daily is None else daily
    return daily.groupBy(F.col("flag").alias("key"), "d").agg((F.sum("cents") / F.sum("n") / 100.0).alias("v"))


def cot(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    daily = orders_daily(spark, sf_dir) if daily is None else daily
    week = F.to_date(F.date_trunc("week", "d"))
    return daily.groupBy(F.col("status").alias("key"), week.alias("d")).agg(F.sum("long_spec").alias("long_spec"), F.sum("short_spec").alias("short_spec"), F.sum("volume").alias("open_interest"))


def weather(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    daily = lines_daily(spark, sf_dir) if daily is None else daily
    return daily.groupBy(F.col("status").alias("key"), "d").agg(F.max("tmax").alias("tmax"), F.min("tmin").alias("tmin"), (F.sum("q") / F.sum("n")).alias("precip"))


def etf(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    daily = lines_daily(spark, sf_dir) if daily is None else daily
    day = daily.groupBy(F.lit("ETF").alias("key"), "d").agg(F.sum("q").alias("q"))
    return day.select("key", "d", F.sum("q").over(Window.partitionBy("key").orderBy("d")).alias("v"))


def environment(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables by kind, and ``bars``. Orders and line items are read once each, to daily rows that are kept as files."""
    orders, lines = materialize(orders_daily(spark, sf_dir), "orders-daily"), materialize(lines_daily(spark, sf_dir), "lines-daily")
    return {
        "bars": prices(spark, sf_dir, orders), "closes": closes(spark, sf_dir, orders), "cot": cot(spark, sf_dir, orders),
        "macro": macro(spark, sf_dir, lines), "weather": weather(spark, sf_dir, lines), "etf": etf(spark, sf_dir, lines),
    }


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts (key, d, strike, kind, oi, iv, years, spot), a month of them a chain."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_linestatus", "l_quantity", "l_discount", "l_linenumber")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return line.join(part, "l_partkey").select(
        F.lit("OPT").alias("key"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("d"), F.col("p_retailprice").alias("strike"), F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("kind"),
        F.col("l_quantity").alias("oi"), (20 + 100 * F.col("l_discount")).alias("iv"), (F.col("l_linenumber") / 12.0).alias("years"), F.lit(950.0).alias("spot"),
    )


#: The same views for SQL; a query lists those it needs.
SQL = {
    "prices": """SELECT 'ORD_' || o_orderstatus AS key, CAST(o_orderdate AS DATE) AS d, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY 1, 2""",
    "closes": "SELECT key, d, close AS v FROM prices",
    "macro": """SELECT l_returnflag AS key, CAST(l_shipdate AS DATE) AS d, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / count(*) / 100.0::DOUBLE AS v
    FROM lineitem GROUP BY 1, 2""",
    "cot": """SELECT o_orderstatus AS key, CAST(date_trunc('week', o_orderdate) AS DATE) AS d, count(*) FILTER (o_orderpriority[1] IN ('1', '2')) AS long_spec,
    count(*) FILTER (o_orderpriority[1] IN ('4', '5')) AS short_spec, count(*) AS open_interest FROM orders GROUP BY 1, 2""",
    "weather": """SELECT l_linestatus AS key, CAST(l_shipdate AS DATE) AS d, max(l_quantity) AS tmax, min(l_quantity) AS tmin, sum(l_quantity) / count(*) AS precip
    FROM lineitem GROUP BY 1, 2""",
    "etf": "SELECT 'ETF' AS key, d, sum(q) OVER (ORDER BY d) AS v FROM (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_quantity) AS q FROM lineitem GROUP BY 1)",
    "options": """SELECT 'OPT' AS key, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, p_retailprice AS strike, CASE WHEN l_linestatus = 'O' THEN 'C' ELSE 'P' END AS kind,
    l_quantity AS oi, 20 + 100 * l_discount AS iv, l_linenumber / 12.0::DOUBLE AS years, 950.0::DOUBLE AS spot FROM lineitem JOIN part ON l_partkey = p_partkey""",
}


def with_views(names: str, body: str) -> str:
    """``body`` after the named views; ``prices`` comes along with what needs it."""
    need = names.split()
    if "closes" in need and "prices" not in need:
        need.insert(0, "prices")
    recursive = "RECURSIVE " if "walk AS (" in body else ""
    return f"WITH {recursive}" + ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in need) + ("," if body.lstrip()[:6].upper() != "SELECT" else "") + "\n" + body
