"""The store of parquet tables as the keyed frames that plans take, and read-only copies of other databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest
from .ingest import holdings
from .schemas import TABLES, conform, schema


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return manifest.read(spark, f"{root}/{name}", schema(name))


def external(spark: SparkSession, url: str, name: str, column: str | None = None, bounds: tuple | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of another database, which is only read; with ``column`` and its ``bounds`` in ``parts`` stretches at once."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if column is not None:
        low, high = bounds
        reader = reader.option("partitionColumn", column).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", str(parts))
    return reader.load()


def environment(spark: SparkSession, root: str, tf: str = "D1") -> dict[str, DataFrame]:
    """Bars, closes and the drivers' series by kind: (key, d, ...), rows without a value left out."""
    p = table(spark, root, "prices").filter(F.col("tf") == tf)
    bars = p.select(F.col("symbol").alias("key"), F.to_date("ts").alias("d"), "open", "high", "low", "close", "volume")
    series = lambda name, key, day, *values: table(spark, root, name).select(F.col(key).alias("key"), F.col(day).alias("d"), *values)
    return {
        "bars": bars, "closes": bars.select("key", "d", F.col("close").alias("v")),
        "macro": series("macro_series", "series_id", "date", F.col("value").alias("v")).filter("v IS NOT NULL"),
        "cot": series("cot_positions", "market", "report_date", "long_spec", "short_spec", "open_interest").filter("long_spec IS NOT NULL AND short_spec IS NOT NULL"),
        "weather": series("weather", "region", "date", "tmax", "tmin", "precip"), "etf": holdings(table(spark, root, "etf_holdings")),
        "gamma": series("gamma", "instrument", "date", "spot", "net_gex", "gamma_center"),
    }


def create(spark: SparkSession, root: str) -> None:
    """Empty tables where there are none yet."""
    for name in TABLES:
        path = f"{root}/{name}"
        if not manifest.current(spark, path).version:
            manifest.found(spark, path)


def put(spark: SparkSession, root: str, name: str, rows: DataFrame, keep_missing: bool = False, order: str | None = None, batch: tuple[str, int] | None = None) -> manifest.Manifest:
    """Upserts rows into a table of the store as its next version; see ``manifest``."""
    own = conform(rows, name)
    if order and order not in own.columns:
        own = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name)), order)
    return manifest.write_upsert(spark, f"{root}/{name}", own, schema(name), list(TABLES[name][1]), order, keep_missing, batch)


def batches(root: str, name: str, stream: str, order: str | None = None):
    """For ``foreachBatch``: upserts each batch of ``stream`` into a table once, also when it comes again after a restart."""

    def apply(rows: DataFrame, n: int) -> None:
        put(rows.sparkSession, root, name, rows, order=order, batch=(stream, n))

    return apply
