"""Declared schemas and primary keys of the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

#: table -> (schema, primary key)
TABLES = {
    "cot_positions": ("market string, report_date date, report_type string, long_spec long, short_spec long, long_comm long, short_comm long, open_interest long", ("market", "report_date")),
    "prices": ("symbol string, tf string, ts timestamp, open double, high double, low double, close double, volume double", ("symbol", "tf", "ts")),
    "macro_series": ("series_id string, date date, value double", ("series_id", "date")),
    "comex_inventory": ("metal string, date date, registered double, eligible double, total double, units string", ("metal", "date")),
    "weather": ("region string, date date, tmax double, tmin double, precip double, gdd double", ("region", "date")),
    "etf_holdings": ("ticker string, date date, tonnes_in_trust double, shares_outstanding double", ("ticker", "date")),
    "gamma": ("instrument string, date date, spot double, net_gex double, gamma_center double", ("instrument", "date")),
    "seed_log": ("source_table string, target_table string, market string, rows_seeded long, seeded_at timestamp", ("source_table", "target_table", "market")),
}


def schema(name: str) -> T.StructType:
    if name not in TABLES:
        raise KeyError(f"unknown table {name}; there are {sorted(TABLES)}")
    return T.StructType.fromDDL(TABLES[name][0])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the table's columns and types; columns that are not there become null, as after a migration."""
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema(name)))


def table_names() -> list[str]:
    return sorted(TABLES)


def row_count(spark: SparkSession, root: str, name: str) -> int:
    """The rows of a known table; a name that is none of them raises before anything is read."""
    from . import manifest

    return manifest.read(spark, f"{root}/{name}", schema(name)).count()
