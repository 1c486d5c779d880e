"""Bars of a price feed that something else has landed as files, brought into the store.

A landed file has a page of bars a line: ``{"symbol": .., "tf": .., "trendbar": [{"utcTimestampInMinutes": .., "low": ..,
"deltaOpen": .., "deltaHigh": .., "deltaClose": .., "volume": ..}]}``, numbers left out being zero. Which files have been
read is the stream's own checkpoint, so a call after a failure goes on where the last one stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ingest, store

BAR = ("utcTimestampInMinutes", "low", "deltaOpen", "deltaHigh", "deltaClose", "volume")
PAGE = f"symbol string, tf string, trendbar array<struct<{', '.join(f'{c}: long' for c in BAR)}>>"


def bars(pages: DataFrame) -> DataFrame:
    """The pages' bars as rows of ``prices`` with ``_seq``, by which the bar of the file landed last is the greatest."""
    landed = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    each = pages.select("symbol", F.coalesce("tf", F.lit("D1")).alias("tf"), landed.alias("_seq"), F.explode("trendbar").alias("b"))
    each = each.select("symbol", "tf", "_seq", "b.utcTimestampInMinutes", *(F.coalesce(f"b.{c}", F.lit(0)).alias(c) for c in BAR[1:]))
    each = each.filter("symbol IS NOT NULL AND utcTimestampInMinutes IS NOT NULL")
    return ingest.trendbars(each, "tf", "_seq")


def land(spark: SparkSession, root: str, folder: str, files_at_once: int = 1000) -> None:
    """Upserts the bars of the files that came to ``folder`` since the last call."""
    store.create(spark, root)
    pages = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_at_once).json(folder)
    write = store.batches(root, "prices", f"landed {folder}", order="_seq")
    query = bars(pages).writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/_landed").trigger(availableNow=True).start()
    query.awaitTermination()
