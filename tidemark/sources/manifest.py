"""Versioned tables: a manifest names the files of a version, and an upsert rewrites only the key ranges that it touches.

``_versions/v0000000001.json`` and its followers each name all parts of the table: a folder, the least key in it and its
rows. An upsert reads the parts whose range has new keys, writes them anew beside the old ones, and then creates the next
manifest, which must not be there yet. That one step makes the version: a writer that dies before it leaves files that no
manifest names, and readers, which take the last whole manifest, never see a part of a write. Of two writers one
creates the file; the other finds it there and starts again from the new version. Old files stay until ``vacuum``.

A folder of plain Parquet files without manifests is a table of one part.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import latest, upsert
from .shared import materialize

VERSIONS = "_versions"
PART, PIECE = "tm_part", "tm_piece"


@dataclass
class Manifest:
    """``parts`` are {path, low (the least key as strings, null for the first part of a plain folder), rows}, in key order; ``batches`` the last id by stream."""

    version: int = 0
    parts: list[dict] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def _text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new file; False if there is one already."""
    p, fs = _path(spark, path)
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or "already exists" in str(e.java_exception.getMessage()):
            return False
        raise
    stream.write(text.encode())
    stream.close()
    return True


def current(spark: SparkSession, path: str) -> Manifest:
    """The last whole version."""
    for name in reversed(_names(spark, f"{path}/{VERSIONS}")):
        if found := _readable(spark, f"{path}/{VERSIONS}/{name}"):  # else its writer died, or is at it
            return Manifest(found["version"], found["parts"], found["batches"])
    plain = any(n.endswith(".parquet") for n in _names(spark, path))
    return Manifest(parts=[{"path": "", "low": None, "rows": 0}]) if plain else Manifest()


def _commit(spark: SparkSession, path: str, after: int, made: Manifest, stale_s: float = 60.0) -> bool:
    """Creates the manifest that follows version ``after``; False if another writer was faster.

    A manifest that can't be read yet may be in the making: it is waited for, and passed over when it is ``stale_s`` old.
    A writer that was passed over finds so at its end, and starts again.
    """
    folder = f"{path}/{VERSIONS}"
    while True:
        names = _names(spark, folder)
        if not names or _readable(spark, f"{folder}/{names[-1]}") or _age(spark, f"{folder}/{names[-1]}") > stale_s:
            break
        time.sleep(0.5)
    if current(spark, path).version != after:
        return False
    made.version = max([0, *(int(n[1:-5]) for n in names)]) + 1
    name = f"v{made.version:010d}.json"
    text = json.dumps({"version": made.version, "after": after, "parts": made.parts, "batches": made.batches})
    if not create_once(spark, f"{folder}/{name}", text):
        return False
    p, fs = _path(spark, f"{folder}/{name}")
    for n in _names(spark, folder):
        if n > name and (later := _readable(spark, f"{folder}/{n}")) and later["after"] < made.version:
            fs.delete(p, False)
            return False
    return True


def _readable(spark: SparkSession, path: str) -> dict | None:
    try:
        return json.loads(_text(spark, path))
    except ValueError:
        return None


def _age(spark: SparkSession, path: str) -> float:
    p, fs = _path(spark, path)
    return time.time() - fs.getFileStatus(p).getModificationTime() / 1000


def found(spark: SparkSession, path: str) -> None:
    """The first version of a table: without rows, or with the plain files that are there."""
    _commit(spark, path, 0, current(spark, path))


def _folders(path: str, parts: list[dict]) -> list[str]:
    return [f"{path}/{p['path']}" if p["path"] else f"{path}/*.parquet" for p in parts]


def read(spark: SparkSession, path: str, schema: T.StructType, version: Manifest | None = None) -> DataFrame:
    """The table as of now, or as of a version; a reader keeps its version whatever is written meanwhile."""
    parts = (version or current(spark, path)).parts
    return spark.read.schema(schema).parquet(*_folders(path, parts)) if parts else spark.createDataFrame([], schema)


def _part_of(keys: list[str], schema: T.StructType, parts: list[dict]) -> Column:
    """Which part a row's key falls into: the last one that begins at or before it, or the first."""
    if len(parts) < 2:
        return F.lit(0)
    typed = lambda low: F.struct(*(F.lit(x).cast(schema[k].dataType).alias(k) for k, x in zip(keys, low, strict=True)))
    lows = F.array(*(typed(p["low"]) for p in parts[1:]))  # a manifest's own size: a few values a part
    return F.size(F.filter(lows, lambda low: low <= F.struct(*keys)))


def write_upsert(
    spark: SparkSession, path: str, new: DataFrame, schema: T.StructType, keys: list[str], order: str | None = None, keep_missing: bool = False, batch: tuple[str, int] | None = None,
    rows_per_part: int = 1_000_000, tries: int = 10,
) -> Manifest:
    """Rows of ``new`` in place of those with their keys; of new rows with one key that with the greatest ``order`` counts.

    ``batch`` (stream, id) is noted with the version: a batch that comes again, after a restart, changes nothing.
    """
    fresh = None
    for _ in range(tries):
        base = current(spark, path)
        if batch and base.batches.get(batch[0], -1) >= batch[1]:
            return base
        if fresh is None:
            fresh = materialize(latest(new, keys, order) if order else _any_of(new, keys), "upsert")
            n = fresh.count()
        batches = base.batches | ({batch[0]: batch[1]} if batch else {})
        if n == 0 and not batch:
            return base
        placed = fresh.withColumn(PART, _part_of(keys, schema, base.parts))
        touched = sorted(r[0] for r in placed.select(PART).distinct().collect())  # numbers of parts
        mine = [base.parts[i] for i in touched if i < len(base.parts)]
        out = f"data-{uuid.uuid4().hex}"
        parts = list(base.parts)
        if n:
            old = spark.read.schema(schema).parquet(*_folders(path, mine)) if mine else spark.createDataFrame([], schema)
            merged = upsert(old, fresh.select(*schema.names), keys, keep_missing, deduplicated=True).withColumn(PART, _part_of(keys, schema, base.parts))
            pieces = math.ceil((n + sum(p["rows"] for p in mine)) / rows_per_part)
            if pieces > 2 * max(1, len(touched)):  # a load: ranges of it
                merged = merged.repartitionByRange(pieces, PART, *keys).withColumn(PIECE, F.spark_partition_id())
            else:
                rank = F.row_number().over(Window.partitionBy(PART).orderBy(*keys)) - 1
                merged = merged.withColumn(PIECE, F.floor(rank / rows_per_part).cast("int")).repartition(PART, PIECE)
            merged.sortWithinPartitions(PART, PIECE, *keys).write.partitionBy(PART, PIECE).parquet(f"{path}/{out}")
            made = spark.read.parquet(f"{path}/{out}").groupBy(PART, PIECE).agg(F.min(F.struct(*keys)).alias("low"), F.count("*").alias("rows"))
            rows = made.select(PART, PIECE, F.array(*(F.col(f"low.{k}").cast("string") for k in keys)).alias("low"), "rows").collect()  # a row a part
            made_parts: dict[int, list[dict]] = {}
            for x in sorted(rows, key=lambda x: (x[PART], x[PIECE])):
                made_parts.setdefault(x[PART], []).append({"path": f"{out}/{PART}={x[PART]}/{PIECE}={x[PIECE]}", "low": list(x["low"]), "rows": x["rows"]})
            parts = [q for i in range(max(1, len(base.parts))) for q in (made_parts.get(i) or ([base.parts[i]] if i < len(base.parts) and i not in touched else []))]
        result = Manifest(parts=parts, batches=batches)
        if _commit(spark, path, base.version, result):
            return result
        p, fs = _path(spark, f"{path}/{out}")
        fs.delete(p, True)
    raise RuntimeError(f"{path}: other writers were faster {tries} times")


def _any_of(new: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key; of several the greatest, as no order is known."""
    rest = [c for c in new.columns if c not in keys]
    return new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_")).select(*keys, "_.*").select(*new.columns)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes data that none of the last ``keep`` versions names, and older manifests; how many folders went."""
    names = [n for n in _names(spark, f"{path}/{VERSIONS}") if n.startswith("v")]
    used: set[str] = set()
    for n in names[-keep:]:
        used |= {p["path"].split("/")[0] for p in (_readable(spark, f"{path}/{VERSIONS}/{n}") or {"parts": []})["parts"]}
    gone = 0
    if not names:
        return 0
    for n in _names(spark, path):
        if n.startswith("data-") and n not in used or n.endswith(".parquet") and "" not in used:
            p, fs = _path(spark, f"{path}/{n}")
            gone += fs.delete(p, True)
    for n in names[:-keep]:
        p, fs = _path(spark, f"{path}/{VERSIONS}/{n}")
        fs.delete(p, False)
    return gone
