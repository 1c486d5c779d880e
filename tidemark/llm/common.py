"""Shared pieces of the corpus operators: batches, partition counts, columns by exact name, text hashing."""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize as materialize

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@contextlib.contextmanager
def modest_batches(spark: SparkSession, rows: int = 1000):
    """While it is open, rows go to Python at most ``rows`` at a time, so that whole texts don't fill a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Free memory goes back to the system: a reused Python worker otherwise keeps the most that any task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches, rows: int = 1000):
    """Arrow batches in pieces of at most ``rows``, so that only a piece's texts are Python objects at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, n_bytes: int, each: int = 64 << 20) -> int:
    """How many groups to deal ``n_bytes`` to, so that one of them doesn't grow with the input."""
    return max(partitions(spark), -(-n_bytes // each))


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns called c0, c1 and so on, as names may differ in case only."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place(df: DataFrame, name: str) -> str:
    """What ``plain`` calls the column of exactly this name."""
    return f"c{df.columns.index(name)}"


def only(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names; other columns may differ from them in case only."""
    return plain(df).select(*(F.col(place(df, n)).alias(n) for n in names))


def recounted(made: DataFrame, docs: DataFrame) -> DataFrame:
    """``made`` (c0, c1 ...) under the names of ``docs``, with ``n_chars``, where there is one, that of the text."""
    if "n_chars" in docs.columns:
        n = place(docs, "n_chars")
        made = made.withColumn(n, F.coalesce(F.length(place(docs, "text")).cast(made.schema[n].dataType), F.col(n)))
    return made.toDF(*docs.columns)


# --- hashing of byte ranges -------------------------------------------------------------------
# A polynomial over a random table of byte values, modulo 2^64: prefix sums give the hash of any
# range in constant time, so words, shingles and windows are hashed without Python loops.

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Longer texts are hashed in pieces of this many bytes, so the tables of powers stay small.
CHUNK = 1 << 18


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of ranges [a, b) of one byte array of at most CHUNK bytes and a margin."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * power[:-1], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inverse[a])


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` in order."""
    if len(data) > CHUNK:  # cut at white space; a longer word is hashed as it is
        out, at = [], 0
        while at < len(data):
            end = min(len(data), at + CHUNK)
            while end < len(data) and data[end] not in SPACES:
                end += 1
            out.append(_words(np.frombuffer(data, np.uint8, end - at, at)))
            at = end
        return np.concatenate(out)
    return _words(np.frombuffer(data, np.uint8))


def _words(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return mix(RangeHash(data)(start, end) + (end - start).astype(np.uint64))


_SHINGLE = np.random.default_rng(7).integers(1, 1 << 63, 5, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles of the lower-cased (A-Z) text.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    k = min(words, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        total += w[i : len(w) - k + 1 + i] * (_SHINGLE[i] if i < 5 else _SHINGLE[i % 5] + np.uint64(2 * i))
    out = np.sort(mix(total))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]
