"""Benchmark decontamination: a Wu-Manber search for many test strings, over words.

A test string is a window of ten consecutive words of a benchmark item, or the whole of a shorter item. Strings of one
length share a table of shifts: of every block of three words the least distance to a string's end. A search looks at the
block that ends at its position; blocks of no string let it jump ahead by a string's length less two words, so most positions
are never looked at. A block that ends a string (shift 0) has its suffix's bucket in a second table, which tells the prefixes that
the bucket's strings begin with; where the prefix fits too, the position is a candidate.

Tables have a fixed size, whatever the benchmark's (a slot holds the least shift of its blocks, a bit any of its strings), so they
can go to every task; a benchmark that fills them makes the search slower, never wrong. Candidates meet the test strings
in a join on the suffix and the string itself: that is the direct comparison, which settles every candidate. Spark can
split it at a passage that many documents share, as each string is one row of the other side.

Positions of a batch of texts are searched side by side: a step moves all of them, each by its own shift.

Defined results: a null text has no words; a null item has none either; items of one id are one item, and so are items without
id, named by an empty string; repeated rows are judged each; a very long text is searched whole, as stretches that overlap;
other columns, also of names that differ in case only, play no part; an empty benchmark leaves every document clean; an empty
table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK, RangeHash, documents, materialize, mix, modest_batches, only, sliced

#: Words to a test string, and to a block.
WINDOW, BLOCK = 10, 3
#: Slots of a table of shifts and bits of a table of prefixes, as powers of two.
SLOTS, BITS = 20, 24

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_TURN = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Words:
    """The words of some bytes: hashes, and where each begins and ends."""

    def __init__(self, data: bytes):
        self.data, parts, at = data, [], 0
        raw = np.frombuffer(data, np.uint8)
        while at < len(raw):  # in pieces that end outside a word, whose bytes fit the tables of powers
            end = min(len(raw), at + CHUNK)
            while end < len(raw) and _WORD[raw[end]]:
                end += 1
            parts.append((at, *self._piece(raw[at:end])))
            at = end
        self.start = np.concatenate([a + first for a, first, _, _ in parts]) if parts else np.empty(0, np.int64)
        self.end = np.concatenate([a + last for a, _, last, _ in parts]) if parts else np.empty(0, np.int64)
        self.hash = np.concatenate([h for *_, h in parts]) if parts else np.empty(0, np.uint64)

    @staticmethod
    def _piece(raw: np.ndarray):
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = _WORD[raw]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return first, last, mix(RangeHash(_LOWER[raw])(first, last) + (last - first).astype(np.uint64))

    def string(self, at: int, length: int) -> str:
        """Lower-cased words joined by single spaces."""
        parts = [self.data[a:b] for a, b in zip(self.start[at : at + length].tolist(), self.end[at : at + length].tolist(), strict=True)]
        return b" ".join(parts).lower().decode("utf-8", "surrogatepass")  # bytes.lower knows A to Z only


def block_hash(words: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words that end at each position."""
    total = np.full(len(ends), size, np.uint64)
    for k in range(size):
        total += words[ends - k] * _TURN[k]
    return mix(total)


def prefix_bit(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The bit of a string: its suffix's bucket, then its prefix."""
    size = min(BLOCK, length)
    both = block_hash(words, starts + length - 1, size) * _TURN[1] + block_hash(words, starts + size - 1, size)
    return (mix(both) >> np.uint64(64 - BITS)).astype(np.int64)


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS)).astype(np.int64)


class Tables:
    """Shifts and prefixes of the strings of one length."""

    def __init__(self, length: int):
        self.length, self.size = length, min(BLOCK, length)
        self.shift = np.full(1 << SLOTS, length - self.size + 1, np.uint8)
        self.prefix = np.zeros(1 << BITS - 3, np.uint8)

    def search(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where candidates start, within stretches [begin, end) of words."""
        at, found = begins + self.length - 1, []
        while True:
            live = at < ends
            at, ends = at[live], ends[live]
            if not len(at):
                break
            jump = self.shift[slot(block_hash(words, at, self.size))]
            found.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
        if not found:
            return np.empty(0, np.int64)
        starts = np.sort(np.concatenate(found)) - (self.length - 1)
        bit = prefix_bit(words, starts, self.length)
        return starts[(self.prefix[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, length, suffix, string, and what the tables hold of it: bit, and slot and shift of each of its blocks."""
    kinds = {"item": pa.string(), "length": pa.int32(), "suffix": pa.int64(), "string": pa.string(), "bit": pa.int64(), "slots": pa.list_(pa.int64()), "shifts": pa.list_(pa.int32())}

    def run(batches):
        for b in sliced(batches):
            held = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Words((text or "").encode("utf-8", "surrogatepass"))
                n = len(words.hash)
                length = min(window, n)
                size = min(BLOCK, length)
                for i in range(n - length + 1 if n else 0):
                    ends = np.arange(i + size - 1, i + length)
                    hashes = block_hash(words.hash, ends, size)
                    bit = int(prefix_bit(words.hash, np.array([i]), length)[0])
                    held.append((item or "", length, int(hashes[-1].view(np.int64)), words.string(i, length), bit, slot(hashes).tolist(), (i + length - 1 - ends).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    items = only(benchmark, "item_id", "text").select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    return items.mapInArrow(run, "item string, length int, suffix long, string string, bit long, slots array<long>, shifts array<int>")


def tables(strings: DataFrame) -> list[Tables]:
    """A table for each length of test strings, of which there are ten at most. Slots and bits are combined before they are
    brought to the driver: at most 2^20 pairs and 2^21 bytes for each length."""
    out: dict[int, Tables] = {}
    pairs = strings.select("length", F.explode(F.arrays_zip("slots", "shifts")).alias("p")).groupBy("length", F.col("p.slots").alias("slot")).agg(F.min("p.shifts").cast("int").alias("shift"))
    for b in pairs.toArrow().to_batches():
        lengths, slots, shifts = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        for n in np.unique(lengths):
            t = out.setdefault(int(n), Tables(int(n)))
            own = lengths == n
            t.shift[slots[own]] = shifts[own]
    bits = strings.groupBy("length", F.expr("bit div 8").alias("at")).agg(F.bit_or(F.expr("shiftleft(1, CAST(bit % 8 AS int))")).alias("byte"))
    for b in bits.toArrow().to_batches():
        lengths, places, values = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        for n in np.unique(lengths):
            own = lengths == n
            out[int(n)].prefix[places[own]] = values[own]
    return [out[n] for n in sorted(out)]


#: Words to a stretch of a text, and bytes of texts whose stretches are searched side by side.
STRETCH, TOGETHER = 512, 1 << 20


def _groups(texts):
    held, size = [], 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    yield held


def _search(texts: list[bytes], searched: list[Tables]):
    """Counts of words, and the candidates (start, length, suffix, string), of each text."""
    words = Words(b"\0".join(texts))
    place = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(words.start, place)
    found = [[] for _ in texts]
    for t in searched:
        room = np.maximum(np.diff(first) - t.length + 1, 0)
        n = -(-room // STRETCH)
        text = np.repeat(np.arange(len(texts)), n)
        begins = first[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        starts = t.search(words.hash, begins, np.minimum(begins + STRETCH + t.length - 1, first[text + 1]))
        suffixes = block_hash(words.hash, starts + t.length - 1, t.size).view(np.int64).tolist()
        owners = (np.searchsorted(first, starts, "right") - 1).tolist()
        for s, suffix, k in zip(starts.tolist(), suffixes, owners, strict=True):
            found[k].append({"start": s - int(first[k]), "length": t.length, "suffix": suffix, "string": words.string(s, t.length)})
    return np.diff(first), found


def candidates(docs: DataFrame, searched: list[Tables]) -> DataFrame:
    """doc_id, n_words, and ``found``: (start, length, suffix, string) of each candidate."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("suffix", pa.int64()), ("string", pa.string())]))

    def run(batches):
        for b in sliced(batches):
            counts, found = [], []
            for texts in _groups(b.column(1).to_pylist()):
                n, own = _search(texts, searched)
                counts.extend(n.tolist())
                found.extend(own)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_words", "found"])

    texts = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, n_words long, found array<struct<start: long, length: int, suffix: long, string: string>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit (words within an occurrence), items (ids of items that occur, sorted as strings), by document."""
    spark = docs.sparkSession
    with modest_batches(spark):
        strings = materialize(windows(benchmark, window), "test-strings")
        scanned = candidates(docs, tables(strings)).withColumn("row", F.monotonically_increasing_id())
        scanned = materialize(scanned, "candidates")
    each = scanned.select("row", F.explode("found").alias("f")).select("row", "f.*")
    known = strings.select("suffix", "string", "item").distinct()
    hits = each.join(known.select("suffix", "string").distinct(), ["suffix", "string"])
    order = Window.partitionBy("row").orderBy("start", "length")
    end = F.col("start") + F.col("length")
    before = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = hits.groupBy("row", "start").agg(F.max("length").alias("length")).withColumn("end", end)
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), before)))
    covered = spans.groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = hits.select("row", "suffix", "string").distinct().join(known, ["suffix", "string"]).select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = scanned.drop("found").join(covered.join(named, "row"), "row", "left").drop("row")
    return out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def op12_decontamination(spark, sf_dir):
    found = decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def oracle_sql() -> str:
    def words(table, key):
        lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        return f"SELECT row_number() OVER () AS r, {key}, regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"

    return rf"""
WITH d AS ({words("documents", "doc_id")}), b AS ({words("benchmark", "coalesce(CAST(item_id AS VARCHAR), '') AS item")}),
strings AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + n - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM strings),
places AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, lengths, unnest(range(1, len(w) - n + 2)) u(i)),
hits AS (SELECT r, i, n, item FROM places JOIN strings USING (n, s)),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), range({WINDOW}) x(k) WHERE k < n GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
