"""Token-id files by Re-Pair grammar compression.

A shard holds the ids of some documents in ascending order of doc_id. Re-Pair repeatedly replaces
frequent pairs of neighbouring ids by nonterminals; the shard stores the rules, the expansion
length of each rule, the documents' ids and symbol offsets and the final sequence, so it is read
without anything beside it. No pair crosses a document's end, so any document is decoded without the others.

Each round counts all pairs of the shard, takes the most frequent ones (up to ``per_round``, found
at least ``least`` times) and replaces their occurrences from left to right at once; rounds end
when no pair is that frequent, or after ``rounds`` if given.

Defined results: a null text has only the end id; an empty table gives no shard; rows with equal
doc_id are kept each, side by side, in the order of their texts' hashes; null ids come first; a long text
is a shard by itself at most; extra columns, also of names that differ in case only, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, only, partitions, sliced
from .tokens import batches, coder, default_vocabulary

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sBxxxIIQQQ")  # magic, bytes of a symbol, first nonterminal, rules, documents, symbols, ids


def _frequent(key: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pair keys those that occur ``least`` times or more: the ``most`` most frequent, in order, and the others."""
    held = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1]))) if len(held) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(held)))
    some = times >= least
    pair, times = held[first[some]], times[some]
    if len(pair) <= most:
        return pair, pair[:0]
    chosen = np.zeros(len(pair), bool)
    chosen[np.argsort(-times, kind="stable")[:most]] = True
    return pair[chosen], pair[~chosen]


def _slots(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _places(key: np.ndarray, chosen: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the index of its pair in ``chosen`` or -1, and whether it may be one of ``rest``, by a table of hash slots."""
    bits = max(8, int(2 * len(key)).bit_length())
    table = np.full(1 << bits, -1, np.int32)
    table[_slots(rest, bits)] = -2
    table[_slots(chosen, bits)] = np.arange(len(chosen))
    which = table[_slots(key, bits)]
    maybe = which != -1
    at = np.flatnonzero(which >= 0)
    wrong = at[chosen[which[at]] != key[at]]  # another pair of the slot: looked up by itself
    which[wrong] = -1
    if len(wrong):
        near = np.minimum(np.searchsorted(chosen, key[wrong]), len(chosen) - 1)
        which[wrong] = np.where(chosen[near] == key[wrong], near, -1)
    return which, maybe


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, rounds: int | None = None, per_round: int = 4000, least: int = 8, doc_ids: list | None = None) -> bytes:
    """One shard: ``ids`` of all documents, ``ends`` the position after each document's last id, the documents' own ids.

    After a round a pair can be frequent only if it holds one of the round's nonterminals or was frequent
    before, so only such places are counted again.
    """
    s = ids.astype(np.uint32)
    last = np.zeros(len(s), bool)
    last[ends[ends > 0] - 1] = True
    live = ~last  # places where a frequent pair may begin
    if len(s):
        live[-1] = False
    left: list[np.ndarray] = []
    n_rules = 0
    for _ in count() if rounds is None else range(rounds):
        place = np.flatnonzero(live)
        key = s[place].astype(np.uint64) << np.uint64(32) | s[place + 1]
        pairs, rest = _frequent(key, least, per_round)
        if not len(pairs):
            break
        which, maybe = _places(key, pairs, rest)
        live[place[~maybe]] = False
        at, which = place[which >= 0], which[which >= 0]
        if len(at) > 1:  # in a run of overlapping hits every second one is taken
            new = np.concatenate(([True], np.diff(at) != 1))
            take = (at - at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]) % 2 == 0
            at, which = at[take], which[take]
        s[at] = vocabulary + n_rules + which
        last[at] = last[at + 1]
        live[at] = ~last[at]
        before = at[at > 0] - 1
        live[before] = ~last[before]
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s, last, live = s[keep], last[keep], live[keep]
        live[-1] = False
        left.append(pairs)
        n_rules += len(pairs)
    rules = np.concatenate(left) if left else np.empty(0, np.uint64)
    pair = np.stack(((rules >> np.uint64(32)).astype("<u4"), rules.astype("<u4")), 1) if n_rules else np.empty((0, 2), "<u4")
    length = np.ones(vocabulary + n_rules, np.int64)
    done = vocabulary
    for part in left:  # rules of a round refer to earlier rounds only
        here = pair[done - vocabulary : done - vocabulary + len(part)]
        length[done : done + len(part)] = length[here].sum(1)
        done += len(part)
    width = 2 if vocabulary + n_rules <= 1 << 16 else 4
    stops = np.flatnonzero(last) + 1
    names = list(range(len(ends))) if doc_ids is None else doc_ids
    none = np.packbits(np.array([x is None for x in names], np.uint8))
    head = _HEAD.pack(MAGIC, width, vocabulary, n_rules, len(ends), len(s), len(ids))
    parts = (pair.astype("<u4"), length[vocabulary:].astype("<u4"), stops.astype("<u8"), np.array([x or 0 for x in names], "<i8"), none, s.astype(f"<u{width}"))
    return head + b"".join(x.tobytes() for x in parts)


class Shard:
    """Random access to the documents of one compressed shard, from its bytes alone."""

    def __init__(self, data: bytes):
        magic, width, self.vocabulary, n, self.n_docs, m, self.n_ids = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a grammar-compressed token shard")
        at = _HEAD.size

        def take(kind: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, k, at)
            at += out.nbytes
            return out

        pair = take("<u4", 2 * n).reshape(n, 2).astype(np.int64)
        self.lengths = take("<u4", n).astype(np.int64)
        self.stops = take("<u8", self.n_docs).astype(np.int64)
        names, none = take("<i8", self.n_docs), np.unpackbits(take("u1", -(-self.n_docs // 8)))
        self.doc_ids = [None if x else k for k, x in zip(names.tolist(), none, strict=False)]
        self.symbols = take(f"<u{width}", m)
        self.offsets = np.concatenate(([0], np.cumsum(self.lengths)))
        self.flat = np.empty(self.offsets[-1], np.uint32)
        # A rule's depth is one more than that of the deeper half; all rules of a depth expand at once.
        depth, inner = np.zeros(n, np.int64), pair >= self.vocabulary
        child = np.where(inner, pair - self.vocabulary, 0)
        while n:
            deeper = np.where(inner, depth[child] + 1, 0).max(1)
            if (deeper == depth).all():
                break
            depth = deeper
        for k in range(int(depth.max(initial=-1)) + 1):
            rule = np.flatnonzero(depth == k)
            size = self.lengths[rule]
            stop = np.cumsum(size)
            self.flat[np.repeat(self.offsets[rule] - (stop - size), size) + np.arange(stop[-1])] = self._expand(pair[rule].ravel())[0]

    def _expand(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols, and where each symbol's ids stop."""
        s = s.astype(np.int64)
        rule = s >= self.vocabulary
        which = np.where(rule, s - self.vocabulary, 0)
        size = np.where(rule, self.lengths[which], 1) if len(self.lengths) else np.ones(len(s), np.int64)
        stop = np.cumsum(size)
        out = np.repeat(s, size).astype(np.uint32)
        if rule.any():
            start, size, from_ = (stop - size)[rule], size[rule], self.offsets[which[rule]]
            run = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            out[np.repeat(start, size) + run] = self.flat[np.repeat(from_, size) + run]
        return out, stop

    def document(self, k: int) -> np.ndarray:
        return self._expand(self.symbols[self.stops[k - 1] if k else 0 : self.stops[k]])[0]

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents, and where each document's ids stop."""
        ids, stop = self._expand(self.symbols)
        return ids, stop[self.stops - 1] if len(stop) else stop


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = 2, shard_ids: int = 600_000, n_partitions: int | None = None) -> DataFrame:
    """(shard_id, n_ids, data) in ascending order of doc_id, one row a shard of about ``shard_ids`` ids."""

    def encode(rows):
        from pyspark import TaskContext

        code = coder(vocabulary)
        size, base, k = code.tokenizer.get_vocab_size(), TaskContext.get().partitionId() << 32, 0
        end = np.array([end_id], code.dtype).tobytes()
        keys: list[int | None] = []
        held: list[bytes] = []
        n = 0

        def flush():
            nonlocal keys, held, n, k
            ids = np.frombuffer(b"".join(held), code.dtype)
            ends = np.cumsum([len(x) for x in held]) // code.dtype.itemsize
            row = pa.RecordBatch.from_pydict({"shard_id": [base + k], "n_ids": [len(ids)], "data": [compress(ids, ends, size, doc_ids=keys)]}, schema=out)
            keys, held, n, k = [], [], 0, k + 1
            return row

        pairs = (x for b in sliced(rows) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for part in batches(pairs, 1_000_000):
            for (key, _), ids in zip(part, code([t for _, t in part]), strict=True):
                keys.append(key)
                held.append(ids + end)
                n += len(ids) // code.dtype.itemsize + 1
                if n >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    out = pa.schema([("shard_id", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
    d = only(docs, "doc_id", "text").withColumn("tie", F.xxhash64("text"))  # so that rows of one id can be dealt out too
    d = d.repartitionByRange(n_partitions or partitions(docs.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return materialize(d.mapInArrow(encode, "shard_id long, n_ids long, data binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards alone."""
    # Ids before a shard: those of earlier partitions, which are a row each, and those before it in its own.
    sizes = shards.select("shard_id", "n_ids", F.shiftright("shard_id", 32).alias("part"))
    above = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(above(Window.orderBy("part"))), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("n_ids").over(above(Window.partitionBy("part").orderBy("shard_id"))), F.lit(0))
    before = sizes.select("shard_id", "part", inside.alias("inside")).join(parts, "part").select("shard_id", (F.col("inside") + F.col("ahead")).alias("before"))

    def decode(rows):
        for b in rows:
            for name, data in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                shard = Shard(data)
                ids, stop = shard.documents()
                stop, whole = stop.tolist(), memoryview(ids.astype("<u4")).cast("B")
                start = [0, *stop[:-1]]
                crc = [zlib.crc32(whole[4 * i : 4 * j]) for i, j in zip(start, stop, strict=True)]
                found = ([name] * len(stop), shard.doc_ids, start, np.diff([0, *stop]), crc)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["shard_id", "doc_id", "start", "n_tokens", "ids_crc32"])

    docs = shards.select("shard_id", "data").mapInArrow(decode, "shard_id long, doc_id long, start long, n_tokens long, ids_crc32 long")
    return docs.join(before, "shard_id").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op9_token_ids(spark, sf_dir):
    return read_shards(write_shards(documents(spark, sf_dir), default_vocabulary()))
