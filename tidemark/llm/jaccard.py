"""N-gram Jaccard join by parity sketches, and the components of its links.

Documents are sets of word shingles. Two sets of a and b shingles with Jaccard similarity of at least
t differ in at most (a + b)(1 - t)/(1 + t) shingles. That bounds how far their parity sketches lie apart:

* Block sketch: each shingle falls into one of a size band's blocks by its hash, and a block's word is
  the XOR of its shingles' hashes. A differing shingle changes one word, so similar sets with at most
  k differences agree in all but k words. By the pigeonhole principle two similar sets share a word
  among any k + 1 words of each, if both take the first in one common order. The order used is by
  rarity over the corpus: words of one document come first and match nothing, common passages last.
* Bit sketch: each shingle flips one of 2,048 bits. The Hamming distance of two sketches is at most the
  number of differing shingles, which sieves candidates before the exact check on full sets.

Bands are powers of two of the larger set's size; a set takes part in those that a partner may have.

Links serve components here, so copies are never expanded into all pairs: equal sets are one node;
sharers of a word are first compared with one of them, and after components are known, only those
pairs of sharers that are still apart. Every pair that shares a word is thus compared or connected.

Words travel as packed arrays by hash bucket, in as many buckets as the text's size asks for; of each
document only shared words of low rank become rows. Bit sketches lie beside the facts and are read for
candidates only. Copies are found by an aggregate that combines before its shuffle, and what is joined
by a set's hash is the table of sets with copies. Joins are equalities that Spark splits at hot keys.

Defined results: null and empty texts, and texts without words, have empty sets and link with nothing;
rows are nodes, also with equal or null doc_id; a component's id is its least doc_id (null if it has
none); other columns, also of names that differ in case only, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets, documents, give_back, materialize, mix, modest_batches, only, place, plain, shingle_set, sliced
from .substrings import by_bucket, doc_bucket, joined, pack, spread, unpack

FIRST = 32  # in the lowest band each shingle is a block
BITS = 2048
FLUSH = 200_000  # words that a task holds before it deals them out


def blocks(top: int) -> int:
    """Blocks of a band whose sets have up to ``top`` shingles: enough that few sets leave too many empty."""
    return top if top <= 128 else int(0.6 * top) if top <= 512 else top // 2


class Measure:
    """Jaccard similarity of at least ``percent`` in the hundred, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def largest(self, n: int) -> int:
        """The largest set that a set of ``n`` can be similar to."""
        return n * 100 // self.percent

    def differences(self, total: int) -> int:
        """How many elements similar sets of ``total`` elements together can differ in."""
        return total * (100 - self.percent) // (100 + self.percent)


def block_words(s: np.ndarray, measure: Measure, seed: int = 0) -> list[tuple[int, np.ndarray, int]]:
    """(band, words, slack) of a sorted set: ``slack`` of the words may be left out."""
    n, out = len(s), []
    top = FIRST
    while top < n:
        top *= 2
    while n:
        if top == FIRST:
            words = s
        else:
            at = (s >> np.uint64(32)) * np.uint64(blocks(top)) >> np.uint64(32)  # rises with the hash
            start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            words = np.bitwise_xor.reduceat(mix(s + np.uint64(seed + 1)), start) + at[start] * np.uint64(0xD6E8FEB86659FD93)
        slack = len(words) - measure.differences(n + min(top, measure.largest(n))) - 1
        out.append((top, mix(words + np.uint64(top)), slack))
        if measure.largest(n) <= top:
            return out
        top *= 2
    return out


def bit_sketch(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


_PART = "bucket int, kind int, data binary"
_ROW = "kind int, node long, word long, n int, f0 long, f1 long, sketch array<long>, weak int, own int"
WORDS, SETS = 0, 1


def _parts(found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([b for b, *_ in found], pa.int32()), pa.array([k for _, k, _ in found], pa.int32()), pa.array([d for *_, d in found], pa.binary())], names=["bucket", "kind", "data"])


def _sketch(rows, n: int, words: int, measure: Measure, seed: int):
    """Documents -> packed words by hash bucket, packed sets' facts by document bucket."""
    keys: list[np.ndarray] = []
    facts: list[tuple] = []
    seen: set[bytes] = set()
    size = 0

    def flush():
        nonlocal keys, facts, size
        node, count, f, weak, own, sketch = (np.array(x) for x in zip(*facts, strict=True))
        node, f = node.astype(np.int64), np.frombuffer(f.tobytes(), np.int64).reshape(-1, 2)
        columns = [node, count.astype(np.uint32), f[:, 0], f[:, 1], weak.astype(np.uint8), own.astype(np.uint8), *sketch.astype(np.int64).T]
        found = [(b, SETS, pack(*x)) for b, x in by_bucket(doc_bucket(node, n), *columns)]
        if keys:
            w, doc, band, slack = (np.concatenate(x) for x in zip(*keys, strict=True))
            found += [(b, WORDS, pack(*x)) for b, x in by_bucket(spread(w, n), w.astype(np.uint32), (w >> np.uint64(32)).astype(np.uint8), doc, band, slack)]
        keys, facts, size = [], [], 0
        return _parts(found)

    for b in sliced(rows):
        for node, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = shingle_set(text, words)
            f = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            made = block_words(s, measure, seed)
            facts.append((node, len(s), np.void(f), min((x for *_, x in made), default=0) < 0, f not in seen, bit_sketch(s)))
            size += 20
            if f in seen:
                continue  # a copy in this task: the first has the words of all
            seen.add(f)
            for top, w, slack in made:
                keys.append((w, np.full(len(w), node, np.int64), np.full(len(w), top.bit_length(), np.uint8), np.full(len(w), min(max(slack, 0), 65535), np.uint16)))
                size += len(w)
            if size > FLUSH:
                yield flush()
                give_back()
    if facts:
        yield flush()
    give_back()


def _shared(kinds: list[int], rows: list[bytes], bucket: int, n: int):
    """Of one hash bucket's words those that several sets have, by document bucket."""
    yield from ((bucket, SETS, d) for k, d in zip(kinds, rows, strict=True) if k == SETS)
    rows = [d for k, d in zip(kinds, rows, strict=True) if k == WORDS]
    if not rows:
        return
    low, high, doc, band, slack = joined(rows)
    w = high.astype(np.int64) << 32 | low
    order = np.argsort(w, kind="stable")
    v = w[order]
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    count = np.repeat(c := np.diff(np.append(start, len(v))), c)
    order, count = order[count > 1], count[count > 1]
    doc = doc[order]
    yield from ((b, WORDS, pack(*x)) for b, x in by_bucket(doc_bucket(doc, n), (bucket << 40) | w[order], doc, band[order], slack[order], count.astype(np.uint32)))


def _lowest(kinds: list[int], rows: list[bytes]) -> pa.Table:
    """Of one document bucket: the facts of each set, and its shared words that are rare enough to count."""
    facts = [unpack(d) for k, d in zip(kinds, rows, strict=True) if k == SETS]
    words = [d for k, d in zip(kinds, rows, strict=True) if k == WORDS]
    names = [x.split()[0] for x in _ROW.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32()}.get(x.split()[1], pa.list_(pa.int64())) for x in _ROW.split(", ")]
    out = []

    def table(columns: dict, m: int):
        return pa.table([columns[c].cast(t) if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(m, t) for c, t in zip(names, types, strict=True)], names=names)

    if facts:
        node, count, f0, f1, weak, own, *sketch = (np.concatenate(x) for x in zip(*facts, strict=True))
        bits = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * len(sketch)), pa.array(np.stack(sketch, 1).ravel()))
        out.append(table({"kind": np.full(len(node), SETS), "node": node, "n": count.astype(np.int32), "f0": f0, "f1": f1, "weak": weak.astype(np.int32), "own": own.astype(np.int32), "sketch": bits}, len(node)))
    if words:
        w, doc, band, slack, count = joined(words)
        order = np.lexsort((w, count, band, doc))[::-1]  # the commonest first
        w, doc, band, slack = w[order], doc[order], band[order], slack[order]
        start = np.concatenate(([True], (doc[1:] != doc[:-1]) | (band[1:] != band[:-1])))
        rank = np.arange(len(w)) - np.maximum.accumulate(np.where(start, np.arange(len(w)), 0))
        keep = rank >= slack
        out.append(table({"kind": np.full(keep.sum(), WORDS), "node": doc[keep], "word": w[keep]}, int(keep.sum())))
    return pa.concat_tables(out) if out else table({}, 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of (a, b) edges; the root is the component's least node."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        hooked = now.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        # Labels of labels: paths halve with each round.
        up = now.select(F.col("node").alias("mid"), F.col("root").alias("top"))
        then = materialize(hooked.join(up, "mid").select("node", F.least("mid", "top").alias("root"), (F.least("mid", "top") != F.col("old")).alias("moved")), "roots")
        now = then.drop("moved")
        if then.filter("moved").isEmpty():
            return now


class Join:
    """Nodes, their facts and shared words for one table; ``nodes`` has (node, text), some ``n_bytes`` of it."""

    def __init__(self, nodes: DataFrame, words: int, percent: int, n_bytes: int = 0):
        self.nodes, self.words, self.measure = nodes, words, Measure(percent)
        spark, measure = nodes.sparkSession, self.measure
        n = buckets(spark, n_bytes, 16 << 20)
        for seed in range(100):

            def start(rows, seed=seed):
                return _sketch(rows, n, words, measure, seed)

            def shared(key, table):
                out = pa.Table.from_batches([_parts(_shared(table.column("kind").to_pylist(), table.column("data").to_pylist(), key[0].as_py(), n))])
                give_back()
                return out

            def lowest(key, table):
                out = _lowest(table.column("kind").to_pylist(), table.column("data").to_pylist())
                give_back()
                return out

            made = nodes.select("node", "text").mapInArrow(start, _PART).groupBy("bucket").applyInArrow(shared, _PART)
            with modest_batches(spark):
                made = materialize(made.groupBy("bucket").applyInArrow(lowest, _ROW), "sketches")
            sets = made.filter(F.col("kind") == SETS)
            # A set with too many empty blocks in a band would miss partners; another seed deals anew.
            if sets.filter("weak = 1").isEmpty():
                break
        else:
            raise RuntimeError("no seed spreads all sets over their blocks")
        self.single = sets.select("node", "n", "sketch")
        # Equal sets are one node, the least; its words come from the least copy that has some of its own.
        facts = sets.select("node", "n", "f0", "f1", "own")
        group = facts.groupBy("f0", "f1").agg(F.min("node").alias("head"), F.min(F.when(F.col("own") == 1, F.col("node"))).alias("giver"), F.count("*").alias("m"))
        copied = materialize(group.filter("m > 1").drop("m"), "copied")
        heads = facts.join(copied, ["f0", "f1"], "left").select("node", "n", "own", F.coalesce("head", "node").alias("head"), F.coalesce("giver", "node").alias("giver"))
        self.heads = materialize(heads, "heads")
        spare = self.heads.filter("own = 1 AND node <> giver").select("node")
        given = self.heads.filter("node = giver AND node <> head").select("node", "head")
        rows = made.filter(F.col("kind") == WORDS).select("node", "word").join(spare, "node", "left_anti").join(given, "node", "left").select(F.coalesce("head", "node").alias("node"), "word")
        lead = rows.groupBy("word").agg(F.min("node").alias("lead"), F.count("*").alias("m")).filter("m > 1").drop("m")
        self.rows = materialize(rows.join(lead, "word"), "words")

    @staticmethod
    def _wide(rows: DataFrame) -> DataFrame:
        """``rows`` with the sketch's words as columns, which a join's condition compares faster than an array's places."""
        return rows.select(*(c for c in rows.columns if c != "sketch"), *(F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(BITS // 64)))

    def _near(self, a: str, b: str):
        """What two sketches allow: sizes in range and no more odd bits than similar sets can have."""
        p = self.measure.percent
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        odd = reduce(Column.__add__, (F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(BITS // 64)))
        return (100 * F.least(na, nb) >= p * F.greatest(na, nb)) & (odd * (100 + p) <= (na + nb) * (100 - p))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Those of (a, b) whose full sets are similar, with the intersection's size."""
        words, p = self.words, self.measure.percent
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

        def sets(rows):
            for b in sliced(rows):
                found = [shingle_set(t, words).view(np.int64) for t in b.column(1).to_pylist()]
                offset = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offset), pa.array(flat))], names=["node", "items"])

        with modest_batches(pairs.sparkSession):
            full = materialize(self.nodes.join(wanted, "node").select("node", "text").mapInArrow(sets, "node long, items array<long>"), "sets")
        x = full.select(F.col("node").alias("a"), F.col("items").alias("x"))
        y = full.select(F.col("node").alias("b"), F.col("items").alias("y"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", F.size("x").alias("nx"), F.size("y").alias("ny"), F.size(F.array_intersect("x", "y")).alias("same"))
        return both.filter(100 * F.col("same") >= p * (F.col("nx") + F.col("ny") - F.col("same"))).select("a", "b", "same")

    def links(self) -> DataFrame:
        """Enough verified links (a, b) to connect every component of single nodes."""
        x, y = (self._wide(self.single).alias(k) for k in "xy")
        pairs = self.rows.filter("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        first = materialize(pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(self._near("x", "y")).select("a", "b"), "candidates")
        found = materialize(self.verify(first), "links")
        # Words whose sharers are in one component by now need no more; of others, all that are apart.
        root = components(found)
        rows = self.rows.join(root, "node", "left").select("word", "node", F.coalesce("root", "node").alias("root"))
        open_words = rows.groupBy("word").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("word")
        rest = materialize(rows.join(open_words, "word").join(self.single, "node"), "apart")
        u, v = (self._wide(rest).alias(k) for k in "uv")
        apart = u.join(v, (F.col("u.word") == F.col("v.word")) & (F.col("u.node") < F.col("v.node")) & (F.col("u.root") != F.col("v.root")) & self._near("u", "v"))
        second = materialize(apart.select(F.col("u.node").alias("a"), F.col("v.node").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "candidates")
        return found.unionByName(self.verify(second)) if not second.isEmpty() else found


def _rooted(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, Column, bool]:
    """``docs`` (c0, c1 ... and the places of doc_id and text) as (node, text, doc_id), (node, n, root) of each node, the node's expression, and whether nodes are ids."""
    key, text = F.col(place(docs, "doc_id")), F.col(place(docs, "text"))
    docs = plain(docs)
    once = docs.agg(F.count("*").alias("n"), F.count_distinct(key).alias("ids"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    unique = once["n"] == once["ids"]
    # Repeated or null ids: rows with equal id and text are one node.
    node = key.cast("long") if unique else F.xxhash64(F.coalesce(key.cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    named = docs.select(node.alias("node"), text.alias("text"), key.cast("long").alias("doc_id"))
    join = Join(named.select("node", "text") if unique else named.select("node", "text").dropDuplicates(["node"]), words, percent, once["bytes"])
    root = components(join.links())
    nodes = join.heads.withColumn("linked", F.when(F.col("n") > 0, F.col("head")).otherwise(F.col("node")))
    nodes = nodes.join(root.withColumnRenamed("node", "linked"), "linked", "left").select("node", "n", F.coalesce("root", "linked").alias("root"))
    return named, nodes, node, unique


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per row of ``docs``."""
    named, nodes, _, unique = _rooted(docs, words, percent)
    if unique:  # nodes are ids, so the least node is the least id, and every node is a row
        return nodes.select(F.col("node").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("root").alias("component_id"))
    rows = named.select("node", "doc_id").join(nodes, "node")
    least = materialize(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return rows.join(least, "root").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the least doc_id, null ids last, and among equal ids of the least node.

    Where ids are repeated or null, a node is a hash of id and text; of rows with both equal one stays. Rows
    with null or empty texts link with nothing and all stay, but for repeats of id and text.
    """
    named, nodes, node, unique = _rooted(docs, 5, 75)
    held = plain(docs).withColumn("node", node)
    if unique:
        return held.join(nodes.filter("node = root").select("node"), "node", "left_semi").drop("node").toDF(*docs.columns)
    rows = named.select("node", "doc_id").distinct().join(nodes, "node")
    keep = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")).select(F.col("first.node").alias("node"))
    return held.join(keep, "node", "left_semi").dropDuplicates(["node"]).drop("node").toDF(*docs.columns)


def op1_ngram_jaccard(spark, sf_dir):
    return near_duplicates(only(documents(spark, sf_dir), "doc_id", "text"))
