"""Removal of byte strings that occur more than once, by bounded interval expansion on a BWT.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else in the corpus.

1. Winnowing: the least hash of the ``GRAM``-byte strings in a window of ``length`` bytes is the
   window's anchor. Equal windows have equal anchors, so each window is dealt with at one anchor,
   and windows of one anchor form a run: a segment of the text, with a hash of its own.
2. By anchor: a segment whose anchor is found nowhere else has no repeated window. Segments that are
   equal as a whole repeat in all their windows. Only the other segments, and one of each repeated
   form beside them, have to be compared window by window.
3. Those segments' bytes are gathered by anchor. Each bucket is one text with separators. A
   Burrows-Wheeler transform is built from suffixes sorted to at least ``length`` symbols, and a
   breadth-first search over intervals derives longest common prefixes by increasing value: the
   interval of a string w of k bytes is extended to the left by each byte c found before it, and
   where the interval of cw ends a common prefix of k is known. It stops at ``length``; neighbours
   without a value by then share ``length`` bytes or more.
4. Documents are cut by the union of the repeated windows.

Between the steps, segments travel as packed arrays, one row a bucket and input batch. Buckets are
hashes of anchors or document ids, as many as the text's size asks for, so a task's share does not
grow with the input. Copies of a passage are one hash each in step 2.

Defined results: a null text is empty; texts below ``length`` bytes are kept whole; repeated rows
with one doc_id get the same result each, and count as different places; other columns, also of names
that differ in case only, are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK, RangeHash, buckets, documents, give_back, materialize, mix, modest_batches, only, sliced

GRAM = 32
_LOW = np.uint64((1 << 24) - 1)


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The position of the least value in each window of ``width`` values; of equal ones the last."""
    n = len(h) - width + 1
    at = np.arange(len(h), dtype=np.uint64)
    key = (h & ~_LOW) | (_LOW - at)
    blocks = -(-len(h) // width)
    full = np.full(blocks * width, ~np.uint64(0))
    full[: len(h)] = key
    full = full.reshape(blocks, width)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return (_LOW - (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & _LOW)).astype(np.int64)


def segments(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor's place, anchor hash, segment hash) of the runs of windows with one anchor."""
    parts = []
    at = 0
    while at + length <= len(data):
        piece = np.frombuffer(data, np.uint8, min(len(data) - at, CHUNK + length - 1), at)
        ranges = RangeHash(piece)
        i = np.arange(len(piece) - GRAM + 1)
        anchor = window_minima(ranges(i, i + GRAM), length - GRAM + 1)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.append(first[1:], len(anchor)) - 1
        a = anchor[first]
        form = mix(ranges(first, last + length) + ((last - first) * 4096 + (a - first)).astype(np.uint64))
        parts.append((first + at, last + at, a + at, ranges(a, a + GRAM), form))
        at += CHUNK
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2


# --- packed rows: (bucket, data), data a pickled tuple of arrays whose bytes are laid out in planes


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    return pickle.dumps([(a.dtype.str, len(a), _planes(np.ascontiguousarray(a))) for a in arrays], protocol=5)


def unpack(data: bytes) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(t).itemsize, n).T).view(t).reshape(n) for t, n, b in pickle.loads(data)]


def joined(rows: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*map(unpack, rows), strict=True)]


def by_bucket(bucket: np.ndarray, *arrays: np.ndarray):
    """(bucket, the arrays' rows in it) for each bucket."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
    for s, e in zip(first, np.append(first[1:], len(b)), strict=True):
        yield int(b[s]), [a[order[s:e]] for a in arrays]


_ROW = "bucket int, data binary"
_SHAPE = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])


def _rows(found) -> pa.RecordBatch:
    found = list(found)
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], schema=_SHAPE)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """A bucket below ``n`` for each 64-bit hash, from its high bits."""
    return ((x >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def anchor_bucket(x: np.ndarray, n: int) -> np.ndarray:
    """Anchors are minima of hashes, so their high bits are hashed again."""
    return spread(mix(x), n)


def doc_bucket(key: np.ndarray, n: int) -> np.ndarray:
    """Spark's ``pmod(xxhash64(key), n)`` for 64-bit keys."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    h = turn(turn(key.astype(np.uint64) * p2, 31) * p1 ^ (np.uint64(50) + p5), 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)).astype(np.int64) % n


def find_segments(rows, length: int, n: int):
    """Documents -> (bucket of the anchor; anchor, form, doc, first, last - first, anchor's place - first)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for b in sliced(rows):
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            first, last, place, anchor, form = segments((text or "").encode("utf-8", "surrogatepass"), length)
            if len(first):
                held.append((anchor, form, np.full(len(first), key, np.int64), first.astype(np.uint32), (last - first).astype(np.uint8), (place - first).astype(np.uint8)))
                size += len(first)
            if size > 200_000:
                yield _flush(held, n)
                held, size = [], 0
                give_back()
    if held:
        yield _flush(held, n)
    give_back()


def _flush(held, n: int) -> pa.RecordBatch:
    arrays = [np.concatenate(x) for x in zip(*held, strict=True)]
    return _rows((b, pack(*x)) for b, x in by_bucket(anchor_bucket(arrays[0], n), *arrays))


COVER, SINGLE, REPEATED = 0, 1, 2


def compare_forms(rows: list[bytes], length: int, n: int, hot: int = 50_000):
    """Step 2 in one bucket: (bucket of the document; kind, anchor, doc, first, last - first).

    The segments of an anchor with more than ``hot`` of them to compare are dealt out by their windows'
    distance from the anchor: equal windows have equal distances.
    """
    anchor, form, doc, first, run, place = joined(rows)
    order = np.lexsort((first, doc, form, anchor))
    anchor, form, doc, first, run, place = (x[order] for x in (anchor, form, doc, first, run, place))
    new_anchor = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    new_form = new_anchor | np.concatenate(([True], form[1:] != form[:-1]))
    of_anchor, of_form = np.cumsum(new_anchor) - 1, np.cumsum(new_form) - 1
    n_anchor, n_form = np.bincount(of_anchor)[of_anchor], np.bincount(of_form)[of_form]
    forms = np.bincount(of_anchor, new_form)[of_anchor]
    cover = np.flatnonzero(n_form > 1)
    ask = np.flatnonzero(((n_form == 1) & (n_anchor > 1)) | ((n_form > 1) & new_form & (forms > 1)))  # one of each form
    kind = np.where(n_form[ask] > 1, REPEATED, SINGLE).astype(np.uint8)
    out = [(np.full(len(cover), COVER, np.uint8), anchor[cover], doc[cover], first[cover], run[cover])]
    shares = 1 << np.ceil(np.log2(np.maximum(1, np.bincount(of_anchor[ask], minlength=len(forms))[of_anchor[ask]] / hot))).astype(np.int64) if len(ask) else ask
    most = 1 << int(np.log2(length - GRAM + 1))  # a share is a distance at least
    for share in np.unique(np.minimum(shares, most)):
        which = np.minimum(shares, most) == share
        i, k = ask[which], kind[which]
        width = -(-(length - GRAM + 1) // int(share))
        f, r, p = (x[i].astype(np.int64) for x in (first, run, place))
        for j in range(share):
            low, high = np.maximum(0, p - (j + 1) * width + 1), np.minimum(r, p - j * width)
            some = low <= high
            name = anchor[i] if share == 1 else mix(anchor[i] + np.uint64(j + 1))
            out.append((k[some], name[some], doc[i][some], (f + low)[some].astype(np.uint32), (high - low)[some].astype(np.uint8)))
    kind, anchor, doc, first, run = (np.concatenate(x) for x in zip(*out, strict=True))
    return ((b, pack(*x)) for b, x in by_bucket(doc_bucket(doc, n), kind, anchor, doc, first, run))


def cut_segments(texts: dict, rows: list[bytes], length: int, n: int):
    """Step 3's input: the bytes of the segments to compare, by bucket of the anchor."""
    kind, anchor, doc, first, run = joined(rows)
    want = kind != COVER
    kind, anchor, doc, first, run = (x[want] for x in (kind, anchor, doc, first, run))
    for b, (k, a, d, f, r) in by_bucket(anchor_bucket(anchor, n), kind, anchor, doc, first, run):
        size = r.astype(np.int64) + length
        data = b"".join(texts[int(x)][y : y + z] for x, y, z in zip(d, f.tolist(), size.tolist(), strict=True))
        yield b, pack(k, a, d, f, r, np.frombuffer(data, np.uint8))


# --- the transform --------------------------------------------------------------------------------


def sort_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes in the order of their first ``depth`` symbols or more (9 bits each)."""
    n = len(symbols)
    s = np.zeros(n + 7, np.uint64)
    s[:n] = symbols
    key = np.zeros(n, np.uint64)
    for k in range(7):
        key = key << np.uint64(9) | s[k : n + k]
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(n, np.int64)
    start = np.concatenate(([True], k[1:] != k[:-1]))
    rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    have = 7
    while have < depth:
        # Only suffixes that share their rank are sorted again, inside their group.
        tied = ~(start & np.append(start[1:], True))
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = order[at]
        ahead = pos + have
        follow = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        again = np.argsort(rank[pos].astype(np.uint64) << np.uint64(32) | follow.astype(np.uint64))
        pos, follow = pos[again], follow[again]
        order[at] = pos
        group = rank[pos]
        start = start.copy()
        start[at] = np.concatenate(([True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])))
        rank[order] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        have *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """The common prefix of each suffix with its predecessor in ``order``, ``most`` where it is that or more."""
    n = len(symbols)
    before = symbols[order - 1]  # the transform; the last symbol stands before the first
    map_left = np.empty(n, np.int64)
    map_left[np.argsort(before, kind="stable")] = np.arange(n)
    common = np.full(n + 1, most, np.int64)
    common[0] = common[n] = 0
    low, high = np.array([0]), np.array([n])
    for k in range(most):
        if not len(low):
            break
        one = high - low == 1
        new_low, new_high = [map_left[low[one]]], [map_left[low[one]] + 1]
        low, high = low[~one], high[~one]
        if len(low):
            size = high - low
            stop = np.cumsum(size)
            row = np.repeat(low - (stop - size), size) + np.arange(stop[-1])
            key = np.repeat(np.arange(len(low)), size) * 512 + before[row]
            by = np.argsort(key, kind="stable")
            key = key[by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            start = map_left[row[by[first]]]
            new_low.append(start)
            new_high.append(start + np.diff(np.append(first, len(key))))
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = common[high] == most
        fresh &= high < n
        low, high = low[fresh], high[fresh]
        common[high] = k
    return common[:n]


def repeated_windows(data: np.ndarray, size: np.ndarray, weight: np.ndarray, length: int) -> np.ndarray:
    """Whether the window at each place of ``data`` starts elsewhere too; segments end after ``size`` bytes each.

    ``weight`` is the number of times each segment stands for.
    """
    n = len(data) + len(size) + 1
    ends = np.cumsum(size + 1) - 1
    symbols = np.zeros(n, np.int64)  # 0 ends the text, 1 ends a segment
    inside = np.ones(n, bool)
    inside[ends] = inside[-1] = False
    symbols[inside] = data.astype(np.int64) + 2
    symbols[ends] = 1
    order = sort_suffixes(symbols, length)
    common = common_prefixes(symbols, order, length)
    left = np.repeat(ends, size + 1) - np.arange(n - 1)
    valid = np.append(left >= length, False)
    times = np.append(np.repeat(weight, size + 1), 0) * valid
    group = np.cumsum(common < length) - 1
    many = np.bincount(group, times[order])[group] > 1
    out = np.zeros(n, bool)
    out[order] = many
    return (out & valid)[inside]


def expand(rows: list[bytes], length: int, n: int, most: int = 200_000):
    """Step 3 in one bucket: (bucket of the document; doc, first byte, end) of repeated windows."""
    kind, anchor, doc, first, run = (np.concatenate(x) for x in zip(*(unpack(r)[:5] for r in rows), strict=True))
    data = np.concatenate([unpack(r)[5] for r in rows])
    size = run.astype(np.int64) + length
    start = np.cumsum(size) - size
    order = np.argsort(anchor, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1])))
    found: list[tuple[np.ndarray, ...]] = []
    at = 0
    while at < len(cut):  # whole anchors, up to about ``most`` bytes at a time; one anchor may be larger
        total, stop = 0, at
        while stop < len(cut) and (stop == at or total < most):
            e = cut[stop + 1] if stop + 1 < len(cut) else len(order)
            total += int(size[order[cut[stop] : e]].sum())
            stop += 1
        take = order[cut[at] : cut[stop] if stop < len(cut) else len(order)]
        s = size[take]
        place = np.repeat(start[take] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        hit = repeated_windows(data[place], s, np.where(kind[take] == REPEATED, 2, 1), length)
        edge = np.cumsum(s)
        prior = np.concatenate(([False], hit[:-1]))
        prior[edge[:-1]] = False
        after = np.concatenate((hit[1:], [False]))
        after[edge - 1] = False
        a, b = np.flatnonzero(hit & ~prior), np.flatnonzero(hit & ~after)
        of = np.searchsorted(edge, a, side="right")
        base = first[take][of].astype(np.int64) - (edge - s)[of]
        found.append((doc[take][of], a + base, b + base + length))
        at = stop
    doc, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return ((k, pack(np.full(len(x[0]), COVER, np.uint8), *x)) for k, x in by_bucket(doc_bucket(doc, n), doc, a, b))


def cut_document(data: bytes, a: np.ndarray, b: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, the rest) for spans [a, b)."""
    if not len(a):
        return 0, 0, data
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    a, b = a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
    keep, at = [], 0
    for s, e in zip(a.tolist(), b.tolist(), strict=True):
        keep.append(data[at:s])
        at = e
    return int((b - a).sum()), len(a), b"".join([*keep, data[at:]])


def remove_repeats(docs: DataFrame, length: int = 200, with_text: bool = False) -> DataFrame:
    """One row per document: n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes)."""
    spark, docs = docs.sparkSession, only(docs, "doc_id", "text")
    once = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    n = buckets(spark, once["bytes"], 16 << 20)
    key = F.col("doc_id").cast("long")
    if once["n"] != once["ids"]:  # repeated or null ids: rows with equal id and text are one key
        key = F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), F.coalesce(docs["text"], F.lit("")))
    base = docs.select(key.alias("key"), docs["text"], docs["doc_id"].cast("long").alias("doc_id"))
    mixed = base.select(F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("bucket"), "*")

    def start(rows):
        return find_segments(rows, length, n)

    def forms(keys, table):
        return _table(compare_forms(table.column("data").to_pylist(), length, n))

    def gather(keys, left, right):
        if not left.num_rows or not right.num_rows:
            return _table(())
        texts = {k: (t or "").encode("utf-8", "surrogatepass") for k, t in zip(left.column("key").to_pylist(), left.column("text").to_pylist(), strict=True)}
        return _table(cut_segments(texts, right.column("data").to_pylist(), length, n))

    def windows(keys, table):
        return _table(expand(table.column("data").to_pylist(), length, n))

    def finish(keys, left, right):
        spans: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for r in right.column("data").to_pylist():
            kind, *x = unpack(r)
            if len(x) == 4:  # whole segments
                doc, a = x[1][kind == COVER], x[2][kind == COVER].astype(np.int64)
                b = a + x[3][kind == COVER] + length
            else:
                doc, a, b = x
            order = np.argsort(doc, kind="stable")
            for s in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(order) else ():
                spans.setdefault(int(doc[s[0]]), []).append((a[s], b[s]))
        out = []
        none = [(np.empty(0, np.int64),) * 2]
        for k, text, doc in zip(*(left.column(c).to_pylist() for c in ("key", "text", "doc_id")), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            removed, runs, rest = cut_document(data, *(np.concatenate(x) for x in zip(*spans.get(k, none), strict=True)))
            out.append((doc, len(data), removed, runs, hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
        columns = zip(*out, strict=True) if out else [[]] * len(result)
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, result.types, strict=True)], schema=result)

    result = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)
    found = base.select("key", "text").mapInArrow(start, _ROW)
    with modest_batches(spark):
        first = materialize(found.groupBy("bucket").applyInArrow(forms, _ROW), "segments")
    cut = mixed.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(gather, _ROW)
    second = cut.groupBy("bucket").applyInArrow(windows, _ROW)
    return mixed.groupBy("bucket").cogroup(first.unionByName(second).groupBy("bucket")).applyInArrow(finish, ", ".join(f"{f.name} {({'int64': 'long', 'string': 'string', 'binary': 'binary'})[str(f.type)]}" for f in result))


def _table(found) -> pa.Table:
    out = pa.Table.from_batches([_rows(found)])
    give_back()
    return out


def op2_substrings(spark, sf_dir):
    return remove_repeats(documents(spark, sf_dir))
