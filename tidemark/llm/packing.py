"""Packing documents into training sequences by lexical retrieval.

Documents are dealt into index shards of about ``shard_tokens`` tokens. A shard holds a BM25
inverted index over its documents' words. The document that begins a sequence is its seed; its
best-scoring unused neighbours follow until the window is full. A document that does not fit is
cut, and its rest begins the next sequence, as its seed. So every sequence of a shard but its last
is full, and each token lies in exactly one piece.

Shards are cut from the stream of a partition, so a task holds one shard at a time, whatever the
input's size; no shuffle is needed, and no group of rows has to come together.

Document frequencies, mean length and neighbours are those of the shard, as in any index that is
partitioned by documents.

Defined results: a null or empty text is a document of the end id only; equal scores go to the
earlier document; rows with null or repeated doc_id are packed each; other columns, also of names that
differ in case only, are ignored; an empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, only, sliced, word_hashes
from .tokens import batches, coder, default_vocabulary

K1, B = 1.2, 0.75


class Index:
    """BM25 over one shard: term-major postings with their weights, and each document's terms."""

    def __init__(self, words: list[np.ndarray]):
        n = len(words)
        length = np.array([len(w) for w in words], float)
        doc = np.repeat(np.arange(n), length.astype(np.int64))
        term = np.concatenate(words) if n else np.empty(0, np.uint64)
        order = np.argsort(term, kind="stable")
        term, doc = term[order], doc[order]
        new = np.concatenate(([True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))) if len(term) else np.empty(0, bool)
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(term)))
        term, doc = term[at], doc[at]
        first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.empty(0, np.int64)
        df = np.diff(np.append(first, len(term)))
        # A word of one document finds no neighbour.
        use = df > 1
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, length.mean() if n else 1.0))
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[doc])
        held = np.repeat(use, df)
        self.n, self.doc, self.weight = n, doc[held], weight[held]
        size = df[use]
        self.start = np.concatenate(([0], np.cumsum(size)))
        t = np.repeat(np.arange(len(size)), size)
        by = np.argsort(self.doc, kind="stable")
        self.terms = t[by]
        self.of = np.searchsorted(self.doc[by], np.arange(n + 1))

    def scores(self, d: int) -> np.ndarray:
        t = self.terms[self.of[d] : self.of[d + 1]]
        a, size = self.start[t], self.start[t + 1] - self.start[t]
        total = int(size.sum())
        if not total:
            return np.zeros(self.n)
        i = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)
        return np.bincount(self.doc[i], self.weight[i], self.n)


def pack(lengths: list[int], index: Index, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset)."""
    out: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(len(lengths), bool)
    sequence, filled, nxt = 0, 0, 0
    ranked: list[int] = []
    seed = -1

    def best() -> int:
        nonlocal ranked, seed, nxt
        if seed >= 0:  # a new seed's neighbours, best first
            score = np.where(used, 0, index.scores(seed))
            some = np.flatnonzero(score > 0)
            ranked = some[np.argsort(-score[some], kind="stable")][::-1].tolist()
            seed = -1
        while ranked:
            if not used[d := ranked.pop()]:
                return d
        while nxt < len(used) and used[nxt]:
            nxt += 1
        return nxt

    while True:
        d = best()
        if d >= len(lengths):
            return out
        used[d] = True
        if not filled:
            seed = d
        start = 0
        while start < lengths[d]:
            n = min(window - filled, lengths[d] - start)
            out.append((d, start, n, sequence, filled))
            start, filled = start + n, filled + n
            if filled == window:
                sequence, filled = sequence + 1, 0
                seed = d if start < lengths[d] else -1
                ranked = []


def pack_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, shard_tokens: int = 1_500_000) -> DataFrame:
    """One row per piece; sequence_id is unique, and offsets in it are gapless."""

    def run(rows):
        from pyspark import TaskContext

        code = coder(vocabulary)
        end = np.array([end_id], code.dtype).tobytes()
        base = TaskContext.get().partitionId() << 36
        keys: list[int | None] = []
        ids: list[bytes] = []
        words: list[np.ndarray] = []
        n = 0

        def flush():
            nonlocal keys, ids, words, n, base
            lengths = [len(x) // code.dtype.itemsize for x in ids]
            pieces = pack(lengths, Index(words), window)
            crc = [zlib.crc32(np.frombuffer(ids[d], code.dtype, size, start * code.dtype.itemsize).astype("<u4").tobytes()) for d, start, size, _, _ in pieces]
            d, start, size, sequence, offset = (np.array(x) for x in zip(*pieces, strict=True))
            row = [pa.array([keys[i] for i in d], pa.int64()), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.array(lengths)[d]), pa.array(base + sequence), pa.array(offset)]
            base += int(sequence[-1]) + 1
            keys, ids, words, n = [], [], [], 0
            return pa.RecordBatch.from_arrays(row, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        pairs = (x for b in sliced(rows) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for part in batches(pairs, 1_000_000):
            for (key, text), x in zip(part, code([t for _, t in part]), strict=True):
                keys.append(key)
                ids.append(x + end)
                words.append(word_hashes((text or "").encode("utf-8")))
                n += len(ids[-1]) // code.dtype.itemsize
                if n >= shard_tokens:
                    yield flush()
        if keys:
            yield flush()

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark, sf_dir):
    return pack_documents(documents(spark, sf_dir), default_vocabulary())


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, n_pieces) of packed pieces."""
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count("*").alias("n_pieces"))
