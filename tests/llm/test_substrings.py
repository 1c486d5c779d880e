"""Repeated-substring removal against brute force."""

import hashlib
import random

import numpy as np
import pytest
from tidemark.llm import substrings


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    places = {}
    for d, x in enumerate(data):
        for i in range(len(x) - length + 1):
            places.setdefault(x[i : i + length], []).append((d, i))
    gone = [bytearray(len(x)) for x in data]
    for where in places.values():
        if len(where) > 1:
            for d, i in where:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for x, g in zip(data, gone, strict=True):
        rest = bytes(c for c, k in zip(x, g, strict=True) if not k)
        runs = sum(1 for i, k in enumerate(g) if k and (not i or not g[i - 1]))
        out.append((len(x), sum(g), runs, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé\n", k=r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (15, 30, 40, 60, 200)]
    texts = [None, "", "a" * 199, "a" * 200, "ab" * 300, "x" * 1000, "x" * 1000, "\0" * 250]
    for _ in range(60):
        parts = [prose(r.randint(0, 60)) for _ in range(r.randint(1, 4))]
        for s in r.sample(shared, r.randint(0, 3)):
            parts.insert(r.randint(0, len(parts)), s[: r.randint(min(90, len(s)), len(s))] if r.random() < 0.5 else s)
        texts.append("".join(parts))
    return texts + texts[-3:] + [texts[-1][:150] + "!" + texts[-1][150:]] + [s[r.randint(0, 30) :] + prose(5) for s in shared for _ in range(6)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, Text_ string, bucket long").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 200)
    assert any(x[1] for x in got.values()) and any(x[2] > 1 for x in got.values())


def test_repeated_rows_and_no_rows(spark):
    long = "The same text again, with words. " * 7
    docs = spark.createDataFrame([(1, long), (1, long), (None, "y" * 150), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substrings.remove_repeats(docs).collect()))
    assert got == [(0, 0, 0), (0, 150, 0), (1, 231, 231), (1, 231, 231)]
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_hot_anchors_are_split():
    r = random.Random(9)
    passage = "".join(r.choices("abcdefgh ", k=260))
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(0, 300))) + passage[r.randint(0, 40) :] + "".join(r.choices("xyz", k=50)) for _ in range(80)]
    data = [t.encode() for t in texts]
    held = []
    for d, x in enumerate(data):
        first, last, place, anchor, form = substrings.segments(x, 200)
        held.append((anchor, form, np.full(len(first), d), first.astype(np.uint32), (last - first).astype(np.uint8), (place - first).astype(np.uint8)))
    rows = [substrings.pack(*(np.concatenate(x) for x in zip(*held, strict=True)))]
    for hot in (3, 10**9):
        asked = [d for _, d in substrings.compare_forms(rows, 200, 4, hot)]
        spans = {d: [] for d in range(len(data))}
        for kind, _, doc, first, run in map(substrings.unpack, asked):
            for k, d, f, n in zip(kind, doc, first, run, strict=True):
                if k == substrings.COVER:
                    spans[d].append((f, f + n + 200))
        for _, x in substrings.expand([d for _, d in substrings.cut_segments(dict(enumerate(data)), asked, 200, 1)], 200, 4):
            _, doc, a, b = substrings.unpack(x)
            for d, s, e in zip(doc, a, b, strict=True):
                spans[d].append((s, e))
        got = []
        for d, x in enumerate(data):
            a = np.array([s for s, _ in spans[d]], np.int64)
            removed, runs, rest = substrings.cut_document(x, a, np.array([e for _, e in spans[d]], np.int64))
            got.append((len(x), removed, runs, hashlib.sha256(rest).hexdigest()))
        assert got == brute(texts, 200)


def test_prefixes_are_those_of_the_sorted_suffixes():
    r = np.random.default_rng(4)
    for n in (1, 2, 50, 400):
        s = np.append(r.integers(2, 5, n), 0)
        order = substrings.sort_suffixes(s, 12)
        common = substrings.common_prefixes(s, order, 10)
        t = s.tolist()
        for i in range(1, len(t)):
            x, y = t[order[i - 1] :], t[order[i] :]
            k = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert x[:12] <= y[:12] and common[i] == min(k, 10)


def test_windows_choose_by_content():
    h = np.random.default_rng(1).integers(0, 9, 500).astype(np.uint64) << np.uint64(40)
    at = substrings.window_minima(h, 17)
    for p in range(len(at)):
        w = h[p : p + 17]
        assert at[p] == p + max(np.flatnonzero(w == w.min()))
