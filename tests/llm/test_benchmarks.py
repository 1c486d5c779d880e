"""Decontamination against a plain search."""

import random
import re

import numpy as np
from pyspark.sql import functions as F
from tidemark.llm import benchmarks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EXTRA = ["TEXT", "Doc_ID", "Item_ID", "row", "found", "item", "string", "suffix", "length", "n_words"]


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    strings = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            strings.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(s) for s in strings}:
            for i in range(len(w) - n + 1):
                if own := strings.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def found(spark, docs, items, extra=False):
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    if extra:
        d, b = (x.select("*", *(F.lit(f"extra {c}").alias(c) for c in EXTRA)) for x in (d, b))
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in benchmarks.decontaminate(d, b).collect()), key=repr)


def some(r):
    few = [f"w{i}" for i in range(12)] + ["É", "ß2", "x" * 40]
    prose = lambda n: r.choice([" ", ", ", "-\n"]).join(r.choices(few, k=n))
    items = [(i, prose(r.choice([1, 2, 3, 4, 9, 10, 11, 25]) if i > 20 else r.randint(10, 40))) for i in range(30)]
    items += [(5, prose(14)), (None, prose(12)), (None, prose(10)), (40, None), (41, ""), (42, " .,"), (43, items[0][1]), (44, items[1][1].upper())]
    docs = []
    for i in range(120):
        text = prose(r.choice([0, 1, 5, 50, 700]))
        for _ in range(r.choice([0, 0, 1, 3])):
            w = words(r.choice(items)[1])
            text += " ; ".join(["", *w[r.randint(0, 3) : r.randint(4, 40)], ""]) + prose(r.randint(0, 20))
        docs.append((i, text))
    docs += [(None, None), (3, docs[3][1]), (3, docs[4][1]), (200, ""), (201, "\0"), (202, "x" * 700_000 + " " + (items[0][1] or "")), (203, " ".join(r.choices(few, k=90_000)))]
    return docs, items


def test_against_a_plain_search(spark):
    docs, items = some(random.Random(4))
    want = plain(docs, items)
    assert sum(x[2] > 0 for x in want) > 40
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, extra=True) == want
    long = [x for x in items if len(words(x[1])) >= 10]  # one table, and documents that stay clean
    assert found(spark, docs, long) == plain(docs, long)


def test_empty_tables(spark):
    docs, items = some(random.Random(5))
    assert found(spark, [], items) == []
    assert all(x[2:] == (0, ()) for x in found(spark, docs, []))
    assert len(found(spark, docs, [(1, None)])) == len(docs)


def test_positions_are_skipped(spark):
    """Blocks of no test string let a search jump a string's length less two words."""
    t = benchmarks.Tables(10)
    seen = []
    at = benchmarks.block_hash
    try:
        benchmarks.block_hash = lambda words, ends, size: (seen.append(len(ends)), at(words, ends, size))[1]
        assert len(t.search(np.arange(8000, dtype=np.uint64), np.array([0]), np.array([8000]))) == 0
    finally:
        benchmarks.block_hash = at
    assert sum(seen) == 999


def test_full_tables_lose_nothing(monkeypatch):
    """Tables far too small for their strings only make more candidates."""
    docs, items = some(random.Random(6))
    monkeypatch.setattr(benchmarks, "SLOTS", 4)
    monkeypatch.setattr(benchmarks, "BITS", 5)
    known, t = set(), benchmarks.Tables(10)
    for _, text in items:
        w = benchmarks.Words((text or "").encode())
        for i in range(len(w.hash) - 9):
            known.add(w.string(i, 10))
            ends = np.arange(i + 2, i + 10)
            np.minimum.at(t.shift, benchmarks.slot(benchmarks.block_hash(w.hash, ends, 3)), (i + 9 - ends).astype(np.uint8))
            bit = benchmarks.prefix_bit(w.hash, np.array([i]), 10)[0]
            t.prefix[bit >> 3] |= np.uint8(1 << (bit & 7))
    _, found = benchmarks._search([(x or "").encode() for _, x in docs], [t])
    n = 0
    for (_, text), own in zip(docs, found, strict=True):
        w = words(text)
        want = {i for i in range(len(w) - 9) if " ".join(w[i : i + 10]) in known}
        assert want <= {x["start"] for x in own}
        n += len(want)
    assert n > 100
