"""The n-gram Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
from tidemark.llm import jaccard
from tidemark.llm.common import shingle_set


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * (same := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - same):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: r.choices(words, k=n)
    passage = prose(40)
    out = [None, "", " \t\n", "one", "one", "ONE two", "a b c d", "a b c d e", "A b c d E", "É é"]
    for n in (6, 9, 12, 20, 33, 45, 70, 90, 130, 200, 300, 600, 1100):
        for _ in range(3):
            base = prose(n)
            out.append(" ".join(base))
            for _ in range(4):
                other = list(base)
                for _ in range(r.randint(0, max(1, n // 25))):
                    k = r.randrange(len(other))
                    other[k : k + r.randint(0, 1)] = prose(r.randint(0, 2))
                other = other + prose(r.randint(0, n // 4)) if r.random() < 0.5 else other[: len(other) - r.randint(0, n // 5)]
                out.append("  ".join(other).upper() if r.random() < 0.2 else " ".join(other))
        out += [" ".join(prose(n // 3) + passage + prose(n // 4)) for _ in range(5)]
    chain = prose(60)
    for _ in range(12):  # each like the next, the ends unlike
        chain = chain[3:] + prose(3)
        out.append(" ".join(chain))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, Text_ string, n int").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(texts) - 60


@pytest.mark.parametrize("parts, falling", [(1, True), (1, False), (5, True)])
def test_components_do_not_depend_on_ids_and_order(spark, parts, falling):
    r = random.Random(parts)
    texts = corpus(3)
    texts += r.sample(texts, 40)  # copies beside near copies
    ids = r.sample(range(-(10**12), 10**12), len(texts))
    rows = sorted(zip(ids, texts, strict=True), reverse=falling)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.coalesce(1) if parts == 1 else docs.repartition(parts)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(docs).collect()}
    want = brute(texts)
    least = {}
    for i, (_, c) in zip(ids, want, strict=True):
        least[c] = min(i, least.get(c, i))
    assert got == {i: (n, least[c]) for i, (n, c) in zip(ids, want, strict=True)}


def test_a_whole_table(spark):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    rows.sort(reverse=True)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(docs).collect()}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = {}  # documents by shingle: only those that share one can be similar
    for i, s in ((i, shingles(t)) for i, t in rows):
        count = {}
        for g in s:
            for j in held.setdefault(g, []):
                count[j] = count.get(j, 0) + 1
            held[g].append((i, len(s)))
        for (j, n), same in count.items():
            if 100 * same >= 75 * (len(s) + n - same):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i, _ in rows}


def test_words_are_shared_by_similar_sets():
    """Any pair at the limit shares one of the words that are kept, in any common order."""
    r = np.random.default_rng(0)
    measure = jaccard.Measure(75)
    for n in (1, 2, 3, 5, 20, 31, 32, 33, 47, 63, 64, 65, 90, 128, 129, 250, 700, 1300):
        for _ in range(30):
            pool = r.integers(0, 1 << 63, 3 * n + 9).astype(np.uint64) * np.uint64(2)
            a = np.unique(pool[:n])
            drop = r.integers(0, n // 4 + 1)
            b = np.unique(np.concatenate((pool[drop:n], pool[n : n + r.integers(0, n // 3 + 1)])))
            same = len(np.intersect1d(a, b))
            if 100 * same < 75 * (len(a) + len(b) - same):
                continue
            kept = []
            for s in (a, b):
                kept.append({(top, int(w)) for top, words, slack in jaccard.block_words(s, measure) for w in np.sort(words)[: len(words) - slack]})
                assert all(slack >= 0 for *_, slack in jaccard.block_words(s, measure))
            assert kept[0] & kept[1], (n, drop)
            odd = sum(int(x).bit_count() for x in (jaccard.bit_sketch(a) ^ jaccard.bit_sketch(b)).view(np.uint64))
            assert odd <= len(a) + len(b) - 2 * same


def test_shingles_are_the_stated_ones():
    for t in (None, "", "A", "a b", "a b c d e", "a b c d e f a b c d e", "\x1ca\x0bb É é c d e f"):
        assert len(shingle_set(t)) == len(shingles(t)), t
    assert (shingle_set("A b C d e f") == shingle_set("a\tb c\nd E  F ")).all() and (shingle_set("É") != shingle_set("é")).any()


def test_long_words_and_texts(monkeypatch):
    from tidemark.llm import common

    r = random.Random(3)
    text = " ".join("".join(r.choices("abcdef", k=r.randint(1, 60))) for _ in range(3000)).encode()
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "CHUNK", 1000)
    assert (common.word_hashes(text) == whole).all()


def test_repeated_null_and_no_rows(spark):
    t = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(7, t), (7, t), (7, "other words that are not like these at all"), (3, t.upper()), (None, t), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard.near_duplicates(docs).collect())
    assert got == [(0, 0, 0), (0, 6, 3), (3, 6, 3), (7, 5, 7), (7, 6, 3), (7, 6, 3)]
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_copies_in_any_order_link_with_their_near_copies(spark):
    """The least id of a group of copies need not be the first that a task reads."""
    t = " ".join(f"w{i}" for i in range(200))
    rows = [(9, t), (8, t), (7, t), (1, t + " end"), (5, "other words that are not like these at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = {9: 1, 8: 1, 7: 1, 1: 1, 5: 5}
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want
    again = spark.createDataFrame(rows + [(None, t)], "doc_id long, text string").coalesce(1)  # nodes are hashes
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(again).collect()} == want | {None: 1}


def test_one_row_of_each_component_stays(spark):
    r = random.Random(4)
    a, b, c, d, e = (" ".join(r.choices([f"w{i}" for i in range(900)], k=80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b + " end"), (7, c), (7, d), (7, d), (3, e), (7, e + " end"), (None, e)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    pairs = [(x.doc_id, x.text) for x in got]
    assert len(pairs) == 5 and {(None, a), (7, c), (7, d), (3, e)} < set(pairs)
    assert len({(None, b), (None, b + " end")} & set(pairs)) == 1
