"""Token files, packing and media against brute force and exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from tidemark.llm import media, packing, repair
from tidemark.llm.tokens import coder, default_vocabulary

SCHEMA = "doc_id long, text string, Text2 string, source string"
TEXTS = [None, "", " ", "one", "two  spaces and\n \nlines ", "it's we'll\t\tend", "x" * 70_000, "la même chose 漢字 🎈", "same words again " * 400, "same words again " * 400, "# # ##2 #"] + [f"word{i} the other{i % 7} common text number {i}" * (i % 9) for i in range(60)]
ROWS = [(i, t, "extra", "s") for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def encoded(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    return t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_ids_of_whole_texts():
    odd = ["a  b", "a   b ", "foo\n ", " lead", "x \x1c y", "b\x0b c", "<|endoftext|> q", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>y z", "<|endoftex t|>", "  a　 b", "a  b", "é è", "don't  's"]
    for t, got in zip(odd, coder(default_vocabulary())(odd), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == encoded(t), t


def test_token_files(docs):
    got = {r.doc_id: r for r in repair.read_shards(repair.write_shards(docs, default_vocabulary(), shard_ids=5000)).collect()}
    start = 0
    for i, t, *_ in ROWS:
        ids = [*encoded(t), 2]
        assert tuple(got[i])[1:] == (start, len(ids), crc(ids)), i
        start += len(ids)
    assert len(got) == len(ROWS)


def test_token_files_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.read_shards(repair.write_shards(empty, default_vocabulary())).count() == 0
    twice = spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", ""), (None, None, "", "")], SCHEMA)
    rows = repair.read_shards(repair.write_shards(twice, default_vocabulary())).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 3), (1, 3)]


@pytest.mark.parametrize("seed", range(4))
def test_repair_round_trip(seed):
    r = np.random.default_rng(seed)
    parts = [r.integers(0, 5 + 50 * seed, n) for n in (0, 1, 2, 500, 3000, 3)] + [np.zeros(999, int)]
    ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
    keep = [p for p in parts if len(p)]
    data = repair.compress(ids, np.cumsum([len(p) for p in keep]), 50257, rounds=9, per_round=9, least=2)
    shard = repair.Shard(data)
    assert all(shard.document(k).tolist() == p.tolist() for k, p in enumerate(keep))
    assert len(shard.symbols) < len(ids) and ends[-1] == len(ids)


def test_repair_ends_when_no_pair_is_frequent():
    r = np.random.default_rng(5)
    copy = r.integers(0, 30000, 2000)
    parts = [copy] * 20 + [r.integers(0, 30000, 50000)]
    data = repair.compress(np.concatenate(parts), np.cumsum([len(p) for p in parts]), 50257)
    shard = repair.Shard(data)
    assert all(shard.document(k).tolist() == p.tolist() for k, p in enumerate(parts))
    assert max(np.diff(np.append(0, shard.stops))[:20]) <= 2
    for k in range(20):
        s = shard.symbols[shard.stops[k - 1] if k else 0 : shard.stops[k]]
        assert len(s) <= 2


def test_a_rare_pair_does_not_hide_a_frequent_one_of_its_slot():
    keys = np.arange(300_000, dtype=np.uint64)
    slot = repair._slots(keys, 8)
    rare = 5
    often, more = (int(x) for x in np.flatnonzero(slot == slot[rare])[1:3])
    key = np.array([rare] + [often, 0] * 20 + [more] * 9 + [more + 1] * 8, np.uint64)
    pairs, rest = repair._frequent(key, 8, 3)
    assert sorted(pairs.tolist()) == sorted([0, often, more]) and rest.tolist() == [more + 1]
    which, maybe = repair._places(key, pairs, rest)
    assert [int(pairs[w]) if w >= 0 else None for w in which] == [None if k in (rare, more + 1) else int(k) for k in key]
    assert maybe[-8:].all() and maybe[which >= 0].all()


def replaced(p, name):
    out, i = [], 0
    while i < len(p):
        pair = tuple(p[i : i + 2])
        out.append(name.get(pair, p[i]))
        i += 1 + (pair in name)
    return out


def plain_rounds(parts, vocabulary, per_round, least):
    """Re-Pair by rounds, counting every pair of every document anew."""
    parts, n_rules = [list(p) for p in parts], 0
    while True:
        times = {}
        for p in parts:
            for pair in zip(p, p[1:], strict=False):
                times[pair] = times.get(pair, 0) + 1
        chosen = sorted(sorted((k for k, n in times.items() if n >= least), key=lambda k: (-times[k], k))[:per_round])
        if not chosen:
            return parts, n_rules
        name = {pair: vocabulary + n_rules + i for i, pair in enumerate(chosen)}
        n_rules += len(chosen)
        parts = [replaced(p, name) for p in parts]


@pytest.mark.parametrize("seed, per_round, least", [(1, 4000, 8), (2, 3, 4), (3, 50, 2), (4, 1, 8)])
def test_repair_is_the_plain_algorithm(seed, per_round, least):
    r = np.random.default_rng(seed)
    parts = [r.integers(0, 4 + 10 * seed, n).tolist() for n in (1, 2, 700, 900, 3)] + [[7] * 99, [1, 2, 3] * 40]
    data = repair.compress(np.concatenate(parts), np.cumsum([len(p) for p in parts]), 1000, per_round=per_round, least=least)
    shard = repair.Shard(data)
    want, n_rules = plain_rounds(parts, 1000, per_round, least)
    assert shard.symbols.tolist() == sum(want, []) and len(shard.lengths) == n_rules


def test_a_shard_is_read_from_its_bytes_alone():
    parts = [np.arange(5), np.array([9]), np.arange(5)]
    shard = repair.Shard(repair.compress(np.concatenate(parts), np.array([5, 6, 11]), 100, least=2, doc_ids=[3, None, -7]))
    ids, stops = shard.documents()
    assert shard.doc_ids == [3, None, -7] and shard.n_ids == 11 and stops.tolist() == [5, 6, 11] and ids.tolist() == [*range(5), 9, *range(5)]


def check_pieces(rows, window, end_id=1):
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for i, t, *_ in ROWS:
        ids, at = [*encoded(t), end_id], 0
        for p in sorted(docs[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length])) and p.length
            at += p.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return sum(sum(p.length for p in s) < window for s in sequences.values())


def test_packing(docs):
    rows = packing.pack_documents(docs, default_vocabulary(), window=256).collect()
    assert check_pieces(rows, 256) <= 3  # one short sequence a shard
    check_pieces(packing.pack_documents(docs, default_vocabulary(), window=64, shard_tokens=300).collect(), 64)


def test_packing_puts_neighbours_together():
    r = np.random.default_rng(1)
    topic = [r.integers(0, 1 << 60, 40).astype(np.uint64) for _ in range(10)]
    words = [np.concatenate((r.choice(topic[i % 10], 30), r.integers(0, 1 << 60, 10).astype(np.uint64))) for i in range(200)]
    pieces = packing.pack([100] * 200, packing.Index(words), 400)
    seqs = {}
    for d, *_, s, _ in pieces:
        seqs.setdefault(s, []).append(d % 10)
    assert np.mean([len(set(s)) == 1 for s in seqs.values()]) > 0.8


def test_a_group_over_a_tenth_of_the_shard_is_packed_together():
    r = np.random.default_rng(2)
    words = [r.integers(1 << 50, 1 << 60, 40).astype(np.uint64) for _ in range(200)]
    hot = r.integers(0, 1 << 40, 30).astype(np.uint64)
    for i in range(0, 200, 4):
        words[i] = np.concatenate((r.choice(hot, 25), words[i][:10]))
    first = [d for d, *_, s, _ in packing.pack([100] * 200, packing.Index(words), 1000) if s == 0]
    assert len(first) == 10 and all(d % 4 == 0 for d in first)


def test_neighbours_are_all_taken_before_the_input_order():
    near = np.arange(20, dtype=np.uint64)
    words = [near if i % 2 == 0 else np.array([1000 + i], np.uint64) for i in range(1200)]
    first = [d for d, *_, s, _ in packing.pack([1] * 1200, packing.Index(words), 600) if s == 0]
    assert all(d % 2 == 0 for d in first)


def test_bm25_equals_brute_force():
    r = np.random.default_rng(3)
    words = [r.integers(0, 60, r.integers(1, 80)).astype(np.uint64) for _ in range(50)]
    index = packing.Index(words)
    mean = np.mean([len(w) for w in words])
    for d in (0, 7, 31):
        want = np.zeros(50)
        for t in set(words[d].tolist()):
            tf = np.array([(w == t).sum() for w in words])
            if (df := (tf > 0).sum()) > 1:
                want += np.log(1 + (50 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * np.array([len(w) for w in words]) / mean))
        assert np.allclose(index.scores(d), want)


def plain_scores(words, d):
    """BM25 of document ``d``'s distinct words against every document; words of one document say nothing."""
    n, mean = len(words), sum(map(len, words)) / len(words)
    out = [0.0] * n
    for t in set(words[d]):
        have = [w.count(t) for w in words]
        if (df := sum(f > 0 for f in have)) > 1:
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            for i, f in enumerate(have):
                out[i] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
    return out


def plain_packing(lengths, words, window):
    """(documents' pieces) by the rule itself: a seed's best unused neighbours fill its window, then the next in order."""
    left, out, sequence, room, near = list(range(len(lengths))), [], 0, window, []
    while left:
        near = [d for d in near if d in left]
        d = near.pop(0) if near else left[0]
        left.remove(d)
        start, seed = 0, d if room == window else None
        while start < lengths[d]:
            n = min(room, lengths[d] - start)
            out.append((d, start, n, sequence, window - room))
            start, room = start + n, room - n
            if not room:
                sequence, room, near = sequence + 1, window, []
                seed = d if start < lengths[d] else None
        if seed is not None:
            score = [round(x, 9) for x in plain_scores(words, seed)]
            near = sorted((i for i in left if score[i] > 0), key=lambda i: (-score[i], i))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_the_plain_rule(seed):
    r = np.random.default_rng(seed)
    words = [r.integers(0, 400, r.integers(0, 30)).tolist() for _ in range(60)]
    words += words[:5]  # copies tie
    lengths = [int(x) for x in r.integers(1, 150, len(words))]
    got = packing.pack(lengths, packing.Index([np.array(w, np.uint64) for w in words]), 100)
    assert got == plain_packing(lengths, words, 100)


def plain_area(a, height, width):
    """Each target pixel's mean, source pixel by source pixel."""
    out = np.zeros((height, width))
    for i in range(height):
        for j in range(width):
            total = weight = 0.0
            for y in range(a.shape[0]):
                dy = min(y + 1, (i + 1) * a.shape[0] / height) - max(y, i * a.shape[0] / height)
                for x in range(a.shape[1]):
                    dx = min(x + 1, (j + 1) * a.shape[1] / width) - max(x, j * a.shape[1] / width)
                    if dy > 0 and dx > 0:
                        total, weight = total + dy * dx * a[y, x], weight + dy * dx
            out[i, j] = total / weight
    return out


def test_features_are_those_of_plain_areas():
    r = np.random.default_rng(4)
    for shape in ((1, 64), (3, 64), (11, 7), (20, 33)):
        a = r.integers(0, 256, shape).astype(np.uint8)
        small = np.round(plain_area(a, 8, 9), 6)
        bits = "".join("1" if small[i, j + 1] > small[i, j] else "0" for i in range(8) for j in range(8))
        assert media.difference_hash(a) == f"{int(bits, 2):016x}"
        assert (np.load(__import__("io").BytesIO(media.npy_tile(a, 5))) == np.rint(np.round(plain_area(a, 5, 5), 9))).all()


def test_media(docs):
    rows = {r.doc_id: r for r in media.media_features(media.text_to_media(docs)).collect()}
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        pad = data + bytes(-len(data) % 64 or 64 * (not data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert np.load(__import__("io").BytesIO(r.npy)).shape == (16, 16) and len(r.feature) == 16
    assert tuple(rows[8])[1:] == tuple(rows[9])[1:]


def test_image_formats():
    r = np.random.default_rng(0)
    grey, rgb = r.integers(0, 256, (5, 7), dtype=np.uint8), r.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(grey)) == grey).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P6 #c\n5 6\n255\n" + rgb.tobytes()) == rgb).all()
    assert media.decode(b"P2\n# c\n2 2 9\n1 2\n3 4\n").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    low = bytearray(media.encode_bmp(grey))
    low[10:14] = (54 + 8).to_bytes(4, "little")  # a palette of two colours
    wide, odd = b"P5 99999999999999999999 3 255\n1", b"P5 2 2 70000\n12345678"
    for bad in (b"", b"P5", b"P5 9 9 255\nxx", b"BM", b"GIF89a", bytes(low), wide, odd, b"P2 2 1 9 -5 3", b"P2 2 1 9 10 3", b"P2 2 1 300 301 3", b"P5 2 1 9\n\x0a\x01", b"P1 2 1 12", b"P2 0 1 9", b"P2 x 1 9", media.encode_bmp(grey)[:-3]):
        with pytest.raises(ValueError):
            media.decode(bad)
    r = np.random.default_rng(1)
    for whole in (media.encode_bmp(grey), media.encode_bmp(rgb), media.encode_pgm(grey), b"P6 5 6 255\n" + rgb.tobytes()):
        for _ in range(300):  # bytes changed anywhere never raise anything else
            data = bytearray(whole[: r.integers(1, len(whole) + 1)])
            for k in r.integers(0, min(len(data), 70), 3):
                data[k] = r.integers(0, 256)
            try:
                media.decode(bytes(data))
            except ValueError:
                pass


def test_area_resize_is_the_mean_of_areas():
    a = np.arange(48.0).reshape(6, 8)
    assert np.allclose(media.area_resize(a, 3, 4), a.reshape(3, 2, 4, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(a, 12, 16), np.repeat(np.repeat(a, 2, 0), 2, 1))
    assert np.isclose(media.area_resize(a, 5, 3).mean(), a.mean())
