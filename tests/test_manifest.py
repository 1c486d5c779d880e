"""Versioned tables: ranges, crashes, readers and writers at once, repeated batches."""

import random

import pytest
from pyspark.sql import types as T
from tidemark.sources import manifest as M

DDL = "k string, d int, v double"
SHAPE = T.StructType([T.StructField("k", T.StringType()), T.StructField("d", T.IntegerType()), T.StructField("v", T.DoubleType())])
KEYS = ["k", "d"]


def rows(spark, data, more=""):
    return spark.createDataFrame(data, DDL + more)


def table(spark, path):
    return {(x.k, x.d): x.v for x in M.read(spark, path, SHAPE).collect()}


def test_upserts_rewrite_only_what_they_touch(spark, tmp_path):
    path, r, want = f"{tmp_path}/t", random.Random(1), {}
    first = [(r.choice("abcd"), i, float(i)) for i in range(1000)]
    want |= {x[:2]: x[2] for x in first}
    M.write_upsert(spark, path, rows(spark, first), SHAPE, KEYS, rows_per_part=100)
    v1 = M.current(spark, path)
    assert len(v1.parts) >= 8 and sum(p["rows"] for p in v1.parts) == 1000 and [p["low"] for p in v1.parts] == sorted((p["low"] for p in v1.parts), key=lambda x: (x[0], int(x[1])))
    assert table(spark, path) == want
    for _ in range(6):
        new = [(r.choice("abcde"), r.randint(-5, 1200), r.random()) for _ in range(r.choice([1, 5, 40]))]
        M.write_upsert(spark, path, rows(spark, [(*x, i) for i, x in enumerate(new)], ", seq int").repartition(3), SHAPE, KEYS, "seq", rows_per_part=100)
        want |= {x[:2]: x[2] for x in new}
        assert table(spark, path) == want
    before = M.current(spark, path)
    M.write_upsert(spark, path, rows(spark, [("a", first[0][1] if first[0][0] == "a" else 0, 7.0)]), SHAPE, KEYS, rows_per_part=100)
    after = M.current(spark, path)
    kept = {p["path"] for p in before.parts} & {p["path"] for p in after.parts}
    assert len(kept) >= len(before.parts) - 1 and after.version == before.version + 1


def test_a_crash_between_steps_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    M.write_upsert(spark, path, rows(spark, [("a", 1, 1.0)]), SHAPE, KEYS)

    def die(*_, **__):
        raise KeyboardInterrupt

    monkeypatch.setattr(M, "_commit", die)
    with pytest.raises(KeyboardInterrupt):  # after the data, before the manifest
        M.write_upsert(spark, path, rows(spark, [("a", 1, 2.0)]), SHAPE, KEYS)
    monkeypatch.undo()
    assert table(spark, path) == {("a", 1): 1.0}
    p, fs = M._path(spark, f"{path}/{M.VERSIONS}/v0000000002.json")  # in the midst of the manifest
    stream = fs.create(p, False)
    stream.write(b'{"version": 2, "parts": [')
    stream.close()
    assert table(spark, path) == {("a", 1): 1.0}
    stale = M._commit
    monkeypatch.setattr(M, "_commit", lambda *a: stale(*a, stale_s=0.0))
    assert M.write_upsert(spark, path, rows(spark, [("a", 1, 3.0)]), SHAPE, KEYS).version == 3
    assert table(spark, path) == {("a", 1): 3.0}
    assert M.vacuum(spark, path, keep=1) == 2  # the first version's data and the dead writer's
    assert table(spark, path) == {("a", 1): 3.0}


def test_a_reader_keeps_its_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    M.write_upsert(spark, path, rows(spark, [("a", i, 0.0) for i in range(50)]), SHAPE, KEYS, rows_per_part=10)
    reader = M.read(spark, path, SHAPE)
    for n in range(3):
        M.write_upsert(spark, path, rows(spark, [("a", i, 1.0 + n) for i in range(50)]), SHAPE, KEYS, rows_per_part=10)
        assert {x.v for x in reader.collect()} == {0.0} and {x.v for x in M.read(spark, path, SHAPE).collect()} == {1.0 + n}


def test_of_two_writers_the_second_starts_again(spark, tmp_path, monkeypatch):
    path, commit, met = f"{tmp_path}/t", M._commit, []
    M.write_upsert(spark, path, rows(spark, [("a", 1, 1.0)]), SHAPE, KEYS)

    def interrupted(*a):
        if not met:  # another writer gets in between
            met.append(1)
            M.write_upsert(spark, path, rows(spark, [("b", 1, 5.0), ("a", 1, 5.0)]), SHAPE, KEYS)
        return commit(*a)

    monkeypatch.setattr(M, "_commit", interrupted)
    M.write_upsert(spark, path, rows(spark, [("a", 1, 2.0)]), SHAPE, KEYS)
    assert table(spark, path) == {("a", 1): 2.0, ("b", 1): 5.0} and M.current(spark, path).version == 3


def test_batches_count_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n, v in ((0, 1.0), (1, 2.0), (0, 1.0), (1, 2.0)):
        M.write_upsert(spark, path, rows(spark, [("a", 1, v)]), SHAPE, KEYS, batch=("s", n))
    assert table(spark, path) == {("a", 1): 2.0} and M.current(spark, path).version == 2
    M.write_upsert(spark, path, rows(spark, []), SHAPE, KEYS, batch=("s", 2))
    assert M.current(spark, path).batches == {"s": 2} and table(spark, path) == {("a", 1): 2.0}


def test_a_plain_folder_becomes_a_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert table(spark, path) == {}
    rows(spark, [("a", 1, 1.0), ("b", 2, 2.0)]).write.parquet(path)
    assert len(table(spark, path)) == 2
    M.write_upsert(spark, path, rows(spark, [("b", 2, None), ("c", 0, 3.0)]), SHAPE, KEYS, keep_missing=True)
    assert table(spark, path) == {("a", 1): 1.0, ("b", 2): 2.0, ("c", 0): 3.0}
