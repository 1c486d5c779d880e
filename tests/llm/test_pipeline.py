"""The pipeline against its stages' brute-force versions."""

import hashlib
import random

import corpus_pipeline
from tidemark.llm import mixing, secrets
from tidemark.llm.quality import measures

from .test_jaccard import brute
from .test_rules import KEY


def test_run(spark, tmp_path):
    r = random.Random(8)
    prose = lambda n: " ".join(r.choices([f"word{i}" for i in range(3000)], k=n))
    texts = [prose(r.randint(20, 200)) for _ in range(120)]
    texts += texts[:20] + [t + " end" for t in texts[20:40]] + [t + f" token={KEY}" for t in texts[100:120]] + [None, "", "spam " * 300]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, t, "en" if i % 3 else "fr", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        got.append({x.doc_id: x.text for x in docs.collect()})

    def good(t):
        n, *_, repeat = measures(t or "")
        return n >= 50 and 100 * repeat <= 50 * n

    want = {i: t for i, t, *_ in rows if good(t)}
    assert got[0] == want
    ids = sorted(want)
    want = {i: want[i] for i, (_, c) in zip(ids, brute([want[i] for i in ids]), strict=True) if ids[c] == i}
    assert got[1] == want
    want = {i: secrets.redact(t, secrets.scan_layers(t)[1]) for i, t in want.items()}
    assert got[2] == want and not any(KEY in t for t in want.values())
    p = {x.doc_id: x.mix_probability for x in mixing.mix(spark.createDataFrame([(*x[:1], want[x[0]], *x[2:]) for x in rows if x[0] in want], schema)).collect()}
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
    assert set(got[3]) == {i for i in want if draw(i) < p[i]}
    assert {x.doc_id for x in packed} == set(got[3]) and sum(x.length for x in packed) == sum({x.doc_id: x.doc_tokens for x in packed}.values())
