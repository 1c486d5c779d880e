"""Every operator and stage with nulls, empty and very long texts, ties, repeated rows, clashing names and no rows."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tidemark.llm import jaccard, media, mixing, packing, quality, repair, secrets, sharding, substrings, urls
from tidemark.llm.tokens import default_vocabulary

#: Names that differ from the operators' own in case only, and names that they use inside.
EXTRA = ["TEXT", "Doc_ID", "SOURCE", "mix_topic", "__lines", "node", "bucket", "key", "row", "doc", "c0", "tokens", "part", "content", "host", "shard", "size"]
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


def some_rows():
    r = random.Random(5)
    prose = lambda n: " ".join(r.choices([f"word{i}" for i in range(2000)], k=n))
    long = prose(60_000)  # some 500,000 characters
    texts = [None, "", " \n\t", "one", prose(60), prose(60), prose(300), long, long + " and more", "x" * 300_000, "a퟿\U0001f388 \0 b"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(4, texts[4], "en", "s", 1), (4, texts[6], None, None, None), (None, texts[5], "de", "s", 3), (None, None, None, None, None), (None, texts[5], "de", "s", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with null and repeated ids and clashing columns."""
    base = spark.createDataFrame(some_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    return base.select(*OWN, *(F.lit(f"extra {c}").alias(c) for c in EXTRA)).repartition(3)


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(some_rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(2)


VOCABULARY = default_vocabulary()
OPERATORS = {
    "jaccard": jaccard.near_duplicates, "substrings": substrings.remove_repeats, "sharding": sharding.shard_documents, "mixing": mixing.mix,
    "media": lambda d: media.media_features(media.text_to_media(d)).drop("npy"), "secrets": secrets.find_secrets, "quality": quality.judge,
    "packing": lambda d: packing.pack_documents(d, VOCABULARY, window=512, shard_tokens=20_000).groupBy("doc_id").agg(F.sum("length").alias("n")),
    "tokens": lambda d: repair.read_shards(repair.write_shards(d, VOCABULARY)).drop("start"),
}


def shown(rows, names):
    return sorted(repr([r[n] for n in names]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_take_any_rows_and_names(spark, docs, plain, name):
    op = OPERATORS[name]
    found, want = op(docs), op(plain)
    rows = found.collect()
    if name != "packing":
        assert len(rows) == len(some_rows())
    names = [c for c in want.columns if c not in OWN[2:] and c not in ("slot", "shard")] if name != "mixing" else ["doc_id", "mix_topic", "mix_tokens", "mix_weight", "mix_sampled"]
    if name == "mixing":  # the operator's own columns come last
        own = want.columns[-5:]
        assert found.columns == docs.columns + own
        rows = [dict(zip(["doc_id", *own], (r[0], *r[-5:]), strict=True)) for r in rows]
    assert shown(rows, names) == shown(want.collect(), names)
    assert op(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_take_any_rows_and_names(spark, docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, "")
    if stage != "packing":
        assert out.columns == docs.columns
        assert all(r[len(OWN) :] == tuple(f"extra {c}" for c in EXTRA) for r in map(tuple, out.collect()))
    assert run(spark, docs.limit(0), "").count() == 0


def kept(df):
    return sorted((str(r[0]), r[1] or "") for r in df.collect())


def test_what_stages_keep(spark, plain):
    rows = [(str(r[0]), r[1] or "") for r in some_rows()]
    good = [(i, t) for i, t in rows if len(t.split()) >= 50]
    assert kept(quality.keep_good(plain)) == sorted(good)
    once = sorted(set(rows) - {("8", rows[8][1]), ("None", rows[5][1]), ("6", rows[6][1])})  # a near copy and copies go, the least id stays
    assert kept(jaccard.one_of_each(plain)) == once
    assert kept(secrets.mask_secrets(plain)) == sorted(rows)
    assert set(kept(mixing.sample(plain))) <= set(rows)


def test_clashing_captures(spark):
    entries = spark.createDataFrame([("l", "domain", "evil.com", "add")], "list string, kind string, pattern string, action string").withColumn("on_date", F.lit("2024-01-01").cast("date"))
    seen = ["http://good.com@evil.com/x", "http://user:pw@evil.com/", "http://evil.com./", "HTTP://EVIL.COM:80", "http://%65vil.com/a", "http:\\\\evil.com\\x", " https://sub.evil.com?q", "http://notevil.com/", "http://evil.com.org/", "mailto:a@evil.com", "http://good.com/evil.com", None]
    captures = spark.createDataFrame([(u, "x", "y") for u in seen], "url string, URL2 string, Host string").withColumnRenamed("URL2", "URL").withColumn("fetch_date", F.lit("2024-05-05").cast("date"))
    got = {r[0]: r["allowed"] for r in urls.filter_captures(captures, entries).collect()}
    assert [got[u] for u in seen] == [False] * 7 + [True] * 5
    paths = spark.createDataFrame([("l", "path", "C.org./b%61d", "add"), ("l", "host", None, "add")], "list string, kind string, pattern string, action string").withColumn("on_date", F.lit("2024-01-01").cast("date"))
    also = spark.createDataFrame([("http://c.org/bad/page",), ("http://c.org/%62ad",), ("http://c.org/good%",)], "url string").withColumn("fetch_date", F.lit("2024-05-05").cast("date"))
    assert [r.allowed for r in urls.filter_captures(also, paths).orderBy("url").collect()] == [False, False, True]
