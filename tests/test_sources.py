"""Connectors, parsers, upserts, streaming and the entry module."""

import datetime as dt
import email.message
import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F
from tidemark.sources import ingest, rest, schemas, store
from tidemark.streaming import run_available, stream_bars


def test_schemas(spark):
    assert len(schemas.table_names()) == 8 and schemas.schema("prices")["open"].dataType.simpleString() == "double"
    with pytest.raises(KeyError):
        schemas.schema("nothing")
    got = schemas.conform(spark.createDataFrame([("T", "2024-01-02", 1)], "ticker string, date string, tonnes_in_trust int"), "etf_holdings")
    assert tuple(got.first()) == ("T", dt.date(2024, 1, 2), 1.0, None)


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, 5.0), ("b", 2, 6.0)], "k string, v int, w double")
    new = spark.createDataFrame([("b", 7, None), ("b", 8, None), ("c", 9, 1.0)], "k string, v int, w double").coalesce(1)
    assert sorted(map(tuple, ingest.upsert(old, new, ["k"]).collect())) == [("a", 1, 5.0), ("b", 8, None), ("c", 9, 1.0)]
    assert ("b", 8, 6.0) in list(map(tuple, ingest.upsert(old, new, ["k"], keep_missing=True).collect()))
    rain = spark.createDataFrame([("r", dt.date(2024, 1, 1), 1.0)], "region string, date date, precip double")
    ordered = new.withColumn("_seq", F.col("v") * -1)
    assert ("b", 7, None) in list(map(tuple, ingest.upsert(old, ordered.repartition(3), ["k"]).collect()))
    for _ in range(2):  # idempotent
        store.put(spark, str(tmp_path), "weather", rain)
    found = store.table(spark, str(tmp_path), "weather").collect()
    assert len(found) == 1 and found[0].gdd is None


def test_parsers(spark):
    one = lambda text: spark.createDataFrame([("S", text)], "key string, payload string")
    macro = json.dumps({"observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-01-02", "value": "."}, {"date": "2024-01-03", "value": ""}, {"date": "2024-01-04", "value": None}]})
    assert [tuple(r) for r in ingest.macro_observations(one(macro)).collect()] == [("S", dt.date(2024, 1, 1), 1.5)]
    energy = json.dumps({"response": {"data": [{"period": "2024-01-05T00", "value": "7"}, {"period": "2024-01-12", "value": "x"}]}})
    assert [tuple(r) for r in ingest.energy_observations(one(energy)).collect()] == [("S", dt.date(2024, 1, 5), 7.0)]
    weather = json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [5.0, 6.0], "temperature_2m_min": [1.0], "precipitation_sum": [0.0, None]}})
    assert [tuple(r)[2:] for r in ingest.weather_days(one(weather)).collect()] == [(5.0, 1.0, 0.0), (6.0, None, None)]
    lines = spark.createDataFrame([("date,price,dix,gex",), ("2024-01-01,1,0.4,5e9",), ("2024-01-02,1,bad,5",), ("2024-01-03,1",)], "value string")
    rows = ingest.dix_csv(lines)
    assert [tuple(r) for r in rows.collect()] == [(dt.date(2024, 1, 1), 0.4, 5e9)]
    assert {r.series_id: r.v for r in ingest.long_series(rows, ["d"], {"dix": "SQZ_DIX", "gex": "SQZ_GEX"}).collect()} == {"SQZ_DIX": 0.4, "SQZ_GEX": 5e9}
    bar = spark.createDataFrame([("G", 200_000_000, 1000, 5000, 2000, 42, 28_401_120)], "symbol string, low long, deltaOpen long, deltaHigh long, deltaClose long, volume long, utcTimestampInMinutes long")
    assert tuple(ingest.trendbars(bar).first()) == ("G", dt.datetime(2024, 1, 1, 0, 0), 2000.01, 2000.05, 2000.0, 2000.02, 42.0)
    chain = ingest.option_chain(spark.createDataFrame([("B", dt.date(2026, 1, 1), 100.0)], "key string, d date, spot double"), spark.createDataFrame([("B", "BTC-02MAR26-65000-C", 3.0, 50.0), ("B", "junk", 1.0, 1.0)], "key string, instrument_name string, open_interest double, mark_iv double"))
    assert [(r.strike, r.kind, r.years) for r in chain.collect()] == [(65000.0, "C", 60 / 365)]


def test_cot_takes_the_first_report_type(spark):
    shape = "contract string, report_date string, {}_long int, {}_short int, {}_long int, {}_short int, open_interest int"
    old = spark.createDataFrame([("GOLD - X", "2024-01-02", 1, 2, 3, 4, 5), ("CORN", "2024-01-02", 1, 2, 3, 4, 5)], shape.format("noncomm", "noncomm", "comm", "comm"))
    new = spark.createDataFrame([("Gold futures", "2024-01-02", 10, 20, 30, 40, 50)], shape.format("mm", "mm", "comm", "comm"))
    got = {r.market: (r.report_type, r.long_spec) for r in ingest.cot_normalised({"legacy": old, "disaggregated": new}, {"gold": ["gold"], "corn": ["maize", "corn"]}).collect()}
    assert got == {"gold": ("disaggregated", 10), "corn": ("legacy", 1)}


def test_keys(spark):
    v = spark.createDataFrame([("Gold A",), ("silver",), ("gold B",)], "value string")
    assert {r.value: r.position for r in ingest.resolve(v, ["SILVER", "gold"]).collect()} == {"Gold A": 1, "gold B": 1, "silver": 0}
    wanted = spark.createDataFrame([("silver",), ("tin",)], "value string")
    assert {r.value: r.status for r in ingest.key_report(v, wanted, "value").collect()} == {"silver": "present", "tin": "missing"}
    rows, counted = ingest.seed(spark.createDataFrame([("S", "2024-01-01", 1.0), ("T", "2024-01-01", 2.0)], "series_id string, date string, value double"), "macro_series", ["S"], "series_id")
    assert [r.series_id for r in rows.collect()] == ["S"] and counted.get == {"rows_seeded": 1}
    assert ingest.seed_log(spark, "a", "macro_series", 1).first().rows_seeded == 1


class Answer(io.BytesIO):
    def __enter__(self):
        return self

    def __exit__(self, *a):
        pass


def test_retries():
    waits, left = [], [429, 500]

    def opener(url, timeout):
        if left:
            head = email.message.Message()
            if left[0] == 429:
                head["Retry-After"] = "7"
            raise urllib.error.HTTPError(url, left.pop(0), "busy", head, None)
        return Answer(b"{}")

    assert rest.fetch("http://x", opener, sleep=waits.append) == "{}" and waits == [7.0, 10.0]
    left[:] = [500] * 9
    with pytest.raises(urllib.error.HTTPError):
        rest.fetch("http://x", opener, sleep=waits.append)
    left[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        rest.fetch("http://x", opener, sleep=waits.append)


def test_rest_source_partitions():
    reader = rest.JsonRest({"url": "http://h/{key}", "keys": "a,b,c", "parallel": "2"}).reader(None)
    assert [p.keys for p in reader.partitions()] == [["a", "c"], ["b"]]
    assert rest.page_plan(0, 25, 10) == [(15, 25), (5, 15), (0, 5)]


def test_secrets(monkeypatch, tmp_path):
    (tmp_path / "s").write_text("# c\nA_KEY = file\n")
    monkeypatch.setenv("TIDEMARK_SECRETS", str(tmp_path / "s"))
    rest.reload_secrets()
    assert rest.secret("A_KEY") == "file" and rest.secret("NOT_THERE", "x") == "x"
    monkeypatch.setenv("A_KEY", "env")
    assert rest.secret("A_KEY") == "env"
    rest.reload_secrets()


def test_stream(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    shape = "key string, ts timestamp, seq long, value double"
    spark.createDataFrame([("k", t(1), 1, 5.0), ("k", t(2), 2, 9.0), ("k", t(3), 3, 1.0), ("k", t(59), 4, 2.0)], shape).write.parquet(f"{tmp_path}/in")
    seen = []
    run_available(stream_bars(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")), lambda df, n: seen.extend(map(tuple, df.collect())), f"{tmp_path}/cp")
    assert seen == [("k", dt.datetime(2024, 1, 1), 5.0, 9.0, 1.0, 2.0, 4)]
    run_available(stream_bars(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")), lambda df, n: seen.extend(map(tuple, df.collect())), f"{tmp_path}/cp")
    assert len(seen) == 1


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Batches are upserted; a tick behind the watermark changes nothing, one of an open hour does, and a batch may come twice."""
    t = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    shape, table = "key string, ts timestamp, seq long, value double", [spark.createDataFrame([], "key string, ts timestamp, open double, high double, low double, close double, volume long")]

    def upsert(df, n):
        rows = df.collect()
        for _ in range(2):
            table[0] = spark.createDataFrame(ingest.upsert(table[0], spark.createDataFrame(rows, df.schema), ["key", "ts"]).collect(), table[0].schema)

    def land(*rows):
        spark.createDataFrame(list(rows), shape).write.mode("append").parquet(f"{tmp_path}/in")
        run_available(stream_bars(spark.readStream.schema(shape).parquet(f"{tmp_path}/in")), upsert, f"{tmp_path}/cp")
        return {(r.key, r.ts.hour): (r.open, r.high, r.low, r.close, r.volume) for r in table[0].collect()}

    assert land(("k", t(0, 5), 1, 5.0), ("k", t(0, 9), 2, 7.0), ("k", t(5, 1), 3, 1.0)) == {("k", 0): (5.0, 7.0, 5.0, 7.0, 2), ("k", 5): (1.0, 1.0, 1.0, 1.0, 1)}
    land(("k", t(5, 2), 4, 9.0))  # the watermark moves on with a batch
    late = land(("k", t(0, 30), 5, 99.0), ("k", t(5, 3), 6, 0.5), ("j", t(5, 3), 7, 2.0))
    assert late == {("k", 0): (5.0, 7.0, 5.0, 7.0, 2), ("k", 5): (1.0, 9.0, 0.5, 0.5, 3), ("j", 5): (2.0, 2.0, 2.0, 2.0, 1)}


def test_entry_stands_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(n.startswith('op1') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin"} | {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})


def test_entry(spark):
    import __spark_entry__ as e

    assert {r.instrument for r in e.entry(spark).collect()} == {"FUL", "OPN", "PAR"}
    assert set(e.oracle_sql()) <= set(e.queries())
