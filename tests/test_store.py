"""The store, copies of other databases, and the commands from end to end."""

import datetime as dt
import json
import math
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from tidemark import cli
from tidemark.queries import QUERIES
from tidemark.plans import score
from tidemark.sources import feeds, ingest, rest, schemas, shared, store

D0 = dt.date(2010, 1, 1)
DERBY = "jdbc:derby:memory:other;create=true"


def day(i):
    return D0 + dt.timedelta(i)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    """A store with two symbols, one of them with a wrong scale here and there, and the series that they go by."""
    root, r = str(tmp_path_factory.mktemp("store")), random.Random(3)
    store.create(spark, root)
    bars, series, level, hidden = [], [], 0.0, 0.0
    for i in range(900):
        hidden = 0.97 * hidden + r.gauss(0, 1)
        level += 0.002 * hidden + r.gauss(0, 0.01)
        series.append(("M", day(i), 100 + hidden))
        for symbol, sign in (("AAA", 1), ("BBB", -1)):
            c = 100 * math.exp(sign * level)
            off = 0.1 if symbol == "BBB" and i in (300, 301, 555) else 1.0
            bars.append((symbol, "D1", dt.datetime(2010, 1, 1) + dt.timedelta(i), *(off * x for x in (c, c * 1.01, c * 0.99, c * 1.002)), 1.0))
    store.put(spark, root, "prices", spark.createDataFrame(bars, schemas.schema("prices")))
    store.put(spark, root, "macro_series", spark.createDataFrame(series, schemas.schema("macro_series")))
    return root


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    f = tmp_path_factory.mktemp("specs")
    for name, ticker, when in (("one", "AAA", "high"), ("two", "BBB", "low")):
        engine = ", engine: scenario, min_prob_tp: 0.0, min_expectancy_r: -9" if name == "two" else ""
        (f / f"{name}.yaml").write_text(
            f"id: {name.title()}\nticker: {ticker}\ndrivers:\n"
            f"  - {{name: momentum, weight: 0.6, params: {{series: M, horizon_days: 5, bull_when: {when}}}}}\n"
            f"  - {{name: price_momentum, weight: 0.4, params: {{symbol: {ticker}, horizon_days: 10}}}}\n"
            f"base_rate: {{horizon_days: 10, band: 0.2, min_effective_n: 5, min_hit_rate_pct: 1, min_expectancy_r: -5{engine}}}\n"
        )
    (f.parent / "swaps.yml").write_text("one: {long_cost_pct_per_day: 0.0001, short_cost_pct_per_day: 0.0001}\n")
    return f


def test_put_and_counts(spark, root):
    assert schemas.row_count(spark, root, "prices") == 1800 and schemas.row_count(spark, root, "gamma") == 0
    with pytest.raises(KeyError):
        schemas.row_count(spark, root, "nothing")
    store.put(spark, root, "macro_series", spark.createDataFrame([("N", day(1), 1.0), ("N", day(1), 2.0)], schemas.schema("macro_series")).coalesce(1))
    store.put(spark, root, "macro_series", spark.createDataFrame([("N", day(1), None)], schemas.schema("macro_series")), keep_missing=True)
    assert store.table(spark, root, "macro_series").filter("series_id = 'N'").first().value == 2.0
    assert schemas.row_count(spark, root, "macro_series") == 901
    env = store.environment(spark, root)
    assert env["macro"].filter("key = 'M'").count() == 900 and env["bars"].columns[:2] == ["key", "d"] and env["etf"].count() == 0


def test_specifications(folder):
    specs = {f["id"]: f for f in cli.load_specs(str(folder), str(folder.parent / "swaps.yml"))}
    assert specs["One"]["swap"]["long_cost_pct_per_day"] == 0.0001 and "swap" not in specs["Two"]


def test_run_writes_the_document(spark, root, folder, tmp_path):
    specs, out = cli.load_specs(str(folder), str(folder.parent / "swaps.yml")), tmp_path / "out/setups.json"
    document = cli.run(spark, root, specs, str(out), generated="then")
    assert json.loads(out.read_text()) == document and document["as_of"] == day(899).isoformat()
    found = {s["instrument"]: s for s in document["signals"]}
    assert set(found) == {"One", "Two"} and all(s["prob_tp"] + s["prob_sl"] + s["prob_time"] == pytest.approx(1) for s in found.values())
    assert all(s["p05"] < s["median"] < s["p95"] and len(s["drivers"]) == 2 and s["data_quality"] == "short history" for s in found.values())
    assert found["One"]["n"] > 20 and "scenario" not in found["One"]["reject_reason"] and "base rate" not in found["Two"]["reject_reason"]
    before = out.stat().st_mtime_ns
    cli.run(spark, root, specs, str(out), generated="later")  # says nothing new
    assert out.stat().st_mtime_ns == before
    early = cli.run(spark, root, specs, str(out), as_of=day(700).isoformat(), generated="then")
    assert early["as_of"] == day(700).isoformat() and {s["as_of"] for s in early["signals"]} == {day(700).isoformat()}
    assert {s["history_years"] for s in early["signals"]} == {1.9}


def test_validate_and_ablate(spark, root, folder):
    specs = cli.load_specs(str(folder))
    checked, folds = cli.validate(spark, root, specs, day(600).isoformat())
    rows = {r.instrument: r for r in checked.collect()}
    assert all(r.n_train > 40 and r.n_oos > 40 and set(r.driver_ic) == {"momentum", "price_momentum"} for r in rows.values())
    assert {r.fold for r in folds.collect()} == {2011, 2012}
    deltas = cli.ablate(spark, root, specs, "momentum", day(600).isoformat()).collect()
    assert {r.instrument for r in deltas} == {"One", "Two"} and all(r.delta == pytest.approx(100 * (r.ablated - r.base), abs=0.01) for r in deltas)


def test_arbitrate(spark, root, tmp_path):
    document = cli.arbitrate(spark, root, str(tmp_path / "a/models.json"))
    assert set(document["models"]) == {"AAA", "BBB"} and all(m["winner"] in ("fhs", "normal") for m in document["models"].values())


def test_clean(spark, root):
    assert cli.clean(spark, root) == 3 and cli.clean(spark, root, apply=True) == 3 and cli.clean(spark, root) == 0
    assert schemas.row_count(spark, root, "prices") == 1800


def test_seed_from_another_database(spark, tmp_path):
    macro = spark.createDataFrame([("A", dt.date(2024, 1, i), float(i)) for i in range(1, 9)] + [("B", dt.date(2024, 1, 1), 5.0), ("C", dt.date(2024, 1, 1), 6.0)], "series_id string, date date, value double")
    macro.write.format("jdbc").option("url", DERBY).option("dbtable", "macro").option("createTableColumnTypes", "series_id VARCHAR(64)").mode("overwrite").save()
    plan = {"macro_series": {"table": "macro", "key": "series_id", "keys": ["A", "B", "Z"]}}
    told = {(r.key, r.status) for r in cli.inspect(spark, DERBY, plan).collect()}
    assert told == {("A", "present"), ("B", "present"), ("Z", "missing")}
    root = str(tmp_path / "store")
    assert cli.seed(spark, root, DERBY, plan) == {"macro_series": 9} and cli.seed(spark, root, DERBY, plan) == {"macro_series": 9}
    assert schemas.row_count(spark, root, "macro_series") == 9 and schemas.row_count(spark, root, "seed_log") >= 1
    parts = store.external(spark, DERBY, "macro", "value", (1, 9), 3)
    assert parts.rdd.getNumPartitions() == 3 and parts.count() == 10


def test_fetch_over_http(spark, tmp_path):
    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.rsplit("/", 1)[1]
            rows = {"X": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-01-02", "value": "."}], "Y": [{"date": "2024-01-03", "value": "2"}]}[name]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"observations": rows}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/{{key}}"
    assert cli.fetch(spark, str(tmp_path / "s"), "macro", url, ["X", "Y"]) == 2
    assert {(r.series_id, r.value) for r in store.table(spark, str(tmp_path / "s"), "macro_series").collect()} == {("X", 1.5), ("Y", 2.0)}
    server.shutdown()


def test_fetch_of_every_kind(spark, tmp_path, monkeypatch):
    """Regions with their places, the two calls of a chain, a CSV file, default series, and a key that comes from a secret."""
    asked = []
    book = [{"instrument_name": f"BTC-02MAR36-{k}-{c}", "open_interest": 3.0, "mark_iv": 50.0} for k, c in ((60000, "C"), (70000, "P"), (80000, "C"))]
    daily = {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [3.0], "temperature_2m_min": [1.0, 2.0], "precipitation_sum": [0.0, 5.5]}

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            at, q = urllib.parse.urlparse(self.path), urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query)
            said = {
                "/weather": {"daily": daily}, "/options/get_index_price": {"result": {"index_price": 65000.0}}, "/options/get_book_summary_by_currency": {"result": book},
                "/macro": {"observations": [{"date": "2024-01-01", "value": "1.5"}]},
            }.get(at.path)
            assert at.path != "/macro" or q["api_key"] == ["hidden"]
            text = "date,price,dix,gex\n2024-01-01,5,0.4,5e9\n2024-01-02,5,,5e9\n" if said is None else json.dumps(said)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(text.encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base, root = f"http://127.0.0.1:{server.server_port}", str(tmp_path / "s")
    monkeypatch.setenv("SERIES_KEY", "hidden")
    assert cli.fetch(spark, root, "weather", f"{base}/weather", ["us_cotton", "own=1.5:-2.5"], "2024-01-01") == 4
    got = {(x.region, x.date.day): (x.tmax, x.tmin, x.precip) for x in store.table(spark, root, "weather").collect()}
    assert got["own", 1] == (3.0, 1.0, 0.0) and got["us_cotton", 2] == (None, 2.0, 5.5)
    assert any("latitude=33.58&longitude=-101.86&start_date=2024-01-01" in x for x in asked) and any("latitude=1.5&longitude=-2.5" in x for x in asked)
    assert cli.fetch(spark, root, "options", f"{base}/options", ["BTC=Bitcoin"]) == 1
    row = store.table(spark, root, "gamma").first()
    assert (row.instrument, row.spot) == ("Bitcoin", 65000.0) and row.gamma_center > 0
    assert cli.fetch(spark, root, "squeeze", f"{base}/dix.csv") == 2
    assert cli.fetch(spark, root, "macro", f"{base}/macro", ["A"], secret="SERIES_KEY") == 1
    assert {(x.series_id, x.value) for x in store.table(spark, root, "macro_series").collect()} == {("SQZ_DIX", 0.4), ("SQZ_GEX", 5e9), ("A", 1.5)}
    assert len(feeds.requests("macro", "https://host/x")) == 7 and [k for k, _ in feeds.requests("energy", "https://host/v2", api_key="k")] == list(rest.ENERGY_SERIES)
    assert "hidden" not in feeds.answers(spark, [("A", f"{base}/macro?api_key=hidden")])._jdf.queryExecution().toString()
    for kind, keys in (("nothing", None), ("weather", ["nowhere"])):
        with pytest.raises(KeyError):
            feeds.requests(kind, "https://host", keys)
    server.shutdown()


def test_missing_series_are_told(spark, root, folder, tmp_path, capsys):
    env = store.environment(spark, root)
    specs = [{"id": "a", "ticker": "AAA", "drivers": [{"name": "momentum", "params": {"series": "M"}}, {"name": "price_ratio", "params": {"numerator": "AAA", "denominator": "GONE"}}]}, {"id": "b", "ticker": "LOST", "drivers": []}]
    assert {(x.instrument, x.driver, x.kind, x.series) for x in score.missing_series(env, specs).collect()} == {("a", "price_ratio", "closes", "GONE"), ("b", "ticker", "closes", "LOST")}
    assert score.missing_series(env, cli.load_specs(str(folder))).count() == 0


def test_command_line(spark, root, folder, tmp_path, capsys):
    cli.main(["run", "--store", root, "--specs", str(folder), "--out", str(tmp_path / "x.json")])
    assert "2 signals" in capsys.readouterr().out and (tmp_path / "x.json").exists()
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_energy_series():
    url = rest.energy_url("https://host/v2", "WCESTUS1", "k", "2020-01-01")
    assert url.startswith("https://host/v2/petroleum/stoc/wstk/data/?") and "facets%5Bseries%5D%5B%5D=WCESTUS1" in url and "start=2020-01-01" in url
    with pytest.raises(KeyError):
        rest.energy_url("https://host", "none", "k")


def test_option_answers(spark):
    one = lambda text: spark.createDataFrame([("B", json.dumps(text))], "key string, payload string")
    book = [{"instrument_name": "BTC-02MAR26-65000-C", "open_interest": 3.0, "mark_iv": 50.0, "interest_rate": 0.04}, {"instrument_name": "junk", "open_interest": 1.0}]
    got = ingest.option_payloads(one({"result": {"index_price": 64000.0}}), one({"result": book}), F.lit("2026-01-01").cast("date")).collect()
    assert [(r.spot, r.strike, r.oi, r.rate) for r in got] == [(64000.0, 65000.0, 3.0, 0.04)]


def test_report_types_by_market(spark):
    shape = "contract string, report_date string, {}_long int, {}_short int, {}_long int, {}_short int, open_interest int"
    old = spark.createDataFrame([("GOLD", "2024-01-02", 1, 2, 3, 4, 5), ("EURO FX", "2024-01-02", 6, 2, 3, 4, 5)], shape.format("noncomm", "noncomm", "comm", "comm"))
    tff = spark.createDataFrame([("EURO FX", "2024-01-02", 7, 2, 3, 4, 5), ("GOLD", "2024-01-02", 8, 2, 3, 4, 5)], shape.format("lev_funds", "lev_funds", "dealer", "dealer"))
    markets = {"gold": {"contracts": ["gold"], "types": ["legacy", "tff"]}, "eur": {"contracts": ["euro fx"], "types": ["tff", "legacy"]}, "other": {"contracts": ["gold"], "types": ["ice"]}}
    got = {r.market: (r.report_type, r.long_spec) for r in ingest.cot_normalised({"legacy": old, "tff": tff}, markets).collect()}
    assert got == {"gold": ("legacy", 1), "eur": ("tff", 7)}
    with pytest.raises(ValueError):
        ingest.cot_normalised({"legacy": old}, {"x": {"contracts": ["a"], "types": ["unheard"]}})


def test_other_copies(spark):
    mix = spark.createDataFrame([("2024-01-01", "45.5"), ("2024-01-16", None)], "day string, sugar_pct string")
    assert [tuple(r) for r in ingest.as_series(mix, "MIX", "day", "sugar_pct").collect()] == [("MIX", dt.date(2024, 1, 1), 45.5)]
    quoted = spark.createDataFrame([('"2024-01-01","1,5","0.4","5e9"',)], "value string")
    assert [tuple(r) for r in ingest.dix_csv(quoted).collect()] == [(dt.date(2024, 1, 1), 0.4, 5e9)]
    both = spark.createDataFrame([("a", day(0), None, 2.0), ("a", day(1), 1.0, 2.0), ("a", day(2), None, None)], schemas.schema("etf_holdings"))
    assert [r.v for r in ingest.holdings(both).orderBy("d").collect()] == [2.0, 1.0]


def test_shared_tables(spark):
    df = shared.materialize(spark.range(3).toDF("id"), "numbers")
    assert df.count() == 3 and shared.session_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_sources_are_read_once(spark):
    """A score's plan reads the daily rows that were kept, not the source tables again for each driver."""
    plan = QUERIES["score_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_shipdate" not in plan and "o_orderdate" not in plan
