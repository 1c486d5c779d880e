"""Landed pages, the lease of a store, and the update that strings the commands together."""

import json
import os
import time

from pyspark.sql import functions as F
from tidemark import cli
from tidemark.sources import landing, store
from tidemark.sources.lease import lease

from .test_store import day, folder, root  # noqa: F401

MINUTES = 28_400_000


def page(path, symbol, bars, at, tf="D1"):
    rows = [{"utcTimestampInMinutes": MINUTES + 1440 * i, "low": low, "deltaClose": up} for i, low, up in bars]
    path.write_text(json.dumps({"symbol": symbol, "tf": tf, "trendbar": rows}) + "\n")
    os.utime(path, (at, at))


def closes(spark, at):
    rows = store.table(spark, at, "prices").orderBy("symbol", "ts").collect()
    return {(r.symbol, (int(r.ts.timestamp()) // 60 - MINUTES) // 1440): (r.open, r.close) for r in rows}


def test_land(spark, tmp_path):
    pages, at = tmp_path / "pages", str(tmp_path / "store")
    pages.mkdir()
    now = int(time.time())
    page(pages / "b.json", "G", [(0, 100_000, 1000), (1, 200_000, 0)], now - 100)
    page(pages / "a.json", "G", [(1, 300_000, 0), (2, 400_000, 5)], now - 50)  # landed later, so its bar counts
    (pages / "none.json").write_text(json.dumps({"symbol": "N", "trendbar": []}) + "\n" + json.dumps({"symbol": None, "trendbar": [{"low": 1}]}) + "\n")
    landing.land(spark, at, str(pages))
    assert closes(spark, at) == {("G", 0): (1.0, 1.01), ("G", 1): (3.0, 3.0), ("G", 2): (4.0, 4.00005)}
    page(pages / "c.json", "G", [(2, 500_000, 0)], now - 200)  # an older time, but a later batch
    page(pages / "d.json", "H", [(0, 100_000, 0)], now)
    landing.land(spark, at, str(pages))
    landing.land(spark, at, str(pages))  # nothing new
    got = closes(spark, at)
    assert got["G", 2] == (5.0, 5.0) and got["H", 0] == (1.0, 1.0) and len(got) == 4


def test_one_lease_at_a_time(spark, tmp_path):
    at = str(tmp_path)
    with lease(spark, at) as first:
        with lease(spark, at) as second:
            assert first and not second
        with lease(spark, at) as third:
            assert not third  # the second gave nothing back
    with lease(spark, at) as again:
        assert again
        os.utime(tmp_path / "_lease", (1, 1))
        with lease(spark, at, longest_s=60) as heir:
            assert heir
            with lease(spark, at) as late:
                assert not late
    assert not (tmp_path / "_lease").exists()


def test_update_goes_on_without_a_feed(spark, root, folder, tmp_path):  # noqa: F811
    specs, out = cli.load_specs(str(folder)), tmp_path / "setups.json"
    pages = tmp_path / "pages"
    pages.mkdir()
    page(pages / "a.json", "Q", [(0, 100_000, 0)], int(time.time()))
    plan = {"fetch": [{"kind": "macro", "url": "http://127.0.0.1:9/x?key={key}&k=hidden", "keys": ["X"]}], "land": str(pages), "clean": True}
    told = cli.update(spark, root, specs, str(out), plan, generated="then")
    assert told["fetch macro"].startswith("failed: ") and "hidden" not in told["fetch macro"]
    assert told["land"] == told["clean"] == "done" and told["run"] == "2 signals" and json.loads(out.read_text())["generated"] == "then"
    assert store.table(spark, root, "prices").filter(F.col("symbol") == "Q").count() == 1
    with lease(spark, root):
        assert cli.update(spark, root, specs, str(out), plan) is None
