"""Indicators from a stream, in any batches and over restarts, against a plain loop."""

import datetime as dt
import math
import random
import statistics

import pytest
from tidemark.streaming.indicators import SCHEMA, indicators, run_to_files

T0 = dt.datetime(2024, 3, 1)
SHAPE = "key string, ts timestamp, seq long, value double"


def plain(ticks, until):
    """Bars that end by ``until``, with range and volatility, of each key."""
    out = {}
    for key in {t[0] for t in ticks}:
        hours = {}
        for _, ts, seq, v in sorted(x for x in ticks if x[0] == key):
            hours.setdefault(ts.replace(minute=0, second=0, microsecond=0), []).append((ts, seq, v))
        old, xs, ranges = None, [], []
        for hour in sorted(hours):
            if hour + dt.timedelta(hours=1) > until:
                continue
            v = [x[2] for x in sorted(hours[hour])]
            ranges.append(max(v) - min(v) if old is None else max(max(v) - min(v), abs(max(v) - old), abs(min(v) - old)))
            x = None if old is None else math.log(v[-1]) - math.log(old)
            xs += [] if x is None else [x]
            level = None
            if len(xs) >= 20:
                level = statistics.pvariance(xs[:20])
                for e in xs:
                    level = 0.94 * level + 0.06 * e * e
            old = v[-1]
            out[key, hour] = (v[0], max(v), min(v), v[-1], len(v), x, sum(ranges[-14:]) / 14 if len(ranges) >= 14 else None, None if level is None else level**0.5)
    return out


def test_indicators_over_batches_and_restarts(spark, tmp_path):
    r = random.Random(12)
    ticks = [(r.choice("ab"), T0 + dt.timedelta(minutes=6 * i - r.randint(0, 8), seconds=r.randint(0, 59)), i, round(math.exp(r.gauss(3, 0.3)), 3)) for i in range(700)]
    ticks += [("a", ticks[5][1], 900, 7.0), ("a", ticks[5][1], 901, 8.0)]  # of one instant
    cuts = [0, 150, 151, 420, len(ticks)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):  # each landing is a run of its own, from the checkpoint
        spark.createDataFrame(ticks[a:b], SHAPE).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        run_to_files(indicators(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in"), late="30 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")
        if n == 1:
            run_to_files(indicators(spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in"), late="30 minutes"), f"{tmp_path}/out", f"{tmp_path}/cp")  # nothing new
    kept = ticks[:700]  # the two late ones came long after their hour was closed
    want = plain(kept, max(t[1] for t in kept) - dt.timedelta(minutes=30))
    rows = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/out").collect()
    got = {(x.key, x.ts): (x.open, x.high, x.low, x.close, x.volume, x.log_return, x.atr, x.next_sigma) for x in rows}
    assert len(rows) == len(got) and set(got) == set(want) and len(want) > 100
    for k, v in want.items():
        assert got[k] == tuple(None if e is None else pytest.approx(e) for e in v)
    assert any(v[-1] for v in want.values())
