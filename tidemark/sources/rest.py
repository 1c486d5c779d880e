"""JSON over HTTP as a Spark data source: one partition per requested key, with retries and spacing.

``spark.dataSource.register(JsonRest)`` then ``spark.read.format("json_rest").option("keys", "a,b")
.option("url", "https://host/path?id={key}").load()`` gives (key, payload), as does an option ``requests.secret`` with
a JSON list of keys and addresses. The opener can be replaced, which the tests do; nothing is fetched at planning.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY_ON = (429, 500, 502, 503, 504)


def fetch(url: str, opener: Callable = urllib.request.urlopen, tries: int = 4, pause: float = 5.0, sleep: Callable = time.sleep) -> str:
    """The body of ``url``. A busy or failing server is asked again after Retry-After, else after pause, 2 pause, 4 pause ..."""
    for k in range(tries):
        try:
            with opener(url, timeout=30) as answer:
                return answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_ON or k + 1 == tries:
                raise
            after = e.headers.get("Retry-After") if e.headers else None
            sleep(float(after) if after and after.isdigit() else pause * 2**k)
        except (urllib.error.URLError, TimeoutError):
            if k + 1 == tries:
                raise
            sleep(pause * 2**k)
    raise AssertionError("unreachable")


class _Part(InputPartition):
    def __init__(self, calls: list[tuple[str, str]]):
        self.calls = calls

    @property
    def keys(self) -> list[str]:
        return [k for k, _ in self.calls]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if "requests.secret" in options:
            self.calls = [tuple(x) for x in json.loads(options["requests.secret"])]
        else:
            self.calls = [(k, options["url"].replace("{key}", k)) for k in options.get("keys", "").split(",") if k]
        self.spacing = float(options.get("spacing", "1"))
        self.parallel = int(options.get("parallel", "1"))  # of one server, politely

    def partitions(self):
        n = max(1, min(self.parallel, len(self.calls)))
        return [_Part(self.calls[i::n]) for i in range(n)]

    def read(self, partition):
        from . import rest

        for i, (key, url) in enumerate(partition.calls):
            if i:
                time.sleep(self.spacing)
            yield key, rest.fetch(url)


class JsonRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_rest"

    def schema(self) -> str:
        return "key string, payload string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


_secrets: dict[str, str] | None = None


def reload_secrets() -> None:
    """Forget the secrets file; it is read again at the next use."""
    global _secrets
    _secrets = None


def secret(name: str, default: str | None = None, path: str | None = None) -> str | None:
    """From the environment, else from a KEY=VALUE file (``TIDEMARK_SECRETS``), else ``default``."""
    global _secrets
    if name in os.environ:
        return os.environ[name]
    if _secrets is None:
        _secrets = {}
        file = path or os.environ.get("TIDEMARK_SECRETS")
        if file and os.path.exists(file):
            with open(file) as f:
                _secrets = dict((p.strip() for p in line.split("=", 1)) for line in f if "=" in line and not line.lstrip().startswith("#"))
    return _secrets.get(name, default)


#: Energy stocks by name: the data route and the series' facet (fixed values).
ENERGY_SERIES = {
    "WCESTUS1": ("petroleum/stoc/wstk", "WCESTUS1"),
    "NG_STOR_L48": ("natural-gas/stor/wkly", "NW2_EPG0_SWO_R48_BCF"),
}


def energy_url(base: str, key: str, api_key: str, start: str | None = None, length: int = 5000) -> str:
    """The address of a registered weekly series, oldest first."""
    if key not in ENERGY_SERIES:
        raise KeyError(f"unknown energy series {key}; there are {sorted(ENERGY_SERIES)}")
    route, facet = ENERGY_SERIES[key]
    query = {"api_key": api_key, "frequency": "weekly", "data[0]": "value", "facets[series][]": facet, "sort[0][column]": "period", "sort[0][direction]": "asc", "length": length}
    return f"{base.rstrip('/')}/{route}/data/?{urllib.parse.urlencode(query | ({'start': start} if start else {}))}"


def page_plan(first_ms: int, last_ms: int, chunk_ms: int) -> list[tuple[int, int]]:
    """[from, to) windows of a history, newest first: one input partition each of a paginated feed."""
    out = []
    while last_ms > first_ms:
        out.append((max(first_ms, last_ms - chunk_ms), last_ms))
        last_ms = out[-1][0]
    return out
