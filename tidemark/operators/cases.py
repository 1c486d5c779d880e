"""Parameters that differ from case to case, where a case is a key of the rows.

Frames and lags of different widths stand side by side over one sort of the rows, so that cases with parameters of their
own go through one plan; each row takes what its case asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Choice:
    """A parameter with a value for each key."""

    def __init__(self, by_key: Mapping[str, Any]):
        if not by_key:
            raise ValueError("a choice needs a case")
        self.values: dict[str, tuple[Any, list[str]]] = {}
        for key, value in by_key.items():
            self.values.setdefault(repr(value), (value, []))[1].append(key)


def pick(param: Any, make: Callable[[Any], Column] = F.lit) -> Column:
    """``make(param)``; of a ``Choice``, what ``make`` gives for the value of each row's key."""
    if not isinstance(param, Choice):
        return make(param)
    (value, _), *more = param.values.values()
    out = make(value)
    for value, keys in more:
        out = F.when(F.col("key").isin(keys), make(value)).otherwise(out)
    return out
