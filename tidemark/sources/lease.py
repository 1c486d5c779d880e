"""One run at a time: a file in the store whose creation succeeds for one of several runs, on any machine."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from .manifest import _path, _text, create_once


@contextmanager
def lease(spark: SparkSession, root: str, longest_s: float = 6 * 3600.0) -> Iterator[bool]:
    """Whether this run alone holds the store's lease, which it gives back at the end.

    A lease older than ``longest_s``, which is to be longer than any run takes, is that of a run that died: the run
    that succeeds in renaming it away may try for the lease again.
    """
    path, own = f"{root}/_lease", uuid.uuid4().hex
    p, fs = _path(spark, path)
    mine = create_once(spark, path, own)
    if not mine and fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 > longest_s:
        gone, _ = _path(spark, f"{path}-{own}")
        if fs.rename(p, gone):
            fs.delete(gone, False)
            mine = create_once(spark, path, own)
    try:
        yield mine
    finally:
        if mine and fs.exists(p) and _text(spark, path) == own:
            fs.delete(p, False)
