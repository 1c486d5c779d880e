"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible. Sorted by size, each group enters the bin with the tightest
remaining capacity that holds it, found in a balanced tree of the open bins. With a fixed number of
shards, the smallest capacity at which all groups fit is searched; groups larger than an even share
get a shard of their own.

Only a histogram of group sizes reaches the driver. Sizes from 2^13 on are rounded up to 13
significant bits, so it has at most 8,192 + 4,096 x 50 rows at any scale. Groups of one class are
interchangeable; their ranks come from a range sort, and slots in a shard from counts by partition.

Defined results: a null text has size 1 and is not equal to an empty one; repeated rows belong to
one group; null ids are rows like others; other columns, also of names that differ in case only, are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, only, partitions


class Tree:
    """A treap of (remaining capacity, bin): the tightest bin in logarithmic time."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _rank(key) -> int:
        return hash((key, 0x5EED)) & 0xFFFFFFFF

    def _split(self, t, key):  # below key, and the rest
        if t is None:
            return None, None
        k, l, r = t
        if k < key:
            a, b = self._split(r, key)
            return (k, l, a), b
        a, b = self._split(l, key)
        return a, (k, b, r)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if self._rank(a[0]) > self._rank(b[0]):
            return a[0], a[1], self._merge(a[2], b)
        return b[0], self._merge(a, b[1]), b[2]

    def add(self, key) -> None:
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, (key, None, None)), b)

    def take(self, size: int):
        """Removes and returns the least (capacity, bin) of at least ``size``, or None."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            return None
        if b[1] is None:  # the root is the least
            self.root = self._merge(a, b[2])
            return b[0]
        path, t = [], b
        while t[1] is not None:
            path.append(t)
            t = t[1]
        rest = t[2]
        for k, _, r in reversed(path):
            rest = (k, rest, r)
        self.root = self._merge(a, rest)
        return t[0]


def best_fit(classes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, bin, count) for (size, count) classes in falling order of size.

    Opens bins as needed; with ``bins`` given, None if they don't do. All items of a class that the
    tightest bin holds go there at once: after each of them it is still the tightest.
    """
    tree, opened, out = Tree(), 0, []
    for size, count in classes:
        while count:
            found = tree.take(size)
            if found is None:
                if opened == bins or size > capacity:
                    return None
                found, opened = (capacity, opened), opened + 1
            room, b = found
            n = min(count, room // size)
            out.append((size, b, n))
            count -= n
            tree.add((room - n * size, b))
    return out


def plan(classes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """Best fit into exactly ``bins`` bins at the smallest capacity found, sizes near equal."""
    classes = sorted(([s, c] for s, c in classes if c), reverse=True)
    out: list[tuple[int, int, int]] = []
    first, total = 0, sum(s * c for s, c in classes)
    while classes and bins - first > 1 and classes[0][0] * (bins - first) > total:  # a share of its own
        s = classes[0][0]
        out.append((s, first, 1))
        total, first = total - s, first + 1
        classes[0][1] -= 1
        classes = classes if classes[0][1] else classes[1:]
    if classes:
        low = max(-(-total // (bins - first)), classes[0][0])
        high = 2 * low
        best = best_fit(classes, high, bins - first)
        while high - low > max(1, low // 100_000):
            mid = (low + high) // 2
            if (got := best_fit(classes, mid, bins - first)) is not None:
                best, high = got, mid
            else:
                low = mid + 1
        best = best_fit(classes, low, bins - first) or best
        out += [(s, b + first, n) for s, b, n in best]
    return out


def size_class(size: str):
    """Column ``size``, rounded up to 13 significant bits."""
    step = F.expr(f"shiftleft(1L, greatest(length(bin({size})) - 13, 0))")
    up = F.col(size) + step - 1
    return (up - F.pmod(up, step)).cast("long")


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    spark = docs.sparkSession
    n = partitions(spark)
    docs, text = only(docs, "doc_id", "text"), F.col("text")
    digest = docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias("content"),
    )
    digest = materialize(digest, "digest")
    groups = digest.groupBy("content").agg(F.sum("size").alias("bytes")).withColumn("class", size_class("bytes"))
    groups = groups.repartitionByRange(n, "class", "content").withColumn("part", F.spark_partition_id())
    groups = materialize(groups.withColumn("at", F.row_number().over(Window.partitionBy("part", "class").orderBy("content"))), "groups")
    # A class spreads over neighbouring partitions; ranks continue from one to the next.
    counts = groups.groupBy("class", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = [(r["class"], r["n"]) for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect()]
    taken: dict[int, int] = {}
    dealt = []
    for size, b, k in plan(histogram, n_shards):
        at = taken.get(size, 0)
        dealt.append((size, b, at, at + k))
        taken[size] = at + k
    dealt = spark.createDataFrame(dealt, "class long, shard int, low long, high long")
    rank = F.col("before") + F.col("at") - 1
    placed = groups.join(counts.drop("n"), ["class", "part"]).join(dealt, "class").filter((rank >= F.col("low")) & (rank < F.col("high"))).select("content", "shard")
    rows = digest.join(placed, "content").drop("content").repartitionByRange(n, "doc_id", "text_crc32").withColumn("part", F.spark_partition_id())
    rows = materialize(rows.withColumn("at", F.row_number().over(Window.partitionBy("part", "shard").orderBy("doc_id", "text_crc32"))), "sharded")
    ahead = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    slot = (F.col("before") + F.col("at") - 1).cast("long").alias("slot")
    return rows.join(ahead, ["shard", "part"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark, sf_dir):
    return shard_documents(documents(spark, sf_dir))
