"""Operators on keyed series: as-of joins, calendar frames, seasonal baselines.

A series is a DataFrame (key, d DATE, v DOUBLE) with one row per key and day. A probe is (key, as_of).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from . import scans
from .cases import Choice, pick


def asof(
    left: DataFrame, right: DataFrame, on: str, right_on: str, values: list[str], keys: tuple[str, ...] = ("key",), lag_days: int = 0, max_age_days: int | None = None, prefix: str = "",
    width: int | None = None,
) -> DataFrame:
    """Backward inclusive as-of join: each left row with the last right row of its keys on or before ``on``, a day or a timestamp.

    A right row is visible ``lag_days`` after its time, and gives nulls when older than ``max_age_days``.
    One shuffle: both sides are interleaved in time and the last right row is carried forward. By default a key's rows
    meet in one task; with ``width`` (days, or seconds of timestamps) they are dealt out by slices of time too, and a pass
    over slices, a row each, carries the last right row from slice to slice. That is for few keys with long series.
    """
    dated = isinstance(left.schema[on].dataType, DateType)
    later = F.date_add(right_on, lag_days) if dated else F.col(right_on) + F.expr(f"INTERVAL {lag_days} DAYS")
    clock = lambda x: F.unix_date(x) if dated else F.unix_micros(F.col(x).cast("timestamp") if isinstance(x, str) else x.cast("timestamp"))
    row = F.struct(F.col(right_on).alias("_day"), *values)
    r = right.select(*keys, clock(later).cast("long").alias("_t"), row.alias("_r"), F.lit(None).cast(left.schema.simpleString()).alias("_l"))
    m = left.select(*keys, clock(on).cast("long").alias("_t"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_l"))
    both = m.unionByName(r)
    if width is None:
        w = Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w))
    else:
        out = scans.last_known(scans.cut(both, F.col("_t"), width * (1 if dated else 1_000_000)), "_r", keys, "_t")
    out = out.filter(F.col("_l").isNotNull())
    if max_age_days is not None:
        out = out.withColumn("_r", F.when(F.datediff(F.col(f"_l.{on}"), F.col("_r._day")) <= max_age_days, F.col("_r")))
    return out.select("_l.*", *(F.col(f"_r.{v}").alias(prefix + v) for v in values))


def spine_ratio(a: DataFrame, b: DataFrame, width: int | None = None) -> DataFrame:
    """a / b carried forward, on a's days; days without b, or with b = 0, are left out."""
    both = asof(a, b.withColumnRenamed("v", "w"), "d", "d", ["w"], width=width)
    return both.filter(F.coalesce("w", F.lit(0.0)) != 0).select("key", "d", (F.col("v") / F.col("w")).alias("v"))


def spine_spread(a: DataFrame, b: DataFrame, width: int | None = None) -> DataFrame:
    """a - b carried forward, on a's days."""
    both = asof(a, b.withColumnRenamed("v", "w"), "d", "d", ["w"], width=width)
    return both.filter(F.col("w").isNotNull()).select("key", "d", (F.col("v") - F.col("w")).alias("v"))


def rows_before(key: str = "key", order: str = "d") -> Window:
    return Window.partitionBy(key).orderBy(order)


def expanding(key: str = "key", order: str = "d"):
    return rows_before(key, order).rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int, key: str = "key", order: str = "d"):
    return rows_before(key, order).rowsBetween(-(n - 1), 0)


def counts_at_most(points: DataFrame, queries: DataFrame) -> DataFrame:
    """(key, id, n): of each query (key, id, t, v), the points (key, t, v) of its key with no later t and no larger v.

    Values become ranks, and ranks bits. A point with rank below the query's leaves its path at the first bit that differs,
    where the query has a one and the point a zero: so points go to the blocks of equal higher bits for each of their
    zeros, queries for each of their ones, and a count over time within each block gives what a query is to add up. That
    is some twelve rows for each of two thousand points of a key, and no row holds a window's values.
    """
    both = points.select("key", "t", "v", F.lit(None).cast("long").alias("id"), F.lit(1).alias("own")).unionByName(queries.select("key", "t", "v", "id", F.lit(0).alias("own")))
    ranked = both.withColumn("rank", F.dense_rank().over(Window.partitionBy("key").orderBy("v")))  # of points from 1
    ranked = ranked.withColumn("rank", F.col("rank") - F.col("own"))  # of points from 0, and a query's is above its equals'
    most = F.max("rank").over(Window.partitionBy("key"))
    placed = ranked.withColumn("levels", F.length(F.bin(most)))
    wanted = F.filter(F.sequence(F.lit(0), F.col("levels") - 1), lambda j: F.getbit(F.col("rank").cast("long"), j) == 1 - F.col("own"))
    each = placed.select("key", "t", "id", "own", "rank", F.explode(wanted).alias("level"))
    each = each.withColumn("block", F.expr("shiftright(rank, level + 1)"))
    w = Window.partitionBy("key", "level", "block").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    return each.withColumn("n", F.sum("own").over(w)).filter("own = 0").groupBy("key", "id").agg(F.sum("n").alias("n"))


def look_back(probes: DataFrame, series: DataFrame, days: int | Choice) -> DataFrame:
    """(key, as_of, cur, n, share) of each distinct probe: of the values in [as_of - days, as_of] the last one, their number, and the share at or below the last."""
    rows = series.filter(F.col("v").isNotNull()).select("key", "d", "v", F.row_number().over(rows_before()).alias("rn"))
    # Both ends of a look-back are brought to the series together, and meet again without a shuffle.
    at = lambda day, last: F.struct(day.alias("at"), F.lit(last).alias("last"))
    ends = probes.select("key", "as_of").distinct().select("key", "as_of", F.explode(F.array(at(F.col("as_of"), True), at(F.date_sub("as_of", pick(days) + 1), False))).alias("e"))
    found = asof(ends.select("key", "as_of", "e.*"), rows, "at", "d", ["d", "v", "rn"])
    end = lambda c, last=True: F.max(F.when(F.col("last") == last, F.col(c)))
    now = found.groupBy("key", "as_of").agg(end("d").alias("d"), end("v").alias("v"), end("rn").alias("rn"), end("rn", False).alias("gone"), end("at", False).alias("_from"))
    inside = F.col("d") > F.col("_from")
    now = now.select("key", "as_of", F.when(inside, F.col("v")).alias("cur"), F.coalesce(F.when(inside, F.col("rn")), F.lit(0)).alias("rn"), F.coalesce(F.when(inside, F.coalesce("gone", F.lit(0))), F.lit(0)).alias("gone"))
    return _shares(rows.select("key", F.col("rn").alias("t"), "v"), now)


def last_rows_share(rows: DataFrame, count: int | Choice) -> DataFrame:
    """``rows`` (key, d, v) with cur, n and share over the last ``count`` of them: null values take a place and count for nothing."""
    placed = rows.select("key", "d", "v", F.row_number().over(rows_before()).alias("rn"), F.count("v").over(expanding()).alias("known"), F.last("v", ignorenulls=True).over(expanding()).alias("last"))
    gone = F.coalesce(pick(count, lambda n: F.lag("known", n).over(rows_before())), F.lit(0))
    now = placed.select("key", F.col("d").alias("as_of"), "last", "known", gone.alias("gone"))
    now = now.select("key", "as_of", F.when(F.col("known") > F.col("gone"), F.col("last")).alias("cur"), F.col("known").alias("rn"), "gone")
    return _shares(placed.filter("v IS NOT NULL").select("key", F.col("known").alias("t"), "v"), now).withColumnRenamed("as_of", "d")


def _shares(points: DataFrame, now: DataFrame) -> DataFrame:
    """(key, as_of, cur, n, share) of ``now`` (key, as_of, cur, rn, gone): among a key's points those numbered from gone + 1 to rn."""
    named = now.withColumn("id", F.unix_date("as_of").cast("long"))
    edges = named.filter("cur IS NOT NULL").select("key", "id", F.col("cur").alias("v"), F.explode(F.array(F.struct(F.lit(1).alias("sign"), F.col("rn").alias("t")), F.struct(F.lit(-1).alias("sign"), F.col("gone").alias("t")))).alias("e"))
    edges = edges.filter("e.t > 0").select("key", (F.col("id") * 2 + (F.col("e.sign") > 0).cast("long")).alias("id"), F.col("e.t").alias("t"), "v")
    counted = counts_at_most(points, edges)
    sides = counted.groupBy("key", F.expr("CAST(floor(id / 2) AS long)").alias("id")).agg(F.sum(F.when(F.col("id") % 2 != 0, F.col("n")).otherwise(-F.col("n"))).alias("least"))
    n = (F.col("rn") - F.col("gone")).cast("long")
    out = named.join(sides, ["key", "id"], "left")
    return out.select("key", "as_of", "cur", n.alias("n"), (F.coalesce("least", F.lit(0)) / F.nullif(n, F.lit(0))).alias("share"))


def seasonal_baseline(rows: DataFrame, half_width: int | Choice, exclude: int) -> DataFrame:
    """``rows`` (key, d, v) with n_all, and mean, sd, n of the values around the same day of the year.

    Days of the year lie on a circle of 366; of the past, the last ``exclude`` rows are left out. Every row
    goes to the buckets of the days near it, so that a frame over a bucket replaces a theta join.
    """
    w = Window.partitionBy("key").orderBy("d")
    doy = F.dayofyear("d")
    near = rows.withColumn("rn", F.row_number().over(w)).select("*", F.explode(F.sequence(-pick(half_width), pick(half_width))).alias("k"))
    near = near.withColumn("bucket", F.pmod(doy - 1 + F.col("k"), F.lit(366)) + 1)
    past = Window.partitionBy("key", "bucket").orderBy("rn").rangeBetween(Window.unboundedPreceding, -exclude)
    out = near.select("key", "d", "v", "k", F.col("rn").alias("n_all"), F.avg("v").over(past).alias("mean"), F.stddev_pop("v").over(past).alias("sd"), F.count("v").over(past).alias("n"))
    return out.filter("k = 0").drop("k")
