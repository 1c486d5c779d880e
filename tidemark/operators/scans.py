"""Scans over long series: what a row needs of all rows before it, without one task a series.

A series is cut into slices of its order, so that (key, slice) deals it out to many tasks. Windows run within a slice; what
enters a slice comes from a pass over the slices of a key, a row each. That row is joined back on (key, slice), by which the rows
are dealt out already, so they are shuffled once however many scans follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
#: Days to a slice of a daily series, and rows to a block within which powers of a decay stay in range.
DAYS, BLOCK = 512, 128


def cut(rows: DataFrame, order: Column, width: int = DAYS) -> DataFrame:
    """``rows`` with the slice that their place in ``order`` (a number, such as a day's or second's) falls into."""
    return rows.withColumn(SLICE, F.floor(order / width))


def _within(key: str, order: str) -> Window:
    return Window.partitionBy(key, SLICE).orderBy(order)


def _entering(parts: DataFrame, key: str, **made: Column) -> DataFrame:
    """A row a slice with what ``made`` says of the slices before it; columns start with an underscore."""
    w = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(key, SLICE, *(x.over(w).alias(n) for n, x in made.items()))


def previous(rows: DataFrame, value: str, name: str, key: str = "key", order: str = "d") -> DataFrame:
    """Adds ``name``: the value of the row before, also across slices; null in a series' first row."""
    last = rows.groupBy(key, SLICE).agg(F.max_by(F.struct(value), order).alias("_last"))
    before = _entering(last, key, _before=F.last("_last"))
    own = F.lag(F.struct(value)).over(_within(key, order))
    return rows.withColumn("_own", own).join(before, [key, SLICE], "left").withColumn(name, F.coalesce("_own", "_before")[value]).drop("_own", "_before")


def running(rows: DataFrame, key: str | tuple[str, ...] = "key", order: str = "d", **values: Column) -> DataFrame:
    """Adds sums of ``values`` over all rows up to and with the row, under their names. Rows of equal order count together."""
    keys = [key] if isinstance(key, str) else list(key)
    sums = rows.groupBy(*keys, SLICE).agg(*(F.sum(x).alias(f"_{n}") for n, x in values.items()))
    w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, SLICE, *(F.sum(f"_{n}").over(w).alias(f"_{n}") for n in values))
    inside = Window.partitionBy(*keys, SLICE).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(x).over(inside).alias(n) for n, x in values.items())).join(before, [*keys, SLICE], "left")
    for n in values:
        out = out.withColumn(n, F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)))
    return out.drop(*(f"_{n}" for n in values))


def last_known(rows: DataFrame, value: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """``rows`` with nulls of ``value`` filled by the last value up to the row; rows of equal order see each other's."""
    known = F.when(F.col(value).isNotNull(), F.struct(order, value))
    last = rows.groupBy(*keys, SLICE).agg(F.max(known[order]).alias("_at"), F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    w = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*keys, SLICE, F.last("_last", ignorenulls=True).over(w).alias("_last"))
    inside = Window.partitionBy(*keys, SLICE).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, SLICE)]
    joined = filled.alias("a").join(before.alias("b"), on, "left")
    return joined.select(*(F.coalesce("a._own", "b._last").alias(c) if c == value else F.col(f"a.{c}").alias(c) for c in rows.columns))


def decayed(rows: DataFrame, flow: Column, decay: float, starts: DataFrame, key: str = "key", order: str = "d") -> DataFrame:
    """Adds ``before`` and ``after``: a level that each row multiplies by ``decay`` and adds its ``flow`` to, from the ``start`` of ``starts`` (key, start).

    A row is an affine map of the level, and so are a block, a slice and a series, by composition. Within a block a level is
    a sum of flows weighted by powers of the decay; blocks of a slice and slices of a series are folded in order.
    """
    a = F.lit(float(decay))
    i = F.row_number().over(_within(key, order)) - 1
    rows = rows.withColumn("_i", i).withColumn("_block", F.floor(F.col("_i") / BLOCK)).withColumn("_k", F.col("_i") % BLOCK).withColumn("_flow", flow)
    share = F.col("_flow") * F.pow(a, -F.col("_k"))
    inside = Window.partitionBy(key, SLICE, "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inner", F.coalesce(F.sum(share).over(inside), F.lit(0.0)) * F.pow(a, F.col("_k") - 1))

    def through(level: Column, part: Column) -> Column:
        return F.pow(a, part["n"]) * level + part["b"]

    parts = rows.groupBy(key, SLICE, "_block").agg(F.count("*").alias("n"), (F.sum(share) * F.pow(a, F.count("*") - 1)).alias("b"))
    slices = parts.groupBy(key, SLICE).agg(F.array_sort(F.collect_list(F.struct("_block", "n", "b"))).alias("_blocks"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("b"))
    whole = F.aggregate("_blocks", none, lambda s, x: F.struct((s["n"] + x["n"]).alias("n"), through(s["b"], x).alias("b")))
    slices = slices.withColumn("_whole", whole)

    def levels(items: str, start: Column) -> Column:
        """The level before each item, then that after the last."""
        return F.aggregate(items, F.array(start), lambda out, x: F.concat(out, F.array(through(F.element_at(out, -1), x))))

    series = slices.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(SLICE, "_whole.n", "_whole.b"))).alias("_slices")).join(starts.select(key, F.col("start").cast("double").alias("start")), key)
    entering = series.select(key, F.explode(F.arrays_zip(F.col(f"_slices.{SLICE}").alias(SLICE), levels("_slices", F.col("start")).alias("level"))).alias("x")).select(key, f"x.{SLICE}", "x.level").filter(F.col(SLICE).isNotNull())
    levelled = slices.join(entering, [key, SLICE]).select(key, SLICE, levels("_blocks", F.col("level")).alias("_levels"))
    out = rows.join(levelled, [key, SLICE]).withColumn("before", F.element_at("_levels", F.col("_block").cast("int") + 1) * F.pow(a, F.col("_k")) + F.col("_inner"))
    return out.withColumn("after", a * F.col("before") + F.col("_flow")).drop("_i", "_block", "_k", "_flow", "_inner", "_levels")
