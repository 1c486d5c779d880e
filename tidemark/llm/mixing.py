"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

The token mass of each (source, lang, topic) cell is raked until the sums by source, by language
and by topic meet their targets; each cell's factor is its documents' weight. Documents are then
sampled without repetition with probability proportional to the weight, the most wanted cell in
full. A document's draw is a hash of its id, or of its text where it has none, so it is the same on
every run and cluster.

Targets of a marginal are a table of shares (value, share), a dictionary of shares, or an exponent that
flattens the natural shares (1 keeps them, 0 makes them equal). Values without a share get none. The
documents are read twice: for the table of cells, and for the draw. Raking works on that table; windows
over one marginal at a time spread over the cluster, and their rows were aggregated before, so a hot source
is one row a cell there. ``residuals`` tells how near the targets the weights come.

Defined results: null attributes count as empty ones, which are a value of their own; documents without tokens keep the
weight of their cell; repeated rows share one draw; other columns are kept, also those whose names
differ in case only or begin with mix_; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, place, plain

DIMS = ("source", "lang", "topic")
#: Exponents of the natural shares in the production mix.
TARGETS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
ROUNDS, ROUNDS_AT_ONCE, SEED = 8, 4, "mix-1"
#: Topics by surface form, first match wins, then by length; the SQL of the query uses the same lists.
TOPICS = (("markup", ("***", "###", "$$$", "%%%", "&&&")), ("shout", ("!! ",)), ("table", (" | ",)), ("mail", ("@",)))
LENGTHS = (("note", 80), ("story", 250), ("article", 700))


def topic(text: Column) -> Column:
    test = lambda marks: reduce(Column.__or__, (text.contains(m) for m in marks))
    (first, marks), *more = TOPICS
    out = F.when(test(marks), first)
    for name, marks in more:
        out = out.when(test(marks), name)
    for name, below in LENGTHS:
        out = out.when(tokens(text) < below, name)
    return out.otherwise("book")


def tokens(text: Column) -> Column:
    """Words at single spaces: what a mix is measured in."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).cast("long")


def _wanted(sums: DataFrame, target: float | dict[str, float] | DataFrame) -> DataFrame:
    """(value, want) of the values of one marginal (value, m, total)."""
    if isinstance(target, dict):
        pairs = F.create_map(*(F.lit(x) for kv in target.items() for x in kv)) if target else F.create_map().cast("map<string,double>")
        return sums.select("value", F.coalesce(F.try_element_at(pairs, F.col("value")), F.lit(0.0)).alias("want"))
    if isinstance(target, DataFrame):
        return sums.join(target.select("value", F.col("share").cast("double").alias("want")), "value", "left").select("value", F.coalesce("want", F.lit(0.0)).alias("want"))
    return sums.select("value", F.when(F.col("m") > 0, F.pow(F.col("m") / F.col("total"), F.lit(target))).otherwise(0.0).alias("want"))


def goals(cells: DataFrame, targets: dict) -> dict[str, DataFrame]:
    """(value, goal) for each marginal of ``cells``: the mass that its values are to have."""
    whole, out = cells.agg(F.sum("mass").alias("total")), {}
    for d, target in targets.items():
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("mass").alias("m")).crossJoin(F.broadcast(whole))  # one row
        want = _wanted(sums, target)
        scale = want.agg(F.sum("want").alias("all")).crossJoin(whole).select((F.col("total") / F.nullif("all", F.lit(0.0))).alias("scale"))
        out[d] = want.crossJoin(F.broadcast(scale)).select("value", (F.col("want") * F.col("scale")).alias("goal"))  # one row
    return out


def rake(cells: DataFrame, targets: dict = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (the dimensions, ``mass``; a table as ``materialize`` gives) with ``weight``: the factor that fits all marginals."""
    dims, out = list(targets), cells
    for d, goal in goals(cells, targets).items():
        out = out.join(goal.select(F.col("value").alias(d), F.col("goal").alias(f"to_{d}")), d)
    out = materialize(out.withColumn("weight", F.lit(1.0)), "cells")
    for k in range(rounds):
        for d in dims:
            now = F.sum(F.col("mass") * F.col("weight")).over(Window.partitionBy(d))
            out = out.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"to_{d}") / now).otherwise(F.col("weight")))
        if (k + 1) % ROUNDS_AT_ONCE == 0 and k + 1 < rounds:
            out = materialize(out, "raked")
    return out.drop(*(f"to_{d}" for d in dims))


def residuals(raked: DataFrame, targets: dict = TARGETS) -> DataFrame:
    """(dim, value, goal, mass): what each marginal is to have and what it has. Targets that no weights can meet show here."""
    parts = []
    for d, goal in goals(raked.select(*targets, "mass"), targets).items():
        got = raked.groupBy(F.col(d).alias("value")).agg(F.sum(F.col("mass") * F.col("weight")).alias("mass"))
        parts.append(goal.join(got, "value").select(F.lit(d).alias("dim"), "value", "goal", "mass"))
    return reduce(DataFrame.unionByName, parts)


def _mixed(docs: DataFrame, targets: dict, seed: str) -> DataFrame:
    """The rows of ``docs`` (c0, c1 ...) with topic, tokens, weight, probability and sampled."""
    key, text, source, lang = (F.col(place(docs, n)) for n in ("doc_id", "text", "source", "lang"))
    known = plain(docs).select("*", F.coalesce(source, F.lit("")).alias("source"), F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(topic(text), F.lit("note")).alias("topic"), tokens(text).alias("tokens"))
    cells = materialize(known.groupBy(*targets).agg(F.sum("tokens").cast("double").alias("mass")), "masses")
    cells = materialize(rake(cells, targets), "weights")
    most = cells.agg(F.max("weight").alias("most"))
    cells = cells.crossJoin(F.broadcast(most)).select(*targets, "weight", (F.col("weight") / F.col("most")).alias("probability"))  # one row
    name = F.coalesce(key.cast("string"), F.md5(F.coalesce(text, F.lit(""))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return known.withColumn("draw", draw).join(cells, list(targets)).withColumn("sampled", F.col("draw") < F.col("probability"))


def mix(docs: DataFrame, targets: dict = TARGETS, seed: str = SEED) -> DataFrame:
    """All rows of ``docs`` with mix_topic, mix_tokens, mix_weight, mix_probability and mix_sampled after their own columns."""
    names = ("topic", "tokens", "weight", "probability", "sampled")
    return _mixed(docs, targets, seed).select(*plain(docs).columns, *names).toDF(*docs.columns, *(f"mix_{n}" for n in names))


def sample(docs: DataFrame, targets: dict = TARGETS, seed: str = SEED) -> DataFrame:
    """The sampled rows of ``docs``, with their own columns."""
    return _mixed(docs, targets, seed).filter("sampled").select(*plain(docs).columns).toDF(*docs.columns)


def op4_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return mix(docs.select("doc_id", "text", "source", "lang")).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("tokens"), F.round("mix_weight", 6).alias("weight"), F.round("mix_probability", 6).alias("probability"), F.col("mix_sampled").alias("sampled")
    )


def oracle_sql() -> str:
    when = " ".join("WHEN " + " OR ".join(f"contains(text, '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in TOPICS)
    count = "CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END"
    lengths = " ".join(f"WHEN {count} < {below} THEN '{name}'" for name, below in LENGTHS)
    steps = [
        f"""known AS (SELECT doc_id, text, source, lang, coalesce(source, '') AS s, coalesce(lang, '') AS l, CASE {when} {lengths} ELSE 'book' END AS t,
        CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS n FROM documents)""",
        "mass AS (SELECT s, l, t, CAST(sum(n) AS DOUBLE) AS mass FROM known GROUP BY ALL)",
        "total AS (SELECT sum(mass) AS total FROM mass)",
    ]
    for c, d in zip("slt", DIMS, strict=True):
        steps.append(f"want_{c} AS (SELECT {c}, CASE WHEN sum(mass) > 0 THEN pow(sum(mass) / any_value(total), {TARGETS[d]}) ELSE 0 END AS want, any_value(total) AS total FROM mass, total GROUP BY {c})")
        steps.append(f"to_{c} AS (SELECT {c}, want * total / (SELECT sum(want) FROM want_{c}) AS goal FROM want_{c})")
    steps.append("w0 AS (SELECT m.*, a.goal AS to_s, b.goal AS to_l, c.goal AS to_t, 1.0::DOUBLE AS w FROM mass m JOIN to_s a USING (s) JOIN to_l b USING (l) JOIN to_t c USING (t))")
    k = 0
    for _ in range(ROUNDS):
        for c in "slt":
            now = f"sum(mass * w) OVER (PARTITION BY {c})"
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (w), CASE WHEN {now} > 0 THEN w * to_{c} / {now} ELSE w END AS w FROM w{k})")
            k += 1
    steps.append(f"p AS (SELECT s, l, t, w, w / (SELECT max(w) FROM w{k}) AS p FROM w{k})")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, source, lang, t AS topic, CAST(n AS BIGINT) AS tokens, round(w, 6) AS weight, round(p, 6) AS probability,
    CAST(concat('0x', substr(md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))))), 1, 8)) AS BIGINT) / 4294967296.0 < p AS sampled
FROM known JOIN p USING (s, l, t)"""
    )
