"""Quality rules: measures of each document, and lines that too many documents of a host share.

Lines are normalised (case and white space), hashed, and counted over the distinct documents of
each host; copies of one whole text are one document there. A line on more than ``most_share`` of its
host's distinct documents, and on more than ``least_docs`` of them, is boilerplate there. A document with
such lines whose others hold less than ``least_left`` of its words, or fewer than ``least_words`` words, is
depleted and rejected, as are those that fail the base rules.

Counting is a two-step aggregation (distinct text and line, then line), combined before each
shuffle; the verdicts come from an equi-join that Spark can split at hot lines. No line's documents
meet in one task.

Defined results: a null text has no words and is rejected; repeated rows are judged each; a null
host is a host of its own; other columns, also of names that differ in case only, play no part and
are kept by ``keep_good``; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, only, place, plain, recounted, sliced

# White space, and the characters that count as symbols.
_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def measures(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeat = 0
    if n > 3:
        h = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
        window = h[:-2] * _MIX[0] + h[1:-1] * _MIX[1] + h[2:] * _MIX[2]
        order = np.sort(window)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            hit = np.flatnonzero(np.isin(window, twice))
            mark = np.zeros(n, bool)
            for k in range(3):
                mark[hit + k] = True
            repeat = int(mark.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def _lines(text: str) -> dict[int, int]:
    """Hash of each distinct normalised line -> its words, over all its occurrences."""
    out: dict[int, int] = {}
    for line in text.split("\n"):
        if w := line.lower().encode("utf-8", "surrogatepass").split():
            key = xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63)
            out[key] = out.get(key, 0) + len(w)
    return out


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: A line is boilerplate above this share of its host's distinct documents, and this number of them.
MOST_SHARE, LEAST_DOCS = 0.05, 5
#: A document that lost lines needs this share of its words, and this number of them, in the others.
LEAST_LEFT, LEAST_WORDS = 0.3, 50


def judge(docs: DataFrame, most_share: float = MOST_SHARE, least_docs: int = LEAST_DOCS, least_left: float = LEAST_LEFT, least_words: int = LEAST_WORDS, carry: bool = False) -> DataFrame:
    """doc_id, host, the measures, ``boilerplate_words``, ``base_failed`` and ``kept``; with ``carry`` also ``doc``, the row (c0, c1 ...), and ``boilerplate``, its lines' hashes."""

    def run(rows):
        for b in sliced(rows):
            texts = [t or "" for t in b.column(2).to_pylist()]
            made = list(zip(*map(measures, texts), strict=True)) or [[]] * 5
            lines = [_lines(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in made),
                    pa.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], pa.int64()),
                    pa.array([list(x) for x in lines], pa.list_(pa.int64())), pa.array([list(x.values()) for x in lines], pa.list_(pa.int64())), *b.columns[3:],
                ],
                names=["doc_id", "host", *_MEASURES, "content", "line", "words"] + ["doc"] * carry,
            )

    key, source, text = (F.col(place(docs, n)) for n in ("doc_id", "source", "text"))
    row = plain(docs)
    base = row.select(key.cast("long").alias("doc_id"), source.alias("host"), text.alias("text"), *([F.struct(*row.columns).alias("doc")] if carry else []))
    schema = "doc_id long, host string, " + ", ".join(f"{n} long" for n in _MEASURES) + ", content long, line array<long>, words array<long>"
    held = materialize(base.mapInArrow(run, schema + (f", doc {base.schema['doc'].dataType.simpleString()}" if carry else "")).withColumn("row", F.monotonically_increasing_id()), "lines")
    site = F.xxhash64(F.coalesce("host", F.lit("\0")))
    each = held.select("row", "content", site.alias("site"), F.explode(F.arrays_zip("line", "words")).alias("l"))
    each = each.select("row", "content", "site", F.xxhash64("site", "l.line").alias("key"), F.col("l.line").alias("line"), F.col("l.words").alias("words"))
    sizes = held.select(site.alias("site"), "content").distinct().groupBy("site").agg(F.count("*").alias("n_docs"))
    often = each.groupBy("key", "content").agg(F.min("site").alias("site")).groupBy("key").agg(F.count("*").alias("docs"), F.min("site").alias("site")).filter(F.col("docs") > least_docs)
    often = often.join(sizes, "site").filter(F.col("docs") > most_share * F.col("n_docs")).select("key")
    lost = each.join(often, "key").groupBy("row").agg(F.sum("words").alias("boilerplate_words"), *([F.collect_list("line").alias("boilerplate")] if carry else []))
    out = held.drop("content", "line", "words").join(lost, "row", "left").withColumn("boilerplate_words", F.coalesce("boilerplate_words", F.lit(0)))
    left = F.col("n_words") - F.col("boilerplate_words")
    return (
        out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & ~((F.col("boilerplate_words") > 0) & ((left < least_left * F.col("n_words")) | (left < least_words))))
        .drop("row")
    )


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; the columns are those of ``docs``, and ``n_chars`` follows the text."""
    row = plain(docs)
    judged = judge(docs, carry=True, **limits).filter("kept").select("doc.*", F.col("boilerplate").alias("lines"))
    at = docs.columns.index("text")

    def run(rows):
        for b in sliced(rows):
            texts = []
            for text, lines in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                if lines:
                    drop = set(lines)
                    text = "\n".join(x for x in text.split("\n") if drop.isdisjoint(_lines(x)))
                texts.append(text)
            kept = [*b.columns[:-1]]
            kept[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(kept, names=b.schema.names[:-1])

    return recounted(judged.mapInArrow(run, row.schema), docs)


def op7_quality(spark, sf_dir):
    return judge(only(documents(spark, sf_dir), "doc_id", "source", "text")).drop("host")


def oracle_sql() -> str:
    space = "\\x20\\x09-\\x0D"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{space}]+') AS w FROM documents),
places AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS g FROM d WHERE len(w) > 2),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM places),
again AS (SELECT r, count(DISTINCT i + k) AS n_repeat FROM grams, range(3) x(k) WHERE n > 1 GROUP BY 1),
split AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT r, host, t, line, regexp_extract_all(lower(line), '[^{space}]+') AS lw FROM split WHERE regexp_matches(line, '[^{space}]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM lines GROUP BY 1),
host_size AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY 1),
often AS (SELECT host, lw FROM lines JOIN host_size USING (host) GROUP BY 1, 2 HAVING count(DISTINCT t) > {LEAST_DOCS} AND count(DISTINCT t) > {MOST_SHARE} * any_value(n)),
lost AS (SELECT r, sum(len(lw)) AS n_lost FROM lines JOIN often USING (host, lw) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[{space}]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lost, 0) AS BIGINT) AS boilerplate_words FROM d LEFT JOIN again USING (r) LEFT JOIN dup USING (r) LEFT JOIN lost USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - boilerplate_words AS still FROM m)
SELECT * EXCLUDE (still), NOT base_failed AND NOT (boilerplate_words > 0 AND (still < {LEAST_LEFT} * n_words OR still < {LEAST_WORDS})) AS kept FROM b"""
