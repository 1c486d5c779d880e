"""Structure repair of conversations: the cheapest edits that make roles alternate and leave no faulty turn.

A conversation should read ``(s?(ua)+)?`` by its roles' initials: an optional system turn, then user and assistant in
turns. Blank and repeated turns must be deleted (4), turns may be kept (0), given the other role (3), or empty ones
inserted anywhere (3); a turn that is cut off costs 3 more if it stays. Of the cheapest edits those win whose initials
(Delete, Insert, Keep, Rerole) are least as ASCII.

Windows derive the faults of each turn, whose initial and faults then are one letter. Letters are collected in order,
by slices of 256 turn numbers first, and ``aggregate`` folds them over four states (nothing yet, after system, after user,
after assistant), each the least struct of (cost, audit). Two audits of one state and one cost never are prefixes of each
other, as all letters after the shorter one would be inserts, which cost; so the least audit stays least whatever follows,
and the fold is exact.

No text is collected: a conversation's row holds a byte a turn, as its audit does. Texts stay rows, dealt out by conversation
and slice, so that a hot conversation spreads over tasks; only its hash, a sequential one, goes over its turns in order, in
one task that holds one turn at a time.

Defined results: null ids are one conversation; null turns come first; turns of equal number are ordered by role and text;
a null role or text is one space, so a null text is blank and a null role can only be given another; an empty role can't be
kept either; repeated rows are duplicates; a very long text is judged whole; other columns, also of names that differ in case
only, play no part; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, only, sliced

#: Turn numbers to a slice of a conversation.
SLICE = 256
#: Prices of edits and of a cut-off turn that stays.
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3


def conversations(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of any table of conversations, with one space for a null role or text."""
    own = only(rows, "conv_id", "turn", "role", "text")
    return own.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(n).cast("string"), F.lit(" ")).alias(n) for n in ("role", "text")))


def damaged(rows: DataFrame) -> DataFrame:
    """The turns with one in four damaged, by a hash of ``conv_id:turn``: dropped, emptied, cut off, repeated or given to the user."""
    named = [F.coalesce(F.col(n).cast("string"), F.lit(" ")) for n in ("conv_id", "turn")]
    kind = F.crc32(F.encode(F.concat(named[0], F.lit(":"), named[1]), "UTF-8")) % 20
    made = turns(rows).withColumn("kind", kind).filter("kind != 0")
    made = made.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    made = made.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return made.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``turns`` with their slice, place in it (rn, from 1), initial, new_turn, and the first fault that holds: blank, duplicate, truncated or none."""
    end = F.substring(F.regexp_replace("text", "[\\x20\\x09-\\x0D]+$", ""), -1, 1)
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    seen = Window.partitionBy("conv_id", "same").orderBy("turn")
    place = Window.partitionBy("conv_id", "slice").orderBy("turn", "role", "text", "again")  # of equal rows the repeated ones come last
    first = rows.withColumn("same", same).withColumn("again", F.row_number().over(seen) > 1).drop("same")
    fault = F.when(end == "", "blank").when(F.col("again"), "duplicate").when(~end.isin(".", "!", "?"), "truncated").otherwise("none")
    return (
        first.withColumn("fault", fault).withColumn("slice", F.floor(F.col("turn") / SLICE)).withColumn("initial", F.substring("role", 1, 1))
        .withColumn("rn", F.row_number().over(place)).withColumn("new_turn", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(place))).drop("again")
    )


def _edit(state: Column, cost, letter: str) -> Column:
    """``state`` with an edit added; an unreachable state is null and stays so."""
    return F.when(state.isNotNull(), F.struct((state["cost"] + cost).cast("long").alias("cost"), F.concat(state["audit"], F.lit(letter)).alias("audit")))


def _step(acc: Column, letter: Column) -> Column:
    """One turn, with the inserts that stand before it. Letters: x must go; s, u, a, o (another initial), in capitals if cut off."""
    none, system, user, assistant = (acc[f"s{i}"] for i in range(4))
    kind = F.lower(letter)
    stays, cut = kind != "x", F.when(kind == letter, 0).otherwise(CUT_OFF)

    def inserted(state, n):
        return _edit(state, INSERT * n, "I" * n)

    to_user = [user, inserted(none, 1), inserted(system, 1), inserted(assistant, 1)]
    to_assistant = [assistant, inserted(user, 1), inserted(none, 2), inserted(system, 2)]

    def taken(state, role):  # kept or given the role that fits
        return F.when(stays, F.when(kind == role, _edit(state, cut, "K")).otherwise(_edit(state, cut + REROLE, "R")))

    def deleted(state):
        return _edit(state, DELETE, "D")

    return F.struct(
        deleted(none).alias("s0"),
        F.least(deleted(system), F.when(kind == "s", _edit(none, cut, "K"))).alias("s1"),
        F.least(*map(deleted, to_user), *(taken(x, "u") for x in (none, system, *to_assistant))).alias("s2"),
        F.least(*map(deleted, to_assistant), *(taken(x, "a") for x in to_user)).alias("s3"),
    )


def audits(judged: DataFrame) -> DataFrame:
    """A row a conversation that has turns: counts of faults, gaps, illegal neighbours, cost, audit, and ``slices`` (slice, size, before)."""
    known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    counts = [F.sum((F.col("fault") == n).cast("long")).alias(n) for n in ("blank", "duplicate", "truncated")]
    in_order = F.array_sort(F.collect_list(F.struct("rn", letter.alias("letter"), known.alias("initial"))))
    part = judged.groupBy("conv_id", "slice").agg(
        *counts, F.min("turn").alias("least"), F.max("turn").alias("most"), F.sum(F.col("new_turn").cast("long")).alias("numbers"), F.count("*").alias("size"), in_order.alias("turns")
    )
    part = part.withColumn("letters", F.array_join("turns.letter", "")).withColumn("initials", F.array_join("turns.initial", "")).drop("turns")
    whole = part.groupBy("conv_id").agg(
        *(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "numbers")), F.min("least").alias("least"), F.max("most").alias("most"),
        F.array_sort(F.collect_list(F.struct(F.col("slice").isNotNull().alias("numbered"), "slice", "size", "letters", "initials"))).alias("parts"),
    )
    initials, letters = F.array_join("parts.initials", ""), F.array_join("parts.letters", "")
    legal = F.length(initials) - F.length(F.regexp_replace(initials, "(?<=s)u|(?<=u)a|(?<=a)u", ""))
    blank = "CAST(NULL AS struct<cost: bigint, audit: string>)"
    start = F.expr(f"named_struct('s0', named_struct('cost', 0L, 'audit', ''), 's1', {blank}, 's2', {blank}, 's3', {blank})")
    end = F.col("end")
    best = F.least(end["s0"], end["s3"], _edit(end["s2"], INSERT, "I"), _edit(end["s0"], 2 * INSERT, "II"), _edit(end["s1"], 2 * INSERT, "II"))
    before = F.transform("parts", lambda p, i: F.struct(p["slice"].alias("slice"), p["size"].alias("size"), F.aggregate(F.slice("parts.size", 1, i), F.lit(0).cast("long"), lambda a, x: a + x).alias("before")))
    return (
        whole.withColumn("end", F.aggregate(F.split(letters, ""), start, lambda acc, x: F.when(x == "", acc).otherwise(_step(acc, x))))
        .withColumn("best", best)
        .select(
            "conv_id", F.when(F.col("least").isNull(), 0).otherwise(F.col("most") - F.col("least") + 1 - F.col("numbers")).cast("long").alias("gaps"),
            "blank", "duplicate", "truncated", (F.length(initials) - 1 - legal).cast("long").alias("illegal"), "best.cost", "best.audit", before.alias("slices"),
        )
    )


def edits(judged: DataFrame, found: DataFrame) -> DataFrame:
    """``judged`` with ``edit``: the letters of the audit that stand for the turn, with the inserts before it (and behind the last turn)."""
    pieces = F.regexp_extract_all("audit", F.lit("I*[DKR](I+$)?"), 0)
    part = found.select("conv_id", pieces.alias("pieces"), F.explode("slices").alias("s")).select("conv_id", "s.slice", F.expr("slice(pieces, CAST(s.before AS int) + 1, CAST(s.size AS int))").alias("pieces"))
    a, b = judged.alias("a"), part.alias("b")
    return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.slice").eqNullSafe(F.col("b.slice"))).select("a.*", F.element_at("b.pieces", F.col("a.rn")).alias("edit"))


def _applied(batches):
    """(conv_id, role, text) of the repaired turns, from sorted rows of (conv_id, role, text, edit)."""
    other = {"u": "assistant", "a": "user", "s": "user", "": "user"}
    at, last = None, ""
    for b in batches:
        for conv, role, text, edit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (conv,):
                at, last = (conv,), ""
            for letter in edit:
                if letter == "D":
                    continue
                name, said = (role, text) if letter == "K" else (other[last], text if letter == "R" else "")
                last = name[0]
                yield conv, name, said


def _in_order(edited: DataFrame) -> DataFrame:
    return edited.repartition("conv_id").sortWithinPartitions("conv_id", "slice", "rn").select("conv_id", "role", "text", "edit")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position from 0, role, text."""

    def run(batches):
        held, at, n = [], None, 0
        for conv, role, text in _applied(sliced(batches)):
            at, n = ((conv,), 0) if at != (conv,) else (at, n + 1)
            held.append((conv, n, role, text))
            if len(held) == 1000:
                yield _batch(held)
                held = []
        yield _batch(held)

    def _batch(held):
        kinds = {"conv_id": pa.int64(), "position": pa.int64(), "role": pa.string(), "text": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    judged = faults(turns(rows))
    with modest_batches(rows.sparkSession):
        return _in_order(edits(judged, audits(judged))).mapInArrow(run, "conv_id long, position long, role string, text string")


def _hashes(batches):
    """(conv_id, hash of the repaired turns) for each conversation of which a turn remains."""
    ids, out, at, h = [], [], None, None
    for conv, role, text in _applied(sliced(batches)):
        if at != (conv,):
            if at:
                ids.append(at[0]), out.append(h.hexdigest())
            at, h = (conv,), hashlib.sha256()
        else:
            h.update(b"\n")
        h.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
    if at:
        ids.append(at[0]), out.append(h.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["conv_id", "repaired_sha256"])


def structure(rows: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """Faults, cost, audit and hash of the repaired text of every conversation of ``original`` (``rows``, if not given)."""
    judged = faults(turns(rows))
    found = audits(judged)
    hashed = _in_order(edits(judged, found)).mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    ids = turns(rows if original is None else original).select("conv_id").distinct()
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = ids.alias("i").join(found.alias("f"), F.expr("i.conv_id <=> f.conv_id"), "left").join(hashed.alias("h"), F.expr("i.conv_id <=> h.conv_id"), "left")
    return out.select(
        "i.conv_id", *(F.coalesce(f"f.{n}", F.lit(0).cast("long")).alias(n) for n in longs), F.coalesce("f.audit", F.lit("")).alias("audit"),
        F.coalesce("h.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op11_structure_repair(spark, sf_dir):
    rows = conversations(spark, sf_dir)
    with modest_batches(spark):
        return structure(damaged(rows), rows)


def crc32_sql(name: str) -> str:
    """SQL for the crc32 of an ASCII string: after each byte eight shifts, which -1 stands for."""
    bits = f"flatten(list_transform(range(1, length({name}) + 1), lambda i: [unicode(substr({name}, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda c, x: {step}), 4294967295)"


def oracle_sql() -> str:
    """A state is a string there: the cost in twelve digits, then the audit, so that the least string is the least struct."""

    def edit(state, cost, letters):
        return f"lpad(CAST(CAST(left({state}, 12) AS BIGINT) + {cost} AS VARCHAR), 12, '0') || substr({state}, 13) || '{letters}'"

    users = ["f.s2", edit("f.s0", 3, "I"), edit("f.s1", 3, "I"), edit("f.s3", 3, "I")]
    assistants = ["f.s3", edit("f.s2", 3, "I"), edit("f.s0", 6, "II"), edit("f.s1", 6, "II")]

    def moves(sources, role):
        return [f"CASE WHEN stays THEN CASE WHEN initial = '{role}' THEN {edit(s, 'cut', 'K')} ELSE {edit(s, '3 + cut', 'R')} END END" for s in (f"({x})" for x in sources)]

    s2 = ", ".join([*(edit(f"({s})", 4, "D") for s in users), *moves(["f.s0", "f.s1", *assistants], "u")])
    s3 = ", ".join([*(edit(f"({s})", 4, "D") for s in assistants), *moves(users, "a")])
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} AS name FROM conversations),
kinds AS (SELECT *, {crc32_sql("name")} % 20 AS kind FROM named),
made AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM kinds, range(2) r(n) WHERE kind <> 0 AND (n = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM made),
told AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS closing FROM placed),
judged AS (SELECT *, CASE WHEN closing = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN closing NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM told),
t AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut FROM judged),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM t GROUP BY conv_id),
fold AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, '000000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM sums
    UNION ALL SELECT f.conv_id, f.k + 1, {edit("f.s0", 4, "D")}, least({edit("f.s1", 4, "D")}, CASE WHEN stays AND initial = 's' THEN {edit("f.s0", "cut", "K")} END), least({s2}), least({s3})
    FROM fold f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.k = f.k + 1),
best AS (SELECT f.conv_id, least(s0, s3, {edit("s2", 3, "I")}, {edit("s0", 6, "II")}, {edit("s1", 6, "II")}) AS b FROM fold f JOIN sums s ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND s.n = f.k),
replay AS (SELECT conv_id, substr(b, 13) AS audit, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS k, '' AS last, CAST(NULL AS VARCHAR) AS lines FROM best
    UNION ALL SELECT conv_id, audit, i, k, CASE letter WHEN 'D' THEN last ELSE left(line, 1) END, CASE letter WHEN 'D' THEN lines ELSE coalesce(lines || chr(10), '') || line END FROM (
        SELECT r.conv_id, r.audit, r.i + 1 AS i, r.last, r.lines, substr(r.audit, r.i + 1, 1) AS letter, CASE WHEN letter = 'I' THEN r.k ELSE r.k + 1 END AS k,
            CASE letter WHEN 'K' THEN t.role ELSE CASE r.last WHEN 'u' THEN 'assistant' ELSE 'user' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE t.text END AS line
        FROM replay r LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND t.k = r.k + 1 WHERE r.i < length(r.audit))),
hashes AS (SELECT conv_id, audit, sha256(coalesce(lines, '')) AS h FROM replay WHERE i = length(audit))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(CAST(left(b, 12) AS BIGINT), 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN hashes h ON h.conv_id IS NOT DISTINCT FROM c.conv_id"""
