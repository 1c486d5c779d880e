"""Structure repair and the prefix trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from tidemark.llm import structure, trie

SCHEMA = "conv_id long, turn long, role string, text string"
EXTRA = ["TEXT", "Conv_ID", "slice", "rn", "edit", "fault", "same", "letters", "node", "path", "c0"]


def text(v):
    return " " if v is None else str(v)


def by_conversation(rows):
    out = defaultdict(list)
    for conv, turn, role, said in rows:
        out[conv].append((turn, text(role), text(said)))
    return out


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, said in rows:
        kind = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        said = "" if kind == 1 else re.sub("[.!?]", "", said) if kind == 2 else said
        out[conv] += [(turn, "user" if kind == 4 else role, said)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def first_faults(turns):
    seen, out = set(), []
    for _, role, said in turns:
        last = re.findall(r"[^\x20\x09-\x0D]", said)[-1:]
        out.append("blank" if not last else "duplicate" if (role, said) in seen else "none" if last[0] in ".!?" else "truncated")
        seen.add((role, said))
    return out


def cheapest(turns, faults):
    """The least of all scripts of edits, of up to two inserts in all: (cost, audit, roles and texts)."""
    after = {"": ["s", "u"], "s": ["u"], "u": ["a"], "a": ["u"]}

    def scripts(i, last, inserts):
        if i == len(turns) and last in ("", "a"):
            yield 0, "", ()
        options = []
        if i < len(turns):
            _, role, said = turns[i]
            options.append((4, "D", None))
            if faults[i] not in ("blank", "duplicate"):
                cut = 3 * (faults[i] == "truncated")
                options += [(cut, "K", (role, said)), *((3 + cut, "R", (r, said)) for r in ("user", "assistant"))]
        options += [(3, "I", (r, "")) for r in ("user", "assistant")] if inserts else []
        for cost, letter, line in options:
            if not line or line[0][:1] in after[last]:
                for c, a, more in scripts(i + (letter != "I"), line[0][0] if line else last, inserts - (letter == "I")):
                    yield cost + c, letter + a, ((line,) if line else ()) + more

    return min(scripts(0, "", 2), key=lambda x: x[:2])


def structure_plain(rows):
    out = {}
    made = damage(rows)
    for conv in {r[0] for r in rows}:
        turns = sorted(made[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        faults = first_faults(turns)
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[1][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(turns, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{s}" for r, s in lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def structure_found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.select("*", *(F.lit(f"extra {c}").alias(c) for c in EXTRA))
    found = structure.structure(structure.damaged(df), df).collect()
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in found}


def talk(r, convs, longest):
    said = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "Ü.  ", "a.\n"]
    rows = []
    for c in range(convs):
        for t in range(r.randint(1, longest)):
            rows.append((c, t + r.choice([0, 0, 0, 1, 5]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), r.choice(said) if r.random() < 0.5 else f"text {r.random()}."))
    return rows


def test_structure_against_all_scripts(spark):
    rows = talk(random.Random(3), 150, 4)
    assert structure_found(spark, rows) == structure_plain(rows)


def test_structure_of_any_rows(spark):
    rows = [
        (None, None, None, None), (None, 0, "user", "Hi."), (None, 0, "user", "Hi."), (1, None, "user", "First."), (1, None, "assistant", "Second."), (1, 3, "", "x."),
        (2, 0, "user", "y" * 300_000), (2, 1, "assistant", "word " * 60_000 + "."), (3, 0, None, None), (4, -5, "user", "a."), (4, 300, "assistant", "b."), (4, 2**40, "user", "c."),
    ]
    want = structure_plain(rows)
    assert structure_found(spark, rows) == want
    assert structure_found(spark, rows, extra=True) == want
    assert structure_found(spark, []) == {}


def test_long_conversation_over_slices(spark):
    """A conversation of several slices costs what it costs with its turns numbered within one."""
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant"]), r.choice(["Same.", "", f"text {t}.", f"text {t}", f"text {t}."])) for t in range(700)]
    judged = structure.faults(structure.turns(spark.createDataFrame(rows, SCHEMA)))
    assert judged.select("slice").distinct().count() == 3
    (found,) = structure.audits(judged).collect()
    cost, audit, seen = 0, found.audit, set()
    lines, at = [], 0
    for letter in audit:  # the audit replayed on the rows
        if letter == "I":
            cost, _ = cost + 3, lines.append(("user" if not lines or lines[-1][0] != "user" else "assistant", ""))
            continue
        _, _, role, said = rows[at]
        at += 1
        bad = not said or (role, said) in seen
        seen.add((role, said))
        if letter == "D":
            cost += 4
            continue
        assert not bad
        cost += 3 * (letter == "R") + 3 * (said[-1] != ".")
        lines.append((role if letter == "K" else "assistant" if lines and lines[-1][0] == "user" else "user", said))
    assert (at, cost) == (700, found.cost)
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0][0] for x in lines))
    assert {(x.position, x.role, x.text) for x in structure.repaired(spark.createDataFrame(rows, SCHEMA)).collect()} == {(i, *x) for i, x in enumerate(lines)}


# --- prefix trie ----------------------------------------------------------------------------------


def trie_plain(rows):
    own = defaultdict(list)
    for conv, turn, role, said in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, (role or "").encode(), (said or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = {p: sum(len(q) == len(p) + 1 for q in below[p]) for p in members}
    saved = {p: (len(m) - 1) * len(p[-1][1]) if p else 0 for p, m in members.items()}
    return sorted(
        (
            m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], sum(not children[q] for q in below[p]), sum(saved[q] for q in below[p]),
            hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_found(spark, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if extra:
        df = df.select("*", *(F.lit(f"extra {c}").alias(c) for c in EXTRA))
    return sorted(tuple(r[c] for c in NODES) for r in trie.trie(trie.rebuilt(trie.numbered(df))).collect())


def many_talks(r, convs):
    said = [("user", "Hi."), ("assistant", "Hé?"), ("user", "Go on."), (None, None), ("user", "z" * 50)]
    return [(c, t, *said[min(r.randint(0, 9), 4) if t > 1 else 0]) for c in convs for t in range(r.choice([0, 1, 2, 3, 3, 4, 9, 12]))]


def test_trie_against_a_plain_one(spark):
    rows = many_talks(random.Random(8), [*range(150), *range(300, 400, 3)])
    rows += [(900 + i, t, "user", f"turn {t}") for i in range(60) for t in range(5)]  # whole copies
    want = trie_plain(rows)
    assert any(x[4] > 2 for x in want) and any(x[3] > 50 for x in want)
    assert trie_found(spark, rows) == want
    assert trie_found(spark, rows, extra=True) == want


def test_trie_of_any_rows(spark):
    rows = [(None, 0, "user", "a"), (7, None, "user", None), (7, None, None, "x"), (7, 1, "user", "b"), (7, 1, "user", "b"), (8, 0, "user", "c"), (5, 0, "assistant", "w " * 200_000), (11, -3, "", "")]
    assert trie_found(spark, rows) == trie_plain(rows)
    assert trie_found(spark, []) == []


def test_parts_of_ranges_join_to_the_same_nodes():
    """However sorted strings are cut into ranges, also ranges of one string, the nodes are the same."""
    r = random.Random(2)
    strings = sorted({b"".join(bytes([r.randint(0, 2)]) * trie.ID for _ in range(r.randint(0, 6))) for _ in range(200)})
    strings = [(s, [10] * (len(s) // trie.ID), r.randint(1, 3), i, "e") for i, s in enumerate(strings)]

    def nodes(cuts):
        out, parts = [], []
        for a, b in zip([0, *cuts], [*cuts, len(strings)], strict=True):
            for row in trie.range_nodes(iter(trie.sorted_run(strings[a:b]))):
                (out if row[9] is None else parts).append(row)
        return sorted(x[:9] for x in out + list(trie.joined_nodes(parts)))

    want = nodes([])
    assert want[0][3] is not None and len(want) == len({x[0] for x in want})
    assert nodes(list(range(1, len(strings)))) == want
    for _ in range(30):
        assert nodes(sorted(r.sample(range(len(strings)), 5))) == want


def test_loser_tree_sorts_and_knows_shared_turns():
    r = random.Random(1)
    for n_runs in (0, 1, 2, 3, 7, 8):
        runs = [[(b"".join(bytes([r.randint(0, 1)]) * trie.ID for _ in range(r.randint(0, 12))), i) for _ in range(r.choice([0, 1, 40]))] for i in range(n_runs)]
        want = sorted((s for run in runs for s in run), key=lambda s: s[0])
        tree = trie.LoserTree([trie.sorted_run(run) for run in runs])
        found = list(tree)
        assert [s[0] for _, s in found] == [s[0] for s in want]
        assert [lcp for lcp, _ in found[1:]] == [trie.common_turns(a[0], b[0]) for a, b in zip(want, want[1:], strict=False)]
        assert tree.compared <= sum(len(s[0]) // trie.ID for s in want) + 4 * len(want)  # a turn is compared once, and one that differs in each game
