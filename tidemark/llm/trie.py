"""The prefix trie of conversations, by an LCP-aware mergesort.

A conversation becomes the string of its turns' 16-byte hashes, so no text is sorted. Equal strings are counted first, so any
number of copies is one string. Strings are dealt out by ranges, some tens of thousands to a task. A task sorts runs of a few
thousand strings and notes each one's LCP (in turns) with the one before; a loser tree merges the runs. A loser keeps its LCP
with the winner that beat it, so the string with the longer LCP is the lesser without a look, and equal LCPs are compared from
there on: no shared turn is compared twice. The merged stream moves a stack along its open path and emits a node when a string
leaves it.

Nodes on the first and the last path of a range may go on in the neighbouring ranges. They are emitted as parts, two paths a
range; one task runs the same stack over these paths in order and emits them whole. What a part sums up lies in its own
range, so only counts of the shared path meet there. Parents get their least member by a join on the node.

Runs are held as a task's byte strings, 20 bytes a turn, and not in files, as executors have no folder of their own to use; the
number of ranges grows with the turns. A conversation's string is one row, again of 20 bytes a turn.

A node's hash of the conversations that end there goes over their ids in order, one at a time, in one task.

Defined results: rows without conv_id belong to no conversation; null turns come first; turns of equal number are ordered by role
and text; a null role or text is empty; repeated rows are turns of their own; a very long text counts with all its bytes; other
columns, also of names that differ in case only, play no part; an empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, materialize, only, sliced
from .structure import conversations, crc32_sql

#: Bytes of a turn's hash, strings to a run, and bytes of strings to a range.
ID, RUN, RANGE = 16, 4096, 32 << 20


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, k (place of the turn, from 1), id (hash of role and text) and size (bytes of the text)."""
    own = only(rows, "conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull())
    role, text = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("role", "text"))
    own = own.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    named = own.withColumn("id", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    return named.select("conv_id", F.row_number().over(order).alias("k"), "id", F.octet_length("text").cast("long").alias("size"))


def rebuilt(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv_id, path (hashes of its turns, one behind the other) and sizes: the first h turns of the conversation ``conv_id - conv_id % group``,
    then its own after the first h, where h is a hash of the id below ``most``."""
    h = F.expr(f"CAST(crc32(CAST(conv_id AS string)) % {most} AS int)")
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("k") > h, F.struct("k", "id", "size")))).alias("own"))
    heads = turns.filter(F.col("k") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("k", "id", "size"))).alias("head"))
    base = own.withColumn("base", F.expr(f"conv_id - conv_id % {group}"))
    both = base.alias("a").join(heads.alias("b"), F.col("a.base") == F.col("b.conv_id"), "left")
    none = F.slice("a.own", 1, 0)
    all_turns = F.concat(F.slice(F.coalesce("b.head", none), 1, F.expr(f"CAST(crc32(CAST(a.conv_id AS string)) % {most} AS int)")), F.col("a.own"))
    made = both.select(F.col("a.conv_id").alias("conv_id"), all_turns.alias("t"))
    return made.select("conv_id", F.unhex(F.array_join("t.id", "")).alias("path"), F.col("t.size").alias("sizes"))


def _digests(batches):
    """(name, hash of its ids, comma-joined) from rows (name, conv_id) sorted by both."""
    names, out, at, h = [], [], None, None
    for b in batches:
        for name, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if name != at:
                if at is not None:
                    names.append(at), out.append(h.hexdigest())
                at, h = name, hashlib.sha256(b"%d" % conv)
            else:
                h.update(b",%d" % conv)
        if len(names) >= 10_000:
            yield _rows({"name": pa.binary(), "ends_sha256": pa.string()}, list(zip(names, out, strict=True)))
            names, out = [], []
    if at is not None:
        names.append(at), out.append(h.hexdigest())
    yield _rows({"name": pa.binary(), "ends_sha256": pa.string()}, list(zip(names, out, strict=True)))


def _rows(kinds: dict, held: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(kinds.values())], names=list(kinds))


# --- sorted runs and the loser tree -------------------------------------------------------------


def common_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Turns that two strings share, of which ``known`` are."""
    k, end = known, min(len(a), len(b)) // ID
    while k < end and a[k * ID : k * ID + ID] == b[k * ID : k * ID + ID]:
        k += 1
    return k


def sorted_run(strings: list[tuple]) -> list[tuple]:
    """(LCP with the string before, string ...) in order; the first item of each is the bytes."""
    strings.sort(key=lambda s: s[0])
    return [(common_turns(a[0], b[0]) if a else 0, b) for a, b in zip([None, *strings], strings)]  # noqa: B905


class LoserTree:
    """Merges sorted runs; yields (LCP with the string before, string ...)."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.lcp = [h[0] if h else -1 for h in self.heads]  # with the last winner; -1 ends a run
        self.width = 1 << max(0, len(runs) - 1).bit_length()
        self.losers = [0] * self.width
        self.compared = 0
        self.winner = self._play(1) if runs else -1

    def _play(self, node: int) -> int:
        if node >= self.width:
            i = node - self.width
            return i if i < len(self.heads) else -1
        a, b = self._play(2 * node), self._play(2 * node + 1)
        return self._game(node, a, b)

    def _game(self, node: int, a: int, b: int) -> int:
        """The winner of two runs; the loser stays at the node, with its LCP with the winner."""
        of_a, of_b = (self.lcp[i] if i >= 0 else -1 for i in (a, b))
        if of_a < of_b:
            a, b = b, a
        elif of_a == of_b >= 0:
            x, y = self.heads[a][1][0], self.heads[b][1][0]
            k = common_turns(x, y, of_a)
            self.compared += k - of_a + 1
            if y[k * ID : k * ID + ID] < x[k * ID : k * ID + ID]:
                a, b = b, a
            self.lcp[b] = k
        self.losers[node] = b
        return a

    def __iter__(self):
        while self.winner >= 0 and self.lcp[self.winner] >= 0:
            w = self.winner
            yield self.lcp[w], self.heads[w][1]
            self.heads[w] = head = next(self.runs[w], None)
            self.lcp[w] = head[0] if head else -1
            node = (w + self.width) // 2
            while node:
                w = self._game(node, w, self.losers[node])
                node //= 2
            self.winner = w


# --- the open path ------------------------------------------------------------------------------


class Node:
    __slots__ = ("children", "convs", "ends", "id", "leaves", "least", "name", "part", "saved", "size")

    def __init__(self, name: bytes, turn: bytes, size: int):
        self.name, self.id, self.size = name, turn, size
        self.convs, self.least, self.children, self.leaves, self.saved, self.ends, self.part = 0, None, 0, 0, 0, None, False

    def add(self, convs, least, children=0, leaves=0, saved=0, ends=None):
        self.convs += convs
        self.least = least if self.least is None else min(self.least, least)
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.ends = ends or self.ends

    def close(self, above: Node | None):
        """All of the node's subtree is known: its own share is added, and its sums go to the node above."""
        self.leaves += self.children == 0
        self.saved += (self.convs - 1) * self.size
        if above:
            above.children += 1
            above.leaves += self.leaves
            above.saved += self.saved


def child_name(name: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(name + turn, digest_size=16).digest()


def root() -> Node:
    return Node(bytes(16), b"", 0)


_NODE = {"name": pa.binary(), "above": pa.binary(), "depth": pa.int64(), "conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
_PART = {"part": pa.int32(), "size": pa.int64(), "turn": pa.binary()}
_KINDS = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
NODE_SCHEMA = ", ".join(f"{n} {_KINDS[t]}" for n, t in _NODE.items())
PART_SCHEMA = NODE_SCHEMA + ", " + ", ".join(f"{n} {_KINDS[t]}" for n, t in _PART.items())


def _row(node: Node, depth: int, above: Node | None, part=None) -> tuple:
    return (node.name, above.name if above else None, depth, node.least, node.convs, node.children, node.leaves, node.saved, node.ends, part, node.size, node.id)


def range_nodes(strings):
    """Rows of nodes from sorted strings (LCP, (path, sizes, convs, least, ends)): whole nodes with part null, and those of the first (0) and last (1) path, from the root down."""
    stack: list[Node] = []
    first: list[tuple] = []  # parts of the first path, from its end up

    def leave(depth):
        while len(stack) - 1 > depth:
            node, above = stack.pop(), stack[-1]
            if node.part:
                first.append(_row(node, len(stack), above, 0))
            else:
                node.close(above)
                yield _row(node, len(stack), above)

    for lcp, (path, sizes, convs, least, ends) in strings:
        begins = not stack
        if begins:
            stack.append(root())
            stack[0].part = True
        yield from leave(lcp)
        for k in range(len(stack) - 1, len(path) // ID):
            turn = path[k * ID : k * ID + ID]
            node = Node(child_name(stack[-1].name, turn), turn, sizes[k])
            node.part = begins
            stack.append(node)
        for node in stack:
            node.add(convs, least)
        stack[-1].ends = ends
    # What is still open is the last path: what it shares with the first belongs to that one.
    rest = [_row(n, d, stack[d - 1] if d else None, 0 if n.part else 1) for d, n in enumerate(stack)]
    yield from [r for r in rest if r[9] == 0]
    yield from reversed(first)
    yield from [r for r in rest if r[9] == 1]


def joined_nodes(parts):
    """Whole nodes from the parts of all ranges, in the order of ranges, and in each as range_nodes gives them."""
    stack: list[Node] = []

    def leave(depth):
        while len(stack) - 1 > depth:
            node = stack.pop()
            above = stack[-1] if stack else None
            node.close(above)
            yield _row(node, len(stack), above)

    for name, _, depth, least, convs, children, leaves, saved, ends, _, size, turn in parts:
        if depth >= len(stack) or stack[depth].name != name:
            yield from leave(depth - 1)
            stack.append(Node(name, turn, size))
        stack[depth].add(convs, least, children, leaves, saved, ends)
    yield from leave(-1)


def _node_batches(rows, kinds, most=5000):
    held = []
    for r in rows:
        held.append(r[: len(kinds)])
        if len(held) == most:
            yield _rows(kinds, held)
            held = []
    yield _rows(kinds, held)


def _merge_range(batches):
    runs, held = [], []
    for b in sliced(batches, RUN):
        held.extend(zip(*(c.to_pylist() for c in b.columns), strict=True))
        if len(held) >= RUN:
            runs.append(sorted_run(held))
            held = []
    runs.append(sorted_run(held))
    yield from _node_batches(range_nodes(LoserTree(runs)), _NODE | _PART)


def _join_parts(batches):
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True))
    yield from _node_batches(joined_nodes(rows), _NODE)


def trie(paths: DataFrame) -> DataFrame:
    """The nodes over conversations (conv_id, path, sizes): conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    paths = materialize(paths.withColumn("name", F.unhex(F.md5("path"))), "paths")
    strings = paths.groupBy("name").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("convs"), F.min("conv_id").alias("least"))
    ids = paths.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    ends = ids.mapInArrow(_digests, "name binary, ends_sha256 string")
    strings = materialize(strings.join(ends, "name").select("path", "sizes", "convs", "least", "ends_sha256"), "strings")
    n_bytes = strings.agg(F.sum(F.octet_length("path") * 2 + 100).cast("long")).first()[0] or 0
    dealt = strings.repartitionByRange(buckets(spark, n_bytes, RANGE), "path")
    made = materialize(dealt.mapInArrow(_merge_range, PART_SCHEMA).withColumn("place", F.monotonically_increasing_id()), "nodes")
    parts = made.filter(F.col("part").isNotNull()).select("place", *_NODE, *_PART)  # two paths a range, in the order of ranges
    shared = materialize(parts.coalesce(1).sortWithinPartitions("place").mapInArrow(_join_parts, NODE_SCHEMA), "shared-nodes")
    nodes = made.filter(F.col("part").isNull()).select(*_NODE).unionByName(shared)
    above = nodes.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    none = F.sha2(F.lit(""), 256)
    return nodes.join(above, "above", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def op13_prefix_trie(spark, sf_dir):
    return trie(rebuilt(numbered(conversations(spark, sf_dir))))


def oracle_sql() -> str:
    h = f"{crc32_sql('CAST(conv_id AS VARCHAR)')} % 9"
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM t), c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {h} AS h FROM ids),
r AS (SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.k <= c.h UNION ALL SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k > c.h),
placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, sha256(length(role) || ':' || role || text) AS id, strlen(text) AS size FROM r),
whole AS (SELECT conv_id, coalesce(list(id ORDER BY d) FILTER (id IS NOT NULL), []) AS p, coalesce(list(size ORDER BY d) FILTER (id IS NOT NULL), []) AS s FROM ids LEFT JOIN placed USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id, d, p[1 : d] AS path, p[1 : d - 1] AS above, s[d] AS size, len(p) = d AS ends FROM whole, unnest(range(0, len(p) + 1)) u(d)),
nodes AS (SELECT d, path, any_value(above) AS above, coalesce(any_value(size), 0) AS size, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY d, path),
families AS (SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
n AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN families USING (d, path)),
sums AS (SELECT u.d, n.path[1 : u.d] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens FROM n, unnest(range(0, n.d + 1)) u(d) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN sums USING (d, path) LEFT JOIN n p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.above"""
