"""A prefix trie of conversations: one global range sort, then sweeps over LCP intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomscape.llm.common import discard, materialize, small

DIGEST = 32  # characters of a turn's key in a path
_IDS = 10_000  # conv_ids in a piece of an open node's list


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, array of (key, chars), of conversations (conv_id, turn, role, text).

    Turns are ordered by turn, null first, and those of one number by their key, a digest
    of role and text; null roles and texts are empty; repeated rows are turns of their
    own. Rows without a conv_id are no conversation's. A turn is 36 bytes here, however
    long its text; other columns are not looked at.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.length(text).alias("chars")).alias("t"))
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def share_openings(arrays: DataFrame, every: int = 100, below: int = 6) -> DataFrame:
    """Every conversation c begins with the first h turns of c - c % every (all if it has
    fewer, none if there is no such conversation), then has its own after its first h;
    h is the unsigned crc32 of the decimal c, modulo below."""
    rows = arrays.withColumns({"base": F.expr(f"conv_id - conv_id % {every}"), "h": (F.crc32(F.col("conv_id").cast("string")) % below).cast("int")})
    first = arrays.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, below).alias("first"))
    own = F.slice("turns", F.col("h") + 1, F.size("turns"))
    opening = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return rows.join(first, "base", "left").select("conv_id", F.concat(opening, own).alias("turns"))


@dataclass
class _Node:
    """A node that may still get members."""

    key: str
    chars: int
    first: bool = False  # on the path of the partition's first row
    conv_id: int | None = None
    n_convs: int = 0
    n_children: int = 0
    n_leaves: int = 0
    saved: int = 0
    ids: list[int] = field(default_factory=list)
    sha: object = None
    rows: list[list] = field(default_factory=list)  # closed children, whose parent's conv_id is not known yet
    parts: list[tuple] = field(default_factory=list)  # pieces that were stitched

    def take(self, conv_id: int, n_convs: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n_convs += n_convs

    def close(self, depth: int, parent: _Node | None) -> list:
        """The node's row; its sums go to its parent."""
        if self.ids:
            self.hash(",".join(map(str, self.ids)))
        leaves = self.n_leaves if self.n_children else 1
        saved = self.saved + (self.n_convs - 1) * self.chars
        row = [self.conv_id, depth, None, self.n_convs, self.n_children, leaves, saved, (self.sha or hashlib.sha256()).hexdigest()]
        for child in self.rows:
            child[2] = self.conv_id
        if parent:
            parent.take(self.conv_id, self.n_convs)
            parent.n_children += 1
            parent.n_leaves += leaves
            parent.saved += saved
        return row

    def hash(self, ids: str) -> None:
        if self.sha is None:
            self.sha = hashlib.sha256(ids.encode())
        else:
            self.sha.update(b"," + ids.encode())


_ROW = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Rows of nodes; part, side and level name an open node: the parent, or (seq >= 0) the row's own.
_SWEPT = f"{_ROW}, part int, side int, level long, seq long, key string, chars long, ids string"


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _common(a: str, b: str) -> int:
    """Turns that two paths have in common at their begin."""
    if a == b:
        return len(a) // DIGEST
    n, most = 0, min(len(a), len(b)) // DIGEST
    while n < most and a[n * DIGEST : (n + 1) * DIGEST] == b[n * DIGEST : (n + 1) * DIGEST]:
        n += 1
    return n


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one partition of sorted paths. Those on the path of its first or last row
    may go on in the partitions beside it and come out open, without what their open
    children have; the others are whole."""
    part = TaskContext.get().partitionId()
    stack: list[_Node] = []
    out: list[list] = []
    last = ""

    def open_row(node: _Node, depth: int, side: int) -> None:
        out.append([node.conv_id, depth, None, node.n_convs, node.n_children, node.n_leaves, node.saved, None, part, side, depth, 0, node.key, node.chars, None])
        for k in range(0, len(node.ids), _IDS):
            out.append([None, depth, None, None, None, None, None, None, part, side, depth, 1 + k, None, None, ",".join(map(str, node.ids[k : k + _IDS]))])
        out.extend([*row, part, side, depth, None, None, None, None] for row in node.rows)

    def pop() -> None:
        depth, node = len(stack) - 1, stack.pop()
        if node.first:
            open_row(node, depth, 0)
        else:
            stack[-1].rows.append(node.close(depth, stack[-1]))
            out.extend([*row, *[None] * 7] for row in node.rows)

    for batch in batches:
        for path, conv_id, chars in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), batch.column("chars").to_pylist(), strict=True):
            common = _common(last, path) if stack else 0
            while len(stack) > common + 1:
                pop()
            new = not stack
            if new:
                stack.append(_Node("", 0, True))
            for d in range(len(stack) - 1, len(chars)):
                stack.append(_Node(path[d * DIGEST : (d + 1) * DIGEST], chars[d], new))
            stack[-1].take(conv_id, 1)
            stack[-1].ids.append(conv_id)
            last = path
        if len(out) >= 10_000:
            yield _batch(out, _SWEPT)
            out.clear()
    for depth, node in enumerate(stack):
        open_row(node, depth, 0 if node.first else 1)
    if out:
        yield _batch(out, _SWEPT)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the open nodes of all partitions, which come in order. Held are those nodes,
    some for each partition and turn of its two outer paths; lists of ids are only hashed."""
    stack: list[_Node] = []
    nodes: list[list] = []
    pieces: list[list] = []

    def pop() -> None:
        depth, node = len(stack) - 1, stack.pop()
        nodes.append(node.close(depth, stack[-1] if stack else None))
        if stack:
            stack[-1].rows.append(nodes[-1])
        pieces.extend([node.conv_id, *[None] * 7, part, side, depth] for part, side in node.parts)

    names = ["conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "part", "side", "level", "seq", "key", "chars", "ids"]
    for batch in batches:
        for conv_id, n_convs, n_children, n_leaves, saved, part, side, depth, seq, key, chars, ids in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if seq:
                stack[depth].hash(ids)
                continue
            if depth >= len(stack) or stack[depth].key != key:
                while len(stack) > depth:
                    pop()
                stack.append(_Node(key, chars))
            node = stack[depth]
            node.parts.append((part, side))
            if conv_id is not None:
                node.take(conv_id, n_convs)
            node.n_children += n_children
            node.n_leaves += n_leaves
            node.saved += saved
    while stack:
        pop()
    done = [[*row, None, None, None] for row in nodes] + pieces
    for k in range(0, len(done), 10_000):
        yield _batch(done[k : k + 10_000], f"{_ROW}, part int, side int, level long")


def prefix_trie(arrays: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row for each distinct opening of conversations (conv_id, turns): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    A node is a sequence of the first depth turns of the conversations that are its members,
    the root (depth 0, no parent) having all of them, also those without turns; conv_id is
    the smallest member. n_leaves counts the nodes without children in its subtree;
    saved_tokens sums (n_convs - 1) * chars of the last turn over the subtree; ends_sha256
    is the digest of the ids of the members that end here, ascending and joined by commas.
    An empty table has no nodes.

    Paths of keys are sorted by ranges over all tasks, equal ones by conv_id, so that a
    path which many conversations have is dealt out too. Each task sweeps its rows with a
    stack of open nodes, closing those deeper than the LCP of neighbours; what is open at
    its ends is stitched in one short task, whose rows are bounded by partitions times
    turns, and by the ids of conversations that go over a border: these are streamed
    through the hash, which can't be computed in parts.
    """
    path = F.array_join(F.transform("turns", lambda t: t["key"]), "")
    paths = materialize(arrays.select(path.alias("path"), "conv_id", F.transform("turns", lambda t: t["chars"]).alias("chars")), "paths")
    dealt = paths.repartitionByRange(partitions, "path", "conv_id") if partitions else paths.repartitionByRange("path", "conv_id")
    swept = materialize(dealt.sortWithinPartitions("path", "conv_id").mapInArrow(_sweep, _SWEPT), "swept")
    border = swept.where("seq IS NOT NULL").select("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "part", "side", "level", "seq", "key", "chars", "ids")
    stitched = materialize(border.repartition(1).sortWithinPartitions("part", "side", "level", "seq").mapInArrow(_stitch, f"{_ROW}, part int, side int, level long"), "stitched")
    columns = [c.split()[0] for c in _ROW.split(", ")]
    whole = swept.where("seq IS NULL AND part IS NULL").select(*columns)
    parents = stitched.where("part IS NOT NULL").select("part", "side", "level", F.col("conv_id").alias("above"))
    below = swept.where("seq IS NULL AND part IS NOT NULL").join(small(parents), ["part", "side", "level"]).withColumn("parent_conv_id", F.col("above")).select(*columns)
    out = materialize(whole.unionByName(below).unionByName(stitched.where("part IS NULL").select(*columns)), "trie")
    discard(paths, swept, stitched)
    return out
