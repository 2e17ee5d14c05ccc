"""The trie of conversations' prefixes, from the Cartesian tree over the common prefixes of sorted neighbours.

Conversations are sorted by the fingerprints of their turns. The length that two neighbours have in common is a boundary; a
node of the tree is a run of conversations between smaller boundaries, found on a stack of open nodes (all nearest smaller
values). Blocks of the sorted rows do that side by side: what a block cannot close is a falling and a rising run of minima, a
few numbers, and one pass over the blocks' minima closes the nodes across them. Equal boundaries are one node, and the depths
between a node and its parent are nodes of the same members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import numbered
from .crc import CRC_SQL, CRC_TABLE
from .shared import broadcast_if_few, checkpointed, in_arrow

#: A conversation starts with the turns of the one whose id GROUP divides, fewer than MOST of them.
GROUP, MOST = 5, 9
#: Bytes of a block of sorted rows, at least and at most: about the root of SIDE times all bytes, so blocks' summaries grow as blocks do.
LEAST_BLOCK, MOST_BLOCK, SIDE = 1 << 18, 16 << 20, 300
#: Depths of a row before they are rows of their own.
DEPTHS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()

_ITEM = "x array<long>, nb array<long>, ne array<long>, n array<long>, least array<long>, weight array<long>, leaves array<long>"
SUMMARY = f"block long, first array<binary>, first_sums array<long>, last array<binary>, last_sums array<long>, falling long, {_ITEM}"
#: Nodes (node is null) of depths low to high, whose parent is at top: sums are the bytes before each of these depths' turns; names of a block's open nodes; their conversations that end there.
NODE = "node long, block long, number long, low long, high long, top long, depth long, conv_id long, parent long, n_convs long, n_children long, n_leaves long, weight long, sums array<long>, ends string, ids string"


def _fingerprint(role: Column, text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, fp (16 bytes of the SHA-256 of role and text) and size (the text's bytes) of each turn; null role and text are empty, rows without conv_id go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _fingerprint(role, text).alias("fp"), F.octet_length(text).cast("long").alias("size"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv_id and length of every rebuilt conversation; and conv_id, d (from 0), fp and size of its turns."""
    rows = checkpointed(numbered(checkpointed(turns(conversations)), [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "fp", "size")], "number"))
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = rows.groupBy("conv_id").agg(F.min("number").alias("start"), F.count("*").alias("n"))
    convs = checkpointed(convs.withColumn("base", base).withColumn("skip", F.when(base == F.col("conv_id"), F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string")) % MOST)))
    given = F.least("skip", F.coalesce("_n", F.lit(0)))
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("_n")), "base", "left").withColumn("given", given).drop("_n")
    convs = checkpointed(convs.withColumn("length", F.col("given") + F.greatest(F.col("n") - F.col("skip"), F.lit(0))))
    rows = rows.join(broadcast_if_few(convs.select("conv_id", "start", "base", "skip", "given")), "conv_id").withColumn("at", F.col("number") - F.col("start"))
    own = rows.where("at >= skip").select("conv_id", (F.col("at") - F.col("skip") + F.col("given")).alias("d"), "fp", "size")
    first = rows.where((F.col("at") < MOST - 1) & (F.col("conv_id") == F.col("base"))).select("base", F.col("at").alias("d"), "fp", "size")
    lent = convs.where("given > 0").select("conv_id", "base", "given").join(first, "base").where("d < given").select("conv_id", "d", "fp", "size")
    return convs.select("conv_id", "length"), checkpointed(own.unionByName(lent))


def heads(convs: DataFrame, of_turns: DataFrame) -> DataFrame:
    """conv_id, length, fps and sizes of the turns up to the first that no other conversation has in that place: no prefix beyond it is shared."""
    alone = of_turns.groupBy("d", "fp").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    cut = alone.groupBy("conv_id").agg(F.min("d").alias("cut"))
    kept = of_turns.join(broadcast_if_few(checkpointed(cut)), "conv_id", "left").where("cut IS NULL OR d <= cut")
    arrays = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("d", "fp", "size"))).alias("t"))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    return convs.join(arrays, "conv_id", "left").select("conv_id", "length", F.coalesce("t.fp", empty("binary")).alias("fps"), F.coalesce("t.size", empty("long")).alias("sizes"))


class Node:
    """An open node: depth x, nb boundaries of that depth and ne conversations that end there; n members, their least id, and the sums over what is closed below it."""

    __slots__ = ("x", "nb", "ne", "n", "least", "weight", "leaves", "ends", "names", "up", "top", "sums")

    def __init__(self, x: int, nb: int, ne: int, n: int, least: int | None, weight: int, leaves: int, ends: tuple | list = (), names: tuple | list = ()):
        self.x, self.nb, self.ne, self.n, self.least, self.weight, self.leaves = x, nb, ne, n, least, weight, leaves
        self.ends, self.names, self.up = list(ends), list(names), None

    def children(self) -> int:
        return self.nb + 1 - self.ne

    def take(self, n: int, least: int | None, weight: int, leaves: int) -> None:
        self.n += n
        self.weight += weight
        self.leaves += leaves
        if self.least is None or (least is not None and least < self.least):
            self.least = least


class Stack:
    """Nodes that are open to the right, in order of depth. Where what comes before is not known, the lowest one is open to the left too, and goes to falling instead of closed."""

    def __init__(self, open_left: bool):
        self.open_left, self.nodes, self.falling, self.closed = open_left, [], [], []

    def add(self, item: Node, sums: np.ndarray) -> None:
        """A boundary of depth x and what follows it. sums: bytes of the first k turns, k from 0, of a member of what that closes."""
        nodes = self.nodes
        while nodes and nodes[-1].x > item.x:
            top = nodes.pop()
            if not nodes and self.open_left:
                self.falling.append(top)
                break
            up = nodes[-1] if nodes and nodes[-1].x >= item.x else item
            if not top.children():
                top.leaves = 1
            up.take(top.n, top.least, top.weight, top.leaves)
            top.up, top.top = up, up.x
            top.sums = sums[up.x if up.x > 0 else 0 : top.x] if top.n > 1 else None
            self.closed.append(top)
        if nodes and nodes[-1].x == item.x:
            same = nodes[-1]
            same.take(item.n, item.least, item.weight, item.leaves)
            same.nb += item.nb
            same.ne += item.ne
            same.ends += item.ends
            same.names += item.names
        else:
            nodes.append(item)

    def open_nodes(self) -> list[Node]:
        return self.falling + self.nodes


def _words(fps: pa.Array) -> np.ndarray:
    """Values of 16 bytes as rows of two numbers."""
    flat = fps.flatten()
    if not len(flat):
        return np.zeros((0, 2), np.uint64)
    at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(flat.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, 16).view(np.uint64)


def common(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Turns that each row (words[at[i]:at[i + 1]]) has in common with the one before it, from the second on."""
    size = np.diff(at)
    out = np.minimum(size[1:], size[:-1])
    row = np.repeat(np.arange(len(out)), out)
    within = np.arange(len(row)) - np.repeat(np.cumsum(out) - out, out)
    differ = np.flatnonzero((words[at[1:-1][row] + within] != words[at[:-2][row] + within]).any(axis=1)) if len(row) else row
    np.minimum.at(out, row[differ], within[differ])
    return out


def _block(t: pa.Table) -> tuple[Stack, list[np.ndarray], pa.Table]:
    """The stack after all rows of a block, its first and last rows' sums, and the rows in order."""
    t = t.sort_by("place").combine_chunks()
    fps, sizes = (t.column(c).combine_chunks() for c in ("fps", "sizes"))
    at = np.concatenate([[0], np.cumsum(fps.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    shared = common(_words(fps), at).tolist()
    total = np.concatenate([[0], np.cumsum(sizes.flatten().to_numpy(zero_copy_only=False))]).astype(np.int64)
    of = lambda i: total[at[i] : at[i + 1] + 1] - total[at[i]]
    stack, before = Stack(open_left=True), of(0)
    for i, (conv, length) in enumerate(zip(t.column("conv_id").to_pylist(), t.column("length").to_pylist(), strict=True)):
        if i:
            sums = of(i)
            stack.add(Node(shared[i - 1], 1, 0, 0, None, int(sums[shared[i - 1]]), 0), before)
            before = sums
        stack.add(Node(length, 0, 1, 1, conv, 0, 0, [conv]), before)
    return stack, [of(0), before], t


def summary(t: pa.Table) -> pa.Table:
    """SUMMARY of a block of rows."""
    stack, (first, last), t = _block(t)
    nodes = stack.open_nodes()
    fps = t.column("fps")
    row = {"block": t.column("block")[0].as_py(), "first": fps[0].as_py(), "first_sums": first.tolist(), "last": fps[len(t) - 1].as_py(), "last_sums": last.tolist(), "falling": len(stack.falling)}
    row |= {c: [getattr(x, c) for x in nodes] for c in ("x", "nb", "ne", "n", "least", "weight", "leaves")}
    return pa.Table.from_pylist([row], _SUMMARY)


def _nodes(closed: list[Node], least: dict[int, int], ends: list[str | None], node: list[int | None]) -> Iterator[dict]:
    """Rows of NODE of closed nodes; least has the least member of nodes that are not closed here."""
    for x, end, number in zip(closed, ends, node, strict=True):
        parent = None if x.up is None else least.get(id(x.up), x.up.least)
        low = x.top + 1
        for lo in range(low, x.x + 1, DEPTHS):
            hi = min(lo + DEPTHS - 1, x.x)
            yield {"node": number, "low": lo, "high": hi, "top": x.top, "depth": x.x, "conv_id": x.least, "parent": parent, "n_convs": x.n, "n_children": x.children(), "n_leaves": x.leaves, "weight": x.weight, "sums": None if x.sums is None else x.sums[lo - low : hi - low + 1].tolist(), "ends": end}


def across(t: pa.Table) -> pa.Table:
    """NODE of the nodes that no block closes, and names (block, number) of the open nodes of blocks, from all blocks' summaries."""
    stack, before = Stack(open_left=False), None
    stack.nodes.append(Node(0, 0, 0, 0, None, 0, 0))
    for row in sorted(t.to_pylist(), key=lambda x: x["block"]):
        first, last = np.array(row["first_sums"], np.int64), np.array(row["last_sums"], np.int64)
        if before is not None:
            x = next((k for k, (a, b) in enumerate(zip(before["last"], row["first"], strict=False)) if a != b), min(len(before["last"]), len(row["first"])))
            stack.add(Node(x, 1, 0, 0, None, int(first[x]), 0), np.array(before["last_sums"], np.int64))
        for k, item in enumerate(zip(*(row[c] for c in ("x", "nb", "ne", "n", "least", "weight", "leaves")), strict=True)):
            stack.add(Node(*item, names=[(row["block"], k)]), first if k <= row["falling"] else last)
        before = row
    stack.add(Node(-1, 0, 0, 0, None, 0, 0), np.array(before["last_sums"], np.int64))
    root = stack.closed[-1]
    root.up, root.sums = None, np.zeros(1, np.int64) if root.n > 1 else None
    numbers = range(len(stack.closed))
    rows = list(_nodes(stack.closed, {}, [None] * len(numbers), list(numbers)))
    rows += [{"node": i, "block": b, "number": k, "conv_id": x.least} for i, x in enumerate(stack.closed) for b, k in x.names]
    return pa.Table.from_pylist(rows, _NODE)


def inside(t: pa.Table, names: pa.Table) -> pa.Table:
    """NODE of the nodes that a block closes, and the ids of conversations that end in its open ones."""
    stack, _, t = _block(t)
    known = {k: (c, i) for k, c, i in zip(*(names.column(c).to_pylist() for c in ("number", "conv_id", "node")), strict=True)}
    opened = stack.open_nodes()
    joined = lambda ids: ",".join(map(str, ids))
    ends = [hashlib.sha256(joined(x.ends).encode()).hexdigest() for x in stack.closed]
    rows = list(_nodes(stack.closed, {id(x): known[k][0] for k, x in enumerate(opened)}, ends, [None] * len(ends)))
    block = t.column("block")[0].as_py()
    rows += [{"node": known[k][1], "block": block, "ids": joined(x.ends)} for k, x in enumerate(opened) if x.ends]
    return pa.Table.from_pylist(rows, _NODE)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


_SUMMARY, _NODE = _schema(SUMMARY), _schema(NODE)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces joined by commas, pieces of a node in order."""
    node, digest = None, hashlib.sha256()
    for b in batches:
        for k, ids in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            if k == node:
                digest.update(b",")
            else:
                if node is not None:
                    yield pa.RecordBatch.from_pydict({"node": [node], "ends": [digest.hexdigest()]})
                node, digest = k, hashlib.sha256()
            digest.update(ids.as_py().encode())
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends": [digest.hexdigest()]})


def prefix_trie(conversations: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node of the trie of rebuilt conversations (conv_id, turn, role, text).

    Turns of a conversation are in order of turn (null first), those with the same number in order of their fingerprints; equal
    rows are turns each. Null role and text are empty; rows without conv_id belong to no conversation. Texts are the same if
    128 bits of their SHA-256 are. A conversation of any length holds only the turns up to its first unshared one in a row;
    the ids of a node's ended conversations stream through the task that hashes them, in order. No conversations: no rows.
    """
    convs, of_turns = rebuilt(conversations)
    rows = checkpointed(heads(convs, of_turns))
    total = rows.agg(F.sum(F.size("fps") * 24 + 64)).first()[0] or 0
    side = block_bytes or min(MOST_BLOCK, max(LEAST_BLOCK, int((SIDE * total) ** 0.5)))
    placed = rows.repartitionByRange(total // side + 1, "fps", "conv_id").sortWithinPartitions("fps", "conv_id")
    placed = checkpointed(placed.select("*", F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("place")))
    # a few numbers of each block, in one task
    summaries = placed.groupBy("block").applyInArrow(summary, SUMMARY)
    merged = checkpointed(summaries.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(across, NODE))
    names = merged.where("number IS NOT NULL").select("block", "number", "conv_id", "node")
    found = checkpointed(placed.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(inside, NODE))
    pieces = found.where("ids IS NOT NULL").select("node", "block", "ids").repartition("node").sortWithinPartitions("node", "block")
    ends = pieces.transform(in_arrow, _hashed, "node long, ends string")
    merged = merged.where("low IS NOT NULL").drop("ends").join(ends, "node", "left")
    nodes = found.where("low IS NOT NULL").unionByName(merged.select(*(F.col(c) for c in found.columns)))
    each = nodes.select("*", F.explode(F.sequence("low", "high")).alias("d"))
    here = F.col("d") == F.col("depth")
    return each.select(
        "conv_id", F.col("d").alias("depth"),
        F.when(F.col("d") == F.col("top") + 1, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(here, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        F.when(F.col("n_convs") == 1, F.lit(0)).otherwise(F.col("weight") - (F.col("n_convs") - 1) * F.get("sums", (F.col("d") - F.col("low")).cast("int"))).cast("long").alias("saved_tokens"),
        F.when(here, F.coalesce("ends", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


_KEY = "sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32]"
SQL = f"""
    WITH {CRC_TABLE},
    t AS (SELECT conv_id, k, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos FROM (SELECT conv_id, turn, {_KEY} AS k, octet_length(encode(coalesce(text, ''))) AS size FROM conversations WHERE conv_id IS NOT NULL)),
    c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC_SQL.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
    r AS (SELECT c.conv_id, 1 AS part, pos, k, size FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos >= h OR base = c.conv_id
          UNION ALL SELECT c.conv_id, 0, pos, k, size FROM c JOIN t ON t.conv_id = c.base WHERE pos < h AND base <> c.conv_id),
    s AS (SELECT c.conv_id, coalesce(list(k ORDER BY part, pos) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(size ORDER BY part, pos) FILTER (k IS NOT NULL), []) AS sizes FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
    m AS (SELECT conv_id, depth, md5(array_to_string(ks[:depth], ',')) AS id, md5(array_to_string(ks[:depth - 1], ',')) AS up, CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS size, depth = len(ks) AS ended
          FROM (SELECT *, unnest(range(len(ks) + 1)) AS depth FROM s)),
    n AS (SELECT depth, id, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '') AS ends FROM m GROUP BY depth, id),
    k AS (SELECT depth - 1 AS depth, up AS id, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, id)),
    a AS (SELECT m.depth, m.id, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((f.n_convs - 1) * f.size)::BIGINT AS saved_tokens FROM f JOIN m ON m.conv_id = f.conv_id AND m.depth <= f.depth GROUP BY m.depth, m.id)
    SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, sha256(f.ends) AS ends_sha256
    FROM f JOIN a USING (depth, id) LEFT JOIN n p ON p.depth = f.depth - 1 AND p.id = f.up AND f.depth > 0"""
