"""Ways from a few ends to all nodes of a network of any size: blocks of neighbouring nodes are searched by tasks of their own, and what leaves a block enters others in the next round.

A block is a range of node numbers and, on either side, a margin of its neighbours' nodes, so that a way which winds along a
border stays in one block. Values start as a hub's own zero; a search in a block takes all that are known to enter it. An
arc that leads out of a block carries its tail's value to every block that has its head but not its tail, and rounds end when
none comes in lower than what that block has there itself. Then each node's value is right in every block that has it: along a shortest way, an arc lies in the
block, or its tail's value was sent there. Any numbering gives the same sums; one where near nodes have near numbers, as of
streets, gives few values to send and about as many rounds as the blocks that a way goes through.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed, new_folder
from .relational import numbered

#: Arcs of a block, about, without its margins; ranges of a block, of which one is its margin in a neighbour; values, at most, of some hubs' nodes that are searched together.
BLOCK_ARCS, RANGES, TOGETHER = 2_000_000, 8, 4_000_000
#: Values, at most, that enter blocks in a round and go to all tasks; arcs, about, by whose tails ranges are cut.
FEW_VALUES, SOME_ARCS = 1_000_000, 500_000
#: What no sum of packed values reaches.
NONE = 1 << 62

SEEDS = "block int, part int, hub long, node long, key long"
#: own: what a block that was searched has itself where it may be entered.
FOUND = f"{SEEDS}, own boolean"


def _packed(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.tobytes(), "zstd", asbytes=True) if len(x) else bytes(8)


def _unpacked(x: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(x[:8], "little")
    return np.frombuffer(pa.decompress(x[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind) if n else np.zeros(0, kind)


class Cuts:
    """Where the ranges of node numbers begin."""

    def __init__(self, at: np.ndarray):
        self.at, self.last = at, len(at) // RANGES

    def of(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block a node is of, and the first and the last one that have it."""
        k = np.searchsorted(self.at, node, side="right")
        block = k // RANGES
        return block, block - ((k % RANGES == 0) & (block > 0)), block + ((k % RANGES == RANGES - 1) & (block < self.last))


def _rows(*columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    block, u, v, key, to = (np.concatenate(c) for c in zip(*columns, strict=True))
    return pa.RecordBatch.from_pydict({"block": block.astype(np.int32), "u": u, "v": v, "key": key, "to": to.astype(np.int32)})


def _dealt(cuts: Cuts, u: np.ndarray, v: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    """An arc in each block that has both ends (to: the block), and in its tail's block for each other one that has its head (to: that one), which gets to know the head."""
    (bu, lu, hu), (bv, lv, hv) = cuts.of(u), cuts.of(v)
    out = []
    for step in (-1, 0, 1):
        c = bu + step
        m = (c >= lu) & (c <= hu) & (c >= lv) & (c <= hv)
        out.append((c[m], u[m], v[m], key[m], c[m]))
        c = bv + step
        m = (c >= lv) & (c <= hv) & ((c < lu) | (c > hu))
        out += [(bu[m], u[m], v[m], key[m], c[m]), (c[m], v[m], v[m], np.zeros_like(key[m]), c[m])]
    return _rows(*out)


def _block_rows(held: list[pa.RecordBatch], parts: int) -> pa.RecordBatch:
    """A block's arcs as arrays, once for each part of the hubs with the asked ends (to: -1; v: the hub, key: its part). Empties held."""
    t = pa.Table.from_batches(held)
    held.clear()
    block = t.column("block")[0].as_py()
    u, v, key, to = (t.column(c).to_numpy() for c in ("u", "v", "key", "to"))
    del t
    inner, out, end = to == block, (to >= 0) & (to != block), to < 0
    out_tail, out_head, out_value, out_to = u[out], v[out], key[out], to[out].astype(np.int32)
    ends = [(v[m], u[m]) for m in (end & (key == p) for p in range(parts))]
    u, v, key = u[inner], v[inner], key[inner]
    del to, inner, out, end
    nodes = np.unique(np.concatenate([np.unique(u), np.unique(v), out_tail]))
    u, v = np.searchsorted(nodes, u).astype(np.int32), np.searchsorted(nodes, v).astype(np.int32)
    order = np.argsort(u, kind="stable")
    u, v, key = u[order], v[order], key[order]
    data = {
        "nodes": np.diff(nodes, prepend=0),
        "degree": np.bincount(u, minlength=len(nodes)).astype(np.int32),
        "head": v - u,
        "value": key,
        "out_tail": np.searchsorted(nodes, out_tail).astype(np.int32),
        "out_head": out_head,
        "out_value": out_value,
        "out_to": out_to,
    }
    columns = {c: [_packed(x)] * parts for c, x in data.items()}
    columns |= {"end_hub": [_packed(h) for h, _ in ends], "end_node": [_packed(e) for _, e in ends]}
    return pa.RecordBatch.from_pydict({"block": pa.array([block] * parts, pa.int32()), "part": pa.array(range(parts), pa.int32())} | columns)


KINDS = {"nodes": np.int64, "degree": np.int32, "head": np.int32, "value": np.int64, "out_tail": np.int32, "out_head": np.int64, "out_value": np.int64, "out_to": np.int32, "end_hub": np.int64, "end_node": np.int64}


def _searched(begin: np.ndarray, head: np.ndarray, value: np.ndarray, at: np.ndarray, key: np.ndarray, hubs: int) -> np.ndarray:
    """Least sums from the seeds (at: hub times nodes plus node) to each node of each hub: those nearer than a limit are passed on together until none comes nearer, then the limit is raised."""
    n = len(begin) - 1
    out = np.full(hubs * n, NONE)
    np.minimum.at(out, at, key)
    pending = np.unique(at)
    step = max(1, int(value.mean())) if len(value) else 1
    limit = 0
    while len(pending):
        d = out[pending]
        near = d < limit
        if not near.any():
            limit = (int(d.min()) // step + 1) * step
            near = d < limit
        front, d, pending = pending[near], d[near], pending[~near]
        node = front % n
        first = begin[node]
        m = begin[node + 1] - first
        k = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(m.sum())
        v, way = np.repeat(front - node, m) + head[k], np.repeat(d, m) + value[k]
        better = way < out[v]
        v = v[better]
        np.minimum.at(out, v, way[better])
        pending = np.unique(np.concatenate([pending, v]))
    return out


def _found(row: dict) -> Iterator[pa.RecordBatch]:
    """What a block's search sends to other blocks, (own) has where others may enter it, and (block: -1) has at asked ends."""
    of = {c: _unpacked(row[c].as_buffer().to_pybytes(), kind) for c, kind in KINDS.items()}
    nodes, begin = np.cumsum(of["nodes"]), np.concatenate([[0], np.cumsum(of["degree"], dtype=np.int64)])
    head = np.repeat(np.arange(len(nodes), dtype=np.int32), of["degree"]) + of["head"]
    entries = np.unique(head[(of["head"] == 0) & (of["value"] == 0)])
    hub, node, key = (row["seeds"].values.field(c).to_numpy() for c in ("hub", "node", "key"))
    place = np.minimum(np.searchsorted(nodes, node), len(nodes) - 1)
    known = nodes[place] == node  # a hub without arcs is not
    hub, place, key = hub[known], place[known], key[known]
    all_hubs, step = np.unique(hub), max(1, TOGETHER // max(1, len(nodes)))
    for at in range(0, len(all_hubs), step):
        own = all_hubs[at : at + step]
        m = (hub >= own[0]) & (hub <= own[-1])
        d = _searched(begin, head, of["value"], np.searchsorted(own, hub[m]) * len(nodes) + place[m], key[m], len(own)).reshape(len(own), -1)
        out = [(of["out_to"], np.full(len(of["out_to"]), h), of["out_head"], d[k][of["out_tail"]] + of["out_value"]) for k, h in enumerate(own)]
        out += [(np.full(len(entries), row["block"].as_py()), np.full(len(entries), h), nodes[entries], d[k][entries]) for k, h in enumerate(own)]
        k = np.minimum(np.searchsorted(own, of["end_hub"]), len(own) - 1)
        e = np.minimum(np.searchsorted(nodes, of["end_node"]), len(nodes) - 1)
        m = (own[k] == of["end_hub"]) & (nodes[e] == of["end_node"])
        out.append((np.full(m.sum(), -1), of["end_hub"][m], of["end_node"][m], d[k[m], e[m]]))
        to, h, v, way = (np.concatenate(c) for c in zip(*out, strict=True))
        m = way < NONE
        yield pa.RecordBatch.from_pydict({"block": to[m].astype(np.int32), "part": np.full(m.sum(), row["part"].as_py(), np.int32), "hub": h[m], "node": v[m], "key": way[m], "own": to[m] == row["block"].as_py()})


def ways_by_blocks(arcs: DataFrame, asked: DataFrame, values: Sequence[str], factors: Sequence[int], size: int) -> DataFrame:
    """hub, node, key: the least sum of the values, times the factors, of a way from hub to node for each distinct pair of asked that has one.

    arcs: u, v and values, whole numbers that are not negative, stored where they need not be made again; size: how many.
    Factors are such that no sum reaches NONE.
    """
    spark = arcs.sparkSession
    context = spark.sparkContext
    some = arcs.where(F.pmod(F.xxhash64("u"), F.lit(max(1, size // SOME_ARCS))) == 0)
    n_ranges = RANGES * max(1, -(-size // BLOCK_ARCS))
    at = some.agg(F.percentile_approx("u", [k / n_ranges for k in range(1, n_ranges)], 10_000)).first()[0] or []  # a number for each range
    cuts = Cuts(np.unique(np.array(at, np.int64)))
    parts = max(1, context.defaultParallelism)
    hubs = checkpointed(numbered(asked.select("hub").distinct(), [F.col("hub")], "_n").select("hub", (F.col("_n") % parts).cast("int").alias("part")))
    pairs = asked.where("hub <> node").join(hubs, "hub")
    row = "block int, u long, v long, key long, to int"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = sum(b.column(c).to_numpy().astype(np.int64) * f for c, f in zip(values, factors, strict=True))
            yield _dealt(cuts, b.column("u").to_numpy(), b.column("v").to_numpy(), key)

    def deal_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v, part = (b.column(c).to_numpy().astype(np.int64) for c in ("node", "hub", "part"))
            yield _rows((cuts.of(u)[0], u, v, part, np.full(len(u), -1)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        for b in batches:
            block = b.column("block").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(ends, ends[1:], strict=False):
                if held and j > i and held[0].column("block")[0].as_py() != block[i]:
                    yield _block_rows(held, parts)
                if j > i:
                    held.append(b.slice(i, j - i))
        if held:
            yield _block_rows(held, parts)

    folder = new_folder(spark, "blocks")
    dealt = arcs.mapInArrow(deal, row).unionByName(pairs.mapInArrow(deal_ends, row))
    kind = ", ".join(["block int", "part int", *(f"{c} binary" for c in KINDS)])
    gathered = dealt.repartition(cuts.last + 1, "block").sortWithinPartitions("block").mapInArrow(gather, kind)
    gathered.write.partitionBy("block", "part").parquet(f"{folder}/arcs")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, part = b.column("hub").to_numpy(), b.column("part").to_numpy()
            _, first, last = cuts.of(node)
            for step in range(3):
                m = first + step <= last
                yield pa.RecordBatch.from_pydict({"block": (first + step)[m].astype(np.int32), "part": part[m], "hub": node[m], "node": node[m], "key": np.zeros(m.sum(), np.int64)})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                yield from _found({c: b.column(c)[n] for c in b.schema.names})

    def read(name: str, schema: str = SEEDS) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("block", "part", "hub", "node").agg(F.min("key").alias("key"))

    hubs.mapInArrow(enter, SEEDS).write.parquet(f"{folder}/seeds/round=0")
    done = 0
    while True:
        new = read(f"seeds/round={done}")
        active = [r.block for r in new.select("block").distinct().collect()]  # a number for each block
        if not active:
            break
        entering = least(read("seeds")).join(new.select("block", "hub").distinct(), ["block", "hub"], "left_semi")
        grouped = entering.groupBy("block", "part").agg(F.collect_list(F.struct("hub", "node", "key")).alias("seeds"))
        grouped = F.broadcast(grouped) if entering.limit(FEW_VALUES + 1).count() <= FEW_VALUES else grouped
        met = read("arcs", kind).where(F.col("block").isin(active)).join(grouped, ["block", "part"])
        met.mapInArrow(search, FOUND).write.parquet(f"{folder}/found/round={done}")
        known = least(read("seeds").unionByName(read("found", FOUND).where("own").drop("own")))
        sent = least(read(f"found/round={done}", FOUND).where("block >= 0 AND NOT own"))
        lower = sent.join(known.withColumnRenamed("key", "_key"), ["block", "part", "hub", "node"], "left").where("_key IS NULL OR key < _key")
        done += 1
        lower.select("block", "part", "hub", "node", "key").write.parquet(f"{folder}/seeds/round={done}")
    got = read("found").where("block < 0").groupBy("hub", "node").agg(F.min("key").alias("key"))
    return got.unionByName(asked.where("hub = node").select("hub", "node", F.lit(0).cast("long").alias("key")))
