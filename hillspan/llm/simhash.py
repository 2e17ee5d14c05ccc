"""SimHash near-duplicates found with vantage-point trees (operator 2).

A vantage-point tree over a bounded sample of the distinct fingerprints deals all of them into shards: at each node a
fingerprint goes inside or outside of a ball around the vantage point. As a query it goes to every other shard that the
triangle bounds do not rule out for its radius, that is, where it lies within the radius of the ball's boundary. Each
shard searches a tree of its own the same way and keeps a spanning forest of the pairs it finds, at most one link for a
fingerprint, so a group of copies costs rows in proportion to its size. Pairs are exact: every two fingerprints within
the radius meet in the shard of one of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .rolling import Texts, slices
from .shared import checkpointed, in_arrow, unused
from .shingles import SIMILARITY, alike

SHINGLE, RADIUS = 3, 2
#: Distinct fingerprints that the shards' tree is fitted on, about: at least and at most, and a 64th of all between; fingerprints of a shard, about; of a leaf.
SAMPLE, MOST_SAMPLE, SHARD, LEAF = 20_000, 500_000, 4096, 128
#: Shingles of a text that are held at a time; queries that a leaf answers at a time; fingerprints that are dealt to shards at a time.
PIECE, QUERIES, ROUTED = 1 << 15, 1 << 13, 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The 64 bits, highest first. Of fewer words than a shingle the whole sequence is one; of no words all bits are 0."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    begin, end = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, total = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(begin), PIECE):
        hashes = b"".join([digest(whole[a:b], 42) for a, b in zip(begin[at : at + PIECE], end[at : at + PIECE], strict=True)])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(begin)).tobytes()


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row_hash (of doc_id and text) and fp (the 64 bits as a long) of each row; null text: no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in slices(batch, 2)):
            t = Texts(b.column(2))
            fp = np.frombuffer(b"".join(fingerprint(t.text(i), shingle) for i in range(t.n)), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], ["doc_id", "row_hash", "fp"])

    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return documents.select(key.alias("doc_id"), F.xxhash64(key, text).alias("row_hash"), text.alias("text")).transform(in_arrow, work, "doc_id long, row_hash long, fp long")


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """A tree over distinct fingerprints, whose leaves hold at most leaf of them (more only if no ball divides them)."""

    def __init__(self, points: np.ndarray, leaf: int):
        #: Nodes: vantage point, ball's radius, node inside, node outside; leaves: -1 - number in place of the nodes.
        self.nodes: list[list] = []
        self.leaves: list[np.ndarray] = []
        self.root = self._build(points, leaf)

    def _build(self, points: np.ndarray, leaf: int) -> int:
        if len(points) > leaf:
            tried = []
            for p in points[:: max(1, len(points) // 5)][:5]:
                d = distance(points, p)
                mu = int(np.median(d))
                mu = mu if (d > mu).any() else mu - 1
                inside = d <= mu
                tried.append((int((np.abs(d.astype(int) - mu) <= 2).sum()) + abs(int(2 * inside.sum()) - len(points)), p, mu, inside))
            _, p, mu, inside = min(tried, key=lambda x: x[0])
            if inside.any() and not inside.all():
                self.nodes.append([p, mu, 0, 0])
                n = len(self.nodes) - 1
                self.nodes[n][2:] = [self._build(points[inside], leaf), self._build(points[~inside], leaf)]
                return n
        self.leaves.append(points)
        return -len(self.leaves)

    def visits(self, q: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the queries that triangle bounds don't keep from each (as indexes); at radius 0 each query has one."""
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            n, at = todo.pop()
            if n < 0:
                yield -1 - n, at
                continue
            p, mu, inside, outside = self.nodes[n]
            d = distance(q[at], p).astype(np.int16)
            todo += [(m, x) for m, x in ((outside, at[d + radius > mu]), (inside, at[d - radius <= mu])) if len(x)]


class Forest:
    """Union-find over numbers, whole arrays of pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while (self.parent[r] != r).any():
            r = self.parent[r]
        self.parent[x] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, b, a)


def links_within(points: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of fingerprints, of the pairs within radius of which one is at home."""
    signed = np.argsort(points.view(np.int64), kind="stable")
    points, home = points[signed], home[signed]
    number = np.flatnonzero(home)
    tree, forest = VantageTree(points[number], LEAF), Forest(len(points))
    for leaf, at in tree.visits(points, radius):
        inner = tree.leaves[leaf]
        own = number[np.searchsorted(points[number].view(np.int64), inner.view(np.int64))]
        for lo in range(0, len(at), QUERIES):
            q = at[lo : lo + QUERIES]
            i, j = np.nonzero(distance(points[q][:, None], inner[None, :]) <= radius)
            forest.join(q[i], own[j])
    root = forest.roots(np.arange(len(points)))
    linked = np.flatnonzero(root != np.arange(len(points)))
    return points[linked], points[root[linked]]


def _joined(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[np.ndarray]:
    """The first column of batches, least rows or more at a time."""
    held, size = [], 0
    for b in batches:
        held.append(b.column(0).to_numpy(zero_copy_only=False))
        size += b.num_rows
        if size >= least:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect all of distinct (fp) that lie within radius of one another, directly or through others."""
    n = distinct.count()
    # those with a small hash, about as many as wanted: nothing is sorted, no task meets all
    share = min(MOST_SAMPLE, max(SAMPLE, n // 64)) / max(n, 1)
    few = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = np.sort(few.toPandas()["fp"].to_numpy(np.int64))
    tree = VantageTree(sample.view(np.uint64), max(1, len(sample) * SHARD // max(n, SHARD)))
    schema = "shard int, fp long, home boolean"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in _joined(batches, ROUTED):
            q = fp.view(np.uint64)
            own = np.zeros(len(q), np.int32)
            for leaf, at in tree.visits(q, 0):
                own[at] = leaf
            for leaf, at in tree.visits(q, radius):
                at = at[own[at] <= leaf]  # of two shards, only the later one gets the other's queries
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), leaf, np.int32)), pa.array(fp[at]), pa.array(own[at] == leaf)], ["shard", "fp", "home"])

    def search(t: pa.Table) -> pa.Table:
        fp, home = t.column("fp").to_numpy(), t.column("home").to_numpy(zero_copy_only=False)
        u, v = links_within(fp.view(np.uint64), home, radius) if home.any() else (fp[:0], fp[:0])
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    return distinct.transform(in_arrow, route, schema).groupBy("shard").applyInArrow(search, "u long, v long")


def simhash_groups(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, row_hash, fp, root (of the group of fingerprints) and component_id of each row of documents (doc_id, text)."""
    prints = checkpointed(fingerprints(documents, shingle))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked_fingerprints(distinct.select("fp"), radius))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "root", "component_id"), "fp", "left")


def simhash_components(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of documents (doc_id, text).

    component_id: the smallest doc_id that links of radius bits or fewer reach, its own included. Null and empty texts have
    fingerprint zero and link like any others. Equal rows share a component. A row with a null id has the component of the
    ids it is linked to, null if there are none. No documents: no rows.
    """
    return simhash_groups(documents, shingle, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of documents, all columns, that have the smallest doc_id of their group (null ids last; then the smallest hash). Of equal rows one stays.

    A group is what links of radius bits or fewer, and of similarity or more on shingles of five words, connect.
    """
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = documents.select(F.xxhash64(key, text).alias("row_hash"), F.xxhash64(text).alias("text_hash"), key.alias("doc_id"), text.alias("text"))
    groups = checkpointed(simhash_groups(documents, shingle, radius).select("doc_id", "row_hash", "root"))
    texts = checkpointed(keyed.select("row_hash", "text_hash").distinct())
    named = checkpointed(groups.join(texts, "row_hash"))
    near = named.select("root", "text_hash").distinct()
    star = near.join(near.groupBy("root").agg(F.min("text_hash").alias("u")), "root").where("text_hash <> u").select("u", F.col("text_hash").alias("v"))
    roots = components(star.union(alike(keyed, similarity)))
    whole = named.join(roots, F.col("text_hash") == F.col("node"), "left").select("doc_id", "row_hash", F.coalesce(roots["root"], "text_hash").alias("g"))
    first = whole.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row_hash"))).alias("x"))
    name = unused(documents, "_row")
    chosen = checkpointed(first.select(F.col("x.row_hash").alias(name)))
    rows = documents.withColumn(name, F.xxhash64(key, text))
    return rows.join(chosen, name, "left_semi").dropDuplicates([name]).select(*documents.columns)
