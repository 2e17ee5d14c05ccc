"""Exact nearest neighbours by a block matrix join (operator 5).

Vectors are dealt into blocks of BLOCK bytes by a hash of their ids, the queries among them into query blocks of QUERIES
bytes. Every query block meets every candidate block in a tile of its own: a stated set of queries against all rows, whose
largest task holds one block of each kind whatever the numbers of either. A tile multiplies the vectors
rounded to int8; with s the scale of a rounded vector q and e the length of what rounding dropped, the distance of two
vectors differs from that of s*q and s'*q' by e + e' at most, by the triangle inequality. Candidates whose lower bound
exceeds the K-th smallest upper bound of their tile are pruned; the others are recomputed in double precision, and the
tile hands on its K best of each query. Heaps of K merge the tiles' rows, for some queries in each task.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, shuffle_partitions

K = 10
#: Bytes of a candidate block and of a query block, about; vectors of a candidate block, at least, where it is split to give all partitions work.
BLOCK, QUERIES, SMALL = 8 << 20, 4 << 20, 512
#: Queries that are multiplied at a time; rows of the tiles that a task merges, about.
SLICE, MERGED = 128, 1 << 18
RESULT = "query_id long, rank int, vec_id long, score double"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows rounded to -127..127, their scales, and the lengths of what rounding dropped (a little more, for its own rounding)."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q, scale, error * (1 + 1e-9) + np.abs(x).max(axis=1) * 1e-12


def tile(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, row id, distance) of each query's k nearest rows but those of its own id; ties to the smaller id."""
    (q_id, q), (r_id, r) = queries, rows
    (qi, qs, qe), (ri, rs, re) = quantised(q), quantised(r)
    # products of int8 add up exactly in float32 while 127^2 * width stays below 2^24, in float64 beyond
    exact = np.float32 if q.shape[1] <= 1024 else np.float64
    dot = (qi.astype(exact) @ ri.astype(exact).T).astype(np.float64)
    lengths = [s**2 * (i.astype(np.int32) ** 2).sum(axis=1) for i, s in ((qi, qs), (ri, rs))]
    near = np.sqrt(np.maximum(lengths[0][:, None] + lengths[1][None, :] - 2 * qs[:, None] * rs[None, :] * dot, 0))
    slack = (qe[:, None] + re[None, :]) + 1e-7 * near + np.sqrt(1e-13 * (lengths[0][:, None] + lengths[1][None, :]))
    own = q_id[:, None] == r_id[None, :]
    upper = np.where(own, np.inf, near + slack)
    limit = np.partition(upper, k - 1, axis=1)[:, k - 1 : k] if upper.shape[1] > k else np.full((len(q), 1), np.inf)
    i, j = np.nonzero((near - slack <= limit) & ~own)
    d = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        d[at : at + (1 << 16)] = np.sqrt(np.add.accumulate((q[a] - r[b]) ** 2, axis=1)[:, -1])  # component by component, as SQL adds
    order = np.lexsort((r_id[j], d, i))
    i, j, d = i[order], j[order], d[order]
    begin = np.searchsorted(i, np.arange(len(q)))
    best = np.arange(len(i)) - begin[i] < k
    return q_id[i[best]], r_id[j[best]], d[best]


def _matrix(t: pa.Table, width: int, number: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    values = t.column(vector).combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return t.column(number).to_numpy(), values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(vectors: DataFrame, every: int = 100, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """RESULT: for each vector whose id is divisible by every, the k nearest of all others by Euclidean distance.

    Null ids, and vectors that are null, empty, zero or hold null or non-finite numbers, take no part. Vectors of another
    length than the query's are not its candidates. Of rows with the same id the one with the least vector counts.
    """
    x = F.col(vector_column).cast("array<double>")
    sound = vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))) & F.exists("v", lambda a: a != 0))
    rows = checkpointed(sound.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("width", F.size("v")))
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q"), F.coalesce(F.max("width"), F.lit(1)).alias("width")).first()
    blocks = max(counts.n * 8 * counts.width // BLOCK + 1, min(shuffle_partitions(vectors.sparkSession), counts.n // SMALL))
    query_blocks = counts.q * 8 * counts.width // QUERIES + 1
    by_hash = F.xxhash64("vec_id")
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = rows.select(F.pmod(by_hash, F.lit(blocks)).cast("int").alias("block"), grid(query_blocks).alias("query_block"), "width", "vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0)
    # the second hash: blocks of queries and of candidates are not to follow one another
    asked = asked.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"), grid(blocks).alias("block"), "width", F.col("vec_id").alias("query_id"), F.col("v").alias("query"))

    def tiles(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            width = left.column("width")[0].as_py()
            candidates, (number, queries) = _matrix(left, width, "vec_id", "v"), _matrix(right, width, "query_id", "query")
            out += [tile((number[at : at + SLICE], queries[at : at + SLICE]), candidates, k) for at in range(0, len(number), SLICE)]
        q, r, d = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"query_id": pa.array(q), "vec_id": pa.array(r), "score": pa.array(d)})

    def merge(t: pa.Table) -> pa.Table:
        pairs: dict[int, list[tuple[float, int]]] = {}
        for query, vec, d in zip(*(t.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
            heap = pairs.setdefault(query, [])
            (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (-d, -vec))
        best = [(query, n + 1, -vec, -d) for query, heap in pairs.items() for n, (d, vec) in enumerate(sorted(heap, reverse=True))]
        query, rank, vec, d = zip(*best, strict=True)
        return pa.table({"query_id": pa.array(query, pa.int64()), "rank": pa.array(rank, pa.int32()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(d, pa.float64())})

    keys = ("block", "query_block", "width")
    found = dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(tiles, "query_id long, vec_id long, score double")
    parts = counts.q * blocks * k // MERGED + 1
    return found.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part")).applyInArrow(merge, RESULT)


SQL = """
WITH sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT vec_id, min(e) AS e FROM sound GROUP BY vec_id),
d AS (
  SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
