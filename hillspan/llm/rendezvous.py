"""Questions that chunks of documents ask about all others, by fingerprint, in two shuffles.

Documents are dealt by a hash into chunks of a bounded size. A chunk sends each *distinct* fingerprint it wants to know
about once, packed by bucket (the fingerprint's top bits): a string that a third of all documents share costs one entry
a chunk, not one a document, so no bucket grows with a group of copies. A bucket answers a chunk with a bit for each
entry, in the entries' order; the chunk, computed again from the same documents, knows that order.

A chunk is a set of documents fixed by their ids and texts and not by the order of rows, so that a task which runs again
after the loss of an executor asks the same questions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shuffle_partitions

U64 = np.uint64
ASKED = "bucket long, chunk long, keys binary, more binary, bits binary"
ANSWERED = "chunk long, bucket long, bits binary"
#: Bytes of text in a chunk, at least and at most; bytes of text to a bucket, at least; bytes of text for each row of packed
#: entries, about: chunks and buckets both grow with the root of all bytes, so that rows keep their size.
LEAST, MOST, BUCKET, ENTRY = 1 << 20, 64 << 20, 2 << 20, 300


@dataclass
class Plan:
    """Documents with the column chunk, and the number of buckets (a power of two)."""

    documents: DataFrame
    buckets: int


def text_bytes(documents: DataFrame, text: str) -> int:
    return documents.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0


def buckets_for(spark: SparkSession, total: int) -> int:
    """A power of two, by the bytes of text, and enough for all partitions."""
    side = max(BUCKET, min(MOST, int((ENTRY * total) ** 0.5)))
    return 1 << max(8, (max(total // side, 8 * shuffle_partitions(spark)) - 1).bit_length())


def deal(documents: DataFrame, columns: list[str], total: int | None = None) -> DataFrame:
    """chunk, id and text of documents (columns: an id and a text); the number of chunks follows the bytes of text."""
    key, text = columns
    total = text_bytes(documents, text) if total is None else total
    chunks = total // min(MOST, max(LEAST, int((ENTRY * total) ** 0.5))) + 1
    return documents.select(F.pmod(F.xxhash64(key, text), F.lit(chunks)).alias("chunk"), F.col(key), F.col(text))


def plan(documents: DataFrame, columns: list[str]) -> Plan:
    total = text_bytes(documents, columns[1])
    return Plan(deal(documents, columns, total), buckets_for(documents.sparkSession, total))


def entries(fp: np.ndarray, second: np.ndarray | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that groups equal fingerprints (with second: equal pairs), where each distinct one begins in it, and the bounds of each bucket in the distinct ones."""
    order = np.argsort(fp, kind="stable") if second is None else np.lexsort((second, fp))
    f = fp[order]
    new = np.ones(len(f), bool)
    new[1:] = f[1:] != f[:-1]
    if second is not None and len(f):
        s = second[order]
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    edges = np.arange(1, buckets, dtype=np.int64).astype(U64) << U64(64 - (buckets - 1).bit_length())
    bounds = np.concatenate([[0], np.searchsorted(f[begin], edges), [len(begin)]])
    return order, begin, bounds


def _packed(values: np.ndarray, bounds: np.ndarray, full: np.ndarray) -> pa.Array:
    """values[bounds[b]:bounds[b + 1]] for the buckets b that are full, as binary."""
    width = values.dtype.itemsize
    at = np.concatenate([bounds[:-1][full], bounds[-1:]]) * width
    return pa.Array.from_buffers(pa.large_binary(), int(full.sum()), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def _bits(flags: np.ndarray, bounds: np.ndarray, full: np.ndarray) -> pa.Array:
    b = np.flatnonzero(full)
    return pa.array([np.packbits(flags[bounds[i] : bounds[i + 1]]).tobytes() for i in b], pa.binary())


def asked(chunk: int, keys: np.ndarray, more: np.ndarray | None, flags: np.ndarray | None, bounds: np.ndarray, carry: np.ndarray | None = None) -> pa.Table:
    """Rows for ASKED. carry: bits that come back to the chunk as they are."""
    full = bounds[1:] > bounds[:-1]
    n = int(full.sum())
    blank = pa.nulls(n, pa.binary())
    out = [pa.table({"bucket": pa.array(np.flatnonzero(full), pa.int64()), "chunk": pa.array(np.full(n, chunk, np.int64)), "keys": _packed(keys, bounds, full), "more": blank if more is None else _packed(more, bounds, full), "bits": blank if flags is None else _bits(flags, bounds, full)})]
    if carry is not None:
        out.append(pa.table({"bucket": pa.array([-1 - chunk], pa.int64()), "chunk": pa.array([chunk], pa.int64()), "keys": pa.array([b""], pa.binary()), "more": pa.nulls(1, pa.binary()), "bits": pa.array([np.packbits(carry).tobytes()], pa.binary())}))
    return pa.concat_tables(out)


def answered(bucket: pa.Table, kind: np.dtype, more: np.dtype | None, decide: Callable[..., np.ndarray]) -> pa.Table:
    """decide(keys, more, flags, sizes) gives a bit, or a row of bits, for each entry of a bucket; sizes: entries of each asking row."""
    number = bucket.column("bucket")[0].as_py()
    chunks, bits = bucket.column("chunk"), bucket.column("bits")
    if number < 0:
        return pa.table({"chunk": chunks, "bucket": pa.array(np.full(len(chunks), -1), pa.int64()), "bits": bits})
    keys = [np.frombuffer(x, kind) for x in bucket.column("keys").to_pylist()]
    sizes = np.array([len(x) for x in keys])
    flags = None if bits.null_count else np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(bits.to_pylist(), sizes, strict=True)])
    second = None if more is None else np.concatenate([np.frombuffer(x, more) for x in bucket.column("more").to_pylist()])
    yes = decide(np.concatenate(keys), second, flags, sizes)
    ends = np.cumsum(sizes)
    any_yes = np.flatnonzero(np.logical_or.reduceat(yes if yes.ndim == 1 else yes.any(axis=1), ends - sizes))
    return pa.table({"chunk": chunks.take(pa.array(any_yes)), "bucket": pa.array(np.full(len(any_yes), number), pa.int64()), "bits": pa.array([np.packbits(yes[ends[i] - sizes[i] : ends[i]]).tobytes() for i in any_yes], pa.binary())}).cast(pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())]))


def by_owner(bucket: int, owners: np.ndarray, bits: np.ndarray) -> pa.Table:
    """Rows for ANSWERED, of a bucket's entries in the order of their chunks' own: owners has the chunk of each, bits a row of bits."""
    order = np.argsort(owners, kind="stable")
    begin = np.flatnonzero(np.diff(owners[order], prepend=-1))
    ends = np.append(begin[1:], len(order))
    full = [(int(owners[order[a]]), np.packbits(bits[order[a:b]]).tobytes()) for a, b in zip(begin, ends, strict=True) if bits[order[a:b]].any()]
    return pa.table({"chunk": pa.array([c for c, _ in full], pa.int64()), "bucket": pa.array([bucket] * len(full), pa.int64()), "bits": pa.array([x for _, x in full], pa.binary())})


def answers(replies: pa.Table, bounds: np.ndarray, wide: int = 1) -> np.ndarray:
    """The bits of each distinct entry of a chunk, wide of them for each."""
    out = np.zeros((bounds[-1], wide), bool)
    for b, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True):
        if b >= 0:
            n = bounds[b + 1] - bounds[b]
            out[bounds[b] : bounds[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n * wide).reshape(n, wide)
    return out if wide > 1 else out[:, 0]


def carried(replies: pa.Table, n: int) -> np.ndarray:
    for b, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist(), strict=True):
        if b < 0:
            return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    return np.zeros(n, bool)


def two_rounds(p: Plan, ask: Callable, settle: Callable, ask_again: Callable, settle_again: Callable, finish: Callable, schema: str) -> DataFrame:
    """ask(chunk table) and ask_again(chunk table, replies) give rows of ASKED, settle and settle_again turn a bucket of them into ANSWERED, finish(chunk table, replies) gives the result."""
    by_chunk = p.documents.groupBy("chunk")
    first = by_chunk.applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(settle, ANSWERED)
    second = by_chunk.cogroup(first.groupBy("chunk")).applyInArrow(ask_again, ASKED).groupBy("bucket").applyInArrow(settle_again, ANSWERED)
    return by_chunk.cogroup(second.groupBy("chunk")).applyInArrow(finish, schema)
