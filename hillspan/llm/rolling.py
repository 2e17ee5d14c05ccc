"""Vectorised words and rolling fingerprints over Arrow string columns.

A fingerprint is a polynomial over random 64-bit values of its symbols, modulo 2^64, put through a mixing function.
Two of them from different keys identify a string; the operators state how many bits they compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes or words that are hashed at a time: the arrays stay in the processor's cache.
SEGMENT = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _key(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1), int(rng.integers(1, 2**62)) * 4 + 3


KEYS = (_key(0x5EED), _key(0xFACE))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and its inverses for i below n, modulo 2^64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT + 1024)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[base] = have = (out[0], out[1])
    return have


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Sums of values[j] * base^j for j below i, with a leading zero."""
    c = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(base, len(values) + 1)[0][: len(values)], out=c[1:])
    return c


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """Fingerprints of the byte strings buf[start:end]; starts ascend, strings may overlap."""
    table, base = KEYS[key]
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        lo = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, lo + SEGMENT)))
        hi = int(end[i:j].max())
        c = _prefix(table[buf[lo:hi]], base)
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = (c[e] - c[s]) * _powers(base, hi - lo + 1)[1][s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15)
        i = j
    return mix(out)


def windows(values: np.ndarray, m: int, key: int) -> np.ndarray:
    """Fingerprints of all runs of m consecutive 64-bit values."""
    base = KEYS[key][1]
    n = len(values) - m + 1
    out = np.empty(max(n, 0), U64)
    for lo in range(0, n, SEGMENT):
        hi = min(lo + SEGMENT, n)
        c = _prefix(values[lo : hi + m - 1], base)
        out[lo:hi] = (c[m:] - c[:-m]) * _powers(base, hi - lo)[1][: hi - lo]
    return mix(out)


def byte_windows(buf: np.ndarray, m: int, key: int) -> np.ndarray:
    """Fingerprints of all runs of m consecutive bytes."""
    table, base = KEYS[key]
    n = len(buf) - m + 1
    out = np.empty(max(n, 0), U64)
    for lo in range(0, n, SEGMENT):
        hi = min(lo + SEGMENT, n)
        c = _prefix(table[buf[lo : hi + m - 1]], base)
        out[lo:hi] = mix((c[m:] - c[:-m]) * _powers(base, hi - lo)[1][: hi - lo])
    return out


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about most bytes of a string column, a row at least: what a task holds doesn't grow with the rows of a batch."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


class Texts:
    """The texts of an Arrow string column as one array of bytes; null is empty."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        column = pc.fill_null(column, "")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks).cast(pa.large_string()) if column.num_chunks else pa.array([], pa.string())
        wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
        n, (_, offsets, data) = len(column), column.buffers()
        at = np.frombuffer(offsets, wide)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.n = n
        self.buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
        self.at = at - at[0]

    def text(self, i: int) -> bytes:
        return self.buf[self.at[i] : self.at[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """words_of() these texts."""
        return words_of(self.buf, self.at)


def words_of(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words of the texts buf[at[i]:at[i + 1]], and where each text's words begin in them (one more than texts)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(buf)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[1:][at[1:] > 0] - 1
    last[edge] = inside[edge]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one of each group of equal keys, and the group of each."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which
