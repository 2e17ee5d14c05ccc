"""Suffix-array deduplication with a logarithmic index family (operator 3).

A match of LENGTH bytes contains the smallest of its rolling fingerprints of half that length (its minimiser), so the
suffixes that start at minimisers suffice to find it: about two in every 200. They are in sparse suffix arrays, ordered by
KEY: the suffix's first eight bytes, then 32 bits for its first 200 bytes, then 32 bits for all bytes in reach of a match.
Two suffixes share a prefix of their keys as far as they share one of these, so a suffix's longest common prefix with any
other is with a neighbour in the order, and a merge scan reads neighbours alone.

A batch of documents gets its array, dealt into buckets by fingerprint of the first 200 bytes; within a bucket it is
merge-scanned against the levels there are and becomes a level itself, and levels of equal size merge, so that each suffix
is merged a logarithmic number of times and a bucket holds a logarithmic number of arrays. The chunks of one batch come
together like this in memory, batch after batch in files (SuffixIndex).

A suffix without another of the same first 200 bytes ends no match; where all that share them agree in their whole reach,
the scan settles their matches; the rest are contested, and a second round compares the strings at every byte of the
contested stretches by their LENGTH bytes.

Strings are equal if 8 or more bits of bucket and 64 bits of two fingerprints are equal (72 bits, and more with more data).
Ordering all suffixes by text to their ends would move 400 bytes for each of them in place of 16.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import removed
from .rendezvous import ANSWERED, ASKED, answered, answers, asked, buckets_for, by_owner, carried, deal, entries, text_bytes
from .rolling import SEGMENT, U64, Texts, byte_windows, mix, spans
from .shared import checkpointed, shared_folder

LENGTH = 400
#: Suffixes in a new batch of the family, at least; starts of strings whose fingerprints are held at a time.
BATCH, SLICE = 8192, 1 << 21
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
#: A suffix's place in the order, compared byte by byte; bytes of it that suffixes of the same first half of LENGTH share.
KEY, NEAR = np.dtype("S16"), 12
LEVEL = "bucket long, keys binary, owners binary, flags binary"
MANIFEST = "version long, length int, batches long, buckets long, level string, size long"


class LevelFamily:
    """Suffix arrays of levels. After every add, same and near say for each key so far whether another equals it, or shares NEAR bytes."""

    def __init__(self, size: int):
        self.same, self.near = np.zeros(size, bool), np.zeros(size, bool)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        new = (keys[order], ids[order])
        self._scan(new[0][:-1], new[1][:-1], new[0][1:], new[1][1:])
        for k, i in self.levels:
            at = np.searchsorted(k, new[0])
            for shift in (0, 1):  # the neighbours in the merged order
                ok = (at - shift >= 0) & (at - shift < len(k))
                j = at[ok] - shift
                self._scan(k[j], i[j], new[0][ok], new[1][ok])
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self.levels.append(merged(self.levels.pop(-2), self.levels.pop()))

    def _scan(self, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> None:
        """Neighbours a and b, numbered i and j: what their common prefix says."""
        common = common_bytes(a, b)
        for found, enough in ((self.same, KEY.itemsize), (self.near, NEAR)):
            found[i[common >= enough]] = True
            found[j[common >= enough]] = True


def common_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the keys a and b, pair by pair."""
    differ = _bytes(a) != _bytes(b)
    return np.where(differ.any(axis=1), differ.argmax(axis=1), KEY.itemsize)


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two arrays (keys, ids) as one: the second one's keys go to their places in the first."""
    (k, i), (l, j) = a, b
    at = np.searchsorted(k, l, side="right") + np.arange(len(l))
    keys, ids, old = np.empty(len(k) + len(l), KEY), np.empty(len(k) + len(l), i.dtype), np.ones(len(k) + len(l), bool)
    old[at] = False
    keys[at], ids[at], keys[old], ids[old] = l, j, k, i
    return keys, ids


def _bytes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, KEY.itemsize)


def family(keys: np.ndarray, sizes: np.ndarray) -> LevelFamily:
    """The family after all batches; sizes: keys that each row brings, rows join into batches of BATCH keys or more."""
    out, at, ends = LevelFamily(len(keys)), 0, np.cumsum(sizes)
    while at < len(keys):
        end = int(ends[min(np.searchsorted(ends, at + BATCH), len(ends) - 1)])
        out.add(keys[at:end], np.arange(at, end))
        at = end
    return out


def sliding(a: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over all runs of w values."""
    n = len(a) - w + 1
    out = np.empty(max(n, 0), a.dtype)
    for lo in range(0, n, SEGMENT):
        hi = min(lo + SEGMENT, n)
        m, span = a[lo : hi + w - 1], 1
        while span * 2 <= w:
            m = op(m[:-span], m[span:])
            span *= 2
        out[lo:hi] = op(m[: hi - lo], m[w - span : w - span + hi - lo])
    return out


class _Chunk:
    """A chunk's texts, its minimisers, and which of them governs the strings from each byte on (as runs of bytes)."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").to_pylist()
        self.number = table.column("chunk")[0].as_py()
        self.length, self.buckets = length, buckets
        t = self.texts = Texts(table.column("text"))
        places, values, edges, least = ([np.zeros(0, k)] for k in (np.int64, U64, np.int64, U64))
        for lo, grams, governing in self._slices():
            w = length - length // 2 + 1
            blank = np.zeros(w - 1, U64)
            at = np.flatnonzero(sliding(np.concatenate([blank, governing, blank]), w, np.maximum) == grams)
            places.append(lo + at)
            values.append(grams[at])
            edge = np.flatnonzero(np.concatenate([[True], governing[1:] != governing[:-1]]))
            edges.append(lo + edge)
            least.append(governing[edge])
        self.edges, self.least = np.concatenate(edges), np.concatenate(least)
        at, first = np.unique(np.concatenate(places), return_index=True)
        self.grams = mix(np.concatenate(values)[first])
        doc = np.searchsorted(t.at, at, side="right") - 1
        lo, hi = np.maximum(t.at[doc], at - (length - length // 2)), np.minimum(t.at[doc + 1], at + length)
        whole = mix(spans(t.buf, lo, hi, 1) + (at - lo).astype(U64))
        keys = np.empty((len(at), KEY.itemsize), np.uint8)
        keys[:, :8] = np.concatenate([t.buf, np.zeros(8, np.uint8)])[at[:, None] + np.arange(8)]
        low = U64((buckets - 1).bit_length())
        for k, x in ((8, self.grams << low), (NEAR, whole)):
            keys[:, k : k + 4] = (x >> U64(32)).astype(">u4").view(np.uint8).reshape(-1, 4)
        #: Distinct keys in the order of bucket and key: the order, where each begins in it, the buckets' bounds.
        keys = keys.view(KEY).ravel()
        bucket = (self.grams >> (U64(64) - low)).astype(np.int64)
        self.order = np.lexsort((keys, bucket))
        keys, bucket = keys[self.order], bucket[self.order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (bucket[1:] != bucket[:-1])])[: len(keys)]
        self.begin = np.flatnonzero(new)
        self.keys = keys[self.begin]
        self.bounds = np.searchsorted(bucket[self.begin], np.arange(buckets + 1))

    def _slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For up to SLICE starts of strings at a time, from lo on: the fingerprints in their reach, and the least one of each string; 0 where it would cross into another document."""
        t, n = self.texts, len(self.texts.buf) - self.length + 1
        half = self.length // 2
        begin, last = t.at[:-1], t.at[1:] - self.length + 1
        begin, last = begin[last > begin], last[last > begin]
        for lo in range(0, n, SLICE):
            hi = min(lo + SLICE, n)
            grams = byte_windows(t.buf[lo : hi + self.length - 1], half, 0) | U64(1)
            change = np.zeros(hi - lo + 1, np.int32)
            some = slice(int(np.searchsorted(last, lo, side="right")), int(np.searchsorted(begin, hi)))
            np.add.at(change, np.maximum(begin[some], lo) - lo, 1)
            np.add.at(change, np.minimum(last[some], hi) - lo, -1)
            yield lo, grams, np.where(np.cumsum(change[:-1]) > 0, sliding(grams, self.length - half + 1, np.minimum), U64(0))

    def several(self) -> np.ndarray:
        """Whether the chunk has each distinct key more than once."""
        return (np.diff(np.append(self.begin, len(self.order))) > 1).astype(np.uint8)

    def starts(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of settled strings, and of contested ones; bits: settled and contested, of each distinct key."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = self.grams[self.order[self.begin]]
        order = np.argsort(grams)
        got = bits[order[np.minimum(np.searchsorted(grams[order], mix(self.least)), len(grams) - 1)]] & (self.least > 0)[:, None]
        run = np.diff(np.append(self.edges, max(0, len(self.texts.buf) - self.length + 1)))
        return tuple(_runs(self.edges[got[:, k]], run[got[:, k]]) for k in (0, 1))

    def suffixes(self, at: np.ndarray):
        a, b = (spans(self.texts.buf, at, at + self.length, k) for k in (0, 1))
        b >>= U64(32)
        return (a, b, *entries(a, b, self.buckets))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the runs, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(start - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


def _strings(high: np.ndarray, low: np.ndarray, buckets: int) -> np.ndarray:
    """32 bits of high below those of its bucket, then 32 of low."""
    return ((high >> U64(64 - (buckets - 1).bit_length() - 32)) << U64(32)) | (low & U64(0xFFFFFFFF))


def _repeated(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Whether each key occurs again, or did so in its chunk."""
    order = np.argsort(keys)
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])[: len(keys)]
    out = np.empty(len(keys), bool)
    out[order] = np.repeat(np.diff(np.append(np.flatnonzero(new), len(keys))) > 1, np.diff(np.append(np.flatnonzero(new), len(keys))))
    return out | (several > 0)


class SuffixIndex:
    """Levels of suffix arrays at path, in files that all executors see, and the documents of all batches.

    add() takes a batch, matches() tells for batches which of their bytes recur in any. An index is opened again by its path.
    A merge removes the levels that it replaces, so what matches() gives is computed before the next batch is added.
    Documents are doc_id and text; null text counts as empty, a null id as any other.
    """

    def __init__(self, spark: SparkSession, path: str, length: int = LENGTH, buckets: int | None = None):
        if length < 16:
            raise ValueError("need a length of 16 bytes or more")
        self.spark, self.path, self.length = spark, path.rstrip("/"), length
        self.version = self.batches = 0
        self.buckets = buckets or buckets_for(spark, 0)
        #: Folder and suffixes of each level.
        self.levels: list[tuple[str, int]] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuffixIndex:
        """The index that add() left at path, for matches of the length that it was made for. What a run wrote that died before its manifest does not count."""
        rows = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
        last = rows.agg(F.max("version")).first()[0]
        found = rows.where(F.col("version") == last).collect()  # a row for each level
        out = cls(spark, path, found[0].length)
        out.version, out.batches, out.buckets = found[0].version, found[0].batches, found[0].buckets
        out.levels = [(r.level, r.size) for r in sorted(found, key=lambda r: -r.size)]
        return out

    def add(self, documents: DataFrame, kept: bool = True) -> int:
        """Takes a batch and gives its number; a batch whose run died is added again under the same one. kept: whether its documents are stored; if not, they come from dealt(), and go to matches() again."""
        number, self.batches = self.batches, self.batches + 1
        dealt = documents
        if kept:
            self.dealt(documents, number).write.mode("overwrite").parquet(f"{self.path}/documents/batch={number}")
            dealt = self._documents(number)
        length, buckets = self.length, self.buckets

        def ask(table: pa.Table) -> pa.Table:
            c = _Chunk(table, length, buckets)
            return asked(c.number, c.keys, c.several(), None, c.bounds)

        def build(bucket: pa.Table) -> pa.Table:
            keys = [np.frombuffer(x, KEY) for x in bucket.column("keys").to_pylist()]
            sizes = np.array([len(x) for x in keys])
            several = np.concatenate([np.frombuffer(x, np.uint8) for x in bucket.column("more").to_pylist()]) > 0
            found = family(np.concatenate(keys), sizes)
            return _level(bucket.column("bucket")[0].as_py(), np.concatenate(keys), np.repeat(bucket.column("chunk").to_numpy(), sizes), found.same | several, found.near | several)

        level = dealt.groupBy("chunk").applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(build, LEVEL)
        self.levels.append(self._written(level))
        replaced = []
        while len(self.levels) > 1 and self.levels[-1][1] >= self.levels[-2][1]:
            replaced += [self.levels.pop()[0] for _ in range(2)]
            both = [self.spark.read.schema(LEVEL).parquet(f) for f in replaced[-2:]]
            self.levels.append(self._written(both[0].unionByName(both[1]).groupBy("bucket").applyInArrow(_united, LEVEL)))
        self.version += 1
        rows = [(self.version, self.length, self.batches, self.buckets, f, n) for f, n in self.levels]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        for folder in replaced:  # no manifest that counts names them any more
            removed(self.spark, folder)
        return number

    def dealt(self, documents: DataFrame, number: int, total: int | None = None) -> DataFrame:
        """doc_id, text and chunk of a batch; chunks of all batches have numbers of their own. total: bytes of text."""
        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return deal(docs, ["doc_id", "text"], total).withColumn("chunk", F.col("chunk") + F.lit(number << 40))

    def _documents(self, number: int) -> DataFrame:
        return self.spark.read.schema("chunk long, doc_id long, text string").parquet(f"{self.path}/documents/batch={number}")

    def _written(self, level: DataFrame) -> tuple[str, int]:
        folder = f"{self.path}/level-{uuid4().hex}"
        level.write.parquet(folder)
        return folder, self.spark.read.schema(LEVEL).parquet(folder).agg(F.coalesce(F.sum(F.octet_length("keys")), F.lit(0))).first()[0] // KEY.itemsize

    def matches(self, batches: list[int] | None = None, documents: DataFrame | None = None) -> DataFrame:
        """RESULT for the documents of some batches (default: all), against all batches. documents: what dealt() gave, for batches that were not stored.

        Chunks of other batches are read again only where one of these shares a contested stretch with them.
        """
        wanted = list(range(self.batches)) if batches is None else batches
        length, buckets, asking = self.length, self.buckets, np.array(wanted, np.int64)
        levels = reduce(DataFrame.unionByName, [self.spark.read.schema(LEVEL).parquet(f) for f, _ in self.levels])

        def settle(bucket: pa.Table) -> pa.Table:
            _, keys, owners, same, near = _opened(bucket)
            order = np.argsort(keys, kind="stable")
            prefix = _bytes(keys[order])[:, :NEAR]
            new = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(axis=1)]))
            size = np.diff(np.append(new, len(keys)))
            ours = np.logical_or.reduceat(np.isin(owners >> 40, asking)[order], new)
            agree = np.logical_and.reduceat(same[order], new)
            bits = np.empty((len(keys), 2), bool)
            bits[order] = np.stack([np.repeat(x, size) for x in (agree & ours, ~agree & ours)], 1)
            return by_owner(bucket.column("bucket")[0].as_py(), owners, bits & near[:, None])

        def ask_again(table: pa.Table, replies: pa.Table) -> pa.Table:
            c = _Chunk(table, length, buckets)
            bits = answers(replies, c.bounds, 2)
            _, at = c.starts(bits)
            a, b, order, begin, bounds = c.suffixes(at)
            first = order[begin]
            return asked(c.number, _strings(a[first], b[first], buckets), (np.diff(np.append(begin, len(order))) > 1).astype(np.uint8), None, bounds, bits.ravel())

        def settle_again(bucket: pa.Table) -> pa.Table:
            return answered(bucket, np.uint64, np.uint8, lambda keys, several, _flags, _sizes: _repeated(keys, several))

        def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
            c = _Chunk(table, length, buckets)
            settled, at = c.starts(carried(replies, 2 * c.bounds[-1]).reshape(-1, 2))
            _, _, order, begin, bounds = c.suffixes(at)
            yes = np.zeros(len(at), bool)
            yes[order] = np.repeat(answers(replies, bounds), np.diff(np.append(begin, len(order))))
            gone = np.zeros(len(c.texts.buf) + 1, np.int32)
            for starts in (settled, at[yes]):
                np.add.at(gone, starts, 1)
                np.add.at(gone, starts + length, -1)
            return _result(c, np.cumsum(gone[:-1]) > 0)

        first = levels.groupBy("bucket").applyInArrow(settle, ANSWERED)
        ours = documents if documents is not None else reduce(DataFrame.unionByName, [self._documents(k) for k in wanted])
        mine = ours.groupBy("chunk")
        others = [k for k in range(self.batches) if k not in wanted]
        if others:
            first = checkpointed(first)
            met = first.where(F.shiftright("chunk", 40).isin(others)).select("chunk").distinct()
            old = reduce(DataFrame.unionByName, [self._documents(k) for k in others]).join(met, "chunk", "left_semi")
            again: GroupedData = ours.unionByName(old).groupBy("chunk")
        else:
            again = mine
        second = again.cogroup(first.groupBy("chunk")).applyInArrow(ask_again, ASKED).groupBy("bucket").applyInArrow(settle_again, ANSWERED)
        if others:
            second = second.where(F.shiftright("chunk", 40).isin(wanted))
        return mine.cogroup(second.groupBy("chunk")).applyInArrow(finish, RESULT)


def _level(bucket: int, keys: np.ndarray, owners: np.ndarray, same: np.ndarray, near: np.ndarray) -> pa.Table:
    order = np.argsort(keys, kind="stable")
    flags = (same * 1 + near * 2).astype(np.uint8)
    return pa.table({"bucket": pa.array([bucket], pa.int64()), "keys": pa.array([keys[order].tobytes()], pa.binary()), "owners": pa.array([owners[order].astype("<i8").tobytes()], pa.binary()), "flags": pa.array([flags[order].tobytes()], pa.binary())})


def _opened(bucket: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's levels, merge-scanned against one another: its number, and the keys, owners, same and near of all."""
    keys = [np.frombuffer(x, KEY) for x in bucket.column("keys").to_pylist()]
    owners = np.concatenate([np.frombuffer(x, "<i8") for x in bucket.column("owners").to_pylist()])
    flags = np.concatenate([np.frombuffer(x, np.uint8) for x in bucket.column("flags").to_pylist()])
    found, at = LevelFamily(len(owners)), 0
    if len(keys) > 1:  # a level alone has been scanned
        for k in keys:
            found.add(k, np.arange(at, at + len(k)))
            at += len(k)
    return bucket.column("bucket")[0].as_py(), np.concatenate(keys), owners, found.same | (flags & 1 > 0), found.near | (flags & 2 > 0)


def _united(bucket: pa.Table) -> pa.Table:
    return _level(*_opened(bucket))


def suffix_dedup(documents: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """RESULT for each row of documents (doc_id, text; other columns are not looked at): an index of one batch, at path (default: a new folder in the shared one).

    removed: the maximal removed runs of bytes, end exclusive. Null text counts as empty, a null id as any other; each of
    several equal rows has the others as copies. Texts of any length are compared whole. No documents: no rows.
    """
    spark, total = documents.sparkSession, text_bytes(documents, "text")
    index = SuffixIndex(spark, path or f"{shared_folder(spark).rstrip('/')}/suffixes-{uuid4().hex}", length, buckets_for(spark, total))
    dealt = index.dealt(documents, 0, total)
    index.add(dealt, kept=False)
    return index.matches(documents=dealt)


def _result(c: _Chunk, gone: np.ndarray) -> pa.Table:
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "removed": []}
    total = np.concatenate([[0], np.cumsum(gone)])
    for i in range(c.texts.n):
        lo, hi = c.texts.at[i], c.texts.at[i + 1]
        text, found = c.texts.buf[lo:hi], []
        if total[hi] > total[lo]:
            g = gone[lo:hi]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            found = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
            text = text[~g]
        for k, v in zip(out, (hi - lo, total[hi] - total[lo], len(found), hashlib.sha256(text.tobytes()).hexdigest(), found), strict=True):
            out[k].append(v if isinstance(v, str | list) else int(v))
    return pa.table({"doc_id": pa.array(c.ids, pa.int64())} | {k: pa.array(v, kind) for (k, v), kind in zip(out.items(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), strict=True)})


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT r, s, md5(substr(h, 2 * s + 1, 800)) AS k FROM d, unnest(generate_series(0, n - 400)) t(s) WHERE n >= 400),
c AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
i AS (SELECT r, s, CASE WHEN s <= lag(s) OVER (PARTITION BY r ORDER BY s) + 400 THEN 0 ELSE 1 END AS new FROM s WHERE k IN (SELECT k FROM c)),
j AS (SELECT r, s, sum(new) OVER (PARTITION BY r ORDER BY s) AS g FROM i),
x AS (SELECT r, min(s) AS a, max(s) + 400 AS b FROM j GROUP BY r, g),
p AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM x UNION ALL SELECT d.r, coalesce(max(b), 0), n FROM d LEFT JOIN x ON d.r = x.r GROUP BY d.r, n),
k AS (SELECT p.r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM p JOIN d ON d.r = p.r GROUP BY p.r),
m AS (SELECT r, sum(b - a) AS removed, count(*) AS spans FROM x GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k ON d.r = k.r LEFT JOIN m ON d.r = m.r
"""
