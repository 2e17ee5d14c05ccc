"""Substring deduplication by fixed-block anchors (operator 1).

Blocks of ANCHOR words that start at every multiple of ANCHOR are the index; every rolling window of ANCHOR words probes
it. Any run of 2 * ANCHOR words contains a whole block, so two documents that share a window of WINDOW words meet at a
block of either. A hit is extended word by word: the windows of WINDOW words that contain it are looked up, and those
that also start in a document with a smaller id join into maximal exact repeats, whose words go.

Both look-ups go through rendezvous: one entry for each chunk and distinct window, so that a passage in a third of all
documents makes no pairs and no hot bucket.

Windows are equal if 8 or more bits of bucket, 32 bits of one fingerprint and 64 of another are equal (104 bits or more).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rendezvous import answered, answers, asked, carried, entries, plan, two_rounds
from .rolling import U64, Texts, spans, windows

WINDOW = 50
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>"


class _Chunk:
    """The words of a chunk's documents, in the order of (id, text), and their windows."""

    def __init__(self, table: pa.Table, window: int):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.window, self.anchor = window, window // 2
        ids = table.column("doc_id")
        self.ids = ids.to_pylist()
        self.known = np.array([x is not None for x in self.ids], bool)
        self.number = np.array([x if x is not None else 0 for x in self.ids], np.int64)
        self.texts = Texts(table.column("text"))
        self.start, self.end, self.first = self.texts.words()
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.texts.n), self.count)
        self.hashes = [spans(self.texts.buf, self.start, self.end, k) for k in (0, 1)]

    def inside(self, m: int) -> np.ndarray:
        """Whether the m words from each word on lie in one document that has an id and a whole window."""
        n = len(self.doc) - m + 1
        if n <= 0:
            return np.zeros(0, bool)
        return (self.doc[:n] == self.doc[m - 1 :]) & (self.known & (self.count >= self.window))[self.doc[:n]]

    def anchors(self, buckets: int):
        """Positions of the rolling windows, and their order, distinct ones and bucket bounds."""
        at = np.flatnonzero(self.inside(self.anchor))
        fp = windows(self.hashes[0], self.anchor, 0)[at] if len(at) else np.zeros(0, U64)
        return (at, fp, *entries(fp, None, buckets))

    def long(self, at: np.ndarray, buckets: int):
        """The same of the windows of full length that start at at."""
        a, b = ((windows(self.hashes[k], self.window, k)[at] if len(at) else np.zeros(0, U64)) for k in (0, 1))
        return (a, b, *entries(a, b, buckets))

    def candidates(self, hit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts of the windows of full length that contain a hit."""
        total = np.zeros(len(self.doc) + 1, np.int64)
        total[at[hit] + 1] = 1
        np.cumsum(total, out=total)
        whole = np.flatnonzero(self.inside(self.window))
        return whole[total[np.minimum(whole + self.window - self.anchor + 1, len(self.doc))] > total[whole]]


def _low(fp: np.ndarray, buckets: int) -> np.ndarray:
    return (fp >> U64(64 - (buckets - 1).bit_length() - 32)).astype(np.uint32)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, where each group begins in it, and the group of each place in it."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


LONG = np.dtype([("second", "<u8"), ("low", "<u4")])


def substring_dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """RESULT for each row of documents (doc_id, text; other columns are not looked at).

    removed: the maximal removed runs, as word positions, end exclusive. Null text and empty text: no words, and the hash
    of the empty string. A document with a null id is returned whole: it is neither smaller than another nor larger.
    Rows with the same id do not remove one another. No documents: no rows.
    """
    p = plan(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["doc_id", "text"])
    buckets = p.buckets

    def ask(table: pa.Table) -> pa.Table:
        c = _Chunk(table, window)
        at, fp, order, begin, bounds = c.anchors(buckets)
        if not len(at):
            return asked(table.column("chunk")[0].as_py(), np.zeros(0, np.uint32), np.zeros(0, np.uint8), None, bounds)
        block = ((at - c.first[c.doc[at]]) % c.anchor == 0)[order]
        number = c.number[c.doc[at]][order]
        several = np.minimum.reduceat(number, begin) != np.maximum.reduceat(number, begin)
        flags = np.stack([np.bitwise_or.reduceat(block, begin), several], 1)
        return asked(table.column("chunk")[0].as_py(), _low(fp[order[begin]], buckets), np.packbits(flags, axis=1)[:, 0], None, bounds)

    def settle(bucket: pa.Table) -> pa.Table:
        def decide(keys, more, _flags, _row):
            order, begin, group = _groups(keys)
            block, several = (more[order] & 128) > 0, (more[order] & 64) > 0
            size = np.diff(np.append(begin, len(order)))
            hit = np.bitwise_or.reduceat(block, begin) & ((size > 1) | np.bitwise_or.reduceat(several, begin))
            out = np.zeros(len(keys), bool)
            out[order] = hit[group]
            return out

        return answered(bucket, np.uint32, np.uint8, decide)

    def ask_again(table: pa.Table, replies: pa.Table) -> pa.Table:
        c = _Chunk(table, window)
        at, _, order, begin, bounds = c.anchors(buckets)
        yes = answers(replies, bounds)
        hit = _spread(yes, order, begin)
        a, b, order, begin, bounds = c.long(starts := c.candidates(hit, at), buckets)
        first = order[begin]
        keys = np.empty(len(first), LONG)
        keys["second"], keys["low"] = b[first], _low(a[first], buckets)
        least = np.minimum.reduceat(c.number[c.doc[starts]][order], begin) if len(first) else np.zeros(0, np.int64)
        return asked(table.column("chunk")[0].as_py(), keys, least, None, bounds, yes)

    def settle_again(bucket: pa.Table) -> pa.Table:
        def decide(keys, least, _flags, _row):
            order, begin, group = _groups(keys["second"], keys["low"])
            out = np.zeros(len(keys), bool)
            out[order] = np.minimum.reduceat(least[order], begin)[group] < least[order]
            return out

        return answered(bucket, LONG, np.int64, decide)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        c = _Chunk(table, window)
        at, _, order, begin, bounds = c.anchors(buckets)
        hit = _spread(carried(replies, bounds[-1]), order, begin)
        _, _, order, begin, bounds = c.long(starts := c.candidates(hit, at), buckets)
        change = np.zeros(len(c.doc) + 1, np.int64)
        if len(starts):
            number = c.number[c.doc[starts]][order]
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
            gone = starts[order[answers(replies, bounds)[group] | (number > np.minimum.reduceat(number, begin)[group])]]
            np.add.at(change, gone, 1)
            np.add.at(change, gone + window, -1)
        return _result(c, np.cumsum(change[:-1]) > 0)

    return two_rounds(p, ask, settle, ask_again, settle_again, finish, RESULT)


def _spread(yes: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Bits of distinct entries, for every position."""
    out = np.zeros(len(order), bool)
    out[order] = np.repeat(yes, np.diff(np.append(begin, len(order))))
    return out


def _result(c: _Chunk, gone: np.ndarray) -> pa.Table:
    kept, runs = [], []
    removed = np.add.reduceat(np.append(gone, False).astype(np.int64), c.first[:-1]) if c.texts.n else np.zeros(0, np.int64)
    removed[c.count == 0] = 0
    for i in range(c.texts.n):
        words, found = c.texts.text(i).split(), []
        if removed[i]:
            g = gone[c.first[i] : c.first[i + 1]]
            words = compress(words, (~g).tolist())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            found = [{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)]
        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
        runs.append(found)
    return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "n_words": pa.array(c.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string()), "removed": pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, s, md5(array_to_string(ws[s : s + 49], ' ')) AS h FROM w, unnest(generate_series(1, len(ws) - 49)) t(s) WHERE len(ws) >= 50),
m AS (SELECT h, min(doc_id) AS least FROM k GROUP BY h),
gone AS (SELECT DISTINCT k.doc_id, s + i AS pos FROM k JOIN m ON k.h = m.h, unnest(generate_series(0, 49)) t(i) WHERE least < k.doc_id),
words AS (SELECT doc_id, pos, ws[pos] AS word FROM w, unnest(generate_series(1, len(ws))) t(pos)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM words x
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.pos = x.pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
