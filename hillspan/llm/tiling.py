"""Benchmark decontamination by greedy string tiling (operator 4).

Seeds are runs of SEED tokens. A filter of a fixed size over the benchmark's seeds goes to all tasks and leaves few
documents; the seeds that pass are joined with the benchmark's. A pair of document and item can reach COVERAGE only with
a share of the item's seeds. So a document of such a pair has one of the seeds that are left when as many of the item's
most frequent ones as that share are put aside: the join is on these alone, and a phrase that a third of all documents
share joins nothing but items that consist of it. The pairs it finds are counted in full, and those below the share end
there. The others are tiled by running Karp-Rabin: the longest
matches that touch no token marked before are marked, then shorter ones, down to SEED tokens. A document is contaminated
if the tiles of an item, in any order, cover COVERAGE of its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rolling import U64, Texts, slices, spans, windows
from .shared import checkpointed, in_arrow, unused

#: Tokens of a seed and of the shortest tile; share of an item's tokens that its tiles must cover.
SEED, COVERAGE = 5, 0.6
#: Bits of the filter, as a power of two: 8 MB for any benchmark. A larger one fills it and lets more documents through.
FILTER_BITS = 26
RESULT = "doc_id long, item_id long, coverage double, n_tiles long, document_tokens long, row_hash long"

_BREAKS = re.compile(r"[\W_]+")


def tokens_of(text: str | None) -> str:
    """Lower-cased runs of letters and digits, joined by single spaces."""
    return _BREAKS.sub(" ", (text or "").lower()).strip()


def _seeds(column: pa.Array, seed: int) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Token texts, and the fingerprint, text and token position of each seed."""
    texts = [tokens_of(x) for x in column.to_pylist()]
    t = Texts(pa.array(texts, pa.string()))
    start, end, first = t.words()
    doc = np.repeat(np.arange(t.n), np.diff(first))
    if len(doc) < seed:
        return texts, np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = doc[: len(doc) - seed + 1] == doc[seed - 1 :]
    at = np.flatnonzero(inside)
    return texts, windows(spans(t.buf, start, end, 0), seed, 0)[at], doc[at], at - first[doc[at]]


def _places(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that stand for each fingerprint."""
    return (fp >> U64(64 - FILTER_BITS)).astype(np.int64), (fp & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _filter(benchmark: DataFrame, seed: int) -> np.ndarray:
    """The benchmark's filter, as bytes of bits: tasks make filters, then few tasks and at last one unite them."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            for at in _places(_seeds(b.column(0), seed)[1]):
                bits[at] = True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([_squeezed(np.packbits(bits))], pa.binary())], ["g", "bits"])

    def unite(t: pa.Table) -> pa.Table:
        out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for x in t.column("bits"):
            out |= _opened(x.as_py())
        return pa.table({"g": pa.array([0], pa.int32()), "bits": pa.array([_squeezed(out)], pa.binary())})

    made = benchmark.select(F.col("text").cast("string")).transform(in_arrow, make, "g int, bits binary")
    rows = made.groupBy("g").applyInArrow(unite, "g int, bits binary").groupBy("g").applyInArrow(unite, "g int, bits binary").collect()
    return _opened(bytes(rows[0].bits)) if rows else np.zeros((1 << FILTER_BITS) // 8, np.uint8)


def _squeezed(bits: np.ndarray) -> bytes:
    return pa.compress(bits.tobytes(), codec="zstd", asbytes=True)


def _opened(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=(1 << FILTER_BITS) // 8, codec="zstd", asbytes=True), np.uint8)


class _Side:
    """The tokens of one text that may be in a tile, as numbers; a negative number stands between runs of them. at: their places in the text, free: not marked yet."""

    def __init__(self, ids: np.ndarray, kept: np.ndarray, gap: int):
        at = np.flatnonzero(kept)
        gaps = np.flatnonzero(np.diff(at) > 1) + 1
        self.at, self.ids = np.insert(at, gaps, -1), np.insert(ids[at], gaps, gap)
        self.values, self.free = self.ids.astype(np.int64).view(U64), self.at >= 0

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of all runs of n unmarked tokens."""
        taken = np.concatenate([[0], np.cumsum(~self.free)])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return windows(self.values, n, 0)[at], at

    def mark(self, i: int, n: int) -> None:
        self.free[i : i + n] = False


def tile(item: list[str], document: list[str], shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in document, length) of greedy string tiling; of equal lengths the first in the item, then in the document.

    A length at which the texts have unmarked tokens in common is looked for by halving, with running hashes; all its tiles are
    marked in one pass, in which a window's next free place only moves on. So work is in proportion to the tokens for each
    length that has a tile, whatever repeats, and no pairs of places are held.
    """
    vocabulary: dict[str, int] = {}
    both = [np.array([vocabulary.setdefault(x, len(vocabulary)) for x in words], np.int64) for words in (item, document)]
    if min(map(len, both)) < shortest:
        return []
    hashes = [windows(x.view(U64), shortest, 0) for x in both]
    sides = []
    for x, own, other, gap in zip(both, hashes, hashes[::-1], (-1, -2), strict=True):
        edge = np.zeros(len(x) + 1, np.int64)
        hit = np.isin(own, other)
        edge[:-shortest] += hit
        edge[shortest:] -= hit
        sides.append(_Side(x, np.cumsum(edge)[:-1] > 0, gap))
    a, b = sides
    tiles: list[tuple[int, int, int]] = []
    most = min(len(a.ids), len(b.ids))
    while most >= shortest:
        length, most = _longest(a, b, shortest, most), 0
        if length:
            tiles += [(int(a.at[i]), int(b.at[j]), length) for i, j in _marked(a, b, length)]
            most = length - 1
    return tiles


def _longest(a: _Side, b: _Side, shortest: int, most: int) -> int:
    """The most tokens that both sides have unmarked in a row, up to most; 0 if fewer than shortest."""
    low, high = shortest - 1, most  # a run of low is known, one of more than high is not there
    step = shortest
    while low < high:
        if np.isin(a.windows(step)[0], b.windows(step)[0]).any():
            low = step
        else:
            high = step - 1
        step = (low + high + 1) // 2
    return low if low >= shortest else 0


def _marked(a: _Side, b: _Side, n: int) -> Iterator[tuple[int, int]]:
    """Marks matches of n unmarked tokens, the first in a with the first in b, until none is left."""
    (ha, at_a), (hb, at_b) = a.windows(n), b.windows(n)
    order = np.argsort(hb, kind="stable")
    sorted_b = hb[order]
    begin, end = np.searchsorted(sorted_b, ha), np.searchsorted(sorted_b, ha, side="right")
    places = at_b[order]
    following: dict[int, int] = {}  # where a hash's next place may be
    until = 0
    for i, lo, hi in zip(at_a.tolist(), begin.tolist(), end.tolist(), strict=True):
        if i < until or lo == hi:
            continue
        k = following.get(lo, lo)
        while k < hi:
            j = int(places[k])
            # a window is free if its ends are: tiles of this pass are as long, longer ones were before
            if b.free[j] and b.free[j + n - 1]:
                break
            k += 1
        following[lo] = k
        if k < hi and (a.ids[i : i + n] == b.ids[j : j + n]).all():
            a.mark(i, n)
            b.mark(j, n)
            until = i + n
            yield i, j


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """RESULT for each pair of a row of documents (doc_id, text) and an item of benchmark (item_id, text) whose tiles cover coverage of the item.

    row_hash is xxhash64(doc_id, text) of the row. Items of fewer tokens than a seed, null and empty ones match nothing; rows
    of equal ids are rows apart, and items of equal ids and texts count once. Texts of any length are tiled whole. Empty
    tables and tables of nulls: no rows.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item")).distinct()
    items = checkpointed(items.withColumn("item_key", F.xxhash64("item_id", "item")))
    bits = documents.sparkSession.sparkContext.broadcast(_filter(benchmark, seed))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve, row = bits.value, TaskContext.get().partitionId() << 33
        for b in (piece for batch in batches for piece in slices(batch, 1)):
            texts, fp, doc, _ = _seeds(b.column(1), seed)
            passed = np.arange(len(fp))
            for place in _places(fp):
                at = place[passed]
                passed = passed[(sieve[at >> 3] >> (7 - (at & 7)) & 1) > 0]
            at, begin = np.unique(doc[passed], return_index=True)
            seeds = [np.unique(x).view(np.int64) for x in np.split(fp[passed], begin[1:])] if len(at) else []
            index = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(row + at), b.column(0).take(index), b.column(2).take(index), pa.array([texts[i] for i in at.tolist()], pa.string()), pa.array(seeds, pa.list_(pa.int64()))], ["row", "doc_id", "row_hash", "tokens", "seeds"])
            row += b.num_rows

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, fp, doc, place = _seeds(b.column(1), seed)
            size = np.array([len(x.split()) for x in texts], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(fp.view(np.int64)), pa.array(place), pa.array(size[doc])], ["item_key", "seed", "place", "size"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("row_hash"))
    kept = checkpointed(docs.transform(in_arrow, keep, "row long, doc_id long, row_hash long, tokens string, seeds array<long>"))
    index = checkpointed(items.select("item_key", "item").transform(in_arrow, item_seeds, "item_key long, seed long, place long, size long"))
    found = kept.select("row", F.explode("seeds").alias("seed"))
    often = found.groupBy("seed").agg(F.count("*").alias("often"))
    # of n places of an item, need or more are a document's: one is among the n - need + 1 rarest
    need = F.greatest(F.ceil(F.col("size") * coverage / seed), F.lit(1))
    ranked = index.join(often, "seed", "left").withColumn("rank", F.row_number().over(Window.partitionBy("item_key").orderBy(F.coalesce("often", F.lit(0)), "seed", "place")))
    rare = ranked.where(F.col("often").isNotNull() & (F.col("rank") <= F.col("size") - seed + 1 - need + 1)).select("seed", "item_key").distinct()
    pairs = checkpointed(found.join(rare, "seed").select("row", "item_key").distinct())
    places = index.groupBy("item_key", "seed").agg(F.count("*").alias("places"), F.first("size").alias("size"))
    shared = pairs.join(found, "row").join(places, ["item_key", "seed"]).groupBy("row", "item_key").agg(F.sum("places").alias("n"), F.first("size").alias("size"))
    pairs = checkpointed(shared.where(F.col("n") * seed >= F.col("size") * coverage).select("row", "item_key"))
    joined = pairs.join(kept.drop("seeds"), "row").join(items, "item_key").select("doc_id", "item_id", "row_hash", "tokens", "item")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for tokens, item in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                words, document = tokens_of(item).split(), tokens.split()
                tiles = tile(words, document, seed)
                out.append((sum(n for *_, n in tiles) / len(words), len(tiles), len(document)))
            share, n, size = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(share, pa.float64()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), b.column(2)], [x.split()[0] for x in RESULT.split(", ")])

    return joined.transform(in_arrow, tiled, RESULT).where(F.col("coverage") >= coverage)


def decontaminate(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """documents without the contaminated rows, all columns as they were."""
    name = unused(documents, "_hit")
    hit = checkpointed(contaminated(documents, benchmark, coverage).select("row_hash").distinct()).withColumnRenamed("row_hash", name)
    return documents.join(hit, F.xxhash64(documents.doc_id.cast("long"), documents.text.cast("string")) == hit[name], "left_anti")
