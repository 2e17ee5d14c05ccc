"""Links between texts whose sets of word shingles are alike, for the pipeline's near-duplicate stage.

SimHash fingerprints within a small radius miss texts that share 80 % of their shingles (README has figures), and at the
radius that would find them the triangle bounds of a vantage-point tree prune nothing. So their candidates come from
min-wise hashing: BANDS keys of ROWS minima each. A text with a key is compared, exactly, with the key's hub, its first
text and the NEXT ones before it, in an order of its own for each key. The hub is the text that meets the most others by
all its keys: of a text and many edited copies of it, which are less like one another than like it, the text itself. So a
key costs a few pairs for each of its texts, not one for each two; a key of up to NEXT + 1 texts has all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .rolling import U64, Texts, mix, slices, spans, windows
from .shared import broadcast_if_few, checkpointed, in_arrow, release_memory

WORDS, SIMILARITY = 5, 0.8
#: Two texts of similarity s share a key with chance 1 - (1 - s^ROWS)^BANDS: 0.998 at 0.8.
BANDS, ROWS = 12, 4
#: Texts before a text in its key's order that it is compared with; texts of a key that are put in order together, about.
NEXT, TOGETHER = 3, 1000
#: Shingles of a block, about; what a text counts as at least; shingles in a piece of a matrix, pairs counted at a time.
BLOCK, LEAST, WIDE, COUNTED = 1 << 18, 256, 1024, 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.Generator(np.random.PCG64(0xBA5E)).integers(1, 2**62, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each text's shingles (A to Z lowered; of fewer words the whole sequence; of none none), and where each text's begin (one more than texts)."""
    t = Texts(column)
    buf = _LOWER[t.buf]
    start, end, first = t.words()
    count = np.diff(first)
    hashes = spans(buf, start, end, 0)
    out = []
    inside = windows(hashes, words, 0)
    for i in range(t.n):
        if count[i] >= words:
            out.append(inside[first[i] : first[i + 1] - words + 1])
        elif count[i]:
            out.append(windows(hashes[first[i] : first[i + 1]], int(count[i]), 0))
        else:
            out.append(hashes[:0])
    return np.concatenate(out) if out else hashes[:0], np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def band_keys(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS keys of each text that has a shingle: rows for texts, in order."""
    begin = at[:-1][np.diff(at) > 0]
    keys = np.empty((len(begin), BANDS), U64)
    for b in range(BANDS):
        key = np.full(len(begin), b + 1, U64)
        for r in range(ROWS):
            key = mix(key ^ np.minimum.reduceat(fp * _FACTORS[b * ROWS + r], begin)) if len(begin) else key
        keys[:, b] = key
    return keys


def with_keys(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """text_hash and key of each band of each row's text. documents: text_hash, text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in slices(batch, 1)):
            fp, at = shingle_sets(b.column(1), words)
            keys = band_keys(fp, at)
            rows = pa.array(np.flatnonzero(np.diff(at) > 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel().view(np.int64)), BANDS).cast(pa.list_(pa.int64()))], ["text_hash", "keys"])

    return documents.select("text_hash", "text").transform(in_arrow, work, "text_hash long, keys array<long>")


def _within(x: np.ndarray, begin: np.ndarray, times: np.ndarray) -> np.ndarray:
    """x[b], x[b + 1], ... of as many as times says, for each b of begin."""
    ends = np.cumsum(times)
    return x[np.repeat(begin - ends + times, times) + np.arange(ends[-1] if len(ends) else 0)]


def common_counts(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray) -> np.ndarray:
    """Shingles that each of some sets (a[at_a[i] : at_a[i + 1]], without repeats) shares with each of others: frequent ones by products of matrices, rare ones by their pairs."""
    n, m = len(at_a) - 1, len(at_b) - 1
    out = np.zeros((n, m), np.float32)
    keys = np.intersect1d(a, b)
    sides = []
    for x, at in ((a, at_a), (b, at_b)):
        where = np.searchsorted(keys, x)
        have = np.flatnonzero(keys[np.minimum(where, len(keys) - 1)] == x) if len(keys) else where[:0]
        have = have[np.argsort(where[have], kind="stable")]
        sides.append((where[have], (np.searchsorted(at, have, side="right") - 1).astype(np.int64)))
    (ka, oa), (kb, ob) = sides
    da, db = np.bincount(ka, minlength=len(keys)), np.bincount(kb, minlength=len(keys))
    frequent = da * db > max(n * m // 256, 1)
    number = np.cumsum(frequent) - 1
    for lo in range(0, int(frequent.sum()), WIDE):
        x, y = np.zeros((n, WIDE), np.float32), np.zeros((m, WIDE), np.float32)
        for matrix, k, o in ((x, ka, oa), (y, kb, ob)):
            here = frequent[k] & (number[k] >= lo) & (number[k] < lo + WIDE)
            matrix[o[here], number[k[here]] - lo] = 1
        out += x @ y.T
    rare = np.flatnonzero(~frequent[ka])
    begin, times = (np.cumsum(db) - db)[ka[rare]], db[ka[rare]]
    total = np.cumsum(times)
    at = 0
    while at < len(rare):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + COUNTED, side="right")))
        cells, counts = np.unique(np.repeat(oa[rare[at:end]], times[at:end]) * m + _within(ob, begin[at:end], times[at:end]), return_counts=True)
        out.ravel()[cells] += counts
        at = end
    return out


def connecting(a: tuple[np.ndarray, np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs (of a, of b) of similarity or more that connect all that such pairs connect. a and b: shingles without repeats, where each set's begin (one more than sets), the label of what each set is connected with."""
    common = common_counts(a[0], a[1], b[0], b[1])
    size_a, size_b = np.diff(a[1]), np.diff(b[1])
    label = np.unique(np.concatenate([a[2], b[2]]), return_inverse=True)[1]
    parent = np.arange(label.max() + 1 if len(label) else 0)
    la, lb = label[: len(a[2])], label[len(a[2]) :]
    out = []
    for i in np.flatnonzero(common.any(axis=1)) if common.size else ():
        shared = common[i].astype(np.float64)
        hits = np.flatnonzero((shared > 0) & (shared >= similarity * (size_a[i] + size_b - shared)))
        hits = hits[parent[lb[hits]] != parent[la[i]]]
        if len(hits):
            labels, first = np.unique(parent[lb[hits]], return_index=True)
            out += [(int(i), int(j)) for j in hits[first]]
            parent[np.isin(parent, labels)] = parent[la[i]]
    return out


def _left(shared: DataFrame, links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between texts of a key of shared (key, text_hash, n) that links do not connect, so that all such texts of similarity or more are connected. sets: text_hash, shingles."""
    spark = shared.sparkSession
    roots = components(links)
    weight = F.greatest(F.size("shingles"), F.lit(LEAST)).cast("long")
    large = shared.where(F.col("n") > NEXT + 2).select("key", "text_hash")
    texts = large.join(roots, F.col("text_hash") == F.col("node"), "left").select("key", "text_hash", F.coalesce("root", "text_hash").alias("label"))
    several = texts.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    texts = checkpointed(texts.join(several, "key", "left_semi").join(sets.select("text_hash", weight.alias("w")), "text_hash"))
    # keys of less than a block go together; of others, what is connected and large has blocks of its own
    labels = checkpointed(texts.groupBy("key", "label").agg(F.sum("w").alias("w")))
    keys = labels.groupBy("key").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("w") <= BLOCK // 2, F.col("w")).otherwise(0)).alias("rest"))
    keys = checkpointed(keys)
    few = keys.where(F.col("total") <= BLOCK).agg(F.sum("total")).first()[0] or 0
    one, own = F.col("total") <= BLOCK, F.col("w") > BLOCK // 2
    pieces = lambda total: (F.floor(F.col(total) / BLOCK) + 1).cast("long")
    placed = labels.join(keys, "key").select(
        "key", "label",
        F.when(one, F.pmod(F.xxhash64("key"), F.lit(few // (BLOCK // 2) + 1))).otherwise(F.col("key")).alias("part"),
        F.when(~one & own, F.col("label")).alias("own"),
        F.when(one, F.lit(1)).when(own, pieces("w")).otherwise(pieces("rest")).alias("pieces"),
    )
    dealt = F.when(F.col("own").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("text_hash"))
    placed = texts.select("key", "label", "text_hash").join(placed, ["key", "label"]).select("part", "own", F.pmod(dealt, "pieces").alias("piece"), "text_hash", "label")
    placed = checkpointed(placed.withColumn("block", F.xxhash64("own", "piece")).select("part", "own", "block", "text_hash", "label").distinct())
    blocks = checkpointed(placed.select("part", "own", "block").distinct())
    other = blocks.select("part", F.col("own").alias("own_b"), F.col("block").alias("b"))
    tasks = blocks.withColumnRenamed("block", "a").join(other, "part").where("a <= b AND (own IS NULL OR own_b IS NULL OR own <> own_b)")
    # each block is told the tasks it is in
    both = F.array(F.struct(F.col("a").alias("block"), F.lit(False).alias("second")), F.struct(F.col("b").alias("block"), F.lit(True).alias("second")))
    tasks = tasks.select("part", "a", "b", F.explode(both).alias("x")).select("part", "a", "b", "x.block", "x.second").where("a <> b OR NOT second")
    tasks = checkpointed(tasks)
    members = placed.select("part", "block", "text_hash", "label").join(tasks, ["part", "block"]).join(sets, "text_hash")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        second = t.column("second").to_numpy(zero_copy_only=False)

        def side(rows: np.ndarray) -> tuple[np.ndarray, tuple]:
            x = t.take(pa.array(np.flatnonzero(rows)))
            lists = x.column("shingles").combine_chunks()
            at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            return x.column("text_hash").to_numpy(), (lists.flatten().to_numpy(zero_copy_only=False), at, x.column("label").to_numpy())

        name_a, a = side(~second)
        name_b, b = side(second) if second.any() else (name_a, a)
        found = connecting(a, b, similarity)
        del t, a, b
        release_memory()
        u, v = (np.array([name[p[k]] for p in found], np.int64) for k, name in enumerate((name_a, name_b)))
        return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})

    found = members.select("part", "a", "b", "second", "text_hash", "label", "shingles").groupBy("part", "a", "b").applyInArrow(compare, "u long, v long")
    return found.distinct() if blocks.limit(1).count() else spark.createDataFrame([], "u long, v long")


def alike(documents: DataFrame, similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """Links (u, v: text hashes) between texts of similarity or more that connect all such texts with a min-wise key in common. documents: row_hash, text_hash, text."""
    keyed = checkpointed(with_keys(documents, words).select("text_hash", F.explode("keys").alias("key")).distinct())
    # each key has its own order, so that the pairs of texts with several common keys differ
    keyed = keyed.withColumn("order", F.xxhash64("key", "text_hash"))
    least = keyed.groupBy("key").agg(F.min_by("text_hash", "order").alias("least"), F.count("*").alias("n")).where("n > 1")
    shared = checkpointed(keyed.join(least, "key"))
    met = shared.groupBy("text_hash").agg(F.sum(F.col("n") - 1).alias("met"))
    hubs = checkpointed(shared.select("key", "text_hash", "order").join(met, "text_hash").groupBy("key").agg(F.max_by("text_hash", F.struct("met", "order")).alias("hub")))
    # the hubs are computed, so that Spark can split a frequent key's rows in the join; and the window has a shuffle of its own, or else it would find its parts where the join on the key alone has put them, in one task
    grouped = shared.join(hubs, "key").withColumn("part", F.pmod("order", F.floor(F.col("n") / TOGETHER) + 1)).repartition("key", "part")
    w = Window.partitionBy("key", "part").orderBy("order")
    partners = F.array("hub", "least", *(F.lag("text_hash", i).over(w) for i in range(1, NEXT + 1)))
    pairs = grouped.select(partners.alias("partners"), F.col("text_hash").alias("b")).select(F.explode("partners").alias("a"), "b").where("a <> b")
    pairs = checkpointed(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("text_hash")).distinct()
    # one row of each wanted text; equal rows are merged below
    rows = documents.select("row_hash", "text_hash").join(wanted, "text_hash", "left_semi").groupBy("text_hash").agg(F.min("row_hash").alias("_row"))
    rows = broadcast_if_few(checkpointed(rows.select("_row")))
    chosen = documents.join(rows, F.col("row_hash") == F.col("_row"), "left_semi").select("text_hash", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in slices(batch, 1)):
            fp, at = shingle_sets(b.column(1), words)
            sets = [np.unique(fp[i:j]).view(np.int64) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["text_hash", "shingles"])

    sets = chosen.transform(in_arrow, work, "text_hash long, shingles array<long>").dropDuplicates(["text_hash"])
    sets = checkpointed(sets)
    a, b = (sets.select(F.col("text_hash").alias(k), F.col("shingles").alias(f"_{k}")) for k in "uv")
    common = F.size(F.array_intersect("_u", "_v"))
    links = checkpointed(pairs.join(a, "u").join(b, "v").where(common >= similarity * (F.size("_u") + F.size("_v") - common)).select("u", "v"))
    return links.union(_left(shared, links, sets, similarity))
