"""Set similarity join on word shingles, by prefixes of single shingles and of combinations of frequent ones.

All shingles have one order: by powers of two of their frequency, rare first, then by hash. Of a set of n that shares m or more with any
partner, the first n - m + 1 in this order, the prefix, hold a shared one, so these are its keys. A frequent shingle alone
would be a key of many sets: shingles of class k are keys only k at a time, among those of one group (a hash of the
shingle). Of the c shingles of a group in the prefix, k - 1 may be shared without a key in common, so they count as
c - k + 1 of the n - m + 1, and the prefix extends until the count is reached.

Why two sets have a key in common: take the one whose prefix ends first in the order. What it shares in its prefix is in
the other's, too, and is more than k - 1 of each group together, so it is a rare shingle or k of one group.

Frequencies come from one look-up: chunks of documents ask buckets of shingles (rendezvous). Pairs that share a key are
compared exactly; sets that repeat are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .rendezvous import ANSWERED, ASKED, ENTRY, LEAST, MOST, answered, answers, asked, buckets_for, entries, text_bytes
from .rolling import U64, mix, slices
from .shared import broadcast_if_few, checkpointed, in_arrow, release_memory
from .shingles import NEXT, shingle_sets
from .shingles import _left as left_links

WORDS, PERCENT = 3, 90
#: Rarity is a power of two: 0 of shingles that one set has, r of those that up to 2^r have, at most MOST_RARITY. Counts of a chunk end at 255: this decides the order, not a pair.
MOST_RARITY, BITS = 15, 4
#: Rarities from which shingles are of class 2 and of class 3.
FREQUENT = (6, 11)
#: A group of a class for each so many shingles of a set.
GROUPED = 12
_KINDS = np.random.Generator(np.random.PCG64(0x96A7)).integers(1, 2**62, 8, dtype=np.uint64) * U64(2) + U64(1)
SIGNED = "doc_id long, row_hash long, set_id long, n_shingles long, keys array<long>"


def set_ids(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64 bits of each set without repeats (fp[at[i]:at[i + 1]])."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(fp ^ _KINDS[0]))])
    return mix(total[at[1:]] - total[at[:-1]] + mix(np.diff(at).astype(U64) + _KINDS[1])).view(np.int64)


def distinct_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles and where they begin (one more than texts)."""
    fp, at = shingle_sets(column, words)
    sets = [np.unique(fp[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return (np.concatenate(sets) if sets else fp), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _places(groups: np.ndarray) -> np.ndarray:
    """How many of the same group come before each."""
    order = np.argsort(groups, kind="stable")
    ordered = groups[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(groups) else order
    out = np.empty(len(groups), np.int64)
    out[order] = np.arange(len(groups)) - np.repeat(begin, np.diff(np.append(begin, len(groups))))
    return out


def _combined(fp: np.ndarray, groups: np.ndarray, k: int) -> np.ndarray:
    """Sums of all k of fp that are of one group, k of 2 or 3."""
    order = np.argsort(groups, kind="stable")
    fp, groups = mix(fp[order] ^ _KINDS[2]), groups[order]
    out, apart = [fp[:0]], 1
    while apart < len(fp) and (same := groups[apart:] == groups[:-apart]).any():
        pairs = fp[apart:] + fp[:-apart]
        if k == 2:
            out.append(pairs[same])
        else:
            more = apart + 1
            while more < len(fp) and (both := groups[more:] == groups[:-more]).any():
                out.append((pairs[: len(fp) - more] + fp[more:])[both])
                more += 1
        apart += 1
    return np.concatenate(out)


def signature(fp: np.ndarray, rarity: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of a set (fp, without repeats; rarity 0 to MOST_RARITY): any two sets of which 100 * shared >= percent * all have one in common, if they differ. Shingles of rarity 0 count and are no keys."""
    n = len(fp)
    partner = -(-percent * n // 100)  # shingles that a partner shares at least
    if n - partner == 0 and 100 * n < percent * (n + 1):
        return fp[:0]  # only an equal set is that similar
    need = n - partner + 1
    alone = rarity == 0
    if int(alone.sum()) >= need:
        return fp[:0]
    hashed = mix(fp ^ _KINDS[3])
    order = np.lexsort((hashed, rarity))
    fp, hashed, rarity = fp[order], hashed[order], rarity[order]
    classes = 1 + sum((rarity >= r).astype(np.int64) for r in FREQUENT)
    own = lambda x, r: mix(x[r > 0] ^ _KINDS[4])
    if classes[need - 1] == 1:
        return own(fp[:need], rarity[:need])
    # sets of one band have as many groups; a set that may have partners in the band below has keys for that one, too
    band = n.bit_length() - 1
    out = []
    for b in {band, min(band, max(int(partner).bit_length() - 1, 0))}:
        least = -(-percent * (1 << b) // 100)
        count = min(max((1 << b) // GROUPED, 1), (least - 1) // 3)  # so that no set is too small for the count
        kinds = classes if count > 0 else np.ones(n, np.int64)
        groups = np.where(kinds == 1, -1 - np.arange(n), kinds * count + (hashed % U64(max(count, 1))).astype(np.int64))
        counted = np.cumsum((kinds == 1) | (_places(groups) >= kinds - 1))
        end = int(np.searchsorted(counted, need)) + 1
        head, groups, kinds = fp[:end], groups[:end], kinds[:end]
        out.append(own(head[kinds == 1], rarity[:end][kinds == 1]))
        for k in (2, 3):
            out.append(mix(_combined(head[kinds == k], groups[kinds == k], k) + U64(int(_KINDS[2 + k]) * max(count, 1) % (1 << 64))))
    return np.unique(np.concatenate(out))


class _Chunk:
    """A chunk's rows and sets; whole has the distinct shingles of each set that occurs, entries() of them."""

    def __init__(self, t: pa.Table, words: int, percent: int, buckets: int):
        least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
        self.ids, self.rows, self.names, self.sizes, kept = [], [], [], [], []
        seen: set[int] = set()
        self.first: list[bool] = []
        for batch in t.select(["doc_id", "row_hash", "text"]).to_batches():
            for piece in slices(batch, 2):
                fp, at = distinct_sets(piece.column(2), words)
                self.ids.append(piece.column(0))
                self.rows.append(piece.column(1))
                names = set_ids(fp, at)
                self.names.append(names)
                self.sizes.append(np.diff(at))
                for i, name in enumerate(names.tolist()):
                    new = at[i + 1] - at[i] >= least and name not in seen
                    self.first.append(bool(new))
                    if new:
                        seen.add(name)
                        kept.append(fp[at[i] : at[i + 1]])
        self.fp = np.concatenate(kept) if kept else np.zeros(0, U64)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
        self.order, self.begin, self.bounds = entries(self.fp, None, buckets)
        self.times = np.diff(np.append(self.begin, len(self.fp)))


def signed(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, row_hash, set_id, n_shingles and keys of each row of documents (doc_id, row_hash, text); keys are null for sets that the chunk has before, and for those too small to have partners."""
    total = text_bytes(documents, "text")
    chunks = total // min(MOST, max(LEAST, int((ENTRY * total) ** 0.5))) + 1
    buckets = buckets_for(documents.sparkSession, total)
    shift = U64((buckets - 1).bit_length())
    dealt = documents.select(F.pmod("row_hash", F.lit(chunks)).alias("chunk"), "doc_id", "row_hash", "text").groupBy("chunk")

    def ask(t: pa.Table) -> pa.Table:
        number = t.column("chunk")[0].as_py()
        c = _Chunk(t, words, percent, buckets)
        keys = ((c.fp[c.order][c.begin] << shift) >> U64(32)).astype(np.uint32)
        out = asked(number, keys, np.minimum(c.times, 255).astype(np.uint8), None, c.bounds)
        del t, c
        release_memory()
        return out

    def settle(bucket: pa.Table) -> pa.Table:
        def rarity(keys: np.ndarray, times: np.ndarray, flags: None, sizes: np.ndarray) -> np.ndarray:
            order = np.argsort(keys, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
            total = np.add.reduceat(times[order].astype(np.int64), begin)
            out = np.empty(len(keys), np.int64)
            out[order] = np.repeat(total, np.diff(np.append(begin, len(keys))))
            power = np.minimum(np.ceil(np.log2(out)).astype(np.int64), MOST_RARITY)
            return (power[:, None] >> np.arange(BITS) & 1).astype(bool)

        return answered(bucket, np.uint32, np.uint8, rarity)

    def finish(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(t):
            return pa.Table.from_pylist([], pa.schema([("doc_id", pa.int64()), ("row_hash", pa.int64()), ("set_id", pa.int64()), ("n_shingles", pa.int64()), ("keys", pa.list_(pa.int64()))]))
        c = _Chunk(t, words, percent, buckets)
        rarity = np.empty(len(c.fp), np.int8)
        rarity[c.order] = np.repeat(answers(replies, c.bounds, BITS).astype(np.int8) @ (1 << np.arange(BITS, dtype=np.int8)), c.times)
        found = iter(signature(c.fp[i:j], rarity[i:j], percent).view(np.int64) for i, j in zip(c.at[:-1].tolist(), c.at[1:].tolist(), strict=True))
        keys = pa.array([next(found) if new else None for new in c.first], pa.list_(pa.int64()))
        column = lambda parts: pa.chunked_array([pa.concat_arrays([x.cast(pa.int64()) for x in parts])])
        out = pa.table({"doc_id": column(c.ids), "row_hash": column(c.rows), "set_id": np.concatenate(c.names), "n_shingles": np.concatenate(c.sizes), "keys": keys})
        del t, c, rarity
        release_memory()
        return out

    replies = dealt.applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(settle, ANSWERED)
    return dealt.cogroup(replies.groupBy("chunk")).applyInArrow(finish, SIGNED)


def partners(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keys that several sets of keyed (set_id, key) have, one of those with the same sets (key, text_hash, n); and pairs (a, b) of their sets to compare first: all of a key of few, of a large one each with the key's first set and with its hub, which meets the most others."""
    own = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("set_id").alias("least"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("y")).where("n > 1")
    kept = checkpointed(own.groupBy("n", "least", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "least"))
    shared = checkpointed(keyed.join(broadcast_if_few(kept), "key").withColumnRenamed("set_id", "text_hash"))
    few, large = shared.where(F.col("n") <= NEXT + 2), shared.where(F.col("n") > NEXT + 2)
    w = Window.partitionBy("key").orderBy("text_hash")
    near = few.select(F.array(*(F.lag("text_hash", i).over(w) for i in range(1, NEXT + 2))).alias("partners"), F.col("text_hash").alias("b"))
    met = shared.groupBy("text_hash").agg(F.sum(F.col("n") - 1).alias("met"))
    hubs = checkpointed(large.join(met, "text_hash").groupBy("key").agg(F.max_by("text_hash", F.struct("met", "text_hash")).alias("hub")))
    star = large.join(broadcast_if_few(hubs), "key").select(F.array("hub", "least").alias("partners"), F.col("text_hash").alias("b"))
    pairs = near.unionByName(star).select(F.explode("partners").alias("a"), "b").where("a <> b")
    return shared.select("key", "text_hash", "n"), checkpointed(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def similar_sets(documents: DataFrame, rows: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (u, v: set ids) that connect all sets of which 100 * shared >= percent * all. documents: row_hash, text; rows: SIGNED of them."""
    keyed = rows.where("keys IS NOT NULL").select("set_id", "keys").dropDuplicates(["set_id"]).select("set_id", F.explode("keys").alias("key"))
    shared, pairs = partners(checkpointed(keyed))
    wanted = checkpointed(pairs.select(F.explode(F.array("u", "v")).alias("set_id")).distinct())
    chosen = rows.join(broadcast_if_few(wanted), "set_id", "left_semi").groupBy("set_id").agg(F.min("row_hash").alias("_row")).select("_row").distinct()
    texts = documents.join(broadcast_if_few(checkpointed(chosen)), F.col("row_hash") == F.col("_row"), "left_semi").select("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in slices(batch, 0)):
            fp, at = distinct_sets(b.column(0), words)
            shingles = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(fp.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(fp, at)), shingles], ["text_hash", "shingles"])

    sets = checkpointed(texts.transform(in_arrow, work, "text_hash long, shingles array<long>").dropDuplicates(["text_hash"]))
    a, b = (sets.select(F.col("text_hash").alias(k), F.col("shingles").alias(f"_{k}")) for k in "uv")
    common = F.size(F.array_intersect("_u", "_v"))
    links = checkpointed(pairs.join(a, "u").join(b, "v").where(100 * common >= percent * (F.size("_u") + F.size("_v") - common)).select("u", "v"))
    return links.union(left_links(shared, links, sets, percent / 100))


def jaccard_components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of documents (doc_id, text).

    A text's set is its distinct shingles of some words (A to Z lowered; of fewer words the whole sequence). Texts link if 100 times
    what their sets share is percent of the union or more. component_id: the smallest doc_id that links reach, its own included.
    Null texts and texts without words have no shingle and no link: their own id. Equal rows share a component; a row with a null
    id has the component of the ids it is linked to, null if there are none. Texts of any length count whole; equal sets meet as
    one, however many rows have them. Sets are equal if 64 bits are, as are shingles. No documents: no rows.
    """
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    keyed = documents.select(key.alias("doc_id"), F.xxhash64(key, text).alias("row_hash"), text.alias("text"))
    rows = checkpointed(signed(keyed, words, percent))
    roots = components(similar_sets(keyed.select("row_hash", "text"), rows, words, percent))
    ids = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    grouped = checkpointed(ids.join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root")))
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("set_id", "component_id")
    out = rows.where("n_shingles > 0").join(broadcast_if_few(checkpointed(named)), "set_id", "left").select("doc_id", "n_shingles", "component_id")
    return out.unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [md5(array_to_string(ws, ' '))] ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: md5(array_to_string(ws[i : i + 2], ' '))))) END AS ss FROM w),
g AS (SELECT min(doc_id) AS id, any_value(ss) AS ss, len(any_value(ss)) AS n FROM s WHERE len(ss) > 0 GROUP BY md5(array_to_string(ss, ''))),
t AS (SELECT id, n, unnest(ss) AS k FROM g),
p AS (SELECT a.id AS u, b.id AS v, a.n AS nu, b.n AS nv, count(*) AS c FROM t a JOIN t b ON a.k = b.k AND a.id < b.id WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT u, v FROM p WHERE 100 * c >= 90 * (nu + nv - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT id AS a, id AS b FROM g UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u),
m AS (SELECT a AS id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.ss)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN g ON len(s.ss) > 0 AND g.ss = s.ss LEFT JOIN m ON m.id = g.id
"""
