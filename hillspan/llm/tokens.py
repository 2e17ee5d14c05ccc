"""Token ids in fixed-width bit-packed files (operator 10).

A file is a Parquet folder of shards, so that Spark's committer replaces the output of lost tasks on any file system. A
shard is one binary value: a header, the documents' ids and token bounds, and the token ids, each in the fewest bits that
hold the vocabulary's largest id, least significant bit first. They come in blocks of BLOCK ids that begin on a byte whose
offset the header's numbers give, so any range of tokens is read by unpacking the blocks that hold it, with array
operations on whole blocks.

Encoding goes word by word, each distinct word once while a worker remembers it: the tokenizer that these files are for
never joins characters across white space, nor letters or digits to marks after them (but apostrophes), and WordEncoder
refuses tokenizers that might. A test holds it against the tokenizer's ids of whole texts around every code point.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rolling import U64, Texts, grouped, mix, slices, words_of
from .shared import in_arrow, shared_folder, shuffle_partitions

#: Closes every document.
END_ID = 2
#: Ids of a block; tokens of a shard, about; words that a worker remembers, at most; bytes of a text that are encoded at a time.
BLOCK, SHARD, REMEMBERED, PIECE = 8192, 1 << 20, 300_000, 4 << 20
HEADER = struct.Struct("<4sIIIQQ")
MAGIC = b"HSTK"
SHARD_SCHEMA = "part int, seq int, first long, n_tokens long, shard binary"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Widths that are numbers of their own.
_WHOLE = {8: "u1", 16: "<u2", 32: "<u4"}


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Eight ids fill bits bytes; byte k of them takes its bits from the ids that reach into it."""
    if bits in _WHOLE:  # as they lie in memory, with blank ids up to eight
        return np.concatenate([ids, np.zeros(-len(ids) % 8, np.uint32)]).astype(_WHOLE[bits]).tobytes()
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint32)
    groups.ravel()[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for k in range(bits):
        for j in range(8 * k // bits, (8 * k + 7) // bits + 1):
            shift = 8 * k - j * bits
            out[:, k] |= (groups[:, j] >> shift if shift >= 0 else groups[:, j] << -shift).astype(np.uint8)
    return out.tobytes()


def unpack(data: memoryview | bytes, n: int, bits: int) -> np.ndarray:
    if bits in _WHOLE:
        return np.frombuffer(data, _WHOLE[bits], n).astype(np.uint32)
    packed = np.frombuffer(data, np.uint8).reshape(-1, bits)
    out = np.zeros((len(packed), 8), np.uint32)
    for k in range(bits):
        for j in range(8 * k // bits, (8 * k + 7) // bits + 1):
            shift = 8 * k - j * bits
            x = packed[:, k].astype(np.uint32)
            out[:, j] |= x << shift if shift >= 0 else x >> -shift
    return (out & np.uint32((1 << bits) - 1)).ravel()[:n]


def write_shard(doc_ids: list, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    known = np.array([x is not None for x in doc_ids], np.uint8)
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    ends = np.cumsum(lengths).astype("<u8")
    numbers = np.array([x if x is not None else 0 for x in doc_ids], "<i8")
    return b"".join([HEADER.pack(MAGIC, bits, BLOCK, len(blocks), len(doc_ids), len(ids)), known.tobytes(), numbers.tobytes(), ends.tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """A shard's bytes, opened for random access."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block, blocks, docs, self.n_tokens = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at, parts = HEADER.size, []
        for kind, n in ((np.dtype("u1"), docs), (np.dtype("<i8"), docs), (np.dtype("<u8"), docs), (np.dtype("<u8"), blocks + 1)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += kind.itemsize * n
        known, numbers, ends, self.offsets = parts
        self.doc_ids = [int(x) if k else None for x, k in zip(numbers, known, strict=True)]
        self.bounds = np.concatenate([[0], ends.astype(np.int64)])
        self.data = memoryview(data)[at:]

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the shard, from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        out = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_tokens - b * self.block)
            out.append(unpack(self.data[int(self.offsets[b]) : int(self.offsets[b + 1])], n, self.bits))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.bounds[i]), int(self.bounds[i + 1]))


class WordEncoder:
    """Ids of whole texts, by way of their words."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        config = json.loads(definition)
        special = [x["content"] for x in config["added_tokens"]]
        if config["model"].get("end_of_word_suffix") != "</w>" or any(x["lstrip"] or x["rstrip"] or x["content"].split() != [x["content"]] for x in config["added_tokens"]):
            raise ValueError("this tokenizer may join characters across white space")
        self.tokenizer = Tokenizer.from_str(definition)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = True
        self.lower = any(x["type"] == "Lowercase" for x in config["normalizer"].get("normalizers", []))
        self.marks = [x.encode() for x in special]
        # for small letters, which nothing normalises and no pattern divides
        plain = config | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(x for x in config["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel")]}}
        self.letters = Tokenizer.from_str(json.dumps(plain))
        #: The place of each word that is remembered, and its ids: pool[begin[place]:begin[place] + count[place]].
        self.known: dict[bytes, int] = {}
        self.begin, self.count, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.used = 0

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as bytes of little-endian 32-bit integers."""
        ids, size = self.encode(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        at = np.cumsum(np.concatenate([[0], size]))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts buf[at[i]:at[i + 1]], one after the other, and how many each has.

        A to Z come in lower case where the tokenizer lowers case, but not in texts with a combining mark, which might join a
        small letter and not the capital, nor in those with a special token, which are split at white space alone.
        """
        if len(buf) > PIECE and len(at) == 2:  # a long text in pieces, cut where white space begins
            cut = [0]
            while len(buf) - cut[-1] > PIECE:
                gap = _GAP.search(buf, cut[-1] + PIECE)
                if not gap:
                    break
                cut.append(gap.start())
            if len(cut) > 1:
                ids = [self.encode(buf[i:j], np.array([0, j - i]))[0] for i, j in zip(cut, [*cut[1:], len(buf)], strict=True)]
                return np.concatenate(ids), np.array([sum(map(len, ids))])
        data = buf.tobytes()
        low = data.lower()
        special = np.zeros(len(at) - 1, bool)
        kept = special.copy()
        for found, signs in ((special, self.marks), (kept, (b"\xcc", b"\xcd"))):
            if any(x in low for x in signs):
                found[:] = [any(x in low[i:j] for x in signs) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        kept |= special
        if not self.lower:
            low = data
        elif kept.any():
            low = b"".join((data if k else low)[i:j] for i, j, k in zip(at[:-1].tolist(), at[1:].tolist(), kept.tolist(), strict=True))
        buf = np.frombuffer(low + bytes(8), np.uint8)
        start, end, first = words_of(buf[: len(low)], at)
        start, end, first = _tails_apart(buf, start, end, first, special)
        one, which = _distinct(buf, start, end)
        place = self._places([low[i:j] for i, j in zip(start[one].tolist(), end[one].tolist(), strict=True)])[which]
        n = self.count[place]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(self.begin[place] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[first])

    def _places(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > REMEMBERED:  # words met first are the frequent ones
            self.known = dict(islice(self.known.items(), REMEMBERED // 2))
            last = len(self.known) - 1
            self.used = int(self.begin[last] + self.count[last])
        get = self.known.get
        got = list(map(get, words))
        if None in got:
            self._learn([w for w, x in zip(words, got, strict=True) if x is None])
            got = list(map(get, words))
        return np.array(got, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        other, plain = [], []
        for w in words:
            (plain if _LETTERS.fullmatch(w) else other).append(w)
        # each of these is one piece, with one id that ends a word, so such ids divide a line of them; should one not be, the counts differ
        lines = [plain[i : i + 64] for i in range(0, len(plain), 64)]
        for some, x in zip(lines, self.letters.encode_batch_fast([b" ".join(x).decode() for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, np.uint32)
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) == len(some):
                self._remember(some, ids, np.diff(end, prepend=0))
            else:
                other += some
        for i in range(0, len(other), 4096):
            some = other[i : i + 4096]
            found = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            self._remember(some, np.array([y for x in found for y in x], np.uint32), np.array([len(x) for x in found]))

    def _remember(self, words: list[bytes], ids: np.ndarray, count: np.ndarray) -> None:
        n, m = len(self.known), len(self.known) + len(words)
        self.begin, self.count, self.pool = (_room(x, k) for x, k in ((self.begin, m), (self.count, m), (self.pool, self.used + len(ids))))
        self.begin[n:m], self.count[n:m] = self.used + np.cumsum(count) - count, count
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(words, range(n, m), strict=True))


def _room(x: np.ndarray, n: int) -> np.ndarray:
    return x if len(x) >= n else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])


#: ASCII marks but the apostrophe, which the tokenizer may join to letters; ASCII letters and digits.
_MARK, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = True
_ALNUM[[i for i in range(128) if chr(i).isalnum()]] = True
_GAP = re.compile(rb"\s")
#: Words of small Latin letters.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _tails_apart(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and where texts begin in them, with marks at a word's end, after an ASCII letter or digit, as words of their own: no pattern of the tokenizer spans both. whole: texts whose words stay."""
    tail = np.flatnonzero(_MARK[buf[end - 1]] & ~np.repeat(whole, np.diff(first))) if len(end) else np.zeros(0, np.int64)
    at, going = end[tail] - 1, np.arange(len(tail))
    while len(going):
        at[going] -= 1
        going = going[(at[going] >= start[tail[going]]) & _MARK[buf[at[going]]]]
    ok = (at >= start[tail]) & _ALNUM[buf[at]]
    tail, at = tail[ok], at[ok] + 1
    extra = np.zeros(len(start) + 1, np.int64)
    extra[tail + 1] = 1
    moved = np.cumsum(extra)
    new_start, new_end = np.empty((2, len(start) + len(tail)), np.int64)
    place = np.arange(len(start)) + moved[:-1]
    new_start[place], new_end[place] = start, end
    new_end[place[tail] + 1], new_end[place[tail]], new_start[place[tail] + 1] = end[tail], at, at
    return new_start, new_end, first + moved[first]


#: Bytes below each number of a word's last eight that belong to it.
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word of each kind, and the kind of each word. Words are compared eight bytes at a time; buf has eight bytes after the last."""
    eights = np.lib.stride_tricks.as_strided(buf[:8].view(U64), (len(buf) - 7,), (1,))
    key = (end - start).astype(U64) * U64(0x9E3779B97F4A7C15)
    left, at = np.arange(len(start)), start
    while len(left):
        size = end[left] - at
        key[left] = mix(key[left] ^ (eights[at] & _KEEP[np.minimum(size, 8)]))
        more = size > 8
        left, at = left[more], at[more] + 8
    one, which = grouped(key)
    left, at, like = np.arange(len(start)), start, start[one[which]]
    same = (end - start) == (end - start)[one[which]]
    while len(left) and same.all():
        size = end[left] - at
        same[left] = ((eights[at] ^ eights[like]) & _KEEP[np.minimum(size, 8)]) == 0
        more = size > 8
        left, at, like = left[more], at[more] + 8, like[more] + 8
    if same.all():
        return one, which
    data = buf.tobytes()  # two words share a key
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(data[i:j], len(numbers)) for i, j in zip(start.tolist(), end.tolist(), strict=True)], np.int64)
    return np.unique(which, return_index=True)[1], which


_ENCODERS: dict[int, WordEncoder] = {}


def encoder(definition: str) -> WordEncoder:
    """This worker's encoder of a tokenizer definition."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def write_tokens(documents: DataFrame, path: str, definition: str, end_id: int = END_ID) -> None:
    """Writes documents (doc_id, text) to path in ascending order of doc_id, null ids first, equal ids in the order of their texts."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(definition)  # of a fixed size: one tokenizer
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = docs.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        bits, close = bits_for(e.vocabulary), np.uint32(end_id)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        numbers: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, first
            size = np.concatenate(lengths)
            data = write_shard(numbers, size, np.concatenate(held), bits)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([int(size.sum())], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "first", "n_tokens", "shard"])
            seq, first = seq + 1, first + int(size.sum())
            for x in (numbers, held, lengths):
                x.clear()
            return out

        total = 0
        for b in (piece for batch in batches for piece in slices(batch, 1, 1 << 20)):
            t = Texts(b.column(1))
            ids, size = e.encode(t.buf, t.at)
            numbers += b.column(0).to_pylist()
            held.append(np.insert(ids, np.cumsum(size), close))
            lengths.append(size + 1)
            total += len(ids) + len(size)
            if total >= SHARD:
                yield flush()
                total = 0
        if numbers:
            yield flush()

    ordered.transform(in_arrow, work, SHARD_SCHEMA).write.parquet(path)


def read_shards(spark: SparkSession, path: str, each: Callable[[Shard, int], pa.RecordBatch], schema: str) -> DataFrame:
    """each(shard, tokens of all shards before it) for every shard at path. The driver sums one number for each part of the file."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    base, total = {}, 0
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base[r.part], total = total, total + r.n

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                yield each(Shard(data.as_py()), base[part] + first)

    return shards.select("part", "first", "shard").transform(in_arrow, work, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document in the files at path."""

    def each(s: Shard, before: int) -> pa.RecordBatch:
        ids = s.tokens(0, s.n_tokens).astype("<u4").tobytes()
        at = s.bounds.tolist()
        crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(s.bounds[:-1] + before, pa.int64()), pa.array(np.diff(s.bounds), pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_shards(spark, path, each, RESULT)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (an array) of each document in the files at path."""

    def each(s: Shard, _before: int) -> pa.RecordBatch:
        values = pa.array(s.tokens(0, s.n_tokens).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(s.bounds.astype(np.int32)), values)], ["doc_id", "ids"])

    return read_shards(spark, path, each, "doc_id long, ids array<int>")


def token_output(documents: DataFrame, definition: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """read_tokens() of what write_tokens() wrote to path (by default a new folder in the shared one).

    Null and empty texts are the closing id alone. Null ids come first; equal ids keep all their rows. No documents: no rows.
    """
    spark = documents.sparkSession
    path = path or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid4().hex}"
    write_tokens(documents, path, definition, end_id)
    return read_tokens(spark, path)


def definition_of(name: str) -> str:
    """The definition of a public tokenizer, by its file's name."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()
