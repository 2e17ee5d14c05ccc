"""Operator 3 against a brute-force version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hillspan.llm import rendezvous
from hillspan.llm.suffix import KEY, LevelFamily, SuffixIndex, common_bytes, suffix_dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        n_spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_for_test(size):
    r = random.Random(3)
    text = lambda n: "".join(r.choices("abcdefgh é", k=n))
    shared, other = text(size * 2), text(size + 30)
    rows = [(0, text(50) + shared + text(80)), (1, None), (2, ""), (3, "x" * (size - 1)), (4, "x" * (size + 60)), (5, "ab" * size)]
    for i in range(6, 40):
        cut = r.randint(0, size)
        t = text(r.randint(0, 100))
        if i % 2:
            t += shared[cut:] + text(r.randint(0, 50))
        if i % 3 == 0:
            t += other[: r.randint(size - 20, size + 30)] + text(9) + other
        rows.append((i, t))
    whole = text(size * 3)
    near = whole[: size + 10] + "#" + whole[size + 11 :]
    rows += [(50, whole), (51, whole), (51, whole), (None, near), (52, near), (53, whole[:size]), (54, whole[5 : size + 4]), (55, text(4000))]
    return rows


@pytest.mark.parametrize(("length", "chunk_bytes"), [(40, 300), (400, 1500), (400, 1 << 22)])
def test_equals_brute_force(spark, monkeypatch, length, chunk_bytes):
    monkeypatch.setattr(rendezvous, "LEAST", chunk_bytes)
    monkeypatch.setattr(rendezvous, "ENTRY", 1)
    rows = rows_for_test(length)
    df = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, chunk int, bits string").repartition(5)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(df, length).collect()), key=str)
    assert got == brute(rows, length)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_family_marks_what_recurs():
    r = np.random.default_rng(1)
    raw = np.zeros((5000, 16), np.uint8)
    raw[:, 0], raw[:, 11], raw[:, 15] = r.integers(0, 40, 5000), r.integers(0, 70, 5000), r.integers(0, 4, 5000)
    keys = raw.view(KEY).ravel()
    f = LevelFamily(len(keys))
    for lo in range(0, len(keys), 70):
        f.add(keys[lo : lo + 70], np.arange(lo, min(lo + 70, len(keys))))
        assert all((k[1:] >= k[:-1]).all() for k, _ in f.levels)
    assert len(f.levels) <= 14 and sum(len(k) for k, _ in f.levels) == len(keys)
    for got, part in ((f.same, raw), (f.near, raw[:, :12])):
        _, inverse, count = np.unique(part, axis=0, return_inverse=True, return_counts=True)
        assert (got == (count[inverse.ravel()] > 1)).all()


def test_common_prefixes():
    a, b = (np.array(x, KEY) for x in ([b"abcdefgh12345678", b"abcdefgh12345678", b"abc", b""], [b"abcdefgh12345678", b"abcdefgh12349999", b"abd", b"x"]))
    assert common_bytes(a, b).tolist() == [16, 12, 2, 0]


def test_batches_in_different_runs(spark, tmp_path, monkeypatch):
    """Batches of an index that is opened again for each: every new one against all, levels by their sizes, and at last all batches."""
    monkeypatch.setattr(rendezvous, "LEAST", 600)
    monkeypatch.setattr(rendezvous, "ENTRY", 1)
    length, rows = 40, rows_for_test(40)
    batches = [rows[i::5] for i in range(5)]
    path = str(tmp_path / "index")
    plain = lambda df: sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)
    for k, batch in enumerate(batches):
        index = SuffixIndex(spark, path, length) if k == 0 else SuffixIndex.open(spark, path)
        # a run that died left a part of the batch and a level
        spark.createDataFrame([(1, 1, "left over")], "chunk long, doc_id long, text string").write.parquet(f"{path}/documents/batch={k}")
        assert index.length == length and index.add(spark.createDataFrame(batch, "doc_id long, text string")) == k
        assert {p.name for p in (tmp_path / "index").glob("level-*")} == {f.rsplit("/", 1)[1] for f, _ in index.levels}
        sizes = [n for _, n in index.levels]
        assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes)
        so_far = [x for b in batches[: k + 1] for x in b]
        left = Counter(map(str, brute(so_far, length)))
        new = plain(index.matches([k]))
        assert len(new) == len(batch) and not Counter(map(str, new)) - left
    assert len(index.levels) < 5
    assert plain(SuffixIndex.open(spark, path).matches()) == brute(rows, length)


def test_a_long_text_in_slices(spark, monkeypatch):
    from hillspan.llm import suffix

    monkeypatch.setattr(suffix, "SLICE", 1000)
    r = random.Random(5)
    text = "".join(r.choices("abcdefgh é", k=9000))
    table = pa.table({"chunk": pa.array([7, 7, 7]), "doc_id": [1, 2, 3], "text": [text + text[50:700], text[:399], text[3000:4000]]})
    one = suffix._Chunk(table, 400, 256)
    monkeypatch.setattr(suffix, "SLICE", 1 << 21)
    other = suffix._Chunk(table, 400, 256)
    assert (one.keys == other.keys).all() and (one.grams == other.grams).all()
    bits = np.stack([np.arange(len(one.keys)) % 3 == 0, np.arange(len(one.keys)) % 3 == 1], 1)
    for a, b in zip(one.starts(bits), other.starts(bits), strict=True):
        assert (a == b).all()
