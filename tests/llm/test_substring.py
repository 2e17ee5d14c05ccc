"""Operator 1 against a brute-force version."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from hillspan.llm import rendezvous
from hillspan.llm.substring import substring_dedup


def brute(rows, window=50):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            if i is not None:
                k = tuple(w[s : s + window])
                least[k] = min(least.get(k, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if i is not None and least[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_for_test():
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdé", k=r.randint(1, 3)))
    text = lambda n: [word() for _ in range(n)]
    passage, license_ = text(73), text(50)
    rows = [(0, " ".join(text(30) + passage + text(40))), (1, None), (2, ""), (3, " \t\n ")]
    for i in range(4, 40):
        parts = text(r.randint(0, 60))
        if i % 3 == 0:
            parts += passage[r.randint(0, 10) :] + text(r.randint(0, 5))
        if i % 4 == 0:
            parts += license_ + text(r.randint(0, 30)) + license_
        rows.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    whole = "\n".join(text(260))
    rows += [(50, whole), (51, whole), (52, whole), (51, whole), (None, whole), (53, "a " * 300), (54, "a " * 77), (55, whole.replace("\n", " "))]
    rows += [(60, "x\x0b" * 49 + "x\x1c"), (61, " ".join(text(5000))), (62, " ".join(passage[:49])), (63, " ".join(passage[-50:]))]
    return rows


@pytest.mark.parametrize("chunk_bytes", [500, 20000, 1 << 22])
def test_equals_brute_force(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(rendezvous, "LEAST", chunk_bytes)
    monkeypatch.setattr(rendezvous, "ENTRY", 1)
    rows = rows_for_test()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, chunk string, bucket int").repartition(5)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect()), key=str)
    assert got == brute(rows)


def test_removed_runs_count_the_removed_words(spark):
    df = spark.createDataFrame(rows_for_test(), "doc_id long, text string")
    for r in substring_dedup(df).collect():
        assert sum(x.end - x.start for x in r.removed) == r.n_removed


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_other_window(spark):
    rows = rows_for_test()
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=12).collect()), key=str)
    assert got == brute(rows, 12)
