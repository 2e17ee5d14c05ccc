"""Links by shingles against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hillspan.llm import shingles
from hillspan.llm.shingles import alike
from hillspan.llm.simhash import one_of_each


def sets_of(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def texts_for_test():
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 5)))
    out = ["", None, "a b", "A  b", "a b c", "one two three four five"]
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 300))]
        for edits in (0, 1, 1, 2, 3, 6, 12):
            w = list(base)
            for _ in range(edits):
                w[r.randrange(len(w))] = word()
            out.append(r.choice([" ", "\n"]).join(w))
    return out


def test_links_connect_what_is_alike(spark):
    texts = texts_for_test()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"row_hash": F.xxhash64("doc_id", "text"), "text_hash": F.xxhash64("text")})
    by_hash = {r.text_hash: r.text for r in df.collect()}
    links = {frozenset((by_hash[r.u], by_hash[r.v])) for r in alike(df).collect()}
    similar = lambda a, b: len(sets_of(a) & sets_of(b)) >= 0.8 * len(sets_of(a) | sets_of(b))
    assert all(similar(*x) for x in links)

    def classes(linked):
        label = {t: t for t in by_hash.values() if t}
        changed = True
        while changed:
            changed = False
            for a in label:
                for b in label:
                    if linked(a, b) and label[b] < label[a]:
                        label[a], changed = label[b], True
        return label

    assert classes(lambda a, b: frozenset((a, b)) in links) == classes(similar)


def test_one_of_each(spark):
    texts = texts_for_test()
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(40, texts[40], 1), (None, texts[40], 1), (None, "alone among all of the others here", 2), (500, texts[7], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    out = one_of_each(df)
    kept = sorted((str(r.doc_id), r.text) for r in out.collect())
    assert out.columns == df.columns and len(kept) == len(set(kept)) < 50
    assert ("None", "alone among all of the others here") in kept and not any(k == "500" for k, _ in kept) and ("0", "") in kept
    sets = [(k, sets_of(t)) for k, t in kept if t]
    assert not any(a != b and len(x & y) >= 0.8 * len(x | y) for a, x in sets for b, y in sets)
    assert one_of_each(df.limit(0)).collect() == []


def test_edited_copies_meet_their_original(spark):
    """Every copy is like the original, few are like one another: one text stays."""
    r = random.Random(12)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 5)))
    base = [word() for _ in range(400)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        w = list(base)
        for at in r.sample(range(0, 400, 8), 8):
            w[at] = word()
        rows.append((1000 + i, " ".join(w)))
    original = sets_of(rows[0][1])
    sets = [sets_of(t) for _, t in rows[1:]]
    assert all(len(s & original) >= 0.8 * len(s | original) for s in sets)
    assert sum(len(a & b) >= 0.8 * len(a | b) for a in sets[:40] for b in sets[:40] if a is not b) < 200
    out = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [x.doc_id for x in out] == [500]


@pytest.mark.parametrize("block", [1 << 12, 1 << 19])
def test_pairs_of_a_frequent_key(spark, monkeypatch, block):
    """Pairs share 0.8 and more, all texts two thirds of their shingles: every key is frequent, and no pair is missed."""
    monkeypatch.setattr(shingles, "BLOCK", block, raising=False)
    r = random.Random(13)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    passage, rows = [word() for _ in range(204)], []
    for i in range(300):
        own = [word() for _ in range(51)]
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join([*passage, *own[:26], *(word() for _ in range(25))]))]
    near = sets_of(rows[0][1]), sets_of(rows[1][1])
    assert len(near[0] & near[1]) >= 0.8 * len(near[0] | near[1]) and len(near[0] & sets_of(rows[2][1])) < 0.7 * len(near[0] | sets_of(rows[2][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row_hash": F.xxhash64("doc_id", "text"), "text_hash": F.xxhash64("text")})
    by_hash = {x.text_hash: x.doc_id for x in df.collect()}
    assert {tuple(sorted((by_hash[x.u], by_hash[x.v]))) for x in alike(df).collect()} == {(2 * i, 2 * i + 1) for i in range(300)}


def test_common_counts():
    r = np.random.default_rng(14)
    sets = [np.unique(r.integers(0, n, 60)) for n in (70, 100, 1000, 5000) for _ in range(20)]
    at = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    flat = np.concatenate(sets)
    assert shingles.common_counts(flat, at, flat[: at[9]], at[:10]).tolist() == [[len(np.intersect1d(x, y)) for y in sets[:9]] for x in sets]
