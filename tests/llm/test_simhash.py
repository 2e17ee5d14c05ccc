"""Operator 2 against a brute-force version."""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from hillspan.llm import simhash
from hillspan.llm.components import components
from hillspan.llm.simhash import VantageTree, links_within, simhash_components


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts_for_test():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeÉ", k=r.randint(1, 4)))
    out = [None, "", " \n", "One", "one", "one TWO", "Éa éa", "a b c"]
    base = [[word() for _ in range(150)] for _ in range(6)]
    for b in base:
        for _ in range(12):
            w = list(b)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            out.append(r.choice([" ", "\t", "\r\n"]).join(w))
    return out + [" ".join(word() for _ in range(r.randint(3, 60))) for _ in range(60)] + ["x y z " * 30000]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 16)
    texts = texts_for_test()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string").repartition(6)
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    label = brute_components(prints, 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_components(df).collect()}
    assert got == {i: (f"{prints[i]:016x}", label[i]) for i in prints}
    assert len(set(label.values())) <= len(texts) - 20


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "other words here")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id is None) for r in simhash_components(df).collect())
    assert got == [("4", False), ("4", False), ("None", False), ("None", True)]
    assert simhash_components(df.limit(0)).collect() == []


def test_tree_meets_every_pair_in_one_shard():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    points = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(40)]))
    tree = VantageTree(points[::3], 25)
    own = {int(points[i]): leaf for leaf, at in tree.visits(points, 0) for i in at}
    for leaf, at in tree.visits(points, 2):
        for q in set(range(len(points))) - set(at.tolist()):
            inner = points[[own[int(p)] == leaf for p in points]]
            assert not (np.bitwise_count(inner ^ points[q]) <= 2).any()
    u, v = links_within(points, np.ones(len(points), bool), 2)
    assert (u != v).all() and len(u) < len(points)


def test_components_of_chains_and_stars(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 300)] + [(-5, 399), (7, 7)]
    r.shuffle(edges)
    df = spark.createDataFrame([(a, b) if r.random() < 0.5 else (b, a) for a, b in edges], "u long, v long")
    got = {x.node: x.root for x in components(df).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: -5 for i in range(100, 400)}
    assert components(df.limit(0)).collect() == []
