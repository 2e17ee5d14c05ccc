"""The set join against all pairs of sets in plain Python."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hillspan.llm.ngram import jaccard_components, signature

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def plain(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            group[root(j)] = root(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((repr((d, len(s), least.get(root(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))))


def found(df, **how):
    return sorted(repr(tuple(r)) for r in jaccard_components(df, **how).select("doc_id", "n_shingles", "component_id").collect())


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
    return words


@pytest.mark.parametrize("percent", [90, 70])
def test_against_all_pairs(spark, percent):
    r = random.Random(percent)
    rows, word = [], lambda: f"w{r.randrange(3000)}"
    for i in range(25):
        base = [word() for _ in range(r.choice([9, 11, 12, 30, 90, 400]))]
        for _ in range(r.choice([1, 2, 8])):
            words = edited(r, base, r.choice([0, 0, 1, 2, 3, 8]))
            words += [word() for _ in range(r.choice([0, 0, 1, 2, 5]))]
            rows.append((len(rows), " ".join(words).upper() if r.random() < 0.2 else "\n".join(words)))
    # a group in which all shingles are frequent, chained by steps that only neighbours are similar over
    chain = [f"c{i}" for i in range(300)]
    rows += [(1000 + k, " ".join(chain[k * 3 : k * 3 + 150])) for k in range(40)]
    common = " ".join(f"p{i}" for i in range(120))
    rows += [(2000 + k, common + " " + " ".join(f"x{k}y{i}" for i in range(r.choice([3, 5, 9])))) for k in range(60)]
    rows += [(3000, "a b"), (3001, "A  b"), (3002, "a b c"), (3003, "a b c a b c"), (3004, "a b c a b c a b c"), (3005, ""), (3006, None), (3007, " \n"), (None, "a b"), (None, rows[0][1]), (7, rows[0][1]), (7, rows[0][1])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("set_id", F.lit("x")).withColumn("n", F.lit(2.0)).repartition(4)
    assert found(df, percent=percent) == plain(rows, percent)


def test_very_long_texts_and_no_rows(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(r, words, 500))), (3, " ".join(edited(r, words, 9000))), (4, " ".join(words[:60_000]))]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, None)] * 2, SCHEMA)) == ["(None, 0, None)"] * 2


def test_similar_sets_have_a_key_in_common():
    r = np.random.default_rng(5)
    seen = 0
    for _ in range(3000):
        a = np.unique(r.integers(1, 2**63, int(r.integers(9, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) > r.choice([0.02, 0.05, 0.08])], r.integers(1, 2**63, int(r.integers(0, max(1, len(a) // 12))), dtype=np.uint64)]))
        mode = int(r.integers(0, 4))
        shared = np.intersect1d(a, b)
        rarity = lambda x: np.maximum(np.full(len(x), (3, 8, 15)[mode]) if mode < 3 else (x >> np.uint64(8)) % np.uint64(16), np.isin(x, shared)).astype(np.int8)  # noqa: B023, E731
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            seen += 1
            assert len(np.intersect1d(signature(a, rarity(a)), signature(b, rarity(b))))
    assert seen > 1000
