"""Operator 4 against a brute-force version."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hillspan.llm.tiling import contaminated, decontaminate, tile, tokens_of


def brute_tile(a, b, shortest):
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return tiles
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        tiles.append((i, j, n))


@given(st.lists(st.sampled_from("abc"), max_size=18), st.lists(st.sampled_from("abcd"), max_size=40), st.integers(1, 4))
@settings(max_examples=400, deadline=None)
def test_tiles_equal_brute_force(a, b, shortest):
    assert tile(a, b, shortest) == brute_tile(a, b, shortest)


def rows_for_test():
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 4)))
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(r.randint(12, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (3, "a second text of item three with quite other words in it"), (None, " ".join(text(20)))]
    docs = [(0, None), (1, ""), (2, "..."), (3, " ".join(text(8000)))]
    for i in range(4, 70):
        body = text(r.randint(5, 60))
        item = (r.choice(items)[1] or "").split()
        how = i % 5
        if how == 0:
            body += [x.upper() + r.choice([",", "!", ""]) for x in item]
        elif how == 1:  # pieces in another order
            cut = sorted(r.sample(range(len(item) + 1), min(2, len(item))))
            pieces = [item[: cut[0]], item[cut[0] : cut[-1]], item[cut[-1] :]] if cut else [item]
            body = pieces[-1] + body + pieces[0] + text(3) + (pieces[1] if len(pieces) > 1 else [])
        elif how == 2:  # part
            body += item[: len(item) // 3]
        elif how == 3:  # edits
            body += [word() if r.random() < 0.15 else x for x in item]
        docs.append((i, " ".join(body)))
    return docs + [(10, docs[10][1]), (None, docs[5][1])], items


def brute(docs, items, coverage=0.6):
    out = []
    for d, text in docs:
        b = tokens_of(text).split()
        for i, item in items:
            a = tokens_of(item).split()
            tiles = brute_tile(a, b, 5) if len(b) < 1000 else tile(a, b, 5)
            share = sum(n for *_, n in tiles) / max(1, len(a))
            if share >= coverage:
                out.append((d, i, share, len(tiles), len(b)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    docs, items = rows_for_test()
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int").repartition(5)
    b = spark.createDataFrame([(*x, 2) for x in items], "item_id long, text string, seed int")
    got = sorted((tuple(x)[:5] for x in contaminated(d, b).collect()), key=str)
    assert got == brute(docs, items) and len(got) > 20
    hit = {x[0] for x in got}
    left = decontaminate(d, b)
    assert left.columns == d.columns
    assert sorted(map(str, (x.doc_id for x in left.collect()))) == sorted(str(i) for i, _ in docs if i not in hit)


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_empty(spark, empty):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(d.limit(0) if empty == "documents" else d, b.limit(0) if empty == "benchmark" else b).collect() == []
    assert decontaminate(d, b.limit(0)).count() == 1 and decontaminate(d, b).count() == 0


def test_slices_hold_all_rows():
    import pyarrow as pa

    from hillspan.llm.rolling import slices

    texts = ["a" * n for n in (5, 0, 100, 3, 3, 3, 40)] + [None]
    b = pa.record_batch([pa.array(range(8)), pa.array(texts, pa.string())], ["i", "t"])
    parts = [p.column(0).to_pylist() for p in slices(b, 1, 10)]
    assert sum(parts, []) == list(range(8)) and parts[0] == [0, 1]
    assert list(slices(b.slice(0, 0), 1)) == []


def test_texts_of_one_token_take_little():
    """Greedy tiling of 2,000 and 100,000 equal tokens, and of a phrase that repeats: no pairs of places are held."""
    import time
    import tracemalloc

    for item, document in ((["a"] * 2000, ["a"] * 100_000), ("a b c d e f g".split() * 280, "a b c d e f g x".split() * 12_000), (["a"] * 1000 + ["b"] * 1000, ["a", "a", "a", "a", "a", "b"] * 16_000)):
        tracemalloc.start()
        began = time.perf_counter()
        tiles = tile(item, document)
        took, (_, peak) = time.perf_counter() - began, tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert tiles and took < 20 and peak < 200e6  # tracing itself takes most of the time
        assert len({k for i, _, n in tiles for k in range(i, i + n)}) == sum(n for *_, n in tiles)


@given(st.lists(st.sampled_from("ab"), max_size=30), st.lists(st.sampled_from("ab"), max_size=60), st.integers(1, 5))
@settings(max_examples=300, deadline=None)
def test_repeating_texts_equal_brute_force(a, b, shortest):
    assert tile(a, b, shortest) == brute_tile(a, b, shortest)
