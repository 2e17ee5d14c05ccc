"""The trie against plain Python: one dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from hillspan.llm.trie import Node, Stack, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            fp = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append((turn is not None, turn or 0, fp, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members, ended = {}, {}
    for c, t in own.items():
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        new = own.get(base, [])[:h] + t[h:]
        for d in range(len(new) + 1):
            members.setdefault(tuple(new[:d]), []).append(c)
        ended.setdefault(tuple(new), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)

    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children.get(p, ())]
        own_saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(x[0] for x in below) if below else 1, own_saved + sum(x[1] for x in below))
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, ())), *sums[p], digest(ended.get(p, ()))) for p, m in members.items())


def found(df, **how):
    return sorted(tuple(r) for r in prefix_trie(df, **how).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("seed, block", [(0, 300), (1, 2000), (2, None)])
def test_against_plain_python(spark, seed, block):
    r = random.Random(seed)
    rows = []
    for c in list(range(-7, 60)) + [2**40]:
        for t in range(r.choice([1, 2, 2, 5, 9, 30])):
            text = r.choice(["a", "b", "é", "", None]) if r.random() < 0.9 else f"own {c} {t}"
            rows.append((c, r.choice([t, t, t, None, 3]), r.choice(["user", "user", None]), text))
    rows += [(None, 0, "user", "a")] * 3 + rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("x")).withColumn("number", F.lit(1)).repartition(5)
    assert found(df, block_bytes=block) == plain(rows)


def test_groups_of_equal_conversations_and_a_very_long_one(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 500, 5) for t in range(3)] + [(5001, t, "user", f"long {t}") for t in range(9000)]
    rows += [(10_000 + 5 * c, 0, "system", "hello") for c in range(200)]
    assert found(spark.createDataFrame(rows, SCHEMA), block_bytes=1000) == plain(rows)


def test_long_texts_nulls_and_no_rows(spark):
    rows = [(0, 0, "user", "x" * 3_000_000), (5, 0, "user", "x" * 3_000_000), (10, None, None, None)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, None, None, None)] * 2, SCHEMA)) == []


def test_turnless_conversations_are_members_of_the_root(spark):
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "a")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_what_a_block_leaves_open_falls_and_rises():
    import numpy as np

    stack, r = Stack(open_left=True), random.Random(3)
    for i in range(1000):
        stack.add(Node(r.randint(0, 9), 1, 0, 1, i, 0, 0), np.zeros(11, np.int64))
    depths = [x.x for x in stack.open_nodes()]
    least = depths.index(min(depths))
    assert depths[: least + 1] == sorted(set(depths[: least + 1]), reverse=True) and depths[least:] == sorted(set(depths[least:]))
    assert sum(x.n for x in stack.open_nodes()) == 1000
