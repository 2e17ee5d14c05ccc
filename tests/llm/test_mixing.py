"""Operator 8 against DuckDB and against its rules."""

from __future__ import annotations

import random
import re

import duckdb
import pandas as pd
import pytest

from hillspan.llm.mixing import SQL, mix
from hillspan.llm.shared import word_count

TESTDATA = "/root/testdata/sf0.001"


def duck(rows):
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(SQL).fetchall()


def corpus(seed):
    r = random.Random(seed)
    out = []
    for i in range(300):
        source = r.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot", "tiny"]) if i > 2 else "tiny"
        out.append((i, " ".join("w" for _ in range(r.randint(0, 90) if source != "tiny" else 2)) + r.choice(["", " ", "\n"]), source))
    return out + [(None, "x y", "a"), (7, "again", "b"), (7, "again", "b"), (900, None, "a"), (901, "", "empty"), (902, "w " * 20000, "long")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_sql_and_keeps_rules(spark, seed):
    rows = corpus(seed)
    got = [tuple(r) for r in mix(spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, h int")).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, duck(rows)))
    total = sum(g[1] for g in got)
    assert total == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert all(g[4] <= 3 * g[1] for g in got)
    by = {}
    for _, size, source_size, target, taken in got:
        x = by.setdefault((source_size, target), [0, 0])
        x[0] += taken
        x[1] = max(x[1], size)
    for (source_size, target), (taken, largest) in by.items():
        assert target <= 3 * source_size and abs(taken - target) <= largest
    assert sum(t for _, t in by) == pytest.approx(total)


def test_empty(spark):
    assert mix(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    assert [tuple(r) for r in mix(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [(1, 0, 0, 0.0, 0)]


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", "a\x0bb\x0c c", " ", "a\x1cb c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", word_count(df.t).alias("n")).orderBy("i").collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
