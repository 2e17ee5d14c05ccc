"""The manifest against plain Python, which builds the trees level by level and checks every proof."""

from __future__ import annotations

import hashlib
import random
import zlib
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from hillspan.llm import merkle
from hillspan.llm.merkle import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The levels of a tree over nodes."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    for nodes in levels[:-1]:
        run = at // 16 * 16
        yield nodes[run:at], nodes[at + 1 : run + 16]
        at //= 16


def plain(rows):
    lower = str.maketrans(ascii_uppercase, ascii_lowercase)
    sources = {}
    for row in rows:
        d = leaf(row)
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
        other = leaf((*row[:4], row[4] and row[4].translate(lower))) if tampered else d
        sources.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, d, row[0], other))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(sources[s])]) for s in names]
    top, out = tree([t[-1][0] for t in trees]), []
    for number, (name, levels) in enumerate(zip(names, trees, strict=True)):
        for at, (_, _, d, doc_id, other) in enumerate(sorted(sources[name])):
            proof = [*siblings(levels, at), *siblings(top, number)]
            folded = other
            for left, right in proof:
                folded = sha("".join([*left, folded, *right]))
            out.append((doc_id, d, levels[-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in proof)), folded, folded == top[-1][0]))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr(tuple(r)) for r in manifest(df).select(*COLUMNS).collect())


def test_bundled_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert found(df) == plain([tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])


def test_sources_of_many_sizes(spark):
    r = random.Random(1)
    rows = [(i, f"s{min(int(r.expovariate(0.2)), 39):02}", "en", i, f"Text {i} É") for i in range(900)]
    rows += [(i, None, None, None, None) for i in range(17)] + [(None, "s00", "en", 1, "A"), (None, "s00", "en", 1, "A"), (3, "", None, 0, ""), (3, "", None, 0, "B")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("g", F.lit("x")).withColumn("p", F.lit(1)).withColumn("number", F.lit(2)).repartition(4)
    assert found(df) == plain(rows)


def test_one_row_long_text_and_none(spark):
    one = [(5, "a", None, 3, "Xyz" * 700_000)]
    assert found(spark.createDataFrame(one, SCHEMA)) == plain(one)
    assert found(spark.createDataFrame([], SCHEMA)) == []
    nulls = [(None,) * 5] * 3
    assert found(spark.createDataFrame(nulls, SCHEMA)) == plain(nulls)


def test_a_source_of_more_than_a_bucket(spark):
    rows = [(i, "a" if i % 3 else "b", "en", 1, f"T{i}") for i in range(merkle.WIDTH * 2 + 5)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
