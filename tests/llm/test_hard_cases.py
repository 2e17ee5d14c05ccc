"""Columns with clashing names, nulls, empty and very long texts, repeated rows: every operator on documents gives what it gives without the other columns."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hillspan.llm.language import identify, learn
from hillspan.llm.merkle import manifest
from hillspan.llm.mixing import mix, mixed
from hillspan.llm.nearest import nearest
from hillspan.llm.ngram import jaccard_components
from hillspan.llm.pii import find_pii
from hillspan.llm.simhash import simhash_components
from hillspan.llm.substring import substring_dedup
from hillspan.llm.suffix import suffix_dedup
from hillspan.llm.tiling import contaminated
from hillspan.llm.tokens import definition_of, token_output

#: Names that operators use or return, with values of other types.
CLASH = {
    "chunk": 7, "bucket": "b", "keys": 1.5, "bits": True, "row": 3, "row_hash": "x", "seeds": 9, "seed": 1, "tokens": "t", "item_key": 0, "size": "s", "h": -1, "below": 2, "times": 9, "s": "q", "prefix": 4, "fp": "f",
    "root": 1, "n_words": 8, "removed": 0, "start": 5, "held_out": "no", "score": "high", "spans": 1, "kept_sha256": 2, "part": "p", "target": "t",
}


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(n))
    long, passage = text(90_000), text(70)  # about 400 kB, more than any part that is worked on at a time
    rows = [(0, long, "en", "a"), (1, long[:200_000] + " end", "en", "a"), (2, passage + " " + text(20), "de", "b"), (3, text(9) + " " + passage, "de", None), (4, None, None, "b"), (5, "", "de", None), (6, " \n", None, "b"), (7, passage, "en", "a"), (7, passage, "en", "a"), (None, passage, "de", "b"), (8, "mail a.b@c.org and +1 555 0100 20", "en", "a"), (9, text(40), None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


OPERATORS = {
    "1": substring_dedup,
    "2": simhash_components,
    "3": suffix_dedup,
    "4": lambda d: contaminated(d, d.sparkSession.createDataFrame([(1, d.where("doc_id = 7").first().text, "clash"), (2, None, ""), (3, "", None)], "item_id long, text string, seed string")),
    "7": identify,
    "8": mix,
    "8 copies": lambda d: mixed(d).select("doc_id", "text", "lang", "source"),
    "9": find_pii,
    "10": lambda d: token_output(d, definition_of("word_bpe_49k.json")),
    "12": jaccard_components,
    "13": lambda d: manifest(d.withColumn("n_chars", F.length("text"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(documents, name):
    plain = sorted(map(repr, OPERATORS[name](documents).collect()))
    wide = documents.select(*(F.lit(c).alias(n) for n, c in CLASH.items()), "*").repartition(3)
    assert sorted(map(repr, OPERATORS[name](wide).collect())) == plain
    if name not in ("4", "8 copies"):
        assert len(plain) == documents.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_tables_of_nulls(spark, documents, name):
    if name == "4":  # its benchmark is one of the documents
        items = spark.createDataFrame([(1, documents.where("doc_id = 7").first().text), (2, None)], "item_id long, text string")
        nulls = spark.createDataFrame([(None, None, None, None)] * 3, documents.schema)
        assert contaminated(documents.limit(0), items).collect() == contaminated(nulls, items).collect() == contaminated(documents, items.limit(0)).collect() == []
        return
    assert OPERATORS[name](documents.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, documents.schema)
    assert len(OPERATORS[name](nulls).collect()) == 3


def test_vectors_with_clashing_columns(spark):
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(60)] + [(None, None), (3, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = df.select(*(F.lit("x").alias(c) for c in ("v", "width", "block", "query_block", "query_id", "query", "score", "rank", "part")), "*")
    assert sorted(map(repr, nearest(wide, 10).collect())) == sorted(map(repr, nearest(df, 10).collect()))


def test_a_source_at_its_stop_gives_at_most_three_copies(spark):
    rows = [(i, "w" if i < 3 else None, "small") for i in range(200)] + [(1000 + i, "w " * 500, "large") for i in range(20)]
    df = spark.createDataFrame(rows, T.StructType.fromDDL("doc_id long, text string, source string"))
    copies = {x.doc_id: x.n for x in mixed(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(copies.values()) and max(copies.values()) <= 3 and all(copies[i] == 3 for i in range(200))


def test_learned_groups_are_those_seen_twice(spark):
    rows = [(i, f"common words here x{chr(97 + i % 26)}q", "en") for i in range(60)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "^com" in model.groups and len(set(model.groups)) == len(model.groups) == len(model.logs) - 1


def test_language_against_plain_python(spark, documents):
    """The whole query in plain Python: groups looked up by their text, the best path by trying every change."""
    import itertools
    import re

    from hillspan.llm import language as L

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = learn(docs)
    row = {g: i for i, g in enumerate(model.groups)}
    lines = sorted((t for (t,) in docs.select("text").where("length(text) between 200 and 900").collect()), key=lambda x: hash(x) % 97)[:24]
    texts = [" ".join(x) for x in itertools.batched(lines, 2)] + [lines[0] + " ЖЖ 123 ünï", "²", None]

    def plain(text):
        words = [w for w in re.findall(r"[^\W\d_]+", (text or "").lower()) if any(c.isalpha() for c in w)]
        if not words:
            return "und", 0.0
        score = []
        for w in words:
            m = f"^{w}$"
            at = [row.get(m[i : i + k], len(row)) for k in (3, 4) for i in range(max(1, len(m) - k + 1))]
            total = model.logs[at].sum(axis=0)
            able = model.able[np.searchsorted(L._STARTS, ord(w[0]), side="right") - 1]
            total = np.where(able, total, -np.inf)
            score.append(np.maximum(total - total.max(), -L.MOST))
        value, back = score[0], []
        for s in score[1:]:
            best = [(max((value[j] - (L.PENALTY if j != k else 0), j == k, -j) for j in range(len(value))), k) for k in range(len(value))]
            back.append([k if b[1] else -b[2] for b, k in best])
            value = np.array([b[0] for b, _ in best]) + s
        path = [int(np.argmax(value))]
        for b in reversed(back):
            path.append(b[path[-1]])
        path = path[::-1]
        weight = np.bincount(path, [len(w) for w in words], len(model.languages))
        return model.languages[int(weight.argmax())], weight

    got = [(lang, spans) for lang, _, spans in L.Labeller(model).label(texts)]
    for (lang, spans), text in zip(got, texts, strict=True):
        want, weight = plain(text)
        assert lang == want
        if spans:
            assert sum(s["n_words"] for s in spans) == len(L.words(text))
            by = dict.fromkeys(model.languages, 0)
            words = L.words(text)
            for s in spans:
                by[s["lang"]] += sum(map(len, words[s["first_word"] : s["first_word"] + s["n_words"]]))
            assert [by[k] for k in model.languages] == weight.tolist()
