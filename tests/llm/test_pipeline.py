"""The pipeline's stages, each on its own input, and its end against plain Python."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
from hillspan.llm.language import Labeller, learn
from hillspan.llm.mixing import SQL
from hillspan.llm.simhash import fingerprint
from hillspan.llm.tiling import tile, tokens_of
from hillspan.llm.tokens import definition_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def sets_of(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9000, "12 34 ...", "en", "src1", 9), (9001, None, None, None, None), (9002, docs.first().text, "en", "src2", 1), (9002, docs.first().text, "en", "src2", 1)], docs.schema)
    docs = docs.unionByName(extra)
    rows = [r.asDict() for r in docs.collect()]
    item_words = [tokens_of(r.text).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    labeller = Labeller(learn(docs))
    want = [r for r in rows if (x := labeller.label([r["text"]])[0])[0] != "und" and x[1] >= 0.5]
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert out.columns == COLUMNS and ids(out) == sorted(r["doc_id"] for r in want) and len(want) == len(rows) - 2

    shingles = [sets_of(r["text"]) for r in want]
    prints = [int.from_bytes(fingerprint((r["text"] or "").encode()), "big") for r in want]
    label = list(range(len(want)))
    changed = True
    while changed:
        changed = False
        for i in range(len(want)):
            for j in range(len(want)):
                near = (prints[i] ^ prints[j]).bit_count() <= 2 or 10 * len(shingles[i] & shingles[j]) >= 8 * len(shingles[i] | shingles[j])
                if near and label[j] < label[i]:
                    label[i], changed = label[j], True
    kept = sorted({label[i]: None for i in range(len(want))})
    best = sorted(min(want[i]["doc_id"] for i in range(len(want)) if label[i] == g) for g in kept)
    second = corpus_pipeline.near_dedup(spark, out, SF)
    assert second.columns == COLUMNS and ids(second) == best and len(best) < len(want)

    def clean(text):
        words = tokens_of(text).split()
        return not any(len(a) >= 5 and sum(n for *_, n in tile(a, words)) >= 0.6 * len(a) for a in item_words)

    by_id = {r["doc_id"]: r for r in want}
    left = [i for i in best if clean(by_id[i]["text"])]
    third = corpus_pipeline.decontamination(spark, second, SF)
    assert third.columns == COLUMNS and ids(third) == left and len(left) < len(best)

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, by_id[i]["text"], by_id[i]["source"]) for i in left], columns=["doc_id", "text", "source"]))
    taken = {i: n // size for i, size, _, _, n in con.sql(SQL).fetchall()}
    fourth = corpus_pipeline.mixing(spark, third, SF)
    assert fourth.columns == COLUMNS and Counter(ids(fourth)) == Counter({i: n for i, n in taken.items() if n})

    t, start, last = Tokenizer.from_str(definition_of("word_bpe_49k.json")), 0, []
    for i in sorted(taken):
        for _ in range(taken[i]):
            x = np.array([*t.encode(by_id[i]["text"], add_special_tokens=False).ids, 2], "<u4")
            last.append((i, start, len(x), zlib.crc32(x.tobytes())))
            start += len(x)
    assert [tuple(r) for r in corpus_pipeline.tokens(spark, fourth, SF).orderBy("start").collect()] == last


def test_run_chains_the_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "tokens"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_keep_clashing_columns(spark):
    clash = {c: F.lit(7) for c in ("_row", "_HIT", "_times", "_copy", "_source", "fp", "root", "row_hash", "keys", "size", "h", "below")}
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").withColumns(clash)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [*COLUMNS, *clash]
    assert all(r._row == 7 and r._copy == 7 for r in docs.collect()) and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
