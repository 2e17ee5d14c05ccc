"""Operator 7: paths against brute force, held-out accuracy, and texts without a language."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hillspan.llm.language import UNKNOWN, best_path, identify, labels, learn, script, words

DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"


def value(scores, path, penalty):
    return sum(scores[i][k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))


@given(st.lists(st.lists(st.integers(-9, 0), min_size=3, max_size=3), min_size=1, max_size=6), st.integers(0, 12))
@settings(max_examples=200, deadline=None)
def test_path_is_the_best(scores, penalty):
    best = max(value(scores, p, penalty) for p in itertools.product(range(3), repeat=len(scores)))
    for f in (best_path, labels):
        assert value(scores, f(np.array(scores, float), penalty).tolist(), penalty) == best


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCUMENTS)
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_spans_of_a_mixed_text_and_hard_texts(spark):
    docs = spark.read.parquet(DOCUMENTS)
    model = learn(docs)
    some = {r.lang: r.text for r in docs.where("length(text) between 900 and 1500").dropDuplicates(["lang"]).collect()}
    mixed = some["en"] + "\n" + some["es"]
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 _ ² ..."), (5, "Ж"), (6, some["de"] * 40), (None, some["fr"]), (6, some["de"])]
    df = spark.createDataFrame([(i, t, "xx", 0.5) for i, t in rows], "doc_id long, text string, lang string, score double")
    got = {(r.doc_id, r.lang_pred): r for r in identify(df, model).collect()}
    assert {x.lang for x in got[1, max(some, key=lambda k: len(some[k]) if k in ("en", "es") else 0)].spans} == {"en", "es"}
    assert sum(x.n_words for x in next(r for k, r in got.items() if k[0] == 1).spans) == len(words(mixed))
    assert [got[i, UNKNOWN].score for i in (2, 3, 4)] == [0, 0, 0]
    assert got[5, next(k[1] for k in got if k[0] == 5)].lang_pred in model.languages
    assert got[6, "de"].score > 0.9 and got[None, "fr"].held_out == (zlib.crc32(b"") % 4 == 2)


def test_scripts():
    assert [script(x) for x in ("a", "é", "λ", "Ж", "ע", "ب", "日", "か", "한")] == ["latin", "latin", "greek", "cyrillic", "hebrew", "arabic", "han", "kana", "hangul"]


def test_script_narrows_candidates(spark):
    rows = [(i, "мама мыла раму и окно " * 3, "ru") for i in range(40)] + [(i, "the cat sat on the mat " * 3, "en") for i in range(40, 80)]
    model = learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.candidates["cyrillic"].tolist() == [False, True]
    assert model.score(["cat"])[0].tolist()[0] == 0 and model.score(["ccc"])[0].argmax() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in identify(df).collect()] == [UNKNOWN]
    assert identify(df.limit(0)).collect() == []


def test_long_texts_in_pieces(spark, monkeypatch):
    """A text that is scored in pieces, cut between words, has the words and spans of the whole one."""
    from hillspan.llm import language
    from hillspan.llm.language import Labeller

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = learn(docs)
    some = [r.text for r in docs.where("length(text) > 400").orderBy("doc_id").limit(30).collect()]
    texts = [" ".join(some), "x" * 5000 + " " + some[0], None, some[1], "", "a" * 3000]
    whole = Labeller(model).label(texts)
    for size in (100, 1000, 4096):
        monkeypatch.setattr(language, "AT_ONCE", size)
        assert Labeller(model).label(texts) == whole
    assert whole[0][2] and sum(s["n_words"] for s in whole[0][2]) == len(words(texts[0]))
