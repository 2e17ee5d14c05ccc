"""Operator 10: packing round trips, and files against the tokenizer's own ids."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hillspan.llm import tokens
from hillspan.llm.tokens import Shard, WordEncoder, bits_for, definition_of, pack, read_ids, token_output, unpack, write_shard

NAME = "word_bpe_49k.json"
TEXTS = [
    None, "", "  ", "One two, three.", "It's we'll they've 'tis", "naïve Ünï É́ é", "a b　c d ́x", "<|startoftext|> <|STARTOFTEXT|> x<|endoftext|>y", "50% of 1,234.56!! ... ---",
    "tail. tail, tail; tail: tail! tail? tail.. tail., 9. 9, É. é,", "ǅ ﬁ Σς ΑΣ İi", "日本語 テキスト。", "x" * 30000, "\x1c\x85 a\x1cb", "HELLO Hello hello hello. Hello,", "l'été d'un 'S 'LL", "don't. y'all's,", "a.b c,d",
]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200), st.integers(1, 32))
@settings(max_examples=200, deadline=None)
def test_packing_round_trip(ids, bits):
    ids = np.array([x % (1 << bits) for x in ids], np.uint32)
    data = pack(ids, bits)
    assert len(data) == -(-len(ids) // 8) * bits
    assert (unpack(data, len(ids), bits) == ids).all()


def test_shard_random_access(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    r = np.random.default_rng(1)
    ids, lengths = r.integers(0, 49408, 1000).astype(np.uint32), np.array([1, 0, 500, 63, 64, 372])
    s = Shard(write_shard([5, None, 7, 8, 9, 10], lengths, ids, 16))
    assert s.doc_ids == [5, None, 7, 8, 9, 10] and (s.document(3) == ids[501:564]).all() and len(s.document(1)) == 0
    for a, b in r.integers(0, 1001, (50, 2)):
        assert (s.tokens(min(a, b), max(a, b)) == ids[min(a, b) : max(a, b)]).all()


def test_bits():
    assert [bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@given(st.lists(st.text(max_size=60), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_give_the_ids_of_texts(texts):
    e = _encoder()
    direct = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.texts([t.encode() for t in texts])] == direct


def test_every_code_point_gives_the_ids_of_whole_texts():
    """Around each: capitals it may combine with, letters, digits and marks before and after it, and ends of words."""
    e = _encoder()
    around = "K{0}. a{0}b, T{0} H{0}!! 9{0} {0} .{0}. {0}, It{0}'s. x.{0} J{0}. W{0}; y{0}"
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    # ideographs, Hangul and what is not assigned neither change case nor join ASCII letters: fewer surroundings, many in a text
    plain = re.compile("[\u3400-\u9fff\uac00-\ud7a3\ue000-\uf8ff\U00020000-\U0010ffff]")
    few = [f"K{c}." for c in points if plain.match(c)]
    every = [around.format(c) for c in points if not plain.match(c)] + [" ".join(few[i : i + 256]) for i in range(0, len(few), 256)]
    for at in range(0, len(every), 1 << 13):
        texts = every[at : at + (1 << 13)]
        direct = e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        got = e.texts([t.encode() for t in texts])
        wrong = [t for t, x, y in zip(texts, direct, got, strict=True) if np.array(x.ids, "<u4").tobytes() != y]
        assert not wrong, wrong[:5]


ODD = st.sampled_from([*"aKİıǰẖßſΣ", *"HTWYJ", "\u0307", "\u0331", "\u0338", "\u0301", "'", "'s", ".", ",", "<", "!!", " ", "\n", "\u3000", "\u0085", "9", "²", "日", "가", "<|endoftext|>", "<|EndOfText|>", "|>"])


@given(st.lists(st.lists(ODD, max_size=14).map("".join), max_size=6))
@settings(max_examples=300, deadline=None)
def test_words_give_the_ids_of_odd_texts(texts):
    test_words_give_the_ids_of_texts.hypothesis.inner_test(texts)


def test_marks_after_a_letter_of_two_in_lower_case():
    text = "ANTALYA Kİ. DEVAMI VAR İ, SON"
    want = _encoder().tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(_encoder().texts([text.encode()])[0], "<u4").tolist() == want


def test_long_texts_in_pieces_and_keys_that_clash(monkeypatch):
    e = _encoder()
    text = "One two, three. " * 40 + "x" * 300 + "\u0301 É. <|endoftext|>.\n" * 7 + "y" * 90
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    for size in (17, 64, 1000):
        monkeypatch.setattr(tokens, "PIECE", size)
        assert np.frombuffer(e.texts([text.encode()])[0], "<u4").tolist() == want
    monkeypatch.setattr(tokens, "mix", lambda x: x & np.uint64(3))
    assert np.frombuffer(e.texts([text.encode()])[0], "<u4").tolist() == want
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    for _ in range(3):
        assert [np.frombuffer(x, "<u4").tolist() for x in e.texts([text.encode(), b"", b"a b new" + str(_).encode()])][0] == want


def test_clashing_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", 7, "x"), (1, "a b", 8, "y"), (None, None, 9, None)], "doc_id long, text string, start long, ids string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output(df, definition_of(NAME)).collect())
    assert got == [(0, None, 1), (1, 1, 3), (4, 1, 3)]


def _encoder(cache=[]):  # noqa: B006
    if not cache:
        cache.append(WordEncoder(definition_of(NAME)))
    return cache[0]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        WordEncoder(definition_of("byte_bpe_50k.json"))


def test_files_hold_the_tokenizers_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD", 40)
    rows = [(100 - i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (90, "again", 1), (90, "Again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(5)
    path = str(tmp_path / "tokens")
    got = [tuple(r) for r in token_output(df, definition_of(NAME), path).orderBy("start").collect()]
    t, start, want = Tokenizer.from_str(definition_of(NAME)), 0, []
    for i, text, _ in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert sum(len(r.ids) for r in read_ids(spark, path).collect()) == start


def test_empty_table(spark):
    assert token_output(spark.createDataFrame([], "doc_id long, text string"), definition_of(NAME)).collect() == []
