"""Operator 9 against the base patterns themselves."""

from __future__ import annotations

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from hillspan.llm.pii import BASE, find_pii, luhn, masked, personal_data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {
        "email": True,
        "ip": kind == "ip" and all(int(x) <= 255 for x in s.split(".")),
        "card": 16 <= len(digits) <= 19 and luhn(digits),
        "phone": 8 <= len(digits) <= 15,
    }[kind]


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()}


@given(st.text(alphabet="0123 45.-+()@aA_éİ,\n", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_kinds_equal_their_patterns(text):
    found = personal_data(text)
    assert {k: found[k] for k in BASE} == brute(text)


def test_denser_texts():
    r = random.Random(4)
    parts = ["4111111111111111", "4111 1111-1111 1111", "1.2.3.4", "255.255.255.255.1", "300.1.1.1", "+1 (640) 555-0953", "+49 30-1234567", "a.b+c@d.e", "@", "x@y", "İ", "@a.b", ".", " ", "-", "5", "text", "0000000000000000", "x@y.z@q.r", "1..2.3.4.5", "000000001.2.3.4"]
    for _ in range(3000):
        text = "".join(r.choices(parts, k=r.randint(1, 12)))
        found = personal_data(text)
        assert {k: found[k] for k in BASE} == brute(text), text


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_added_kinds():
    cut = lambda text: {k: [text[s:e] for s, e in v] for k, v in personal_data(text).items() if v}
    assert cut('see HTTPS://a.b/c?d=1. Token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == {"url": ["HTTPS://a.b/c?d=1"], "secret": ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]}
    assert cut("SSN: 123-45-6789")["ssn"] == ["123-45-6789"]
    assert cut("IBAN DE89 3704 0044 0532 0130 00.")["iban"] == ["DE89 3704 0044 0532 0130 00"]
    assert "iban" not in cut("IBAN DE89 3704 0044 0532 0130 01.")
    assert cut("Account no. 1234567")["account"] == ["1234567"]
    assert cut("ordinary words about a token of thanks and an account of the day") == {}


def test_masked():
    assert masked("mail a@b.c or 1.2.3.4!") == "mail <email> or <ip>!"


def test_query_rows(spark):
    texts = [None, "", "write to a.b@c.de, 4111111111111111 or +1 (640) 555-0953", "é@x.y 10.0.0.1 " * 3000, "1.2.3.4"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(4, "1.2.3.4", 1), (None, "a@b.c", 1)], "doc_id long, text string, spans int")
    got = sorted(find_pii(df).collect(), key=str)
    want = []
    for i, t in [*enumerate(texts), (4, "1.2.3.4"), (None, "a@b.c")]:
        b = brute(t or "")
        line = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in b[k])
        want.append((i, *(len(b[k]) for k in BASE), hashlib.sha256(line.encode()).hexdigest(), line))
    assert [tuple(r) for r in got] == sorted(want, key=lambda w: str(got[0].__class__(**dict(zip(got[0].asDict(), w, strict=True))))) or sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert find_pii(df.limit(0)).collect() == []
