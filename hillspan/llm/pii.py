"""Personal data by anchor expansion (operator 9).

An Aho-Corasick automaton finds the cues in one pass over a text: at-signs, schemes, plus-and-digit, digit pairs, and
words that introduce an identifier. A deterministic parser of each cue's kind expands to both sides and validates. The
parsers of the four base kinds give exactly the leftmost non-overlapping matches of their patterns:

email  the local part is the whole run of its characters before the at-sign (after the match before), and labels follow
       greedily, since a label's characters exclude the dot that must come next;
ip     runs of digits joined by single dots, four at a time from the left of a dotted chain;
card   a chain of digits with at most one space or hyphen between each two, taken whole;
phone  from a plus and a digit through all characters allowed, back to the last digit.

The added kinds are URLs with their scheme, keys and secrets given by name, and social-security, IBAN and account numbers
after their cue words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import slices
from .shared import in_arrow

#: The base kinds in the order of their digest, then the added ones.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "secret", "ssn", "iban", "account")
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

#: Cue words of identifiers, lower case.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
SECRETS = ("token", "password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key")
ACCOUNTS = ("account", "acct", "konto", "compte", "cuenta")

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'|\\^`{}]+")
_SECRET = re.compile(r"['\"]?\s{0,3}[=:]\s{0,3}['\"]?([A-Za-z0-9_+/=.-]{12,})")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"\s{0,3}(?:no|number|nr|num)?\.?\s{0,3}[:#=]?\s{0,3}([0-9][0-9 -]{4,32}[0-9])(?![0-9])", re.IGNORECASE)
#: Characters after a cue word in which its identifier begins.
NEAR = 40


def _automaton() -> ahocorasick.Automaton:
    cues = {"@": "email"} | {f"+{d}": "phone" for d in DIGITS}
    cues |= {f"{a}.{b}": "ip" for a in DIGITS for b in DIGITS}
    cues |= {f"{a}{s}{b}": "card" for a in DIGITS for b in DIGITS for s in ("", " ", "-")}
    cues |= dict.fromkeys(SCHEMES, "url") | dict.fromkeys(SECRETS, "secret") | dict.fromkeys(ACCOUNTS, "account") | {"ssn": "ssn", "social security": "ssn", "iban": "iban"}
    out = ahocorasick.Automaton()
    for cue, kind in cues.items():
        out.add_word(cue, (kind, len(cue)))
    out.make_automaton()
    return out


_CUES = _automaton()


def luhn(digits: str) -> bool:
    d = [int(x) for x in digits]
    return (sum(d[-1::-2]) + sum(x * 2 - 9 * (x > 4) for x in d[-2::-2])) % 10 == 0


def _left(text: str, at: int, least: int, allowed) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


class _Parsers:
    """What each cue expands to in one text; a kind's matches don't overlap."""

    def __init__(self, text: str):
        self.text = text
        self.found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + ADDED}
        self.done = dict.fromkeys(BASE + ADDED, 0)

    def email(self, at: int, _end: int) -> None:
        start = _left(self.text, at, self.done["email"], LOCAL)
        if start < at and (m := _DOMAIN.match(self.text, at + 1)):
            self.found["email"].append((start, m.end()))
            self.done["email"] = m.end()

    def ip(self, at: int, _end: int) -> None:
        """at: a digit before a dot and a digit. The chain is matched from its left, or from where the last match ended."""
        if at < self.done["ip"]:
            return
        start = _left(self.text, at, self.done["ip"], DIGITS)
        m = _DOTTED.match(self.text, start)
        if m:
            self.done["ip"] = m.end()
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                self.found["ip"].append(m.span())

    def card(self, at: int, _end: int) -> None:
        if at < self.done["card"]:
            return
        m = _CHAIN.match(self.text, at)  # cues come from the left, so this one begins its chain
        self.done["card"] = m.end()
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            self.found["card"].append(m.span())

    def phone(self, at: int, _end: int) -> None:
        if at >= self.done["phone"] and (m := _PHONE.match(self.text, at)):
            self.done["phone"] = m.end()
            if 8 <= sum(x in DIGITS for x in m[0]) <= 15:
                self.found["phone"].append(m.span())

    def url(self, at: int, end: int) -> None:
        if at >= self.done["url"] and (m := _URL.match(self.text, end)):
            stop = end + len(m[0].rstrip(".,;:!?)]*"))
            if stop > end:
                self.found["url"].append((at, stop))
                self.done["url"] = stop

    def secret(self, _at: int, end: int) -> None:
        if end >= self.done["secret"] and (m := _SECRET.match(self.text, end)):
            self.found["secret"].append(m.span(1))
            self.done["secret"] = m.end(1)

    def ssn(self, _at: int, end: int) -> None:
        if m := _SSN.search(self.text, max(end, self.done["ssn"]), end + NEAR):
            self.found["ssn"].append(m.span())
            self.done["ssn"] = m.end()

    def iban(self, _at: int, end: int) -> None:
        for m in _IBAN.finditer(self.text, max(end, self.done["iban"]), end + 2 * NEAR):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                self.found["iban"].append(m.span())
                self.done["iban"] = m.end()
                return

    def account(self, _at: int, end: int) -> None:
        if end >= self.done["account"] and (m := _ACCOUNT.match(self.text, end)):
            self.found["account"].append(m.span(1))
            self.done["account"] = m.end(1)


def personal_data(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive, ascending."""
    p, lower = _Parsers(text), text.lower()
    if len(lower) != len(text):  # a few letters have longer lower cases; cues are ASCII, so lowering A to Z is enough
        lower = text.translate(_ASCII_LOWER)
    for last, (kind, n) in _CUES.iter(lower):
        getattr(p, kind)(last + 1 - n, last + 1)
    return p.found


_ASCII_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def find_pii(documents: DataFrame) -> DataFrame:
    """RESULT for each row of documents (doc_id, text): counts and digest of the base kinds, spans of all.

    Null text counts as empty: no spans and the hash of the empty string. Rows with the same id are rows apart. A text of
    any length is read whole, some texts at a time. No documents: no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in slices(batch, 1)):
            rows = []
            for x in b.column(1):
                found = personal_data(x.as_py() or "")
                rows.append((*(len(found[k]) for k in BASE), hashlib.sha256(joined(found, BASE).encode()).hexdigest(), joined(found, BASE + ADDED)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in RESULT.split(", ")])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(in_arrow, work, RESULT)


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become the first one's."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, spans in personal_data(text).items() for s, e in spans):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
