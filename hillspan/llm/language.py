"""Language identification of mixed-language texts (operator 7).

A word is a run of letters. The script of its first letter, by ranges of code points, narrows its candidates to the
languages in which the training rows write that script. Each candidate scores the word by its letter groups of GROUPS
letters (with marks at both ends) under a smoothed multinomial learned for each language. Viterbi's path over the words'
scores, at a fixed penalty for each change of language, labels spans; a text's language is the one whose spans have the
most letters.

Many texts are scored at once: their code points are one array, equal words (by a 64-bit fingerprint) are scored once, and
letter groups are looked up in a hash table of arrays.

The model is learned from at most about SAMPLE labelled rows, dealt evenly to the languages and chosen by a hash of the
id; it holds every letter group that these rows have LEAST times or more, and goes to all tasks.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import U64, grouped, mix, slices
from .shared import in_arrow

#: Labelled rows to learn from, about (the hash decides each alone); times that a letter group occurs in them, at least.
SAMPLE, LEAST = 8_000, 2
GROUPS = (3, 4)
#: Nats that a change of language costs; by which a word's candidates differ at most.
PENALTY, MOST = 20.0, 12.0
#: Share of a language's words in a script from which the script's words have it as a candidate.
SHARE = 0.01
#: Code points that are scored at a time; words of a text from which its path is found apart from other texts'.
AT_ONCE, LONG = 1 << 20, 4096
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>"

#: First code points of blocks and the script that is written in them up to the next.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "other"),
    (0x20000, "han"),
)
_STARTS = np.array([x[0] for x in SCRIPTS])
_WORD, _GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")


def script(word: str) -> str:
    return SCRIPTS[int(np.searchsorted(_STARTS, ord(word[0]), side="right")) - 1][1]


def words(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    found = _WORD.findall(text.lower())
    return found if text.isascii() else [w for w in found if w.isalpha() or any(c.isalpha() for c in w)]


def groups(word: str) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for n in GROUPS for i in range(max(1, len(marked) - n + 1))]


def _code(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each string of 3 or 4 code points (columns: the first of each, the second, ...): three fit, four are hashed."""
    a, b, c, *rest = (x.astype(U64) for x in columns)
    code = a | b << U64(21) | c << U64(42)
    return mix(code) ^ rest[0] * U64(0x9E3779B97F4A7C15) if rest else code


@dataclass
class Model:
    languages: list[str]
    #: The letter groups, whose logs are the rows of logs; the last row is for groups it doesn't hold.
    groups: list[str]
    logs: np.ndarray
    candidates: dict[str, np.ndarray]

    def __post_init__(self):
        #: For each block of SCRIPTS the languages that its words may be in: all, if no row of the sample has its script.
        every = np.ones(len(self.languages), bool)
        self.able = np.array([self.candidates.get(name, every) for _, name in SCRIPTS])
        self.by_language = np.ascontiguousarray(self.logs.T)
        codes = np.zeros(len(self.groups), U64)
        for n in GROUPS:
            at = np.array([i for i, g in enumerate(self.groups) if len(g) == n], np.int64)
            if len(at):
                points = _points("".join(self.groups[i] for i in at)).reshape(-1, n)
                codes[at] = _code([points[:, j] for j in range(n)])
        # open addressing; no code is 0
        self.bits = max(10, (4 * len(codes)).bit_length())
        self.keys, self.ids = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
        left, place = np.arange(len(codes)), self._place(codes)
        while len(left):
            slot, first = np.unique(place[left], return_index=True)
            free = self.keys[slot] == 0
            put = left[first[free]]
            self.keys[slot[free]], self.ids[slot[free]] = codes[put], put
            left = np.setdiff1d(left, put)
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return (codes * U64(0xD6E8FEB86659FD93) >> U64(64 - self.bits)).astype(np.int64)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of logs for each code."""
        place = self._place(codes)
        key = self.keys[place]
        out = np.where(key == codes, self.ids[place], np.int32(len(self.groups)))
        left = np.flatnonzero((key != codes) & (key != 0))
        while len(left):
            place[left] = (place[left] + 1) & ((1 << self.bits) - 1)
            key = self.keys[place[left]]
            hit = key == codes[left]
            out[left[hit]] = self.ids[place[left[hit]]]
            left = left[~hit & (key != 0)]
        return out

    def scores(self, points: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word (points: the words' code points, one after the other) for each language, less that of its best candidate; at least -MOST."""
        if not len(size):
            return np.zeros((0, len(self.languages)))
        marked = np.empty(len(points) + 2 * len(size), points.dtype)
        begin = np.cumsum(size + 2) - (size + 2)
        marked[begin], marked[begin + size + 1] = ord("^"), ord("$")
        inside = np.ones(len(marked), bool)
        inside[begin] = inside[begin + size + 1] = False
        marked[inside] = points
        place = np.arange(len(marked)) - np.repeat(begin, size + 2)
        total = np.zeros((len(size), len(self.languages)))
        for n in GROUPS:
            many = size + 3 - n  # a group for each place, but for words too short
            whole = many > 0
            at = np.flatnonzero(place < np.repeat(many, size + 2))
            row = self._rows(_code([marked[at + j] for j in range(n)])) if len(at) else at
            if whole.any():
                starts = np.cumsum(many[whole]) - many[whole]
                for k, logs in enumerate(self.by_language):
                    total[whole, k] += np.add.reduceat(logs[row], starts)
            if not whole.all():  # of a single letter, which has one group of three, for both
                at = begin[~whole]
                total[~whole] += self.logs[self._rows(_code([marked[at + j] for j in range(3)]))]
        total = np.where(self.able[np.searchsorted(_STARTS, marked[begin + 1], side="right") - 1], total, -np.inf)
        return np.maximum(total - total.max(axis=1, keepdims=True), -MOST)

    def score(self, words: list[str]) -> np.ndarray:
        return self.scores(_points("".join(words)), np.array([len(w) for w in words], np.int64))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


@functools.cache
def _classes() -> np.ndarray:
    """For each code point: 1 for those of _WORD, 2 more for letters."""
    every = "".join(map(chr, range(0x110000)))
    out = np.fromiter(map(str.isalpha, every), bool, len(every)).astype(np.uint8) * 2
    for m in _WORD.finditer(every):
        out[m.start() : m.end()] |= 1
    return out


_POWERS = np.multiply.accumulate(np.full(1 << 10, 0xA0761D6478BD642F, U64))


def _found(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start in points, their sizes, and their fingerprints."""
    kind = _classes()[points]
    edge = np.flatnonzero(np.diff((kind & 1).view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return start, size, np.zeros(0, U64)
    inside = (kind & 1).view(bool)
    begin = np.cumsum(size) - size
    real = np.bitwise_or.reduceat(kind[inside], begin) >= 2
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    powers = _POWERS[place % len(_POWERS)]
    if size.max() > len(_POWERS):
        powers = powers * mix((place // len(_POWERS)).astype(U64) + U64(1))
    fingerprint = mix(np.add.reduceat((points[inside].astype(U64) + U64(1)) * powers, begin))
    return start[real], size[real], fingerprint[real]


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn(documents: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of documents (doc_id, text, lang) that are not held out and have a language."""
    labelled = documents.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], [], np.zeros((1, 0)), {})
    languages = sorted(counts)
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample / len(languages) / counts[k]))))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in slices(batch, 0)):
            found: Counter = Counter()
            by_lang: dict[str, Counter] = {}
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, Counter()).update(words(text.as_py()))
            for lang, counted in by_lang.items():
                for w, n in counted.items():
                    found[lang, "", script(w)] += n
                    for g in groups(w):
                        found[lang, g, ""] += n
            lang, group, kind = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(group, pa.string()), pa.array(kind, pa.string()), pa.array(found.values(), pa.int64())], ["lang", "grp", "script", "n"])

    counted = chosen.select(F.col("text").cast("string"), "lang").transform(in_arrow, count, "lang string, grp string, script string, n long")
    pivoted = counted.groupBy("grp", "script").agg(*(F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(F.lit(0))).alias(f"n{i}") for i, k in enumerate(languages)), F.sum("n").alias("total"))
    rows = pivoted.where((F.col("grp") == "") | (F.col("total") >= LEAST)).collect()
    features = sorted((r for r in rows if r.grp), key=lambda r: r.grp)
    n = np.array([[r[2 + i] for i in range(len(languages))] for r in features] + [[0] * len(languages)], float).reshape(-1, len(languages)) + 0.5
    scripts = {r.script: np.array([r[2 + i] for i in range(len(languages))], float) for r in rows if not r.grp}
    total = sum(scripts.values(), np.zeros(len(languages))) + 1
    candidates = {k: v / total >= SHARE for k, v in scripts.items()}
    return Model(languages, [r.grp for r in features], np.log(n / n.sum(axis=0)), {k: v for k, v in candidates.items() if v.any()})


def best_path(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The labels with the greatest sum of scores less penalty for each change; of equal ones, the path that stays."""
    n, k = scores.shape
    rows = scores.tolist()
    value, stays, best = rows[0], [], []
    for row in rows[1:]:
        top = max(value)
        b = value.index(top)
        stay = [v >= top - penalty for v in value]
        value = [s + (v if x else top - penalty) for s, v, x in zip(row, value, stay, strict=True)]
        stays.append(stay)
        best.append(b)
    path = [value.index(max(value))]
    for stay, b in zip(reversed(stays), reversed(best), strict=True):
        path.append(path[-1] if stay[path[-1]] else b)
    return np.array(path[::-1])


def paths(scores: list[np.ndarray], penalty: float = PENALTY) -> list[np.ndarray]:
    """best_path() of each, all of them a word at a time."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    size = np.array([len(scores[i]) for i in order])
    table = np.zeros((len(order), size[0], scores[0].shape[1]))
    for row, i in enumerate(order):
        table[row, : size[row]] = scores[i]
    value, back = table[:, 0], []
    for t in range(1, size[0]):
        n = int(np.searchsorted(-size, -t))  # those of more than t words come first
        now, row = value[:n], np.arange(n)
        best = now.argmax(axis=1)
        least = now[row, best][:, None] - penalty
        back.append(np.where(now >= least, np.arange(now.shape[1]), best[:, None]).astype(np.int16))
        value = np.concatenate([np.maximum(now, least) + table[:n, t], value[n:]])
    state = value.argmax(axis=1)
    path = np.zeros((len(order), size[0]), np.int64)
    path[np.arange(len(order)), size - 1] = state
    for t in range(size[0] - 1, 0, -1):
        n = len(back[t - 1])
        state[:n] = back[t - 1][np.arange(n), state[:n]]
        path[:n, t - 1] = state[:n]
    out: list[np.ndarray] = [path[0]] * len(order)
    for row, i in enumerate(order):
        out[i] = path[row, : size[row]]
    return out


def changing(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of each text's scores (first: where its words begin; one more than texts), its best single language, and whether another path may be better.

    Against that language, the base, a path of several languages that has words in the base has a change at least for each
    span in another language, so it is no better if no span gains more than a change costs. A path without the base has a
    change, and gains no more than all words' best gains together. Where both fail to rule out a path, it is to be looked for.
    """
    sums = np.add.reduceat(scores, first[:-1], axis=0)
    base = sums.argmax(axis=1)
    text = np.repeat(np.arange(len(base)), np.diff(first))
    gain = scores - scores[np.arange(len(scores)), base[text]][:, None]
    open_ = (np.add.reduceat(np.maximum(gain, 0), first[:-1], axis=0) > penalty).any(axis=1)
    for i in np.flatnonzero(open_):
        g = gain[first[i] : first[i + 1]]
        upto = np.cumsum(np.vstack([np.zeros(g.shape[1]), g]), axis=0)
        open_[i] = (upto - np.minimum.accumulate(upto, axis=0)).max() > penalty
    gain[np.arange(len(gain)), base[text]] = -np.inf
    return sums, base, open_ | (np.add.reduceat(gain.max(axis=1), first[:-1]) > penalty)


def labels(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """best_path(), at once where changing() rules out any other than one language."""
    _, base, other = changing(scores, np.array([0, len(scores)]), penalty)
    return best_path(scores, penalty) if other[0] else np.full(len(scores), base[0])


class Labeller:
    """A model at work on texts."""

    def __init__(self, model: Model):
        self.model = model

    def _pieces(self, texts: list[str | None]) -> Iterator[tuple[list[int], str, list[int]]]:
        """Texts in lower case, joined up to about AT_ONCE code points, their numbers and their ends; a longer one in pieces, cut between words."""
        held: list[str] = []
        numbers: list[int] = []
        size = 0
        for i, x in enumerate(texts):
            x = (x or "").lower()
            at = 0
            while at < len(x):
                m = _GAP.search(x, at + AT_ONCE) if len(x) - at > AT_ONCE else None
                end = m.start() if m else len(x)
                held.append(x[at:end])
                numbers.append(i)
                size += end - at
                at = end
                if size >= AT_ONCE:
                    yield numbers, "\n".join(held), np.cumsum([len(y) + 1 for y in held]).tolist()
                    held, numbers, size = [], [], 0
        if held:
            yield numbers, "\n".join(held), np.cumsum([len(y) + 1 for y in held]).tolist()

    def words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores and letters of all words, and where each text's words begin in them (one more than texts)."""
        scores, letters, count = [np.zeros((0, len(self.model.languages)))], [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for numbers, joined, ends in self._pieces(texts):
            points = _points(joined)
            start, size, fingerprint = _found(points)
            first, which = grouped(fingerprint)
            n = size[first]
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[first], n)
            scores.append(self.model.scores(points[place], n)[which])
            letters.append(size)
            np.add.at(count, numbers, np.diff(np.searchsorted(start, [0, *ends])))
        return np.concatenate(scores), np.concatenate(letters), np.concatenate([[0], np.cumsum(count)])

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        """Of each text the language, how sure it is, and the spans."""
        out: list[tuple[str, float, list[dict]]] = [(UNKNOWN, 0.0, [])] * len(texts)
        if not self.model.languages:
            return out
        scores, letters, begin = self.words(texts)
        full = np.flatnonzero(np.diff(begin))
        if not len(full):
            return out
        first = begin[np.append(full, len(texts))]
        sums, base, other = changing(scores, first)
        part = [scores[first[i] : first[i + 1]] for i in np.flatnonzero(other)]
        short = [x for x in part if len(x) < LONG]
        found = iter(paths(short) if short else [])
        chosen = {int(i): next(found) if len(x) < LONG else best_path(x) for i, x in zip(np.flatnonzero(other), part, strict=True)}
        for i, text in enumerate(full.tolist()):
            if i in chosen:
                out[text] = self._one(scores[first[i] : first[i + 1]], letters[first[i] : first[i + 1]], chosen[i])
            else:
                lang = self.model.languages[base[i]]
                out[text] = lang, _odds(sums[i], int(base[i])), [{"lang": lang, "first_word": 0, "n_words": int(first[i + 1] - first[i])}]
        return out

    def _one(self, scores: np.ndarray, letters: np.ndarray, path: np.ndarray) -> tuple[str, float, list[dict]]:
        """How sure: the share of letters in the language's spans, times the odds that it beats the next language there."""
        weight = np.bincount(path, letters, scores.shape[1])
        top = int(weight.argmax())
        edge = np.flatnonzero(np.diff(np.concatenate([[-1], path, [-1]])))
        spans = [{"lang": self.model.languages[path[a]], "first_word": int(a), "n_words": int(b - a)} for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return self.model.languages[top], float(weight[top] / letters.sum()) * _odds(scores[path == top].sum(axis=0), top), spans


def _odds(sums: np.ndarray, top: int) -> float:
    margin = float(sums[top] - np.delete(sums, top).max()) if len(sums) > 1 else 50.0
    return 1 / (1 + math.exp(-max(-50.0, min(margin, 50.0))))


def identify(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """RESULT for each row of documents (doc_id, text, lang); without a model, learns one from them first.

    Only the text is looked at for a prediction. Null texts and texts without a letter are UNKNOWN with score 0, and so is
    every text if no row has a language to learn from. A null id counts as an empty one in the choice of held-out rows.
    Rows with the same id or text are rows apart with the same result; a text of any length is read whole, AT_ONCE code
    points at a time. No documents: no rows.
    """
    model = learn(documents) if model is None else model
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in batches:
            rows: list = []
            for piece in slices(b, 2):
                rows += labeller.label(piece.column(2).to_pylist())
            lang, score, spans = zip(*rows, strict=True) if rows else ((), (), ())
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).transform(in_arrow, work, RESULT)


def with_language(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of documents, all columns, whose language is known and has at least a share of least in the text."""
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents))
    at_text = documents.columns.index("text")

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for b in (piece for batch in batches for piece in slices(batch, at_text)):
            found = labeller.label(b.column(at_text).to_pylist())
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in found], pa.bool_()))

    return documents.transform(in_arrow, accepted, documents.schema)
