"""Main text of web pages with host suffix arrays (operator 6).

A scanner divides a page into blocks and marks each: in an article element, in a main element, in an element whose tag,
role, class or id says that it is a menu, header, footer, sidebar, notice, advert, form or comments, or in none. All blocks are the
page's token stream. The streams of a host's pages, one after the other, get a suffix array, ordered by the first RUN
tokens; suffixes next to each other that share them (a longest common prefix of RUN or more) are one repeated substring,
and one on PAGES distinct pages or more, and on SHARE of the host's, is boilerplate. A block that such substrings cover
goes as a whole; unique runs of blocks stay.

What an article element holds stays all the same: nothing but the article is there, and a line that it shares with others
is its own. Where most of a page's text repeats, the page is a copy and no template, and keeps its blocks. The marks then
choose among what is left: blocks with a cue go, and an article, or a main element, stands for the page unless it is a
teaser.

A host's streams are dealt into chunks of a bounded size. A substring on SHARE of a large host's pages is on that share of
one chunk's pages at least, so the chunks propose what is frequent in them, count what any of them has proposed, and their
counts add up: exact counts of what matters, and little to move.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .rolling import U64, Texts, grouped, mix, slices, spans, windows
from .shared import broadcast_if_few, checkpointed, in_arrow

#: Tokens of the shortest repeated substring (a power of two); distinct pages, and share of the host's pages, that have one that is boilerplate, at least.
RUN, PAGES, SHARE = 4, 3, 0.05
#: Share of a block's tokens that boilerplate covers, from which the block goes; share of a page's tokens without a cue that must be left, or the page is a copy.
COVERED, LEFT = 0.9, 0.2
#: Tokens of other blocks to one of the article's or main element's beyond which that is a teaser.
TEASER = 2
#: Bytes of a chunk of pages, at least and at most, and about a sixteenth of all pages between; pages of a large host's chunk, about, at least.
LEAST_CHUNK, CHUNK, CHUNK_PAGES = 1 << 20, 8 << 20, 120
#: Rows that a large host's substrings come in.
PIECES = 64
RESULT = "page_id long, url string, text string, n_chars long"
#: Marks of blocks.
ARTICLE, MAIN, PLAIN, CUED = 0, 1, 2, 3

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select object canvas math audio video head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
BOILERPLATE = frozenset("nav aside footer form menu dialog button fieldset".split())
SPACED = frozenset("br td th wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog toolbar".split())
CUES = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar sidenav aside footer masthead topbar toolbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup signin login share sharing social comment comments respond replies reply disqus related recommended recommendations pagination pager skip search widget copyright legal disclaimer hidden".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_PARTS = re.compile(r"[a-z0-9]+")
_CLOSERS = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}


def _cued(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its tag, role, class or id. A header in an article is the article's."""
    if name in BOILERPLATE or (name == "header" and not inside):
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main") and any(x in CUES for x in _PARTS.findall(value)):
            return True
        if key in ("class", "id") and name == "article" and any(x in ("comment", "comments", "reply", "ad", "related") for x in _PARTS.findall(value)):
            return True
    return False


def blocks(page: str) -> list[tuple[int, str]]:
    """Marks and texts of the page's blocks in order; empty ones left out."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    #: Open containers: name, whether it is an article, a main element, boilerplate.
    stack: list[tuple[str, bool, bool, bool]] = []
    #: How many of a name are open, and the places of the boilerplate in the stack: no tag looks through the stack.
    opened: Counter[str] = Counter()
    cued_at: list[int] = []
    articles = mains = cues = links = 0
    linked = total = at = 0

    def text(piece: str) -> None:
        nonlocal linked, total
        piece = html.unescape(piece) if "&" in piece else piece
        held.append(piece)
        total += len(piece)
        linked += len(piece) if links else 0

    def flush() -> None:
        nonlocal linked, total
        if held:
            words = " ".join("".join(held).split())
            if words:
                mark = CUED if cues else ARTICLE if articles else CUED if linked * 2 > total else MAIN if mains else PLAIN
                out.append((mark, words))
            held.clear()
        linked = total = 0

    def pop(to: int) -> None:
        nonlocal articles, mains, cues
        while len(stack) > to:
            name, article, inside, cue = stack.pop()
            opened[name] -= 1
            articles -= article
            mains -= inside
            cues -= cue
            if cue:
                cued_at.pop()

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if name == "a":
            links = 0 if closing else 1
        elif name in SPACED:
            held.append(" ")
        if name in BLOCKS:
            flush()
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                flush()
                i = len(stack) - 1
                while stack[i][0] != name:  # all of these are closed with it
                    i -= 1
                pop(i)
            continue
        if name in RAW:
            if attributes.endswith("/"):
                continue
            m = (_CLOSERS[name] if name != "head" else _HEAD).search(page, at)
            at = end if m is None else m.end() if name != "head" else (m.end() if m[0].startswith("</") else m.start())
            continue
        article, inside = name == "article", name == "main" or (bool(attributes) and 'role="main"' in attributes.lower())
        cue = _cued(name, attributes, articles + mains > 0)
        if (article or inside) and not cue and cues and not articles + mains:
            if stack[cued_at[0]][0] in ("nav", "form", "header", "footer"):  # a menu or form left open does not hold the article
                pop(cued_at[0])
        if name in BLOCKS or cue or article or inside:
            if name == "p" and not cue and not inside:
                continue
            if cue and name not in BLOCKS:
                flush()
            if cue:
                cued_at.append(len(stack))
            stack.append((name, article, inside, cue))
            opened[name] += 1
            articles += article
            mains += inside
            cues += cue
    flush()
    return out


#: A head ends at its end tag, or where the body begins.
_HEAD = re.compile(r"</head\s*>|<(?:body|article|main|nav|div|p|h1)\b", re.IGNORECASE)


def _packed(page: str) -> bytes:
    return pa.compress((data := json.dumps(blocks(page), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")), codec="zstd", asbytes=True) + len(data).to_bytes(8, "little")


def _opened(blob: bytes) -> list:
    return json.loads(pa.decompress(blob[:-8], decompressed_size=int.from_bytes(blob[-8:], "little"), codec="zstd", asbytes=True).decode("utf-8", "surrogatepass"))


def suffix_array(symbols: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes ordered by their first run symbols, and the class of equal ones for each suffix, by doubling; suffixes shorter than run are left out."""
    _, rank = grouped(symbols)
    span = 1
    while span < run:
        rank = grouped(rank[:-span] * np.int64(len(symbols)) + rank[span:])[1] if len(rank) > span else np.zeros(0, np.int64)
        span *= 2
    return np.argsort(rank, kind="stable"), rank


class _Streams:
    """The token streams of a chunk of pages, in the order of (page_id, url, blob)."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("page_id", "ascending"), ("url", "ascending"), ("blob", "ascending")])
        self.table = table
        self.blocks = [_opened(x) for x in table.column("blob").to_pylist()]
        t = Texts(pa.array(["\n".join(words for _, words in page) for page in self.blocks], pa.large_string()))
        start, end, self.first = t.words()
        self.tokens = spans(t.buf, start, end, 0)
        self.row = np.repeat(np.arange(t.n), np.diff(self.first))
        #: Numbers of the row's host and page; rows of one page come together.
        self.host, self.key = (grouped(table.column(c).to_numpy())[1] for c in ("host", "page"))
        self.of_host = np.bincount(self.host[grouped(self.key)[0]], minlength=int(self.host.max()) + 1)
        n = len(self.tokens) - RUN + 1
        #: Starts of RUN tokens of one page.
        self.at = np.flatnonzero(self.row[: max(n, 0)] == self.row[RUN - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The suffix array: starts in order, where each class of RUN equal tokens begins in it, and the pages and the host of each."""
        symbols = mix(self.tokens ^ mix(self.host[self.row].astype(U64)))
        order, rank = suffix_array(symbols, RUN)
        inside = np.zeros(len(rank), bool)
        inside[self.at] = True
        order = order[inside[order]]
        if not len(order):
            return order, order, order, order
        # neighbours of one rank have RUN tokens or more in common
        new = np.diff(rank[order], prepend=-1) != 0
        begin = np.flatnonzero(new)
        # within a class, suffixes come in the order of the rows
        other = np.diff(self.key[self.row[order]], prepend=-1) != 0
        return order, begin, np.add.reduceat(new | other, begin, dtype=np.int64), self.host[self.row[order[begin]]]

    def grams(self, at: np.ndarray) -> np.ndarray:
        return windows(self.tokens, RUN, 0)[at] if len(at) else np.zeros(0, U64)

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Whether each token is one of RUN from at on."""
        change = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + RUN, -1)
        return np.cumsum(change[:-1]) > 0


def least_pages(pages: np.ndarray, least: int, share: float) -> np.ndarray:
    """Distinct pages from which a substring is boilerplate, by the host's pages."""
    return np.maximum(least, np.ceil(pages * share).astype(np.int64))


def main_text(page: list, covered: np.ndarray) -> str:
    """The text of one page's blocks; covered: whether boilerplate covers each token of its stream."""
    at, found = 0, []
    for mark, words in page:
        n = words.count(" ") + 1
        found.append((mark, words, n, mark != ARTICLE and covered[at : at + n].sum() >= COVERED * n))
        at += n
    plain = [x for x in found if x[0] != CUED]
    if sum(n for *_, n, gone in plain if not gone) >= LEFT * sum(x[2] for x in plain):
        plain = [x for x in plain if not x[3]]
    for mark in (ARTICLE, MAIN):
        inside = [x for x in plain if x[0] <= mark]
        size = sum(x[2] for x in inside)
        if inside and sum(x[2] for x in plain) - size <= TEASER * size:
            plain = inside
            break
    return "\n\n".join(x[1] for x in plain)


def _texts(s: _Streams, at: np.ndarray) -> pa.Table:
    """The result's rows; at: where boilerplate starts."""
    covered = s.covered(at)
    texts = [main_text(page, covered[s.first[i] : s.first[i + 1]]) for i, page in enumerate(s.blocks)]
    return pa.table({"page_id": s.table.column("page_id"), "url": s.table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})


#: Substrings of hosts that go to all tasks, at most; beyond them they are joined by shuffle.
FEW_GRAMS = 1 << 20
#: A large host's chunk in one row, its pages as an Arrow stream.
PACKED = "chunk long, host long, pages long, rows binary"
COUNTED = "host long, gram long, n long"


def _pack(t: pa.Table) -> pa.Table:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as out:
        out.write_table(t)
    n = len(grouped(t.column("page").to_numpy())[0])
    return pa.table({"chunk": t.column("chunk")[:1], "host": t.column("host")[:1], "pages": pa.array([n], pa.int64()), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def _unpacked(rows: bytes) -> _Streams:
    return _Streams(pa.ipc.open_stream(rows).read_all())


def _with_grams(packed: DataFrame, grams: DataFrame, work: Callable[[_Streams, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """work on every chunk of packed and the substrings of its host, from grams (host, gram): to all tasks if they are few, else in PIECES rows a chunk."""
    grams = checkpointed(grams)
    if grams.limit(FEW_GRAMS + 1).count() <= FEW_GRAMS:
        lists = grams.groupBy("host").agg(F.collect_list("gram").alias("grams"))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows, asked in zip(b.column(0), b.column(1), strict=True):
                    yield from work(_unpacked(rows.as_py()), asked.values.to_numpy().view(U64) if asked.is_valid else np.zeros(0, U64)).to_batches()

        return packed.join(F.broadcast(lists), "host", "left").select("rows", "grams").transform(in_arrow, each, schema)
    pieces = grams.groupBy("host", F.pmod("gram", F.lit(PIECES)).alias("piece")).agg(F.collect_list("gram").alias("grams"))
    asked = packed.select(F.col("chunk").alias("asking"), "host").join(pieces, "host").select("asking", "grams")

    def both(t: pa.Table, asked: pa.Table) -> pa.Table:
        lists = [x.values.to_numpy() for x in asked.column("grams")]
        return work(_unpacked(t.column("rows")[0].as_py()), np.concatenate(lists).view(U64) if lists else np.zeros(0, U64))

    return packed.groupBy("chunk").cogroup(asked.groupBy("asking")).applyInArrow(both, schema)


def extract(pages: DataFrame, least: int = PAGES, share: float = SHARE) -> DataFrame:
    """RESULT for each row of pages (page_id, url, html; other columns are not looked at).

    least, share: distinct pages, and share of its host's, that have a substring which is boilerplate.

    Null and empty html give an empty text; pages without a host in their url, or with a null one, are one host's. Rows with
    the same page_id and url are one page for the purpose of repeats, and rows of the result each. A page of any length is
    read whole. No pages: no rows.
    """
    columns = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    keyed = columns.select("page_id", "url", F.xxhash64("page_id", "url").alias("page"), F.xxhash64(host).alias("host"), "html")
    sizes = checkpointed(keyed.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"), F.count("*").alias("rows")))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    chunk = max(LEAST_CHUNK, min(CHUNK, total // 16))
    # what is on a share of a host's pages is on that share of a chunk's; a chunk has so many pages that this says something
    parts = F.greatest(F.lit(1), F.least(F.ceil(F.col("bytes") * 2 / chunk), F.floor(F.col("rows") / CHUNK_PAGES)))
    large = checkpointed(sizes.where(F.col("bytes") > chunk).select("host", parts.alias("parts")))
    dealt = keyed.join(broadcast_if_few(large), "host", "left")
    # small hosts share bins, whole; a large host has chunks of its own
    small = dealt.where("parts is null").withColumn("chunk", F.pmod(F.col("host"), F.lit(2 * total // chunk + 1)))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for batch in batches for piece in slices(batch, 5)):
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([_packed(x.as_py()) for x in b.column(5)], pa.binary())], ["chunk", "page_id", "url", "page", "host", "blob"])

    def parsed(df: DataFrame) -> GroupedData:
        rows = df.select("chunk", "page_id", "url", "page", "host", "html").transform(in_arrow, parse, "chunk long, page_id long, url string, page long, host long, blob binary")
        return rows.groupBy("chunk")

    def whole(t: pa.Table) -> pa.Table:
        s = _Streams(t)
        order, begin, pages, host = s.classes()
        often = pages >= least_pages(s.of_host, least, share)[host]
        return _texts(s, order[np.repeat(often, np.diff(np.append(begin, len(order))))])

    out = parsed(small).applyInArrow(whole, RESULT)
    if not large.limit(1).count():
        return out
    # a large host's pages are read and dealt once
    packed = checkpointed(parsed(dealt.where("parts is not null").withColumn("chunk", F.xxhash64("host", F.pmod(F.col("page"), F.col("parts"))))).applyInArrow(_pack, PACKED))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The substrings that may be boilerplate on a chunk's host."""
        for b in batches:
            for host, n, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = _unpacked(rows)
                order, begin, pages, _ = s.classes()
                # on share of the host's pages or more (least is no fewer where it is the bound), so on share of some chunk's
                found = s.grams(order[begin[pages >= share * n]]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), host, np.int64)), pa.array(found)], ["host", "gram"])

    def count(s: _Streams, asked: np.ndarray) -> pa.Table:
        grams = s.grams(s.at)
        hit = np.isin(grams, asked)
        found = np.unique(np.stack([grams[hit].view(np.int64), s.key[s.row[s.at[hit]]]]), axis=1)[0]
        gram, n = np.unique(found, return_counts=True)
        return pa.table({"host": pa.array([s.table.column("host")[0].as_py()] * len(gram), pa.int64()), "gram": pa.array(gram, pa.int64()), "n": pa.array(n, pa.int64())})

    def finish(s: _Streams, frequent: np.ndarray) -> pa.Table:
        return _texts(s, s.at[np.isin(s.grams(s.at), frequent)])

    candidates = packed.select("host", "pages", "rows").transform(in_arrow, propose, "host long, gram long").distinct()
    counted = _with_grams(packed, candidates, count, COUNTED).groupBy("host", "gram").agg(F.sum("n").alias("n"))
    counted = counted.join(packed.groupBy("host").agg(F.sum("pages").alias("pages")), "host")
    frequent = counted.where(F.col("n") >= F.greatest(F.lit(least), F.ceil(F.col("pages") * share))).select("host", "gram")
    return out.unionByName(_with_grams(packed, frequent, finish, RESULT))
