"""Operator 6: pages of every kind, and the repeats against brute force."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hillspan.llm import html
from hillspan.llm.html import ARTICLE, CUED, MAIN, PLAIN, RUN, blocks, extract, suffix_array


def main(page):
    return "\n\n".join(t for m, t in blocks(page) if m in (ARTICLE, MAIN))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><a href=/>x</a></nav><div class=\"ad\">buy</div><article><h1>A &amp; B</h1><p><b>One\n two.<br><p>Three&nbsp;four</p></article><footer>&copy; f</footer></body></html>", "A & B\n\nOne two.\n\nThree four"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut off</p><foot", "cut off"),
        ("<article><p>a < b and c<d e</p></article>", "a < b and c"),
        ("<article><p>x<!-- <p>no</p> --> y</p></article><p>out</p>", "x y"),
        ("<article><header><h1>Title</h1></header><div class='comments'><p>reader</p></div><p>body<p>more<ul><li>i<li>j</ul></article>", "Title\n\nbody\n\nmore\n\ni\n\nj"),
        ("<main><form><p>mail</p></form><aside>side</aside><p>in <i>line</i>d &#233;&#x41;</p><table><tr><td>a<td>b</tr></table></main>", "in lined éA\n\na b"),
        ('<nav><p>open<article><p data-x="a>b">text</p></article>', "text"),
        ("<article><p>t</p><article class='comment'><p>c</p></article></article>", "t"),
        ("<ARTICLE><P>up</P><SCRIPT>x</script ><p hidden>h</p></ARTICLE>", "up"),
        ("<article><p>q</p><script>never closed", "q"),
        ("", ""),
    ],
)
def test_article_blocks(page, want):
    assert main(page) == want


def test_marks_outside_an_article():
    assert blocks("<p>plain text</p><div id='site-footer'>f</div><ul><li><a>l</a></ul><div>d") == [(PLAIN, "plain text"), (CUED, "f"), (CUED, "l"), (PLAIN, "d")]


def host(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def brute(rows):
    """Substrings of RUN words by the pages that have them, in plain Python."""
    pages, seen = {}, {}
    for i, u, h in rows:
        pages.setdefault(host(u), set()).add((i, u))
        words = [w for _, t in blocks(h or "") for w in t.split(" ")]
        for s in range(len(words) - RUN + 1):
            seen.setdefault((host(u), *words[s : s + RUN]), set()).add((i, u))
    out = []
    for i, u, h in rows:
        found = [(m, t, t.split(" ")) for m, t in blocks(h or "")]
        words = [w for *_, ws in found for w in ws]
        covered = [False] * len(words)
        for s in range(len(words) - RUN + 1):
            n = len(pages[host(u)])
            if len(seen[(host(u), *words[s : s + RUN])]) >= max(3, -(-n // 20)):
                covered[s : s + RUN] = [True] * RUN
        left, at = [], 0
        for m, t, ws in found:
            gone = m != ARTICLE and 10 * sum(covered[at : at + len(ws)]) >= 9 * len(ws)
            at += len(ws)
            if m != CUED:
                left.append((m, t, len(ws), gone))
        if 5 * sum(n for *_, n, gone in left if not gone) >= sum(x[2] for x in left):
            left = [x for x in left if not x[3]]
        for marks in ((ARTICLE,), (ARTICLE, MAIN)):
            inside = [x for x in left if x[0] in marks]
            if inside and sum(x[2] for x in left) <= 3 * sum(x[2] for x in inside):
                left = inside
                break
        text = "\n\n".join(x[1] for x in left)
        out.append((i, u, text, len(text)))
    return sorted(out, key=str)


def test_suffix_array_equals_sorted_suffixes():
    r = random.Random(1)
    for n in (0, 1, 7, 8, 9, 300):
        symbols = [r.randrange(3) for _ in range(n)]
        order, rank = suffix_array(np.array(symbols, np.uint64), 8)
        assert order.tolist() == sorted(range(max(0, n - 7)), key=lambda i: (symbols[i : i + 8], i))
        assert all((rank[i] == rank[j]) == (symbols[i : i + 8] == symbols[j : j + 8]) for i in range(len(rank)) for j in range(0, len(rank), 17))


@pytest.mark.parametrize(("chunk", "few"), [(300, 1 << 20), (3000, 1 << 20), (3000, 0), (1 << 22, 1 << 20)])
def test_repeats_equal_brute_force(spark, monkeypatch, chunk, few):
    monkeypatch.setattr(html, "FEW_GRAMS", few)
    monkeypatch.setattr(html, "CHUNK", chunk)
    monkeypatch.setattr(html, "LEAST_CHUNK", chunk)
    monkeypatch.setattr(html, "CHUNK_PAGES", 4)
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choices("abcdefgé", k=3)) for _ in range(n))
    notices = [text(n) for n in (5, 8, 11, 30)]
    rows = [(0, None, None), (1, "http://h.x/1", ""), (2, "nohost", "<p>alone</p>")]
    for i in range(3, 110):
        h = r.choice(["h.x", "h.x", "H.X", "other.y", f"small{i % 5}.z"])
        body = "".join(f"<div>{r.choice([r.choice(notices), text(r.randint(1, 40)), text(4) + ' ' + r.choice(notices)])}</div>" for _ in range(r.randint(1, 5)))
        rows.append((i, f"https://u@{h}:80/p{i}", body if i % 4 else f"<{r.choice(['article', 'main'])}><p>{r.choice(notices)}</p><p>{text(r.randint(1, 9))}</p></article>" + body))
    rows += [(5, rows[5][1], rows[5][2]), (180, "https://h.x/c", "<p>" + text(3000) + "</p>"), (None, "https://h.x/n", "<p>" + notices[3] + " tail</p>")]
    rows += [(200 + i, f"https://h.x/copy{i}", rows[-2][2]) for i in range(9)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "page_id long, url string, html string, chunk int, grams int").repartition(4)
    assert sorted((tuple(x) for x in extract(df).collect()), key=str) == brute(rows)
    assert extract(df.limit(0)).collect() == []


def test_repeats_decide_without_cues(spark):
    """Menus, notices and closing lines in plain elements, some inside main; a copied article stays."""
    r = random.Random(7)
    text = lambda n: " ".join("".join(r.choices("abcdefgé", k=4)) for _ in range(n))
    menu, notice, closing = text(12), text(20), text(15)
    pages, want = [], {}
    for i in range(60):
        own = [text(r.randint(3, 60)) for _ in range(4)] if i not in (41, 42, 43, 44) else want[40].split("\n\n")
        kind = r.choice(["main", "div"])
        body = f"<div>{menu}</div><{kind}><p>{own[0]}</p><p>{notice}</p>{''.join(f'<p>{x}</p>' for x in own[1:])}<p>{closing}</p></{kind}><div>{closing}</div>"
        pages.append((i, f"https://plain.example/{i}", body))
        want[i] = "\n\n".join(own)
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x.page_id: x.text for x in extract(df).collect()}
    copies = {40, 41, 42, 43, 44}  # everything on these repeats
    assert {i for i in got if got[i] != want[i]} <= copies and all(want[i].split("\n\n")[1] in got[i] for i in copies)
    without = {x.page_id: x.text for x in extract(df, least=1 << 40).collect()}
    assert sum(without[i] != got[i] for i in got) >= 50


def test_a_long_page(spark):
    long = " ".join(str(i) for i in range(120_000))
    df = spark.createDataFrame([(1, "https://a.b/1", f"<p>{long}</p><p>x</p>")], "page_id long, url string, html string")
    assert [x.text for x in extract(df).collect()] == [long + "\n\nx"]


def test_bundled_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {x.page_id: x.text for x in extract(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.DOTALL)[1]
        assert got[p.page_id].split() == re.sub(r"<[^>]*>", " ", inner).replace("&amp;", "&").replace("&quot;", '"').split()


def test_tags_that_do_not_match_take_time_in_proportion():
    n = 100_000
    pages = ("<div>" * n + "</p></i></section>" * n + "text", "<aside>" + "<div>" * n + "<article>a</article>" * n, "<nav>" + "<article>b</article>" * n, "<div><p>" * n + "</div>" * n + "text")
    began = time.perf_counter()
    found = [blocks(x) for x in pages]
    assert time.perf_counter() - began < 30 and found[0] == [(2, "text")] and len(found[1]) == n


def test_a_host_of_large_pages(spark):
    """Pages of 80 KB: what is common to a twentieth of them goes, wherever the host's chunks begin."""
    filler = lambda i, n: F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.concat(F.lit("w"), F.conv(F.abs(F.xxhash64("id", k, F.lit(i))).cast("string"), 10, 36))))
    rare, often = "<div>one line that some of the pages have in them</div>", "<div>another line that many of the pages have in them</div>"
    html = F.concat(F.lit("<div>"), filler(1, 3000), F.lit("</div>"), F.when(F.col("id") % 40 == 0, F.lit(rare)).otherwise(F.lit("")), F.when(F.col("id") % 10 == 0, F.lit(often)).otherwise(F.lit("")), F.lit("<div>"), filler(2, 3000), F.lit("</div>"))
    pages = spark.range(800).repartition(8).select(F.col("id").alias("page_id"), F.concat(F.lit("https://large.example/"), "id").alias("url"), html.alias("html"))
    r = extract(pages).agg(F.count("*").alias("n"), F.count_if(F.contains("text", F.lit("one line that"))).alias("rare"), F.count_if(F.contains("text", F.lit("another line"))).alias("often")).first()
    assert (r.n, r.rare, r.often) == (800, 20, 0)
