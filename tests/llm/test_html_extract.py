"""Main text: markup rules, repeated runs against a count of all windows, shards, awkward rows."""
import random
import re
from collections import defaultdict
from html import unescape

import numpy as np
import pytest

from gavel.llm import _tokens as T
from gavel.llm import html_extract as H
from gavel.llm.queries import QUERIES

from .common import prose

PAGES = "page_id long, url string, html string, text string, host int"


@pytest.mark.parametrize("html,want", [
    ("<body><p>a <b>b</b>c<br>d</p><p>e", [(0, "a bc d"), (0, "e")]),
    ("<article><h1>T &amp; &#233;</h1><p><b>x<br><p>y</article>z", [(1, "T & é"), (1, "x"), (1, "y"), (0, "z")]),
    ("<nav><p>n</nav><main>m<footer>f</footer><aside>s</aside>k</main><footer>g", [(1, "m"), (1, "k")]),
    ("<div class='cookie-notice'>c</div><div id=sidebarLeft>s</div><div class=\"adventure\">t</div>", [(0, "t")]),
    ("<header>h</header><article><header><h1>t</h1></header>b<div class=comments><article>c</article></div></article>", [(1, "t"), (1, "b")]),
    ("<form><article>kept</article>gone</form>", [(1, "kept")]),
    ("<article class=comment>c</article><div class='entry-content'>e</div>", [(1, "e")]),
    ("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- y --><textarea>z</textarea>", [(0, "x")]),
    ("<p hidden>h</p><p style='display: none'>n</p><p aria-hidden=\"true\">a</p><p data-hidden=1>k", [(0, "k")]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table>", [(0, x) for x in "abcdefg"]),
    ("<body class='no-sidebar'><div class='has-comments'>w</div></span></b></i>", [(0, "w")]),
    ("a <span class=ad>gone</span> b<!doctype x><?php y ?> 1 < 2", [(0, "a"), (0, "b 1 < 2")]),
    ('<a title="x > y">l</a> <p title="un closed>t', [(0, "l"), (0, "t")]),
    ("<article>x<!-- open", [(1, "x")]), ("<script>open", []), ("&nbsp; \t", []), ("&am &amp", [(0, "&am &")]), ("<", [(0, "<")]),
])
def test_blocks(html, want):
    assert [b[:2] for b in H.blocks(html)] == want


def test_links_are_counted():
    assert H.blocks("<li><a href=x>one two</a></li><p>see <a>this</a> please, and read on</p>") == [(0, "one two", 7), (0, "see this please, and read on", 4)]


def runs_by_count(texts, page, zone, n_pages, run):
    """Words covered by windows that enough pages have, by plain counting."""
    on = defaultdict(set)

    def windows(ws):
        if len(ws) < run:
            return [(0, tuple(ws))]
        return [(i, tuple(ws[i:i + run])) for i in range(len(ws) - run + 1)]

    for t, p in zip(texts, page):
        for _, w in windows(t.split()):
            on[w].add(p)
    out = []
    for t, z in zip(texts, zone):
        hit = [False] * len(t.split())
        for i, w in windows(t.split()):
            k = len(on[w])
            if (k >= 10 and 4 * k >= 3 * n_pages) if z == H.ARTICLE else k >= max(2, -(-n_pages // 2)):
                hit[i:i + len(w)] = [True] * len(w)
        out += hit
    return out


def test_runs_against_counting():
    rng = random.Random(5)
    for n_pages in (2, 3, 12, 16):
        texts, page, zone = [], [], []
        common = [prose(k, rng.randint(3, 25), "abc") for k in range(6)]
        for p in range(n_pages):
            for _ in range(rng.randint(1, 6)):
                t = " ".join(rng.choice([rng.choice(common), prose(rng.random(), rng.randint(1, 12), "ab")]) for _ in range(rng.randint(1, 3)))
                texts.append(t), page.append(p), zone.append(rng.randint(0, 1))
        gone, counts = H.covered(texts, np.array(page), np.array(zone), n_pages)
        assert counts.tolist() == [len(t.split()) for t in texts]
        assert gone.tolist() == runs_by_count(texts, page, zone, n_pages, H.RUN)


def test_suffix_order_sorts_by_leading_tokens():
    rng = np.random.default_rng(1)
    ids, counts = rng.integers(0, 3, 400).astype(np.uint64), np.array([100, 3, 0, 150, 147])
    at, rank = H.suffix_order(ids, counts, 8)
    inside = [i for i in range(400) if T.room(counts)[i] >= 8]
    assert sorted(at.tolist()) == inside
    keys = [tuple(ids[i:i + 8].tolist()) for i in at]
    assert keys == sorted(keys) and [k == q for k, q in zip(keys, keys[1:])] == (rank[1:] == rank[:-1]).tolist()


def page(title, body, template=True):
    menu, note = "<div><a href=/>Home</a> <a href=/x>All news</a></div>", "<div class=k9>This site is run by volunteers who would like your help today</div>"
    return f"<html><body>{menu if template else ''}<div><h1>{title}</h1><p>{body}</p></div>{note if template else ''}<p>Read more</p></body></html>"


def test_unmarked_pages_lose_what_their_host_repeats(spark):
    data = [(i, f"http://Site.example/{i}", page(f"Title {i}", prose(i, 40)), "t", 1) for i in range(8)]
    data += [(20, "http://site.example/20", data[3][2], "t", 1)]  # a copy is no other page
    got = {r.page_id: r.text for r in H.main_text(spark.createDataFrame(data, PAGES)).collect()}
    assert all(got[i] == f"Title {i}\n{prose(i, 40)}" for i in range(8)) and got[20] == got[3]


def test_marked_articles_keep_passages_that_others_quote():
    quote = prose(77, 30)
    pages = [f"<article><h1>T{i}</h1><p>{quote if i % 2 else prose(i + 100, 30)}</p><p>{prose(i, 50)}</p>"
             f"<p>Sign this petition now and tell all of your friends about it</p></article>" for i in range(12)]
    for i, text in enumerate(H.host_texts(pages)):
        assert text == "\n".join([f"T{i}", quote if i % 2 else prose(i + 100, 30), prose(i, 50)])
    assert H.host_texts(pages[:9])[0].endswith("all of your friends about it")  # too few pages to tell


def test_unique_runs_of_a_repeated_block_stay():
    note = "this notice stands on every page of this site so be it "
    texts = H.host_texts([f"<p>{note} {prose(i, 20)}</p><p>{note} only {i}</p>" for i in range(4)])
    assert texts == [prose(i, 20) for i in range(4)]


def test_large_host_is_dealt_and_judged_alike(spark):
    data = [(i, "http://big.example/%d" % i, page("T%d" % i, prose(i, 60)), "", 0) for i in range(400)]
    data += [(1000 + i, "http://h%d.example/" % i, page("S", prose(i, 60)), "", 0) for i in range(20)]
    whole, dealt = (sorted((r.page_id, r.text, r.n_chars) for r in H.main_text(spark.createDataFrame(data, PAGES), b).collect()) for b in (10**8, 20_000))
    assert whole == dealt and len(whole) == 420


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>{prose(k, 200)}</p>" for k in range(200)) + "</article>"
    data = [(1, None, None, None, 1), (2, "x", "", None, 1), (None, "http://a/", "<p>t", None, 1), (4, "http://a/", long, None, 1), (4, "http://a/", long, "", 2),
            (5, "HTTP://A/", "<b>" * 3000 + "deep", "", 2), (6, "http://a", "<p><div>" * 2000 + "x" + "</div>" * 2000, "", 2)]
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in H.main_text(spark.createDataFrame(data, PAGES)).collect()))
    whole = "\n".join(prose(k, 200) for k in range(200))
    assert got == [(0, "t", 1), (1, "", 0), (2, "", 0), (4, whole, len(whole)), (4, whole, len(whole)), (5, "deep", 4), (6, "x", 1)]
    assert H.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_query_on_the_smallest_table(spark):
    d = "/root/testdata/sf0.001"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in QUERIES["op13_html_extract"](spark, d).collect():
        inside = re.search(r"<article>(.*)</article>", html[r.page_id], re.S)[1]
        want = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


def test_results_do_not_depend_on_how_a_host_is_dealt(spark):
    """Passages on about half (loose) or three quarters (marked) of a host's pages: some shards have more of them, some fewer."""
    rng = random.Random(5)
    notes = [prose(5000 + j, 12) for j in range(8)]
    data = []
    for i in range(300):
        some = "".join(f"<p>{notes[j]}</p>" for j in range(8) if rng.random() < 0.47 + 0.01 * j)
        marked = "".join(f"<p>{notes[j]}</p>" for j in range(8) if rng.random() < 0.72 + 0.01 * j)
        html = f"<p>{prose(i, 30)}</p>{some}" if i % 2 else f"<article><p>{prose(i, 30)}</p>{marked}</article>"
        data.append((i, f"http://{'odd' if i % 2 else 'even'}.example/{i}", html, "", 0))
    data += [(1000 + i, data[7][1], data[7][2], "", 0) for i in range(200)]  # copies of one page count once
    df = spark.createDataFrame(data, PAGES)
    whole = {}
    for host in ("odd", "even"):
        rows = [d for d in data if host in d[1]]
        whole |= dict(zip((d[0] for d in rows), H.host_texts([d[2] for d in rows])))
    assert any(n in t for n in notes for t in whole.values()) and not all(any(n in t for t in whole.values()) for n in notes)
    for shard_bytes in (10**8, 40_000, 4_000):
        assert {r.page_id: r.text for r in H.main_text(df, shard_bytes).collect()} == whole
