"""URL rules and lists against a loop over all entries."""
import random
from urllib.parse import quote

import numpy as np
import xxhash

from gavel.llm import url_filter as U
from gavel.llm.queries import BLOCKED, QUERIES, URL_RULES

PAGES = "page_id long, url string, html string, hits string"
ODD = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/EN/x", "http://example.net", "http://example.net/", "http://a.b.example.net/en/1?x=/de/#y",
       "https://example.net#/en/", "https://notexample.net/en/", "ftp://x.example.com/de/", "http://spam-farm.example.org/fr/1",
       "http://www.adult-x.example.com", "http://www.adult-x.example.com/de", "://org/fr/", "http://é.org/fr/" + "x" * 3000, "a://b://c.org/fr/"]


def brute(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        end = min([rest.index(c) for c in "?#" if c in rest] + [len(rest)])
        rest = rest[:end]
        cut = rest.index("/") if "/" in rest else len(rest)
        host, path = rest[:cut].translate(U.LOWER), rest[cut:]
    fits = lambda h, p: host and (host == h or host.endswith("." + h)) and path.startswith(p)
    rule = max((h + p for _, h, p in rules if fits(h, p)), key=len, default=None)
    listed = max((e for e in blocked if fits(e[:e.index("/")], e[e.index("/"):])), key=len, default=None)
    action = next((a for a, h, p in rules if h + p == rule), None)
    return host, path, rule, action or ("block" if listed else "allow"), listed


def rows(n=300):
    rng = random.Random(6)
    urls = ODD + [f"https://{rng.choice(['', 'www.', 'm.x.'])}{rng.choice(['a', 'spam-farm', 'b'])}.example.{rng.choice(['com', 'net', 'org'])}"
                  f"{rng.choice(['', '/', '/en/', '/de/', '/fr/', '/bad/page', '/bad/pages'])}{quote(rng.choice(['', '1', 'q?x#y']))}" for _ in range(n)]
    return [(i % 250, u, "<p>", "x") for i, u in enumerate(urls)]


def test_against_loops(spark):
    data, extra = rows(), BLOCKED + ["a.example.org/bad/page", "example.org/bad/", "a.example.org/bad/page"]
    blocked = spark.createDataFrame([(e,) for e in extra + [None]], "entry string")
    pages = spark.createDataFrame(data, PAGES)
    want = sorted(((i, *brute(u, URL_RULES, extra)) for i, u, *_ in data), key=str)
    for most in (U.MAX_BYTES, 0):  # by the mapped file, and by a join
        got = sorted((tuple(r) for r in U.judge_urls(pages, URL_RULES, blocked, most).collect()), key=str)
        assert got == want


def test_no_rules_and_empty(spark):
    none = spark.createDataFrame([], "entry string")
    pages = spark.createDataFrame(rows(20), PAGES)
    assert {(r.rule, r.verdict, r.entry) for r in U.judge_urls(pages, [], none).collect()} == {(None, "allow", None)}
    assert U.judge_urls(spark.createDataFrame([], PAGES), URL_RULES, none).collect() == []


def test_collisions_are_confirmed(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda s: len(s) % 3)
    entries = [f"host{i}.net/" + "x" * (i % 5) for i in range(60)]
    U.DigestFile.write(entries[:30], str(tmp_path / "f"))
    f = U.DigestFile(str(tmp_path / "f"))
    assert f.holds(entries).tolist() == [True] * 30 + [False] * 30
    assert f.holds([]).tolist() == [] and np.all(np.diff(f.digests.astype(np.int64)) >= 0)


def test_query(spark):
    got = QUERIES["op6_url_filter"](spark, "/root/testdata/sf0.001").collect()
    assert got and all((r.host, r.path, r.rule, r.verdict) for r in got)
