"""HTML extraction: main text of pages, with a suffix array a host for what its pages repeat.

1. Markup. A page becomes blocks of text. Elements that say what they are (nav, footer, aside, form,
   script, a class such as ``cookie-notice`` or ``comments``) go. Blocks inside ``article``, ``main`` or an
   element named as such are the page's marked article, the others are loose.
2. Repetition. The remaining blocks of a host's pages are one token stream; a block shorter than RUN
   words is filled up to it, so that it is a run as a whole. Prefix doubling sorts all suffixes by
   their first RUN tokens: equal neighbours are runs that repeat, counted by distinct pages (pages of equal
   streams are one). A run is boilerplate if enough of the host's distinct pages have it: half of them
   outside a marked article (two at least), three quarters inside one (ten at least), since
   articles quote each other and have copies. Words covered by boilerplate runs go; a block with fewer than
   RUN words of its own left goes whole, and all unique runs stay.
3. Text. A page with a marked article is what is left of it; any other page is its loose blocks
   but those that are mostly links.

A host is judged by all of its pages, whatever its size. One with more than ``shard_bytes`` of html is dealt into shards
of about that size, each with a suffix array of its own; small hosts share a group, so no group grows with a host. A run
on half of the host's distinct pages is on half of some shard's, so the shards name the candidates, and those alone
are then counted in all shards of their host. Pages of hosts without boilerplate are not shuffled again. How hosts are
dealt changes no result.

Defined results: null or empty html: empty text; pages without a host (null url, or no ``://``) are one
host. Repeated rows are pages of their own and count as one in what repeats. A page is one row, however
long; an unclosed comment or script reaches the end of the page. An empty table gives no rows. Extra
columns, whatever their names, are ignored. Within a block white space (``br`` included) is one space.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B
from gavel.llm import _tokens as T

RUN = 8
SHARD_BYTES = 2_000_000
BROADCAST_HOSTS = 100_000
LOOSE, ARTICLE, GONE = 0, 1, 2
OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
PARSED = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("shards", pa.int64()),
                    ("name", pa.binary()), ("body", pa.binary()), ("zones", pa.binary()), ("linked", pa.list_(pa.int32()))])
DDL_PARSED = "row long, page_id long, url string, host string, shards long, name binary, body binary, zones binary, linked array<int>"
RUNS = pa.schema([("host", pa.string()), ("run", pa.int64()), ("pages", pa.int64())])
DDL_RUNS = "host string, run long, pages long"

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section summary table tbody td tfoot th thead tr ul""".split())
NOT_CONTENT = set("""nav footer aside form button select datalist noscript svg canvas object audio video dialog menu template map
head fieldset search""".split())
ENDS_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"},
             "tr": {"table"}, "td": {"table"}, "th": {"table"}}
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar".split())
# Words of a class or id that name what is not the article; the first list holds for longer words too.
CUE_STEMS = re.compile(r"(?:advert|banner|breadcrumb|captcha|comment(?!ar)|consent|cookie|copyright|disclaimer|disqus|gdpr|login|masthead|modal|"
                       r"navig|newsletter|pagination|paywall|popup|promo|recommend|related|share|sharing|sidebar|signup|social|sponsor|"
                       r"subscri|toolbar|widget)")
CUE_WORDS = set("ad ads adbox adslot footer header menu nav navbar notice notices pager replies skip topbar".split())
LASTING = re.compile(r"comment(?!ar)|disqus|replies|related|recommend")  # an article inside is no main article either
NEGATIONS = {"no", "has", "with", "without"}
ARTICLE_NAMES = {"articlebody", "article-body", "article-content", "article-text", "entry-content", "post-content", "post-body", "story-body",
                 "main-content", "maincontent"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)
| <(?P<raw>script|style|textarea|title|iframe|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
| <(?P<end>/)?(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^"'>]|"[^"]*"|'[^']*')*+>|[^>]*>)
| <[!?/][^>]*>""", re.I | re.S | re.X)
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


class Element:
    """An open element: where its text belongs, and whether an article inside starts anew."""

    __slots__ = ("tag", "zone", "lasting")

    def __init__(self, tag: str, zone: int, lasting: bool):
        self.tag, self.zone, self.lasting = tag, zone, lasting


def _opened(tag: str, attrs: str, parent: Element) -> Element:
    """The element that a start tag opens below ``parent``."""
    zone, lasting = parent.zone, parent.lasting
    named, gone, lasts = tag in ("article", "main"), tag in NOT_CONTENT, False
    if tag == "header" and zone != ARTICLE:
        gone = True
    if "=" in attrs or "hidden" in attrs:
        value = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
        role = value.get("role", "").lower()
        labels = f"{value.get('class', '')} {value.get('id', '')}"
        words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", labels).lower())
        named = named or role in ("main", "article") or value.get("itemprop", "").lower() == "articlebody" or any(
            x in ARTICLE_NAMES for x in labels.lower().split())
        gone = gone or role in ROLES or value.get("aria-hidden") == "true" or bool(HIDDEN.search(value.get("style", "")))
        gone = gone or bool(re.search(r"(?:^|\s)hidden(?:\s|/|>|$)", ATTRIBUTE.sub(" ", attrs)))
        if tag not in ("html", "body", "main") and not NEGATIONS.intersection(words):
            cues = [w for w in words if w in CUE_WORDS or CUE_STEMS.match(w)]
            if zone == ARTICLE or named:
                cues = [w for w in cues if w != "header"]
            gone = gone or bool(cues)
            lasts = any(LASTING.match(w) for w in cues)
    if named and not gone and not lasting:
        return Element(tag, ARTICLE, False)
    return Element(tag, GONE if gone else zone, lasting or lasts)


def blocks(page: str) -> list[tuple[int, str, int]]:
    """(zone, text, characters in links) of every block that markup doesn't rule out, in page order."""
    out: list[tuple[int, str, int]] = []
    stack, open_ = [Element("", LOOSE, False)], Counter()
    parts: list[str] = []
    linked = links = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text and stack[-1].zone != GONE:
                out.append((stack[-1].zone, text, linked))
            parts.clear()
            linked = 0

    def pop():
        nonlocal links
        tag = stack.pop().tag
        open_[tag] -= 1
        links -= tag == "a"

    def add(raw: str):
        nonlocal linked
        if stack[-1].zone != GONE:
            parts.append(unescape(raw))
            linked += len(parts[-1]) if links else 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            if tag in ("br", "hr") and parts:
                parts.append(" ")
            continue
        if m["end"]:
            if open_[tag] and (tag in BLOCK or not _inside_block(stack, tag)):
                while stack[-1].tag != tag:
                    _leave(stack, flush, pop)
                _leave(stack, flush, pop)
            continue
        if tag in BLOCK and open_["p"] and _p_ends(stack):
            while stack[-1].tag != "p":
                pop()
            pop()
        if tag in ENDS_SAME and open_[tag]:
            i = len(stack) - 1
            while stack[i].tag != tag and stack[i].tag not in ENDS_SAME[tag]:
                i -= 1
            if stack[i].tag == tag:
                while len(stack) > i:
                    pop()
        inner = _opened(tag, m["attrs"], stack[-1])
        if inner.zone != stack[-1].zone:
            flush()
        stack.append(inner)
        open_[tag] += 1
        links += tag == "a"
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _leave(stack: list[Element], flush, pop) -> None:
    if len(stack) > 1 and stack[-1].zone != stack[-2].zone:
        flush()
    pop()


def _inside_block(stack: list[Element], tag: str) -> bool:
    """Whether a block element was opened after the last inline element ``tag``."""
    for e in reversed(stack):
        if e.tag == tag:
            return False
        if e.tag in BLOCK:
            return True
    return True


def _p_ends(stack: list[Element]) -> bool:
    """Whether a block that starts now ends an open p: only inline elements are between."""
    for e in reversed(stack):
        if e.tag == "p":
            return True
        if e.tag in BLOCK:
            return False
    return False


def suffix_order(ids: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that have ``depth`` tokens inside their block, sorted by those tokens, and their ranks.

    Prefix doubling: a rank by 2h tokens comes from the ranks of two neighbours by h. ``depth`` is
    a power of two.
    """
    left = T.room(counts)
    _, rank = np.unique(ids, return_inverse=True)
    at, h = np.arange(len(ids)), 1
    while h < depth:
        at = at[left[at] >= 2 * h]
        key = rank[at] * (int(rank.max(initial=0)) + 1) + rank[at + h]
        _, new = np.unique(key, return_inverse=True)
        rank = np.zeros(len(ids), np.int64)
        rank[at] = new
        h *= 2
    order = np.argsort(rank[at], kind="stable")
    return at[order], rank[at[order]]


def stream(texts: list[str], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of blocks (short ones filled up), tokens of each block, the place of each word, words of each block."""
    h, _, _, counts = T.words(*T.buffers(pa.array(texts, pa.large_string())))
    filled = np.maximum(counts, run)
    begin = np.cumsum(filled) - filled
    ids = np.zeros(int(filled.sum()), np.uint64)
    word = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(h))
    ids[word] = h
    return ids, filled, word, counts


def run_pages(ids: np.ndarray, filled: np.ndarray, page: np.ndarray, n_pages: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs begin, by the suffix array; each one's rank; and the distinct pages of each rank."""
    block = np.repeat(np.arange(len(filled)), filled)
    at, rank = suffix_order(ids, filled, run)
    pairs = np.unique(rank * n_pages + page[block[at]])
    return at, rank, np.bincount(pairs // n_pages, minlength=int(rank.max(initial=-1)) + 1)


def under(hit: np.ndarray, word: np.ndarray, size: int, run: int) -> np.ndarray:
    """Which words are covered by runs that begin at ``hit``."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + run, -1)
    return (np.cumsum(edge[:-1]) > 0)[word]


def covered(texts: list[str], page: np.ndarray, zone: np.ndarray, n_pages: int, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a host's blocks boilerplate runs cover, and the words of each block.

    ``page`` names the distinct page of each block; ``n_pages`` is how many there are.
    """
    ids, filled, word, counts = stream(texts, run)
    at, rank, on = run_pages(ids, filled, page, n_pages, run)
    on = on[rank]
    loose = on >= max(2, -(-n_pages // 2))
    inside = (on >= 10) & (on * 4 >= n_pages * 3)
    block = np.repeat(np.arange(len(texts)), filled)
    return under(at[np.where(zone[block[at]] == ARTICLE, inside, loose)], word, len(ids), run), counts


def _left(found: list[list[tuple[int, str, int]]], gone: np.ndarray, counts: np.ndarray) -> list[str]:
    """Texts of pages of blocks, without the words that are gone."""
    cut = np.concatenate(([0], np.cumsum(counts)))
    lost = np.concatenate(([0], np.cumsum(gone)))
    lost = lost[cut[1:]] - lost[cut[:-1]]
    out, i = [], 0
    for bs in found:
        kept: tuple[list[str], list[str]] = ([], [])
        for z, text, linked in bs:
            if lost[i]:
                own = counts[i] - lost[i]
                text = " ".join(w for w, g in zip(text.split(" "), gone[cut[i]:cut[i + 1]]) if not g) if own >= RUN else ""
            if text and (z == ARTICLE or 2 * linked <= len(text)):
                kept[z].append(text)
            i += 1
        out.append("\n".join(kept[ARTICLE] or kept[LOOSE]))
    return out


def host_texts(pages: list[str | None]) -> list[str]:
    """Main text of every page of a host."""
    found = [blocks(p) if p else [] for p in pages]
    names: dict[tuple, int] = {}
    page_of = [names.setdefault(tuple(b[:2] for b in bs), len(names)) for bs in found]
    flat = [b for bs in found for b in bs]
    if not flat:
        return [""] * len(pages)
    zone = np.array([z for z, _, _ in flat])
    owner = np.repeat(np.array(page_of), [len(bs) for bs in found])
    return _left(found, *covered([t for _, t, _ in flat], owner, zone, len(names)))


def _parse(batches):
    """Pages as blocks; ``name`` is the same for pages of equal streams. Blocks have no line feed inside.

    Bodies are packed: the disk holds this table and one shuffle of it."""
    n = TaskContext.get().partitionId() << 32
    for batch in batches:
        out = []
        for page_id, url, host, shards, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "host", "shards", "html"))):
            bs = blocks(html) if html else []
            body, zones = "\n".join(t for _, t, _ in bs).encode("utf-8", "surrogatepass"), bytes(z for z, _, _ in bs)
            name = blake2b(zones + b"\n" + body, digest_size=16).digest()
            out.append((n, page_id, url, host, shards, name, zlib.compress(body, 1), zones, [k for _, _, k in bs]))
            n += 1
        yield from B.to_table(out, PARSED).to_batches()


def _blocks_of(t: pa.Table) -> list[list[tuple[int, str, int]]]:
    return [list(zip(zones, zlib.decompress(body).decode("utf-8", "surrogatepass").split("\n"), linked)) for body, zones, linked in zip(*(t[c].to_pylist() for c in ("body", "zones", "linked")))]


def _by_host(t: pa.Table) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, host in enumerate(t["host"].to_pylist()):
        out.setdefault(host, []).append(i)
    return out


def _candidates(pages: pa.Table, firsts: pa.Table) -> pa.Table:
    """Runs on half of a shard's distinct pages, and on how many."""
    pages = pages.filter(pa.compute.is_in(pages["row"], firsts["row"].combine_chunks()))
    found, out = _blocks_of(pages), []
    for host, rows in _by_host(pages).items():
        sizes = [len(found[i]) for i in rows]
        if not sum(sizes):
            continue
        ids, filled, _, _ = stream([t for i in rows for _, t, _ in found[i]])
        at, rank, on = run_pages(ids, filled, np.repeat(np.arange(len(rows)), sizes), len(rows), RUN)
        some = np.flatnonzero(2 * on >= len(rows))
        run = T.grams(ids, RUN)[at[np.searchsorted(rank, some)]].view(np.int64)
        out.append(pa.Table.from_arrays([pa.array([host] * len(some), pa.string()), pa.array(run), pa.array(on[some], pa.int64())], schema=RUNS))
    return pa.concat_tables(out) if out else RUNS.empty_table()


def _has(sorted_runs: np.ndarray, run: np.ndarray) -> np.ndarray:
    if not len(sorted_runs):
        return np.zeros(len(run), bool)
    return sorted_runs[np.minimum(np.searchsorted(sorted_runs, run), len(sorted_runs) - 1)] == run


def _count(pages: pa.Table, facts: pa.Table) -> pa.Table:
    """On how many of a shard's distinct pages each candidate is. ``facts``: rows of first pages, and candidates by host."""
    pages = pages.filter(pa.compute.is_in(pages["row"], facts["row"].combine_chunks().drop_null()))
    found, out = _blocks_of(pages), []
    asked = facts.filter(pa.compute.is_valid(facts["run"]))
    runs = asked["run"].to_numpy()
    of = {host: np.sort(runs[rows]) for host, rows in _by_host(asked).items()}
    for host, rows in _by_host(pages).items():
        sizes = [len(found[i]) for i in rows]
        if host not in of or not sum(sizes):
            continue
        ids, filled, _, _ = stream([t for i in rows for _, t, _ in found[i]])
        at = np.flatnonzero(T.room(filled) >= RUN)
        run = T.grams(ids, RUN)[at].view(np.int64)
        hit = _has(of[host], run)
        page = np.repeat(np.repeat(np.arange(len(rows)), sizes), filled)[at[hit]]
        pairs = np.unique(np.searchsorted(of[host], run[hit]) * len(rows) + page)
        which, on = np.unique(pairs // len(rows), return_counts=True)
        out.append(pa.Table.from_arrays([pa.array([host] * len(which), pa.string()), pa.array(of[host][which]), pa.array(on, pa.int64())], schema=RUNS))
    return pa.concat_tables(out) if out else RUNS.empty_table()


def _texts(t: pa.Table, texts: list[str]) -> pa.Table:
    return pa.Table.from_arrays([t["page_id"], t["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], schema=OUT)


def _without(pages: pa.Table, facts: pa.Table) -> pa.Table:
    """Texts of the pages of a group without their hosts' boilerplate runs (``inside``: in marked articles too)."""
    found, text = _blocks_of(pages), [""] * len(pages)
    facts_of = _by_host(facts)
    runs, inside = facts["run"].to_numpy(), facts["inside"].to_numpy(zero_copy_only=False)
    for host, rows in _by_host(pages).items():
        mine = [found[i] for i in rows]
        flat = [b for bs in mine for b in bs]
        if not flat:
            continue
        of = facts_of.get(host, [])
        ids, filled, word, counts = stream([t for _, t, _ in flat])
        at = np.flatnonzero(T.room(filled) >= RUN)
        run = T.grams(ids, RUN)[at].view(np.int64)
        zone = np.repeat(np.array([z for z, _, _ in flat]), filled)[at]
        hit = np.where(zone == ARTICLE, _has(np.sort(runs[of][inside[of]]), run), _has(np.sort(runs[of]), run))
        for i, x in zip(rows, _left(mine, under(at[hit], word, len(ids), RUN), counts)):
            text[i] = x
    return _texts(pages, text)


def _whole(batches):
    """Texts of pages whose host has no boilerplate."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        found = _blocks_of(t)
        n = sum(map(len, found))
        yield from _texts(t, _left(found, np.zeros(n, bool), np.ones(n, np.int64))).to_batches()


def main_text(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row a page of (page_id, url, html): page_id, url, text, n_chars."""
    spark = pages.sparkSession
    host = F.coalesce(F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), "html")
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    sizes = B.stored(sizes)
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    groups = max(B.partitions(spark), -(-total // shard_bytes))
    # at most total / shard_bytes hosts
    large = B.stored(sizes.where(F.col("bytes") > shard_bytes).select("host", F.ceil(F.col("bytes") / shard_bytes).alias("shards")))
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(groups)  # few large files would be parsed in few tasks
    if large.count() <= BROADCAST_HOSTS:
        dealt = rows.join(F.broadcast(large), "host", "left")
    else:
        dealt = B.attach(rows, large, "host", "html", "left")
    key = F.when(F.col("shards").isNull(), F.pmod(F.xxhash64("host"), F.lit(groups))).otherwise(
        F.xxhash64("host", F.pmod(F.xxhash64("row"), F.col("shards"))))
    steps = B.Steps(spark)
    parsed = steps.keep("parsed", dealt.select("page_id", "url", "host", "shards", "html").mapInArrow(_parse, DDL_PARSED).withColumn("key", key))
    firsts = steps.keep("firsts", parsed.groupBy("host", "name").agg(F.min(F.struct("row", "key", "shards")).alias("first")).select("host", "first.*"))
    found = steps.keep("found", B.cogrouped(parsed.select("key", "row", "host", "body", "zones", "linked"), firsts.select("key", "row"),
                                            "key", _candidates, DDL_RUNS))
    n = firsts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("shards").alias("shards"))
    asked = found.join(n.where("shards is not null").select("host"), "host").select("host", "run").distinct()
    asked = steps.keep("asked", asked)
    hosts = asked.select("host").distinct()
    keys = firsts.select("key", "host").distinct()
    facts = (firsts.join(hosts, "host").select("key", "host", "row", F.lit(None).cast("long").alias("run"))
             .unionByName(asked.join(keys, "host").select("key", "host", F.lit(None).cast("long").alias("row"), "run")))
    facts = facts.toDF(*facts.columns)  # the two sides share a table
    again = B.cogrouped(parsed.join(hosts, "host", "left_semi").select("key", "row", "host", "body", "zones", "linked"), facts, "key", _count, DDL_RUNS)
    once = found.join(n.where("shards is null").select("host"), "host").select("host", "run", "pages")
    on = steps.keep("on", once.unionByName(again)).groupBy("host", "run").agg(F.sum("pages").alias("on")).join(n, "host")
    common = B.stored(on.where("on >= 2 and 2 * on >= n").select("host", "run", F.expr("on >= 10 and 4 * on >= 3 * n").alias("inside")))
    for name in ("firsts", "found", "asked", "on"):
        steps.drop(name)
    with_some = common.select("host").distinct()
    rest = parsed.join(with_some, "host", "left_anti").select("page_id", "url", "body", "zones", "linked")
    cut = parsed.join(with_some, "host", "left_semi").select("key", "page_id", "url", "host", "body", "zones", "linked")
    facts = common.join(parsed.join(with_some, "host", "left_semi").select("key", "host").distinct(), "host").select("key", "host", "run", "inside")
    facts = facts.toDF(*facts.columns)
    ddl = "page_id long, url string, text string, n_chars long"
    return rest.mapInArrow(_whole, ddl).unionByName(B.cogrouped(cut, facts, "key", _without, ddl))
