"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A document is parsed greedily
into phrases, each the longest match from its place on that occurs in the language's text (a
symbol that doesn't occur there is a phrase of its own). The fewer phrases, the closer the
language: with c phrases over n symbols and N symbols of training text the cross entropy is
about ``c * log2(N) / n`` bits a symbol, so languages with unequal text compare fairly. The
least wins; ties go to the lesser name.

Symbols are the lower-cased letters of the training texts; any run of other characters is one
separator. ``score`` is the winner's weight among 2**-entropy of all languages (0 to 1).

The model is fitted on a bounded sample: about ``docs_per_lang`` documents a language (by a
hash of the text, in expectation; the language's count decides the share), of each an excerpt from a
hashed place on, all of the same length, ``chars_per_lang`` characters together; of more than ``max_langs``
labels the most frequent are learned. Prediction reads whole texts and nothing but the text.

Documents are parsed side by side: one step moves all (document, language) lanes of a piece by
one symbol; the last, longest documents go on one by one. Transitions are rows of a table where that
has DENSE_CELLS cells at most, and a hash table of the edges otherwise (a script of thousands of
letters has few edges a state): both give the same phrases.

Defined results: null text or no letter: ``und`` with score 0; a learned language is any
non-null ``lang`` whose sample has a letter; without any training text, or an empty table, all is
``und`` or nothing. A letter that no training text has is a phrase of its own in every language. Equal
entropies go to the lesser name, equally frequent labels likewise. Repeated rows get a row each;
equal training texts are drawn once. A text of any length is parsed whole. Extra columns, whatever
their names, are ignored.
"""
from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B

DENSE_CELLS = 1 << 25
FEW = 24  # lanes below which a step for all costs more than steps one by one
OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_symbols", pa.int64())])
DDL = "doc_id long, lang_pred string, score double, n_symbols long"


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Edges (symbol -> state) of every state of the suffix automaton of a sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Rows:
    """Transitions as a table, completed: where a match ends, the next phrase starts at once from the root."""

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, root_of: np.ndarray, fresh: np.ndarray):
        width = fresh.shape[1]
        # entry: (first cell of the next state's row) * 2 + 1 where a phrase starts
        kind = np.int64 if 2 * width * len(root_of) >= 2**31 else np.int32
        table = (fresh * (2 * width) + 1).astype(kind)[root_of]
        table[state, symbol] = to * (2 * width)
        self.table, self.width = table.ravel(), width
        self.nbytes = self.table.nbytes

    def place(self, state: int) -> int:
        """How a state is held in a lane."""
        return state * self.width

    def step(self, lanes: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.table.take(lanes + symbol[:, None])
        return to >> 1, to & 1

    def walk(self, lane: int, at: int, symbols: list[int]) -> int:
        item, n = self.table.item, 0
        for c in symbols:
            to = item(at + c)
            n += to & 1
            at = to >> 1
        return n


class Edges:
    """Transitions as a hash table of edges (open addressing); the roots' own are rows."""

    def __init__(self, state: np.ndarray, symbol: np.ndarray, to: np.ndarray, root_of: np.ndarray, fresh: np.ndarray):
        self.fresh, self.width = fresh, fresh.shape[1]
        self.mask = (1 << max(4, int(2 * len(state)).bit_length())) - 1
        self.keys, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        keys, left = state * self.width + symbol, np.arange(len(state))
        slot = self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = keys[left[free]]  # of several the last stays
            won = self.keys[slot[left]] == keys[left]
            self.to[slot[left[won]]] = to[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & self.mask
        self.nbytes = self.keys.nbytes + self.to.nbytes + fresh.nbytes

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & self.mask

    def place(self, state: int) -> int:
        return state

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The next state of each (state, symbol); -1: no edge."""
        out = np.full(len(keys), -1, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[slot[left]]
            hit = there == keys[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (there >= 0)]
            slot[left] = (slot[left] + 1) & self.mask
        return out

    def step(self, lanes: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to = self.find((lanes * self.width + symbol[:, None]).ravel()).reshape(lanes.shape)
        mark = to < 0
        return np.where(mark, self.fresh[:, symbol].T, to), mark.astype(lanes.dtype)

    def walk(self, lane: int, at: int, symbols: list[int]) -> int:
        if not hasattr(self, "edge"):
            used = np.flatnonzero(self.keys >= 0)
            self.edge = dict(zip(self.keys[used].tolist(), self.to[used].tolist()))
        n, get, width, fresh = 0, self.edge.get, self.width, self.fresh[lane]
        for c in symbols:
            to = get(at * width + c)
            if to is None:
                to, n = int(fresh[c]), n + 1
            at = to
        return n


class Parser:
    """The learned languages: one automaton each, their states numbered in a run."""

    def __init__(self, texts: dict[str, str], dense_cells: int = DENSE_CELLS):
        self.langs = sorted(texts)
        letters = sorted({c for t in texts.values() for c in t.lower() if c.isalpha() and len(c) == 1})
        known = {c: i for i, c in enumerate(letters, 1)}
        self.code = np.zeros(0x110000, np.uint32)  # 0: separator; the last code: a letter not learned
        for c in map(chr, range(0x110000)):
            if c.isalpha():
                self.code[ord(c)] = known.get(c.lower(), len(letters) + 1)
        width, at = len(letters) + 2, 0
        state, symbol, to, root_of, roots, self.bits = [], [], [], [], [], []
        fresh = np.zeros((len(self.langs), width), np.int64)  # where a phrase's first symbol leads; unknown ones back to the root
        for lane, name in enumerate(self.langs):
            codes = self.symbols(texts[name])
            edges = automaton(codes.tolist())
            fresh[lane] = at
            fresh[lane, list(edges[0])] = [at + x for x in edges[0].values()]
            state.append(np.repeat(np.arange(1, len(edges)), [len(e) for e in edges[1:]]) + at)
            symbol.append(np.array([c for e in edges[1:] for c in e], np.int64))
            to.append(np.array([x for e in edges[1:] for x in e.values()], np.int64) + at)
            root_of.append(np.full(len(edges), lane))
            roots.append(at)
            self.bits.append(math.log2(max(2, len(codes))))
            at += len(edges)
        some = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (state, symbol, to, root_of)]
        self.moves = (Rows if at * width <= dense_cells else Edges)(*some, fresh)
        self.root = np.array([self.moves.place(r) for r in roots], np.int64)

    def symbols(self, text: str) -> np.ndarray:
        """Codes of a text; a run of separators is one, none at either end."""
        c = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = c > 0
        keep[1:] |= c[:-1] > 0
        c = c[keep]
        return c[:-1] if len(c) and c[-1] == 0 else c

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Phrase counts (documents x languages)."""
        n_lang = len(self.langs)
        order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        size = np.array([len(docs[i]) for i in order], np.int64)
        out = np.zeros((len(docs), n_lang), np.int64)
        if not len(size) or not size[0]:
            return out
        live = len(size)
        flat = np.concatenate([docs[i] for i in order]).astype(np.int64)
        begin = np.cumsum(size) - size
        state = np.tile(self.root, (live, 1))
        count = np.zeros((live, n_lang), np.int64)
        step = 0
        while live:
            live = int(np.searchsorted(-size[:live], -step, side="left"))  # those longer than step
            if live < FEW:
                break
            state[:live], mark = self.moves.step(state[:live], flat.take(begin[:live] + step))
            count[:live] += mark
            step += 1
        for r in range(live):
            codes = flat[begin[r] + step:begin[r] + size[r]].tolist()
            for lane in range(n_lang):
                count[r, lane] += self.moves.walk(lane, int(state[r, lane]), codes)
        out[order] = count
        return out

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, symbols) of every text."""
        docs = [self.symbols(t or "") for t in texts]
        if not self.langs:
            return [("und", 0.0, 0) for _ in docs]
        found = self.phrases(docs)
        bits = np.array(self.bits)
        out = []
        for i, d in enumerate(docs):
            if not len(d):
                out.append(("und", 0.0, 0))
                continue
            h = found[i] * bits / len(d)
            best = int(np.argmin(h))
            out.append((self.langs[best], float(1 / np.exp2(h[best] - h).sum()), len(d)))
        return out


@lru_cache(maxsize=2)
def _parser(texts: tuple[tuple[str, str], ...]) -> Parser:
    """Built once a worker process, not once a task."""
    return Parser(dict(texts))


def learn(docs: DataFrame, train: Column, docs_per_lang: int = 200, chars_per_lang: int = 40_000, max_langs: int = 1000) -> dict[str, str]:
    """Training text per language from the rows where ``train`` holds (a bounded sample of them)."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    share = counted.select("lang", (F.lit(float(docs_per_lang)) / F.col("n")).alias("share"),
                           F.ceil(F.lit(float(chars_per_lang)) / F.least("n", F.lit(docs_per_lang))).cast("int").alias("excerpt"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) / 1_000_000.0
    drawn = B.attach(known, share, "lang", "text", "inner").where(draw < F.col("share"))
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - F.col("excerpt"), F.lit(0)) + 1).cast("int")
    rows = drawn.select("lang", draw.alias("d"), F.substring("text", place + 1, F.col("excerpt")).alias("x")).distinct().collect()
    by_lang: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.d, r.x)):
        by_lang.setdefault(r.lang, []).append(r.x)
    # more than expected may have been drawn: all stay, a little shorter
    texts = {k: " ".join(x[:max(1, chars_per_lang // len(v) - 1)] for x in v) for k, v in by_lang.items()}
    return {k: v for k, v in texts.items() if any(c.isalpha() for c in v)}


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """One row a document: doc_id, lang_pred, score, n_symbols. Reads the text alone."""
    given = tuple(sorted(texts.items()))

    def run(batches):
        for t in B.pieces(batches, most=8_000_000):
            got = _parser(given).judge(t["text"].to_pylist())
            yield from B.to_table([(d, *x) for d, x in zip(t["doc_id"].to_pylist(), got)], OUT).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DDL)
