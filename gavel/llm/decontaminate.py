"""Benchmark decontamination: SimHash fingerprints of item-sized windows, a multi-index over
Hamming blocks, and exact weighted-shingle similarity of the candidates.

Words are runs of letters and digits, lower-cased. An item's shingles are its five-word
sequences, weighted by how often they occur (shorter items: one shingle, all words). For
every item size a window of that many words starts at every word of a document; a document
shorter than an item is one window, held against the items that are longer than it.

1. A window whose similarity to an item reaches the threshold s has at least s times its
   shingles in the benchmark. Running counts of benchmark shingles tell this for all windows
   of all sizes; a window with fewer can't match any item and needs no fingerprint (lossless).
2. A fingerprint has BITS bits: the signs of the weighted sums of the shingles' hash bits.
3. Fingerprints are cut into BITS / 16 blocks. Two fingerprints within ``radius`` bits agree
   in one block but for ``radius // blocks`` bits at most (pigeonhole). The index holds every
   item under the variants of its blocks with as many of these bits flipped as INDEX_BYTES allow, and a
   window looks up the variants that the other bits allow, so all items within the radius are met; the
   full distance is tested next.
4. Candidates are verified by exact weighted Jaccard similarity of the shingle multisets.

The default radius holds pairs of similarity 0.8 (expected distance 19 of 128 bits, standard
deviation 4) with a probability of 0.998, and equal windows always.

``benchmark`` is a parameter-like table. It goes to the tasks in slices of SLICE_ITEMS items and
SLICE_BYTES of text at most (an index of INDEX_BYTES), fetched one at a time; a larger benchmark takes one
pass over the documents a slice, each written before the next slice is fetched.

Defined results: null or empty items and documents match nothing; null ids are returned as
null; repeated rows of a document or item come back once a pair (best similarity, then first
window, then fewest words); documents of any length are read whole; empty tables give no rows. Extra columns, whatever
their names, are ignored, and kept by ``decontaminate``.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B
from gavel.llm import _tokens as T

BITS, BLOCK_BITS = 128, 16
BLOCKS = BITS // BLOCK_BITS
SLICE_BYTES, SLICE_ITEMS = 8_000_000, 32_000
PAIRS_AT_ONCE, INDEX_BYTES = 1_000_000, 32_000_000
HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int64()),
                  ("n_words", pa.int64()), ("distance", pa.int32())])
DDL = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int"


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    return T.grams(h, k) if len(h) >= k else np.array([T._short(h)], np.uint64) if len(h) else np.zeros(0, np.uint64)


def fingerprints(grid: np.ndarray) -> np.ndarray:
    """SimHash of every row of shingle hashes (a multiset), as bytes; a sum of zero is a 0 bit."""
    ones = np.zeros((len(grid), BITS), np.int32)
    for j in range(grid.shape[1]):
        wide = np.stack([grid[:, j], T.mix(grid[:, j] ^ T.GOLDEN)], axis=1).view(np.uint8)
        ones += np.unpackbits(wide, axis=1)
    return np.packbits(2 * ones > grid.shape[1], axis=1)


def _flips(most: int) -> np.ndarray:
    """All patterns of up to ``most`` bits of a block."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(BLOCK_BITS), n)], np.int64)


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return prints[:, 2 * b].astype(np.int64) << 8 | prints[:, 2 * b + 1]


class Index:
    """Items by the variants of their fingerprints' blocks."""

    def __init__(self, items: list[tuple], k: int, radius: int):
        self.k, self.radius = k, radius
        texts = pa.array([t or "" for _, t in items], pa.string())
        h, _, _, counts = T.words(*T.buffers(pa.compute.utf8_lower(texts)), gap=T.ALNUM)
        at = np.cumsum(counts) - counts
        self.items = [(i, int(n), shingles(h[a:a + n], k)) for (i, _), a, n in zip(items, at, counts) if n]
        self.sizes: dict[int, int] = {}
        for _, n, s in self.items:
            self.sizes[n] = len(s)
        self.known = np.unique_values(np.concatenate([s for *_, s in self.items])) if self.items else np.zeros(0, np.uint64)
        self.known = np.sort(self.known)
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[(self.known >> np.uint64(42)).astype(np.int64)] = True
        self.prints = np.zeros((len(self.items), BITS // 8), np.uint8)
        by_size: dict[int, list[int]] = {}
        for i, (*_, x) in enumerate(self.items):
            by_size.setdefault(len(x), []).append(i)
        for rows in by_size.values():
            self.prints[rows] = fingerprints(np.stack([self.items[i][2] for i in rows]))
        slack = radius // BLOCKS
        # of the bits that may differ, the index holds as many as its bytes allow; a lookup does the rest
        held = max([h for h in range(slack + 1) if len(self.items) * len(_flips(h)) * BLOCKS * 4 <= INDEX_BYTES], default=0)
        mine, self.probe = _flips(held), _flips(slack - held)
        self.tables = []
        for b in range(BLOCKS):
            keys = (_block(self.prints, b)[:, None] ^ mine[None, :]).ravel()
            who = np.repeat(np.arange(len(self.prints), dtype=np.int32), len(mine))
            at = np.zeros((1 << BLOCK_BITS) + 1, np.int32)
            np.cumsum(np.bincount(keys, minlength=1 << BLOCK_BITS), out=at[1:])
            self.tables.append((at, who[np.argsort(keys.astype(np.uint16), kind="stable")]))
        self.nbytes = self.prints.nbytes + sum(at.nbytes + who.nbytes for at, who in self.tables)

    def near(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, distance) of all items within the radius of each fingerprint."""
        step = max(1, PAIRS_AT_ONCE // max(1, len(self.items)))
        found = [np.zeros(0, np.int64)]
        for lo in range(0, len(marks), step):
            part = marks[lo:lo + step]
            for b, (at, who) in enumerate(self.tables):
                key = _block(part, b)[:, None] ^ self.probe[None, :]
                n = (at[key + 1] - at[key]).ravel()
                row = np.repeat(np.repeat(np.arange(len(part)), len(self.probe)), n)
                place = np.repeat(at[key].ravel() - (np.cumsum(n) - n), n) + np.arange(len(row))
                item = who[place]
                keep = np.bitwise_count(self.prints[item] ^ part[row]).sum(axis=1) <= self.radius
                found.append((row[keep] + lo) * len(self.items) + item[keep])
        row, item = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.items)))
        return row, item, np.bitwise_count(self.prints[item] ^ marks[row]).sum(axis=1)

    def in_benchmark(self, g: np.ndarray) -> np.ndarray:
        hit = self.bloom[(g >> np.uint64(42)).astype(np.int64)]
        at = np.flatnonzero(hit)
        pos = np.minimum(np.searchsorted(self.known, g[at]), len(self.known) - 1)
        hit[at] = self.known[pos] == g[at]
        return hit


@lru_cache(maxsize=2)
def _index(items: tuple[tuple, ...], k: int, radius: int) -> Index:
    """Built once a worker process, not once a task."""
    return Index(list(items), k, radius)


def overlap(grid: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Size of the multiset intersection of every row with an item's shingles."""
    values, weights = np.unique(item, return_counts=True)
    both = np.zeros(len(grid), np.int64)
    for v, w in zip(values, weights):
        both += np.minimum((grid == v).sum(axis=1), w)
    return both


def _matcher(items: list[tuple], k: int, threshold: float, radius: int):
    """A function from a slice of documents to {(row, item_id): (-similarity, word, words, distance)}."""
    limit = Fraction(str(threshold))
    given = tuple(items)

    def match(t: pa.Table) -> dict:
        index = _index(given, k, radius)
        best: dict = {}
        lower = pa.compute.utf8_lower(B.column_of(t, "text"))
        h, _, _, counts = T.words(*T.buffers(lower), gap=T.ALNUM)
        doc = np.repeat(np.arange(len(counts)), counts)
        begin = np.cumsum(counts) - counts
        left = T.room(counts)
        g = T.grams(h, k)
        known = index.in_benchmark(g) & (left[:len(g)] >= k)
        run, sums = np.zeros(len(g) + 1, np.int64), np.zeros(len(g) + 1, np.uint64)
        np.cumsum(known, out=run[1:])
        np.cumsum(T.mix(g), out=sums[1:])
        live = np.flatnonzero(known)

        def judge(at: np.ndarray, grid: np.ndarray, size: int, whole: bool = False) -> None:
            """Enters the items that reach the threshold in windows of ``size`` words; whole documents meet longer items only."""
            if not len(at):
                return
            n = grid.shape[1]
            row, item, far = index.near(fingerprints(grid))
            for i in np.unique(item):
                if whole and index.items[i][1] <= size:
                    continue
                mine = np.flatnonzero(item == i)
                theirs = index.items[i][2]
                both = overlap(grid[row[mine]], theirs)
                union = n + len(theirs) - both
                for m in np.flatnonzero(both * limit.denominator >= union * limit.numerator):
                    a = int(at[row[mine[m]]])
                    d = int(doc[a])
                    hit = (-int(both[m]) / int(union[m]), a - int(begin[d]), size, int(far[mine[m]]))
                    key = (d, index.items[i][0])
                    if key not in best or hit < best[key]:
                        best[key] = hit

        for size, n in index.sizes.items():
            if size < k:  # a short item is one shingle of all its words
                at = np.flatnonzero(left >= size)
                grid = T.shorts(h, at, size)[:, None]
                keep = index.in_benchmark(grid[:, 0])
                at, grid = at[keep], grid[keep]
            else:  # windows in which enough shingles belong to the benchmark
                starts = np.zeros(len(g) + 1, np.int64)
                np.add.at(starts, np.maximum(0, live - n + 1), 1)
                np.add.at(starts, live + 1, -1)
                at = np.flatnonzero(np.cumsum(starts[:-1]) > 0) if len(live) else live
                at = at[left[at] >= size]
                at = at[(run[at + n] - run[at]) * limit.denominator >= n * limit.numerator]
                # of a document's windows with the same shingles the first will do
                same = np.stack([doc[at].astype(np.uint64), sums[at + n] - sums[at]], axis=1)
                at = at[np.sort(np.unique(same, axis=0, return_index=True)[1])] if len(at) else at
                grid = g[at[:, None] + np.arange(n)[None, :]]
            judge(at, grid, size)
        for size in np.unique(counts[(counts >= k) & (counts < max(index.sizes, default=0))]).tolist():
            n = size - k + 1
            at = begin[counts == size]
            at = at[(run[at + n] - run[at]) * limit.denominator >= n * limit.numerator]
            judge(at, g[at[:, None] + np.arange(n)[None, :]], size, whole=True)
        return best

    return match


def _slices(benchmark: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """Distinct (item_id, text) in bounded slices, one for all but huge benchmarks, and whether more follow."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    size, count = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(-(-(size or 0) // SLICE_BYTES), -(-count // SLICE_ITEMS))
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        yield sorted(((r.item_id, r.text) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])), i + 1 < n


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 31) -> DataFrame:
    """One row a (doc_id, item_id) that match: best similarity, its first window, the Hamming distance."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = docs.sparkSession.createDataFrame([], DDL)
    for items, more in _slices(benchmark):
        match = _matcher(items, k, threshold, radius)

        def scan(batches, match=match):
            for t in B.pieces(batches):
                ids = t["doc_id"].to_pylist()
                rows = [(ids[d], i, -s, w, n, far) for (d, i), (s, w, n, far) in match(t).items()]
                yield from B.to_table(rows, HITS).to_batches()

        hits = docs.mapInArrow(scan, DDL)
        found = found.union(B.stored(hits) if more else hits)
    order = F.struct((-F.col("similarity")).alias("o"), "start_word", "n_words", "distance")
    return (found.groupBy("doc_id", "item_id").agg(F.min(order).alias("b"))
            .select("doc_id", "item_id", (-F.col("b.o")).alias("similarity"), "b.start_word", "b.n_words", "b.distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int = 31) -> DataFrame:
    """The documents that match no item, with all their columns; judged and dropped in one pass a slice."""
    for items, more in _slices(benchmark):
        match = _matcher(items, k, threshold, radius)

        def keep(batches, match=match):
            for t in B.pieces(batches):
                clean = np.ones(t.num_rows, bool)
                clean[[d for d, _ in match(t)]] = False
                yield from t.filter(pa.array(clean)).to_batches()

        docs = docs.mapInArrow(keep, docs.schema)
        docs = B.stored(docs) if more else docs
    return docs
