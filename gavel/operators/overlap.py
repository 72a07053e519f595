"""Text overlap scores as Spark jobs.

Both n-gram scores join the texts (or their words' hashes) themselves and pack them where the pairs are scored: a
text's n-grams of an order are a sorted array of 64-bit hashes in which the second, third, ... occurrence of a gram
is an element of its own, so the clipped overlap of two texts is the size of the intersection of two sets. Packed
arrays are many times the text, so they are never shuffled; a task keeps the last ones, up to PACKED_BYTES, as a
text's pairs follow each other. Pairs stay rows of their own (a group of any size is never held together).
Stated parameters (these are our definitions, documented in the README):

* character F-score: orders 1..6 over the text with all whitespace removed, beta = 2;
  per order F = (1 + b^2) P R / (b^2 P + R) (0 when P + R = 0); the score is 100 x the
  mean F over orders where both texts have n-grams; the best reference wins.
* word n-gram score: whitespace tokens, orders 1..4, counts clipped by the maximum
  count over all references, p1 = m1 / t1 and pn = (mn + 1) / (tn + 1) for n > 1,
  brevity penalty against the closest reference length (ties: shorter),
  100 x BP x exp(mean log pn); 0 when the hypothesis is empty or has no unigram match.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..functions.text import WS_CLASS, col_, py_strip, strip_ws_all

CHAR_ORDERS = 6
BETA = 2.0
WORD_ORDERS = 4
PACKED_BYTES = 64_000_000


LONG_PAIR = 4_000_000  # cells of the distance matrix beyond which near copies are looked for first
MOST_EDITS = 1024


def few_edits(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two code point sequences if it is ``most`` at most, by furthest-reaching diagonals.

    With e edits, ``reach`` holds how far each diagonal of the matrix gets; equal code points are free. The work
    follows the length and the square of the distance, not the product of the lengths.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    a, b = np.append(a.astype(np.int64), -1), np.append(b.astype(np.int64), -2)  # ends that equal nothing
    width = 2 * most + 3
    diagonal = np.arange(width) - most - 1  # place in a less place in b
    reach = np.full(width, -1, np.int64)
    for e in range(most + 1):
        if e:
            near = np.full(width + 2, -n - m - 2, np.int64)
            near[1:-1] = np.where(reach >= 0, reach, -n - m - 2)
            reach = np.maximum(np.maximum(near[:-2] + 1, near[1:-1] + 1), near[2:])
            reach = np.minimum(reach, np.minimum(n, m + diagonal))
        else:
            reach[most + 1] = 0
        live = np.flatnonzero((np.abs(diagonal) <= e) & (reach >= 0) & (reach - diagonal >= 0))
        reach[np.abs(diagonal) > e] = -1
        step = 1
        while len(live):  # each diagonal runs on while code points are equal, in stretches that double
            if step > 1 and len(live) == 1:
                x = int(reach[live[0]])
                y, k = x - int(diagonal[live[0]]), min(step, n - x, m - x + int(diagonal[live[0]]))
                unequal = np.flatnonzero(a[x:x + k] != b[y:y + k])
                reach[live[0]] += int(unequal[0]) if len(unequal) else k
                if len(unequal) or not k:
                    break
                step *= 2
                continue
            x = reach[live]
            on = a[x] == b[x - diagonal[live]]
            live = live[on]
            reach[live] += 1
            step = 2 if len(live) == 1 else 1
        if reach[most + 1 + n - m] >= n:
            return e
    return None


@F.pandas_udf(IntegerType())
def _few_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    points = lambda t: np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    return pd.Series([None if x is None or y is None else few_edits(points(x), points(y), MOST_EDITS) for x, y in zip(a, b)], dtype="Int32")


def edit_distance(a, b) -> Column:
    """Levenshtein distance on code points; null texts count as the text 'None'
    (the reference stringifies them). Long pairs up to MOST_EDITS apart cost their length and the square of their
    distance; only long pairs farther apart fill the whole matrix. All give the same distance."""
    s = lambda c: F.coalesce(col_(c).cast("string"), F.lit("None"))
    long = F.length(s(a)).cast("long") * F.length(s(b)) > LONG_PAIR
    return F.coalesce(_few_edits(F.when(long, s(a)), F.when(long, s(b))), F.levenshtein(s(a), s(b)))


_STEP, _ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_HALF = np.uint64(33)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _ONE
    x = (x ^ (x >> _HALF)) * _TWO
    return x ^ (x >> _HALF)


def multiset(grams: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a sorted set: further occurrences of a hash get hashes of their own."""
    x = np.sort(grams)
    if len(x) < 2:
        return x
    at = np.arange(len(x))
    first = np.concatenate(([True], x[1:] != x[:-1]))
    if first.all():
        return x
    again = at - np.maximum.accumulate(np.where(first, at, 0))
    return np.sort(np.where(again > 0, _scramble(x + again.astype(np.uint64) * _STEP), x))


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of one sorted set are in another."""
    if not len(b):
        return np.zeros(len(a), bool)
    return b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a


def _multisets(symbols: np.ndarray, orders: int) -> list[np.ndarray]:
    """A text's n-gram multisets by order."""
    out, h = [], _scramble(symbols + np.uint64(1))
    for n in range(1, orders + 1):
        if n > 1:
            h = _scramble(h[:-1] * _STEP + symbols[n - 1:]) if len(h) > 1 else h[:0]
        out.append(multiset(h))
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _hashes(words: list[int]) -> np.ndarray:
    return np.array(words, np.int64).view(np.uint64)


class Packer:
    """Multisets by order of the texts last seen, up to PACKED_BYTES in all."""

    def __init__(self, read: Callable, orders: int):
        self.read, self.orders, self.kept, self.size = read, orders, OrderedDict(), 0

    def sets(self, text) -> list[np.ndarray]:
        key = text if isinstance(text, str) else tuple(text)
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        out = _multisets(self.read(text), self.orders)
        self.kept[key] = out
        self.size += sum(x.nbytes for x in out)
        while self.size > PACKED_BYTES and len(self.kept) > 1:
            self.size -= sum(x.nbytes for x in self.kept.popitem(last=False)[1])
        return out


def _pairs(hyps: DataFrame, refs: DataFrame, group: str, hyp_key: str, symbols: Column) -> DataFrame:
    """(group, hyp_key, h, r): the symbols of each hypothesis and of each reference of its group.

    Both sides are shuffled by group: a small or unsplittable input would otherwise be scored in one task."""
    h = hyps.select(group, hyp_key, symbols.alias("h"))
    return h.join(refs.select(group, symbols.alias("r")).hint("merge"), group).select(group, hyp_key, "h", "r")


def char_f_score(hyps: DataFrame, refs: DataFrame, group: str, hyp_key: str, ref_key: str, text: str = "text",
                 orders: int = CHAR_ORDERS, beta: float = BETA) -> DataFrame:
    """Best character n-gram F-score of each hypothesis against the references of
    its group. Returns (group, hyp_key, chrf). Keys are unique."""
    pairs = _pairs(hyps, refs, group, hyp_key, F.coalesce(strip_ws_all(text), F.lit("")))
    b2 = beta * beta
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields[:2])

    def score(batches):
        packer = Packer(_code_points, orders)
        for batch in batches:
            out = []
            for hyp, ref in zip(batch.column(2), batch.column(3)):
                f = []
                for a, b in zip(packer.sets(hyp.as_py()), packer.sets(ref.as_py())):
                    if len(a) and len(b):
                        m = int(shared(a, b).sum())
                        p, q = m / len(a), m / len(b)
                        f.append((1 + b2) * p * q / (b2 * p + q) if m else 0.0)
                out.append(100 * sum(f) / len(f) if f else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=[group, hyp_key, "_score"])

    best = pairs.mapInArrow(score, f"{fields}, _score double").groupBy(group, hyp_key).agg(F.max("_score").alias("chrf"))
    return (hyps.select(group, hyp_key).distinct().join(best, [group, hyp_key], "left")
                .withColumn("chrf", F.coalesce("chrf", F.lit(0.0))))


def _tokens(text: str) -> Column:
    return F.filter(F.split(py_strip(text), WS_CLASS + "+"), lambda x: x != "")


def _matches(hyps: DataFrame, refs: DataFrame, group: str, hyp_key: str, ref_key: str, text: str, orders: int) -> DataFrame:
    """(group, hyp_key, m): by order, the hypothesis' n-grams that some reference has as often."""
    words = F.coalesce(F.transform(_tokens(text), lambda w: F.xxhash64(w)), F.array().cast("array<long>"))
    pairs = _pairs(hyps, refs, group, hyp_key, words)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields[:2])

    def found(batches):
        """Each pair's shared elements as bits, in place of the two texts."""
        packer = Packer(_hashes, orders)
        for batch in batches:
            sizes, bits = [], []
            for hyp, ref in zip(batch.column(2), batch.column(3)):
                h, r = packer.sets(hyp.as_py()), packer.sets(ref.as_py())
                sizes.append([len(a) for a in h])
                bits.append(np.packbits(np.concatenate([shared(a, b) for a, b in zip(h, r)])).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.list_(pa.int32())), pa.array(bits, pa.binary())],
                                             names=[group, hyp_key, "hn", "bits"])

    def any_reference(batches):
        """Rows sorted by hypothesis: the union of its bits, one hypothesis at a time."""
        schema = None
        last, sizes, bits = None, None, None

        def row():
            seen = np.unpackbits(bits, count=sum(sizes)).astype(np.int64)
            at = np.cumsum([0, *sizes])
            return (*last, [int(seen[a:b].sum()) for a, b in zip(at[:-1], at[1:])])

        for batch in batches:
            schema = pa.schema([batch.schema.field(0), batch.schema.field(1), ("m", pa.list_(pa.int64()))])
            done = []
            for g, k, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (g, k) != last:
                    if last is not None:
                        done.append(row())
                    last, sizes, bits = (g, k), n, np.frombuffer(raw, np.uint8)
                else:
                    bits = bits | np.frombuffer(raw, np.uint8)
            yield from _rows_table(done, schema)
        if last is not None:
            yield from _rows_table([row()], schema)

    bits = pairs.mapInArrow(found, f"{fields}, hn array<int>, bits binary")
    return (bits.repartition(group, hyp_key).sortWithinPartitions(group, hyp_key).mapInArrow(any_reference, f"{fields}, m array<long>"))


def _rows_table(rows: list[tuple], schema: pa.Schema):
    cols = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema).to_batches()


def word_ngram_score(hyps: DataFrame, refs: DataFrame, group: str, hyp_key: str, ref_key: str, text: str = "text",
                     orders: int = WORD_ORDERS) -> DataFrame:
    """Multi-reference clipped word n-gram precision score (see module docstring). Keys are unique."""
    m = _matches(hyps, refs, group, hyp_key, ref_key, text, orders)
    hl = hyps.select(group, hyp_key, F.size(_tokens(text)).alias("hlen"))
    rl = refs.select(group, F.size(_tokens(text)).alias("rlen"))
    # closest reference length, ties to the shorter one
    closest = (hl.join(rl, group)
                 .groupBy(group, hyp_key)
                 .agg(F.min_by("rlen", F.struct(F.abs(F.col("rlen") - F.col("hlen")), F.col("rlen"))).alias("rlen")))
    out = hl.join(m, [group, hyp_key], "left").join(closest, [group, hyp_key], "left")
    counts = F.coalesce("m", F.array(*[F.lit(0).cast("long")] * orders))
    total = lambda n: F.greatest(F.col("hlen") - n + 1, F.lit(0))
    logs = F.log(F.when(total(1) > 0, F.get(counts, 0) / total(1)))
    for n in range(2, orders + 1):
        logs = logs + F.log((F.get(counts, n - 1) + 1) / (total(n) + 1))
    c, r = F.col("hlen").cast("double"), F.col("rlen").cast("double")
    bp = F.when(c > r, F.lit(1.0)).otherwise(F.exp(1 - r / c))
    score = F.when((F.col("hlen") <= 0) | F.col("hlen").isNull() | (F.get(counts, 0) == 0) | F.col("rlen").isNull(), F.lit(0.0)).otherwise(
        100 * bp * F.exp(logs / orders))
    return out.select(group, hyp_key, score.alias("score"))


def error_reduction(base, new) -> Column:
    """Relative error reduction of two 0-100 scores; base = 100 -> null."""
    from ..functions.text import error_reduction as er
    return er(base, new)
