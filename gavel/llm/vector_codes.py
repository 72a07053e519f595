"""Vector code compression: product codes whose nearest entries come from equal-average search.

Components become integers ``floor(scale * x)``; a vector is cut into equal consecutive parts and
every part position has a codebook of its own. A part's nearest entry (squared Euclidean distance)
is searched from the entry whose component sum is nearest to the part's own: entries are sorted by
sum, and the search expands outward on both sides. By Cauchy-Schwarz a squared sum gap over the
part's dimension is a lower bound of the distance, so a part is settled as soon as that bound
strictly exceeds its best distance (an equal one might still be a tie of a lower index).

Codebooks start from the vectors of the least ids and are refined in rounds over all rows: a task
adds up the components of its parts by entry, Spark sums them, and the driver sees one row a
codebook component. No vector is shuffled; each round is one scan.

Defined results: a vector that is null, holds a null, NaN or infinite component, or one whose
scaled value leaves 32 bits (its squared error could leave a long) is dropped. The dimension is
that of the first starting vector; vectors of another length have null ``code`` and ``error``.
A dimension that the parts don't divide is filled up with zeros. Fewer vectors than entries give
smaller codebooks; an empty table gives no rows and an empty codebook. Equal distances go to the
lower index, equal ids (null last) start in order of their vectors. Repeated rows are rows of
their own. An error beyond a long is null. Long vectors cost memory by Arrow batch alone. Extra
columns, whatever their names, are ignored.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B

LIMIT = 2.0 ** 31
NARROW = 2 ** 26  # squares of differences of smaller integers add up within 64 bits
SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("pos", pa.int32()), ("s", pa.int64()), ("n", pa.int64())])
LONGEST = 2 ** 63 - 1


def usable(vector: Column, scale: int) -> Column:
    """Whether all components are there, finite, and integers of 32 bits after scaling."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x.cast("double") * F.lit(float(scale))) < F.lit(LIMIT)), F.lit(False))), F.lit(False))


def integers(rows: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """(vectors, parts, width) of ``floor(scale * x)``, zeros beyond the last component."""
    x = np.floor(rows.astype(np.float64) * scale).astype(np.int64)
    width = -(-x.shape[1] // parts)
    out = np.zeros((len(x), parts * width), np.int64)
    out[:, :x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each row; ties to the lower index."""
    n, width = x.shape
    if n and width and max(int(np.abs(x).max()), int(np.abs(book).max(initial=0))) > NARROW:
        x, book = x.astype(object), book.astype(object)  # exact beyond 64 bits
    sums = book.sum(1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    mine = x.sum(1)
    high = np.searchsorted(sums, mine)
    low = high - 1
    best, entry = np.full(n, -1, x.dtype), np.zeros(n, np.int64)
    left = np.arange(n)
    for _ in range(len(book)):  # every step looks at one entry of each part that isn't settled
        lo, hi, s = low[left], high[left], mine[left]
        up = s - sums[np.maximum(lo, 0)]
        down = sums[np.minimum(hi, len(sums) - 1)] - s
        take_low = (hi >= len(sums)) | ((lo >= 0) & (up <= down))
        gap = np.where(take_low, up, down)
        new = best[left] < 0
        open_ = new | (gap * gap <= best[left] * width)
        left, take_low, lo, hi = left[open_], take_low[open_], lo[open_], hi[open_]
        if not len(left):
            break
        e = order[np.where(take_low, lo, hi)]
        d = ((x[left] - book[e]) ** 2).sum(1)
        nearer = (best[left] < 0) | (d < best[left]) | ((d == best[left]) & (e < entry[left]))
        best[left[nearer]], entry[left[nearer]] = d[nearer], e[nearer]
        low[left[take_low]] -= 1
        high[left[~take_low]] += 1
    return entry, best


def _fitting(batch: pa.RecordBatch, dim: int, scale: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch have the dimension, and their integers."""
    column = batch.column("vector")
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    fits = sizes == dim
    flat = (column if fits.all() else column.filter(pa.array(fits))).flatten().to_numpy(zero_copy_only=False)
    return fits, integers(flat.reshape(int(fits.sum()), dim), scale, parts)


class Codebooks:
    """Entries as integers (parts, entries, width), and how to get from a vector to them."""

    def __init__(self, entries: np.ndarray, dim: int, scale: int):
        self.entries, self.dim, self.scale = entries, dim, scale

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def sha256(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def sums(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per entry: the parts nearest to it, and the sums of their components."""
        p, k, width = self.entries.shape
        total, count = np.zeros((p, k, width), np.int64), np.zeros((p, k), np.int64)
        for batch in batches:
            _, x = _fitting(batch, self.dim, self.scale, p)
            for j in range(p):
                entry, _ = nearest(x[:, j], self.entries[j])
                n = np.bincount(entry, minlength=k)
                some = np.flatnonzero(n)
                if len(some) and width:
                    order = np.argsort(entry.astype(np.uint8), kind="stable")
                    total[j, some] += np.add.reduceat(x[order, j], np.cumsum(n[some]) - n[some])
                count[j] += n
        part, at = np.nonzero(count)
        rows = np.repeat(np.arange(len(part)), width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[rows], pa.int32()), pa.array(at[rows], pa.int32()), pa.array(np.tile(np.arange(width), len(part)), pa.int32()),
             pa.array(total[part, at].ravel()), pa.array(count[part, at][rows])], schema=SUMS)

    def encode(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Replaces ``vector`` by ``code`` and ``error``."""
        for batch in batches:
            fits, x = _fitting(batch, self.dim, self.scale, self.parts)
            code, error = np.zeros((len(x), self.parts), np.uint8), [0] * len(x)
            for j in range(self.parts):
                code[:, j], d = nearest(x[:, j], self.entries[j])
                error = [a + b for a, b in zip(error, d.tolist())]
            at = iter(range(len(x)))
            where = [next(at) if f else None for f in fits.tolist()]
            codes = [None if i is None else code[i].tobytes().hex() for i in where]
            errors = [None if i is None or error[i] > LONGEST else error[i] for i in where]
            kept = [i for i, name in enumerate(batch.schema.names) if name != "vector"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in kept] + [pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                names=[batch.schema.names[i] for i in kept] + ["code", "error"])


def _vectors(vectors: DataFrame, scale: int) -> DataFrame:
    return (vectors.select(F.col("vec_id").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("vector"))
            .where(usable(F.col("vector"), scale)))


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codebooks:
    """Codebooks from all rows of (vec_id, label, embedding); ``entries`` is 256 at most."""
    if not 0 < entries <= 256:
        raise ValueError("entries must be 1 to 256")
    rows = _vectors(vectors, scale)
    start = rows.select("vec_id", "vector").orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).collect()
    dim = len(start[0].vector) if start else 0
    first = [r.vector for r in start if len(r.vector) == dim]
    books = Codebooks(integers(np.array(first, np.float64).reshape(len(first), dim), scale, parts).transpose(1, 0, 2), dim, scale)
    width = books.entries.shape[2]
    for _ in range(rounds if start and width else 0):
        sums = (rows.select("vector").mapInArrow(books.sums, "part int, entry int, pos int, s long, n long")
                .groupBy("part", "entry", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")))
        moved = books.entries.copy()
        for r in sums.collect():  # bounded by the codebooks' components
            moved[r.part, r.entry, r.pos] = int(r.s) // r.n
        books = Codebooks(moved, dim, scale)
    return books


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """One row a kept vector: vec_id, label, code, error, label_error, codebooks_sha256."""
    books = fit(vectors, parts, entries, rounds, scale)
    rows = _vectors(vectors, scale)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = rows.mapInArrow(books.encode, f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")
    # nulls are a label of their own
    coded = B.stored(coded.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    by_label = coded.groupBy("__label").agg(F.sum("error").alias("label_error"))
    return B.attach(coded, by_label, "__label", "vec_id", "inner").select(
        "vec_id", "label", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
