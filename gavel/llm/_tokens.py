"""Word hashing over Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` (or runs of letters and digits). A word's 64-bit hash
is a polynomial over its bytes, read off prefix sums of a whole chunk of text, so that no
Python object is made per word. The constants are fixed: every worker gets the same hash.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@lru_cache(maxsize=8)
def _byte_table(seed: int, fold: bool) -> np.ndarray:
    t = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    if fold:
        t[ord("A"):ord("Z") + 1] = t[ord("a"):ord("z") + 1]
    return t


@lru_cache(maxsize=1)
def _gaps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes part words: white space; all but letters, digits and non-ASCII; line feeds."""
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    other = np.ones(256, bool)
    other[128:] = False
    for a, b in ("09", "AZ", "az"):
        other[ord(a):ord(b) + 1] = False
    line = np.zeros(256, bool)
    line[10] = True
    return space, other, line


SPACE, ALNUM, LINE = 0, 1, 2
WHITE = _gaps()[SPACE]


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 (B is odd), as far as the longest chunk so far."""
    if not _POWERS or len(_POWERS["up"]) < n:
        base = 0x2545F4914F6CDD1D
        n = max(n, CHUNK + 1)
        for name, b in (("up", base), ("down", pow(base, -1, 2**64))):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray, seed: int = 1, fold: bool = False,
          gap: int = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of every word, and the number of words of every text.

    ``fold`` reads A-Z as a-z. ``gap``: what parts words (SPACE), runs of letters and digits
    (ALNUM) or lines that aren't empty (LINE).
    """
    gap_of = _gaps()[gap]
    table = _byte_table(seed, fold)
    first = np.zeros(len(data) + 1, bool)  # a text starts here
    first[off] = True
    hs, ss, es = [], [], []
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + CHUNK)
        while b < n:  # cut where a word can't be
            at = np.flatnonzero(gap_of[data[a + 1:b]] | first[a + 1:b])
            if len(at):
                b = a + 1 + int(at[-1])
                break
            b = min(n, b + CHUNK)
        part = data[a:b]
        inside = ~gap_of[part]
        begin = first[a:b].copy()
        begin[0] = True
        begin[1:] |= ~inside[:-1]
        start = np.flatnonzero(inside & begin)
        stop = np.empty(len(part), bool)
        stop[:-1] = begin[1:] | ~inside[1:]
        stop[-1] = True
        end = np.flatnonzero(inside & stop) + 1
        up, down = _powers(len(part) + 1)
        run = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * up[:len(part)], out=run[1:])
        hs.append(mix((run[end] - run[start]) * down[start]))
        ss.append(start + a)
        es.append(end + a)
        a = b
    h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
    s = np.concatenate(ss) if ss else np.zeros(0, np.int64)
    e = np.concatenate(es) if es else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(s, off))
    return h, s, e, counts


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (the last k - 1 positions have none)."""
    n = max(0, len(h) - k + 1)
    out = h[:n].copy()
    for j in range(1, k):
        out *= GOLDEN
        out += h[j:n + j]
    return mix(out)


def room(counts: np.ndarray) -> np.ndarray:
    """Words from each position to the end of its text, itself included."""
    total = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return ends - np.arange(total)


def shingle_sets(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of every text, sorted, and the offsets of the texts.

    A text of fewer than k words, but one at least, has one shingle: all its words.
    """
    g = grams(h, k)
    sets, sizes, at = [], np.zeros(len(counts) + 1, np.int64), 0
    for i, n in enumerate(counts.tolist()):
        if n >= k:
            x = np.sort(g[at:at + n - k + 1])
            sets.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n:
            sets.append(np.array([_short(h[at:at + n])], np.uint64))
        sizes[i + 1] = len(sets[-1]) if n else 0
        at += n
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.cumsum(sizes)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the value's index of every element, and the sorting order."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    new = np.ones(len(x), bool)
    new[1:] = y[1:] != y[:-1]
    index = np.empty(len(x), np.int64)
    index[order] = np.cumsum(new) - 1
    return y[new], index, order


def slices(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Deals sorted hashes to n buckets by their high bits: the buckets met, and their offsets."""
    to = ((h >> U64(32)) * U64(n)) >> U64(32)
    begin = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(h) else np.zeros(0, np.int64)
    return to[begin].astype(np.int64), np.append(begin, len(h))


def _short(h: np.ndarray) -> int:
    x = U64(len(h))
    with np.errstate(over="ignore"):
        for v in h:
            x = x * GOLDEN + v
    return int(mix(np.array([x]))[0])


def grams_of_rows(x: np.ndarray) -> np.ndarray:
    """One hash for each row of a matrix."""
    out = x[:, 0].copy()
    for j in range(1, x.shape[1]):
        out = mix(out * GOLDEN + x[:, j])
    return out


def set_key(x: np.ndarray) -> str:
    """128-bit name of a sorted set of hashes."""
    from hashlib import blake2b
    return blake2b(x.tobytes(), digest_size=16).hexdigest()


def shorts(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The hash that ``shingle_sets`` gives a text of n words, for the n words from each position on."""
    x = np.full(len(at), n, np.uint64)
    for j in range(n):
        x = x * GOLDEN + h[at + j]
    return mix(x)
