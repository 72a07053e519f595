"""LM scoring with a Brown class model: word classes from exchange clustering, and a class
bigram model whose transitions and emissions are counted over the whole training corpus.

``P(w | previous) = P(class(w) | class(previous)) * P(w | class(w))``. A word that training never
saw is one more class, entered with the Good-Turing share of once-seen words after the previous
class; the single unknown word is then spelled byte by byte from the training words' bytes, its end
included, so that the probabilities of all texts of a length add up to one at most. The end of a text
is a token and a class; it also stands before its first word.

1. Coding. A task's documents are cut into blocks of some 16 MB of text; a block is one row: its
   distinct words' hashes with their training counts and spelling costs, and its documents as word
   numbers. Texts are read here and are never shuffled. N, V and the ``core`` most frequent words
   (a parameter) come from counts packed by block and hash bucket.
2. First classes. The bigram counts of core words over the whole corpus (a bounded matrix) go to
   the driver, where exchange clustering moves each word to the class that raises the likelihood
   most, until no word moves. This only seeds the next step.
3. All words, the core's too, in rounds. A block packs, for its words, the counts of the current classes
   to their left and right; a bucket adds them up, which is the round's one stored table. Its sum over
   all words is the class matrix; by it each word of the vocabulary moves to the class with the
   largest exchange gain, its own counts taken out. All words of a round move at once; the rounds end
   when one raises the log likelihood by less than RISE a token (one that lowers it is undone).
   In the first round neighbours outside the core share one class.
4. Blocks and their words' classes and counts meet again. A document keeps its class bigram
   counts; those of training documents make the transition matrix, and all are scored.

The vocabulary is never brought together: only N, V, core words, byte counts and class matrices
reach the driver. Words are named by 64-bit hashes; counts travel in as many bytes as they need.
A round's tables replace those before, so the disk holds one round.

Defined results: null text: no words, the end token alone; a null doc_id counts as training;
without training documents every token is unknown, base_score is 0, and a text ends or goes on with a
word of equally likely bytes with probability 1/2 each. A text longer than a block is a block of its
own. Of equally frequent words the one of the smaller hash is first in the core; of equal gains a word
stays, else takes the first class from its hash on. Repeated rows are rows of their own. An empty
table gives no rows. Extra columns, whatever their names, are ignored.
"""
from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B
from gavel.llm import _tokens as T

CORE, CLASSES = 500, 32
RISE, WORDS_AT_ONCE, FEW_COUNTS = 0.002, 2048, 32
TOKENS_AT_ONCE, CODED_AT_ONCE = 200_000, 2_000_000  # tokens, bytes of text: what a block's temporary arrays span
COST = 1000  # spelling costs are whole thousandths of a power of ten, rounded up
PACKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
TALLY = pa.schema([("words", pa.int64()), ("tokens", pa.int64()), ("top", pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))])
PAIRS = pa.schema([("pair", pa.int32()), ("n", pa.int64())])
CODED = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("ns", pa.binary()), ("costs", pa.binary()), ("seq", pa.binary()),
                   ("sizes", pa.binary()), ("ids", pa.list_(pa.int64())), ("train", pa.list_(pa.bool_()))])
DDL_CODED = "block long, keys binary, ns binary, costs binary, seq binary, sizes binary, ids array<long>, train array<boolean>"
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("now", pa.binary()), ("entries", pa.binary()),
                  ("ctx", pa.binary()), ("counts", pa.binary())])
DDL_SENT = "bucket int, block long, keys binary, now binary, entries binary, ctx binary, counts binary"
STATE = pa.schema([("bucket", pa.int32()), ("spread", pa.binary()), ("now", pa.binary()), ("entries", pa.binary()), ("ctx", pa.binary()),
                   ("counts", pa.binary()), ("blocks", pa.list_(pa.int64())), ("words", pa.list_(pa.binary()))])
DDL_STATE = ("bucket int, spread binary, now binary, entries binary, ctx binary, counts binary, blocks array<long>, "
             "words array<binary>")
BACK = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("classes", pa.binary()), ("counts", pa.binary())])
STATS = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                   ("base", pa.float64()), ("emit", pa.float64()), ("pairs", pa.binary()), ("ns", pa.binary())])


def planes(x: np.ndarray) -> bytes:
    """Integers from 0 on in as many bytes as the largest needs, all bytes of equal weight together: small ones leave runs of zeros."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    width = raw[0]
    x = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1).T
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :width] = x
    return out.view(np.int64).ravel()


def narrow(raw: bytes) -> np.ndarray:
    """As ``unplanes``, in half the bytes where they do: for the word numbers of a block's whole text."""
    width = raw[0]
    if width > 3:
        return unplanes(raw)
    x = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros(x.shape[1], np.int32)
    for i in range(width):
        out |= x[i].astype(np.int32) << (8 * i)
    return out


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each is there."""
    return runs_sorted(np.sort(x))


def runs_sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate(([len(x) > 0], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[begin], np.diff(np.append(begin, len(x)))


def phi(x):
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, n_words: int, n_classes: int) -> np.ndarray:
    """Classes of the first ``n_words`` of a bigram matrix; what follows are classes of their own.

    Words start by frequency rank, in turn; each round offers every word to every class. A move
    raises the likelihood, so the rounds come to an end.
    """
    extra = counts.shape[0] - n_words
    cls = np.concatenate([np.arange(n_words) % n_classes, n_classes + np.arange(extra)])
    size = n_classes + extra
    onehot = np.eye(size)[cls]
    g = onehot.T @ counts @ onehot
    moved = 1
    while moved:
        moved = 0
        for w in range(n_words):
            a, same = cls[w], counts[w, w]
            right = np.bincount(cls, counts[w], size)
            left = np.bincount(cls, counts[:, w], size)
            right[a] -= same
            left[a] -= same
            n_right, n_left = right.sum() + same, left.sum() + same
            if n_right + n_left == 0:
                continue
            g[a] -= right
            g[:, a] -= left
            g[a, a] -= same
            at = np.arange(n_classes)
            rows, cols = g[:n_classes], g[:, :n_classes]
            gain = (phi(rows + right) - phi(rows)).sum(1) + (phi(cols + left[:, None]) - phi(cols)).sum(0)
            own = g[at, at]  # the cell that is in both sums
            gain += phi(own + right[at] + left[at] + same) + phi(own) - phi(own + right[at]) - phi(own + left[at])
            r, c = rows.sum(1) + left[:n_classes], cols.sum(0) + right[:n_classes]  # pairs with the word are pairs still
            gain -= phi(r + n_right) - phi(r) + phi(c + n_left) - phi(c)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += a != b
            cls[w] = b
            g[b] += right
            g[:, b] += left
            g[b, b] += same
    return cls[:n_words]

def _letters(batches):
    """Bytes of the words (A-Z as a-z), 256 for a word's end, and how often each is there."""
    total, space = np.zeros(257, np.int64), T.WHITE
    for t in B.pieces(batches):
        data, off = T.buffers(B.column_of(t, "text"))
        total[:256] += np.bincount(data, minlength=256)
        inside = ~space[data]
        last = np.ones(len(data), bool)
        last[:-1] = ~inside[1:]
        ends = off[1:] - 1
        last[ends[ends >= 0]] = True
        total[256] += int((inside & last).sum())
    total[97:123] += total[65:91]
    total[65:91] = 0
    total[:256][space] = 0
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=PAIRS)


def spelling(letters: np.ndarray) -> np.ndarray:
    """Cost of each byte and of a word's end (256) in thousandths, so that all words' probabilities add up to one at most."""
    p = (letters + 0.5) / (letters.sum() + 0.5 * 257)
    cost = np.ceil(-np.log10(p) * COST).astype(np.int64)
    cost[65:91] = cost[97:123]
    return cost


def _code(cost: np.ndarray, most: int):
    """One row a block: distinct words, and the documents as word numbers."""
    def code(batches):
        for i, t in enumerate(B.pieces(batches, most=most)):
            train = B.column_of(t, "train").to_numpy(zero_copy_only=False)
            parts, sizes = [], []
            for part in B.pieces(t.to_batches(), most=CODED_AT_ONCE):
                data, off = T.buffers(B.column_of(part, "text"))
                h, start, end, counts = T.words(data, off, fold=True)
                sizes.append(counts)
                keys, index, order = T.distinct(h)
                one = order[np.searchsorted(index[order], np.arange(len(keys)))]  # an occurrence of each word
                size = end[one] - start[one]
                first = np.cumsum(size) - size
                letters = data[np.repeat(start[one] - first, size) + np.arange(int(size.sum()))]
                parts.append((keys, index.astype(np.int32), np.add.reduceat(cost[letters], first) if len(one) else size))
            counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            keys, to, _ = T.distinct(np.concatenate([x for x, _, _ in parts]) if parts else np.zeros(0, np.uint64))
            spelled = np.zeros(len(keys), np.int64)
            spelled[to] = np.concatenate([x for _, _, x in parts]) if parts else 0
            at = np.cumsum([0] + [len(x) for x, _, _ in parts])
            index = np.concatenate([to[x:x + len(y)].astype(np.int32)[z] for x, (y, z, _) in zip(at, parts)]) if parts else np.zeros(0, np.int32)
            del parts
            yield from B.to_table([((TaskContext.get().partitionId() << 32) + i, keys.tobytes(),
                                    planes(np.bincount(index[np.repeat(train, counts)], minlength=len(keys))),
                                    planes(spelled + cost[256]), planes(index), planes(counts),
                                    t["doc_id"].to_pylist(), train.tolist())], CODED).to_batches()

    return code


def _rows(batches):
    """Coded blocks one by one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _tally(n: int):
    """The words of each block with training counts, packed for n buckets."""
    def tally(batches):
        for row in _rows(batches):
            keys, counts = np.frombuffer(row["keys"], np.uint64), unplanes(row["ns"])
            keys, counts = keys[counts > 0], counts[counts > 0]
            to, at = T.slices(keys, n)
            yield from B.to_table([(int(b), keys[x:y].tobytes(), planes(counts[x:y])) for b, x, y in zip(to, at[:-1], at[1:])], PACKED).to_batches()

    return tally


def _totals(index: np.ndarray, amounts: np.ndarray, n: int) -> np.ndarray:
    """Whole-number sums by index (bincount's are exact as long as they fit a double)."""
    out = np.zeros(n, np.int64)
    np.add.at(out, index, amounts)
    return out


def _add_up(core: int):
    def add_up(sent: pa.Table) -> pa.Table:
        keys, index, _ = T.distinct(np.concatenate([np.frombuffer(x, np.uint64) for x in sent["keys"].to_pylist()]))
        counts = _totals(index, np.concatenate([unplanes(x) for x in sent["counts"].to_pylist()]), len(keys))
        top = np.lexsort((keys, -counts))[:core]
        return B.to_table([(len(keys), int(counts.sum()), [{"h": int(h), "n": int(n)} for h, n in zip(
            keys[top].view(np.int64), counts[top])])], TALLY)

    return add_up


class Core:
    """The core words by hash: their place by frequency, count and class."""

    def __init__(self, hashes: list[int], counts: list[int]):
        h = np.array(hashes, np.int64).view(np.uint64)
        self.rank = np.argsort(h, kind="stable")
        self.hash = h[self.rank]
        self.counts = np.array(counts, np.int64)
        self.cls = np.zeros(len(h), np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Frequency rank of each word; -1: not in the core."""
        if not len(self.hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.rank[at], -1)


def _with_ends(values: np.ndarray, counts: np.ndarray, end: int) -> np.ndarray:
    """A value per word -> per token: one end before the first text and one after each."""
    out = np.full(len(values) + len(counts) + 1, end, values.dtype)
    doc = np.repeat(np.arange(len(counts)), counts)
    out[np.arange(len(values)) + doc + 1] = values
    return out


def _training(row: dict, end: int) -> np.ndarray:
    """The word numbers of a block's training texts, with ``end`` before the first and after each."""
    counts, train = unplanes(row["sizes"]), np.array(row["train"], bool)
    return _with_ends(narrow(row["seq"])[np.repeat(train, counts)], counts[train], end)


def _core_pairs(core: Core):
    n = len(core.hash)

    def count_pairs(batches):
        total = np.zeros((n + 2) ** 2, np.int64)
        for row in _rows(batches):
            keys = np.frombuffer(row["keys"], np.uint64)
            place = core.places(keys)
            s = np.append(np.where(place < 0, n, place), n + 1)[_training(row, len(keys))]
            total += np.bincount(s[:-1] * (n + 2) + s[1:], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=PAIRS)

    return count_pairs


def _classes(keys: np.ndarray, back: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and training count of a block's words, as the buckets sent them back."""
    to, cut = T.slices(keys, n)
    where = dict(zip(to.tolist(), range(len(to))))
    cls, seen = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for bucket, c, m in zip(back["bucket"].to_pylist(), back["classes"].to_pylist(), back["counts"].to_pylist()):
        x, y = cut[where[bucket]], cut[where[bucket] + 1]
        cls[x:y], seen[x:y] = unplanes(c), unplanes(m)
    return cls, seen


def _contexts(row: dict, keys: np.ndarray, cls: np.ndarray, k: int, n: int) -> list[tuple]:
    """A block's words with their classes now, and the classes beside them: left, right, and the word itself."""
    width = k + 2
    stride, end = 2 * width + 1, len(keys)
    s = _training(row, end)
    small = np.int32 if (end + 1) * stride < 1 << 31 else np.int64
    s, of = s.astype(small, copy=False), np.append(cls, k + 1).astype(small)
    first, second = s[:-1], s[1:]
    # the right, left and own sides fill one array, in place of several of the block's length
    right, left, same = first < end, second < end, (first == second) & (first < end)
    a, b = int(right.sum()), int(left.sum())
    cells = np.empty(a + b + int(same.sum()), small)
    np.multiply(first[right], stride, out=cells[:a])
    cells[:a] += of[second[right]] + small(width)
    np.multiply(second[left], stride, out=cells[a:a + b])
    cells[a:a + b] += of[first[left]]
    np.multiply(first[same], stride, out=cells[a + b:])
    cells[a + b:] += 2 * width
    del s, first, second, right, left, same
    cells.sort()
    cell, amount = runs_sorted(cells)
    del cells
    word, ctx = np.divmod(cell, stride)
    each = np.bincount(word, minlength=len(keys))
    begin = np.concatenate(([0], np.cumsum(each)))
    to, cut = T.slices(keys, n)
    return [(int(b), row["block"], keys[x:y].tobytes(), planes(cls[x:y]), planes(each[x:y]),
             planes(ctx[begin[x]:begin[y]]), planes(amount[begin[x]:begin[y]])) for b, x, y in zip(to, cut[:-1], cut[1:])]


def _seed(core: Core, k: int, n: int):
    """The first round's contexts: the core's classes, and k for all other words."""
    def seed(batches):
        for row in _rows(batches):
            keys = np.frombuffer(row["keys"], np.uint64)
            place = core.places(keys)
            cls = np.where(place < 0, k, core.cls[place] if len(core.cls) else k)
            yield from B.to_table(_contexts(row, keys, cls, k, n), SENT).to_batches()

    return seed


def _send(k: int, n: int):
    """A later round's contexts, by the classes of the round before."""
    def send(coded: pa.Table, back: pa.Table) -> pa.Table:
        out = []
        for row in coded.to_pylist():
            keys = np.frombuffer(row["keys"], np.uint64)
            out += _contexts(row, keys, _classes(keys, back, n)[0], k, n)
        return B.to_table(out, SENT)

    return send


def _gather(k: int):
    """A bucket's words: their contexts added up over the blocks, and which of them each block has."""
    stride = 2 * (k + 2) + 1

    def gather(sent: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in sent["keys"].to_pylist()]
        keys, index, _ = T.distinct(np.concatenate(parts))
        at = np.cumsum([0] + [len(p) for p in parts])
        now = np.zeros(len(keys), np.int64)
        now[index] = np.concatenate([unplanes(x) for x in sent["now"].to_pylist()])
        each = np.concatenate([unplanes(x) for x in sent["entries"].to_pylist()])
        ctx = np.concatenate([unplanes(x) for x in sent["ctx"].to_pylist()])
        amount = np.concatenate([unplanes(x) for x in sent["counts"].to_pylist()])
        cell, where, _ = T.distinct(np.repeat(index, each) * stride + ctx)
        word, side = np.divmod(cell, stride)
        return B.to_table([(sent["bucket"][0].as_py(), planes(keys % T.U64(k)), planes(now), planes(np.bincount(word, minlength=len(keys))),
                            planes(side), planes(_totals(where, amount, len(cell))), sent["block"].to_pylist(),
                            [planes(index[x:y]) for x, y in zip(at[:-1], at[1:])])], STATE)

    return gather


def _sum_classes(k: int):
    """Class bigrams of the words' contexts: each word's right side, and the words after an end."""
    width = k + 2

    def add_up(batches):
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for now, entries, ctx, counts in zip(*(batch.column(c).to_pylist() for c in ("now", "entries", "ctx", "counts"))):
                cls, ctx, m = np.repeat(unplanes(now), unplanes(entries)), unplanes(ctx), unplanes(counts)
                right, start = (ctx >= width) & (ctx < 2 * width), ctx == k + 1
                cell = np.concatenate([cls[right] * width + ctx[right] - width, (k + 1) * width + cls[start]])
                total += _totals(cell, np.concatenate([m[right], m[start]]), len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=PAIRS)

    return add_up


def likelihood(g: np.ndarray) -> float:
    """Log likelihood of class bigrams, but for what no exchange changes."""
    return float(phi(g).sum() - phi(g.sum(0)).sum() - phi(g.sum(1)).sum())


def _small_rises(table: np.ndarray) -> np.ndarray:
    """How phi rises in every cell with 0 to FEW_COUNTS more counts."""
    return np.stack([phi(table + m) - phi(table) for m in range(FEW_COUNTS + 1)])


def _rises(table: np.ndarray, small: np.ndarray, row: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How phi rises in the cells of the given rows with ``m`` more counts: looked up for the many small counts."""
    few = m <= FEW_COUNTS
    out = small[np.where(few, m, 0).astype(np.int64), row]
    many = np.flatnonzero(~few)
    out[many] = phi(table[row[many]] + m[many, None]) - phi(table[row[many]])
    return out


def alike(word: np.ndarray, ctx: np.ndarray, total: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the same class and the same counts of the same contexts: one of each kind, and each word's kind.

    Most words are rare and share their kind; kinds are told apart by 64-bit hashes.
    """
    h = T.mix(T.mix(ctx.astype(np.uint64) + T.GOLDEN) ^ T.mix(total.astype(np.uint64)))
    kind = T.mix(now.astype(np.uint64) + T.U64(1))
    np.add.at(kind, word, h)
    _, one, of = np.unique(kind, return_index=True, return_inverse=True)
    return one, of


def place(word: np.ndarray, ctx: np.ndarray, total: np.ndarray, now: np.ndarray, g: np.ndarray, k: int,
          spread: np.ndarray) -> np.ndarray:
    """The best of the first k classes for every word, with its own counts taken out of the class bigrams ``g``.

    Cells (word, ctx, total) are sorted by word; ``ctx`` is the class to the left, the class to
    the right plus k + 2, or 2 * (k + 2) for the word itself. Words without counts get k + 1.
    Of equal classes (such as empty ones) the first from ``spread`` on is taken, so that words don't move as one.
    """
    width, at = k + 2, np.arange(k)
    rows, cols, diagonal = g[:k].sum(1), g[:, :k].sum(0), g[at, at]
    by_right, by_left = np.ascontiguousarray(g[:k].T), g[:, :k]
    rise_right, rise_left, rise_rows, rise_cols = (_small_rises(t) for t in (by_right, by_left, rows[None, :], cols[None, :]))
    one, of = alike(word, ctx, total, now)
    number = np.full(len(now), -1)
    number[one] = np.arange(len(one))
    word = number[word]
    order = np.flatnonzero(word >= 0)
    order = order[np.argsort(word[order], kind="stable")]
    word, ctx, total, now_one = word[order], ctx[order], total[order], now[one]
    tied = np.zeros((len(one), k), bool)
    stays, empty = np.zeros(len(one), bool), np.zeros(len(one), bool)
    for lo in range(0, len(one), WORDS_AT_ONCE):
        a = now_one[lo:lo + WORDS_AT_ONCE].astype(np.int64)
        i = np.arange(len(a))
        x, y = np.searchsorted(word, [lo, lo + len(a)])
        dense = np.zeros((len(a), 2 * width + 1))
        dense[word[x:y] - lo, ctx[x:y]] = total[x:y]
        left, right, same = dense[:, :width], dense[:, width:2 * width], dense[:, 2 * width]
        n = left.sum(1)
        left[i, a] -= same
        right[i, a] -= same
        gain = np.zeros((len(a), k))
        for side, other, table, rise in ((right, left, by_right, rise_right), (left, right, by_left, rise_left)):
            w, c = np.nonzero(side)
            if not len(w):
                continue
            m = side[w, c]
            up = _rises(table, rise, c, m)
            mine = np.flatnonzero(a[w] < k)  # its own class has lost the word's counts
            t = table[c[mine], a[w[mine]]]
            up[mine, a[w[mine]]] = phi(t) - phi(t - m[mine])
            selves = np.flatnonzero(c == a[w])  # and so has the context that is the word's own class
            v = w[selves]
            own = at == a[v, None]
            base = table[c[selves]] - own * m[selves, None] - other[v, :k] - own * same[v, None]
            up[selves] = phi(base + m[selves, None]) - phi(base)
            begin = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            gain[w[begin]] += np.add.reduceat(up, begin, axis=0)
        # the cell that is in both sums, where both have counts or the word follows itself
        w, b = np.nonzero(((right[:, :k] > 0) & (left[:, :k] > 0)) | (same[:, None] > 0))
        ri, le, sa = right[w, b], left[w, b], same[w]
        cell = diagonal[b] - (b == a[w]) * (ri + le + sa)
        gain[w, b] += phi(cell + ri + le + sa) + phi(cell) - phi(cell + ri) - phi(cell + le)
        for sums, rise in ((rows, rise_rows), (cols, rise_cols)):
            up = _rises(sums[None, :], rise, np.zeros(len(a), int), n)
            mine = np.flatnonzero(a < k)
            t = sums[a[mine]]
            up[mine, a[mine]] = phi(t) - phi(t - n[mine])
            gain -= up
        best = gain.max(1)
        tied[lo:lo + len(a)] = gain >= best[:, None] - 1e-9
        stays[lo:lo + len(a)] = (a < k) & (best <= gain[i, np.minimum(a, k - 1)] + 1e-9)
        empty[lo:lo + len(a)] = n == 0
    out = np.full(len(now), k + 1)
    for lo in range(0, len(now), 1 << 16):
        kind, mine = of[lo:lo + (1 << 16)], spread[lo:lo + (1 << 16), None]
        best = np.where(tied[kind], (at - mine) % k, k).argmin(1)
        best = np.where(stays[kind], now[lo:lo + (1 << 16)], best)
        out[lo:lo + (1 << 16)] = np.where(empty[kind], k + 1, best)
    return out


def _assign(g: np.ndarray, k: int):
    """The class of each word after a round, and its count, for the blocks that have it."""
    width = k + 2

    def assign(batches):
        for row in _rows(batches):
            now, side, total = unplanes(row["now"]), unplanes(row["ctx"]), unplanes(row["counts"])
            word = np.repeat(np.arange(len(now)), unplanes(row["entries"]))
            n = _totals(word[side < width], total[side < width], len(now))
            cls = place(word, side, total, now, g, k, unplanes(row["spread"]))
            yield from B.to_table([(block, row["bucket"], planes(cls[i]), planes(n[i])) for block, i in zip(
                row["blocks"], map(unplanes, row["words"]))], BACK).to_batches()

    return assign


def _describe(k: int, n: int, ends: int):
    """Per document: token counts, sums of logs, and class bigrams. Classes: k, end k, unknown k + 1.

    The last column of the pairs' matrix counts tokens seen once in training, by the class before.
    """
    width = k + 3

    def describe(coded: pa.Table, back: pa.Table) -> pa.Table:
        tables = []
        for row in coded.to_pylist():
            keys, index, counts = np.frombuffer(row["keys"], np.uint64), narrow(row["seq"]), unplanes(row["sizes"])
            cls, seen = _classes(keys, back, n)
            cls = np.where(seen > 0, cls, k + 1)
            of_word = np.where(seen > 0, np.log10(np.maximum(seen, 1)), -unplanes(row["costs"]) / COST)
            half_of_word = np.log10(seen + 0.5)
            cut = np.concatenate(([0], np.cumsum(counts)))
            lo = 0
            while lo < len(counts):  # some documents at a time: nothing below has the block's length
                hi = max(lo + 1, int(np.searchsorted(cut, cut[lo] + TOKENS_AT_ONCE, "right")) - 1)
                tables.append(some_documents(row, lo, counts[lo:hi], index[cut[lo]:cut[hi]], cls, seen, of_word, half_of_word))
                lo = hi
        return pa.concat_tables(tables) if tables else STATS.empty_table()

    def some_documents(row, lo, counts, index, cls, seen, of_word, half_of_word) -> pa.Table:
        c, m, logs, half, out, w = cls[index], seen[index], of_word[index], half_of_word[index], [], 0
        s = _with_ends(c, counts, k)
        once = _with_ends((m == 1).astype(np.int64), counts, 0)
        for i, words in enumerate(counts.tolist()):
            a = w + i
            before, now = s[a:a + words + 1], s[a + 1:a + words + 2]
            single = before[once[a + 1:a + words + 2] > 0]
            some, pair = runs(np.concatenate([before * width + now, single * width + k + 2]))
            known = int((m[w:w + words] > 0).sum()) + (ends > 0)
            out.append((row["ids"][lo + i], row["train"][lo + i], words + 1, known, float(half[w:w + words].sum() + np.log10(ends + 0.5)),
                        float(logs[w:w + words].sum()), planes(some), planes(pair)))
            w += words
        return B.to_table(out, STATS)

    return describe


def _sum_pairs(size: int):
    def add_up(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for p, c in zip(batch.column("pairs").to_pylist(), batch.column("ns").to_pylist()):
                total[unplanes(p)] += unplanes(c)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=PAIRS)

    return add_up


def log_model(g: np.ndarray, k: int) -> np.ndarray:
    """log10 of P(class | class before) / words of the class in training, as pairs are numbered.

    Transitions are smoothed with the class shares (weight: the number of classes); the unknown
    class gets the share of once-seen tokens after the class before, smoothed likewise.
    """
    width = k + 3
    known = g[:k + 2, :k + 1]
    total = known.sum()
    out = np.zeros((width, width))
    if not total:
        out[:, k:k + 2] = np.log10(0.5)
        return out.ravel()
    share = (known.sum(0) + 0.5) / (total + 0.5 * (k + 1))
    row = known.sum(1, keepdims=True)
    step = (known + (k + 1) * share) / (row + k + 1)
    once = g[:k + 2, k + 2:k + 3]
    rate = (once + once.sum() / total + 0.5 / total) / (row + 1 + 1 / total)
    words = np.maximum(known.sum(0), 1)
    words[k] = 1  # the end is the only word of its class
    out[:k + 2, :k + 1] = np.log10((1 - rate) * step) - np.log10(words)
    out[:k + 2, k + 1] = np.log10(rate[:, 0])
    return out.ravel()


def _matrix(rows: DataFrame, side: int) -> np.ndarray:
    """Summed (pair, n) rows as a matrix of ``side`` rows and columns."""
    out = np.zeros((side, side))
    for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[divmod(r.pair, side)] = r.n
    return out


def score_corpus(docs: DataFrame, train: Column, core_words: int = CORE, classes: int = CLASSES,
                 layout: tuple[int, int] | None = None) -> DataFrame:
    """One row a document: doc_id, train, n_tokens, n_known, train_tokens, train_types, base_score, score, perplexity.

    ``layout``: bytes of text a block and number of buckets (see ``_blocks.layout``).
    """
    spark, k = docs.sparkSession, classes
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce(train, F.lit(True)).alias("train"))
    most, buckets = layout or B.layout(B.text_bytes(docs), B.partitions(spark))
    letters = np.zeros(257, np.int64)
    for r in (docs.where("train").select("text").mapInArrow(_letters, "pair int, n long")
              .groupBy("pair").agg(F.sum("n").alias("n")).collect()):  # 257 rows
        letters[r.pair] = r.n
    steps = B.Steps(spark)
    coded = steps.keep("coded", docs.mapInArrow(_code(spelling(letters), most), DDL_CODED))
    tally = steps.keep("tally", B.grouped(coded.select("keys", "ns").mapInArrow(_tally(buckets), "bucket int, keys binary, counts binary"),
                                          "bucket", _add_up(core_words), "words long, tokens long, top array<struct<h:long,n:long>>"))
    words, tokens = (x or 0 for x in tally.agg(F.sum("words"), F.sum("tokens")).first())
    ends = docs.where("train").count()
    n_train, n_types = tokens + ends, words + (ends > 0)
    top = (tally.select(F.explode("top").alias("t")).select("t.h", "t.n")
           .orderBy(F.desc("n"), "h").limit(core_words).collect())  # bounded by core_words
    core = Core([r.h for r in top], [r.n for r in top])
    pairs = coded.select("keys", "seq", "sizes", "train").mapInArrow(_core_pairs(core), "pair int, n long")
    core.cls = exchange(_matrix(pairs, len(top) + 2), len(top), k)  # bounded by core_words squared

    blocks = coded.select("block", "keys", "seq", "sizes", "train")
    back, before, best = None, None, -np.inf
    for turn in count(1):
        sent = blocks.mapInArrow(_seed(core, k, buckets), DDL_SENT) if back is None else B.cogrouped(
            blocks, back, "block", _send(k, buckets), DDL_SENT)
        state = steps.keep("state", B.grouped(sent, "bucket", _gather(k), DDL_STATE))
        g = _matrix(state.mapInArrow(_sum_classes(k), "pair int, n long"), k + 2)  # bounded by the classes squared
        reached = likelihood(g) if back is not None else -np.inf  # the first has one class more
        if back is not None and reached - best < RISE * n_train or before is not None and not n_train:
            back = before if before is not None and reached < best else back
            break
        before, best = back, reached
        # the table of the round before stays: a round that lowers the likelihood is undone
        back = steps.keep(f"back{turn % 2}", state.mapInArrow(_assign(g, k), "block long, bucket int, classes binary, counts binary"))
    stats = B.stored(B.cogrouped(coded.drop("ns"), back, "block", _describe(k, buckets, ends),
                                 "doc_id long, train boolean, n_tokens long, n_known long, base double, emit double, "
                                 "pairs binary, ns binary"))
    for name in list(steps.paths):
        steps.drop(name)
    width = k + 3
    g = _matrix(stats.where("train").select("pairs", "ns").mapInArrow(_sum_pairs(width * width), "pair int, n long"), width)
    model = log_model(g, k)
    model[np.arange(width) * width + width - 1] = 0  # once-seen tokens are counted, not scored
    floor = float(np.log10(n_train + 0.5 * (n_types + 1)))

    def score(batches):
        for batch in batches:
            each = [float(model[unplanes(p)] @ unplanes(c)) for p, c in zip(
                batch.column("pairs").to_pylist(), batch.column("ns").to_pylist())]
            t = pa.Table.from_batches([batch]).drop_columns(["pairs", "ns"]).append_column("walk", pa.array(each, pa.float64()))
            yield from t.to_batches()

    out = stats.mapInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, base double, emit double, walk double")
    return (out.withColumn("base_score", F.col("base") - F.col("n_tokens") * F.lit(floor) if n_train else F.lit(0.0))
            .withColumn("score", F.col("walk") + F.col("emit"))
            .withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
            .select("doc_id", "train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
                    F.lit(n_types).cast("long").alias("train_types"), "base_score", "score", "perplexity"))
