"""Substring dedup by level-wise doubling.

A word sequence of ``min_words`` that stands in several documents can only be found where
its shorter windows are repeated too. So windows of half that length are judged first, and
only those that are repeated are extended to (at most) twice their length:

1. seed level, ``ceil(min_words / 2)`` words: every block of documents sends the 32-bit
   fingerprints of its distinct windows to hash buckets; a bucket answers which of them
   other blocks have too. Fingerprints only prune: one that collides is sorted out next.
2. target level, ``min_words`` words: only where the two overlapping seed windows are both
   repeated, a window's full 64-bit hash goes out with the least doc_id the block has it in.
   The bucket number comes from the same well-mixed hash, so two sequences are mixed up
   with a probability of about pairs / 2**64.
``remove_repeats`` stops at ``min_words``, which settles every word. ``repeated_passages`` goes
on: windows repeated at one length alone are extended to twice that length until none survives.

Each level is one shuffle of packed arrays (a few bytes a window, hot windows once a block),
not of rows per window. Texts are shuffled once, into blocks, and that exchange is reused.

Defined results: a null text has no words; a null doc_id comes after all others (such rows
don't remove from each other); a repeated doc_id isn't smaller than itself, so rows that
share one keep what they share; fewer than ``min_words`` words: nothing is removed. Extra
columns, whatever their names, are ignored. An empty table gives no rows. A text of any length is read whole.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B
from gavel.llm import _tokens as T

LAST = np.iinfo(np.int64).max  # stands for a null doc_id
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])
BACK = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("found", pa.binary())])
DDL_SENT, DDL_BACK = "bucket int, block int, keys binary, ids binary", "block int, bucket int, found binary"
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
                 ("spans", pa.list_(pa.list_(pa.int64())))])


def _windows(docs: pa.Table, k: int):
    """Word counts, window hashes of k words, where each is whole, and each word's row."""
    data, off = T.buffers(B.column_of(docs, "text"))
    h, _, _, counts = T.words(data, off)
    g = T.grams(h, k)
    whole = T.room(counts)[:len(g)] >= k
    return data, off, counts, g, whole, np.repeat(np.arange(len(counts)), counts)


def _ids(docs: pa.Table) -> np.ndarray:
    return B.column_of(docs, "doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _send(block: int, keys: np.ndarray, packed: np.ndarray, ids: np.ndarray | None, n: int) -> pa.Table:
    """One row for each bucket that the sorted ``keys`` meet."""
    to, at = T.slices(keys, n)
    return B.to_table([(int(b), block, packed[x:y].tobytes(), b"" if ids is None else ids[x:y].tobytes())
                       for b, x, y in zip(to, at[:-1], at[1:])], SENT)


def _seed_level(k: int, n: int):
    def send(docs: pa.Table) -> pa.Table:
        *_, g, whole, _ = _windows(docs, k)
        keys = np.sort(g[whole])
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
        return _send(docs["block"][0].as_py(), keys, keys.astype(np.uint32), None, n)

    def judge(sent: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint32) for x in sent["keys"].to_pylist()]
        every = np.concatenate(rows)
        _, index, _ = T.distinct(every)
        again = np.bincount(index)[index] > 1
        out, at = [], 0
        for block, bucket, r in zip(sent["block"].to_pylist(), sent["bucket"].to_pylist(), rows):
            if (hit := again[at:at + len(r)]).any():
                out.append((block, bucket, np.packbits(hit).tobytes()))
            at += len(r)
        return B.to_table(out, BACK)

    return send, judge


def _candidates(docs: pa.Table, found: pa.Table, k: int, n: int):
    """Windows of k words repeated in this block or, by the buckets' answers, in another."""
    data, off, counts, g, whole, row = _windows(docs, k)
    at = np.flatnonzero(whole)
    keys, index, _ = T.distinct(g[at])
    again = np.bincount(index, minlength=len(keys)) > 1
    to, cut = T.slices(keys, n)
    where = dict(zip(to.tolist(), range(len(to))))
    for bucket, bits in zip(found["bucket"].to_pylist(), found["found"].to_pylist()):
        i = where[bucket]
        x, y = cut[i], cut[i + 1]
        again[x:y] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
    hit = np.zeros(len(g), bool)
    hit[at] = again[index]
    return g, hit, whole, row, counts


def _double(g: np.ndarray, step: int) -> np.ndarray:
    """Hash of the window that a window and the one ``step`` words on make together."""
    n = max(0, len(g) - step)
    return T.mix(T.mix(g[:n]) * T.GOLDEN + g[step:step + n])


def _target_level(seed: int, k: int, n: int):
    def send(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return SENT.empty_table()
        g, hit, _, row, counts = _candidates(docs, found, seed, n)
        step = k - seed
        both = hit[:len(g) - step] & hit[step:] if len(g) > step else np.zeros(0, bool)
        at = np.flatnonzero(both & (T.room(counts)[:len(both)] >= k))
        keys, index, order = T.distinct(_double(g, step)[at])
        least = _least(_ids(docs)[row[at]], index, order, len(keys))
        return _send(docs["block"][0].as_py(), keys, keys, least, n)

    def judge(sent: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint64) for x in sent["keys"].to_pylist()]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in sent["ids"].to_pylist()])
        keys, index, order = T.distinct(np.concatenate(rows))
        smaller = _least(ids, index, order, len(keys))[index] < ids
        out, at = [], 0
        for block, bucket, r in zip(sent["block"].to_pylist(), sent["bucket"].to_pylist(), rows):
            if (hit := smaller[at:at + len(r)]).any():
                out.append((block, bucket, r[hit].tobytes()))
            at += len(r)
        return B.to_table(out, BACK)

    return send, judge


def _least(ids: np.ndarray, index: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    begin = np.searchsorted(index[order], np.arange(n))
    return np.minimum.reduceat(ids[order], begin)


def _cut(seed: int, k: int):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return OUT.empty_table()
        data, off, counts, g, _, row = _windows(docs, seed)
        ids = _ids(docs)
        at = np.flatnonzero(T.room(counts)[:max(0, len(g) - (k - seed))] >= k)
        keys, index, order = T.distinct(_double(g, k - seed)[at])
        mine = ids[row[at]]
        gone = mine > _least(mine, index, order, len(keys))[index]
        back = [np.frombuffer(x, np.uint64) for x in found["found"].to_pylist()]
        if back and len(keys):
            back = np.concatenate(back)
            there = np.zeros(len(keys), bool)
            there[np.searchsorted(keys, back)] = True
            gone |= there[index]
        cover = np.zeros(len(row) + 1, np.int32)
        np.add.at(cover, at[gone], 1)
        np.add.at(cover, at[gone] + k, -1)
        covered = np.cumsum(cover[:-1]) > 0
        out, w = [], 0
        real = B.column_of(docs, "doc_id").to_pylist()
        raw = data.tobytes()
        for i, c in enumerate(counts.tolist()):
            kept = raw[off[i]:off[i + 1]].split()
            lost = covered[w:w + c]
            spans = []
            if lost.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], lost.view(np.int8), [0]))))
                spans = edge.reshape(-1, 2).tolist()
                kept = [x for x, y in zip(kept, lost.tolist()) if not y]
            kept = b" ".join(kept)
            out.append((real[i], c, int(lost.sum()), kept.decode("utf-8"), spans))
            w += c
        return B.to_table(out, OUT)

    return cut


def remove_repeats(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_text, spans.

    A word goes if a window of ``min_words`` words covers it whose word sequence also starts
    in a document of a smaller doc_id. ``spans`` are the removed [first, last + 1) word runs.
    Windows are judged on the input, not on what is left.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 at least")
    seed = (min_words + 1) // 2
    n = B.block_count(docs)
    buckets = min(n, B.MAX_BUCKETS)
    dealt = B.with_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, "doc_id", "text")
    send, judge = _seed_level(seed, buckets)
    found = B.grouped(B.grouped(dealt, "block", send, DDL_SENT), "bucket", judge, DDL_BACK)
    send, judge = _target_level(seed, min_words, buckets)
    found = B.grouped(B.cogrouped(dealt, found, "block", send, DDL_SENT), "bucket", judge, DDL_BACK)
    return B.cogrouped(dealt, found, "block", _cut(seed, min_words),
                       "doc_id long, n_words long, n_removed long, kept_text string, "
                       "spans array<array<long>>")


STATE = pa.schema([("block", pa.int32()), ("code", pa.binary()), ("keys", pa.binary()), ("ids", pa.binary())])
DDL_STATE = "block int, code binary, keys binary, ids binary"


def _state(block: int, code: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> pa.Table:
    """Windows of a block that are still in question: row and word (``code``), hash, doc_id."""
    return B.to_table([(block, code.tobytes(), keys.tobytes(), ids.tobytes())] if len(code) else [], STATE)


def _read(state: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(state["code"][0].as_py(), np.int64), np.frombuffer(state["keys"][0].as_py(), np.uint64),
            np.frombuffer(state["ids"][0].as_py(), np.int64))


def repeated_passages(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """The longest repeated passages: one row for each document that shares ``min_words`` words
    in a row with another doc_id: doc_id, words, start_word, n_windows.

    Windows repeated at one length alone are extended to twice that length, level after level,
    until no candidate survives. ``words`` is the last length (min_words * 2**k) at which the
    document has a window that another doc_id has too, ``n_windows`` how many it has there,
    ``start_word`` where the first of them starts. Null doc_ids count as one.
    """
    seed = (min_words + 1) // 2
    n = B.block_count(docs)
    buckets = min(n, B.MAX_BUCKETS)
    dealt = B.with_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), n, "doc_id", "text")
    first_send, first_judge = _seed_level(seed, buckets)
    found = B.grouped(B.grouped(dealt, "block", first_send, DDL_SENT), "bucket", first_judge, DDL_BACK)

    def begin(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return STATE.empty_table()
        g, hit, _, row, counts = _candidates(docs, found, seed, buckets)
        step = min_words - seed
        both = hit[:len(g) - step] & hit[step:] if len(g) > step else np.zeros(0, bool)
        at = np.flatnonzero(both & (T.room(counts)[:len(both)] >= min_words))
        word = at - (np.cumsum(counts) - counts)[row[at]]
        return _state(docs["block"][0].as_py(), row[at] << 32 | word, _double(g, step)[at], _ids(docs)[row[at]])

    def send(state: pa.Table) -> pa.Table:
        _, keys, ids = _read(state)
        own, index, order = T.distinct(keys)
        ends = np.stack([_least(ids, index, order, len(own)), -_least(-ids, index, order, len(own))], axis=1)
        return _send(state["block"][0].as_py(), own, own, ends, buckets)

    def judge(sent: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, np.uint64) for x in sent["keys"].to_pylist()]
        ends = np.concatenate([np.frombuffer(x, np.int64) for x in sent["ids"].to_pylist()]).reshape(-1, 2)
        keys, index, order = T.distinct(np.concatenate(rows))
        shared = (_least(ends[:, 0], index, order, len(keys)) < -_least(-ends[:, 1], index, order, len(keys)))[index]
        out, at = [], 0
        for block, bucket, r in zip(sent["block"].to_pylist(), sent["bucket"].to_pylist(), rows):
            if (hit := shared[at:at + len(r)]).any():
                out.append((block, bucket, r[hit].tobytes()))
            at += len(r)
        return B.to_table(out, BACK)

    def keep(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows or not found.num_rows:
            return STATE.empty_table()
        code, keys, ids = _read(state)
        hit = np.isin(keys, np.concatenate([np.frombuffer(x, np.uint64) for x in found["found"].to_pylist()]))
        return _state(state["block"][0].as_py(), code[hit], keys[hit], ids[hit])

    def extend(step: int):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    code, keys, ids = _read(pa.Table.from_batches([batch.slice(i, 1)]))
                    to = np.minimum(np.searchsorted(code, code + step), len(code) - 1)
                    both = code[to] == code + step
                    yield from _state(batch.column("block")[i].as_py(), code[both],
                                      T.mix(T.mix(keys[both]) * T.GOLDEN + keys[to[both]]), ids[both]).to_batches()

        return run

    summary = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()), ("start_word", pa.int64()), ("n_windows", pa.int64())])

    def report(words: int):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    code, _, ids = _read(pa.Table.from_batches([batch.slice(i, 1)]))
                    own, index, _ = T.distinct(code >> 32)
                    at = np.searchsorted(code >> 32, own)
                    yield from B.to_table([(None if d == LAST else int(d), words, int(c & 0xFFFFFFFF), int(k)) for d, c, k in zip(
                        ids[at], code[at], np.bincount(index))], summary).to_batches()

        return run

    ddl = "doc_id long, words long, start_word long, n_windows long"
    state, words, out = B.stored(B.cogrouped(dealt, found, "block", begin, DDL_STATE)), min_words, None
    while True:
        back = B.grouped(B.grouped(state, "block", send, DDL_SENT), "bucket", judge, DDL_BACK)
        state = B.stored(B.cogrouped(state, back, "block", keep, DDL_STATE))
        if out is not None and state.isEmpty():
            break
        level = state.mapInArrow(report(words), ddl)
        out = level if out is None else out.union(level)
        state, words = B.stored(state.mapInArrow(extend(words), DDL_STATE)), words * 2
    best = F.max(F.struct("words", (-F.col("start_word")).alias("s"), "n_windows")).alias("b")
    return out.groupBy("doc_id").agg(best).select("doc_id", "b.words", (-F.col("b.s")).alias("start_word"), "b.n_windows")
