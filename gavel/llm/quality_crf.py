"""Quality rules by line sequence labelling: a linear-chain CRF marks each line as content or
boilerplate; the share of content words decides retention.

The CRF has two states, the line features of FEATURES per state (the difference is learned)
and a weight for each transition. It is fitted by gradient ascent on the exact conditional
log-likelihood (forward-backward) of a bounded sample of labelled documents: at most
``max_docs`` in expectation (by a hash of the doc_id), of each at most ``max_lines`` lines.
Lines start with their document's label; lines of low-quality documents that an independent
fit takes for content are then relabelled, so that good documents' lines inside bad ones
don't blur the model. Decoding (Viterbi) reads every line of every document.

Defined results: null text is like empty text: no words, ``base_failed``, not kept. Lines
without a word are skipped. Without labels of both kinds every line is content. Repeated
rows give a row each; of equally good line labellings Viterbi takes content last. Texts of any length are
labelled whole. An empty table gives no rows. Extra columns, whatever their names, are ignored, and kept
by ``keep_good`` (``labels`` needs doc_id and quality).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B
from gavel.llm import _tokens as T

FEATURES = ("one", "symbols", "marks", "capitals", "digits", "echo", "repeats", "again", "short", "closed")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT = 50, 50  # words; per cent of words in repeated three-word windows
STATS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                   ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines", pa.int64()),
                   ("n_content_lines", pa.int64()), ("content_share", pa.float64()), ("line_labels", pa.string())])


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


IS_SYMBOL = _mask(SYMBOLS)
IS_SPACE = _mask(b" \t\n\x0b\x0c\r")
IS_UPPER, IS_LOWER, IS_DIGIT = (_mask(bytes(range(ord(a), ord(b) + 1))) for a, b in ("AZ", "az", "09"))
IS_MARK = _mask(b"!\"'()+/:;=?@[\\]^_`{}~-")
IS_CLOSE = _mask(b".!?:;\"')")
IS_CHAR = np.array([b & 0xC0 != 0x80 for b in range(256)]) & ~IS_SPACE  # first byte of a code point


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def describe(data: np.ndarray, off: np.ndarray) -> dict:
    """Base counts of every text, and the lines with a word: their text, word count and features."""
    n_docs = len(off) - 1
    h, start, end, counts = T.words(data, off)
    doc = np.repeat(np.arange(n_docs), counts)
    whole = T.room(counts) >= 3
    at = np.flatnonzero(whole)
    repeat = np.zeros(len(h) + 1, np.int64)
    if len(at):
        tri = T.grams(h, 3)[at]
        _, index, _ = T.distinct(tri ^ T.mix(doc[at].astype(np.uint64) + T.GOLDEN))
        twice = at[np.bincount(index)[index] > 1]
        np.add.at(repeat, twice, 1)
        np.add.at(repeat, twice + 3, -1)
    in_repeat = np.cumsum(repeat[:-1]) > 0
    per_doc = lambda flags: np.diff(_running(flags)[off])
    by_word = np.searchsorted(start, off)

    lh, ls, le, _ = T.words(data, off, gap=T.LINE)
    first, last = np.searchsorted(start, ls), np.searchsorted(start, le)
    held = last > first  # lines with a word
    lh, ls, le, first, last = lh[held], ls[held], le[held], first[held], last[held]
    line_doc = np.searchsorted(off, ls, side="right") - 1
    again = np.zeros(len(ls), bool)
    if len(ls):
        _, index, order = T.distinct(lh ^ T.mix(line_doc.astype(np.uint64) + T.GOLDEN))
        again[order[1:]] = index[order[1:]] == index[order[:-1]]
    words = (last - first).astype(float)
    size = np.maximum(1, le - ls).astype(float)
    of = lambda flags: (lambda r: r[le] - r[ls])(_running(flags))
    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1])
    echoes, repeats = _running(echo), _running(in_repeat)
    upper, lower = of(IS_UPPER[data]), of(IS_LOWER[data])
    x = np.stack([np.ones(len(ls)), np.minimum(1, 5 * of(IS_SYMBOL[data]) / size), np.minimum(1, 5 * of(IS_MARK[data]) / size),
                  upper / np.maximum(1, upper + lower), of(IS_DIGIT[data]) / size,
                  (echoes[last] - echoes[np.minimum(first + 1, last)]) / words, (repeats[last] - repeats[first]) / words,
                  again.astype(float), (words <= 3).astype(float), IS_CLOSE[data[end[last - 1] - 1]].astype(float)
                  if len(ls) else np.zeros(0)], axis=1)
    return {"n_words": counts, "word_chars": per_doc(IS_CHAR[data]), "n_symbols": per_doc(IS_SYMBOL[data]),
            "n_dup_lines": np.bincount(line_doc[again], minlength=n_docs),
            "n_repeat_words": np.diff(_running(in_repeat)[by_word]),
            "line_doc": line_doc, "line_words": words, "x": x, "line_at": np.searchsorted(line_doc, np.arange(n_docs + 1))}


def _log_add(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def fit(lines: list[np.ndarray], good: list[bool], rounds: int = 150, rate: float = 0.15, shrink: float = 1e-3) -> dict:
    """CRF weights from the feature rows of each document's lines and its label."""
    if not lines or all(good) or not any(good):
        return {"w": np.zeros(len(FEATURES)), "t": np.zeros((2, 2)), "plain": True}
    x = np.concatenate(lines)
    y = np.repeat(np.array(good, float), [len(a) for a in lines])
    weigh = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.zeros(x.shape[1])
    speed = np.zeros_like(w)
    for _ in range(400):  # independent lines first
        p = 1 / (1 + np.exp(-(x @ w)))
        grad = x.T @ (weigh * (y - p)) - shrink * w
        speed = 0.9 * speed + grad
        w += 2.0 * speed
    y = np.where((y == 0) & (x @ w > 0), 1.0, y)

    order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
    size = np.array([len(lines[i]) for i in order])
    begin = np.cumsum([0] + [len(a) for a in lines])
    top = int(size[0])
    grid = np.zeros((len(order), top, x.shape[1]))
    gold = np.zeros((len(order), top), int)
    for r, i in enumerate(order):
        grid[r, :size[r]] = lines[i]
        gold[r, :size[r]] = y[begin[i]:begin[i + 1]]
    live = np.arange(top)[None, :] < size[:, None]
    t = np.zeros((2, 2))
    pace = [np.zeros_like(w), np.zeros_like(t)]
    total = live.sum()
    for _ in range(rounds):
        e = np.stack([np.zeros(grid.shape[:2]), grid @ w], axis=2)
        ahead = np.zeros((len(order), top, 2))
        back = np.zeros((len(order), top, 2))
        ahead[:, 0] = e[:, 0]
        for k in range(1, top):
            n = int((size > k).sum())
            ahead[:n, k] = _log_add(ahead[:n, k - 1, :, None] + t, 1) + e[:n, k]
        for k in range(top - 2, -1, -1):
            n = int((size > k + 1).sum())
            back[:n, k] = _log_add(t + (e[:n, k + 1] + back[:n, k + 1])[:, None, :], 2)
        z = _log_add(ahead[np.arange(len(order)), size - 1], 1)
        p = np.exp(ahead + back - z[:, None, None])[:, :, 1]
        gw = ((gold - p) * live).ravel() @ grid.reshape(-1, grid.shape[2]) / total - shrink * w
        gt = -shrink * t
        if top > 1:
            pair = live[:, 1:]
            joint = np.exp(ahead[:, :-1, :, None] + t + (e + back)[:, 1:, None, :] - z[:, None, None, None])
            for a in (0, 1):
                for b in (0, 1):
                    seen = ((gold[:, :-1] == a) & (gold[:, 1:] == b) & pair).sum()
                    gt[a, b] += (seen - joint[:, :, a, b][pair].sum()) / total
        for v, g, at in ((w, gw, 0), (t, gt, 1)):
            pace[at] = 0.9 * pace[at] + g
            v += rate * 10 * pace[at]
    return {"w": w, "t": t, "plain": False}


def decode(scores: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Viterbi: the best sequence of 1 (content) and 0 (boilerplate); ties go to content."""
    (t00, t01), (t10, t11) = t.tolist()
    a, b, came = 0.0, 0.0, []
    for s in scores.tolist():
        if came:
            x, y = (b + t10 >= a + t00), (b + t11 >= a + t01)
            came.append((x, y))
            a, b = (b + t10 if x else a + t00), (b + t11 if y else a + t01) + s
        else:
            came.append((False, False))
            b = s
    out = np.zeros(len(came), np.int8)
    state = b >= a
    for i in range(len(came) - 1, -1, -1):
        out[i] = state
        state = came[i][1] if state else came[i][0]
    return out


def _label(model: dict):
    def label(batches):
        for t in B.pieces(batches):
            d = describe(*T.buffers(B.column_of(t, "text")))
            score = d["x"] @ model["w"]
            at, rows = d["line_at"], []
            for i, doc in enumerate(B.column_of(t, "doc_id").to_pylist()):
                a, b = at[i], at[i + 1]
                marks = np.ones(b - a, np.int8) if model["plain"] else decode(score[a:b], model["t"])
                words = d["line_words"][a:b]
                share = float(words[marks == 1].sum() / words.sum()) if b > a else 0.0
                rows.append((doc, *(int(d[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
                             int(b - a), int(marks.sum()), share, "".join("BC"[m] for m in marks)))
            yield from B.to_table(rows, STATS).to_batches()

    return label


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, max_lines: int = 200) -> dict:
    """Fits the CRF on a sample of about ``max_docs`` labelled documents (lines' features only)."""
    known = labels.where("doc_id is not null and quality is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, max_docs / max(1, n))))
    schema = pa.schema([("quality", pa.int32()), ("x", pa.list_(pa.float64()))])

    def features(batches):
        for t in B.pieces(batches):
            d = describe(*T.buffers(B.column_of(t, "text")))
            at = d["line_at"]
            yield from B.to_table([(q, d["x"][at[i]:min(at[i + 1], at[i] + max_lines)].ravel().tolist())
                                   for i, q in enumerate(t["quality"].to_pylist()) if at[i + 1] > at[i]], schema).to_batches()

    # the sample is bounded by max_docs, so it may be broadcast
    sample = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .join(F.broadcast(known.where(part)), "doc_id").select("text", "quality")
              .mapInArrow(features, "quality int, x array<double>").collect())
    rows = sorted((r.quality, tuple(r.x)) for r in sample)  # the same order in every run
    return fit([np.array(x).reshape(-1, len(FEATURES)) for _, x in rows], [q == 1 for q, _ in rows])


def judge_quality(docs: DataFrame, model: dict, min_share: float = 0.5) -> DataFrame:
    """One row a document: counts, line labels (B or C a line), content_share, base_failed, kept."""
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _label(model), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                       "n_lines long, n_content_lines long, content_share double, line_labels string")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("content_share") >= min_share))


def keep_good(docs: DataFrame, model: dict, min_share: float = 0.5) -> DataFrame:
    """The documents that ``judge_quality`` keeps, with all their columns; judged and dropped in one pass."""
    label = _label(model)

    def keep(batches):
        for t in B.pieces(batches):
            given = pa.table({"doc_id": pa.nulls(t.num_rows, pa.int64()), "text": t["text"]})
            seen = pa.Table.from_batches(label(given.to_batches(max_chunksize=t.num_rows)))
            n, repeats, share = (seen[c].to_numpy() for c in ("n_words", "n_repeat_words", "content_share"))
            good = (n >= MIN_WORDS) & (100 * repeats <= MAX_REPEAT * n) & (share >= min_share)
            yield from t.filter(pa.array(good)).to_batches()

    return docs.mapInArrow(keep, docs.schema)
