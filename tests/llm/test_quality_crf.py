"""Base counts, the CRF's likelihood and decoding against plain enumeration, and what is kept."""
import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gavel.llm import _tokens as T
from gavel.llm import quality_crf as Q
from tests.llm.common import awkward, frame, prose, words

LABELS = "doc_id long, quality int, toxic int"


def base(t):
    w = words(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i in range(len(w) - 2) for j in range(3) if tri[tuple(w[i:i + 3])] > 1}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), again, len(covered)


def corpus(n=120):
    """Good prose, lines of symbols, and repeated words; doc_ids from 0, quality in turn."""
    docs, labels = [], []
    for i in range(n):
        lines = [prose(50 * i + j, 14) + "." for j in range(8)]
        if i % 3 == 0:
            lines = [" | ".join(x.split()) + " ###" for x in lines]
        if i % 9 == 3:
            lines[0] = prose(i, 14) + "."
        docs.append((i, "\n".join(lines), "en", "s", 0))
        labels.append((i, int(i % 3 > 0), 0))
    return docs, labels


def test_base_counts(spark):
    df = frame(spark)
    model = Q.fit([], [])
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.judge_quality(df, model).collect() if r.doc_id is not None)
    want = sorted((i, *base(t)) for i, t, *_ in awkward() if i is not None)
    assert got == want
    for r in Q.judge_quality(df, model).collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_symbols_and_lines():
    text = "a | b\n\na | b\n \t\nÉ #x\na | b\nend."
    d = Q.describe(*T.buffers(pa.array([text, None, "z"])))
    assert [int(d[k][0]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == list(base(text))
    assert d["line_at"].tolist() == [0, 5, 5, 6]


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    for _ in range(100):
        s, t = rng.normal(size=rng.integers(1, 8)), rng.normal(size=(2, 2))
        best = max(itertools.product((0, 1), repeat=len(s)),
                   key=lambda y: sum(a for a, b in zip(s, y) if b) + sum(t[a, b] for a, b in zip(y, y[1:])))
        assert Q.decode(s, t).tolist() == list(best)
    assert Q.decode(np.zeros(0), np.zeros((2, 2))).tolist() == []


def test_training_raises_the_likelihood():
    docs, labels = corpus(60)
    d = Q.describe(*T.buffers(pa.array([t for _, t, *_ in docs])))
    lines = [d["x"][a:b] for a, b in zip(d["line_at"][:-1], d["line_at"][1:])]
    good = [q == 1 for _, q, _ in labels]

    def likelihood(m):
        total = 0.0
        for x, g in zip(lines, good):
            s, y = x @ m["w"], [int(g)] * len(x)
            score = lambda y: sum(a for a, b in zip(s, y) if b) + sum(m["t"][a, b] for a, b in zip(y, y[1:]))
            z = np.array([score(y) for y in itertools.product((0, 1), repeat=len(x))])
            total += score(y) - (z.max() + np.log(np.exp(z - z.max()).sum()))
        return total

    assert likelihood(Q.fit(lines, good)) > 0.2 * likelihood({"w": np.zeros(len(Q.FEATURES)), "t": np.zeros((2, 2))})


def test_keeps_good_and_drops_bad(spark):
    docs, labels = corpus()
    df = frame(spark, docs)
    model = Q.learn(df, spark.createDataFrame(labels, LABELS))
    assert Q.learn(df.repartition(7), spark.createDataFrame(labels, LABELS))["w"].tolist() == model["w"].tolist()
    kept = {r.doc_id for r in Q.judge_quality(df, model).collect() if r.kept}
    assert kept == {i for i, q, _ in labels if q}
    assert {r.doc_id for r in Q.keep_good(df, model).collect()} == kept


def test_awkward_rows_and_no_labels(spark):
    df = frame(spark)
    model = Q.learn(df, spark.createDataFrame([(1, None, 0), (None, 1, 0)], LABELS))
    assert model["plain"]
    judged = Q.judge_quality(df, model).collect()
    assert len(judged) == len(awkward()) and sum(r.kept for r in judged) == Q.keep_good(df, model).count()
    assert Q.keep_good(df, model).columns == df.columns
    assert Q.judge_quality(frame(spark, []), model).collect() == []
    assert Q.learn(frame(spark, []), spark.createDataFrame([], LABELS))["plain"]


def test_fixed_symbols():
    assert all(len(re.findall(r"[#*$%&|<>]", chr(c))) == Q.IS_SYMBOL[c] for c in range(128))
