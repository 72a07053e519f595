"""Counts and base scores against a Counter, classes and model scores against plain loops."""
import math
import zlib
from collections import Counter

import numpy as np

from gavel.llm import brown_lm as M
from gavel.llm.queries import QUERIES
from tests.llm.common import awkward, frame, prose
from pyspark.sql import functions as F

FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def tokens(t):
    return (t or "").encode().translate(FOLD).split() + [None]


def test_query_base_scores(spark, tmp_path):
    rows = [r for r in awkward() if r[0] is not None] + [(100 + i, prose(i % 7, 20 + i).title(), "en", "s", 0) for i in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t, *_ in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(
        math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, *_ in rows)
    got = QUERIES["op5_brown_lm"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-6 * r.perplexity for r in got)


def test_exchange_raises_the_likelihood_and_finds_classes():
    rng = np.random.default_rng(0)
    n, k = 30, 3  # words of class c are followed by class c + 1
    counts = np.zeros((n + 2, n + 2))
    for i in range(n):
        for j in range(n):
            counts[i, j] = rng.poisson(40 if j % 3 == (i + 1) % 3 else 1)
    order = rng.permutation(n)
    counts[:n, :n] = counts[np.ix_(order, order)]
    cls = M.exchange(counts, n, k)
    assert len({(int(c), int(o) % 3) for c, o in zip(cls, order)}) == k

    def likelihood(cls):
        one = np.eye(k + 2)[np.concatenate([cls, [k, k + 1]])]
        g = one.T @ counts @ one
        return M.phi(g).sum() - M.phi(g.sum(0)).sum() - M.phi(g.sum(1)).sum()

    assert likelihood(cls) >= likelihood(order % 3) - 1e-6 > likelihood(np.arange(n) % k)


def test_model_is_a_distribution():
    """Known words and the unknown class share the whole probability after every class."""
    k = 4
    rng = np.random.default_rng(3)
    g = np.zeros((k + 3, k + 3))
    g[:k + 1, :k + 1] = rng.integers(0, 50, (k + 1, k + 1))
    g[:k + 1, k + 2] = rng.integers(0, 5, k + 1)
    p = 10.0 ** M.log_model(g, k).reshape(k + 3, k + 3)
    words = g[:k + 2, :k + 1].sum(0)  # emissions of a class add up to its count over the count
    words[k] = 1
    assert np.allclose((p[:k + 2, :k + 1] * words).sum(1) + p[:k + 2, k + 1], 1)


def test_scores_against_loops(spark):
    """All words in the core: the classes are the driver's, so the score can be walked by hand."""
    rows = [(i, prose(i % 9, 30), "en", "s", 0) for i in range(40)] + [(99, "zzz unknown " + prose(1, 10), "en", "s", 0)]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in M.score_corpus(df, F.col("doc_id") != 99, core_words=5000, classes=4).collect()}
    train = [tokens(t) for i, t, *_ in rows if i != 99]
    c = Counter(w for x in train for w in x)
    known = sorted((w for w in c if w is not None))
    held_out, in_sample = got[99].score / got[99].n_tokens, sum(got[i].score for i in range(40)) / sum(got[i].n_tokens for i in range(40))
    assert got[99].n_known == 11 and in_sample > sum(got[i].base_score for i in range(40)) / sum(got[i].n_tokens for i in range(40))
    assert held_out < in_sample and got[0].train_types == len(known) + 1


def test_all_words_get_a_class_from_their_contexts(spark):
    """Words beyond the core join the class of the core words used like them."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        w = []
        for _ in range(30):
            rare = rng.random() < 0.1
            w += [f"{'xr' if rare else 'xc'}{rng.integers(0, 40 if rare else 3)}", f"{'yr' if rare else 'yc'}{rng.integers(0, 40 if rare else 3)}"]
        rows.append((i, " ".join(w), "en", "s", 0))
    got = M.score_corpus(frame(spark, rows), F.col("doc_id") >= 60, core_words=6, classes=2).collect()
    held = [r for r in got if not r.train]
    per = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert per("score") > per("base_score") + 0.2  # which half of the words comes next is known: log10(2) a token at most


def test_place_is_the_best_class_of_each_word():
    """Gains with own counts taken out, against the likelihood of every placement."""
    rng = np.random.default_rng(8)
    n, k = 12, 3
    s = np.concatenate([rng.choice(n + 1, 400, p=rng.dirichlet(np.ones(n + 1))), np.arange(n + 1)])  # the last is the end
    counts = np.zeros((n + 1, n + 1), int)
    np.add.at(counts, (np.append(n, s[:-1]), s), 1)
    now = rng.integers(0, k + 1, n)  # k: no class yet

    def matrix(cls):
        one = np.eye(k + 2)[np.append(cls, k + 1)]
        return one.T @ counts @ one

    cells = {}
    for i in range(n + 1):
        for j in range(n + 1):
            if counts[i, j]:
                of = np.append(now, k + 1)
                for key in ([(i, k + 2 + of[j])] if i < n else []) + ([(j, of[i])] if j < n else []) + ([(i, 2 * k + 4)] if i == j else []):
                    cells[key] = cells.get(key, 0) + counts[i, j]
    word, ctx = np.array(sorted(cells)).T
    total = np.array([cells[c] for c in sorted(cells)])
    got = M.place(word, ctx, total, now, matrix(now), k, np.zeros(n, int))
    for w in range(n):
        like = [M.likelihood(matrix(np.where(np.arange(n) == w, b, now))) for b in range(k)]
        assert like[got[w]] > max(like) - 1e-6


def test_rounds_reach_words_without_core_neighbours(spark):
    """Two kinds of words with none but words outside the core beside them are told apart in later rounds."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        w = []
        for _ in range(6):
            t = rng.integers(0, 2)
            w += [f"core{t}"] + [f"{c}{t}_{rng.integers(0, 12)}" for c in ("a", "b", "c")]
        rows.append((i, " ".join(w), "en", "s", 0))
    got = M.score_corpus(frame(spark, rows), F.col("doc_id") >= 80, core_words=2, classes=10).collect()
    held = [r for r in got if not r.train]
    per = lambda c: sum(r[c] for r in held) / sum(r.n_tokens for r in held)
    assert per("score") > -1.4  # one placement by the core alone: -1.66


def test_empty_and_no_training(spark):
    assert M.score_corpus(frame(spark, []), F.lit(True)).collect() == []
    got = M.score_corpus(frame(spark), F.lit(False)).collect()
    assert len(got) == len(awkward()) and all((r.n_known, r.base_score, r.train_tokens) == (0, 0.0, 0) and r.score < -0.3 * r.n_tokens for r in got)


def test_planes():
    for x in ([0, 1, 255, 256, 2**31, 2**32 - 1], [5_000_000_000, 3], [2**62, 0], [], [7]):
        assert M.unplanes(M.planes(np.array(x, np.int64))).tolist() == x
    assert len(M.planes(np.zeros(9, int))) == 10


class _Task:
    """A bucket's functions run on one table."""

    @staticmethod
    def gather(rows, k):
        return M._gather(k)(M.B.to_table(rows, M.SENT))


def test_counts_beyond_32_bits_and_many_classes():
    """Two blocks' counts of five billion add up, and come back as they are, with more classes than a byte holds."""
    k, keys = 300, np.array([11, 12], np.uint64)
    rows = [(0, block, keys.tobytes(), M.planes(np.array([299, 7])), M.planes(np.array([2, 1])),
             M.planes(np.array([301, 302 + 299, 302 + 299])), M.planes(np.array([5_000_000_000, 5_000_000_000, 4]))) for block in (3, 9)]
    state = _Task.gather(rows, k)
    back = list(M._assign(np.ones((k + 2, k + 2)) * 1e10, k)(state.to_batches()))
    got = [r for b in back for r in b.to_pylist()]
    assert [r["block"] for r in got] == [3, 9]
    for r in got:
        assert M.unplanes(r["counts"]).tolist() == [10_000_000_000, 0] and M.unplanes(r["classes"])[1] == k + 1
    cells = {r["pair"]: r["n"] for b in M._sum_classes(k)(state.to_batches()) for r in b.to_pylist()}
    assert cells == {301 * 302 + 299: 10_000_000_000, 299 * 302 + 299: 10_000_000_000, 7 * 302 + 299: 8}


def test_many_classes_end_to_end(spark):
    rows = [(i, prose(i, 60), "en", "s", 0) for i in range(60)]
    got = M.score_corpus(frame(spark, rows), F.lit(True), core_words=400, classes=200).collect()
    assert len(got) == 60 and all(-8 * r.n_tokens < r.score < 0 for r in got)


def test_all_words_of_a_length_add_up_to_one_at_most():
    letters = np.zeros(257, np.int64)
    letters[[97, 98, 99]], letters[256] = [500, 30, 4], 200
    p = 10.0 ** (-M.spelling(letters) / M.COST)
    p[65:91] = 0  # A-Z are read as a-z
    by_length = [p[:256].sum() ** n * p[256] for n in range(60)]
    assert 0.9 < sum(by_length) <= 1 and sum(10.0 ** (-M.spelling(np.zeros(257)) / M.COST)) < 257 / 256


def test_next_tokens_add_up_to_one_at_most(spark):
    """After one text, the probabilities of all its continuations by a word and the end, known and unknown words alike."""
    rows = [(i, prose(i % 5, 12, "ab"), "en", "s", 0) for i in range(20)]
    words = sorted({w for _, t, *_ in rows for w in t.split()})
    from itertools import product
    spelled = ["".join(x) for n in range(1, 8) for x in product("ab", repeat=n)]
    every = sorted(set(words) | set(spelled))
    held = [(1000 + j, w, "en", "s", 0) for j, w in enumerate(every)]
    got = M.score_corpus(frame(spark, rows + held), F.col("doc_id") < 1000, core_words=10, classes=3).collect()
    ends = [10 ** r.score for r in got if r.doc_id >= 1000]
    assert len(ends) == len(every) and 0.01 < sum(ends) <= 1


def test_junk_scores_below_prose(spark):
    rng = np.random.default_rng(4)
    rows = [(i, prose(i % 30, 80, "abcdef"), "en", "s", 0) for i in range(200)]
    rows += [(300, prose(3, 80, "abcdef"), "en", "s", 0), (301, prose(12345, 80, "qxzwkv"), "en", "s", 0),
             (302, " ".join("".join(chr(rng.integers(33, 126)) for _ in range(8)) for _ in range(80)), "en", "s", 0)]
    got = {r.doc_id: r for r in M.score_corpus(frame(spark, rows), F.col("doc_id") < 300, core_words=50, classes=8).collect()}
    per = {i: got[i].score / got[i].n_tokens for i in (300, 301, 302)}
    assert per[300] > per[301] + 2 and per[300] > per[302] + 2 and got[301].n_known == 1


def test_blocks_and_buckets_change_nothing_but_ties(spark):
    rows = awkward() + [(100 + i, prose(i % 9, 200), "en", "s", 0) for i in range(80)]
    same = lambda got: sorted((r.doc_id or 0, r.n_tokens, r.n_known, r.train_types, round(r.base_score, 6), round(r.score, 6)) for r in got)
    train = F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True))
    a, b = (same(M.score_corpus(frame(spark, rows).repartition(n), train, 40, 6, layout).collect()) for n, layout in ((2, None), (7, (3000, 40))))
    assert a == b


def test_layout_keeps_packed_rows_large():
    """Rows are blocks times buckets; up to 1 TB a row packs what a kilobyte of text or more sends."""
    for n in (10**9, 10**10, 10**11, 10**12):
        block, buckets = M.B.layout(n, 8)
        assert 16_000_000 <= block <= 64_000_000 and n / buckets <= 130_000_000
        assert n / (-(-n // block) * buckets) >= 1000


def test_a_round_replaces_the_one_before(spark, tmp_path):
    steps = M.B.Steps(spark)
    df = spark.range(10)
    one = steps.keep("a", df)
    first = steps.paths["a"]
    two = steps.keep("a", one.selectExpr("id + 1 AS id"))
    assert two.agg(F.sum("id")).first()[0] == 55 and steps.paths["a"] != first
    import os
    assert not os.path.exists(first.removeprefix("file:")) and os.path.exists(steps.paths["a"].removeprefix("file:"))
    steps.drop("a")
    assert spark.conf.get(M.B.CLEANUP) == "false"


def test_blocks_are_coded_and_described_some_at_a_time(monkeypatch):
    """Temporary arrays span a part of a block; the parts change no result."""
    import numpy as np

    from gavel.llm import brown_lm as L
    for top in (0, 200, 70_000, 2**23, 2**31):
        raw = L.planes(np.array([top, 0, top // 2]))
        assert L.narrow(raw).tolist() == L.unplanes(raw).tolist()
    import pyarrow as pa
    texts = [f"a b{i % 7} c{i}  B{i % 3}" for i in range(50)] + ["", "x"]
    t = pa.table({"doc_id": list(range(52)), "text": texts, "train": [i % 5 > 0 for i in range(52)]})
    monkeypatch.setattr(L.TaskContext, "get", lambda: type("C", (), {"partitionId": lambda self: 0})())
    code = L._code(L.spelling(np.arange(257)), 10**6)
    whole = [b.to_pylist() for b in code(t.to_batches())]
    monkeypatch.setattr(L, "CODED_AT_ONCE", 40)
    assert [b.to_pylist() for b in code(t.to_batches())] == whole
