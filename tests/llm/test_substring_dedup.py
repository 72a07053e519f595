"""Substring dedup against a plain dictionary of windows."""
import random

import pytest
from pyspark.sql import functions as F

from gavel.llm.substring_dedup import remove_repeats, repeated_passages
from tests.llm.common import frame, prose, words


def brute(rows, k):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - k + 1):
            s = tuple(w[a:a + k])
            first[s] = min(first.get(s, float("inf")), float("inf") if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - k + 1):
            if first[tuple(w[a:a + k])] < (float("inf") if i is None else i):
                gone[a:a + k] = [True] * k
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(df, k):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(df, k).collect()), key=str)


@pytest.mark.parametrize("k", [13, 4, 3, 2])
def test_awkward_rows(spark, k):
    df = frame(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert run(df, k) == brute(rows, k)


def test_planted_passages(spark):
    rng = random.Random(5)
    shared = [prose(100 + j, 55) for j in range(3)]
    rows = []
    for i in range(80):
        t = prose(200 + i, rng.randint(1, 120))
        if i % 4 == 0:
            t += " " + shared[i % 3] + " " + prose(900 + i, rng.randint(0, 20))
        rows.append((i, t, "en", "s", len(t)))
    df = frame(spark, rows)
    got = run(df, 13)
    assert got == brute([(r[0], r[1]) for r in rows], 13)
    assert sum(r[2] for r in got) >= 17 * 55


def test_spans_and_extra_columns(spark):
    a = prose(1, 40)
    df = frame(spark, [(1, a, None, None, 0), (2, "new words " + a + " end", None, None, 0)]).withColumn(
        "block", F.lit(7)).withColumn("bucket", F.lit("x"))
    got = {r.doc_id: r for r in remove_repeats(df, 13).collect()}
    assert got[2].spans == [[2, 42]] and got[2].kept_text == "new words end" and got[1].spans == []


def test_empty(spark):
    assert remove_repeats(frame(spark, []), 13).collect() == []


def test_one_word_seed_is_refused(spark):
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, []), 1)


def levels(rows, k):
    """(doc_id, longest level, first start, windows) over one row a doc_id."""
    best = {}
    n = k
    while True:
        seen = {}
        for i, t in rows:
            w = words(t)
            for a in range(len(w) - n + 1):
                seen.setdefault(tuple(w[a:a + n]), set()).add(i)
        hits = {}
        for i, t in rows:
            w = words(t)
            at = [a for a in range(len(w) - n + 1) if len(seen[tuple(w[a:a + n])]) > 1]
            if at:
                hits[i] = (n, at[0], len(at))
        if not hits:
            return best
        best.update(hits)
        n *= 2


def test_levels_double_until_none_survives(spark):
    rng = random.Random(8)
    shared = [prose(100 + j, 20 * (j + 1)) for j in range(6)]
    rows = [(i, " ".join([prose(300 + i, rng.randint(0, 30)), shared[rng.randrange(6)], prose(600 + i, rng.randint(0, 9))]), "en", "s", 0)
            for i in range(40)] + [(90, "y " * 60, "en", "s", 0), (91, "y " * 45, "en", "s", 0), (92, "z " * 70, "en", "s", 0), (93, None, None, None, 0)]
    for k in (13, 5):
        got = {r.doc_id: (r.words, r.start_word, r.n_windows) for r in repeated_passages(frame(spark, rows), k).collect()}
        assert got == levels([(r[0], r[1]) for r in rows], k)
    assert repeated_passages(frame(spark, []), 13).collect() == []
