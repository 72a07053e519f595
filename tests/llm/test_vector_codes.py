"""Vector codes against loops over all entries."""
import math
import random
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest

from gavel.llm import vector_codes as V

VECTORS = "vec_id long, embedding array<double>, label int, error long, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    """Contract by loops: (vec_id, code, error, label_error), and the codebooks' digest."""
    kept = [(i, v, lab) for i, v, lab, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = {k: [[math.floor(4096 * x) for x in v[p * w:(p + 1) * w]] for p in range(parts)] for k, (_, v, _) in enumerate(kept)}
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        return {k: [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), j) for j, e in enumerate(books[p])) for p in range(parts)]
                for k, c in cut.items()}

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [cut[k][p] for k in cut if got[k][p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = assign()
    error = {k: sum(d for d, _ in a) for k, a in got.items()}
    by_label = defaultdict(int)
    for k, (_, _, lab) in enumerate(kept):
        by_label[lab] += error[k]
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for _, j in got[k]), error[k], by_label[lab]) for k, (i, _, lab) in enumerate(kept)], digest


def rows(n, dim, seed=0, spread=1.0):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, spread) for _ in range(dim)], rng.choice([0, 1, 2, None]), 7, "x") for i in range(n)]
    bad = [(None if k % 2 else 0, v, 1, 0, "") for k, v in enumerate([None, [None] * dim, [math.nan] * dim, [math.inf] + [0.0] * (dim - 1)])]
    return out + bad


@pytest.mark.parametrize("n,dim,spread", [(120, 16, 1.0), (9, 8, 1.0), (1, 16, 1.0), (60, 8, 0.0003), (40, 16, 40_000.0)])
def test_against_loops(spark, n, dim, spread):
    data = rows(n, dim, n, spread)
    data += data[:3]  # repeated rows, codebook's own included
    data += [(None, data[0][1], None, 1, "")]
    want, digest = brute(data)
    got = V.compress(spark.createDataFrame(data, VECTORS).repartition(5)).collect()
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=str) == sorted(want, key=str)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_ties_go_to_the_lower_index():
    book = np.array([[5, 0], [0, 5], [5, 0], [1, 1], [0, 0]], np.int64)
    x = np.array([[5, 5], [0, 0], [5, 0], [3, 3], [-9, 4]], np.int64)
    entry, d = V.nearest(x, book)
    full = ((x[:, None] - book[None]) ** 2).sum(2)
    assert entry.tolist() == full.argmin(1).tolist() and d.tolist() == full.min(1).tolist()


def test_search_is_exact_beyond_64_bits():
    rng = np.random.default_rng(3)
    x, book = (rng.integers(-2**31, 2**31, (k, 12)) for k in (50, 16))
    entry, d = V.nearest(x, book)
    full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e)) for e in book] for v in x]
    assert [(int(e), int(m)) for e, m in zip(entry, d)] == [(f.index(min(f)), min(f)) for f in full]


def test_other_lengths_and_empty_tables(spark):
    data = rows(30, 10, 4) + [(50, [1.0, 2.0], 1, 0, ""), (51, [], None, 0, "")]
    got = {r.vec_id: r for r in V.compress(spark.createDataFrame(data, VECTORS)).collect()}
    assert got[50].code is None and got[51].error is None and len(got[3].code) == 16
    filled = [(i, v and v + [0.0] * 6, lab, e, c) for i, v, lab, e, c in data[:30]]  # ten components are filled up to sixteen
    want = {r.vec_id: r.code for r in V.compress(spark.createDataFrame(filled, VECTORS)).collect()}
    assert all(len(got[i].code) == 16 for i in want)
    assert V.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert V.compress(spark.createDataFrame(data[30:34], VECTORS)).count() == 0
    assert [r.code for r in V.compress(spark.createDataFrame([(1, [], 2, 0, "")], VECTORS)).collect()] == ["00" * 8]


def test_entries_are_bytes():
    with pytest.raises(ValueError):
        V.fit(None, entries=257)
