"""Mixing: water filling by iteration, sampling by a sorted loop."""
import hashlib
from collections import defaultdict
from math import floor, isclose

from gavel.llm.mixing import mix_sources
from tests.llm.common import frame, prose, words


def share_out(sizes: dict, weights=(5, 2, 1), share=1.5, limit=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        total = sum(weight[s] for s in rest)
        target |= {s: left * weight[s] / total for s in rest} if rest else {}
        over = [s for s in rest if target[s] > limit * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = limit * sizes[s]
            full.add(s)
            left -= target[s]


def check(rows, got):
    size = [len(words(t)) for _, t, *_ in rows]
    sizes = defaultdict(int)
    for r, n in zip(rows, size):
        sizes[r[3]] += n
    target = share_out(sizes)
    want = []
    for source, total in sizes.items():
        docs = [(r[0], n) for r, n in zip(rows, size) if r[3] == source]
        whole = floor(target[source] / total + 1e-12) if total else 0
        rest = max(0.0, target[source] - whole * total)
        pi = rest / total if total else 0.0
        ranked = []
        for i, n in docs:
            u = (int(hashlib.md5(f"mix|{'' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            ranked.append(((u / (1 - u)) / (pi / (1 - pi)) if pi > 1e-12 else 0.0, n, i))
        ranked.sort(key=lambda x: x[:2])
        at, taken = 0, [whole] * len(ranked)
        for j, (_, n, _) in enumerate(ranked):
            if pi > 1e-12 and at + n <= rest:
                at += n
                taken[j] += 1
            else:
                break
        out = [j for j in range(len(ranked)) if taken[j] == whole and ranked[j][1] and pi > 1e-12]
        out = [j for j in out if abs(ranked[j][1] - (rest - at)) < rest - at]
        if out:
            taken[min(out, key=lambda j: (abs(ranked[j][1] - (rest - at)), ranked[j][0]))] += 1
        want += [(i, source, n, total, c * n) for (_, n, i), c in zip(ranked, taken)]
    have = [(r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    for r in got:
        assert isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.taken <= 2 * r.size
    return {s: sum(r.taken for r in got if r.source == s) for s in sizes}, target


def test_awkward_rows(spark):
    df = frame(spark)
    check([tuple(r) for r in df.collect()], mix_sources(df).collect())


def test_hot_source_and_targets(spark):
    rows = [(i, prose(i, 5 + i % 60), "en", "hot" if i % 3 == 0 else f"s{i % 7}", 0) for i in range(900)]
    df = frame(spark, rows)
    taken, target = check(rows, mix_sources(df).collect())
    for s in taken:
        assert abs(taken[s] - target[s]) <= 6  # a tenth of the largest document
    again = mix_sources(df.repartition(5)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, mix_sources(df).collect()), key=str)


def test_no_words_and_empty(spark):
    df = frame(spark, [(1, None, None, "a", 0), (2, "", None, None, 0)])
    assert [(r.target, r.taken) for r in mix_sources(df).collect()] == [(0.0, 0)] * 2
    assert mix_sources(frame(spark, [])).collect() == []
