"""The n-gram join against all pairs."""
import random
from collections import defaultdict

from gavel.llm import _blocks as B
from gavel.llm import ngram_join as J
from gavel.llm.ngram_join import choose_bands, keep_one, near_duplicates
from tests.llm.common import frame, prose, words


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else None


def brute(rows):
    by = defaultdict(list)
    for i, t in rows:
        if i is not None and shingles(t):
            by[shingles(t)].append(i)
    sets = list(by)
    links = defaultdict(set)
    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for a in range(len(sets)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[sets[a]] = (min(by[sets[a]]), min(i for s in seen for i in by[sets[s]]), len(links[a]))
    return sorted(((i, *(out[shingles(t)] if i is not None and shingles(t) else (i, i, 0))) for i, t in rows), key=str)


def run(df):
    return sorted(((r.doc_id, r.copy_id, r.class_id, r.n_links) for r in near_duplicates(df).collect()), key=str)


def family(seed, n, size, edits):
    """Chain of texts, each a copy of an earlier one with some words replaced."""
    rng = random.Random(seed)
    texts = [prose(seed, size).split()]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(edits):
            t[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


def test_awkward_rows(spark):
    df = frame(spark)
    assert run(df) == brute([(r.doc_id, r.text) for r in df.collect()])


def test_large_group_over_many_cells(spark):
    """A family over several cells, copies among them: every link is counted."""
    texts = family(3, 150, 120, 1) + family(4, 20, 60, 1) + [prose(700 + i, 80) for i in range(30)]
    texts += texts[:40]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got, want = run(frame(spark, rows)), brute([(r[0], r[1]) for r in rows])
    assert [r[:3] for r in got] == [r[:3] for r in want]
    missed = sum(w[3] - g[3] for g, w in zip(got, want))
    assert all(g[3] <= w[3] for g, w in zip(got, want)) and missed <= 0.001 * sum(w[3] for w in want)


def test_recall_against_all_pairs(spark):
    """Pairs just above the threshold, on their own: the measured share that is found."""
    rng = random.Random(21)
    rows = []
    for i in range(500):
        w = prose(5000 + i, 100).split()
        rows.append((2 * i, " ".join(w)))
        for at in rng.sample([5, 30, 55, 80], 2):
            w[at] = f"edit{i}"
        rows.append((2 * i + 1, " ".join(w)))
    want = {r[0]: r[3] for r in brute(rows)}
    got = {r.doc_id: r.n_links for r in near_duplicates(frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()}
    similar = [len(shingles(rows[i][1]) & shingles(rows[i + 1][1])) / len(shingles(rows[i][1]) | shingles(rows[i + 1][1])) for i in range(0, 1000, 2)]
    assert all(0.8 <= x < 0.85 for x in similar) and sum(want.values()) == 1000
    assert sum(got.values()) >= 0.99 * 1000


def test_pages_of_one_template_are_hardly_verified(spark, monkeypatch):
    """2,000 pages that share 30 % of their shingles, none a copy: few are candidates."""
    shared = prose(1, 92)
    rows = [(i, shared + " " + prose(10_000 + i, 103), "en", "s", 0) for i in range(2000)]
    seen = []
    cells = J._cells
    monkeypatch.setattr(J, "_cells", lambda g: seen.append(cells(g)) or seen[-1])
    got = near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 2000 and all(r.n_links == 0 for r in got)
    sides = defaultdict(lambda: [0, 0, 0])
    for r in seen[0].collect():
        sides[r.cell][r.side] += 1
    assert sum(a * b + c * (c - 1) // 2 for a, b, c in sides.values()) < 10_000


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        bands, rows = choose_bands(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 304


def test_keep_one(spark):
    df = frame(spark)
    got = sorted(((r.doc_id, r.text) for r in keep_one(df).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in df.collect()])
    stay = {r[0] for r in want if r[0] is None or r[0] == r[2]}
    rows = {(r.doc_id, r.text) for r in df.collect() if r.doc_id in stay and not (r.doc_id is not None and shingles(r.text) and any(
        shingles(r.text) == shingles(o.text) and o.doc_id is not None and o.doc_id < r.doc_id for o in df.collect()))}
    assert len({x for x in got if x[0] is not None}) == len([x for x in got if x[0] is not None])
    assert {x for x in got if x[0] is not None} == {x for x in rows if x[0] is not None}
    assert keep_one(df).columns == df.columns


def test_empty(spark):
    assert near_duplicates(frame(spark, [])).collect() == [] and keep_one(frame(spark, [])).collect() == []


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(1, 200)]
    edges += [(2000 + i, 2001 + i) for i in range(40)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    got = B.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
