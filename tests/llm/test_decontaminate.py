"""Decontamination against every window of every item size."""
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from gavel.llm import decontaminate as D
from tests.llm.common import awkward, frame, prose

ITEMS = "item_id long, text string"


def tokens(t):
    return re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())


def weighted(w, k=5):
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)]) if w else Counter()


def brute(docs, items):
    best = {}
    for i, t in docs:
        w = tokens(t)
        for j, x in items:
            y = tokens(x)
            b = weighted(y)
            for n in {len(tokens(z)) for _, z in items if tokens(z)}:
                for a in range(len(w) - n + 1):
                    s = weighted(w[a:a + n])
                    both = sum((s & b).values())
                    if both and both * 10 >= 8 * sum((s | b).values()):
                        like = both / sum((s | b).values())
                        best[i, j] = max(best.get((i, j), 0), like)
    return best


def got(spark, docs, items):
    rows = D.contaminated(docs, spark.createDataFrame(items, ITEMS)).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r.similarity for r in rows}


def test_awkward_rows(spark):
    base = awkward()[0][1]
    items = [(1, " ".join(base.split()[5:30])), (2, None), (3, ""), (4, "one two three"), (5, prose(77, 20)), (1, " ".join(base.split()[5:30])),
             (None, " ".join(base.split()[30:50])), (6, "x x x x x x x x")]
    df = frame(spark)
    have, want = got(spark, df, items), brute([(r.doc_id, r.text) for r in df.collect()], items)
    assert have.keys() == want.keys()
    assert all(abs(have[k] - want[k]) < 1e-12 for k in want)


def test_edited_passages(spark):
    """Passages with edits: what reaches the threshold is found, whatever its shift and size."""
    items = [(i, prose(300 + i, 15 + 3 * i)) for i in range(12)]
    rows = []
    for i in range(60):
        w = items[i % 12][1].split()
        if i % 3:
            w[(i * 7) % len(w)] = f"edit{i}"
        rows.append((i, " ".join([prose(i, i % 40).upper()] + w + [prose(500 + i, 25)]).replace(" ", ", ", 2), "en", "s", 0))
    rows += [(100 + i, prose(900 + i, 150), "en", "s", 0) for i in range(10)]
    df = frame(spark, rows)
    have, want = got(spark, df, items), brute([(r[0], r[1]) for r in rows], items)
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-12 for k in want)
    kept = {r.doc_id for r in D.decontaminate(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert kept == {r[0] for r in rows} - {i for i, _ in want}


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    items = [(i, prose(i, 30)) for i in range(50)]
    index = D.Index(items, 5, 31)
    marks, truth = [], []
    for i in range(300):
        p = np.unpackbits(index.prints[i % 50])
        p[rng.choice(D.BITS, rng.integers(0, 40), replace=False)] ^= 1
        marks.append(np.packbits(p))
        far = np.bitwise_count(index.prints ^ marks[-1]).sum(1)
        truth += [(i, int(j), int(far[j])) for j in np.flatnonzero(far <= 31)]
    row, item, far = index.near(np.array(marks))
    assert sorted(zip(row.tolist(), item.tolist(), far.tolist())) == sorted(truth)


def test_an_index_of_many_items_is_small():
    """32,000 items: built in seconds, 50 MB at most, and nothing within the radius is lost."""
    import time
    rng = np.random.default_rng(5)
    items = [(i, " ".join(map(str, rng.integers(0, 10**6, 30)))) for i in range(32_000)]
    t = time.time()
    index = D.Index(items, 5, 31)
    assert index.nbytes < 50_000_000 and time.time() - t < 10
    marks = np.unpackbits(index.prints[:40], axis=1)
    for i, m in enumerate(marks):
        m[rng.choice(D.BITS, i % 32, replace=False)] ^= 1
    marks = np.packbits(marks, axis=1)
    far = np.array([np.bitwise_count(index.prints ^ m).sum(1) for m in marks])
    row, item, d = index.near(marks)
    assert sorted(zip(row.tolist(), item.tolist(), d.tolist())) == sorted((int(i), int(j), int(far[i, j])) for i, j in zip(*np.nonzero(far <= 31)))


def test_slices_give_the_same(spark, monkeypatch):
    items = [(i, prose(300 + i, 20)) for i in range(20)]
    df = frame(spark, [(i, prose(i, 9) + " " + items[i % 20][1], "en", "s", 0) for i in range(40)])
    whole = got(spark, df, items)
    monkeypatch.setattr(D, "SLICE_BYTES", 500)
    assert got(spark, df, items) == whole and len(whole) == 40


def test_documents_shorter_than_an_item(spark):
    """An item less its last or first words is found as a document, by the whole document."""
    items = [(1, prose(41, 38)), (2, prose(42, 15)), (3, "one two three"), (4, prose(43, 59))]
    w = {i: t.split() for i, t in items}
    texts = [w[1][:36], w[1][:30], w[1][3:], w[2][:13], w[2][:12], w[4][5:55], w[4][:48], w[3][:2], w[1][:36] + ["x"], w[1][:4]]
    rows = [(i, " ".join(t), "en", "s", 0) for i, t in enumerate(texts)] + [(50, w[1][0], None, None, 0), (51, None, None, None, 0)]
    want = {}
    for i, t, *_ in rows:
        for j, x in items:
            s, b = weighted(tokens(t)), weighted(tokens(x))
            both, union = sum((s & b).values()), sum((s | b).values())
            if both and both * 10 >= 8 * union:
                want[i, j] = both / union
    df = frame(spark, rows)
    have = got(spark, df, items)
    assert have.keys() == want.keys() == {(0, 1), (2, 1), (3, 2), (5, 4), (6, 4), (8, 1)} and have[0, 1] == 32 / 34
    assert all(abs(have[k] - want[k]) < 1e-12 for k in want)
    kept = {r.doc_id for r in D.decontaminate(df, spark.createDataFrame(items, ITEMS)).collect()}
    assert kept == {r[0] for r in rows} - {i for i, _ in want}


def test_empty(spark):
    assert got(spark, frame(spark, []), [(1, "a b")]) == {}
    assert got(spark, frame(spark), []) == {}
    assert D.decontaminate(frame(spark), spark.createDataFrame([], ITEMS)).count() == len(awkward())


def test_duplicate_ids_keep_the_clean_text(spark):
    item = prose(5, 30)
    df = frame(spark, [(1, item, None, None, 0), (1, prose(6, 30), None, None, 0), (None, item, None, None, 0)])
    assert [r.text for r in D.decontaminate(df, spark.createDataFrame([(1, item)], ITEMS)).collect()] == [prose(6, 30)]


def test_nulls_buffer():
    from gavel.llm import _tokens as T
    data, off = T.buffers(pa.chunked_array([pa.array(["ab c", None]), pa.array(["", "d"])]))
    assert data.tobytes() == b"ab cd" and off.tolist() == [0, 4, 4, 4, 5]
