import os
from collections import Counter
from math import exp, log

from pyspark.sql import functions as F

from gavel.operators import corpus as CP
from gavel.operators import overlap as OV
from gavel.operators import ranking as RK


def test_read_articles_and_context(spark, tmp_dir):
    path = os.path.join(tmp_dir, "wiki.txt")
    with open(path, "w") as f:
        f.write("\n\nA one.\nA two.\nA three.\n\n\nB only.\n\n\n\nC one.\tx\nC two.\n\n")
    arts = CP.read_articles(spark, path)
    sents = CP.sentences_with_context(arts, "group_id", "lines").collect()
    by = {}
    for r in sents:
        by.setdefault(r.group_id, []).append(r)
    groups = sorted(([x.sentence for x in sorted(v, key=lambda r: r.pos)] for v in by.values()), key=lambda g: g[0])
    assert groups == [["A one.", "A two.", "A three."], ["B only."], ["C one.\tx", "C two."]]
    a2 = [r for r in sents if r.sentence == "A two."][0]
    assert (a2.prev_sentence, a2.next_sentence) == ("A one.", "A three.")
    b = [r for r in sents if r.sentence == "B only."][0]
    assert b.prev_sentence is None and b.next_sentence is None
    para = CP.with_paragraph(spark.createDataFrame(sents)).filter("sentence = 'A one.'").first().paragraph
    assert para == "A one. A two."


def test_crlf_articles_and_stable_ids(spark, tmp_dir):
    """CRLF files give the same articles, a row each, and ids don't depend on the splits."""
    text = "A one.\nA two.\n\nB only.\n\n\nC one.\nC two.\n\nB only.\n"
    got = {}
    for name, body in (("lf", text), ("crlf", text.replace("\n", "\r\n"))):
        path = os.path.join(tmp_dir, f"{name}.txt")
        with open(path, "w", newline="") as f:
            f.write(body)
        got[name] = CP.read_articles(spark, path).collect()
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16b")
        small = CP.read_articles(spark, path).collect()
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert sorted(r.group_id for r in small) == sorted(r.group_id for r in got[name])
        assert len({r.group_id for r in small}) == 4
    want = sorted([["A one.", "A two."], ["B only."], ["C one.", "C two."], ["B only."]])
    assert sorted(r.lines for r in got["lf"]) == want == sorted(r.lines for r in got["crlf"])


def test_stratified_sample_quota(spark):
    rows = [("f1", g, p) for g in range(3) for p in range(g * 3 + 1)] + [("f2", 9, p) for p in range(10)]
    df = spark.createDataFrame(rows, "file string, g int, pos int")
    got = CP.stratified_sample(df, "file", "g", 8, ["g", "pos"]).collect()
    c = Counter((r.file, r.g) for r in got)
    # quota per file 4; f1 has 3 groups -> max(1, 4 // 3) = 1 per group; f2 one group -> 4
    assert c == Counter({("f1", 0): 1, ("f1", 1): 1, ("f1", 2): 1, ("f2", 9): 4})


def test_length_band_is_strict(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 101)], "lenght int")
    kept = [r.lenght for r in CP.length_band(df).collect()]
    assert min(kept) == 3 and max(kept) == 98
    same = spark.createDataFrame([(5,)] * 10, "lenght int")
    assert CP.length_band(same).count() == 0


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _grams(s, n):
    return Counter(s[i:i + n] for i in range(len(s) - n + 1))


def _chrf(h, refs):
    h = "".join(h.split())
    best = 0.0
    for r in refs:
        r = "".join(r.split())
        fs = []
        for n in range(1, 7):
            hg, rg = _grams(h, n), _grams(r, n)
            if not hg or not rg:
                continue
            m = sum((hg & rg).values())
            p, rc = m / sum(hg.values()), m / sum(rg.values())
            fs.append(5 * p * rc / (4 * p + rc) if p + rc > 0 else 0.0)
        best = max(best, 100 * sum(fs) / len(fs) if fs else 0.0)
    return best


def _wscore(h, refs):
    ht = h.split()
    rts = [r.split() for r in refs]
    if not ht:
        return 0.0
    logs, m1 = 0.0, 0
    for n in range(1, 5):
        hg = Counter(tuple(ht[i:i + n]) for i in range(len(ht) - n + 1))
        mx = Counter()
        for rt in rts:
            for g, c in Counter(tuple(rt[i:i + n]) for i in range(len(rt) - n + 1)).items():
                mx[g] = max(mx[g], c)
        m = sum(min(c, mx[g]) for g, c in hg.items())
        t = max(len(ht) - n + 1, 0)
        if n == 1:
            if m == 0:
                return 0.0
            m1 = m
            logs += log(m / t)
        else:
            logs += log((m + 1) / (t + 1))
    c = len(ht)
    r = min((abs(len(rt) - c), len(rt)) for rt in rts)[1]
    bp = 1.0 if c > r else exp(1 - r / c)
    return 100 * bp * exp(logs / 4)


def test_overlap_scores_against_brute_force(spark):
    hyps = [(1, 1, "the cat sat on the mat"), (1, 3, "a dog"), (2, 1, "é ü 漢字 text"), (3, 1, "")]
    refs = [(1, 0, "the cat is on the mat"), (1, 2, "there is a cat"), (2, 0, "é ü 漢字 texts"), (3, 0, "x")]
    h = spark.createDataFrame(hyps, "g int, hk int, text string")
    r = spark.createDataFrame(refs, "g int, rk int, text string")
    cf = {(x.g, x.hk): x.chrf for x in OV.char_f_score(h, r, "g", "hk", "rk").collect()}
    ws = {(x.g, x.hk): x.score for x in OV.word_ngram_score(h, r, "g", "hk", "rk").collect()}
    for g, hk, text in hyps:
        rs = [t for gg, _, t in refs if gg == g]
        assert abs(cf[(g, hk)] - _chrf(text, rs)) < 1e-9
        assert abs(ws[(g, hk)] - _wscore(text, rs)) < 1e-9
    pairs = [("kitten", "sitting"), ("café", "cafe"), ("", "abc"), ("漢字", "漢")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [x[0] for x in df.select(OV.edit_distance("a", "b")).collect()] == [_lev(a, b) for a, b in pairs]


def test_win_loss_and_ranks(spark):
    ratings = spark.createDataFrame([
        ("s", "t1", "t2", "x", "y", 1.0, 3.0, True),
        ("s", "t1", "t3", "x", "z", 1.0, 5.0, False),
        ("s", "t2", "t3", "y", "z", 3.0, 5.0, True),
    ], "source_id string, translation_id_1 string, translation_id_2 string, translation_1 string, "
       "translation_2 string, human_score_1 double, human_score_2 double, model_agrees boolean")
    wl = {r.translation_id: (r.wins, r.losses, r.fluency_score) for r in RK.win_loss(ratings).collect()}
    assert wl == {"t1": (1, 1, 0.5), "t2": (1, 1, 0.5), "t3": (1, 1, 0.5)}
    top = RK.top_n_human_rank(RK.win_loss(ratings), RK.human_ranks(ratings), 1).collect()
    assert [(r.translation_id, r.human_rank) for r in top] == [("t1", 3)]


def test_pair_ratings_long_and_inline_agree(spark):
    pairs = spark.createDataFrame([("p1", "s", "a", "b", 1.0, 3.0), ("p2", "s", "a", "c", 1.0, 5.0)],
                                  "pair_id string, source_id string, translation_id_1 string, translation_id_2 string, "
                                  "human_score_1 double, human_score_2 double")
    votes = spark.createDataFrame([("p1", 1, False, "B"), ("p1", 1, True, "a"), ("p2", 1, False, "tie"),
                                   ("p2", 1, True, "b")], "pair_id string, repeat int, swapped boolean, response string")
    long = {r.pair_id: r.model_preference_score for r in RK.pair_ratings(votes, pairs, 1).collect()}
    arr = votes.groupBy("pair_id").agg(F.collect_list(F.struct("repeat", "swapped", "response")).alias("replies"))
    inline = {r.pair_id: r.model_preference_score
              for r in RK.pair_ratings_inline(pairs.join(arr, "pair_id"), "replies", 1).collect()}
    assert long == inline == {"p1": 1.0, "p2": 0.25}


def test_edit_distance_of_long_near_copies(spark):
    """Copies of 100,000 characters a few edits apart take seconds; the distance is that of the whole matrix."""
    import random
    import time
    from gavel.operators import overlap as OV
    rng = random.Random(4)
    base = "".join(rng.choice("abcdef ") for _ in range(100_000))
    w = list(base)
    for at in rng.sample(range(100_000), 40):
        w[at] = "Z"
    df = spark.createDataFrame([(base, "".join(w)), (base, base[:-7]), (base, base)], "a string, b string")
    t = time.time()
    assert [r.d for r in df.select(OV.edit_distance("a", "b").alias("d")).collect()] == [40, 7, 0]
    assert time.time() - t < 30
    rows = [("".join(rng.choice("abcé") for _ in range(rng.randint(0, 200))), "".join(rng.choice("abcé") for _ in range(rng.randint(0, 200)))) for _ in range(60)]

    def full(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    points = lambda x: __import__("numpy").array([ord(c) for c in x], dtype="int64")
    for a, b in rows:
        want = full(a, b)
        assert OV.few_edits(points(a), points(b), 300) == want and OV.few_edits(points(a), points(b), want) == want
        assert want == 0 or OV.few_edits(points(a), points(b), want - 1) is None
        assert OV.few_edits(points(a), points(a[:50] + "x" + a[50:]), 5) == 1
    got = spark.createDataFrame(rows + [(None, "x"), ("", "")], "a string, b string").select("a", "b", OV.edit_distance("a", "b").alias("d")).collect()
    assert all(r.d == full("None" if r.a is None else r.a, r.b) for r in got)


def test_packed_multisets_are_not_shuffled(spark):
    """Packed arrays are made where pairs are scored: no exchange carries a binary as large as they are."""
    from gavel.operators import overlap as OV
    hyps = spark.createDataFrame([(1, 0, "abc def " * 50)], "g long, k long, text string")
    refs = spark.createDataFrame([(1, 1, "abc dex " * 50)], "g long, r long, text string")
    packer = OV.Packer(OV._code_points, OV.CHAR_ORDERS)
    packed = sum(x.nbytes for x in packer.sets("abcdef" * 50))
    assert packed > 20 * 300
    for df in (OV.char_f_score(hyps, refs, "g", "k", "r"), OV.word_ngram_score(hyps, refs, "g", "k", "r")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("SortMergeJoin [g"):] if "SortMergeJoin [g" in plan else plan
        assert "hg#" not in plan and "rg#" not in plan and "Join" in below


def test_kept_multisets_are_bounded(monkeypatch):
    from gavel.operators import overlap as OV
    monkeypatch.setattr(OV, "PACKED_BYTES", 10_000)
    packer = OV.Packer(OV._code_points, OV.CHAR_ORDERS)
    for i in range(200):
        want = OV._multisets(OV._code_points(f"text {i} " * 8), OV.CHAR_ORDERS)
        assert all((a == b).all() for a, b in zip(packer.sets(f"text {i} " * 8), want))
    assert packer.size <= 10_000 and len(packer.kept) < 10
