import random

from pyspark.sql import functions as F

from gavel.operators import metrics as M
from gavel.operators import ordering as O


def test_global_rank_and_hash_rank(spark):
    rnd = random.Random(3)
    vals = [(rnd.randint(0, 50), k) for k in range(500)]
    df = spark.createDataFrame(vals, "v int, k int")
    got = {(r.v, r.k): r.rank for r in O.global_rank(df, ["v", "k"], "rank").collect()}
    exp = {x: i + 1 for i, x in enumerate(sorted(vals))}
    assert got == exp
    h = df.withColumn("h", O.seeded_hash("k"))
    got2 = sorted((r.rank, r.h) for r in O.rank_by_hash(h, "h", ["k"], "rank").collect())
    assert [x[0] for x in got2] == list(range(1, 501))
    assert [x[1] for x in got2] == sorted(x[1] for x in got2)


def test_top_n_per_group_with_hot_group(spark):
    rows = [("hot", i, (i * 37) % 101) for i in range(3000)] + [("cold", i, i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, id int, s int")
    got = O.top_n_per_group(df, ["g"], [F.col("s").desc(), F.col("id")], 5, salt_cols=["id"]).collect()
    exp = []
    for g in ("hot", "cold"):
        xs = sorted([r for r in rows if r[0] == g], key=lambda r: (-r[2], r[1]))[:5]
        exp += [(g, r[1]) for r in xs]
    assert sorted((r.g, r.id) for r in got) == sorted(exp)


def test_positional_split(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "i int")
    s = {r.i: r.split for r in O.positional_split(df, ["i"]).collect()}
    assert [s[i] for i in range(11)] == ["train"] * 8 + ["test"] * 3


def _avg_ranks(xs):
    order = sorted(range(len(xs)), key=lambda i: xs[i])
    ranks = [0.0] * len(xs)
    i = 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and xs[order[j + 1]] == xs[order[i]]:
            j += 1
        for k in range(i, j + 1):
            ranks[order[k]] = (i + j) / 2 + 1
        i = j + 1
    return ranks


def _pearson(a, b):
    n = len(a)
    ma, mb = sum(a) / n, sum(b) / n
    cov = sum((x - ma) * (y - mb) for x, y in zip(a, b))
    va = sum((x - ma) ** 2 for x in a) ** 0.5
    vb = sum((y - mb) ** 2 for y in b) ** 0.5
    return cov / (va * vb)


def test_spearman_and_regression(spark):
    rnd = random.Random(5)
    t = [rnd.randint(1, 5) for _ in range(200)]
    p = [min(5, max(1, x + rnd.choice([-1, 0, 0, 1]))) for x in t]
    df = spark.createDataFrame(list(zip(t, p)), "t int, p int")
    sp = M.spearman(df, "t", "p").first().spearman
    assert abs(sp - _pearson(_avg_ranks(t), _avg_ranks(p))) < 1e-9
    r = M.regression_metrics(df, "t", "p").first()
    assert abs(r.mae - sum(abs(a - b) for a, b in zip(t, p)) / 200) < 1e-12
    assert abs(r.pearson - _pearson(t, p)) < 1e-9


def test_confusion_and_report(spark):
    rows = [("A", "A"), ("A", "B"), ("B", "B"), ("B", "B"), ("C", "A")]
    conf = M.confusion(spark.createDataFrame(rows, "t string, p string"), "t", "p", ["A", "B"])
    assert sorted(tuple(r) for r in conf.collect()) == [("A", "A", 1), ("A", "B", 1), ("B", "A", 0), ("B", "B", 2)]
    rep = {r.label: r for r in M.classification_report(conf, ["A", "B"]).collect()}
    assert rep["A"].precision == 1.0 and rep["A"].recall == 0.5
    assert abs(rep["B"].precision - 2 / 3) < 1e-9 and rep["accuracy"].f1 == 0.75


def test_ab_metrics_and_histograms(spark):
    df = spark.createDataFrame([("A", "A", False), ("B", "A", True), ("B", "B", False)], "predicted string, correct string, is_tie boolean")
    w = M.ab_metrics_with_ties(df).first()
    wo = M.ab_metrics_without_ties(df).first()
    assert (w.correct, w.ties, w.accuracy) == (2, 1, 2 / 3)
    assert (wo.non_tie, wo.correct_non_tie, wo.accuracy) == (2, 2, 1.0)
    allties = M.ab_metrics_without_ties(df.filter("is_tie")).first()
    assert allties.accuracy == 0.0
    h = M.equal_width_histogram(spark.createDataFrame([(float(x),) for x in range(11)], "v double"), "v", 5)
    assert [r.n for r in h.orderBy("bin").collect()] == [2, 2, 2, 2, 3]
    ih = M.integer_histogram(spark.createDataFrame([(1,), (5,), (5,), (7,)], "v int"), "v")
    assert [r.n for r in ih.orderBy("value").collect()] == [1, 0, 0, 0, 2]
    half = M.integer_histogram(spark.createDataFrame([(x + 0.5,) for x in range(6)], "v double"), "v")
    assert [r.n for r in half.orderBy("value").collect()] == [1, 1, 1, 1, 2]  # as numpy: the last bin is closed
    d = M.describe(spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double"), "v").first()
    assert (d.p25, d.p50, d.p75) == (25.75, 50.5, 75.25)
    q = M.exact_percentiles(spark.createDataFrame([(float(x),) for x in range(1, 101)], "v double"), "v", [0.02, 0.98]).first()
    assert (round(q.p02, 6), round(q.p98, 6)) == (2.98, 98.02)


def test_percentiles_of_any_doubles(spark):
    """Against Spark's exact percentile, with repeats, negatives, one value and none."""
    rnd = random.Random(8)
    for values in ([rnd.gauss(0, 1e6) for _ in range(3000)], [rnd.choice([-1.5, 0.0, 2.25]) for _ in range(50)], [4.0], [1e-300, 1e300, 3.0, None]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        probs = [0.0, 0.02, 0.25, 0.5, 0.77, 1.0]
        want = df.selectExpr("percentile(v, array(0.0D, 0.02D, 0.25D, 0.5D, 0.77D, 1.0D)) AS q").first().q
        got = M.exact_percentiles(df, "v", probs).first()
        assert all(abs(a - b) <= 1e-12 * max(1, abs(a)) for a, b in zip(want, got))
    assert list(M.exact_percentiles(spark.createDataFrame([], "v double"), "v", [0.5]).first()) == [None]


def test_correlations_per_model(spark):
    rnd = random.Random(9)
    rows = [(f"m{i % 3}", rnd.randint(1, 5), rnd.random(), rnd.choice([None, 1.0, 2.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, h int, a double, b double")
    sp = {r.model: (r.spearman, r.n) for r in M.spearman(df, "h", "a", ["model"]).collect()}
    pe = {(r.model, r.column): (r.pearson, r.n) for r in M.pearson_by(df, "h", ["a", "b"], ["model"]).collect()}
    for m in ("m0", "m1", "m2"):
        x = [(r[1], r[2]) for r in rows if r[0] == m]
        assert abs(sp[m][0] - _pearson(_avg_ranks([a for a, _ in x]), _avg_ranks([b for _, b in x]))) < 1e-9 and sp[m][1] == 100
        y = [(r[1], r[3]) for r in rows if r[0] == m and r[3] is not None]
        assert abs(pe[m, "b"][0] - _pearson([a for a, _ in y], [b for _, b in y])) < 1e-9 and pe[m, "b"][1] == len(y)


def test_running_sums_of_a_skewed_distribution(spark):
    """Lognormal values and one far outlier: exact sums, and no range holds many more values than another."""
    import random
    from collections import Counter
    from pyspark.sql import functions as F
    rng = random.Random(2)
    values = [round(rng.lognormvariate(0, 3), 3) for _ in range(20_000)] + [1e18, -5.0]
    df = spark.createDataFrame([(v, "ab"[i % 2]) for i, v in enumerate(values)], "v double, g string")
    got = {r.v: (r.n, r.before) for r in M.running_counts(df, "v").collect()}
    want, seen = {}, 0
    for v, n in sorted(Counter(values).items()):
        want[v], seen = (n, seen), seen + n
    assert got == want
    plan = M.running_sums(df.groupBy("v").agg(F.count("*").alias("n")), "v", cells=64)
    assert plan.count() == len(want)
    cuts = df.select("v").distinct().agg(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 640).alias("c")).first().c
    sizes = Counter(sum(c <= v for c in cuts) for v in want)
    assert max(sizes.values()) <= 2 * len(want) / 64
    per = {(r.g, r.v): r.before for r in M.running_sums(df.groupBy("g", "v").agg(F.count("*").alias("n")), "v", ["g"]).collect()}
    for g in "ab":
        seen = 0
        for v, n in sorted(Counter(v for i, v in enumerate(values) if "ab"[i % 2] == g).items()):
            assert per[g, v] == seen
            seen += n
