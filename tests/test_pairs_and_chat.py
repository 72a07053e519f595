import itertools
import re

from pyspark.sql import functions as F

from gavel.operators import chat as C
from gavel.operators import pairs as P


def _items(spark, rows):
    df = spark.createDataFrame(rows, "id string, sentence string, score string")
    return P.prepare_items(df.withColumn("o", F.monotonically_increasing_id()), "id", "sentence", "score", order_col="o")


def test_prepare_items_rejects(spark):
    rows = [("1-1", "god dag", "3"), ("1-2", "ok", "4"), ("2-1", None, "2"), ("3", "hej med dig", "x"), (None, "abc", "1")]
    items, rejects = _items(spark, rows)
    assert sorted(r.id for r in items.collect()) == ["1-1"]
    reasons = {r.reject_reason for r in rejects.collect()}
    assert reasons == {"invalid_sentence", "invalid_score", "missing_id"}


def test_pairs_semantics_and_blocks(spark):
    rows = [(f"g{g}-{i}", f"sentence number {g}-{i}", str((i * 7 + g) % 5 + 1)) for g in range(3) for i in range(9)]
    rows += [("solo-1", "only one here", "4"), ("eq-1", "same score a", "3"), ("eq-2", "same score b", "3")]
    items, _ = _items(spark, rows)
    pairs = P.preference_pairs(items, min_diff=2)
    got = {(r.better_id, r.worse_id) for r in pairs.collect()}
    # brute force: all i<j pairs in a group with |diff| >= 2
    exp = set()
    by = {}
    for k, (i, s, sc) in enumerate(rows):
        by.setdefault(i.split("-")[0], []).append((k, i, float(sc)))
    for g, xs in by.items():
        for (ka, ia, sa), (kb, ib, sb) in itertools.combinations(xs, 2):
            if abs(sa - sb) >= 2 and sa != sb:
                exp.add((ia, ib) if sa > sb else (ib, ia))
    assert got == exp
    # hot-group blocking gives the same pairs
    small = {(r.better_id, r.worse_id) for r in P.preference_pairs(items, min_diff=2, block_rows=2).collect()}
    assert small == exp
    for r in pairs.collect():
        assert r.chosen != r.rejected
        assert len(r.prompt) >= 50
        if "1." in r.prompt:
            assert {r.chosen, r.rejected} == {"1", "2"}


def test_group_split_is_leak_free(spark):
    rows = [(f"g{g}-{i}", f"text {g} {i} long enough", str(i % 5 + 1)) for g in range(20) for i in range(4)]
    items, _ = _items(spark, rows)
    split = P.group_split(P.preference_pairs(items, min_diff=1)).collect()
    train = {r.group_key for r in split if r.split == "train"}
    test = {r.group_key for r in split if r.split == "test"}
    assert not train & test
    assert len(train) == int(0.8 * len(train | test))


def test_translation_mode_needs_same_source(spark):
    df = spark.createDataFrame([("1-1", "god dag", "5", "good day"), ("1-2", "goddag", "1", "good day"),
                                ("1-3", "dav du", "1", "hello"), ("1-4", "hej hej", "1", "")],
                               "id string, sentence string, score string, src string")
    items, _ = P.prepare_items(df, "id", "sentence", "score", english_col="src")
    got = P.preference_pairs(items, translation=True).collect()
    assert [(r.better_id, r.worse_id) for r in got] == [("1-1", "1-2")]
    assert "good day" in got[0].prompt


def test_instruction_templates(spark):
    df = spark.createDataFrame([("100% {} %s text",)], "t string")
    for tpl, exp in [("Rate: %s!", "Rate: 100% {} %s text!"), ("Say {} now", "Say 100% {} %s text now"),
                     ("No slot", "No slot 100% {} %s text"), ("%s and %s", "%s and %s 100% {} %s text")]:
        rec, _ = C.chat_records(df.withColumn("o", F.lit(1)), "t", "o", tpl)
        assert rec.first().user_content == exp


def test_reject_reasons(spark):
    df = spark.createDataFrame([("a", 1, True), ("  ", 1, True), ("b", None, True), ("c", 1, False)],
                               "i string, o int, has boolean")
    _, rej = C.chat_records(df, "i", "o", "%s", output_present="has")
    assert sorted(r.reject_reason for r in rej.collect()) == ["empty_input", "missing_output", "null_output"]


def _py_rules():
    out = []
    for p, r in C.AB_REWRITE_RULES:
        m = re.match(r"\(\?([a-zA-Z]+)\)", p)
        flags = 0
        if m:
            for ch in m.group(1):
                flags |= {"m": re.M, "i": re.I}.get(ch, 0)
            p = p[m.end():]
        out.append((re.compile(p, flags), re.sub(r"\$(\d)", r"\\\1", r)))
    return out


def test_ab_rewrite_matches_python_re(spark):
    texts = ["Choose:\n\n1. foo\n2. bar\n\nAnswer 1 or 2:", " 1) x\n  2) y", "Option 1 or option 2", "sentence 2 is 1",
             "Answer with only the number (1 or 2)", "Select 1 or 2. Pick 1 or 2", "(1) and (2) (1 or B) (A or 2)",
             "Answer: (1 or 2 only)", "year 1999 and 12 apples 1 Æble", "2", "Respond with ONLY a or b:", "x 1\n"]
    rules = _py_rules()

    def ref(t):
        for c, r in rules:
            t = c.sub(r, t)
        return t
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(C.ab_user_text("t")).collect()]
    assert got == [ref(t) for t in texts]
    answers = spark.createDataFrame([("1",), (" 2 ",), (" B ",), ("Both",)], "a string")
    assert [r[0] for r in answers.select(C.ab_answer("a")).collect()] == ["A", "B", "B", "Both"]


def test_ab_rewrite_in_any_case(spark):
    """Every rule phrase in random case mixes, alone and in text, against Python ``re``."""
    import random
    rng = random.Random(11)
    rules = _py_rules()
    phrases = ["Option 1", "option  2", "Sentence 1", "Answer with only the number (1 or 2)", "Answer with only the number (1 and 2)",
               "Answer with only the number 1 or 2", "Answer with only number (1 or 2)", "Select 1 or 2", "Choose 1 or 2", "Answer 1 or B",
               "Answer A or 2", "Answer 1 or 2", "Pick 1 or 2", "number (1 or 2)", "number 1 or 2", "the number (1 or B)",
               "Your answer (letter only):", "Respond with only A or B:", "(1)", "(2)", "Answer: (1 or 2 only)", "(1 or B)", "(A or 2)", "(1 or 2)"]
    texts = []
    for p in phrases:
        for _ in range(12):
            mixed = "".join(rng.choice((c.lower(), c.upper())) for c in p)
            texts.append(rng.choice(("", "Reply ", "1. ", "x\n2) ")) + mixed + rng.choice(("", " now", " ok\n1 Æ", ": 2")))

    def ref(t):
        for c, r in rules:
            t = c.sub(r, t)
        return t

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.ab_user_text("t")).collect()]
    assert got == [ref(t) for t in texts]


def test_custom_templates_are_rewritten_whole(spark):
    rows = [(f"g{g}-{i}", w, str(i % 5 + 1)) for g in range(4) for i, w in enumerate(["Hund", "Kat her", "Option two", "with (2) here"])]
    items, _ = _items(spark, rows)
    rules = _py_rules()
    pairs = P.preference_pairs(items, min_diff=1, templates=[
        "1 {sentence_a}\n2 {sentence_b}\n which of these two sentences is it, Answer 1 OR 2", "{sentence_b} OR {sentence_a}: sElEcT 1 oR 2, which one of them reads better"])
    got = C.pairs_to_chat(pairs).select("prompt", "user_content", "error").collect()
    assert len(got) > 10
    for r in got:
        t = r.prompt
        for c, rep in rules:
            t = c.sub(rep, t)
        assert r.user_content == t and r.error is None


def test_equal_order_keeps_every_pair(spark):
    df = spark.createDataFrame([("g-1", "one here", "1"), ("g-1", "two here", "3"), ("g-2", "three here", "5")], "id string, s string, score string")
    items, _ = P.prepare_items(df, "id", "s", "score")
    assert P.candidate_pairs(items).count() == 3


def test_records_with_errors(spark):
    df = spark.createDataFrame([(1, [("user", "Answer 1 oR 2"), ("assistant", "2")]), (2, None), (3, []), (4, [("assistant", "Both")])],
                               "id int, messages array<struct<role:string,content:string>>")
    got = {r.id: r for r in C.rewrite_records(df).collect()}
    assert (got[1].user_edited, got[1].assistant_edited, got[1].error) == (True, True, None)
    assert (got[2].error, got[3].error, got[4].error, got[4].assistant_edited) == ("missing_messages", "empty_messages", None, False)
    c = C.conversion_counters(C.rewrite_records(df)).first()
    assert (c.n_records, c.user_conversions, c.assistant_conversions, c.errors) == (4, 1, 1, 2)


def test_message_rewrite(spark):
    df = spark.createDataFrame([([("user", "Answer 1 or 2:"), ("assistant", "2")],)],
                               "messages array<struct<role:string,content:string>>")
    got = df.select(C.rewrite_messages("messages")).first()[0]
    assert [tuple(m) for m in got] == [("user", "Answer A or B:"), ("assistant", "B")]


def test_large_groups_against_all_pairs(spark):
    """Groups above the limit, with continuous, discrete and equal scores, beside small ones."""
    import random
    rng = random.Random(3)
    rows = []
    for g, n, score in [("wide", 900, lambda: rng.lognormvariate(0, 2)), ("five", 700, lambda: float(rng.randint(1, 5))),
                        ("same", 300, lambda: 2.0), ("small", 40, lambda: rng.random() * 3), ("two", 500, lambda: rng.choice([0.0, 1.0]))]:
        rows += [(f"{g}{k}", k // 2, g, f"text {k % 7}", score()) for k in range(n)]  # pairs of equal ord
    df = spark.createDataFrame(rows, "id string, ord long, group_key string, sentence string, score double")
    for d in (0.0, 0.5, 1.0, 3.0):
        got = P.candidate_pairs(df, min_diff=d, block_rows=100).select("first_id", "second_id", "better_id", "worse_id").collect()
        want = []
        by = {}
        for r in rows:
            by.setdefault(r[2], []).append(r)
        for members in by.values():
            for i, x in enumerate(members):
                for y in members[i + 1:]:
                    if abs(x[4] - y[4]) >= d and x[4] != y[4]:
                        a, b = (x, y) if (x[1], x[0]) < (y[1], y[0]) else (y, x)
                        hi, lo = (x, y) if x[4] > y[4] else (y, x)
                        want.append((a[0], b[0], hi[0], lo[0]))
        assert len(got) == len(want) and sorted(map(tuple, got)) == sorted(want), d


def test_large_groups_join_about_what_qualifies(spark):
    """One per cent of a large group's pairs qualify: about twice as many rows are joined, and no key is large."""
    n = 8000
    df = spark.range(n).selectExpr("cast(id as string) AS id", "id AS ord", "'g' AS group_key", "'text' AS sentence",
                                   "pmod(xxhash64(id), 1000000) / 1000000.0D AS score")
    low, high, on = P._banded(df, ["group_key"], 0.9)
    joined = low.join(high, on)
    total, good = joined.selectExpr("1").count(), P.candidate_pairs(df, 0.9, block_rows=100).count()
    assert 0.004 < good / (n * n / 2) < 0.02 and total < 2.5 * good
    assert max(r["count"] for side in (low, high) for r in side.groupBy(*on).count().collect()) <= 2 * P.BLOCK


def test_rules_that_can_not_match_change_nothing(spark):
    """Random joins of rule phrases, their pieces and Java's extra letters: as the plain chain of all rules."""
    import random

    from pyspark.sql import functions as F
    rng = random.Random(3)
    pieces = ["1", "2", "1)", "2.", " ", "\n", ":", "(", ")", "A", "b", " or ", " only", "Option ", "optıon", "ſentence 1", "Anſwer 1 or 2",
              "pİcK 1 or 2", "Answer with only the number ", "(1 or 2)", "Select ", "Choose ", "number ", "the ", "letter", "Your answer (letter only):",
              "respond with only a OR B:", "Answer: (", "Æ", "x", "Σ", "1 or B", "A or 2"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(1500)] + [None, ""]
    assert len(C._RULE_NEEDS) == len(C.AB_REWRITE_RULES)
    plain = F.col("t")
    for pattern, repl in C.AB_REWRITE_RULES:
        plain = F.regexp_replace(plain, pattern, repl)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(C.ab_user_text("t").alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
