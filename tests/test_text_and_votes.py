
from gavel.functions import text as TX
from gavel.functions import votes as V


def one(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_py_strip_matches_python(spark):
    samples = ["  a b  ", "　x ", "\x1c\x1dy\x1f", "\tz\n\x0b\x0c\r", "", " q ", "none"]
    got = one(spark, [(s,) for s in samples], "s string", TX.py_strip("s"))
    assert got == [s.strip() for s in samples]


def test_token_estimates_and_tag_ids(spark):
    got = spark.createDataFrame([("abcdefgh", "1-2.3")], "t string, i string").select(
        TX.item_tokens("t"), TX.text_tokens("t"), TX.tag_safe_id("i")).first()
    assert tuple(got) == ((8 + 16) // 4 + 50, 8 // 4, "1_2_3")


def test_quoted_text_forms(spark):
    rows = ['Rate "god dag" now', 'Text: "only one', "Sentence: hello there ", "plain text", '"a" and "b"']
    got = one(spark, [(r,) for r in rows], "s string", TX.quoted_text("s"))

    def ref(u):
        a, b = u.find('"'), u.rfind('"')
        if a != -1 and b != -1 and a != b:
            return u[a + 1:b]
        c = u.rfind(":")
        return u[c + 1:].strip().strip('"') if c != -1 else u
    assert got == [ref(r) for r in rows]


def test_score_forms(spark):
    df = spark.createDataFrame([("4/5",), ("Score: 3/5",), ("x/5",), ("Score 4/5 good",)], "s string")
    a = [r[0] for r in df.select(TX.score_before_slash("s")).collect()]
    b = [r[0] for r in df.select(TX.score_last_token_before_slash("s")).collect()]
    assert a == [4, None, None, None]
    assert b == [4, 3, None, None]


def test_first_tag_and_rank_list(spark):
    df = spark.createDataFrame([("x <Score> 4 </score> y <score>5</score>", "3, 1,x")], "r string, l string")
    row = df.select(TX.first_tag_text("r", "score"), TX.rank_list("l")).first()
    assert row[0] == "4" and row[1] == [3, 1, None]


def test_logprob_vote_cases(spark):
    rows = [
        ({"A": -0.5}, ("A", False)),
        ({" B": -0.5}, ("B", False)),
        ({"C": -0.1}, ("A", True)),
        ({" A": -1.0, "\nA": -0.2, "B": -0.25}, ("A", True)),   # diff 0.05 -> tie
        ({"A": -0.1, "B": -0.3}, ("A", False)),                # diff 0.2
        ({"A": -0.3, "B": -0.3}, ("B", True)),                 # equal -> B, tie
        ({" A ": -0.3, "_B": -0.9}, ("A", False)),             # stripped key
        ({}, ("A", True)),
    ]
    df = spark.createDataFrame([(m,) for m, _ in rows], "m map<string,double>")
    got = [tuple(r[0]) for r in df.select(V.logprob_vote("m")).collect()]
    assert got == [e for _, e in rows]


def test_prob_vote_and_argmax(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.7, 0.2), (0.1, 0.3), (None, 0.3)], "a double, b double")
    got = [tuple(r[0]) for r in df.select(V.prob_vote("a", "b")).collect()]
    assert got == [("A", True), ("A", False), ("B", False), ("A", False)]
    p = spark.createDataFrame([([0.1, 0.4, 0.4, 0.1, 0.0],), (None,)], "p array<double>")
    assert [r[0] for r in p.select(V.argmax_score("p")).collect()] == [2, 3]


def test_vote_points(spark):
    rows = [("A", False), (" b ", False), ("equal", True), ("tie", False), ("<winner>A</winner>", True), ("hmm", False)]
    df = spark.createDataFrame(rows, "r string, s boolean")
    got = [tuple(x[0]) for x in df.select(V.vote_points("r", "s")).collect()]
    assert got == [(0.0, 1.0), (1.0, 0.0), (0.5, 0.5), (0.5, 0.5), (1.0, 0.0), (0.0, 0.0)]


def test_compare_and_error_reduction(spark):
    df = spark.createDataFrame([(3, 4, 50.0, 75.0), (4, 4, 100.0, 90.0), (5, 2, 0.0, 0.0)], "n int, o int, b double, w double")
    got = df.select(V.compare_scores("n", "o"), TX.error_reduction("b", "w")).collect()
    assert [r[0] for r in got] == ["worse", "equal", "better"]
    assert [r[1] for r in got] == [0.5, None, 0.0]


def test_small_scalar_helpers(spark):
    df = spark.createDataFrame([("org/gpt4o_cot_scores", "3304-3-2", "A", "A", True)],
                               "m string, i string, p string, t string, tie boolean")
    r = df.select(TX.model_short_name("m"), TX.group_key("i"), V.correct_flag("p", "t"),
                  V.correct_flag("p", "t", "tie")).first()
    assert tuple(r) == ("gpt4o", "3304", True, False)
