"""Cross parsing against substring search, and held-out accuracy."""
import random

from pyspark.sql import functions as F

from gavel.llm import langid as L
from gavel.llm.queries import QUERIES, table
from tests.llm.common import awkward, frame, prose

TEXTS = {"a": prose(1, 300, "abcde"), "b": prose(2, 200, "cdefgh"), "c": prose(3, 50, "xyzé")}


def phrases(parser, text, train):
    s = "".join(chr(65 + c) for c in parser.symbols(text))
    t = "".join(chr(65 + c) for c in parser.symbols(train))
    i = n = 0
    while i < len(s):
        j = i + 1
        while j <= len(s) and s[i:j] in t:
            j += 1
        i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrase_counts():
    p = L.Parser(TEXTS)
    rng = random.Random(4)
    texts = [prose(10 + i, rng.randint(0, 80), rng.choice(["abcde", "cdefgh", "xyzé", "aqxé"])) for i in range(60)] + ["", "...", "É x!"]
    sparse = L.Parser(TEXTS, dense_cells=0)
    assert isinstance(p.moves, L.Rows) and isinstance(sparse.moves, L.Edges)
    for docs in (texts, texts[:3], texts[::-1]):
        want = [[phrases(p, t, TEXTS[n]) for n in p.langs] for t in docs]
        assert all(q.phrases([q.symbols(t) for t in docs]).tolist() == want for q in (p, sparse))


def test_scripts_of_many_letters_stay_small():
    """Forty thousand characters over 3,000 ideographs beside two alphabets: no table of states by letters."""
    rng = random.Random(8)
    ideographs = [chr(0x4E00 + i) for i in range(3000)]
    han = "".join(rng.choice(ideographs[:rng.choice((30, 300, 3000))]) for _ in range(40_000))
    texts = {"en": prose(1, 8000, "abcdefghijklmnop"), "ru": prose(2, 8000, "абвгдежзиклмн"), "zh": han}
    p = L.Parser(texts)
    assert p.moves.nbytes < 60_000_000
    docs = [han[100:180] + "".join(rng.choice(ideographs) for _ in range(40)), prose(5, 40, "abcdefghijklmnop"), prose(6, 40, "абвгдежзиклмн"), "末" * 9]
    assert [g[0] for g in p.judge(docs * 10)][:3] == ["zh", "en", "ru"] and p.judge(docs) == p.judge(docs * 10)[:4]
    assert p.phrases([p.symbols(t) for t in docs]).tolist() == [[phrases(p, t, texts[n]) for n in p.langs] for t in docs]


def test_symbols():
    p = L.Parser({"a": "abc é"})
    assert p.symbols("  A,b..C É! q").tolist() == [p.code[ord(c)] for c in "a"] + [0, p.code[ord("b")], 0, p.code[ord("c")], 0, p.code[ord("é")],
                                                          0, p.code[ord("q")]]


def test_letters_of_no_training_text():
    p = L.Parser(TEXTS)
    got = p.judge(["абв", "а1б", "ABC ẞ", "12 !", None])
    assert all(g[0] in TEXTS and 0 < g[1] <= 1 for g in got[:3]) and got[2][0] == "a" and [g[0] for g in got[3:]] == ["und", "und"]
    assert p.phrases([p.symbols("абв")]).tolist() == [[3, 3, 3]]
    assert p.symbols("É").tolist() == p.symbols("é").tolist() and len(set(p.symbols("абв").tolist())) == 1


def test_awkward_rows(spark):
    df = frame(spark).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(2))
    got = L.identify(df, TEXTS).collect()
    assert len(got) == len(awkward())
    assert all(0 <= r.score <= 1 and r.lang_pred in {"a", "b", "c", "und"} for r in got)
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {3: "und", 4: "und", 5: "und"}
    assert {r.lang_pred for r in L.identify(df, {}).collect()} == {"und"}
    assert L.identify(frame(spark, []), TEXTS).collect() == []
    assert L.learn(frame(spark, []), F.lit(True)) == {}
    assert set(L.learn(frame(spark), F.lit(True))) == {"en"}


def test_sample_is_bounded(spark):
    rows = [(i, prose(i, 200), "en" if i % 2 else "de", "s", 0) for i in range(300)]
    texts = L.learn(frame(spark, rows), F.lit(True), docs_per_lang=20, chars_per_lang=5000)
    assert set(texts) == {"en", "de"} and all(len(t) <= 5000 for t in texts.values())
    assert texts == L.learn(frame(spark, rows).repartition(9), F.lit(True), docs_per_lang=20, chars_per_lang=5000)


def test_all_drawn_documents_count_from_any_place(spark):
    """A head that all documents share doesn't fill the sample."""
    head = prose(0, 400, "xyz")
    rows = [(i, head + " " + prose(i, 2000, "abcde" if i % 2 else "fghij"), "en" if i % 2 else "de", "s", 0) for i in range(60)]
    texts = L.learn(frame(spark, rows), F.lit(True), docs_per_lang=30, chars_per_lang=6000)
    for t in texts.values():
        assert 4000 < len(t) <= 6000 and sum(c in "xyz" for c in t) < 0.4 * len(t)
    more = L.learn(frame(spark, rows + [(1000 + i, "a b", f"l{i:03}", "s", 0) for i in range(50)]), F.lit(True), max_langs=2)
    assert set(more) == {"en", "de"}


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    got = QUERIES["op3_language_id"](spark, base).join(table(spark, base, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
