import json
import os

from pyspark.sql import functions as F

from gavel.functions import text as TX
from gavel.functions import votes as V
from gavel.operators import corpus as CP
from gavel.operators import lookup as LK
from gavel.operators import metrics as M
from gavel.operators import ordering as O
from gavel.operators import ranking as RK
from gavel.sources import io as IO


def test_model_results_glob_whole_file_and_parquet_glob(spark, tmp_dir):
    for name, rows in [("gpt4o_cot_scores.jsonl", [{"id": "1", "score": 4}]),
                       ("llama_scores.jsonl", [{"id": "1", "score": 2}, {"id": "2", "score": 5}])]:
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows))
    got = IO.read_model_results(spark, os.path.join(tmp_dir, "*_scores.jsonl"), "id string, score int").collect()
    assert sorted((r.model, r.method, r.id) for r in got) == [("gpt4o", "cot", "1"), ("llama", "direct", "1"),
                                                             ("llama", "direct", "2")]
    with open(os.path.join(tmp_dir, "prompt.txt"), "w") as f:
        f.write("line one\nline two\n")
    assert IO.read_whole(spark, os.path.join(tmp_dir, "prompt.txt")).first().text == "line one\nline two\n"
    for i in range(3):
        spark.createDataFrame([(i,)], "x int").write.parquet(os.path.join(tmp_dir, f"p{i}.parquet"))
    g = IO.read_parquet_glob(spark, os.path.join(tmp_dir, "p*.parquet"), max_files=2)
    assert sorted(r.x for r in g.collect()) == [0, 1]
    IO.write_metrics(spark.createDataFrame([(0.5, [[1, 2], [3, 4]])], "accuracy double, matrix array<array<long>>"),
                     os.path.join(tmp_dir, "m"))
    IO.write_sentences(spark.createDataFrame([(1, "a")], "group_id long, sentence string"), os.path.join(tmp_dir, "s"))
    assert spark.read.json(os.path.join(tmp_dir, "m")).first().matrix == [[1, 2], [3, 4]]
    assert IO.read_any(spark, os.path.join(tmp_dir, "p0.parquet")).count() == 1


def test_blank_line_article_ids(spark):
    rows = [("f", i, t) for i, t in enumerate(["a1", "a2", "", "b1", "", "", "c1"])]
    df = spark.createDataFrame(rows, "file string, line int, sentence string")
    got = [(r.group_id, r.sentence) for r in CP.article_ids_by_blank_lines(df, "file", "line", "sentence").orderBy("line").collect()]
    assert got == [(0, "a1"), (0, "a2"), (1, "b1"), (3, "c1")]


def test_lookups(spark):
    dim = spark.createDataFrame([(0, "Danish", "da", "dan"), (1, "Dutch", "nl", "dan"), (2, "x", "dan", "y")],
                                "ord int, name string, a2 string, a3 string")
    vals = spark.createDataFrame([("dan",), ("nl",), ("zz",)], "v string")
    got = {r.v: r.out for r in LK.any_column_lookup(vals, "v", dim, ["a2", "a3"], "ord", "name", "out").collect()}
    assert got == {"dan": "x", "nl": "Dutch", "zz": ""}
    names = spark.createDataFrame([("m1",), ("m2",)], "model string")
    dimn = spark.createDataFrame([("m1", "Model One")], "k string, d string")
    assert sorted(r.shown for r in LK.display_names(names, "model", dimn, "k", "d", "shown").collect()) == ["Model One", "m2"]
    ans = spark.createDataFrame([(0, "A", "r")], "idx int, winner string, reason string")
    rows = spark.createDataFrame([(0,), (1,)], "i int")
    j = {r.i: r.winner for r in LK.attach_answers(rows, "i", ans).collect()}
    assert j == {0: "A", 1: None}


def test_references_long_and_shuffle(spark):
    refs = spark.createDataFrame([("s1", "r1"), ("s1", "r2")], "source_id string, reference string")
    tg = spark.createDataFrame([("s1", "r2"), ("s2", "t")], "source_id string, target string")
    got = sorted(tuple(r) for r in RK.references_long(refs, tg).collect())
    assert got == [("s1", "r1"), ("s1", "r2"), ("s2", "t")]
    df = spark.createDataFrame([(i,) for i in range(20)], "k int")
    a = [r.k for r in O.seeded_shuffle(df, ["k"]).collect()]
    b = [r.k for r in O.seeded_shuffle(df.repartition(5), ["k"]).collect()]
    assert a == b and sorted(a) == list(range(20)) and a != list(range(20))


def test_small_column_helpers(spark):
    df = spark.createDataFrame([([("user", "hi")], "p", True, " B ", ["a", "b"], "x")],
                               "m array<struct<role:string,content:string>>, prompt string, flag boolean, v string, "
                               "arr array<string>, s string")
    r = df.select(TX.message_text("m", "prompt").alias("t"), V.edited_side("flag").alias("side"),
                  V.verdict_matches("v", F.lit("B")).alias("ok")).first()
    assert (r.t, r.side, r.ok) == ("hi", "B", True)
    empty = spark.createDataFrame([([], "p")], "m array<struct<role:string,content:string>>, prompt string")
    assert empty.select(TX.message_text("m", "prompt")).first()[0] == "p"
    up = lambda c: F.upper(c)
    out = TX.map_scalar_or_list_df(TX.map_scalar_or_list_df(df, "arr", up), "s", up).first()
    assert out["arr_mt-translated"] == ["A", "B"] and out["s_mt-translated"] == "X"


def test_mse_filters_and_unions(spark):
    long = spark.createDataFrame([("m", 3.0, 3.0), ("m", 4.0, 2.0), ("m", 5.0, None)], "model string, h double, v double")
    se = M.squared_errors(long, "h", "v")
    assert M.mse_by_model(se, ["model"]).first().mse == 2.0
    assert M.mse_by_model(se, ["model"], disagreements_only=True).first().mse == 4.0
    ev = spark.createDataFrame([({"A": -1.0}, "A", None), ({}, "B", None), ({}, "A", "B"), ({"A": 0.0}, None, None)],
                               "top map<string,double>, ans string, stored string")
    ok, counts = M.evaluable(ev, "top", "ans", "stored")
    assert ok.count() == 2 and tuple(counts.first()) == (2, 2)
    wide = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, a_cot double, a_da double, b_score double")
    assert M.columns_by_suffix(wide, ["_cot", "_score"]).columns == ["a_cot", "b_score"]
    u = M.union_long([spark.createDataFrame([(1, "x")], "id int, a string"), spark.createDataFrame([(2, 0.5)], "id int, b double")])
    assert sorted(u.columns) == ["a", "b", "id"] and u.count() == 2


def test_nested_items_whose_fields_are_all_null_stay(spark):
    df = spark.createDataFrame([([("da", [("x", 1), (None, None)]), ("en", [])],), ([("en", [("y", 2)])],)],
                               "languages array<struct<language:string,items:array<struct<a:string,b:int>>>>")
    assert sorted((tuple(r) for r in IO.nested_section(df, "da").collect()), key=str) == sorted([("x", 1), (None, None)], key=str)


def test_blank_lines_of_any_white_space_are_skipped(spark, tmp_dir):
    path = os.path.join(tmp_dir, "blank.jsonl")
    with open(path, "w") as f:
        f.write('{"a": 1}\n\t\n \n{"a": 2}\nbad\n')
    good, bad = IO.read_jsonl(spark, path, "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["bad"]


def test_reply_entities_and_shared_tags(spark):
    from gavel.operators.replies import parse_dict_reply, parse_task_results
    batches = spark.createDataFrame([("1", ["a"], ["a"], ["t"], "m"), ("2", ["b_1", "b_1"], ["b-1", "b.1"], ["t", "u"], "m")],
                                    "batch_id string, item_ids array<string>, original_ids array<string>, item_texts array<string>, model_name string")
    replies = spark.createDataFrame([("1", "<ida><o>4</o><reason>x &lt;y&gt; &amp;amp; z</reason></ida>"),
                                     ("2", "<idb_1><o>4</o></idb_1><idb_1><o>5</o></idb_1>")], "batch_id string, response string")
    got = {r.id: (r.output, r.reason) for r in parse_task_results(batches, replies).collect()}
    assert got == {"a": ("4", "x <y> &amp; z"), "b-1": (None, ""), "b.1": (None, "")}
    d = spark.createDataFrame([("{'a': 1, 'b': None,}",), ('{"x": True, "y": "None"}',), ("none",)], "r string")
    assert [r.m for r in d.select(parse_dict_reply("r").alias("m")).collect()] == [{"a": "1", "b": None}, {"x": "true", "y": "None"}, None]


def test_resume_by_sample_index_and_ordered_merge(spark):
    from gavel.operators import resume as RS
    items = spark.createDataFrame([("a", None), (None, 1), (None, 2), (None, None)], "id string, sample_idx int")
    done = RS.done_ids(spark.createDataFrame([("a", None, "x"), (None, 1, "y"), (None, 2, None)], "id string, sample_idx int, output string"))
    left = [tuple(r) for r in RS.pending_items(items, done).collect()]
    assert sorted(left, key=str) == sorted([(None, 2), (None, None)], key=str)
    prev = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("k", 0, None)], "key string, n int, out string")
    good, _ = RS.merge_previous(spark.createDataFrame([("k",)], "key string"), prev, "key", "out", ["n"])
    assert good.first().out == "early"
