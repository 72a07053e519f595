import json
import os

import pytest

from gavel.operators import pack as K
from gavel.operators import scorer as Y
from gavel.sources import io as IO
from gavel.streaming import incremental as ST


def test_read_jsonl_lenient_and_strict(spark, tmp_dir):
    p = os.path.join(tmp_dir, "in.jsonl")
    with open(p, "w") as f:
        f.write('{"id": "1-1", "s": "hej", "n": 3}\n\n{bad json\n{"id": 7, "s": null}\n{"id": "2"}\n"just a string"\n'
                '{"id": "3", "s": "x", "n": 1}')
    good, bad = IO.read_jsonl(spark, p, "id string, s string, n int")
    rows = {r.id: r for r in good.collect()}
    assert set(rows) == {"1-1", "7", "2", "3"}
    assert rows["7"].s is None and rows["7"].s__present is True
    assert rows["2"].s__present is False
    assert bad.count() == 2
    import pytest
    with pytest.raises(Exception):
        IO.read_jsonl(spark, p, "id string, s string, n int", strict=True)[0].collect()


def test_split_jsonl_counts_in_one_scan(spark, tmp_dir):
    p = os.path.join(tmp_dir, "in.jsonl")
    lines = ['{"id": "1", "n": 3}', "", "{bad", '{"id": null}', "  ", "[1]", '{"n": 4}']
    with open(p, "w") as f:
        f.write("\n".join(lines) + "\n")
    good, bad, counts = IO.split_jsonl(spark, p, "id string, n int", os.path.join(tmp_dir, "out"))
    assert counts == {"lines": 7, "good": 3, "bad": 2, "blank": 2}
    want, rest = IO.read_jsonl(spark, p, "id string, n int")
    assert good.columns == want.columns and sorted(map(str, good.collect())) == sorted(map(str, want.collect()))
    assert sorted(r.value for r in bad.collect()) == sorted(r.value for r in rest.collect()) == ["[1]", "{bad"]
    empty = os.path.join(tmp_dir, "empty.jsonl")
    open(empty, "w").close()
    good, bad, counts = IO.split_jsonl(spark, empty, "id string", os.path.join(tmp_dir, "none"))
    assert good.count() == bad.count() == 0 and counts == {"lines": 0, "good": 0, "bad": 0, "blank": 0}


def test_read_any_and_sinks(spark, tmp_dir):
    df = spark.createDataFrame([("a", None, "train"), ("b", 1, "test")], "k string, v int, split string")
    out = os.path.join(tmp_dir, "out")
    IO.write_jsonl(df, out, partition_by=["split"])
    text = "".join(open(os.path.join(out, "split=train", f)).read()
                   for f in os.listdir(os.path.join(out, "split=train")) if f.endswith(".json"))
    assert '"v":null' in text
    written, back = IO.verify_count(spark, df, os.path.join(tmp_dir, "v"))
    assert written == back == 2
    IO.write_table(df, os.path.join(tmp_dir, "t.tsv"), sep="\t")
    import pytest
    with pytest.raises(ValueError):
        IO.read_any(spark, os.path.join(tmp_dir, "x.xml"))


def test_nested_section(spark):
    df = spark.createDataFrame([([("da", [("p1",), ("p2",)]), ("en", [("q",)]), ("da", [("p3",)])],)],
                               "languages array<struct<language:string, items:array<struct<prompt:string>>>>")
    assert [r.prompt for r in IO.nested_section(df, "da").collect()] == ["p1", "p2"]
    assert IO.nested_section(df, "fi").count() == 0


def test_incremental_parse_is_idempotent(spark, tmp_dir):
    items = spark.createDataFrame([("a", "ta", 0), ("b", "tb", 1), ("c", "tc", 2)], "id string, text string, ord long")
    batches = K.batch_prompts(K.pack_batches(items, 2, 10000, "Rate."), "Rate.", "task", "m")
    rdir, res, ck = (os.path.join(tmp_dir, x) for x in ("replies", "results", "ck"))
    os.makedirs(rdir)
    with open(os.path.join(rdir, "r1.json"), "w") as f:
        f.write(json.dumps({"batch_id": "1", "response": "<ida><o>4</o><reason>ok</reason></ida>"}) + "\n")
    ST.start_incremental_parse(spark, rdir, batches, res, ck).awaitTermination()
    first = ST.latest_results(spark, res).collect()
    assert {(r.id, r.output) for r in first} == {("a", "4"), ("b", None)}
    with open(os.path.join(rdir, "r2.json"), "w") as f:
        f.write(json.dumps({"batch_id": "1", "response": "<ida><o>4</o></ida><idb><o>2</o><reason>r</reason></idb>"}) + "\n")
        f.write(json.dumps({"batch_id": "2", "response": "<idc><o>1</o><reason>r</reason></idc>"}) + "\n")
    ST.start_incremental_parse(spark, rdir, batches, res, ck).awaitTermination()
    n_before = spark.read.json(res).count()
    ST.start_incremental_parse(spark, rdir, batches, res, ck).awaitTermination()
    assert spark.read.json(res).count() == n_before  # nothing new: no rows added
    latest = {r.id: r.output for r in ST.latest_results(spark, res).collect()}
    assert latest == {"a": "4", "b": "2", "c": "1"}


def test_scorer_retries_and_errors(spark):
    df = spark.createDataFrame([("ok",), ("fail",), ("flaky",)], "prompt string")

    def fn(p):
        if p == "fail":
            raise RuntimeError("boom")
        if p == "flaky" and not os.path.exists("/tmp/gavel-test-flaky-" + str(os.getpid())):
            open("/tmp/gavel-test-flaky-" + str(os.getpid()), "w").close()
            raise RuntimeError("once")
        return p.upper()
    got = {r.prompt: (r.response, r.error is None, r.attempts)
           for r in Y.apply_scorer(df, fn, retries=3, wait_seconds=0, partitions=1).collect()}
    assert got["ok"] == ("OK", True, 1)
    assert got["fail"][0] is None and got["fail"][1] is False and got["fail"][2] == 3
    assert got["flaky"] == ("FLAKY", True, 2)
    rep = Y.score_with_reprompt(spark.createDataFrame([("x",)], "prompt string"),
                                lambda p: "5" if p.endswith("!") else "?",
                                parse=lambda r: r if r.isdigit() else None, rewrite=lambda p: p + "!",
                                passes=1, wait_seconds=0)
    r = rep.first()
    assert (r.parsed, r.passes_used, r.response) == ("5", 1, "5")


def test_reprompt_keeps_every_row_with_a_random_scorer(spark, tmp_dir):
    """A scorer that answers differently on each call: each id once, no call too many."""
    calls = os.path.join(tmp_dir, "calls")

    def fn(p):
        import random
        with open(calls, "a") as f:
            f.write("x\n")
        return random.choice(["7", "?"])

    df = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "id int, prompt string")
    out = Y.score_with_reprompt(df, fn, parse=lambda r: r if r.isdigit() else None, rewrite=lambda p: p + "!",
                                passes=2, wait_seconds=0, partitions=8).collect()
    assert sorted(r.id for r in out) == list(range(200))
    assert all((r.parsed is None) == (r.response == "?") for r in out)
    assert len(open(calls).readlines()) == sum(r.passes_used + 1 for r in out) <= 600


def test_stream_keeps_the_good_reply_of_a_batch(spark, tmp_dir):
    """A bad and a good reply for each batch, in one file and in two, in both orders."""
    batches = spark.createDataFrame([(str(i), [f"i{i}"], [f"i{i}"], ["t"], "m") for i in range(40)],
                                    "batch_id string, item_ids array<string>, original_ids array<string>, item_texts array<string>, model_name string")
    good = [json.dumps({"batch_id": str(i), "response": f"<idi{i}><o>{i % 5}</o></idi{i}>"}) for i in range(40)]
    bad = [json.dumps({"batch_id": str(i), "response": "no tags"}) for i in range(40)]
    for k, files in enumerate(([good + bad], [bad + good], [good, bad], [bad, good])):
        rdir, res, ck = (os.path.join(tmp_dir, f"{n}{k}") for n in ("r", "o", "c"))
        os.makedirs(rdir)
        for n, lines in enumerate(files):
            with open(os.path.join(rdir, f"{n}.json"), "w") as f:
                f.write("\n".join(lines) + "\n")
            ST.start_incremental_parse(spark, rdir, batches, res, ck).awaitTermination()
        latest = {r.id: r.output for r in ST.latest_results(spark, res).collect()}
        assert latest == {f"i{i}": str(i % 5) for i in range(40)}


def _wave(path, name, rows):
    with open(os.path.join(path, name), "w") as f:
        f.write("\n".join(json.dumps({"batch_id": b, "response": r}) for b, r in rows) + "\n")


def _batches(spark, n):
    return spark.createDataFrame([(str(i), [f"i{i}"], [f"i{i}"], [f"t{i}"], "m") for i in range(n)],
                                 "batch_id string, item_ids array<string>, original_ids array<string>, item_texts array<string>, model_name string")


def test_an_epoch_reads_its_own_files_only(spark, tmp_dir):
    """Ten files in ten epochs: the rows read follow the file, not what was finished before."""
    rdir, res, ck = (os.path.join(tmp_dir, x) for x in ("r", "o", "c"))
    os.makedirs(rdir)
    for k in range(10):
        _wave(rdir, f"{k}.json", [(str(i), f"<idi{i}><o>{k}</o></idi{i}>") for i in range(5 * k, 5 * k + 10)])
    q = ST.start_incremental_parse(spark, rdir, _batches(spark, 60), res, ck, max_files=1)
    q.awaitTermination()
    read = [p["numInputRows"] for p in map(lambda p: json.loads(p.json), q.recentProgress) if p["numInputRows"]]
    assert read == [10] * 10
    assert not [t for p in q.recentProgress for t in json.loads(p.json)["sources"] if "FileStreamSource" not in t["description"]]
    got = ST.results(spark, res).collect()
    assert sorted(r.id for r in got) == sorted(f"i{i}" for i in range(55))  # each id once, from one of its two files
    assert all(int(r.output) in (int(r.id[1:]) // 5 - 1, int(r.id[1:]) // 5) for r in got)
    state = json.loads(q.lastProgress.json)["stateOperators"][0]
    assert state["numRowsTotal"] >= 55


def test_open_items_are_offered_again_until_done(spark, tmp_dir):
    rdir, res, ck = (os.path.join(tmp_dir, x) for x in ("r", "o", "c"))
    os.makedirs(rdir)
    good = lambda i: (str(i), f"<idi{i}><o>5</o></idi{i}>")
    bad = lambda i: (str(i), "nothing")

    def wait(q, seen):
        import time
        for _ in range(120):
            if q.exception():
                raise q.exception()
            if os.path.exists(os.path.join(res, "_spark_metadata")) and seen({(r.id, r.event, r.tries) for r in ST.results(spark, res).collect()}):
                return
            time.sleep(0.5)
        raise AssertionError(sorted(map(tuple, ST.results(spark, res).collect()), key=str))

    _wave(rdir, "1.json", [good(0), bad(1), bad(2)])
    q = ST.start_incremental_parse(spark, rdir, _batches(spark, 4), res, ck, available_now=False, retry_seconds=0.1, max_tries=2, every="200 milliseconds")
    try:
        wait(q, lambda e: {("i1", "retry", 1), ("i2", "retry", 1)} <= e)
        assert {(r.id, r.input, r.tries) for r in ST.due_items(spark, res).collect()} == {("i1", "t1", 1), ("i2", "t2", 1)}
        _wave(rdir, "2.json", [good(1), bad(2), bad(0)])
        wait(q, lambda e: {("i1", "done", 2), ("i2", "open", 2)} <= e)
    finally:
        q.stop()
    events = {(r.id, r.event, r.tries) for r in ST.results(spark, res).collect()}
    assert events == {("i0", "done", 1), ("i1", "open", 1), ("i2", "open", 1), ("i1", "retry", 1), ("i2", "retry", 1), ("i1", "done", 2), ("i2", "open", 2)}
    assert ST.due_items(spark, res).collect() == []  # tried as often as it may be
    _wave(rdir, "3.json", [good(2), good(1)])  # a late better reply still counts, a second one doesn't
    ST.start_incremental_parse(spark, rdir, _batches(spark, 4), res, ck, retry_seconds=0.1, max_tries=2).awaitTermination()
    assert {r.id: r.output for r in ST.latest_results(spark, res).collect()} == {"i0": "5", "i1": "5", "i2": "5"}
    assert len([r for r in ST.results(spark, res).collect() if r.event == "done"]) == 3


def test_texts_stay_out_of_the_state_and_shuffles_go_with_the_epoch(spark, tmp_dir):
    """Open items' texts reach the events, also of a batch listed twice and of one id with two texts, but not the checkpoint."""
    import random
    import time
    draw = random.Random(1)
    text = lambda: "".join(chr(draw.randrange(0x4e00, 0x9fa5)) for _ in range(20_000))
    rows = [(str(i), [f"i{i}", f"n{i}"], [f"i{i}", f"n{i}"], [text(), None], "m") for i in range(20)] + [("20", ["i0"], ["i0"], [text()], "m")]
    batches = spark.createDataFrame(rows + rows[:3], "batch_id string, item_ids array<string>, original_ids array<string>, item_texts array<string>, model_name string")
    rdir, res, ck = (os.path.join(tmp_dir, x) for x in ("r", "o", "c"))
    os.makedirs(rdir)
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = shuffles()
    _wave(rdir, "1.json", [(str(i), "nothing") for i in range(20)])
    ST.start_incremental_parse(spark, rdir, batches, res, ck).awaitTermination()
    for _ in range(50):  # they are removed in the background
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before
    got = {r.id: r.input for r in ST.results(spark, res).collect()}
    assert got == {f"i{i}": rows[i][3][0] for i in range(20)} | {f"n{i}": None for i in range(20)}
    assert ST.results(spark, res).count() == 40
    held = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(ck) for f in fs)
    assert held < 20 * 60_000 / 2
    _wave(rdir, "2.json", [("20", "<idi0><o>3</o></idi0>"), ("1", "<idi1><o>2</o></idi1>")])
    ST.start_incremental_parse(spark, rdir, batches, res, ck).awaitTermination()
    latest = {r.id: (r.input, r.output) for r in ST.latest_results(spark, res).collect()}
    assert latest["i0"] == (rows[20][3][0], "3") and latest["i1"] == (rows[1][3][0], None) and len(latest) == 40


def test_finished_ids_are_forgotten_in_time(spark, tmp_dir):
    rdir, res, ck = (os.path.join(tmp_dir, x) for x in ("r", "o", "c"))
    os.makedirs(rdir)
    for k in range(2):
        _wave(rdir, f"{k}.json", [("0", f"<idi0><o>{k}</o></idi0>")])
        ST.start_incremental_parse(spark, rdir, _batches(spark, 1), res, ck, forget_seconds=0.001).awaitTermination()
    assert sorted(r.output for r in ST.results(spark, res).collect()) == ["0", "1"]


def test_calls_under_way_and_their_limit(spark):
    """Twenty slow calls of one partition take the time of one; calls that hang or raise lose no row."""
    import time

    def slow(p):
        import time
        if p == "hang":
            time.sleep(30)
        if p == "bad":
            raise TimeoutError("its own")
        time.sleep(1.5)
        return p.upper()

    df = spark.createDataFrame([(i, f"p{i}") for i in range(20)], "id int, prompt string")
    df.coalesce(1).count()
    t = time.time()
    got = Y.apply_scorer(df, slow, wait_seconds=0, partitions=1, in_flight=20).collect()
    assert time.time() - t < 15 and [r.id for r in got] == sorted(r.id for r in got) or {r.id for r in got} == set(range(20))
    assert {(r.id, r.response) for r in got} == {(i, f"P{i}") for i in range(20)}
    df = spark.createDataFrame([(i, ["ok", "hang", "bad"][i % 3]) for i in range(9)], "id int, prompt string")
    t = time.time()
    got = {r.id: r for r in Y.apply_scorer(df, slow, retries=2, wait_seconds=0, partitions=1, in_flight=9, timeout_seconds=3).collect()}
    assert time.time() - t < 25 and set(got) == set(range(9))
    assert all(got[i].response == "OK" and got[i].attempts == 1 for i in (0, 3, 6))
    assert all(got[i].error == "TimeoutError: no answer within 3 s" and got[i].attempts == 2 for i in (1, 4, 7))
    assert all(got[i].error == "TimeoutError: its own" for i in (2, 5, 8))


def test_rerun_of_a_failed_append_has_each_id_once(spark, tmp_dir):
    from pyspark.sql import functions as F
    out = os.path.join(tmp_dir, "results")
    IO.append_results(spark.range(5).selectExpr("'run0' AS run", "0 AS batch", "id", "cast(NULL AS string) AS output"), out, ["run", "batch"])
    work = spark.range(0, 100, 1, 4).selectExpr("'run1' AS run", "id div 10 AS batch", "id", "cast(id AS string) AS output")
    broken = work.withColumn("output", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("output")))
    with pytest.raises(Exception, match="lost"):
        IO.append_results(broken, out, ["run", "batch"])
    for _ in range(2):  # the rerun, and one more
        IO.append_results(work, out, ["run", "batch"])
    back = spark.read.json(out)
    assert sorted(r.id for r in back.where("run = 'run1'").collect()) == list(range(100))
    assert back.where("run = 'run0'").count() == 5
