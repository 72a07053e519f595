import random


from gavel.operators import pack as K
from gavel.operators import replies as RP


def ref_pack(items, n, max_tokens, instr_tokens):
    """The reference's greedy packing, written plainly for the test."""
    out = []
    for b in range(0, len(items), n):
        batch = items[b:b + n]
        toks = [(len(t) + 16) // 4 + 50 for _, t in batch]
        if instr_tokens + sum(toks) > max_tokens:
            avail = max_tokens - instr_tokens - 300
            chunks, cur, ct = [], [], 0
            for (i, t), k in zip(batch, toks):
                if ct + k > avail and cur:
                    chunks.append(cur)
                    cur, ct = [], 0
                cur.append(i)
                ct += k
            if cur:
                chunks.append(cur)
        else:
            chunks = [[i for i, _ in batch]]
        bn = b // n + 1
        for ci, ch in enumerate(chunks):
            bid = str(bn) if len(chunks) == 1 else f"{bn}-{ci + 1}"
            for p, i in enumerate(ch):
                out.append((i, bid, p + 1, len(chunks) > 1))
    return sorted(out)


def test_packing_matches_reference_algorithm(spark):
    rnd = random.Random(7)
    for max_tokens, n in [(1500, 5), (400, 4), (100, 3), (100000, 7)]:
        items = [(f"{k:03d}", "x" * rnd.choice([10, 200, 800, 3000])) for k in range(23)]
        df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(items)], "id string, text string, ord long")
        instr = "y" * 120
        got = K.pack_batches(df, n, max_tokens, instr).select("id", "batch_id", "position", "was_split").collect()
        assert sorted(tuple(r) for r in got) == ref_pack(items, n, max_tokens, len(instr) // 4)


def test_packing_a_batch_of_many_items(spark):
    """One batch of 30,000 items, over several Arrow batches, some items larger than a chunk."""
    rnd = random.Random(8)
    items = [(f"{k:06d}", "x" * rnd.choice([1, 30, 400, 9000])) for k in range(30_000)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(items)], "id string, text string, ord long")
    got = K.pack_batches(df, 30_000, 2000, "y" * 40).select("id", "batch_id", "position", "was_split").collect()
    assert sorted(tuple(r) for r in got) == ref_pack(items, 30_000, 2000, 10)


def test_prompts_and_collisions(spark):
    df = spark.createDataFrame([("1-2", "a", 0), ("1_2", "b", 1), ("3.4", "c", 2)], "id string, text string, ord long")
    packed = K.pack_batches(df, 5, 10000, "Rate.")
    b = K.batch_prompts(packed, "Rate.", "task").first()
    assert b.prompt.startswith("Rate.\n\n<id1_2>a</id1_2>\n<id1_2>b</id1_2>\n<id3_4>c</id3_4>\n")
    assert b.item_ids == ["1_2", "1_2", "3_4"] and b.original_ids == ["1-2", "1_2", "3.4"]
    c = K.tag_collisions(df).first()
    assert (c.n_ids, c.first_id, c.last_id) == (2, "1-2", "1_2")


def test_task_reply_parsing(spark):
    batches = spark.createDataFrame([
        ("1", ["a", "b"], ["a", "b"], ["ta", "tb"], "m"),
        ("2", ["c", "d"], ["c", "d"], ["tc", "td"], "m"),
        ("3", ["e"], ["e"], ["te"], "m"),
        ("4", ["f"], ["f"], ["tf"], "m"),
    ], "batch_id string, item_ids array<string>, original_ids array<string>, item_texts array<string>, model_name string")
    long_reason = "r" * 600
    replies = spark.createDataFrame([
        ("1", f"<ida><o> 4 </o><reason>{long_reason}</reason></ida>\n<idb><o>2</o></idb>"),
        ("2", "<idc><o>3</o><reason>ok</reason></idc>\n<ID_D><o>1</o></ID_D><IDd><O>5</O><REASON>up</REASON></IDd>"),
        ("3", ""),
    ], "batch_id string, response string")
    got = {r.id: (r.output, r.reason) for r in RP.parse_task_results(batches, replies).collect()}
    assert got["a"] == ("4", "r" * 500 + "...")
    assert got["b"] == ("2", "No reason provided")
    # batch 2: d has no structured block -> strict, case-insensitive form for all ids
    assert got["c"] == ("3", "ok") and got["d"] == ("5", "up")
    assert got["e"] == (None, "")
    assert got["f"] == (None, "Error during processing")


def test_score_reply_parsing(spark):
    text = "x" * 250
    reply = ("<id1-1><score>4</score></id1-1>\n**Rationale:** **Good** flow\n"
             "<ID1-2><SCORE>3</SCORE></ID1-2>\n" + text + "\n"
             "<id1-3>5</id1-3>\n<id1-4><score>2</score>\n<id1-5><score>6</score></id1-5>\n")
    members = spark.createDataFrame([("1", f"1-{i}") for i in range(1, 7)] + [("2", "2-1")],
                                    "batch_id string, response_id string")
    replies = spark.createDataFrame([("1", reply)], "batch_id string, response string")
    got = {r.response_id: (r.fluency_score, r.reason) for r in RP.parse_score_results(members, replies).collect()}
    assert got["1-1"] == (4, "Good flow")
    assert got["1-2"] == (3, "x" * 200 + "...")
    assert got["1-3"] == (5, "No rationale")
    assert got["1-4"] == (2, "No rationale")
    assert got["1-5"] == (None, "")
    assert got["1-6"] == (None, "")
    assert got["2-1"] == (None, "Error during processing")


def test_dict_reply(spark):
    df = spark.createDataFrame([("```json\n{0: 'A', 1: 'B'}\n```",), ("noise {'k': 'v'} tail",), ("none",)], "r string")
    got = [r[0] for r in df.select(RP.parse_dict_reply("r")).collect()]
    assert got[0] == {"0": "A", "1": "B"} and got[1] == {"k": "v"} and got[2] is None


def test_resume_ops(spark):
    from gavel.operators import resume as RS
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    done = RS.done_ids(spark.createDataFrame([("a", "4"), ("b", None)], "id string, output string"))
    assert sorted(r.id for r in RS.pending_items(items, done).collect()) == ["b", "c"]
    batches = spark.createDataFrame([("1", ["a"]), ("2", ["a", "c"])], "batch_id string, original_ids array<string>")
    assert [r.batch_id for r in RS.pending_batches(batches, done).collect()] == ["2"]
    prev = spark.createDataFrame([("a", "x"), ("b", None)], "k string, res string")
    d, t = RS.merge_previous(spark.createDataFrame([("a",), ("b",)], "k string"), prev, "k", "res")
    assert [r.k for r in d.collect()] == ["a"] and [r.k for r in t.collect()] == ["b"]


def task_by_patterns(reply, ids):
    """The reference's rule, one search per id: first block, first inner tags, strict form as a fallback."""
    import re
    plain = lambda x: re.sub("<[^>]*>", "", x)
    found = {}
    for i in ids:
        m = re.search(f"(?s)<id{re.escape(i)}>(.*?)</id{re.escape(i)}>", reply)
        o = m and re.search("(?s)<o>(.*?)</o>", m[1])
        if o:
            r = re.search("(?s)<reason>(.*?)</reason>", m[1])
            found[i] = (plain(o[1]).strip(), plain(r[1]).strip() if r else "No reason provided")
    if len(found) == len(ids) and len(set(ids)) == len(ids):
        return found
    out = {}
    for i in ids:
        m = re.search(f"(?is)<id{re.escape(i)}><o>([^<]+)</o><reason>(.*?)</reason></id{re.escape(i)}>", reply)
        out[i] = (m[1].strip(), m[2].strip()) if m else (None, "")
    return out


def score_by_patterns(reply, i):
    import re
    q = re.escape(i)
    m = re.search(f"(?is)<id{q}><score>([1-5])</score></id{q}>(.*)", reply)
    if m:
        rest = re.sub(r"(?is)<id\d+(?:-\d+)*><score>.*", "", m[2]).strip()
        rest = re.sub(r"(?i)^\*\*Rationale:\*\*\s*", "", rest)
        rest = re.sub(r"\*\*(.*?)\*\*", r"\1", rest).strip()
        return int(m[1]), rest[:200] + "..." if len(rest) > 200 else rest
    m = re.search(f"(?i)<id{q}><score>([1-5])</score>", reply) or re.search(f"(?i)<id{q}>([1-5])</id[^>]*>", reply)
    return (int(m[1]), "No rationale") if m else (None, "")


def test_task_replies_against_one_search_per_id(spark):
    rng = random.Random(11)
    ids = ["a", "b", "a_1", "10", "1"]
    bits = [f"<{s}id{i}>" for i in ids for s in ("", "/")] + ["<o>3</o>", "<o>", "</o>", "<reason>why <b>x</b></reason>", "<reason></reason>", "text", "\n", "<", ">", "<ID10><O>4</O><REASON>R</REASON></ID10>"]
    whole = [f"<id{i}><o>{k}</o><reason>r{k}</reason></id{i}>" for k, i in enumerate(ids)]
    replies = []
    for k in range(300):
        parts = [rng.choice(bits) for _ in range(rng.randint(0, 14))]
        for w in whole:
            if rng.random() < 0.9:
                parts.insert(rng.randint(0, len(parts)), w)
        replies.append("".join(parts))
    batches = spark.createDataFrame([(str(k), ids, [f"{k}/{i}" for i in ids], ids, "m") for k in range(300)],
                                    "batch_id string, item_ids array<string>, original_ids array<string>, item_texts array<string>, model_name string")
    got = {r.id: (r.output, r.reason) for r in RP.parse_task_results(batches, spark.createDataFrame(
        [(str(k), x) for k, x in enumerate(replies)], "batch_id string, response string")).collect()}
    for k, x in enumerate(replies):
        want = task_by_patterns(x, ids)
        assert {i: got[f"{k}/{i}"] for i in ids} == want, x
    assert len({v for v in got.values()}) > 12


def test_score_replies_against_one_search_per_id(spark):
    rng = random.Random(12)
    ids = ["1-1", "1-2", "1-10", "2", "x"]
    bits = [f"<id{i}>{rest}" for i in ids for rest in ("<score>4</score>", f"<score>2</score></id{i}>", "3</id>", f"5</id{i}>", "<score>6</score>", "")]
    bits += ["**Rationale:** fine", "**bold** text", "\n", "word ", "<score>1</score>", "<ID1-1><SCORE>5</SCORE></ID1-1>", "y" * 210, "</id2>"]
    replies = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [""]
    members = spark.createDataFrame([(str(k), i) for k in range(len(replies)) for i in ids], "batch_id string, response_id string")
    got = {(r.batch_id, r.response_id): (r.fluency_score, r.reason) for r in RP.parse_score_results(members, spark.createDataFrame(
        [(str(k), x) for k, x in enumerate(replies)], "batch_id string, response string")).collect()}
    for k, x in enumerate(replies):
        for i in ids:
            assert got[str(k), i] == score_by_patterns(x, i), (i, x)


def test_a_reply_of_a_thousand_ids(spark):
    """Long replies with nested blocks: every id is found, in time that follows the reply's length."""
    import time
    ids = [f"n{k}" for k in range(1000)]
    reply = "<idouter>" + "".join(f"<id{i}><o>{k % 5}</o><reason>{'r' * 300}</reason></id{i}>\n" for k, i in enumerate(ids)) + "</idouter>"
    schema = "batch_id string, item_ids array<string>, original_ids array<string>, item_texts array<string>, model_name string"
    batches = spark.createDataFrame([("1", ids + ["outer"], ids + ["outer"], ids + ["outer"], "m")], schema)
    t = time.time()
    got = {r.id: r.output for r in RP.parse_task_results(batches, spark.createDataFrame([("1", reply)], "batch_id string, response string")).collect()}
    assert time.time() - t < 20
    assert all(got[i] == str(k % 5) for k, i in enumerate(ids)) and got["outer"] == "0"
    scores = "".join(f"<id1-{k}><score>{1 + k % 5}</score></id1-{k}>\nreason {k}\n" for k in range(1000))
    members = spark.createDataFrame([("1", f"1-{k}") for k in range(1000)], "batch_id string, response_id string")
    t = time.time()
    rows = RP.parse_score_results(members, spark.createDataFrame([("1", scores)], "batch_id string, response string")).collect()
    assert time.time() - t < 20 and all((r.fluency_score, r.reason) == (1 + int(r.response_id[2:]) % 5, f"reason {r.response_id[2:]}") for r in rows)


def test_extract_items_keeps_one_text_a_place_and_deals_it_once(spark):
    rows = [("a", "x", 1), ("a", " x ", 1), ("a", "x", 5), ("a", "y", 5), ("b", "x", 2), ("b", "  ", 3), (None, "x", 4), ("c", None, 6), ("d", "z", None)]
    df = spark.createDataFrame(rows, "id string, text string, ord long")
    got = K.extract_items(df, "id", "text", "ord")
    assert sorted(tuple(r) for r in got.collect()) == [("a", "x", 1), ("a", "y", 5), ("b", "x", 2)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        plan = K.extract_items(df, "id", "text", "ord")._jdf.queryExecution().executedPlan()
        dealt = [x for x in plan.toString().split("\n") if "Exchange hashpartitioning" in x]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(dealt) == 3  # hashes by text, hashes by place, texts by place
