"""More registered queries: messages, translation pairs, resume by sample index, dict replies,
per-model joins and correlations, and the smaller helpers. Importing it completes the catalog.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions import votes as V
from ..functions.templates import render_sql
from ..operators import chat as C
from ..operators import corpus as CP
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import replies as RP
from ..operators import resume as RS
from ..operators.ordering import seeded_shuffle
from ..session import SHUFFLE_CLEANUP, drop_folder, ensure_checkpoint_dir, settings
from ..streaming import incremental as ST
from .catalog import (JUDGE_SQL, ORACLE, QUERIES, R9, REPLY_SQL, SEED, VOTE_SQL, ab_rewrite_sql, logprob_votes, query,
                      scored_documents, task_batches, task_replies)
from .sqltext import WS_SQL, hexval_sql, md5_key_sql, sql_literal, strip_sql
from .tables import DOC_GROUP_SQL, HUMAN_SCORE_SQL, human_score, table

__all__ = ["QUERIES", "ORACLE"]


# --- conversations as messages (X23, X26, X39, A25) ------------------------------------
# Phrases of the rewrite rules in mixed case; a hash of the turn picks one.
PHRASES = ["Answer 1 OR 2 now", "answer A oR 2 please", "Select 1 oR 2 please", "Reply (1 oR 2) ok", "OPTION 1 and option 2",
           "sentence 1: x", "nothing here", "1) first, 2. second"]
ANSWERS = ["1", " 2 ", "B", "Both"]


def conversation_messages(spark, sf_dir) -> DataFrame:
    """One row a conversation: its turns in order as (role, content); no messages where all texts are null."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    digit = F.conv(F.substring(F.md5(F.concat_ws("|", "conv_id", "turn")), 1, 1), 16, 10).cast("int")
    phrase = F.element_at(F.array(*[F.lit(x) for x in PHRASES]), digit % len(PHRASES) + 1)
    answer = F.element_at(F.array(*[F.lit(x) for x in ANSWERS]), digit % len(ANSWERS) + 1)
    content = (F.when(F.col("role") == "user", F.concat("text", F.lit("\n"), phrase))
                .when(F.col("role") == "assistant", answer).otherwise(F.col("text")))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", content.alias("content"))))  # a conversation's turns
    got = c.groupBy("conv_id").agg(turns.alias("_t"))
    every = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return every.join(got, "conv_id", "left").select(
        "conv_id", F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


_PHRASE_SQL = "[" + ", ".join(sql_literal(x) for x in PHRASES) + "]"
_ANSWER_SQL = "[" + ", ".join(sql_literal(x) for x in ANSWERS) + "]"
_DIGIT_SQL = hexval_sql("substr(md5(concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))), 1, 1)")
MESSAGE_SQL = f"""WITH m AS (
  SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || chr(10) || ({_PHRASE_SQL})[{_DIGIT_SQL} % {len(PHRASES)} + 1]
                             WHEN role = 'assistant' THEN ({_ANSWER_SQL})[{_DIGIT_SQL} % {len(ANSWERS)} + 1] ELSE text END AS content
  FROM conversations WHERE text IS NOT NULL),
n AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, content) - 1 AS pos, role, content,
         CASE WHEN content = '' THEN content WHEN role = 'user' THEN {ab_rewrite_sql('content')}
              WHEN role = 'assistant' THEN CASE WHEN {strip_sql('content')} = '1' THEN 'A' WHEN {strip_sql('content')} = '2' THEN 'B'
                WHEN {strip_sql('content')} IN ('A', 'B') THEN {strip_sql('content')} ELSE content END
              ELSE content END AS new FROM m)
"""


@query("message_rewrite", MESSAGE_SQL + "SELECT conv_id, CAST(pos AS INTEGER) AS pos, role, new AS content FROM n")
def q_message_rewrite(spark, sf_dir):
    out = C.rewrite_records(conversation_messages(spark, sf_dir))
    return out.select("conv_id", F.posexplode("messages").alias("pos", "m")).select("conv_id", "pos", "m.role", "m.content")


@query("message_counters", MESSAGE_SQL + """, per AS (
  SELECT conv_id, bool_or(role = 'user' AND content <> new) AS u, bool_or(role = 'assistant' AND content <> new) AS a FROM n GROUP BY 1)
SELECT (SELECT count(DISTINCT conv_id) FROM conversations) AS n_records, count(*) FILTER (WHERE u) AS user_conversions,
       count(*) FILTER (WHERE a) AS assistant_conversions, (SELECT count(DISTINCT conv_id) FROM conversations) - count(*) AS errors FROM per""")
def q_message_counters(spark, sf_dir):
    return C.conversion_counters(C.rewrite_records(conversation_messages(spark, sf_dir)))


@query("message_text", """SELECT c.conv_id, coalesce((SELECT arg_min(text, turn) FROM conversations t
  WHERE t.conv_id = c.conv_id AND t.role = 'user' AND t.text IS NOT NULL), 'prompt ' || CAST(c.conv_id AS VARCHAR)) AS text
FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE c.conv_id IS NOT NULL""")
def q_message_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    users = c.where("role = 'user' and text is not null").groupBy("conv_id").agg(
        F.array(F.struct(F.min_by("text", "turn").alias("content"))).alias("messages"))
    rows = c.select("conv_id").distinct().join(users, "conv_id", "left").withColumn(
        "prompt", F.concat(F.lit("prompt "), F.col("conv_id").cast("string")))
    return rows.select("conv_id", TX.message_text("messages", "prompt").alias("text")).where("text is not null")


@query("message_label", f"""SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality END AS label FROM labels""")
def q_message_label(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    answer = F.when(F.col("toxic") == 1, "none").otherwise(F.concat(F.lit(" "), F.col("quality").cast("string"), F.lit("\n")))
    m = lab.select("doc_id", F.array(msg("user", F.lit("x")), msg("assistant", answer)).alias("messages"))
    return m.select("doc_id", TX.message_label("messages").cast("long").alias("label"))


@query("prev_next_turn", f"""SELECT conv_id, CAST(pos AS INTEGER) AS pos, lag(t) OVER w AS prev_sentence, t AS sentence, lead(t) OVER w AS next_sentence
FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS pos, text AS t FROM conversations WHERE text IS NOT NULL)
WINDOW w AS (PARTITION BY conv_id ORDER BY pos)""")
def q_prev_next_turn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text is not null")
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    lines = turns.select("conv_id", F.transform("_t", lambda t: t["text"]).alias("lines"))
    return CP.sentences_with_context(lines, "conv_id", "lines").select("conv_id", "pos", "prev_sentence", "sentence", "next_sentence")


# --- translation pairs (J4, X22, F2, F4, F5) ---------------------------------------------
_ENG_SQL = "CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE 'Topic ' || CAST(doc_id % 3 AS VARCHAR) END"
_T0, _T1 = (render_sql(t, {"sentence_a": "sa", "sentence_b": "sb", "english_sentence": "eng"}) for t in P.TRANSLATION_PAIR_TEMPLATES)


@query("translation_pairs", f"""WITH items AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, {DOC_GROUP_SQL} AS g, {strip_sql('text')} AS s,
         CAST({HUMAN_SCORE_SQL} AS DOUBLE) AS score, {strip_sql(_ENG_SQL)} AS eng
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND length({strip_sql('text')}) >= 3),
p AS (
  SELECT a.g, a.eng, CASE WHEN a.score > b.score THEN a.id ELSE b.id END AS better_id, CASE WHEN a.score > b.score THEN b.id ELSE a.id END AS worse_id,
         CASE WHEN a.score > b.score THEN a.s ELSE b.s END AS bs, CASE WHEN a.score > b.score THEN b.s ELSE a.s END AS ws,
         {md5_key_sql('a.id', 'b.id', seed=SEED)} AS h
  FROM items a JOIN items b ON a.g = b.g AND a.eng = b.eng AND a.eng <> '' AND a.ord < b.ord AND abs(a.score - b.score) >= 2.0),
q AS (SELECT *, substr(h, 1, 1) < '8' AS a_first, {hexval_sql('substr(h, 2, 1)')} % 2 AS tix FROM p),
r AS (SELECT *, CASE WHEN a_first THEN bs ELSE ws END AS sa, CASE WHEN a_first THEN ws ELSE bs END AS sb FROM q),
t AS (SELECT *, trim(CASE WHEN tix = 0 THEN {_T0} ELSE {_T1} END, {WS_SQL}) AS prompt FROM r)
SELECT better_id, worse_id, prompt, CASE WHEN tix = 0 THEN (CASE WHEN a_first THEN 'A' ELSE 'B' END) ELSE (CASE WHEN a_first THEN '1' ELSE '2' END) END AS chosen,
       CASE WHEN tix = 0 THEN (CASE WHEN a_first THEN 'B' ELSE 'A' END) ELSE (CASE WHEN a_first THEN '2' ELSE '1' END) END AS rejected, true AS valid
FROM t WHERE length(prompt) >= 50""")
def q_translation_pairs(spark, sf_dir):
    d = scored_documents(spark, sf_dir)
    eng = F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.lit("Topic "), (F.col("doc_id") % 3).cast("string")))
    items, _ = P.prepare_items(d.withColumn("eng", eng), "doc_id", "text", "human_score", order_col="doc_id", english_col="eng", group_col="grp")
    pairs = P.as_messages(P.preference_pairs(items, min_diff=2.0, seed=SEED, translation=True))
    return pairs.select("better_id", "worse_id", "prompt", F.col("chosen")[1]["content"].alias("chosen"),
                        F.col("rejected")[1]["content"].alias("rejected"), P.valid_pair_record().alias("valid"))


# --- pairs of large groups (J3): score bands in place of all pairs -----------------------------
@query("large_group_pairs", f"""WITH items AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, lang AS g, n_chars / 1000.0::DOUBLE AS score FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL AND length({strip_sql('text')}) >= 3 AND n_chars IS NOT NULL)
SELECT a.g AS group_key, CASE WHEN a.score > b.score THEN a.id ELSE b.id END AS better_id,
       CASE WHEN a.score > b.score THEN b.id ELSE a.id END AS worse_id, greatest(a.score, b.score) AS better_score
FROM items a JOIN items b ON a.g = b.g AND a.ord < b.ord AND abs(a.score - b.score) >= 60.0""")
def q_large_group_pairs(spark, sf_dir):
    """All documents of a language are one group; its length in thousands of characters is the score."""
    d = table(spark, sf_dir, "documents").withColumn("score", F.col("n_chars") / 1000.0)
    items, _ = P.prepare_items(d, "doc_id", "text", "score", order_col="doc_id", group_col="lang")
    return P.candidate_pairs(items, min_diff=60.0, block_rows=128).select("group_key", "better_id", "worse_id", "better_score")


# --- the reply stream (ST1) -------------------------------------------------------------------
@query("incremental_results", REPLY_SQL + "SELECT id, input, output, reason FROM results WHERE reason <> 'Error during processing'")
def q_incremental_results(spark, sf_dir):
    """Replies arrive in two files; in the first every other batch's reply is empty. The stream keeps the good ones.
    Batches are packed once and stored; shuffle files and stored tables go as soon as they are read."""
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gavel-stream/{uuid.uuid4().hex}"
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        batches = task_batches(spark, sf_dir).select("batch_id", "item_ids", "original_ids", "item_texts", "model_name")
        batches.write.parquet(f"{at}/batches", compression="zstd")
    batches = spark.read.schema(batches.schema).parquet(f"{at}/batches")
    replies = task_replies(spark, sf_dir, batches)
    blank = F.substring(F.md5("batch_id"), 2, 1) < "8"
    first = replies.withColumn("response", F.when(blank, "").otherwise(F.col("response")))
    for k, wave in enumerate((first, replies.where(blank)), 1):
        wave.write.json(f"{at}/replies/{k}", compression="gzip")
        ST.start_incremental_parse(spark, f"{at}/replies/*", batches, f"{at}/results", f"{at}/checkpoint").awaitTermination()
        drop_folder(spark, f"{at}/replies/{k}")
    drop_folder(spark, f"{at}/batches")
    return ST.latest_results(spark, f"{at}/results").select("id", "input", "output", "reason")


# --- resume by sample index (J1) -----------------------------------------------------------
@query("resume_by_sample_idx", """SELECT doc_id FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)""")
def q_resume_by_sample_idx(spark, sf_dir):
    """Every third row has no id and is known by its sample index; toxic labels count as unanswered."""
    no_id = F.col("doc_id") % 3 == 0
    key = [F.when(~no_id, F.concat(F.lit("d"), F.col("doc_id").cast("string"))).alias("id"), F.when(no_id, F.col("doc_id")).alias("sample_idx")]
    results = table(spark, sf_dir, "labels").select(*key, F.when(F.col("toxic") == 0, F.col("quality")).alias("output"))
    items = table(spark, sf_dir, "documents").select("doc_id", *key)
    return RS.pending_items(items, RS.done_ids(results)).select("doc_id")


# --- dict replies (X13) ---------------------------------------------------------------------
@query("dict_replies", """SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE CAST(quality + 1 AS VARCHAR) END AS score,
  CASE doc_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'it is' WHEN 2 THEN NULL WHEN 3 THEN 'true' WHEN 4 THEN 'last' END AS note FROM labels""")
def q_dict_replies(spark, sf_dir):
    s = (F.col("quality") + 1).cast("string")
    forms = [('```json\n{"score": ', ', "note": "ok"}\n```'), ("{'score': ", ", 'note': 'it is',}"), ('Here: {score: ', ", note: None}"),
             ('{"score": ', ', "note": True , }'), ('x {"score": ', ', "note": "last"} and {"score": 9}'), ("no dict ", "")]
    reply = None
    for i, (a, b) in enumerate(forms):
        r = F.concat(F.lit(a), s, F.lit(b))
        reply = F.when(F.col("doc_id") % 6 == i, r) if reply is None else reply.when(F.col("doc_id") % 6 == i, r)
    d = table(spark, sf_dir, "labels").select("doc_id", RP.parse_dict_reply(reply).alias("m"))
    return d.select("doc_id", F.try_element_at("m", F.lit("score")).alias("score"), F.try_element_at("m", F.lit("note")).alias("note"))


# --- evaluation helpers (F8, F11, F12, F13, F15, J7, K4, U2, X17, X41, A8, A9, A14) ---------
@query("evaluable_counts", """SELECT count(*) FILTER (WHERE ok) AS processed, count(*) FILTER (WHERE NOT ok) AS skipped FROM (
  SELECT (CAST(embedding[1] AS DOUBLE) > 0.1 OR CAST(embedding[8] AS DOUBLE) > 0.15) AND label % 4 <> 1 AS ok FROM embeddings)""")
def q_evaluable_counts(spark, sf_dir):
    e = lambda i: F.col("embedding")[i].cast("double")
    df = table(spark, sf_dir, "embeddings").select(
        F.map_filter(F.create_map(F.lit("A"), e(0)), lambda k, v: v > 0.1).alias("top"),
        F.when(e(7) > 0.15, "A").alias("stored"), F.when(F.col("label") % 4 != 1, "B").alias("answer"))
    return M.evaluable(df, "top", "answer", "stored")[1]


def judged(spark, sf_dir) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source"), table(spark, sf_dir, "labels")
    j = (F.lit(1) + (F.col("doc_id") * 7 + F.col("n_chars") + (1 - F.col("quality")) * (1 + F.col("toxic"))) % 5).cast("int")
    return d.join(lab, "doc_id").select("doc_id", "source", human_score().alias("human"), j.alias("judge"), "quality", "toxic")


JUDGED_SQL = f"""WITH sc AS (
  SELECT d.doc_id, d.source, {HUMAN_SCORE_SQL.replace('doc_id', 'd.doc_id').replace('n_chars', 'd.n_chars')} AS human,
         {JUDGE_SQL.replace('doc_id', 'd.doc_id').replace('n_chars', 'd.n_chars')} AS judge, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


@query("score_subsets", JUDGED_SQL + """SELECT subset, doc_id FROM (
  SELECT 'imperfect' AS subset, doc_id FROM sc WHERE human <> 5 UNION ALL SELECT 'equal', doc_id FROM sc WHERE human = 3
  UNION ALL SELECT 'parsed', doc_id FROM sc WHERE quality <> 0 UNION ALL SELECT 'complete', doc_id FROM sc WHERE toxic = 0)""")
def q_score_subsets(spark, sf_dir):
    d = judged(spark, sf_dir)
    parts = [(n, M.score_subset(d, "human" if n != "parsed" else "quality", n)) for n in ("imperfect", "equal", "parsed")]
    parts.append(("complete", M.drop_missing(d.withColumn("derived", F.when(F.col("toxic") == 0, F.col("judge"))), ["derived", "human"])))
    return M.union_long([p.select(F.lit(n).alias("subset"), "doc_id") for n, p in parts])


@query("columns_by_suffix", JUDGED_SQL + "SELECT human AS m1_score, judge AS m2_score, toxic AS m1_pairwise FROM sc")
def q_columns_by_suffix(spark, sf_dir):
    d = judged(spark, sf_dir).select("doc_id", F.col("human").alias("m1_score"), F.col("judge").alias("m2_score"),
                                     F.col("toxic").alias("m1_pairwise"), F.col("source").alias("score_source"))
    return M.columns_by_suffix(d, ["_score", "_pairwise"])


@query("score_change", JUDGED_SQL + """SELECT doc_id, CASE WHEN judge > human THEN 'better' WHEN judge < human THEN 'worse' ELSE 'equal' END AS change FROM sc""")
def q_score_change(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", V.compare_scores("judge", "human").alias("change"))


@query("model_columns", JUDGED_SQL + """SELECT d.doc_id, sc.human AS m1, CASE WHEN sc.toxic = 0 THEN sc.judge END AS m2, CAST(NULL AS INTEGER) AS m3
FROM documents d LEFT JOIN sc ON d.doc_id = sc.doc_id""")
def q_model_columns(spark, sf_dir):
    d = judged(spark, sf_dir)
    long = M.union_long([d.select("doc_id", F.lit("m1").alias("model"), F.col("human").alias("value")),
                         d.where("toxic = 0").select("doc_id", F.lit("m2").alias("model"), F.col("judge").alias("value"))])
    return M.attach_model_column(table(spark, sf_dir, "documents").select("doc_id"), long, "doc_id", "model", ["m1", "m2", "m3"], "value")


@query("union_models", JUDGED_SQL + """SELECT 'm1' AS model, doc_id, human AS value, NULL AS note FROM sc
UNION ALL SELECT 'm2', doc_id, judge, CASE WHEN toxic = 1 THEN 'toxic' END FROM sc""")
def q_union_models(spark, sf_dir):
    d = judged(spark, sf_dir)
    return M.union_long([d.select(F.lit("m1").alias("model"), "doc_id", F.col("human").alias("value")),
                         d.select("doc_id", F.col("judge").alias("value"), F.when(F.col("toxic") == 1, "toxic").alias("note"),
                                  F.lit("m2").alias("model"))])


@query("metrics_row", JUDGED_SQL + """, c AS (SELECT g.v AS a, h.v AS p, (SELECT count(*) FROM sc WHERE human = g.v AND judge = h.v) AS n FROM range(1, 6) g(v), range(1, 6) h(v)),
m AS (SELECT '[' || string_agg(r, ',' ORDER BY a) || ']' AS j FROM (SELECT a, '[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY p) || ']' AS r FROM c GROUP BY a))
SELECT (SELECT count(*) FROM sc) AS n, (SELECT round(avg(abs(judge - human)), 9) FROM sc) AS mae, j AS confusion_matrix FROM m""")
def q_metrics_row(spark, sf_dir):
    d = judged(spark, sf_dir)
    labels = [1, 2, 3, 4, 5]
    row = M.metrics_row(M.confusion(d, "human", "judge", labels), M.regression_metrics(d, "human", "judge").select("n", R9(F.col("mae")).alias("mae")), labels)
    return row.select("n", "mae", F.to_json("confusion_matrix").alias("confusion_matrix"))


@query("correlation_by_source", JUDGED_SQL + """, r AS (
  SELECT source, human, judge, quality, rank() OVER (PARTITION BY source ORDER BY human) + (count(*) OVER (PARTITION BY source, human) - 1) / 2.0 AS rh,
         rank() OVER (PARTITION BY source ORDER BY judge) + (count(*) OVER (PARTITION BY source, judge) - 1) / 2.0 AS rj FROM sc),
c AS (SELECT source, count(*) AS n, corr(human, judge) AS pj, CASE WHEN stddev_pop(quality) > 0 THEN corr(human, quality) END AS pq, corr(rh, rj) AS s FROM r GROUP BY source)
SELECT source, n, round(pj, 6) AS pearson_judge, round(pq, 6) AS pearson_quality, round(s, 6) AS spearman_judge FROM c WHERE n > 3""")
def q_correlation_by_source(spark, sf_dir):
    d = judged(spark, sf_dir)
    p = M.pearson_by(d, "human", ["judge", "quality"], ["source"]).groupBy("source").agg(
        *[F.max(F.when(F.col("column") == c, F.col("pearson"))).alias(f"pearson_{c}") for c in ("judge", "quality")])
    s = M.spearman(d, "human", "judge", ["source"])
    return p.join(s, "source").where("n > 3").select("source", "n", *[F.round(c, 6).alias(c) for c in ("pearson_judge", "pearson_quality")],
                                                     F.round("spearman", 6).alias("spearman_judge"))


@query("half_point_histogram", JUDGED_SQL + """, h AS (SELECT (human + judge) / 2.0 + 0.5 AS v FROM sc)
SELECT CAST(g.v AS INTEGER) AS value, (SELECT count(*) FROM h WHERE v >= g.v - 0.5 AND (v < g.v + 0.5 OR (g.v = 5 AND v = 5.5))) AS n FROM range(1, 6) g(v)""")
def q_half_point_histogram(spark, sf_dir):
    return M.integer_histogram(judged(spark, sf_dir).select(((F.col("human") + F.col("judge")) / 2.0 + 0.5).alias("v")), "v", 1, 5)


@query("first_element", "SELECT vec_id, CASE WHEN label % 3 = 0 THEN NULL ELSE CAST(embedding[3] AS DOUBLE) END AS first FROM embeddings")
def q_first_element(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    lst = F.when(F.col("label") % 3 == 0, F.slice("embedding", 1, 0)).otherwise(F.slice("embedding", 3, 4))
    return e.select("vec_id", V.first_element(lst).cast("double").alias("first"))


@query("correct_flags", VOTE_SQL + "SELECT vec_id, predicted = correct AS correct, predicted = correct AND NOT is_tie AS correct_no_tie FROM vote")
def q_correct_flags(spark, sf_dir):
    v = logprob_votes(spark, sf_dir)
    return v.select("vec_id", V.correct_flag("predicted", "correct").alias("correct"), V.correct_flag("predicted", "correct", "is_tie").alias("correct_no_tie"))


# --- text and order helpers (X36, X37, X40, L3, W4) -------------------------------------------
@query("name_parts", """SELECT doc_id, lang AS model, source AS group_key FROM documents""")
def q_name_parts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("org/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("_v1_"), F.col("source"))
    item = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit("-x"))
    return d.select("doc_id", TX.model_short_name(path).alias("model"), TX.group_key(item).alias("group_key"))


@query("mapped_columns", """SELECT doc_id, CAST(length(source) AS INTEGER) AS scalar, array_to_string([CAST(length(x) AS VARCHAR) FOR x IN string_split(coalesce(text, ''), chr(10))], '|') AS listed FROM documents""")
def q_mapped_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    out = TX.map_scalar_or_list_df(TX.map_scalar_or_list_df(d, "source", F.length), "lines", lambda x: F.length(x).cast("string"))
    return out.select("doc_id", F.col("source_mt-translated").alias("scalar"), F.array_join("lines_mt-translated", "|").alias("listed"))


@query("seeded_order", f"""SELECT doc_id, {md5_key_sql('doc_id', seed=SEED)} AS sort_key FROM documents ORDER BY sort_key, doc_id""")
def q_seeded_order(spark, sf_dir):
    d = seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], SEED)
    return d.select("doc_id", F.col("_shuffle_key").alias("sort_key"))


@query("blank_line_articles", """WITH l AS (
  SELECT doc_id, unnest(range(len(a))) AS line, unnest(a) AS t FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10) || chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL))
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(group_id AS BIGINT) AS group_id, t FROM (
  SELECT *, coalesce(sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS group_id FROM l) WHERE t <> ''""")
def q_blank_line_articles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.split(F.replace("text", F.lit(". "), F.lit("\n\n")), "\n")
    rows = d.select("doc_id", F.posexplode(lines).alias("line", "t"))
    return CP.article_ids_by_blank_lines(rows, "doc_id", "line", "t").select("doc_id", "line", "group_id", "t")
