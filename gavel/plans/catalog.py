"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

Every query reads the whole given tables (no id subsets, no prefixes, no row caps)
and returns flat scalar columns whose names equal the oracle's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.templates import render_sql
from ..operators import pairs as P
from .sqltext import WS_SQL, hexval_sql, md5_key_sql, sql_literal, strip_sql
from .tables import DOC_GROUP_SQL, HUMAN_SCORE_SQL, doc_group, human_score, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEED = 42


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def R9(c):
    """round doubles where summation order may differ between engines"""
    return F.round(c, 9)


# ---------------------------------------------------------------------------------
# shared derivations
# ---------------------------------------------------------------------------------

def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "text", "lang", "source", "n_chars",
                       human_score().alias("human_score"), doc_group().alias("grp"))


def doc_items(spark: SparkSession, sf_dir: str):
    docs = scored_documents(spark, sf_dir)
    return P.prepare_items(docs, "doc_id", "text", "human_score", order_col="doc_id", group_col="grp")


ITEMS_SQL = f"""items AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, {DOC_GROUP_SQL} AS group_key,
         {strip_sql('text')} AS sentence, CAST({HUMAN_SCORE_SQL} AS DOUBLE) AS score
  FROM documents
  WHERE doc_id IS NOT NULL AND text IS NOT NULL AND length({strip_sql('text')}) >= 3)"""


def _pairs_sql(min_diff: float = 1.0) -> str:
    t0 = render_sql(P.PAIR_TEMPLATES[0], {"sentence_a": "sa", "sentence_b": "sb"})
    t1 = render_sql(P.PAIR_TEMPLATES[1], {"sentence_a": "sa", "sentence_b": "sb"})
    return f"""WITH {ITEMS_SQL},
p AS (
  SELECT a.group_key, a.id AS first_id, b.id AS second_id,
         CASE WHEN a.score > b.score THEN a.id ELSE b.id END AS better_id,
         CASE WHEN a.score > b.score THEN b.id ELSE a.id END AS worse_id,
         CASE WHEN a.score > b.score THEN a.sentence ELSE b.sentence END AS bs,
         CASE WHEN a.score > b.score THEN b.sentence ELSE a.sentence END AS ws,
         greatest(a.score, b.score) AS better_score, least(a.score, b.score) AS worse_score,
         {md5_key_sql('a.id', 'b.id', seed=SEED)} AS h
  FROM items a JOIN items b
    ON a.group_key = b.group_key AND a.ord < b.ord
   AND abs(a.score - b.score) >= {float(min_diff)} AND a.score <> b.score),
q AS (SELECT *, substr(h, 1, 1) < '8' AS a_first, {hexval_sql('substr(h, 2, 1)')} % 2 AS tix FROM p),
r AS (SELECT *, CASE WHEN a_first THEN bs ELSE ws END AS sa, CASE WHEN a_first THEN ws ELSE bs END AS sb FROM q),
s AS (
  SELECT group_key, better_id, worse_id, better_score, worse_score, a_first, tix,
         trim(CASE WHEN tix = 0 THEN {t0} ELSE {t1} END, {WS_SQL}) AS prompt,
         CASE WHEN tix = 0 THEN (CASE WHEN a_first THEN 'A' ELSE 'B' END)
              ELSE (CASE WHEN a_first THEN '1' ELSE '2' END) END AS chosen,
         CASE WHEN tix = 0 THEN (CASE WHEN a_first THEN 'B' ELSE 'A' END)
              ELSE (CASE WHEN a_first THEN '2' ELSE '1' END) END AS rejected
  FROM r)
"""


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = doc_items(spark, sf_dir)
    return P.preference_pairs(items, min_diff=1.0, seed=SEED)


# ---------------------------------------------------------------------------------
# Scores -> preference data
# ---------------------------------------------------------------------------------

@query("preference_pairs", _pairs_sql() + """
SELECT group_key, better_id, worse_id, prompt, chosen, rejected, better_score, worse_score
FROM s WHERE length(prompt) >= 50""")
def q_preference_pairs(spark, sf_dir):
    return doc_pairs(spark, sf_dir).select("group_key", "better_id", "worse_id", "prompt", "chosen",
                                           "rejected", "better_score", "worse_score")


@query("group_split", _pairs_sql() + f""",
ok AS (SELECT * FROM s WHERE length(prompt) >= 50),
g AS (SELECT DISTINCT group_key FROM ok),
gr AS (SELECT group_key,
              row_number() OVER (ORDER BY {md5_key_sql('group_key', seed=SEED)}, group_key) AS rk,
              count(*) OVER () AS n FROM g)
SELECT ok.group_key, better_id, worse_id,
       CASE WHEN rk <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split
FROM ok JOIN gr USING (group_key)""")
def q_group_split(spark, sf_dir):
    return P.group_split(doc_pairs(spark, sf_dir), seed=SEED).select("group_key", "better_id", "worse_id", "split")


@query("pair_counters", _pairs_sql() + """,
ok AS (SELECT * FROM s WHERE length(prompt) >= 50)
SELECT (SELECT count(*) FROM items) AS n_items, (SELECT count(DISTINCT group_key) FROM items) AS n_groups,
       (SELECT count(*) FROM ok) AS n_pairs, (SELECT count(DISTINCT group_key) FROM ok) AS n_groups_with_pairs""")
def q_pair_counters(spark, sf_dir):
    items, _ = doc_items(spark, sf_dir)
    return P.pair_counters(items, doc_pairs(spark, sf_dir))


# ---------------------------------------------------------------------------------
# Chat records (F3, X23, A1, L8) and the pair -> chat rewrite
# ---------------------------------------------------------------------------------
from ..functions import votes as V  # noqa: E402
from ..functions.templates import apply_instruction_sql  # noqa: E402
from ..functions.text import norm_answer  # noqa: E402
from ..operators import chat as C  # noqa: E402
from ..operators import metrics as M  # noqa: E402
from ..operators.ordering import global_rank, positional_split  # noqa: E402

CHAT_INSTRUCTION = "Rate the quality of the following text with 0 or 1.\n\nText: %s\n\nAnswer:"


def _doc_label_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("_has"))
    return docs.join(lab, "doc_id", "left").withColumn("_has", F.coalesce("_has", F.lit(False)))


def chat_tables(spark, sf_dir):
    j = _doc_label_join(spark, sf_dir)
    return C.chat_records(j, "text", "quality", CHAT_INSTRUCTION, output_present="_has", keep=["doc_id"])


CHAT_SQL = f"""WITH j AS (
  SELECT d.doc_id, d.text, l.quality, l.doc_id IS NOT NULL AS has_label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
t AS (
  SELECT *, CASE WHEN NOT has_label THEN 'missing_output'
                 WHEN text IS NULL OR {strip_sql('text')} = '' THEN 'empty_input'
                 WHEN quality IS NULL THEN 'null_output' END AS reject_reason
  FROM j),
rec AS (
  SELECT doc_id, {apply_instruction_sql(CHAT_INSTRUCTION, strip_sql('text'))} AS user_content,
         {strip_sql('CAST(quality AS VARCHAR)')} AS assistant_content
  FROM t WHERE reject_reason IS NULL)
"""


@query("chat_records", CHAT_SQL + "SELECT doc_id, user_content, assistant_content FROM rec")
def q_chat_records(spark, sf_dir):
    return chat_tables(spark, sf_dir)[0]


@query("reject_reasons", CHAT_SQL + """SELECT reject_reason, count(*) AS n FROM t
WHERE reject_reason IS NOT NULL GROUP BY reject_reason""")
def q_reject_reasons(spark, sf_dir):
    return chat_tables(spark, sf_dir)[1].groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("value_distribution", CHAT_SQL + """SELECT value, n, round(CAST(n AS DOUBLE) * 100.0 / total, 9) AS percent
FROM (SELECT assistant_content AS value, count(*) AS n FROM rec GROUP BY 1) v,
     (SELECT count(*) AS total FROM rec) t""")
def q_value_distribution(spark, sf_dir):
    return C.value_distribution(chat_tables(spark, sf_dir)[0])


@query("positional_split", CHAT_SQL + """SELECT doc_id,
  CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split
FROM rec""")
def q_positional_split(spark, sf_dir):
    return positional_split(chat_tables(spark, sf_dir)[0].select("doc_id"), ["doc_id"])


def _re2_rule(pattern: str, repl: str) -> tuple[str, str]:
    """The same rule in RE2 (DuckDB): drop Java-only flags, emulate the look-ahead by
    capturing the context and writing it back."""
    import re as _re
    flags = ""
    m = _re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if m:
        flags = "".join(ch for ch in m.group(1) if ch in "mi")
        pattern = pattern[m.end():]
    if "(?=" in pattern:
        head, look = pattern.split("(?=", 1)
        pattern = head + "(" + look
        repl = repl + "$1"
    repl = _re.sub(r"\$(\d)", r"\\\1", repl)
    return (f"(?{flags})" if flags else "") + pattern, repl


def ab_rewrite_sql(expr: str) -> str:
    out = expr
    for pat, rep in C.AB_REWRITE_RULES:
        p, r = _re2_rule(pat, rep)
        out = f"regexp_replace({out}, {sql_literal(p)}, {sql_literal(r)}, 'g')"
    return out


AB_SQL = _pairs_sql() + f""",
ok AS (SELECT * FROM s WHERE length(prompt) >= 50),
rw AS (
  SELECT better_id, worse_id, prompt, chosen, {ab_rewrite_sql('prompt')} AS user_content,
         CASE WHEN {strip_sql('chosen')} = '1' THEN 'A' WHEN {strip_sql('chosen')} = '2' THEN 'B'
              WHEN {strip_sql('chosen')} IN ('A', 'B') THEN {strip_sql('chosen')} ELSE chosen END AS assistant_content
  FROM ok)
"""


@query("ab_rewrite", AB_SQL + "SELECT better_id, worse_id, user_content, assistant_content FROM rw")
def q_ab_rewrite(spark, sf_dir):
    chat = C.pairs_to_chat(doc_pairs(spark, sf_dir))
    return chat.select("better_id", "worse_id", "user_content", "assistant_content")


@query("conversion_counters", AB_SQL + """SELECT count(*) AS n_records,
  count(*) FILTER (WHERE user_content <> prompt) AS user_conversions,
  count(*) FILTER (WHERE assistant_content <> chosen) AS assistant_conversions,
  count(*) FILTER (WHERE prompt IS NULL OR chosen IS NULL) AS errors FROM rw""")
def q_conversion_counters(spark, sf_dir):
    return C.conversion_counters(C.pairs_to_chat(doc_pairs(spark, sf_dir)))


# ---------------------------------------------------------------------------------
# evaluation: logprob / probability / arg-max votes (X15-X19, X21, F8) + metrics
# ---------------------------------------------------------------------------------
LOGPROB_KEYS = ["A", " B", "\nA", "_B", "x", " A ", "B"]


def logprob_votes(spark, sf_dir) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    e = lambda i: F.col("embedding")[i].cast("double")
    top = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in LOGPROB_KEYS]),
                                         F.array(*[e(i) for i in range(len(LOGPROB_KEYS))])),
                       lambda k, v: v > -0.1)
    stored = e(7) > 0.15
    stored_choice = F.when(stored, F.when(e(8) > 0, "B").otherwise("A"))
    stored_tie = F.when(stored, e(9) > 0.2)
    raw_answer = F.when(F.col("label") % 2 == 0, " a").otherwise("B\n")
    df = emb.select("vec_id", top.alias("top"), stored_choice.alias("stored_choice"),
                    stored_tie.alias("stored_tie"), raw_answer.alias("correct_answer"))
    # F8: nothing to decide from, or no answer -> skipped
    df = df.filter(((F.size("top") > 0) | F.col("stored_choice").isNotNull()) & F.col("correct_answer").isNotNull())
    vote = V.stored_or_computed("stored_choice", "stored_tie", V.logprob_vote("top"))
    return df.select("vec_id", vote["predicted"].alias("predicted"), vote["is_tie"].alias("is_tie"),
                     norm_answer("correct_answer").alias("correct"))


_E = lambda i: f"CAST(embedding[{i + 1}] AS DOUBLE)"
VOTE_SQL = f"""WITH v AS (
  SELECT vec_id, label, {', '.join(f'{_E(i)} AS e{i}' for i in range(20))} FROM embeddings),
w AS (
  SELECT *, greatest(CASE WHEN e0 > -0.1 THEN e0 END, CASE WHEN e2 > -0.1 THEN e2 END,
                     CASE WHEN e5 > -0.1 THEN e5 END) AS best_a,
            greatest(CASE WHEN e1 > -0.1 THEN e1 END, CASE WHEN e3 > -0.1 THEN e3 END,
                     CASE WHEN e6 > -0.1 THEN e6 END) AS best_b,
            (e0 > -0.1 OR e1 > -0.1 OR e2 > -0.1 OR e3 > -0.1 OR e4 > -0.1 OR e5 > -0.1 OR e6 > -0.1) AS has_top,
            e7 > 0.15 AS has_stored
  FROM v),
vote AS (
  SELECT vec_id,
         CASE WHEN has_stored THEN (CASE WHEN e8 > 0 THEN 'B' ELSE 'A' END)
              WHEN best_a IS NULL AND best_b IS NULL THEN 'A' WHEN best_a IS NULL THEN 'B'
              WHEN best_b IS NULL THEN 'A' WHEN best_a > best_b THEN 'A' ELSE 'B' END AS predicted,
         CASE WHEN has_stored THEN e9 > 0.2
              WHEN best_a IS NULL AND best_b IS NULL THEN true
              WHEN best_a IS NULL OR best_b IS NULL THEN false
              ELSE abs(best_a - best_b) < 0.1 END AS is_tie,
         CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS correct
  FROM w WHERE has_top OR has_stored)
"""


@query("logprob_vote", VOTE_SQL + "SELECT vec_id, predicted, is_tie, correct FROM vote")
def q_logprob_vote(spark, sf_dir):
    return logprob_votes(spark, sf_dir)


@query("logprob_metrics", VOTE_SQL + """SELECT total, correct, ties, pred_a, pred_b,
  round(correct / total, 9) AS accuracy, round(ties / total, 9) AS tie_rate,
  round(pred_a / total, 9) AS a_rate, round(pred_b / total, 9) AS b_rate
FROM (SELECT count(*) AS total, count(*) FILTER (WHERE predicted = correct) AS correct,
             count(*) FILTER (WHERE is_tie) AS ties, count(*) FILTER (WHERE predicted = 'A') AS pred_a,
             count(*) FILTER (WHERE predicted = 'B') AS pred_b FROM vote)""")
def q_logprob_metrics(spark, sf_dir):
    m = M.ab_metrics_with_ties(logprob_votes(spark, sf_dir))
    return m.select("total", "correct", "ties", "pred_a", "pred_b",
                    *[R9(F.col(c)).alias(c) for c in ("accuracy", "tie_rate", "a_rate", "b_rate")])


CONF_AB_SQL = VOTE_SQL + """,
grid AS (SELECT a.l AS actual, p.l AS predicted FROM (VALUES ('A'), ('B')) a(l), (VALUES ('A'), ('B')) p(l)),
cnt AS (SELECT correct AS actual, predicted, count(*) AS n FROM vote
        WHERE correct IN ('A', 'B') AND predicted IN ('A', 'B') GROUP BY 1, 2),
conf AS (SELECT grid.actual, grid.predicted, coalesce(cnt.n, 0) AS n FROM grid LEFT JOIN cnt USING (actual, predicted))
"""


@query("logprob_confusion", CONF_AB_SQL + "SELECT actual, predicted, n FROM conf")
def q_logprob_confusion(spark, sf_dir):
    return M.confusion(logprob_votes(spark, sf_dir), "correct", "predicted", ["A", "B"])


def classification_report_sql(conf: str) -> str:
    return f""",
per AS (
  SELECT s.label, CASE WHEN pr.n_pred > 0 THEN t.tp / pr.n_pred ELSE 0.0 END AS precision,
         CASE WHEN s.support > 0 THEN t.tp / s.support ELSE 0.0 END AS recall, s.support, t.tp
  FROM (SELECT actual AS label, n AS tp FROM {conf} WHERE actual = predicted) t
  JOIN (SELECT actual AS label, sum(n) AS support FROM {conf} GROUP BY 1) s USING (label)
  JOIN (SELECT predicted AS label, sum(n) AS n_pred FROM {conf} GROUP BY 1) pr USING (label)),
per2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM per),
tot AS (SELECT sum(support) AS total, sum(tp) AS tp_all, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
               sum(precision * support) AS wp, sum(recall * support) AS wr, sum(f1 * support) AS wf FROM per2),
rep AS (
  SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, support FROM per2
  UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN total > 0 THEN tp_all / total ELSE 0.0 END, total FROM tot
  UNION ALL SELECT 'macro avg', mp, mr, mf, total FROM tot
  UNION ALL SELECT 'weighted avg', CASE WHEN total > 0 THEN wp / total ELSE 0.0 END,
                   CASE WHEN total > 0 THEN wr / total ELSE 0.0 END, CASE WHEN total > 0 THEN wf / total ELSE 0.0 END, total FROM tot)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       CAST(support AS BIGINT) AS support FROM rep"""


@query("logprob_report", CONF_AB_SQL + classification_report_sql("conf"))
def q_logprob_report(spark, sf_dir):
    return M.classification_report(q_logprob_confusion(spark, sf_dir), ["A", "B"])


@query("prob_vote_metrics", VOTE_SQL + """,
pv AS (SELECT abs(e10) AS pa, CASE WHEN label = 3 THEN abs(e10) ELSE abs(e11) END AS pb,
              CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS correct FROM v),
pv2 AS (SELECT correct, abs(pa - pb) < 1e-8 AS is_tie,
               CASE WHEN abs(pa - pb) < 1e-8 THEN 'A' WHEN pa > pb THEN 'A' ELSE 'B' END AS predicted FROM pv),
m AS (SELECT count(*) AS total, count(*) FILTER (WHERE is_tie) AS tie_count,
             count(*) FILTER (WHERE NOT is_tie) AS non_tie,
             count(*) FILTER (WHERE NOT is_tie AND predicted = correct) AS correct_non_tie,
             count(*) FILTER (WHERE NOT is_tie AND predicted = 'A') AS pred_a,
             count(*) FILTER (WHERE NOT is_tie AND predicted = 'B') AS pred_b,
             count(*) FILTER (WHERE NOT is_tie AND correct = 'A') AS true_a,
             count(*) FILTER (WHERE NOT is_tie AND correct = 'B') AS true_b FROM pv2)
SELECT *, round(CASE WHEN non_tie > 0 THEN correct_non_tie / non_tie ELSE 0.0 END, 9) AS accuracy,
       round(CASE WHEN total > 0 THEN tie_count / total END, 9) AS tie_share FROM m""")
def q_prob_vote_metrics(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    e = lambda i: F.abs(F.col("embedding")[i].cast("double"))
    pb = F.when(F.col("label") == 3, e(10)).otherwise(e(11))
    vote = V.prob_vote(e(10), pb)
    df = emb.select(vote["predicted"].alias("predicted"), vote["is_tie"].alias("is_tie"),
                    F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("correct"))
    m = M.ab_metrics_without_ties(df)
    return m.select(*[c for c in m.columns if c not in ("accuracy", "tie_share")],
                    R9(F.col("accuracy")).alias("accuracy"), R9(F.col("tie_share")).alias("tie_share"))


def _avg_rank_sql(col: str) -> str:
    return f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)"


def regression_sql(src: str, true: str, pred: str) -> str:
    return f""",
ok AS (SELECT CAST({true} AS DOUBLE) AS t, CAST({pred} AS DOUBLE) AS p FROM {src}
       WHERE {true} IS NOT NULL AND {pred} IS NOT NULL),
rk AS (SELECT t, p, {_avg_rank_sql('t')} AS rt, {_avg_rank_sql('p')} AS rp FROM ok)
SELECT count(*) AS n, round(avg(abs(p - t)), 9) AS mae, round(avg((p - t) * (p - t)), 9) AS mse,
       round(sqrt(avg((p - t) * (p - t))), 9) AS rmse, round(avg(CASE WHEN p = t THEN 1.0 ELSE 0.0 END), 9) AS exact,
       round(avg(CASE WHEN abs(p - t) <= 1 THEN 1.0 ELSE 0.0 END), 9) AS within_1,
       round(avg(CASE WHEN abs(p - t) <= 2 THEN 1.0 ELSE 0.0 END), 9) AS within_2,
       round(corr(t, p), 9) AS pearson, round(corr(rt, rp), 9) AS spearman FROM rk"""


def regression_frame(df: DataFrame, true: str, pred: str) -> DataFrame:
    reg = M.regression_metrics(df, true, pred)
    sp = M.spearman(df, true, pred).select("spearman")
    out = reg.crossJoin(sp)
    return out.select("n", *[R9(F.col(c)).alias(c) for c in
                             ("mae", "mse", "rmse", "exact", "within_1", "within_2", "pearson", "spearman")])


@query("argmax_metrics", VOTE_SQL + """,
am AS (SELECT vec_id, 1 + (vec_id * 3 + label) % 5 AS true_score,
              CASE WHEN label = 9 THEN 3
                   ELSE coalesce(nullif(list_position(embedding[13:17], list_max(embedding[13:17])), 0), 3) END AS predicted
       FROM embeddings)""" + regression_sql("am", "true_score", "predicted"))
def q_argmax_metrics(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    probs = F.when(F.col("label") != 9, F.slice("embedding", 13, 5))
    df = emb.select((F.lit(1) + (F.col("vec_id") * 3 + F.col("label")) % 5).alias("true_score"),
                    V.argmax_score(probs).alias("predicted"))
    return regression_frame(df, "true_score", "predicted")


# ---------------------------------------------------------------------------------
# human vs judge scores on documents x labels
# ---------------------------------------------------------------------------------
JUDGE_SQL = "CAST(1 + ((doc_id * 7 + n_chars + (1 - quality) * (1 + toxic)) % 5) AS INTEGER)"
SCORED_SQL = f"""WITH sc AS (
  SELECT d.doc_id, d.n_chars, {HUMAN_SCORE_SQL.replace('doc_id', 'd.doc_id').replace('n_chars', 'd.n_chars')} AS human,
         CAST(1 + ((d.doc_id * 7 + d.n_chars + (1 - l.quality) * (1 + l.toxic)) % 5) AS INTEGER) AS judge,
         l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""


def scored_pairs(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    j = docs.join(lab, "doc_id")
    judge = (F.lit(1) + F.pmod(F.col("doc_id") * 7 + F.col("n_chars") + (1 - F.col("quality")) * (1 + F.col("toxic")),
                               F.lit(5))).cast("int")
    return j.select("doc_id", "n_chars", human_score().alias("human"), judge.alias("judge"), "quality", "toxic")


@query("score_metrics", SCORED_SQL + regression_sql("sc", "human", "judge"))
def q_score_metrics(spark, sf_dir):
    return regression_frame(scored_pairs(spark, sf_dir), "human", "judge")


@query("binary_metrics", SCORED_SQL + """,
b AS (SELECT t.threshold,
             count(*) FILTER (WHERE human <= t.threshold AND judge <= t.threshold) AS tn,
             count(*) FILTER (WHERE human <= t.threshold AND judge > t.threshold) AS fp,
             count(*) FILTER (WHERE human > t.threshold AND judge <= t.threshold) AS fn,
             count(*) FILTER (WHERE human > t.threshold AND judge > t.threshold) AS tp
      FROM sc, (VALUES (3.0), (4.0)) t(threshold) GROUP BY t.threshold),
b2 AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
              CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM b)
SELECT CAST(threshold AS DOUBLE) AS threshold, tn, fp, fn, tp, round(precision, 9) AS precision, round(recall, 9) AS recall,
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 9) AS f1
FROM b2""")
def q_binary_metrics(spark, sf_dir):
    m = M.threshold_metrics(scored_pairs(spark, sf_dir), "human", "judge", [3, 4])
    return m.select("threshold", "tn", "fp", "fn", "tp", *[R9(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@query("threshold_distribution", SCORED_SQL + """,
grid AS (SELECT s.side, v.human_score FROM (VALUES ('high'), ('low')) s(side), (VALUES (1), (2), (3), (4), (5)) v(human_score)),
c AS (SELECT CASE WHEN judge > 3 THEN 'high' ELSE 'low' END AS side, human AS human_score, count(*) AS n
      FROM sc WHERE judge IS NOT NULL GROUP BY 1, 2)
SELECT grid.side, grid.human_score, coalesce(c.n, 0) AS n FROM grid LEFT JOIN c USING (side, human_score)""")
def q_threshold_distribution(spark, sf_dir):
    return M.threshold_distribution(scored_pairs(spark, sf_dir), "human", "judge", 3)


@query("score_confusion", SCORED_SQL + """,
grid AS (SELECT a.v AS actual, p.v AS predicted FROM range(1, 6) a(v), range(1, 6) p(v)),
c AS (SELECT human AS actual, judge AS predicted, count(*) AS n FROM sc
      WHERE human BETWEEN 1 AND 5 AND judge BETWEEN 1 AND 5 GROUP BY 1, 2)
SELECT CAST(grid.actual AS INTEGER) AS actual, CAST(grid.predicted AS INTEGER) AS predicted, coalesce(c.n, 0) AS n
FROM grid LEFT JOIN c ON grid.actual = c.actual AND grid.predicted = c.predicted""")
def q_score_confusion(spark, sf_dir):
    return M.confusion(scored_pairs(spark, sf_dir), "human", "judge", [1, 2, 3, 4, 5])


@query("score_report", SCORED_SQL + """,
grid AS (SELECT a.v AS actual, p.v AS predicted FROM range(1, 6) a(v), range(1, 6) p(v)),
c AS (SELECT human AS actual, judge AS predicted, count(*) AS n FROM sc
      WHERE human BETWEEN 1 AND 5 AND judge BETWEEN 1 AND 5 GROUP BY 1, 2),
conf AS (SELECT grid.actual, grid.predicted, CAST(coalesce(c.n, 0) AS DOUBLE) AS n
         FROM grid LEFT JOIN c ON grid.actual = c.actual AND grid.predicted = c.predicted)""" +
       classification_report_sql("conf"))
def q_score_report(spark, sf_dir):
    return M.classification_report(q_score_confusion(spark, sf_dir), [1, 2, 3, 4, 5])


@query("score_histogram", SCORED_SQL + """,
grid AS (SELECT CAST(v AS INTEGER) AS value FROM range(1, 6) g(v)),
c AS (SELECT judge AS value, count(*) AS n FROM sc WHERE judge BETWEEN 0.5 AND 5.5 GROUP BY 1)
SELECT grid.value, coalesce(c.n, 0) AS n FROM grid LEFT JOIN c USING (value)""")
def q_score_histogram(spark, sf_dir):
    return M.integer_histogram(scored_pairs(spark, sf_dir), "judge", 1, 5)


@query("value_histogram", """WITH ok AS (SELECT CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL),
mm AS (SELECT min(v) AS mn, max(v) AS mx, count(*) AS n FROM ok),
c AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((v - mn) * 20 / (mx - mn)), 19) END AS INTEGER) AS bin,
             count(*) AS cnt FROM ok, mm GROUP BY 1)
SELECT CAST(g.bin AS INTEGER) AS bin, round(mn + g.bin * ((mx - mn) / 20), 9) AS lo,
       round(mn + (g.bin + 1) * ((mx - mn) / 20), 9) AS hi, coalesce(c.cnt, 0) AS n,
       round(coalesce(c.cnt, 0) / (n * ((mx - mn) / 20)), 9) AS density
FROM range(0, 20) g(bin) CROSS JOIN mm LEFT JOIN c ON c.bin = g.bin""")
def q_value_histogram(spark, sf_dir):
    h = M.equal_width_histogram(table(spark, sf_dir, "events"), "value", 20, density=True)
    return h.select("bin", R9(F.col("lo")).alias("lo"), R9(F.col("hi")).alias("hi"), "n",
                    R9(F.col("density")).alias("density"))


@query("describe_lengths", """SELECT count(v) AS count, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std,
  min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75,
  max(v) AS max FROM (SELECT CAST(n_chars AS DOUBLE) AS v FROM documents)""")
def q_describe_lengths(spark, sf_dir):
    d = M.describe(table(spark, sf_dir, "documents"), "n_chars")
    return d.select("count", R9(F.col("mean")).alias("mean"), R9(F.col("std")).alias("std"), "min",
                    "p25", "p50", "p75", "max")


MELT_COLS = ["m1_cot", "m1_da", "m2_cot", "m2_da", "m9_da"]


def wide_scores(spark, sf_dir) -> DataFrame:
    s = scored_pairs(spark, sf_dir)
    return s.select("doc_id", F.col("human").cast("double").alias("m1_cot"), F.col("judge").cast("double").alias("m1_da"),
                    (F.col("quality") * 4 + 1).cast("double").alias("m2_cot"),
                    F.when(F.col("toxic") == 0, F.col("judge")).cast("double").alias("m2_da"),
                    (F.col("toxic") * 4 + 1).cast("double").alias("m9_da"))


WIDE_SQL = SCORED_SQL + """,
wide AS (SELECT doc_id, CAST(human AS DOUBLE) AS m1_cot, CAST(judge AS DOUBLE) AS m1_da,
                CAST(quality * 4 + 1 AS DOUBLE) AS m2_cot, CAST(CASE WHEN toxic = 0 THEN judge END AS DOUBLE) AS m2_da,
                CAST(toxic * 4 + 1 AS DOUBLE) AS m9_da FROM sc),
long AS (UNPIVOT wide ON m1_cot, m1_da, m2_cot, m2_da, m9_da INTO NAME col VALUE value),
means AS (SELECT split_part(col, '_', 1) AS model, split_part(col, '_', 2) AS method,
                 avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM long GROUP BY 1, 2)
"""


def melt_means_frame(spark, sf_dir) -> DataFrame:
    long = M.melt(wide_scores(spark, sf_dir), ["doc_id"], MELT_COLS, "col", "value")
    long = long.select(F.split_part("col", F.lit("_"), F.lit(1)).alias("model"),
                       F.split_part("col", F.lit("_"), F.lit(2)).alias("method"), "value")
    return M.melt_means(long, ["model", "method"])


@query("melt_means", WIDE_SQL + "SELECT model, method, round(mean, 9) AS mean, round(std, 9) AS std, n FROM means")
def q_melt_means(spark, sf_dir):
    m = melt_means_frame(spark, sf_dir)
    return m.select("model", "method", R9(F.col("mean")).alias("mean"), R9(F.col("std")).alias("std"), "n")


@query("name_map", WIDE_SQL + """,
dim AS (SELECT 'm' || CAST(r_regionkey AS VARCHAR) AS model, r_name AS display FROM region)
SELECT coalesce(dim.display, means.model) AS display_name, method, round(mean, 9) AS mean
FROM means LEFT JOIN dim USING (model)""")
def q_name_map(spark, sf_dir):
    from ..operators.lookup import display_names
    dim = table(spark, sf_dir, "region").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("key"),
                                                F.col("r_name").alias("display"))
    m = display_names(melt_means_frame(spark, sf_dir), "model", dim, "key", "display", "display_name")
    return m.select("display_name", "method", R9(F.col("mean")).alias("mean"))


@query("row_mean", WIDE_SQL + """SELECT doc_id, round(
  (coalesce(m1_cot, 0) + coalesce(m1_da, 0) + coalesce(m2_da, 0)) /
  nullif((m1_cot IS NOT NULL)::INT + (m1_da IS NOT NULL)::INT + (m2_da IS NOT NULL)::INT, 0), 9) AS judge_mean
FROM wide""")
def q_row_mean(spark, sf_dir):
    w = wide_scores(spark, sf_dir)
    return w.select("doc_id", R9(M.row_mean(["m1_cot", "m1_da", "m2_da"])).alias("judge_mean"))


@query("match_pct", SCORED_SQL + "SELECT round(avg(CASE WHEN human = judge THEN 1.0 ELSE 0.0 END) * 100, 9) AS match_pct FROM sc")
def q_match_pct(spark, sf_dir):
    return M.match_percentage(scored_pairs(spark, sf_dir), "human", "judge").select(R9(F.col("match_pct")).alias("match_pct"))


# ---------------------------------------------------------------------------------
# Items -> batches -> prompts -> replies -> results, resume
# ---------------------------------------------------------------------------------
from ..operators import pack as K  # noqa: E402
from ..operators import replies as RP  # noqa: E402
from ..operators import resume as RS  # noqa: E402

TASK_INSTRUCTION = "Score each text for fluency from 1 to 5 and give a one-sentence reason."
ITEMS_PER_BATCH = 5
MAX_TOKENS = 1500
MODEL_NAME = "judge-x"


def task_items(spark, sf_dir) -> DataFrame:
    return K.extract_items(table(spark, sf_dir, "documents"), "doc_id", "text", "doc_id")


def packed_items(spark, sf_dir) -> DataFrame:
    return K.pack_batches(task_items(spark, sf_dir), ITEMS_PER_BATCH, MAX_TOKENS, TASK_INSTRUCTION,
                          order_cols=["ord", "id"])


def task_batches(spark, sf_dir) -> DataFrame:
    return K.batch_prompts(packed_items(spark, sf_dir), TASK_INSTRUCTION, "task", MODEL_NAME)


def _reply_piece(safe: F.Column, text: F.Column, key: F.Column) -> F.Column:
    d = F.substring(F.md5(key), 1, 1)
    score = (F.lit(1) + F.length(text) % 5).cast("string")
    full = F.concat(F.lit("<id"), safe, F.lit("><o>"), score, F.lit("</o><reason>"), text, F.lit("</reason></id"), safe,
                    F.lit(">\n"))
    no_reason = F.concat(F.lit("<id"), safe, F.lit("><o>"), score, F.lit("</o></id"), safe, F.lit(">\n"))
    upper = F.concat(F.lit("<ID"), safe, F.lit("><O>"), score, F.lit("</O><REASON>"), text, F.lit("</REASON></ID"), safe,
                     F.lit(">\n"))
    return (F.when(d.isin(*"0123456789"), full).when(d.isin("a", "b"), no_reason)
             .when(d.isin("c", "d"), F.lit("")).otherwise(upper))


def task_replies(spark, sf_dir, batches: DataFrame | None = None) -> DataFrame:
    """Judge replies derived from the batches themselves (varied forms; a batch whose
    md5 starts with 0 has no reply, i.e. it failed)."""
    b = task_batches(spark, sf_dir) if batches is None else batches
    members = F.arrays_zip(F.col("item_ids").alias("s"), F.col("original_ids").alias("o"), F.col("item_texts").alias("t"))
    reply = F.array_join(F.transform(members, lambda m: _reply_piece(m["s"], m["t"], m["o"])), "")
    return b.filter(F.substring(F.md5("batch_id"), 1, 1) != "0").select("batch_id", reply.alias("response"))


def task_results(spark, sf_dir) -> DataFrame:
    return RP.parse_task_results(task_batches(spark, sf_dir), task_replies(spark, sf_dir))


PACK_SQL = f"""WITH RECURSIVE it0 AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, {strip_sql('text')} AS text, min(doc_id) AS ord
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND {strip_sql('text')} <> ''
  GROUP BY 1, 2),
it AS (
  SELECT *, (length(text) + 16) // 4 + 50 AS tokens, row_number() OVER (ORDER BY ord, id) AS rk FROM it0),
it2 AS (SELECT *, (rk - 1) // {ITEMS_PER_BATCH} + 1 AS batch_no, (rk - 1) % {ITEMS_PER_BATCH} + 1 AS slot FROM it),
bt AS (SELECT batch_no, {len(TASK_INSTRUCTION) // 4} + sum(tokens) > {MAX_TOKENS} AS need FROM it2 GROUP BY 1),
walk(batch_no, slot, id, chunk, cur, position) AS (
  SELECT batch_no, slot, id, 1, tokens, 1 FROM it2 WHERE slot = 1
  UNION ALL
  SELECT i.batch_no, i.slot, i.id,
         CASE WHEN b.need AND w.cur + i.tokens > {MAX_TOKENS - len(TASK_INSTRUCTION) // 4 - 300} THEN w.chunk + 1 ELSE w.chunk END,
         CASE WHEN b.need AND w.cur + i.tokens > {MAX_TOKENS - len(TASK_INSTRUCTION) // 4 - 300} THEN i.tokens ELSE w.cur + i.tokens END,
         CASE WHEN b.need AND w.cur + i.tokens > {MAX_TOKENS - len(TASK_INSTRUCTION) // 4 - 300} THEN 1 ELSE w.position + 1 END
  FROM walk w JOIN it2 i ON i.batch_no = w.batch_no AND i.slot = w.slot + 1 JOIN bt b ON b.batch_no = i.batch_no),
nc AS (SELECT batch_no, max(chunk) AS n_chunks FROM walk GROUP BY 1),
packed AS (
  SELECT it2.id, it2.text, it2.tokens, it2.rk, w.batch_no, w.chunk, w.position, nc.n_chunks,
         CASE WHEN nc.n_chunks = 1 THEN CAST(w.batch_no AS VARCHAR) ELSE CAST(w.batch_no AS VARCHAR) || '-' || CAST(w.chunk AS VARCHAR) END AS batch_id,
         nc.n_chunks > 1 AS was_split, translate(it2.id, '-.', '__') AS safe
  FROM walk w JOIN it2 ON it2.batch_no = w.batch_no AND it2.slot = w.slot JOIN nc ON nc.batch_no = w.batch_no)
"""


@query("batch_pack", PACK_SQL + """SELECT id, CAST(batch_no AS BIGINT) AS batch_no, batch_id, CAST(position AS INTEGER) AS position,
  was_split, CAST(tokens AS BIGINT) AS tokens FROM packed""")
def q_batch_pack(spark, sf_dir):
    return packed_items(spark, sf_dir).select("id", "batch_no", "batch_id", "position", "was_split", "tokens")


PROMPT_SQL = PACK_SQL + f""",
prompts AS (
  SELECT batch_id, any_value(was_split) AS was_split, count(*) AS n_items,
         {sql_literal(TASK_INSTRUCTION + chr(10) + chr(10))}
         || string_agg('<id' || safe || '>' || text || '</id' || safe || '>' || chr(10), '' ORDER BY position)
         || {sql_literal(K.TASK_FORMAT_HEADER)}
         || string_agg('<id' || safe || '><o>[score]</o><reason>[rationale]</reason></id' || safe || '>' || chr(10), '' ORDER BY position)
         AS prompt
  FROM packed GROUP BY batch_id)
"""


@query("batch_prompts", PROMPT_SQL + """SELECT batch_id, prompt, CAST(n_items AS INTEGER) AS n_items, CAST(length(prompt) // 4 AS BIGINT) AS estimated_tokens,
  was_split FROM prompts""")
def q_batch_prompts(spark, sf_dir):
    b = task_batches(spark, sf_dir)
    return b.select("batch_id", "prompt", F.size("item_ids").alias("n_items"), "estimated_tokens", "was_split")


def _trim(x: str) -> str:
    return strip_sql(x)


def _untag(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]*>', '', 'g')"


def _cut500(x: str) -> str:
    return f"(CASE WHEN length({x}) > 500 THEN substr({x}, 1, 500) || '...' ELSE {x} END)"


REPLY_SQL = PROMPT_SQL + f""",
pieces AS (
  SELECT batch_id, position, safe, id, text, substr(md5(id), 1, 1) AS d,
         CAST(1 + length(text) % 5 AS VARCHAR) AS score FROM packed),
replies AS (
  SELECT batch_id, string_agg(CASE
      WHEN d IN ('0','1','2','3','4','5','6','7','8','9') THEN '<id' || safe || '><o>' || score || '</o><reason>' || text || '</reason></id' || safe || '>' || chr(10)
      WHEN d IN ('a', 'b') THEN '<id' || safe || '><o>' || score || '</o></id' || safe || '>' || chr(10)
      WHEN d IN ('c', 'd') THEN ''
      ELSE '<ID' || safe || '><O>' || score || '</O><REASON>' || text || '</REASON></ID' || safe || '>' || chr(10) END,
      '' ORDER BY position) AS response
  FROM pieces WHERE substr(md5(batch_id), 1, 1) <> '0' GROUP BY batch_id),
m AS (
  SELECT p.batch_id, p.id, p.text, p.safe, r.response, r.batch_id IS NOT NULL AS has_reply,
         '(?s)<id\\Q' || p.safe || '\\E>(.*?)</id\\Q' || p.safe || '\\E>' AS block_pat,
         '(?is)<id\\Q' || p.safe || '\\E><o>([^<]+)</o><reason>(.*?)</reason></id\\Q' || p.safe || '\\E>' AS strict_pat
  FROM packed p LEFT JOIN replies r USING (batch_id)),
m2 AS (
  SELECT *, regexp_matches(response, block_pat) AS has_block, regexp_extract(response, block_pat, 1) AS block,
         regexp_matches(response, strict_pat) AS has_strict FROM m),
m3 AS (
  SELECT *, has_block AND regexp_matches(block, '(?s)<o>.*?</o>') AS has_o,
         has_block AND regexp_matches(block, '(?s)<reason>.*?</reason>') AS has_r FROM m2),
m4 AS (
  SELECT *,
    CASE WHEN has_o THEN {_trim(_untag("regexp_extract(block, '(?s)<o>(.*?)</o>', 1)"))} END AS l1_out,
    CASE WHEN has_r THEN {_cut500(_trim(_untag("regexp_extract(block, '(?s)<reason>(.*?)</reason>', 1)")))}
         WHEN has_o THEN 'No reason provided' END AS l1_reason,
    CASE WHEN has_strict THEN {_trim('regexp_extract(response, strict_pat, 1)')} END AS l2_out,
    CASE WHEN has_strict THEN {_cut500(_trim('regexp_extract(response, strict_pat, 2)'))} END AS l2_reason
  FROM m3),
lv AS (SELECT batch_id, bool_and(l1_out IS NOT NULL) AS level1 FROM m4 GROUP BY batch_id),
results AS (
  SELECT m4.id, m4.text AS input,
         CASE WHEN NOT has_reply THEN NULL WHEN lv.level1 THEN l1_out ELSE l2_out END AS output,
         CASE WHEN NOT has_reply THEN 'Error during processing'
              WHEN lv.level1 THEN coalesce(l1_reason, '') ELSE coalesce(l2_reason, '') END AS reason,
         'judge-x' AS model_name
  FROM m4 JOIN lv USING (batch_id))
"""


@query("parse_output_tags", REPLY_SQL + "SELECT id, input, output, reason, model_name FROM results")
def q_parse_output_tags(spark, sf_dir):
    return task_results(spark, sf_dir)


@query("run_summary", REPLY_SQL + """SELECT expected, extracted, batches, split_batches,
  CASE WHEN expected > 0 THEN extracted / expected END AS success_share
FROM (SELECT count(*) AS expected, count(output) AS extracted FROM results) r,
     (SELECT count(*) AS batches, count(*) FILTER (WHERE was_split) AS split_batches FROM prompts) b""")
def q_run_summary(spark, sf_dir):
    s = K.run_summary(task_results(spark, sf_dir), task_batches(spark, sf_dir))
    return s.select("expected", "extracted", "batches", "split_batches", "success_share")


@query("resume_anti", f"""SELECT CAST(doc_id AS VARCHAR) AS id FROM documents d
WHERE doc_id IS NOT NULL AND text IS NOT NULL AND {strip_sql('text')} <> ''
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = CAST(d.doc_id AS VARCHAR))""")
def q_resume_anti(spark, sf_dir):
    done = RS.done_ids(table(spark, sf_dir, "labels"), "doc_id", None)
    return RS.pending_items(task_items(spark, sf_dir), done).select("id")


@query("batch_semi", PROMPT_SQL + """SELECT DISTINCT p.batch_id FROM packed p
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE CAST(l.doc_id AS VARCHAR) = p.id)""")
def q_batch_semi(spark, sf_dir):
    done = RS.done_ids(table(spark, sf_dir, "labels"), "doc_id", None)
    return RS.pending_batches(task_batches(spark, sf_dir), done).select("batch_id")


@query("retry_nulls", REPLY_SQL + """SELECT DISTINCT p.id FROM packed p
WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.id = p.id AND r.output IS NOT NULL)""")
def q_retry_nulls(spark, sf_dir):
    done = RS.done_ids(task_results(spark, sf_dir), "id", "output")
    return RS.pending_items(task_items(spark, sf_dir), done).select("id")


@query("dedup_first", f"""SELECT min(doc_id) AS doc_id, md5({strip_sql('text')}) AS text_md5, count(*) AS n_copies
FROM documents WHERE text IS NOT NULL GROUP BY {strip_sql('text')}""")
def q_dedup_first(spark, sf_dir):
    from ..functions.text import py_strip
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    d = d.select("doc_id", py_strip("text").alias("stext"))
    out = K.dedup_first(d, ["stext"], ["doc_id"])
    return out.select("doc_id", F.md5("stext").alias("text_md5"), "n_copies")


@query("dedup_responses", f"""WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos,
         CASE WHEN n_chars % 2 = 0 THEN source ELSE '' END AS original_paragraph
  FROM documents),
ok AS (SELECT doc_id, pos, {strip_sql('line')} AS response, original_paragraph FROM lines
       WHERE line IS NOT NULL AND {strip_sql('line')} <> '')
SELECT response, arg_min(doc_id, (doc_id, pos)) AS doc_id, CAST(arg_min(pos, (doc_id, pos)) AS INTEGER) AS pos,
       arg_min(original_paragraph, (doc_id, pos)) AS original_paragraph, count(*) AS n_copies
FROM ok GROUP BY response""")
def q_dedup_responses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    original = F.when(F.col("n_chars") % 2 == 0, F.to_json(F.struct(F.col("source").alias("paragraph")))).otherwise(
        F.lit("plain"))
    raw = d.select("doc_id", F.split("text", "\n").alias("responses"), original.alias("original"))
    ex = K.explode_responses(raw, "responses", "doc_id", "original").withColumnRenamed("ord", "doc_id")
    out = K.dedup_first(ex.select("response", "doc_id", "pos", "original_paragraph"), ["response"], ["doc_id", "pos"])
    return out.select("response", "doc_id", "pos", "original_paragraph", "n_copies")


# ---------------------------------------------------------------------------------
# Corpus -> context -> stratified sample -> length band -> few-shot prompts
# ---------------------------------------------------------------------------------
from ..operators import corpus as CP  # noqa: E402

N_SAMPLES = 12000
FEWSHOT_K = 3
SRC_LABEL, TGT_LABEL = "English", "Danish"


def doc_sentences(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    arts = d.select("doc_id", "lang", CP.doc_lines("text").alias("lines"))
    return CP.sentences_with_context(arts, "doc_id", "lines", keep=["lang"])


def sampled_sentences(spark, sf_dir) -> DataFrame:
    return CP.stratified_sample(doc_sentences(spark, sf_dir), "lang", "doc_id", N_SAMPLES, ["doc_id", "pos"], SEED)


def banded(spark, sf_dir) -> DataFrame:
    return CP.length_band(CP.with_paragraph(sampled_sentences(spark, sf_dir)))


CORPUS_SQL = f"""WITH docs AS (
  SELECT doc_id, lang, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS arr FROM documents WHERE text IS NOT NULL),
sent AS (SELECT doc_id, lang, arr, unnest(range(len(arr))) AS pos, unnest(arr) AS sentence FROM docs),
ctx AS (
  SELECT doc_id, lang, CAST(pos AS INTEGER) AS pos, sentence,
         CASE WHEN pos > 0 THEN arr[pos] END AS prev_sentence,
         CASE WHEN pos + 1 < len(arr) THEN arr[pos + 2] END AS next_sentence
  FROM sent),
ctxp AS (
  SELECT *, {strip_sql("concat_ws(' ', nullif(prev_sentence, ''), sentence, nullif(next_sentence, ''))")} AS paragraph
  FROM ctx),
pf AS (SELECT lang, count(DISTINCT doc_id) AS groups FROM ctx GROUP BY lang),
nf AS (SELECT count(*) AS files FROM pf),
qt AS (SELECT lang, greatest(1, floor(floor({N_SAMPLES} / files) / groups)) AS q FROM pf, nf),
smp AS (
  SELECT c.*, qt.q, row_number() OVER (PARTITION BY c.lang, c.doc_id
                                       ORDER BY {md5_key_sql('c.doc_id', 'c.pos', seed=SEED)}, c.doc_id, c.pos) AS rn
  FROM ctxp c JOIN qt USING (lang)),
sampled AS (SELECT *, CAST(length(paragraph) AS INTEGER) AS lenght FROM smp WHERE rn <= q),
bounds AS (SELECT quantile_cont(lenght, 0.02) AS lo, quantile_cont(lenght, 0.98) AS hi FROM sampled),
band AS (SELECT s.* FROM sampled s, bounds b WHERE s.lenght > b.lo AND s.lenght < b.hi),
al AS (SELECT u.conv_id, u.text AS src, a.text AS tgt FROM conversations u JOIN conversations a
       ON u.conv_id = a.conv_id AND u.turn = 0 AND a.turn = 1),
fs AS (
  SELECT {sql_literal(CP.FEWSHOT_HEADER.format(source_label=SRC_LABEL, target_label=TGT_LABEL))}
         || string_agg({sql_literal(SRC_LABEL + ': ')} || src || chr(10) || {sql_literal(TGT_LABEL + ': ')} || tgt
                       || chr(10) || chr(10), '' ORDER BY conv_id) AS fewshot
  FROM (SELECT * FROM al ORDER BY conv_id LIMIT {FEWSHOT_K}))
"""


@query("context_paragraphs", CORPUS_SQL + "SELECT doc_id, pos, prev_sentence, next_sentence, paragraph FROM ctxp")
def q_context_paragraphs(spark, sf_dir):
    return CP.with_paragraph(doc_sentences(spark, sf_dir)).select("doc_id", "pos", "prev_sentence", "next_sentence",
                                                                  "paragraph")


@query("stratified_sample", CORPUS_SQL + "SELECT doc_id, pos, sentence FROM sampled")
def q_stratified_sample(spark, sf_dir):
    return sampled_sentences(spark, sf_dir).select("doc_id", "pos", "sentence")


@query("length_band", CORPUS_SQL + "SELECT doc_id, pos, lenght FROM band")
def q_length_band(spark, sf_dir):
    return banded(spark, sf_dir).select("doc_id", "pos", "lenght")


@query("sampled_prompts", CORPUS_SQL + f"""SELECT doc_id, pos, paragraph,
  fewshot || {sql_literal(SRC_LABEL + ': ')} || paragraph || chr(10) || {sql_literal(TGT_LABEL + ': ')} AS prompt
FROM band, fs""")
def q_sampled_prompts(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations")
    u = conv.filter(F.col("turn") == 0).select("conv_id", F.col("text").alias("src"))
    a = conv.filter(F.col("turn") == 1).select("conv_id", F.col("text").alias("tgt"))
    header = CP.fewshot_header(u.join(a, "conv_id"), "src", "tgt", "conv_id", FEWSHOT_K, SRC_LABEL, TGT_LABEL)
    out = CP.translation_prompts(banded(spark, sf_dir), header, SRC_LABEL, TGT_LABEL)
    return out.select("doc_id", "pos", "paragraph", "prompt")


# ---------------------------------------------------------------------------------
# pairwise judging: pairs -> swap-debiased votes -> win/loss -> top-n -> human rank
# ---------------------------------------------------------------------------------
from ..operators import ranking as RK  # noqa: E402

VOTE_REPEAT = 2
# judge replies are picked by an md5 digit of (pair, repeat, side); the forms cover the
# vote rules: letters in any case/padding, tie words, free text and the winner tag
VOTE_REPLIES = ["A", " b ", "equal", "tie", "B", "a\n", "unclear", "<winner>b</winner>"]


def rating_pairs(spark, sf_dir, with_text: bool = True) -> DataFrame:
    items, _ = doc_items(spark, sf_dir)
    c = P.candidate_pairs(items, min_diff=0.0)
    text = (lambda col: F.col(col)) if with_text else (lambda col: F.lit(None).cast("string"))
    return c.select(F.concat_ws(":", "first_id", "second_id").alias("pair_id"),
                    F.col("group_key").alias("source_id"),
                    F.col("worse_id").alias("translation_id_1"), F.col("better_id").alias("translation_id_2"),
                    text("worse_sentence").alias("translation_1"), text("better_sentence").alias("translation_2"),
                    F.col("worse_score").alias("human_score_1"), F.col("better_score").alias("human_score_2"))


def _judge_reply(pair_id, rep, swapped) -> F.Column:
    h = F.md5(F.concat_ws("|", pair_id, rep.cast("string"), swapped.cast("string"), F.lit(str(SEED))))
    ix = F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % len(VOTE_REPLIES)
    return F.element_at(F.array(*[F.lit(x) for x in VOTE_REPLIES]), ix + 1)


def judge_votes(pairs: DataFrame, repeat: int = VOTE_REPEAT) -> DataFrame:
    """Long replies table (pair_id, repeat, swapped, response)."""
    combos = F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(s).alias("swapped"))
                       for r in range(1, repeat + 1) for s in (False, True)])
    v = pairs.select("pair_id", F.inline(combos))
    return v.withColumn("response", _judge_reply(F.col("pair_id"), F.col("repeat"), F.col("swapped")))


def judge_replies_inline(pairs: DataFrame, repeat: int = VOTE_REPEAT) -> DataFrame:
    """The same replies as an array on each pair row (how a scorer returns them)."""
    reps = [F.struct(F.lit(r).alias("repeat"), F.lit(s).alias("swapped"),
                     _judge_reply(F.col("pair_id"), F.lit(r), F.lit(s)).alias("response"))
            for r in range(1, repeat + 1) for s in (False, True)]
    return pairs.withColumn("replies", F.array(*reps))


def rated(spark, sf_dir, with_text: bool = False) -> DataFrame:
    """Rated pairs; pair texts are kept only when asked for."""
    pairs = rating_pairs(spark, sf_dir, with_text)
    return RK.pair_ratings_inline(judge_replies_inline(pairs), "replies", VOTE_REPEAT).drop("replies")


_REPLY_LIST_SQL = "[" + ", ".join(sql_literal(x).replace("\n", "' || chr(10) || '") for x in VOTE_REPLIES) + "]"
RANK_SQL = f"""WITH {ITEMS_SQL},
pr AS (
  SELECT a.id || ':' || b.id AS pair_id, a.group_key AS source_id,
         CASE WHEN a.score > b.score THEN b.id ELSE a.id END AS translation_id_1,
         CASE WHEN a.score > b.score THEN a.id ELSE b.id END AS translation_id_2,
         CASE WHEN a.score > b.score THEN b.sentence ELSE a.sentence END AS translation_1,
         CASE WHEN a.score > b.score THEN a.sentence ELSE b.sentence END AS translation_2,
         least(a.score, b.score) AS human_score_1, greatest(a.score, b.score) AS human_score_2
  FROM items a JOIN items b ON a.group_key = b.group_key AND a.ord < b.ord AND a.score <> b.score),
combos AS (SELECT * FROM (VALUES (1, false), (1, true), (2, false), (2, true)) c(rep, swapped)),
votes AS (
  SELECT pr.pair_id, c.rep, c.swapped,
         ({_REPLY_LIST_SQL})[{hexval_sql("substr(md5(concat_ws('|', pr.pair_id, CAST(c.rep AS VARCHAR), CAST(c.swapped AS VARCHAR), '42')), 1, 1)")} % 8 + 1] AS response
  FROM pr, combos c),
vn AS (
  SELECT pair_id, rep, swapped, response, lower({strip_sql("CASE WHEN regexp_matches(response, '(?is)<winner>.*?</winner>') THEN regexp_extract(response, '(?is)<winner>(.*?)</winner>', 1) ELSE response END")}) AS r
  FROM votes),
pts AS (
  SELECT pair_id,
         sum(CASE WHEN (r = 'b' AND NOT swapped) OR (r = 'a' AND swapped) THEN 1.0 WHEN r IN ('equal', 'tie') THEN 0.5 ELSE 0.0 END) AS corr
  FROM vn GROUP BY pair_id),
rated AS (
  SELECT pr.*, coalesce(pts.corr, 0.0) / {2.0 * VOTE_REPEAT} AS model_preference_score,
         coalesce(pts.corr, 0.0) / {2.0 * VOTE_REPEAT} > 0.5 AS model_agrees
  FROM pr LEFT JOIN pts USING (pair_id)),
sides AS (
  SELECT source_id, translation_id_1 AS translation_id, human_score_1 AS human_score,
         CASE WHEN model_agrees THEN 0 ELSE 1 END AS w, CASE WHEN model_agrees THEN 1 ELSE 0 END AS l FROM rated
  UNION ALL
  SELECT source_id, translation_id_2, human_score_2,
         CASE WHEN model_agrees THEN 1 ELSE 0 END, CASE WHEN model_agrees THEN 0 ELSE 1 END FROM rated),
wl AS (
  SELECT source_id, translation_id, sum(w) AS wins, sum(l) AS losses, any_value(human_score) AS human_score,
         CASE WHEN sum(w) + sum(l) > 0 THEN sum(w) / (sum(w) + sum(l)) ELSE 0.0 END AS fluency_score
  FROM sides GROUP BY 1, 2),
hr AS (
  SELECT source_id, human_score, dense_rank() OVER (PARTITION BY source_id ORDER BY human_score DESC) AS human_rank
  FROM (SELECT source_id, human_score_1 AS human_score FROM rated UNION SELECT source_id, human_score_2 FROM rated)),
best AS (
  SELECT wl.*, row_number() OVER (PARTITION BY source_id ORDER BY fluency_score DESC, translation_id) AS position FROM wl),
worst AS (
  SELECT wl.*, row_number() OVER (PARTITION BY source_id ORDER BY fluency_score ASC, translation_id) AS position FROM wl)
"""


@query("swap_vote", RANK_SQL + """SELECT pair_id, source_id, translation_id_1, translation_id_2,
  model_preference_score, model_agrees FROM rated""")
def q_swap_vote(spark, sf_dir):
    return rated(spark, sf_dir).select("pair_id", "source_id", "translation_id_1", "translation_id_2",
                                       "model_preference_score", "model_agrees")


@query("agreement", RANK_SQL + """SELECT s.source_id, round(r.rate, 9) AS agreement_rate, coalesce(r.n, 0) AS n_compared
FROM (SELECT DISTINCT group_key AS source_id FROM items) s
LEFT JOIN (SELECT source_id, avg(CASE WHEN model_agrees THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n
           FROM rated GROUP BY 1) r USING (source_id)""")
def q_agreement(spark, sf_dir):
    items, _ = doc_items(spark, sf_dir)
    sources = items.select(F.col("group_key").alias("source_id")).distinct()
    a = RK.agreement_by_source(rated(spark, sf_dir), sources)
    return a.select("source_id", R9(F.col("agreement_rate")).alias("agreement_rate"), "n_compared")


@query("win_loss", RANK_SQL + """SELECT source_id, translation_id, CAST(wins AS BIGINT) AS wins,
  CAST(losses AS BIGINT) AS losses, round(fluency_score, 9) AS fluency_score, human_score FROM wl""")
def q_win_loss(spark, sf_dir):
    w = RK.win_loss(rated(spark, sf_dir))
    return w.select("source_id", "translation_id", "wins", "losses", R9(F.col("fluency_score")).alias("fluency_score"),
                    "human_score")


@query("top_n_rank", RANK_SQL + """SELECT b.source_id, b.translation_id, CAST(b.position AS INTEGER) AS position,
  CAST(hr.human_rank AS INTEGER) AS human_rank
FROM best b LEFT JOIN hr ON b.source_id = hr.source_id AND b.human_score = hr.human_score WHERE b.position <= 3""")
def q_top_n_rank(spark, sf_dir):
    ranks = RK.item_ranks(doc_items(spark, sf_dir)[0])
    t = RK.top_n_human_rank(RK.win_loss(rated(spark, sf_dir)), ranks, 3, best=True)
    return t.select("source_id", "translation_id", "position", "human_rank")


@query("bottom_n_rank", RANK_SQL + """SELECT b.source_id, b.translation_id, CAST(b.position AS INTEGER) AS position,
  CAST(hr.human_rank AS INTEGER) AS human_rank
FROM worst b LEFT JOIN hr ON b.source_id = hr.source_id AND b.human_score = hr.human_score WHERE b.position <= 3""")
def q_bottom_n_rank(spark, sf_dir):
    ranks = RK.item_ranks(doc_items(spark, sf_dir)[0])
    t = RK.top_n_human_rank(RK.win_loss(rated(spark, sf_dir)), ranks, 3, best=False)
    return t.select("source_id", "translation_id", "position", "human_rank")


@query("rank_histogram", RANK_SQL + """,
top1 AS (SELECT hr.human_rank FROM best b JOIN hr ON b.source_id = hr.source_id AND b.human_score = hr.human_score
         WHERE b.position = 1)
SELECT CAST(g.v AS INTEGER) AS value, coalesce(c.n, 0) AS n FROM range(1, 6) g(v)
LEFT JOIN (SELECT human_rank AS v, count(*) AS n FROM top1 WHERE human_rank BETWEEN 1 AND 5 GROUP BY 1) c USING (v)""")
def q_rank_histogram(spark, sf_dir):
    ranks = RK.item_ranks(doc_items(spark, sf_dir)[0])
    t = RK.top_n_human_rank(RK.win_loss(rated(spark, sf_dir)), ranks, 1, best=True)
    return M.integer_histogram(t, "human_rank", 1, 5)


@query("three_way_verdict", RANK_SQL + """SELECT pair_id, CASE WHEN corr > trans THEN 'better' WHEN trans > corr THEN 'worse'
  ELSE 'equal' END AS verdict
FROM (SELECT pair_id,
        sum(CASE WHEN (lower(trim(response, {ws})) = 'b' AND NOT swapped) OR (lower(trim(response, {ws})) = 'a' AND swapped) THEN 1.0
                 WHEN lower(trim(response, {ws})) = 'equal' THEN 0.5 ELSE 0.0 END) AS corr,
        sum(CASE WHEN (lower(trim(response, {ws})) = 'a' AND NOT swapped) OR (lower(trim(response, {ws})) = 'b' AND swapped) THEN 1.0
                 WHEN lower(trim(response, {ws})) = 'equal' THEN 0.5 ELSE 0.0 END) AS trans
      FROM votes GROUP BY pair_id)""".replace("{ws}", WS_SQL))
def q_three_way_verdict(spark, sf_dir):
    return RK.three_way_verdict(judge_votes(rating_pairs(spark, sf_dir, with_text=False)))


# ---------------------------------------------------------------------------------
# overlap scores: assistant turns against the user turns of their conversation
# ---------------------------------------------------------------------------------
from ..operators import overlap as OV  # noqa: E402
from .sqltext import WS_RE2  # noqa: E402


def conv_sides(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    hyps = c.filter(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("hyp_turn"), "text")
    refs = c.filter(F.col("role") == "user").select("conv_id", F.col("turn").alias("ref_turn"), "text")
    return hyps, refs


OVERLAP_SQL = f"""WITH conv AS (
  SELECT conv_id, turn, role, text, regexp_replace(text, {sql_literal(WS_RE2)}, '', 'g') AS s,
         list_filter(regexp_split_to_array({strip_sql('text')}, {sql_literal(WS_RE2 + '+')}), lambda x: x <> '') AS toks
  FROM conversations WHERE text IS NOT NULL),
hyp AS (SELECT conv_id, turn AS hyp_turn, s, toks FROM conv WHERE role = 'assistant'),
ref AS (SELECT conv_id, turn AS ref_turn, s, toks FROM conv WHERE role = 'user'),
hg0 AS (SELECT conv_id, hyp_turn, n, s, unnest(range(1, length(s) - n + 2)) AS i FROM hyp, range(1, 7) o(n)),
hg AS (SELECT conv_id, hyp_turn, n, substr(s, i, n) AS g, count(*) AS c FROM hg0 GROUP BY ALL),
rg0 AS (SELECT conv_id, ref_turn, n, s, unnest(range(1, length(s) - n + 2)) AS i FROM ref, range(1, 7) o(n)),
rg AS (SELECT conv_id, ref_turn, n, substr(s, i, n) AS g, count(*) AS rc FROM rg0 GROUP BY ALL),
mt AS (SELECT hg.conv_id, hyp_turn, ref_turn, hg.n, sum(least(c, rc)) AS m FROM hg JOIN rg
       ON hg.conv_id = rg.conv_id AND hg.n = rg.n AND hg.g = rg.g GROUP BY ALL),
ht AS (SELECT conv_id, hyp_turn, n, sum(c) AS ht FROM hg GROUP BY ALL),
rt AS (SELECT conv_id, ref_turn, n, sum(rc) AS rt FROM rg GROUP BY ALL),
grid AS (SELECT ht.conv_id, ht.hyp_turn, rt.ref_turn, ht.n, ht.ht, rt.rt, CAST(coalesce(mt.m, 0) AS DOUBLE) AS m
         FROM ht JOIN rt ON ht.conv_id = rt.conv_id AND ht.n = rt.n
         LEFT JOIN mt ON mt.conv_id = ht.conv_id AND mt.hyp_turn = ht.hyp_turn AND mt.ref_turn = rt.ref_turn AND mt.n = ht.n),
pf AS (SELECT *, m / ht AS p, m / rt AS r FROM grid),
perref AS (SELECT conv_id, hyp_turn, ref_turn,
                  avg(CASE WHEN p + r > 0 THEN (1 + {OV.BETA ** 2}) * p * r / ({OV.BETA ** 2} * p + r) ELSE 0.0 END) * 100 AS score
           FROM pf GROUP BY ALL),
chrf AS (SELECT h.conv_id, h.hyp_turn, coalesce(b.best, 0.0) AS chrf FROM (SELECT DISTINCT conv_id, hyp_turn FROM hyp) h
         LEFT JOIN (SELECT conv_id, hyp_turn, max(score) AS best FROM perref GROUP BY ALL) b USING (conv_id, hyp_turn)),
wg0 AS (SELECT conv_id, hyp_turn, n, toks, unnest(range(1, len(toks) - n + 2)) AS i FROM hyp, range(1, 5) o(n)),
wg AS (SELECT conv_id, hyp_turn, n, array_to_string(toks[i:i + n - 1], ' ') AS g, count(*) AS c FROM wg0 GROUP BY ALL),
wr0 AS (SELECT conv_id, ref_turn, n, toks, unnest(range(1, len(toks) - n + 2)) AS i FROM ref, range(1, 5) o(n)),
wr AS (SELECT conv_id, n, g, max(c) AS rc FROM (
         SELECT conv_id, ref_turn, n, array_to_string(toks[i:i + n - 1], ' ') AS g, count(*) AS c FROM wr0 GROUP BY ALL)
       GROUP BY ALL),
wm AS (SELECT wg.conv_id, hyp_turn, wg.n, sum(least(c, rc)) AS m FROM wg JOIN wr
       ON wg.conv_id = wr.conv_id AND wg.n = wr.n AND wg.g = wr.g GROUP BY ALL),
hl AS (SELECT conv_id, hyp_turn, len(toks) AS hlen FROM hyp),
rl AS (SELECT conv_id, len(toks) AS rlen FROM ref),
cl AS (SELECT hl.conv_id, hl.hyp_turn, arg_min(rl.rlen, (abs(rl.rlen - hl.hlen), rl.rlen)) AS rlen
       FROM hl JOIN rl ON hl.conv_id = rl.conv_id GROUP BY ALL),
pn AS (SELECT hl.conv_id, hl.hyp_turn, hl.hlen, o.n, greatest(hl.hlen - o.n + 1, 0) AS t,
              CAST(coalesce(wm.m, 0) AS DOUBLE) AS m
       FROM hl CROSS JOIN range(1, 5) o(n)
       LEFT JOIN wm ON wm.conv_id = hl.conv_id AND wm.hyp_turn = hl.hyp_turn AND wm.n = o.n),
pa AS (SELECT conv_id, hyp_turn, hlen, sum(CASE WHEN n = 1 THEN m END) AS m1,
              sum(ln(CASE WHEN n = 1 THEN (CASE WHEN t > 0 AND m > 0 THEN m / t END) ELSE (m + 1) / (t + 1) END)) AS logsum
       FROM pn GROUP BY ALL),
wscore AS (SELECT pa.conv_id, pa.hyp_turn,
                  CASE WHEN pa.hlen = 0 OR pa.m1 = 0 OR cl.rlen IS NULL THEN 0.0
                       ELSE 100 * (CASE WHEN CAST(pa.hlen AS DOUBLE) > cl.rlen THEN 1.0 ELSE exp(1 - CAST(cl.rlen AS DOUBLE) / pa.hlen) END)
                            * exp(pa.logsum / 4) END AS score
           FROM pa LEFT JOIN cl USING (conv_id, hyp_turn))
"""


def chrf_frame(spark, sf_dir) -> DataFrame:
    hyps, refs = conv_sides(spark, sf_dir)
    return OV.char_f_score(hyps, refs, "conv_id", "hyp_turn", "ref_turn")


@query("char_ngram_f", OVERLAP_SQL + "SELECT conv_id, hyp_turn, round(chrf, 9) AS chrf FROM chrf")
def q_char_ngram_f(spark, sf_dir):
    return chrf_frame(spark, sf_dir).select("conv_id", "hyp_turn", R9(F.col("chrf")).alias("chrf"))


@query("word_ngram_score", OVERLAP_SQL + "SELECT conv_id, hyp_turn, round(score, 9) AS score FROM wscore")
def q_word_ngram_score(spark, sf_dir):
    hyps, refs = conv_sides(spark, sf_dir)
    w = OV.word_ngram_score(hyps, refs, "conv_id", "hyp_turn", "ref_turn")
    return w.select("conv_id", "hyp_turn", R9(F.col("score")).alias("score"))


@query("overlap_gain", OVERLAP_SQL + """SELECT conv_id,
  round(((100 - base) - (100 - new)) / nullif(100 - base, 0), 9) AS error_reduction
FROM (SELECT conv_id, arg_min(chrf, hyp_turn) AS base, arg_max(chrf, hyp_turn) AS new FROM chrf GROUP BY conv_id)""")
def q_overlap_gain(spark, sf_dir):
    c = chrf_frame(spark, sf_dir)
    g = c.groupBy("conv_id").agg(F.min_by("chrf", "hyp_turn").alias("base"), F.max_by("chrf", "hyp_turn").alias("new"))
    return g.select("conv_id", R9(OV.error_reduction("base", "new")).alias("error_reduction"))


# Each benchmark item against the next one, the last against the first. The oracle walks the
# distance matrix row by row over code points (DuckDB's own levenshtein counts bytes): within
# row i, d[j] = min over k <= j of (cost of coming from above at k) + (j - k).
EDIT_SQL = """WITH RECURSIVE b AS (
  SELECT item_id, text AS a, coalesce(lead(text) OVER (ORDER BY item_id), first_value(text) OVER (ORDER BY item_id)) AS z FROM benchmark),
walk(item_id, a, z, i, d) AS (
  SELECT item_id, a, z, 0, range(length(z) + 1) FROM b
  UNION ALL
  SELECT item_id, a, z, i + 1, (
    SELECT list(m + j ORDER BY j) FROM (
      SELECT j, min(c - j) OVER (ORDER BY j ROWS UNBOUNDED PRECEDING) AS m FROM (
        SELECT j, CASE WHEN j = 0 THEN i + 1 ELSE least(d[j + 1] + 1, d[j] + CASE WHEN substr(z, j, 1) = substr(a, i + 1, 1) THEN 0 ELSE 1 END) END AS c
        FROM (SELECT unnest(range(length(z) + 1)) AS j))))
  FROM walk WHERE i < length(a))
SELECT item_id, CAST(d[length(z) + 1] AS INTEGER) AS distance FROM walk WHERE i = length(a)"""


@query("edit_distance", EDIT_SQL)
def q_edit_distance(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    order = b.select("item_id", "text")
    ids = global_rank(b.select("item_id"), ["item_id"], "_r")
    n = ids.agg(F.max("_r").alias("_n"))
    nxt = order.join(ids, "item_id").select(F.col("text").alias("next_text"), F.col("_r").alias("_nr"))
    own = order.join(ids, "item_id").crossJoin(F.broadcast(n))  # one row
    j = own.withColumn("_nr", F.col("_r") % F.col("_n") + 1).join(nxt, "_nr")
    return j.select("item_id", OV.edit_distance("text", "next_text").cast("int").alias("distance"))


# ---------------------------------------------------------------------------------
# rating job: score-form prompts and replies (X6 score kind, X7, X9)
# ---------------------------------------------------------------------------------
SCORE_INSTRUCTION = "Rate the fluency of each response from 1 to 5.\n\n"


def score_members(spark, sf_dir) -> DataFrame:
    p = packed_items(spark, sf_dir)
    return p.select("batch_id", "position", F.col("id").alias("doc_id"), F.col("text").alias("sentence"),
                    F.concat_ws("-", F.col("batch_id"), F.col("position").cast("string")).alias("response_id"))


def _score_piece(rid: F.Column, text: F.Column) -> F.Column:
    d = F.substring(F.md5(rid), 1, 1)
    s = (F.lit(1) + F.length(text) % 5).cast("string")
    tag = lambda a, b: F.concat(F.lit("<" + a), rid, F.lit(b))
    normal = F.concat(tag("id", "><score>"), s, F.lit("</score></id"), rid, F.lit(">\n"), text, F.lit("\n\n"))
    bold = F.concat(tag("id", "><score>"), s, F.lit("</score></id"), rid, F.lit(">\n**Rationale:** "), text,
                    F.lit("\n\n"))
    upper = F.concat(tag("ID", "><SCORE>"), s, F.lit("</SCORE></ID"), rid, F.lit(">\n"), text, F.lit("\n"))
    short = F.concat(tag("id", ">"), s, F.lit("</id"), rid, F.lit(">\n"))
    unclosed = F.concat(tag("id", "><score>"), s, F.lit("</score>\n"))
    invalid = F.concat(tag("id", "><score>6</score></id"), rid, F.lit(">\n"))
    return (F.when(d.isin(*"01234567"), normal).when(d.isin("8", "9"), bold).when(d.isin("a", "b"), upper)
             .when(d == "c", short).when(d == "d", unclosed).when(d == "e", invalid).otherwise(F.lit("")))


def score_replies(spark, sf_dir) -> DataFrame:
    m = score_members(spark, sf_dir)
    per = m.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("position", "response_id", "sentence"))).alias("ms"))
    reply = F.array_join(F.transform("ms", lambda x: _score_piece(x["response_id"], x["sentence"])), "")
    return per.filter(F.substring(F.md5("batch_id"), 1, 1) != "0").select("batch_id", reply.alias("response"))


SCORE_REPLY_SQL = PACK_SQL + """,
mem AS (SELECT batch_id, position, id AS doc_id, text AS sentence,
               batch_id || '-' || CAST(position AS VARCHAR) AS response_id FROM packed),
pieces AS (SELECT *, substr(md5(response_id), 1, 1) AS d, CAST(1 + length(sentence) % 5 AS VARCHAR) AS s FROM mem),
replies AS (
  SELECT batch_id, string_agg(CASE
      WHEN d IN ('0','1','2','3','4','5','6','7') THEN '<id' || response_id || '><score>' || s || '</score></id' || response_id || '>' || chr(10) || sentence || chr(10) || chr(10)
      WHEN d IN ('8','9') THEN '<id' || response_id || '><score>' || s || '</score></id' || response_id || '>' || chr(10) || '**Rationale:** ' || sentence || chr(10) || chr(10)
      WHEN d IN ('a','b') THEN '<ID' || response_id || '><SCORE>' || s || '</SCORE></ID' || response_id || '>' || chr(10) || sentence || chr(10)
      WHEN d = 'c' THEN '<id' || response_id || '>' || s || '</id' || response_id || '>' || chr(10)
      WHEN d = 'd' THEN '<id' || response_id || '><score>' || s || '</score>' || chr(10)
      WHEN d = 'e' THEN '<id' || response_id || '><score>6</score></id' || response_id || '>' || chr(10)
      ELSE '' END, '' ORDER BY position) AS response
  FROM pieces WHERE substr(md5(batch_id), 1, 1) <> '0' GROUP BY batch_id),
j AS (
  SELECT m.*, r.response, r.batch_id IS NOT NULL AS has_reply,
         '(?is)<id\\Q' || m.response_id || '\\E><score>([1-5])</score></id\\Q' || m.response_id || '\\E>(.*)' AS main_pat,
         '(?i)<id\\Q' || m.response_id || '\\E><score>([1-5])</score>' AS fb1,
         '(?i)<id\\Q' || m.response_id || '\\E>([1-5])</id[^>]*>' AS fb2
  FROM mem m LEFT JOIN replies r USING (batch_id)),
j2 AS (
  SELECT *, regexp_matches(response, main_pat) AS has_main,
         regexp_replace(regexp_extract(response, main_pat, 2), '(?is)<id\\d+(?:-\\d+)*><score>.*', '') AS rest,
         CAST(CASE WHEN regexp_matches(response, main_pat) THEN regexp_extract(response, main_pat, 1)
                   WHEN regexp_matches(response, fb1) THEN regexp_extract(response, fb1, 1)
                   WHEN regexp_matches(response, fb2) THEN regexp_extract(response, fb2, 1) END AS INTEGER) AS score
  FROM j),
j3 AS (
  SELECT *, trim(regexp_replace(regexp_replace(trim(rest, WSX), '(?i)^\\*\\*Rationale:\\*\\*\\s*', ''), '\\*\\*(.*?)\\*\\*', '\\1', 'g'), WSX) AS rat
  FROM j2)
""".replace("WSX", WS_SQL)


@query("parse_score_tags", SCORE_REPLY_SQL + """SELECT response_id, doc_id,
  CASE WHEN has_reply THEN score END AS fluency_score,
  CASE WHEN NOT has_reply THEN 'Error during processing'
       WHEN has_main THEN (CASE WHEN length(rat) > 200 THEN substr(rat, 1, 200) || '...' ELSE rat END)
       WHEN score IS NOT NULL THEN 'No rationale' ELSE '' END AS reason
FROM j3""")
def q_parse_score_tags(spark, sf_dir):
    r = RP.parse_score_results(score_members(spark, sf_dir), score_replies(spark, sf_dir))
    return r.select("response_id", "doc_id", "fluency_score", "reason")


@query("score_prompts", PACK_SQL + f""",
mem AS (SELECT batch_id, position, text, batch_id || '-' || CAST(position AS VARCHAR) AS rid FROM packed)
SELECT batch_id, {sql_literal(SCORE_INSTRUCTION)}
  || string_agg('<id' || rid || '>' || text || '</id' || rid || '>' || chr(10), '' ORDER BY position)
  || {sql_literal(K.SCORE_FORMAT_HEADER)}
  || string_agg('<id' || rid || '><score>[1-5]</score></id' || rid || '>' || chr(10) || '[Brief rationale]' || chr(10) || chr(10), '' ORDER BY position)
  AS prompt
FROM mem GROUP BY batch_id""")
def q_score_prompts(spark, sf_dir):
    return K.batch_prompts(packed_items(spark, sf_dir), SCORE_INSTRUCTION, "score").select("batch_id", "prompt")


# ---------------------------------------------------------------------------------
# smaller operators on the driver tables
# ---------------------------------------------------------------------------------
from ..functions import text as TX  # noqa: E402
from ..operators.lookup import any_column_lookup  # noqa: E402
from ..operators.ordering import first_n  # noqa: E402
from ..sources.io import nested_section  # noqa: E402


@query("nested_section", """SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, prompt FROM (
  SELECT doc_id, unnest(range(len(arr))) AS line_no, unnest(arr) AS prompt
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS arr
        FROM documents WHERE lang = 'en' AND text IS NOT NULL))""")
def q_nested_section(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    lines = CP.doc_lines("text")
    items = F.transform(lines, lambda x, i: F.struct(F.col("doc_id").alias("doc_id"), i.alias("line_no"), x.alias("prompt")))
    empty = F.array().cast("array<struct<doc_id:bigint,line_no:int,prompt:string>>")
    nested = d.select(F.array(F.struct(F.col("lang").alias("language"), items.alias("items")),
                              F.struct(F.lit("zz").alias("language"), empty.alias("items"))).alias("languages"))
    return nested_section(nested, "en").select("doc_id", "line_no", "prompt")


@query("page_titles", f"""SELECT page_id,
  nullif({strip_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")}, '') AS title FROM pages""")
def q_page_titles(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", TX.first_tag_text("html", "title").alias("title"))


@query("quoted_text", f"""WITH d AS (
  SELECT doc_id, text, strpos(text, '"') AS first, length(text) - strpos(reverse(text), '"') + 1 AS last,
         length(text) - strpos(reverse(text), ':') + 1 AS colon FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN first > 0 AND last <> first THEN substr(text, first + 1, last - first - 1)
                    WHEN strpos(text, ':') > 0 THEN trim({strip_sql('substr(text, colon + 1)')}, '"')
                    ELSE text END AS extracted FROM d""")
def q_quoted_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    return d.select("doc_id", TX.quoted_text("text").alias("extracted"))


@query("score_forms", f"""SELECT doc_id,
  TRY_CAST({strip_sql("split_part(CAST(quality * 4 + 1 AS VARCHAR) || '/5', '/', 1)")} AS INTEGER) AS direct_score,
  TRY_CAST({strip_sql("split_part(list_last(string_split('Score: ' || CAST(toxic + 2 AS VARCHAR) || '/5', ' ')), '/', 1)")} AS INTEGER) AS last_token_score,
  TRY_CAST(CASE WHEN toxic = 1 THEN 'n/a' ELSE '3.5' END AS DOUBLE) AS numeric_score,
  coalesce(TRY_CAST(CASE WHEN toxic = 1 THEN 'n/a' ELSE '3.5' END AS DOUBLE), 0.0) AS numeric_or_zero
FROM labels""")
def q_score_forms(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    s1 = F.concat((F.col("quality") * 4 + 1).cast("string"), F.lit("/5"))
    s2 = F.concat(F.lit("Score: "), (F.col("toxic") + 2).cast("string"), F.lit("/5"))
    s3 = F.when(F.col("toxic") == 1, "n/a").otherwise("3.5")
    return lab.select("doc_id", TX.score_before_slash(s1).alias("direct_score"),
                      TX.score_last_token_before_slash(s2).alias("last_token_score"),
                      TX.to_number(s3).alias("numeric_score"), TX.to_number(s3, True).alias("numeric_or_zero"))


LOOKUP_DIM_SQL = """dim AS (
  SELECT n_nationkey AS ord, n_name AS res, n_name AS c1, 'src' || CAST(n_regionkey * 4 AS VARCHAR) AS c2,
         'src' || CAST(n_nationkey AS VARCHAR) AS c3 FROM nation),
long AS (SELECT c1 AS v, 0 AS pos, ord, res FROM dim UNION ALL SELECT c2, 1, ord, res FROM dim
         UNION ALL SELECT c3, 2, ord, res FROM dim)"""


@query("any_column_lookup", f"""WITH {LOOKUP_DIM_SQL},
best AS (SELECT v, arg_min(res, (pos, ord)) AS res FROM long WHERE v IS NOT NULL GROUP BY v),
vals AS (SELECT DISTINCT source AS value FROM documents UNION SELECT DISTINCT lang FROM documents)
SELECT value, coalesce(best.res, '') AS match FROM vals LEFT JOIN best ON vals.value = best.v""")
def q_any_column_lookup(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    dim = n.select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("res"), F.col("n_name").alias("c1"),
                   F.concat(F.lit("src"), (F.col("n_regionkey") * 4).cast("string")).alias("c2"),
                   F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("c3"))
    d = table(spark, sf_dir, "documents")
    vals = d.select(F.col("source").alias("value")).union(d.select("lang")).distinct()
    return any_column_lookup(vals, "value", dim, ["c1", "c2", "c3"], "ord", "res", "match").select("value", "match")


@query("top_items", """SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25""")
def q_top_items(spark, sf_dir):
    return first_n(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 25)


@query("longest_candidates", """WITH top AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL
                                  ORDER BY length(text) DESC, doc_id LIMIT 15)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, candidate FROM (
  SELECT doc_id, unnest(range(len(arr))) AS pos, unnest(arr) AS candidate
  FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS arr FROM top))""")
def q_longest_candidates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter(F.col("text").isNotNull())
    top = first_n(d.select("doc_id", "text"), [F.length("text").desc(), F.col("doc_id")], 15)
    return top.select("doc_id", F.posexplode(CP.doc_lines("text")).alias("pos", "candidate"))


# ---------------------------------------------------------------------------------
# list-wise judging: winner index and ranking lists against human ranks
# ---------------------------------------------------------------------------------

def listwise(spark, sf_dir):
    items, _ = doc_items(spark, sf_dir)
    cand = items.select(F.col("group_key").alias("source_id"), F.col("id").alias("translation_id"),
                        F.col("score").alias("human_score"))
    cand = RK.candidate_positions(cand)
    ranks = (cand.select("source_id", "human_score").distinct()
                 .withColumn("human_rank", F.dense_rank().over(
                     Window.partitionBy("source_id").orderBy(F.col("human_score").desc()))))
    # one reply per source, derived from the source's md5 digits and its candidate count
    src = cand.select("source_id", "n_candidates").distinct()
    h = F.md5(F.concat_ws("|", "source_id", F.lit(str(SEED))))
    dig = lambda i: F.conv(F.substring(h, i, 1), 16, 10).cast("int")
    pos = lambda i: ((dig(i) % F.col("n_candidates")) + 1).cast("string")
    winner = F.when(dig(1) == 15, F.lit("no clear winner")).otherwise(
        F.concat(F.lit("<winner>"), pos(1), F.lit("</winner>")))
    rankings = F.concat(F.lit("<rankings>"), pos(2), F.lit(", "), pos(3), F.lit(","),
                        F.when(dig(4) == 0, F.lit("x")).otherwise(pos(4)), F.lit("</rankings>"))
    replies = src.select("source_id", winner.alias("winner_reply"), rankings.alias("ranking_reply"))
    return cand, ranks, replies


LISTWISE_SQL = f"""WITH {ITEMS_SQL},
cand AS (SELECT group_key AS source_id, id AS translation_id, score AS human_score,
                CAST(row_number() OVER (PARTITION BY group_key ORDER BY id) AS INTEGER) AS position,
                count(*) OVER (PARTITION BY group_key) AS n_candidates FROM items),
ranks AS (SELECT source_id, human_score, dense_rank() OVER (PARTITION BY source_id ORDER BY human_score DESC) AS human_rank
          FROM (SELECT DISTINCT source_id, human_score FROM cand)),
src AS (SELECT DISTINCT source_id, n_candidates, md5(source_id || '|{SEED}') AS h FROM cand),
dg AS (SELECT source_id, n_candidates,
              {hexval_sql('substr(h, 1, 1)')} AS d1, {hexval_sql('substr(h, 2, 1)')} AS d2,
              {hexval_sql('substr(h, 3, 1)')} AS d3, {hexval_sql('substr(h, 4, 1)')} AS d4 FROM src)
"""


@query("winner_rank", LISTWISE_SQL + """SELECT dg.source_id, CAST(d1 % dg.n_candidates + 1 AS INTEGER) AS position,
  c.translation_id, CAST(r.human_rank AS INTEGER) AS human_rank
FROM dg JOIN cand c ON c.source_id = dg.source_id AND c.position = d1 % dg.n_candidates + 1
LEFT JOIN ranks r ON r.source_id = c.source_id AND r.human_score = c.human_score
WHERE d1 <> 15""")
def q_winner_rank(spark, sf_dir):
    cand, ranks, replies = listwise(spark, sf_dir)
    w = RK.winner_rank(replies.select("source_id", F.col("winner_reply").alias("response")), cand, ranks)
    return w.select("source_id", "position", "translation_id", F.col("human_rank").cast("int").alias("human_rank"))


@query("ranking_list_ranks", LISTWISE_SQL + """,
lst AS (SELECT source_id, 1 AS list_pos, d2 % n_candidates + 1 AS position FROM dg
        UNION ALL SELECT source_id, 2, d3 % n_candidates + 1 FROM dg
        UNION ALL SELECT source_id, 3, CASE WHEN d4 = 0 THEN NULL ELSE d4 % n_candidates + 1 END FROM dg)
SELECT lst.source_id, CAST(lst.list_pos AS INTEGER) AS list_pos, CAST(lst.position AS INTEGER) AS position,
       c.translation_id, CAST(r.human_rank AS INTEGER) AS human_rank
FROM lst JOIN cand c ON c.source_id = lst.source_id AND c.position = lst.position
LEFT JOIN ranks r ON r.source_id = c.source_id AND r.human_score = c.human_score
WHERE lst.position IS NOT NULL""")
def q_ranking_list_ranks(spark, sf_dir):
    cand, ranks, replies = listwise(spark, sf_dir)
    r = RK.ranking_list_ranks(replies.select("source_id", F.col("ranking_reply").alias("response")), cand, ranks, n=3)
    return r.select("source_id", "list_pos", "position", "translation_id",
                    F.col("human_rank").cast("int").alias("human_rank"))


@query("mse_by_model", WIDE_SQL + """,
se AS (SELECT split_part(col, '_', 1) AS model, split_part(col, '_', 2) AS method,
              (CAST(w.m1_cot AS DOUBLE) - value) * (CAST(w.m1_cot AS DOUBLE) - value) AS squared_error
       FROM long JOIN wide w USING (doc_id) WHERE col <> 'm1_cot')
SELECT model, method, round(avg(squared_error), 9) AS mse, count(*) AS n,
       round(avg(squared_error) FILTER (WHERE squared_error > 0), 9) AS mse_disagreements
FROM se WHERE squared_error IS NOT NULL GROUP BY 1, 2""")
def q_mse_by_model(spark, sf_dir):
    w = wide_scores(spark, sf_dir)
    long = M.melt(w, ["doc_id", "m1_cot"], [c for c in MELT_COLS if c != "m1_cot"], "col", "value")
    long = long.select(F.split_part("col", F.lit("_"), F.lit(1)).alias("model"),
                       F.split_part("col", F.lit("_"), F.lit(2)).alias("method"), "m1_cot", "value")
    se = M.squared_errors(long, "m1_cot", "value")
    a = M.mse_by_model(se, ["model", "method"])
    b = M.mse_by_model(se, ["model", "method"], disagreements_only=True).select(
        "model", "method", F.col("mse").alias("mse_disagreements"))
    out = a.join(b, ["model", "method"], "left")
    return out.select("model", "method", R9(F.col("mse")).alias("mse"), "n",
                      R9(F.col("mse_disagreements")).alias("mse_disagreements"))


# ---------------------------------------------------------------------------------
# verdicts attached by index (J5, X30, X31), resume merge (J10), reference lists
# ---------------------------------------------------------------------------------
from ..operators.lookup import attach_answers  # noqa: E402


@query("verdict_match", """WITH v AS (SELECT doc_id AS idx, CASE WHEN quality = 1 THEN 'B' ELSE 'A' END AS winner FROM labels),
d AS (SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' THEN 'B' ELSE 'A' END AS expected FROM documents)
SELECT d.doc_id, d.expected, v.winner, (trim(v.winner, """ + WS_SQL + """) = d.expected) AS correct
FROM d LEFT JOIN v ON v.idx = d.doc_id""")
def q_verdict_match(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    verdicts = lab.select(F.col("doc_id").alias("idx"), F.when(F.col("quality") == 1, "B").otherwise("A").alias("winner"))
    d = table(spark, sf_dir, "documents").select(
        "doc_id", (F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "8").alias("edited_second"))
    d = d.withColumn("expected", V.edited_side("edited_second"))
    j = attach_answers(d, "doc_id", verdicts)
    return j.select("doc_id", "expected", "winner", V.verdict_matches("winner", F.col("expected")).alias("correct"))


@query("resume_merge", REPLY_SQL + """SELECT p.id, r.output, CASE WHEN r.output IS NULL THEN 'todo' ELSE 'done' END AS state
FROM (SELECT DISTINCT id FROM packed) p
LEFT JOIN (SELECT id, any_value(output) AS output FROM results WHERE output IS NOT NULL GROUP BY id) r USING (id)""")
def q_resume_merge(spark, sf_dir):
    items = task_items(spark, sf_dir).select("id").distinct()
    done, todo = RS.merge_previous(items, task_results(spark, sf_dir), "id", "output")
    return (done.withColumn("state", F.lit("done")).unionByName(todo.withColumn("state", F.lit("todo")))
                .select("id", "output", "state"))


@query("reference_lists", """WITH refs AS (SELECT DISTINCT conv_id AS source_id, text AS reference FROM conversations
                                 WHERE role = 'user' AND text IS NOT NULL),
tg AS (SELECT DISTINCT conv_id AS source_id, text AS target FROM conversations WHERE turn = 1 AND text IS NOT NULL)
SELECT source_id, reference FROM refs
UNION ALL
SELECT source_id, target FROM tg WHERE NOT EXISTS (SELECT 1 FROM refs WHERE refs.source_id = tg.source_id AND refs.reference = tg.target)""")
def q_reference_lists(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter(F.col("text").isNotNull())
    refs = c.filter(F.col("role") == "user").select(F.col("conv_id").alias("source_id"), F.col("text").alias("reference"))
    tg = c.filter(F.col("turn") == 1).select(F.col("conv_id").alias("source_id"), F.col("text").alias("target"))
    return RK.references_long(refs, tg).select("source_id", "reference")
