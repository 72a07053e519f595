"""Judge replies -> per-item results.

Replies are a table ``(batch_id, response)``; batches carry their expected ids. A reply is cut
into tags and the texts between them by two fixed patterns, each one pass; an id's block is looked
up among the tags, nested or not, so no pattern is built or searched for an id. Everything stays
inside JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_, py_strip

# --- fixed values: limits and default texts of the result rows ------------------------
REASON_LIMIT = 500
RATIONALE_LIMIT = 200
NO_REASON = "No reason provided"
NO_RATIONALE = "No rationale"
BATCH_ERROR = "Error during processing"
XML_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")]
# --- end of fixed values ------------------------------------------------------------


def _plain(c: Column) -> Column:
    """Text of an XML element: inner tags dropped, the five entities decoded (``&amp;`` last)."""
    c = F.regexp_replace(c, "<[^>]*>", "")
    for entity, char in XML_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _q(c: Column) -> Column:
    """quote an id for use inside a regex (\\Q..\\E works in Java and RE2)"""
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def _extract(text: Column, pattern: Column, idx: int) -> Column:
    # a per-row pattern: the Python helper only takes literal patterns
    return F.call_function("regexp_extract", text, pattern, F.lit(idx))


def _found(text: Column, pattern: Column) -> Column:
    return F.regexp_like(text, pattern)


def _cut(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


# every opening and closing id tag of a reply; names hold no angle brackets
ID_TAG = "</?id[^<>]+>"
# where a run of a score reply starts, the forms of its first tag, and a plain score
SCORE_START = "(?i)(?=<id[^<>]+><score>)"
SCORED = "(?i)^<id([^<>]+)><score>([1-5])</score>"
NUMBERED_SCORE = r"(?i)^<id\d+(?:-\d+)*><score>"
PLAIN = "(?i)<id([^<>]+)>([1-5])(?=</id[^>]*>)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _level1(block: Column) -> Column:
    """Structured form of a block: struct(output, reason); output null without ``<o>``."""
    has_o = F.regexp_like(block, F.lit("(?s)<o>.*?</o>"))
    has_r = F.regexp_like(block, F.lit("(?s)<reason>.*?</reason>"))
    o_text = py_strip(_plain(F.regexp_extract(block, "(?s)<o>(.*?)</o>", 1)))
    r_text = _cut(py_strip(_plain(F.regexp_extract(block, "(?s)<reason>(.*?)</reason>", 1))), REASON_LIMIT)
    return F.struct(F.when(has_o, o_text).alias("output"),
                    F.when(has_r, r_text).when(has_o, F.lit(NO_REASON)).alias("reason"))


def _level2(reply: Column, safe_id: Column) -> Column:
    """Strict form for one id: ``<idX><o>([^<]+)</o><reason>(.*?)</reason></idX>``, any case, dot-all."""
    qid = _q(safe_id)
    strict = F.concat(F.lit("(?is)<id"), qid, F.lit("><o>([^<]+)</o><reason>(.*?)</reason></id"), qid, F.lit(">"))
    found = _found(reply, strict)
    return F.struct(F.when(found, py_strip(_extract(reply, strict, 1))).alias("output"),
                    F.when(found, _cut(py_strip(_extract(reply, strict, 2)), REASON_LIMIT)).alias("reason"))


def _block(reply: Column, tags: Column, texts: Column, safe: Column) -> Column:
    """Text from an id's first opening tag to the first closing one after it; null without both.

    ``texts`` are the pieces between the ``tags``, one more than these: the block is what is joined
    of both between the two places.
    """
    start = F.array_position(tags, F.concat(F.lit("<id"), safe, F.lit(">"))).cast("int")
    rest = F.when(start > 0, F.slice(tags, start + 1, F.size(tags)))
    n = F.array_position(rest, F.concat(F.lit("</id"), safe, F.lit(">"))).cast("int")  # tags up to the closing one
    inner = F.array_join(F.zip_with(F.slice(texts, start + 1, n - 1), F.slice(tags, start + 1, n - 1), lambda t, g: F.concat(t, g)), "")
    found = F.when(n == 1, F.get(texts, start)).when(n > 1, F.concat(inner, F.get(texts, start + n - 1)))
    # a name with angle brackets is no tag: it is searched as a text
    pattern = F.concat(F.lit("(?s)<id"), _q(safe), F.lit(">(.*?)</id"), _q(safe), F.lit(">"))
    return F.when(F.regexp_like(safe, F.lit("[<>]")), F.when(_found(reply, pattern), _extract(reply, pattern, 1))).otherwise(found)


def parse_task_results(batches: DataFrame, replies: DataFrame) -> DataFrame:
    """X8 + X9: one result row per expected item: id, input, output, reason, model_name.

    ``batches``: batch_id, item_ids (tag-safe), original_ids, item_texts, model_name.
    ``replies``: batch_id, response (a batch without a reply row failed).

    Level 1 (structured): an item's first ``<idX>...</idX>`` block (tag names are case
    sensitive, like an XML parser), inside it the first ``<o>`` and ``<reason>``. Level 2 (strict)
    reads the replies in which some item has no output at level 1.
    """
    return task_results_of(batches.join(replies.select("batch_id", "response", F.lit(True).alias("has_reply")), "batch_id", "left"))


def task_results_of(joined: DataFrame) -> DataFrame:
    """The result rows of batches that carry their ``response`` and ``has_reply`` (null: failed); row by row, so it
    reads streams as well."""
    reply = F.col("response")
    j = joined.withColumn("_tags", F.regexp_extract_all(reply, F.lit(ID_TAG), F.lit(0)))
    j = j.withColumn("_texts", F.split(reply, ID_TAG, -1))
    j = j.withColumn("_found", F.transform("item_ids", lambda x: _block(reply, F.col("_tags"), F.col("_texts"), x)))
    j = j.withColumn("_l1", F.transform("_found", _level1))
    # two items under one tag-safe id (D18) can't be told apart: the batch goes to the fallback
    clear = F.size(F.array_distinct("item_ids")) == F.size("item_ids")
    j = j.withColumn("_level1", clear & F.forall("_l1", lambda x: x["output"].isNotNull()))
    j = j.withColumn("_result", F.when(F.col("_level1"), F.col("_l1")).otherwise(F.transform("item_ids", lambda x: _level2(reply, x))))
    members = F.arrays_zip(F.col("original_ids").alias("orig"), F.col("item_texts").alias("txt"), F.col("_result").alias("r"))
    ex = j.select("model_name", "has_reply", F.explode(members).alias("m"))
    failed = F.col("has_reply").isNull()
    return ex.select(F.col("m.orig").alias("id"), F.col("m.txt").alias("input"),
                     F.when(~failed, F.col("m.r.output")).cast("string").alias("output"),
                     F.when(failed, F.lit(BATCH_ERROR)).otherwise(F.coalesce("m.r.reason", F.lit(""))).alias("reason"), "model_name")


def _clean_rationale(raw: Column) -> Column:
    r = py_strip(raw)
    r = F.regexp_replace(r, r"(?iU)^\*\*Rationale:\*\*\s*", "")
    r = F.regexp_replace(r, r"(?d)\*\*(.*?)\*\*", "$1")
    return _cut(py_strip(r), RATIONALE_LIMIT)


def _ascii_lower(c: Column) -> Column:
    """A-Z as a-z, as the case-insensitive patterns have it."""
    return F.translate(c, UPPER, LOWER)


def reply_scores(replies: DataFrame) -> DataFrame:
    """X7 for all ids of a reply at once: (batch_id, key, score, rationale), one row an id that has a score.

    A reply is cut before each ``<idX><score>``; a run that closes its own id is of the main form, and its
    rationale goes on up to the next numbered score tag. Plain forms are found in one more pass. Of an
    id's places the first of the best form counts.
    """
    runs, numbered = F.col("_runs"), F.col("_numbered")
    r = replies.select("batch_id", "response", F.split("response", SCORE_START, -1).alias("_runs"))
    r = r.withColumn("_numbered", F.transform(runs, lambda x: F.regexp_like(x, F.lit(NUMBERED_SCORE))))

    def of_run(x: Column, i: Column) -> Column:
        main = F.lit(r"(?i)^<id([^<>]+)><score>[1-5]</score></id\1>")
        until = F.array_position(F.slice(numbered, i + 2, F.size(numbered)), True).cast("int")  # 0: no further one
        after = F.slice(runs, i + 2, F.when(until > 0, until - 1).otherwise(F.size(runs)))
        closed = F.regexp_like(x, main)
        rest = F.concat(F.regexp_replace(x, r"(?i)^<id([^<>]+)><score>[1-5]</score></id\1>", ""), F.array_join(after, ""))
        return F.struct(F.regexp_extract(x, SCORED, 1).alias("key"), F.when(closed, 0).otherwise(1).alias("form"), i.alias("at"),
                        F.nullif(F.regexp_extract(x, SCORED, 2), F.lit("")).cast("int").alias("score"),
                        F.when(closed, _clean_rationale(rest)).otherwise(F.lit(NO_RATIONALE)).alias("rationale"))

    plain = F.transform(F.arrays_zip(F.regexp_extract_all("response", F.lit(PLAIN), F.lit(1)).alias("k"),
                                     F.regexp_extract_all("response", F.lit(PLAIN), F.lit(2)).alias("s")),
                        lambda p, i: F.struct(p["k"].alias("key"), F.lit(2).alias("form"), i.alias("at"),
                                              p["s"].cast("int").alias("score"), F.lit(NO_RATIONALE).alias("rationale")))
    scored = F.filter(F.transform(runs, of_run), lambda x: x["score"].isNotNull())
    r = r.select("batch_id", F.inline(F.concat(scored, plain)))
    best = F.min_by(F.struct("score", "rationale"), F.struct("form", "at")).alias("_best")
    return r.groupBy("batch_id", _ascii_lower(F.col("key")).alias("_key")).agg(best).select("batch_id", "_key", "_best")


def parse_score_results(members: DataFrame, replies: DataFrame) -> DataFrame:
    """X7 + X9 on a long table: ``members`` = (batch_id, response_id, sentence, ...);
    ``replies`` = (batch_id, response). Failed batches give null score and the error text.
    Replies are parsed once each; members meet the scores, not the reply texts."""
    replied = replies.select("batch_id", F.lit(True).alias("_has_reply")).distinct()
    j = members.withColumn("_key", _ascii_lower(F.col("response_id")))
    j = j.join(reply_scores(replies), ["batch_id", "_key"], "left").join(replied, "batch_id", "left")
    failed = F.col("_has_reply").isNull()
    return (j.withColumn("fluency_score", F.col("_best.score"))
             .withColumn("reason", F.when(failed, F.lit(BATCH_ERROR)).otherwise(F.coalesce("_best.rationale", F.lit(""))))
             .select(*members.columns, "fluency_score", "reason"))


def parse_dict_reply(reply) -> Column:
    """A dict literal in a reply (maybe fenced) -> map<string,string>.

    Tries, in order: the text without code fences; the span from the first ``{`` to
    the first ``}``. Unquoted keys, single quotes, a comma before the closing brace and
    the literals ``None``, ``True`` and ``False`` as values are accepted. Null when both
    fail (route those rows to an error table).
    """
    r = col_(reply)
    opts = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}
    unfenced = py_strip(F.regexp_replace(F.regexp_replace(r, r"(?s)^\s*```[a-zA-Z]*", ""), r"(?s)```\s*$", ""))
    first_span = F.regexp_extract(r, r"(?s)(\{.*?\})", 1)

    def json(x: Column) -> Column:
        x = F.regexp_replace(x, r",\s*\}", "}")
        for literal, word in (("None", "null"), ("True", "true"), ("False", "false")):
            x = F.regexp_replace(x, rf"(:\s*){literal}(?=\s*[,}}])", f"$1{word}")
        return F.from_json(x, "map<string,string>", opts)

    return F.coalesce(json(unfenced), json(first_span))
