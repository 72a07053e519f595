"""Chat training records (F3, X23, A1, L8) and the pair -> chat rewrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.templates import apply_instruction
from ..functions.text import col_, py_strip
from .ordering import positional_split


def _falsy(c: Column, dtype: T.DataType) -> Column:
    """Python truthiness of a scalar input: '' / 0 / false / empty array or map."""
    if isinstance(dtype, T.StringType):
        return c.isNull() | (py_strip(c) == "")
    if isinstance(dtype, T.BooleanType):
        return c.isNull() | ~c
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(dtype, T.NumericType):
        return c.isNull() | (c == 0)
    return c.isNull()


def reject_reason(df: DataFrame, input_col: str, output_col: str,
                  input_present: str | None = None, output_present: str | None = None) -> Column:
    """why a row cannot become a chat record (null = keep).

    ``*_present`` name boolean columns that say whether the key exists at all (for
    tables built by a left join, or JSON read through VARIANT); without them a column
    is always present. Checks run in the reference's order: missing input, missing
    output, empty/falsy input, null output.
    """
    dtype = df.schema[input_col].dataType
    in_missing = ~F.col(input_present) if input_present else F.lit(False)
    out_missing = ~F.col(output_present) if output_present else F.lit(False)
    return (F.when(in_missing, "missing_input")
             .when(out_missing, "missing_output")
             .when(_falsy(F.col(input_col), dtype), "empty_input")
             .when(F.col(output_col).isNull(), "null_output"))


def chat_records(df: DataFrame, input_col: str, output_col: str, instruction: str,
                 input_present: str | None = None, output_present: str | None = None,
                 keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects). records: keep cols + user_content, assistant_content."""
    tagged = df.withColumn("reject_reason", reject_reason(df, input_col, output_col, input_present, output_present))
    good = tagged.filter(F.col("reject_reason").isNull())
    user = apply_instruction(instruction, py_strip(F.col(input_col).cast("string")))
    assistant = py_strip(F.col(output_col).cast("string"))
    records = good.select(*(keep or []), user.alias("user_content"), assistant.alias("assistant_content"))
    return records, tagged.filter(F.col("reject_reason").isNotNull())


def as_chat_messages(df: DataFrame, user="user_content", assistant="assistant_content") -> DataFrame:
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), col_(c).alias("content"))
    return df.select(F.array(msg("user", user), msg("assistant", assistant)).alias("messages"))


def value_distribution(records: DataFrame, value_col: str = "assistant_content") -> DataFrame:
    """A1: count and percent per stringified value, sorted by value."""
    counts = records.groupBy(F.col(value_col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = records.agg(F.count(F.lit(1)).alias("_total"))
    return (counts.crossJoin(F.broadcast(total))  # one row
                  .select("value", "n", F.round(F.col("n") * 100.0 / F.col("_total"), 9).alias("percent"))
                  .orderBy("value"))


def chat_split(records: DataFrame, order_cols: list, train_share: float = 0.8) -> DataFrame:
    """Positional split, no shuffle of the records themselves."""
    return positional_split(records, order_cols, train_share)


# --- fixed values: the ordered 1/2 -> A/B rewrite rules (pattern, replacement) -------
# Patterns must match the reference's rules in this exact order. Java flags stand in
# for Python's: (?m) MULTILINE, (?i)+(?u) IGNORECASE on str, (?U) Unicode \s and \b,
# (?d) so that ^ and $ only see '\n'. Replacements use Java's $1 for Python's \1.
AB_REWRITE_RULES = [
    (r"(?mdU)^(\s*)1\)", "$1A)"),
    (r"(?mdU)^(\s*)2\)", "$1B)"),
    (r"(?mdU)^(\s*)1\.", "$1A."),
    (r"(?mdU)^(\s*)2\.", "$1B."),
    (r"(?iuU)\bOption\s+1\b", "Option A"),
    (r"(?iuU)\bOption\s+2\b", "Option B"),
    (r"(?iuU)\bSentence\s+1\b", "Sentence A"),
    (r"(?iuU)\bSentence\s+2\b", "Sentence B"),
    (r"(?dU)\b1\b(?=\s*[:\-\)]|\s*$|\s+[A-ZÆØÅ])", "A"),
    (r"(?dU)\b2\b(?=\s*[:\-\)]|\s*$|\s+[A-ZÆØÅ])", "B"),
    (r"(?iu)Answer with only the number \(1 or 2\)", "Answer with only the letter (A or B)"),
    (r"(?iu)Answer with only the number \(1 and 2\)", "Answer with only the letter (A and B)"),
    (r"(?iu)Answer with only the number 1 or 2", "Answer with only the letter A or B"),
    (r"(?iu)Answer with only number \(1 or 2\)", "Answer with only letter (A or B)"),
    (r"(?iu)Select 1 or 2", "Select A or B"),
    (r"(?iu)Choose 1 or 2", "Choose A or B"),
    (r"(?iu)Answer 1 or B", "Answer A or B"),
    (r"(?iu)Answer A or 2", "Answer A or B"),
    (r"(?iu)Answer 1 or 2", "Answer A or B"),
    (r"(?iu)Pick 1 or 2", "Pick A or B"),
    (r"(?iu)number \(1 or 2\)", "letter (A or B)"),
    (r"(?iu)number 1 or 2", "letter A or B"),
    (r"(?iu)the number \(1 or B\)", "the letter (A or B)"),
    (r"(?iu)Your answer \(letter only\):", "Your answer (letter only):"),
    (r"(?iu)Respond with only A or B:", "Respond with only A or B:"),
    (r"\(1\)", "(A)"),
    (r"\(2\)", "(B)"),
    (r"(?iuU)Answer:\s*\([AB12]+\s+or\s+[AB12]+\s+only\)", "Answer: (A or B only)"),
    (r"(?iu)\(1 or B\)", "(A or B)"),
    (r"(?iu)\(A or 2\)", "(A or B)"),
    (r"\(1 or 2\)", "(A or B)"),
]
# --- end of fixed values ------------------------------------------------------------


# What a text must hold, in small letters, for a rule to match (same order as the rules). No rule makes a digit, or any
# of these words or joins, so the text before the first rule tells; a rule that can't match changes nothing.
_RULE_NEEDS = [
    ["1)"], ["2)"], ["1."], ["2."], ["option", "1"], ["option", "2"], ["sentence", "1"], ["sentence", "2"], ["1"], ["2"],
    ["answer with only", "number", "1"], ["answer with only", "number", "1"], ["answer with only", "number", "1"],
    ["answer with only", "number", "1"], ["select", "1", "2"], ["choose", "1", "2"], ["answer", "1"], ["answer", "2"],
    ["answer", "1", "2"], ["pick", "1", "2"], ["number", "1", "2"], ["number", "1", "2"], ["number", "1"],
    ["your answer", "only"], ["respond with only"], ["(1)"], ["(2)"], ["answer", "only)"], ["(1"], ["2)"], ["(1", "2)"],
]


def ab_user_text(c) -> Column:
    """The ordered rewrite list over one text column, rule after rule.

    A rule runs where the text holds what its match would hold; elsewhere it would change nothing. Java's
    case-insensitive letters include the dotted and dotless i, the long s and the Kelvin sign."""
    t = col_(c).cast("string")
    small = F.lower(F.translate(t, "\u0130\u0131\u017f\u212a", "iisk"))
    rules = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("repl"), F.array(*map(F.lit, need)).alias("need"))
                      for (p, r), need in zip(AB_REWRITE_RULES, _RULE_NEEDS, strict=True)])
    bound = F.transform(F.array(F.struct(t.alias("t"), small.alias("small"))), lambda x: F.aggregate(
        F.filter(rules, lambda rule: F.forall(rule["need"], lambda n: F.contains(x["small"], n))),
        x["t"], lambda now, rule: F.regexp_replace(now, rule["pattern"], rule["repl"])))
    return bound[0]


def ab_answer(c) -> Column:
    """Assistant answer 1 -> A, 2 -> B, A/B kept (stripped), other text unchanged."""
    s = py_strip(col_(c))
    return (F.when(s == "1", "A").when(s == "2", "B")
             .when(s.isin("A", "B"), s).otherwise(col_(c)))


def rewrite_messages(messages="messages", enabled: bool = True) -> Column:
    """Rewrite an array<struct<role, content>> by role; switchable off."""
    m = col_(messages)
    if not enabled:
        return m
    def one(x):
        content = x["content"]
        new = (F.when(content.isNull() | (content == ""), content)
                .when(x["role"] == "assistant", ab_answer(content))
                .when(x["role"] == "user", ab_user_text(content))
                .otherwise(content))
        return x.withField("content", new)
    return F.transform(m, one)


def messages_error(messages="messages") -> Column:
    """X26 error row: why a record's messages can't be converted (null: they can)."""
    m = col_(messages)
    return F.when(m.isNull(), "missing_messages").when(F.size(m) == 0, "empty_messages")


def rewrite_records(df: DataFrame, messages: str = "messages", enabled: bool = True) -> DataFrame:
    """X26 + A25 per record: rewritten messages, edit flags by role and ``error`` (unconverted)."""
    out = df.withColumn("error", messages_error(messages)).withColumn("_new", rewrite_messages(messages, enabled))

    def edited(role):
        return F.coalesce(F.exists(F.arrays_zip(F.col(messages).alias("o"), F.col("_new").alias("n")),
                                   lambda x: (x["o"]["role"] == role) & (x["o"]["content"] != x["n"]["content"])), F.lit(False))

    return (out.withColumn("user_edited", edited("user")).withColumn("assistant_edited", edited("assistant"))
               .withColumn(messages, F.col("_new")).drop("_new"))


def pairs_to_chat(pairs: DataFrame, enabled: bool = True) -> DataFrame:
    """Preference records (flat prompt/chosen) -> chat record columns + edit flags.

    A record without a prompt or an answer is not converted and carries ``error``."""
    user_new = ab_user_text("prompt") if enabled else F.col("prompt")
    asst_new = ab_answer("chosen") if enabled else F.col("chosen")
    error = F.when(F.col("prompt").isNull(), "missing_prompt").when(F.col("chosen").isNull(), "missing_chosen")
    out = pairs.select("*", user_new.alias("user_content"), asst_new.alias("assistant_content"), error.alias("error"))
    # flags read the new columns (the rewrite is computed once)
    return out.select("*", (F.col("user_content") != F.col("prompt")).alias("user_edited"),
                      (F.col("assistant_content") != F.col("chosen")).alias("assistant_edited"))


def conversion_counters(chat: DataFrame) -> DataFrame:
    """Records, user edits, assistant edits, records with an error."""
    return chat.agg(F.count(F.lit(1)).alias("n_records"),
                    F.count_if(F.col("user_edited")).alias("user_conversions"),
                    F.count_if(F.col("assistant_edited")).alias("assistant_conversions"),
                    F.count_if(F.col("error").isNotNull()).alias("errors"))
