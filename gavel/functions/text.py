"""Scalar text helpers as Column expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's ``str.strip()`` removes every character for which ``str.isspace()`` is
# true. Spark's one-argument ``trim`` only removes spaces, so the set is built from
# that rule and handed to ``btrim`` (a character-set trim, same as SQL ``trim(s, chars)``).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())
# A regex character class with the same members (for "remove all whitespace").
WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE) + "]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Unicode whitespace strip with Python semantics."""
    return F.btrim(col_(c), F.lit(PY_WHITESPACE))


def valid_sentence(c, min_len: int = 3) -> Column:
    """non-null string whose stripped length is at least ``min_len``."""
    c = col_(c)
    return c.isNotNull() & (F.length(py_strip(c)) >= min_len)


def item_tokens(c) -> Column:
    """Token estimate of one tagged item: floor((chars + 16) / 4) + 50."""
    return (F.floor((F.length(col_(c)) + 16) / 4) + 50).cast("long")


def text_tokens(c) -> Column:
    """Token estimate of an instruction or prompt: floor(chars / 4)."""
    return F.floor(F.length(col_(c)) / 4).cast("long")


def tag_safe_id(c) -> Column:
    """X5: '-' and '.' become '_' so the id can be used inside a tag name."""
    return F.translate(col_(c).cast("string"), "-.", "__")


def first_tag_text(c, tag: str) -> Column:
    """Text of the first ``<tag>...</tag>`` (case-insensitive, dot-all), stripped; absent -> null."""
    raw = F.regexp_extract(col_(c), f"(?is)<{tag}>(.*?)</{tag}>", 1)
    return F.nullif(py_strip(raw), F.lit(""))


def score_before_slash(c) -> Column:
    """X11: ``4/5`` -> 4 (text before the first ``/``), invalid -> null."""
    return py_strip(F.split_part(col_(c), F.lit("/"), F.lit(1))).try_cast("int")


def score_last_token_before_slash(c) -> Column:
    """X11: ``Score: 4/5`` -> 4 (last single-space-separated token, then the text before its ``/``)."""
    last = F.element_at(F.split(col_(c), " "), -1)
    return py_strip(F.split_part(last, F.lit("/"), F.lit(1))).try_cast("int")


def rank_list(c) -> Column:
    """``"3, 1,2"`` -> [3, 1, 2]; unparsable entries become null."""
    return F.transform(F.split(col_(c), ","), lambda v: py_strip(v).try_cast("int"))


def to_number(c, null_as_zero: bool = False) -> Column:
    """Numeric coerce; invalid -> null (or 0)."""
    v = col_(c).cast("string").try_cast("double")
    return F.coalesce(v, F.lit(0.0)) if null_as_zero else v


def quoted_text(c) -> Column:
    """Text between the first and the last double quote; else the text after the
    last colon (stripped, quotes stripped); else the whole text."""
    c = col_(c)
    first = F.instr(c, '"')
    last = F.length(c) - F.instr(F.reverse(c), '"') + 1
    has_pair = (first > 0) & (last != first)
    colon = F.length(c) - F.instr(F.reverse(c), ":") + 1
    has_colon = F.instr(c, ":") > 0
    between = c.substr(first + 1, last - first - 1)
    after_colon = F.btrim(py_strip(c.substr(colon + 1, F.length(c))), F.lit('"'))
    return F.when(has_pair, between).when(has_colon, after_colon).otherwise(c)


def message_label(messages) -> Column:
    """X20's label: the second message's content as an integer (null when it is none)."""
    second = F.try_element_at(col_(messages), F.lit(2))
    return py_strip(second["content"]).try_cast("int")


def norm_answer(c) -> Column:
    """Strip + upper."""
    return F.upper(py_strip(col_(c)))


def paragraph(prev, cur, nxt) -> Column:
    """Previous + current + next sentence, empty parts skipped, single spaces, stripped."""
    parts = [F.nullif(col_(x), F.lit("")) for x in (prev, cur, nxt)]
    return py_strip(F.concat_ws(" ", *parts))


def error_reduction(base, new) -> Column:
    """((100 - base) - (100 - new)) / (100 - base); base = 100 -> null."""
    b, n = col_(base), col_(new)
    return ((F.lit(100.0) - b) - (F.lit(100.0) - n)) / F.nullif(F.lit(100.0) - b, F.lit(0.0))


def model_short_name(c) -> Column:
    """After the last '/', before the first '_'."""
    tail = F.element_at(F.split(col_(c), "/"), -1)
    return F.split_part(tail, F.lit("_"), F.lit(1))


def group_key(c) -> Column:
    """Id text before the first '-'."""
    return F.split_part(col_(c).cast("string"), F.lit("-"), F.lit(1))


def strip_ws_all(c) -> Column:
    """Remove every whitespace character (used by the character n-gram score)."""
    return F.regexp_replace(col_(c), WS_CLASS, "")


def message_text(messages, prompt) -> Column:
    """The text to score: the first message's content, else the prompt (null = skip)."""
    first = F.try_element_at(col_(messages), F.lit(1))
    return F.coalesce(first["content"], col_(prompt))


def map_scalar_or_list_df(df, col: str, fn, suffix: str = "_mt-translated"):
    """X36 on a DataFrame: ``<col><suffix>`` holds ``fn`` applied to the value, or to every
    element (order kept) when the column is an array. Every mapped column is renamed
    (the reference renamed only the last one)."""
    from pyspark.sql import types as T
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.ArrayType):
        out = F.transform(F.col(col), lambda x: fn(x))
    else:
        out = fn(F.col(col))
    return df.withColumn(col + suffix, out)
