"""Prompt templates as Column expressions.

A template is plain user data with ``{slot}`` placeholders (``{{``/``}}`` escape
braces). It is split once on the driver with the standard library and turned into
one ``concat`` of literals and columns, so user text that contains ``%``, ``{}`` or
``$1`` is never interpreted.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def template_parts(template: str) -> list[tuple[str, str | None]]:
    """[(literal, slot_or_None), ...] for a ``str.format``-style template."""
    parts = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if spec or conv:
            raise ValueError(f"format specs are not supported in templates: {field!r}")
        parts.append((literal, field))
    return parts


def template_slots(template: str) -> list[str]:
    return [f for _, f in template_parts(template) if f is not None]


def render(template: str, slots: dict) -> Column:
    """``render("A: {a}\\nB: {b}", {"a": col, "b": col})`` -> string Column.

    A null slot value makes the result null (the row has nothing to render).
    """
    pieces: list[Column] = []
    for literal, field in template_parts(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            if field not in slots:
                raise KeyError(f"template slot {field!r} has no column")
            pieces.append(col_(slots[field]).cast("string"))
    if not pieces:
        return F.lit("")
    return F.concat(*pieces)


def sql_literal(s: str) -> str:
    """ANSI SQL string literal (used when writing oracle SQL)."""
    return "'" + s.replace("'", "''") + "'"


def render_sql(template: str, slots: dict[str, str]) -> str:
    """The same rendering as :func:`render`, as a SQL ``||`` expression."""
    pieces = []
    for literal, field in template_parts(template):
        if literal:
            pieces.append(sql_literal(literal))
        if field is not None:
            pieces.append(f"CAST({slots[field]} AS VARCHAR)")
    return "(" + " || ".join(pieces or ["''"]) + ")"


def instruction_mode(template: str) -> str:
    """How an instruction template takes the input text.

    ``%s`` once -> replace; ``%s`` more than once -> the text is appended (the
    reference's fallback when ``%`` formatting fails); ``{}`` once -> replace;
    ``{}`` more than once -> rejected up front; no slot -> appended after a space.
    """
    n_pct, n_brace = template.count("%s"), template.count("{}")
    if n_pct == 1:
        return "pct"
    if n_pct > 1:
        return "append"
    if n_brace == 1:
        return "brace"
    if n_brace > 1:
        raise ValueError("instruction template has more than one {} slot")
    return "append"


def apply_instruction(template: str, text) -> Column:
    """Literal substitution of the input text into the instruction."""
    mode = instruction_mode(template)
    t = col_(text)
    if mode == "append":
        return F.concat(F.lit(template + " "), t)
    slot = "%s" if mode == "pct" else "{}"
    head, tail = template.split(slot, 1)
    return F.concat(F.lit(head), t, F.lit(tail))


def apply_instruction_sql(template: str, text_sql: str) -> str:
    mode = instruction_mode(template)
    if mode == "append":
        return f"({sql_literal(template + ' ')} || {text_sql})"
    slot = "%s" if mode == "pct" else "{}"
    head, tail = template.split(slot, 1)
    return f"({sql_literal(head)} || {text_sql} || {sql_literal(tail)})"
