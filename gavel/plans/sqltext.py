"""Small helpers for writing the DuckDB oracle SQL of the registered queries."""

from __future__ import annotations

from ..functions.templates import sql_literal  # noqa: F401  (re-export)
from ..functions.text import PY_WHITESPACE

WS_SQL = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
# RE2 class with the same members as Python's str.isspace()
WS_RE2 = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE) + "]"


def strip_sql(expr: str) -> str:
    return f"trim({expr}, {WS_SQL})"


def md5_key_sql(*parts: str, seed: int | str = 42) -> str:
    cols = ", ".join([f"CAST({p} AS VARCHAR)" for p in parts] + [sql_literal(str(seed))])
    return f"md5(concat_ws('|', {cols}))"


def hexval_sql(expr: str) -> str:
    """value of one hex digit (0..15)"""
    return f"(strpos('0123456789abcdef', {expr}) - 1)"
