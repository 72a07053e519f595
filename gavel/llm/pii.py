"""PII by anchor expansion: an Aho-Corasick automaton finds at-signs, schemes and identifier
cues in one pass; deterministic local parsers expand from each anchor and validate what they
found. Numbers without a cue (IP addresses, payment cards, phones) anchor on their digits.

Kinds, in this order: ``email``, ``ip``, ``card``, ``phone`` (base), ``url`` (a scheme whose
address carries user data before an at-sign) and ``account`` (a cue such as ``iban`` or
``token``, a separator, an identifier with a digit; an IBAN must pass mod 97). Spans are code
points, end exclusive; of one kind they don't overlap, of different kinds they may.

Defined results: a null or empty text has no spans (redacted text: null stays null). Repeated
rows give a row each. Texts of any length are read whole. An empty table gives no rows. Of matches of
a kind that overlap the leftmost stays. Extra columns, whatever their names, are ignored by
``find_pii`` and kept by ``redact``.
"""
from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavel.llm import _blocks as B

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("url", "account")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start after a digit can't begin a leftmost match: the digit's own match would hold it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
SCHEMES = ("http", "https", "ftp", "sftp", "ssh", "postgres", "postgresql", "mysql", "redis", "mongodb", "amqp", "smb")
USER_ADDRESS = re.compile(r"[^\s/?#@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
CUES = ("iban", "ssn", "passport", "account", "konto", "cuenta", "compte", "token", "api_key", "apikey", "api key",
        "secret", "password", "passwd")
AFTER_CUE = re.compile(r"(?:[ _-]?(?:id|no|nr|number|key))?\.?[ \t]{0,3}[:=#][ \t]{0,3}[\"']?")
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/-]{4,}(?:={1,2}|[A-Za-z0-9])")  # of any length, with its padding
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
SPANS = "array<struct<kind:string,start:int,end:int>>"
FOUND = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])


@lru_cache(maxsize=1)
def _anchors():
    auto = ahocorasick.Automaton()
    auto.add_word("@", ("@", 1))
    auto.add_word("://", ("://", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.title()}:
            auto.add_word(form, ("cue", len(form)))
    auto.make_automaton()
    return auto


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c in "0123456789"]


def luhn(text: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(_digits(text))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    flat = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _email(text: str, at: int, since: int) -> tuple[int, int] | None:
    start = at
    while start > since and text[start - 1] in LOCAL:
        start -= 1
    right = DOMAIN.match(text, at + 1) if start < at else None
    return (start, right.end()) if right else None


def _account(text: str, start: int, end: int) -> tuple[int, int] | None:
    if start and text[start - 1].isalnum():
        return None
    gap = AFTER_CUE.match(text, end)
    if not gap:
        return None
    if text[start:end].lower() == "iban":
        m = IBAN.match(text, gap.end())
        return (m.start(), m.end()) if m and iban_ok(m.group()) else None
    m = IDENTIFIER.match(text, gap.end())
    return (m.start(), m.end()) if m and any(c in "0123456789" for c in m.group()) else None


def _url(text: str, at: int) -> tuple[int, int] | None:
    start = at
    while start and at - start < 12 and text[start - 1].isascii() and text[start - 1].isalpha():
        start -= 1
    if text[start:at].lower() not in SCHEMES:
        return None
    m = USER_ADDRESS.match(text, at + 3)
    return (start, m.end()) if m else None


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as listed, then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for last, (what, size) in _anchors().iter(text):
        first = last - size + 1
        kind = {"@": "email", "://": "url", "cue": "account"}[what]
        since = found[kind][-1][1] if found[kind] else 0
        span = (_email(text, first, since) if what == "@" else _url(text, first) if what == "://"
                else _account(text, first, last + 1))
        if span and span[0] >= since:
            found[kind].append(span)
    found["ip"] = [m.span() for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.group().split("."))]
    found["card"] = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13
                     and 13 <= len(_digits(m.group())) <= 19 and luhn(m.group())]
    found["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def redacted(text: str | None) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    spans = sorted((a, -b, k) for k, a, b in spans_of(text))
    if not spans:
        return text
    out, at = [], 0
    i = 0
    while i < len(spans):
        a, b, kind = spans[i][0], -spans[i][1], spans[i][2]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, -spans[i][1])
        out += [text[at:a], f"<{kind.upper()}>"]
        at, i = b, i + 1
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, spans (kind, start, end)."""
    def find(batches):
        for t in B.pieces(batches):
            rows = [(d, [{"kind": k, "start": a, "end": b} for k, a, b in spans_of(x)])
                    for d, x in zip(t["doc_id"].to_pylist(), t["text"].to_pylist())]
            yield from B.to_table(rows, FOUND).to_batches()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, f"doc_id long, spans {SPANS}")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with their personal data replaced; all columns and their order stay."""
    def mask(batches):
        for t in B.pieces(batches):
            at = t.schema.get_field_index("text")
            new = pa.array([redacted(x) for x in t["text"].to_pylist()], pa.string())
            yield from t.set_column(at, t.schema.field(at).with_type(pa.string()), new).to_batches()

    return docs.mapInArrow(mask, docs.schema)
