"""Small tables with the awkward rows that every operator must bear."""
from __future__ import annotations

import random
import re

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def prose(seed: int, n: int, letters: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward() -> list[tuple]:
    """Null and empty texts, null ids, langs and sources, repeated rows, odd white space, a long text."""
    base = prose(1, 60)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n "), (6, "one"), (7, "one two three four"),
            (8, "one two three four"), (9, base.replace(" ", " \x0b ", 3)), (10, "a b c d \x1c e\u0085f"),
            (None, base), (None, None), (11, prose(2, 4000)), (12, "x " * 500), (13, base + " tail"), (14, "\U0001F600 éß " * 20),
            (7, "another text under a taken id " + prose(3, 30)), (15, base.split(" ", 1)[1]), (16, "same line\nsame line\n\nsame line")]
    return [(i, t, "en" if k % 3 else None, "s%d" % (k % 4) if k % 5 else None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DOCS)


def key(row):
    return tuple((v is not None, v if not isinstance(v, list) else str(v)) for v in row)
