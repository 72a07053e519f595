"""PII spans against the base patterns, and the added kinds by hand."""
import random
import re

from pyspark.sql import functions as F

from gavel.llm import pii as P
from gavel.llm.queries import QUERIES
from tests.llm.common import awkward, frame

CASES = {
    "mail bob.k+x@mail.example.org, now": [("email", 5, 30)],
    "no a@b and @c.d x@.y": [],
    "10.0.0.1 and 256.1.1.1 and 1.2.3.4.5": [("ip", 0, 8), ("ip", 27, 34)],
    "card 4111 1111 1111 1111 but not 4111 1111 1111 1112": [("card", 5, 24)],
    "call +1 (136) 555-7479 or +12": [("phone", 5, 22)],
    "see https://bob:pw@host.example/x and https://host.example/x": [("email", 15, 32), ("url", 4, 33)],
    'TOKEN = "9233A8ECF7C5B0" api_key: abcdefgh1 token of love': [("account", 9, 23), ("account", 34, 43)],
    "IBAN: DE89 3704 0044 0532 0130 00 iban: DE00 3704 0044 0532 0130 00": [("account", 6, 33)],
}


def brute(x):
    digits = lambda m: sum(c in "0123456789" for c in m.group())
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x) if 13 <= digits(m) <= 19 and P.luhn(m.group())]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= digits(m) <= 15]


def test_cases():
    for text, want in CASES.items():
        got = P.spans_of(text)
        base = [s for s in got if s[0] in P.BASE_KINDS and s[0] != "email"]
        assert [s for s in want if s[0] != "email"] == [s for s in got if s[0] != "email" and (s in want or s not in base)], text
        assert [s for s in got if s[0] in P.BASE_KINDS] == brute(text), text


def test_base_kinds_on_random_strings():
    rng = random.Random(9)
    for alphabet in ("aB.@-+ 0123456789()%x:\n", "1.23 -", "@a.", "+0 ()-.9", "é@a.b1٣"):
        for _ in range(1500):
            x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90)))
            assert [s for s in P.spans_of(x) if s[0] in P.BASE_KINDS] == brute(x), x


def test_long_digit_runs_end():
    assert P.spans_of("1" * 50_000 + " " + "1." * 20_000 + "@" * 5000 + "a." * 20_000) is not None


def test_redacted():
    assert P.redacted('a b@c.de x TOKEN="12345678" 10.0.0.1') == 'a <EMAIL> x TOKEN="<ACCOUNT>" <IP>'
    assert P.redacted("token: 4111111111111111 z") == "token: <CARD> z" or P.redacted("token: 4111111111111111 z") == "token: <ACCOUNT> z"
    assert P.redacted(None) is None and P.redacted("clean text") == "clean text"


def test_long_identifiers_go_whole(spark):
    for key in ("k9" * 200, "Ab3/+" * 80 + "==", "a1" * 63 + "z", "a1-" * 50 + "b=", "x7" * 100_000):
        text = f"a secret={key} b"
        assert P.spans_of(text) == [("account", 9, 9 + len(key))], key[:20]
        df = frame(spark, [(1, text, None, None, 0)])
        assert [s.end - s.start for s in P.find_pii(df).first().spans] == [len(key)]
        assert P.redact(df).first().text == "a secret=<ACCOUNT> b"


def test_frames(spark):
    df = frame(spark).withColumn("spans", F.lit("x"))
    rows = {(r.doc_id, len(r.spans)) for r in P.find_pii(df).collect()}
    assert len(P.find_pii(df).collect()) == len(awkward()) and all(n == 0 for _, n in rows)
    assert sorted(map(str, P.redact(df).collect())) == sorted(map(str, df.collect()))
    assert P.find_pii(frame(spark, [])).collect() == []


def test_query_columns(spark, tmp_path):
    frame(spark, [(1, "x@y.zz 10.0.0.1", None, None, 0), (2, None, None, None, 0)]).write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib
    got = {r.doc_id: r for r in QUERIES["op9_pii"](spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:0:6,ip:7:15" and (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 0, 0)
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:15").hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
