"""Licence scans against sets of bigrams."""
from fractions import Fraction

import pytest
import regex

from gavel.llm.licenses import TEMPLATES, anchors, bigrams, scan_licenses, words_of
from tests.llm.common import awkward, frame, prose


def brute(rows, templates, t=Fraction(4, 5)):
    best = {}
    for i, text in rows:
        text = text or ""
        parts = regex.split(r"\n[^\p{L}\p{N}\n]*\n", text)
        units = [("line", k, words_of(x)) for k, x in enumerate(text.split("\n"))]
        units += [("paragraph", k, words_of(x)) for k, x in enumerate(parts) if "\n" in x] + ([("text", 0, words_of(text))] if len(parts) > 1 else [])
        every = words_of(text)
        for name, template in templates.items():
            b, n = set(bigrams(template)), len(words_of(template))
            runs = [("words", k, every[k:k + n]) for k in range(len(every) - n + 1)]
            for kind, k, w in units + runs:
                a = set(zip(w, w[1:]))
                a = {" ".join(x) for x in a}
                if a and b and Fraction(2 * len(a & b), len(a) + len(b)) >= t:
                    hit = (-2 * len(a & b) / (len(a) + len(b)), kind, k)
                    best[i, name] = min(best.get((i, name), hit), hit)
    return sorted(((i, n, -d, kind, k) for (i, n), (d, kind, k) in best.items()), key=str)


def run(df, templates=TEMPLATES):
    return sorted((tuple(r) for r in scan_licenses(df, templates).collect()), key=str)


def test_all_templates_in_context(spark):
    rows = []
    for i, (name, t) in enumerate(TEMPLATES.items()):
        rows.append((i, prose(i, 40) + "\n" + t.upper() + "\n" + prose(i + 99, 9), None, None, 0))
        half = t.split()
        rows.append((100 + i, "intro\n\n" + " ".join(half[:len(half) // 2]) + "\n" + " ".join(half[len(half) // 2:]) + "\n \t\nend " + prose(i, 5), None, None, 0))
        half[len(half) // 2] = "changed"
        rows.append((200 + i, " ".join(half), None, None, 0))
    df = frame(spark, rows)
    got = run(df)
    assert got == brute([(r[0], r[1]) for r in rows], TEMPLATES)
    assert {(i, n) for i, n, *_ in got} >= {(i, n) for i, n in enumerate(TEMPLATES)} | {(100 + i, n) for i, n in enumerate(TEMPLATES)}


def test_short_forms_as_lines(spark):
    """Public short forms, each a line of a text, are reported by their licence first."""
    forms = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "licensed under CC-BY-4.0": "CC-BY-4.0", "This work is licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
             "Licensed under Creative Commons Attribution-NonCommercial 4.0": "CC-BY-NC-4.0", "Licensed under the GNU GPL v3.": "GPL-3.0",
             "Licensed under the GPLv2": "GPL-2.0", "Licensed under the GPL-3.0.": "GPL-3.0", "Licensed under the GNU LGPL v3": "LGPL-3.0",
             "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0", "Licensed under the MPL 2.0": "MPL-2.0",
             "Licensed under the BSD 3-Clause License.": "BSD-3-Clause", "Licensed under the ISC License.": "ISC", "Licensed under the MIT License.": "MIT",
             "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0",
             "SPDX-License-Identifier: CC-BY-NC-4.0": "CC-BY-NC-4.0", "/* SPDX-License-Identifier: BSD-3-Clause */": "BSD-3-Clause"}
    rows = [(i, prose(i, 30) + "\n" + f + "\n" + prose(i + 50, 30), None, None, 0) for i, f in enumerate(forms)]
    rows.append((99, "We like the MIT License and CC BY-NC 4.0 alike", None, None, 0))
    rows.append((98, "Some prose first. This work is licensed under CC BY 4.0. More words follow in the line.", None, None, 0))
    got = run(frame(spark, rows))
    assert got == brute([(r[0], r[1]) for r in rows], TEMPLATES)
    for i, name in enumerate(forms.values()):
        mine = [g for g in got if g[0] == i]
        top = max(mine, key=lambda g: g[2])
        assert any(g[1].startswith(name) and g[2:] == (top[2], "line", 1) for g in mine), (name, mine)
    assert not [g for g in got if g[0] == 99]
    assert (98, "CC-BY-4.0-work", 1.0, "words", 3) in got


def test_commented_header_and_notice_before_code(spark):
    gpl, mit = TEMPLATES["GPL-notice"].split(), TEMPLATES["MIT-notice"].split()
    wrapped = [" ".join(gpl[i:i + 9]) for i in range(0, len(gpl), 9)]
    header = "\n".join(["#!/bin/sh", "#", "# A tool."] + ["#"] + ["#   " + x for x in wrapped] + ["#", "#  It is useful.", "set -e"])
    code = "/*\n * " + "\n * ".join(" ".join(mit[i:i + 7]) for i in range(0, len(mit), 7)) + "\n */ int main(void) { return run(argc, argv); }\n" * 3
    rows = [(1, header, None, None, 0), (2, code, None, None, 0), (3, prose(3, 3000) + " " + " ".join(gpl) + " " + prose(4, 3000), None, None, 0)]
    got = run(frame(spark, rows))
    assert got == brute([(r[0], r[1]) for r in rows], TEMPLATES)
    assert {(i, n) for i, n, *_ in got} == {(1, "GPL-notice"), (2, "MIT-notice"), (3, "GPL-notice")}


def test_units_at_the_threshold(spark):
    """Scores of exactly 0.8 count, whichever side the sizes differ to."""
    template = {"six": "a b c d e f g"}
    rows = [(1, "a b c d e f g h i j", None, None, 0), (2, "a b c d e", None, None, 0), (3, "a b c d e x", None, None, 0), (4, "x y a b c d e f g", None, None, 0)]
    got = run(frame(spark, rows), template)
    assert got == brute([(r[0], r[1]) for r in rows], template) and [(g[0], g[2]) for g in got] == [(1, 1.0), (2, 0.8), (4, 1.0)]
    nine = {"nine": "This work is licensed under CC BY-NC 4.0 a b"}
    assert run(frame(spark, [(1, "This work is licensed under CC BY", None, None, 0)]), nine) == brute([(1, "This work is licensed under CC BY")], nine)


def test_a_match_holds_an_anchor():
    for t in TEMPLATES.values():
        g = bigrams(t)
        n = len(g) - len(anchors(g, Fraction(4, 5)))  # a unit of these alone scores less than the threshold
        assert Fraction(2 * n, len(g) + n) < Fraction(4, 5)


def test_very_long_text(spark):
    text = prose(9, 60_000) + "\n" + TEMPLATES["MIT"] + "\n" + " ".join(["free of charge, to any person"] * 2000)
    got = run(frame(spark, [(1, text, None, None, 0)]))
    assert [(g[1], g[2], g[3]) for g in got if g[2] == 1.0] == [("MIT", 1.0, "line")]


def test_awkward_rows(spark):
    own = {"x": "x x x", "four": "One, two; three four!", "line": "same line same line same line"}
    df = frame(spark)
    assert run(df, own) == brute([(i, t) for i, t, *_ in awkward()], own)
    assert run(frame(spark, [])) == [] and run(df) == []


def test_templates_need_bigrams(spark):
    with pytest.raises(ValueError):
        scan_licenses(frame(spark), {"x": "word"})
