"""License scans: normalised text against licence templates by the Dice coefficient over word
bigrams, in DataFrame operations only.

Normalising lower-cases and takes runs of a-z and 0-9 as words, so comment marks, line breaks and
white space don't matter. Units are a text's lines, its paragraphs (parted by lines without a
letter or digit) of several lines, the whole text if it has several paragraphs, and, for each template,
all runs of as many words as it has: a notice in a commented header, before code or inside a line
is such a run. A unit and a template with a and b distinct bigrams score 2 * common / (a + b); all
comparisons with the threshold are of whole numbers.

A score of t needs at least b * t / (2 - t) common bigrams, so a match holds one of any
b - that + 1 of the template's bigrams: its anchors, the longest ones, which stand for the rarest. Texts
without an anchor are dropped after one pass; only units and runs around anchors are scored, and size
bounds prune the templates of a unit. All of it is per row; the templates are literals (their
number and size are a parameter of the caller), so nothing is shuffled but the matches.

Defined results: null and empty texts match nothing; a unit of one word has no bigram and matches
nothing; of several units that match a template the best counts, then the first by kind (line, paragraph,
text, words) and number (of the line or paragraph, of the first word of a run, from 0). Repeated rows of a
document come back once. A text is one row, however long. An empty table gives no rows. Extra
columns, whatever their names, are ignored.
"""
from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short public licence notices and the names they are known by (SPDX).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                         "compliance with the License. You may obtain a copy of the License at "
                         "http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                  "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                  "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
                  "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD": "This software is released under the BSD License.",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
                  "the following conditions are met:",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
                  "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                  "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                  "option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
}
# The usual short forms of the same licences: how a line names them, and their SPDX lines.
TEMPLATES |= {f"{k}-short": f"Licensed under {v}." for k, v in {
    "MIT": "the MIT License", "BSD": "the BSD License", "BSD-2-Clause": "the BSD 2-Clause License", "BSD-3-Clause": "the BSD 3-Clause License",
    "ISC": "the ISC License", "MPL-2.0": "the Mozilla Public License, Version 2.0", "MPL-2.0-id": "the MPL 2.0",
    "GPL-2.0": "the GNU GPL v2", "GPL-3.0": "the GNU GPL v3", "GPL-2.0-id": "the GPL-2.0", "GPL-3.0-id": "the GPL-3.0",
    "GPL-2.0-plain": "the GPLv2", "GPL-3.0-plain": "the GPLv3", "LGPL-2.1": "the GNU LGPL v2.1", "LGPL-3.0": "the GNU LGPL v3",
    "LGPL-3.0-id": "the LGPL-3.0", "LGPL-3.0-plain": "the LGPLv3", "AGPL-3.0": "the GNU AGPL v3", "AGPL-3.0-id": "the AGPL-3.0",
    "AGPL-3.0-plain": "the AGPLv3", "CC-BY-4.0": "CC BY 4.0", "CC-BY-SA-4.0": "CC BY-SA 4.0", "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-NC-SA-4.0": "CC BY-NC-SA 4.0", "CC0-1.0": "CC0 1.0", "CC-BY-4.0-name": "Creative Commons Attribution 4.0",
    "CC-BY-SA-4.0-name": "Creative Commons Attribution-ShareAlike 4.0",
    "CC-BY-NC-4.0-name": "Creative Commons Attribution-NonCommercial 4.0",
    "CC-BY-NC-SA-4.0-name": "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"}.items()}
TEMPLATES |= {f"CC-{k}-4.0-work": f"This work is licensed under CC {k} 4.0." for k in ("BY", "BY-SA", "BY-NC", "BY-NC-SA")}
TEMPLATES |= {f"{k}-spdx": f"SPDX-License-Identifier: {k}" for k in (
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-only",
    "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-only",
    "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC0-1.0", "Unlicense")}


def words_of(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def bigrams(text: str) -> list[str]:
    """A template's distinct bigrams, in order."""
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def anchors(grams: list[str], threshold: Fraction) -> list[str]:
    """As many of a template's bigrams, the longest first, as a match can't be without."""
    least = -(-len(grams) * threshold.numerator // (2 * threshold.denominator - threshold.numerator))
    return sorted(grams, key=lambda g: (-len(g), g))[:len(grams) - least + 1]


def _pairs(words: Column) -> Column:
    """Hashes of a text's bigrams, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.xxhash64(a, b))


def _let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once."""
    return F.transform(F.array(value), fn)[0]


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """One row a (doc_id, license) that match: dice, kind and number of the best unit."""
    share = Fraction(str(threshold))
    p, q = share.numerator, share.denominator
    names = {k: bigrams(v) for k, v in templates.items()}
    names = {k: v for k, v in names.items() if v}
    if not names:
        raise ValueError("no template has a bigram")

    def hashed(grams: list[str]) -> Column:
        return F.array(*[F.xxhash64(*map(F.lit, g.split())) for g in grams])

    known = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(len(v)).alias("n"), F.lit(len(words_of(templates[k]))).alias("words"),
                               hashed(v).alias("grams"), hashed(anchors(v, share)).alias("anchors")) for k, v in sorted(names.items())])
    every = sorted({g for v in names.values() for g in anchors(v, share)})
    # one row of literals, folded here so that the scan tests a hash set
    hashes = docs.sparkSession.range(1).select(hashed(every).alias("h")).first().h

    def scored(grams: Column, t: Column, kind: str, number: Column) -> Column:
        """(-dice, kind, number) of a unit's distinct bigrams and a template; null below the threshold."""
        return _let(F.size(F.array_intersect(grams, t["grams"])), lambda c: F.when(
            2 * q * c >= p * (F.size(grams) + t["n"]),
            F.struct((-2 * c / (F.size(grams) + t["n"])).alias("d"), F.lit(kind).alias("kind"), number.cast("int").alias("number"))))

    def run_best(t: Column) -> Column:
        """The best run of a template's number of words that holds an anchor."""
        size = t["words"] - 1
        near = F.filter("spots", lambda x: F.array_contains(t["anchors"], x["h"]))
        starts = F.array_distinct(F.flatten(F.transform(near, lambda x: F.sequence(
            F.greatest(x["i"] - size + 1, F.lit(0)), F.least(x["i"], F.size("pairs") - size)))))
        return F.when(F.size("pairs") >= size, F.array_min(F.array_compact(F.transform(starts, lambda s: _let(
            F.array_distinct(F.slice("pairs", s + 1, size)), lambda g: scored(g, t, "words", s))))))

    def unit_best(units: Column, t: Column) -> Column:
        """The best unit whose size can match a template."""
        fit = F.filter(units, lambda u: (2 * q * F.least(F.size(u["grams"]), t["n"]) >= p * (F.size(u["grams"]) + t["n"])))
        return F.array_min(F.array_compact(F.transform(fit, lambda u: _let(F.size(F.array_intersect(u["grams"], t["grams"])), lambda c: F.when(
            2 * q * c >= p * (F.size(u["grams"]) + t["n"]),
            F.struct((-2 * c / (F.size(u["grams"]) + t["n"])).alias("d"), u["kind"].alias("kind"), u["number"].alias("number")))))))

    def words(text: Column) -> Column:
        return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")

    def once(df: DataFrame, value: Column, name: str) -> DataFrame:
        """Adds a column that is computed once: an explode of one element, which filters and
        projections aren't folded into (they would repeat the expression)."""
        return df.select("*", F.explode(F.array(value)).alias(name))

    def numbered(kind: str, parts: Column, several: bool) -> Column:
        """Units with an anchor; ``several``: of several lines only."""
        units = F.transform(parts, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("number"), F.when(
            F.instr(x, "\n") > 0 if several else F.lit(True), F.array_distinct(_pairs(words(x)))).alias("grams")))
        return F.filter(units, lambda u: F.exists(u["grams"], lambda h: h.isin(hashes)))

    text = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    text = once(text, _let(words(F.col("text")), _pairs), "pairs")
    text = once(text.where(F.exists("pairs", lambda h: h.isin(hashes))),
                F.filter(F.transform("pairs", lambda h, i: F.struct(i.alias("i"), h.alias("h"))), lambda x: x["h"].isin(hashes)), "spots")
    paragraphs = F.split("text", r"\n[^\p{L}\p{N}\n]*\n")
    text = once(text, F.concat(
        numbered("line", F.split("text", "\n"), False), numbered("paragraph", paragraphs, True),
        F.when(F.size(paragraphs) > 1, numbered("text", F.array("text"), False)).otherwise(numbered("text", F.slice(paragraphs, 1, 0), False))), "units")
    near = F.filter(known, lambda t: F.arrays_overlap(t["anchors"], F.transform("spots", lambda x: x["h"])))
    hits = F.transform(near, lambda t: F.struct(t["license"].alias("license"), F.array_min(F.array_compact(F.array(
        unit_best(F.col("units"), t), run_best(t)))).alias("b")))
    hits = text.select("doc_id", F.explode(hits).alias("x")).where("x.b IS NOT NULL")
    return (hits.groupBy("doc_id", F.col("x.license").alias("license")).agg(F.min("x.b").alias("b"))
            .select("doc_id", "license", (-F.col("b.d")).alias("dice"), F.col("b.kind").alias("unit"), F.col("b.number").alias("unit_no")))
