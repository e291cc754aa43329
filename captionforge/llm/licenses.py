"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, once with line breaks as ends and once with line breaks as spaces (wrapped notices).
Normalised sentences that are in the table of known sentences become identifiers, and every other one a gap
mark. Ordered rules, sequences of identifiers with at most ``MAX_GAP`` unknown sentences between two, are
matched in turn; what a rule has matched is taken out for the later ones, so a full text comes
before the short notices it contains.

Everything is an expression over one row: no join, no shuffle. Defined cases: a null or empty text has no
sentence and no licence; texts of any length are scanned whole; repeated rows are scanned each; an empty
table has no rows; further columns stay, and ``out`` replaces a column of that name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GAP = 2

# Sentences of well-known licence texts and notices, by identifier. Those with = are names of licences,
# which mean something in a rule only.
SENTENCES = {
    "mit-notice": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.",
                   "Distributed under the MIT License."],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation '
                  'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
                  'modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the '
                  'Software is furnished to do so, subject to the following conditions:'],
    "mit-condition": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-warranty": ['The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the '
                     'warranties of merchantability, fitness for a particular purpose and noninfringement.'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                  "provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd-permit": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                   "following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                   "disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                 "derived from this software without specific prior written permission."],
    "apache-notice": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache-limits": ["you may not use this file except in compliance with the License.",
                      'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an '
                      '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "gpl-free": ["This program is free software:"],
    "gpl3-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                   "Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-later": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                   "Foundation; either version 2 of the License, or (at your option) any later version."],
    "mpl2-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "cc-by-nc-4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-4": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "spdx": ["SPDX-License-Identifier:"],
    "=mit": ["MIT"],
    "=apache": ["Apache-2.0"],
    "=gpl3": ["GPL-3.0-only", "GPL-3.0-or-later"],
    "=bsd3": ["BSD-3-Clause"],
}

# Rules in the order in which they are tried, each a sequence of sentence identifiers.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("BSD-3-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-permit", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-notice", "apache-limits", "apache-limits"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-later"]),
    ("MIT", ["spdx", "=mit"]),
    ("Apache-2.0", ["spdx", "=apache"]),
    ("GPL-3.0", ["spdx", "=gpl3"]),
    ("BSD-3-Clause", ["spdx", "=bsd3"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("ISC", ["isc-grant"]),
]

BREAK = "\x01"
END_OF_LINE = r"[.!?:;]+[ \t\r\n]+|\n"
END_OF_SENTENCE = r"[.!?:;]+[ \t\r\n]+|\n[ \t\r]*\n"
NO_WORD = "[^A-Za-z0-9\x01]+"
BORDER = " ?\x01[ \x01]*"
# a text without one of these words, in any case, has no known sentence but names, which mean nothing alone
HINT = "(?i)licen|permission|permitted|redistribut|free[^A-Za-z0-9]+software|warrant"


def normalise(sentence: str) -> str:
    """What the table of known sentences holds: ASCII letters and digits in lower case, one space between words."""
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def known_sentences() -> dict[str, str]:
    """Identifier of each normalised sentence; an end inside a known sentence cuts it like any text."""
    table = {}
    for name, sentences in SENTENCES.items():
        for sentence in sentences:
            parts = [normalise(p) for p in re.split(r"[.!?:;]+[ \t\r\n]+", sentence)]
            table[[p for p in parts if p][-1]] = name
    return table


def sentences(text: Column, ends: str) -> Column:
    """Normalised sentences of a text."""
    broken = F.regexp_replace(text, ends, BREAK)
    plain = F.trim(F.lower(F.regexp_replace(broken, NO_WORD, " ")))
    return F.array_remove(F.split(plain, BORDER), "")


def sequence(found: Column, known: dict[str, str]) -> Column:
    """Identifiers of the known sentences in order, as ``<id>``, with a ``u`` for each unknown one between two (nine at most)."""
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    places = F.filter(F.transform(found, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda p: p["s"].isin(list(known)))
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("last"))
    return F.aggregate(places, start, lambda a, p: F.struct(
        F.concat(a["text"], F.repeat(F.lit("u"), F.least(F.lit(9), p["i"] - a["last"] - 1)), F.lit("<"), F.element_at(names, p["s"]), F.lit(">")).alias("text"),
        p["i"].alias("last")), lambda a: a["text"])


def match_rules(sequence: Column, rules: list[tuple[str, list[str]]] = RULES, max_gap: int = MAX_GAP) -> Column:
    """The sequence with what each rule has matched replaced by ``[licence]``."""
    for name, ids in rules:
        pattern = f"u{{0,{max_gap}}}".join(f"<{i}>" for i in ids)
        sequence = F.regexp_replace(sequence, pattern, f"[{name}]")
    return sequence


def scan(docs: DataFrame, text_col: str = "text", out: str = "licences", max_gap: int = MAX_GAP) -> DataFrame:
    """``docs`` with ``out``: struct of licences (distinct, in alphabetical order) and loose (identifiers, but for names, that no rule took)."""
    known = known_sentences()
    text = F.coalesce(F.col(text_col), F.lit(""))

    def matched(ends: str) -> Column:
        return match_rules(sequence(sentences(text, ends), known), RULES, max_gap)

    def named(sequences: Column) -> Column:
        every = lambda pattern: F.sort_array(F.array_distinct(F.flatten(F.transform(
            sequences, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(1))))))
        return F.struct(every(r"\[([^\]]+)\]").alias("licences"), every("<([^>=]+)>").alias("loose"))

    both = F.transform(F.array(F.array(matched(END_OF_LINE), matched(END_OF_SENTENCE))), named)[0]
    none = F.struct(F.array().cast("array<string>").alias("licences"), F.array().cast("array<string>").alias("loose"))
    return docs.withColumn(out, F.when(text.rlike(HINT), both).otherwise(none))
