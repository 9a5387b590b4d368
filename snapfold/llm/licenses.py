"""Licences in texts by sentence rules: sentences become identifiers, sequences of identifiers match ordered rules.

Everything is a column expression. A text becomes words, sentence ends and line breaks. A known sentence lies between two
such ends; line breaks inside it, blank lines and comment signs are no more than a space. The identifiers found, in order,
are one string in which each rule is a substring. Texts without any of the ``CUES``, one of which is in every known
sentence, skip all that.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known licence notices, by identifier.
SENTENCES = {
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    " General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
    " option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without"
    " even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
    " associated documentation files (the \"Software\"), to deal in the Software without restriction, including without"
    " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
    " Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
    " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
    " compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is"
    " distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc0": "Licensed under CC0 1.0.",
    "bsd-short": "Released under the BSD License.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "rights": "All rights reserved.",
}
#: Licence and the sentences it takes, in this order and with no other known sentence between.
RULES = (
    ("GPL-3.0", ("gpl3-work",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-warranty", "gpl-see", "gpl-copy")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-as-is")),
    ("MIT", ("mit-released", "mit-grant", "mit-as-is")),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-header", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-header",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC0-1.0", ("cc0",)),
    ("BSD", ("bsd-short",)),
    ("MPL-2.0", ("mpl",)),
    ("proprietary", ("rights",)),
)
#: In every known sentence, in lower case, is one of these.
CUES = ("licen", "warrant", "permission", "rights")
SENTENCE_END = r"[.!?]+(?:\s+|$)|\n+"
NOT_PLAIN = r"[^a-z0-9.]+"
#: Sentence ends by punctuation and by line breaks, the two cases of ``SENTENCE_END``, and the mark of the first.
STOP, BREAK = SENTENCE_END.split("|\\n")[0], r"\n+"
STOP_MARK = "|"
#: Comment signs that count as words or as sentence ends; all others are not plain anyway.
SIGN_WORDS, SIGN_STOPS = r"(?:dnl|rem|c)(?![a-z0-9.])[ .]*", r"(?m)^[ \t]*!+[ \t]*"
#: A line break inside a sentence, with blank lines and the next line's comment sign. Possessive, so that any number of
#: blank lines takes no stack; no known sentence has a word that reads as a comment sign or starts with a point.
WRAP = rf"[ .]*+(?:\n[ .]*+(?:{SIGN_WORDS})?+)++"


def _plain(sentence: str) -> str:
    """What ``normalised`` makes of a known sentence, for the look-up literals."""
    lower = "".join(c if c.isascii() and (c.isalnum() or c == ".") else " " for c in sentence.lower())
    return " ".join(lower.split()).strip(" .")


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> identifier. Notices of several sentences are cut as texts are."""
    return {_plain(text): name for name, text in _single().items()}


def _single() -> dict[str, str]:
    """Identifier -> one sentence: a text that holds a sentence end inside is known by each part, numbered."""
    out = {}
    for name, text in SENTENCES.items():
        parts = [p for p in re.split(SENTENCE_END, text) if p.strip()]
        out |= {name if len(parts) == 1 else f"{name}.{k}": p for k, p in enumerate(parts)}
    return out


def rule_sequences() -> list[tuple[str, str]]:
    """(licence, identifiers as ';a;b;') by length, the longest first; parts of a cut sentence follow each other."""
    names = list(_single())
    spell = lambda name: [n for n in names if n == name or n.rpartition(".")[0] == name]
    rules = [(licence, ";" + ";".join(p for s in parts for p in spell(s)) + ";") for licence, parts in RULES]
    return sorted(rules, key=lambda r: (-r[1].count(";"), r[0], r[1]))


def marked(text: Column) -> Column:
    """Lower case; letters, digits and points, single spaces between, each sentence end as one ``STOP_MARK`` or line break."""
    plain = F.regexp_replace(F.replace(F.lower(text), F.lit(STOP_MARK), F.lit(" ")), SIGN_STOPS, "")
    ended = F.regexp_replace(F.regexp_replace(plain, STOP, re.escape(STOP_MARK)), BREAK, "\n")
    return F.regexp_replace(ended, r"[^a-z0-9.|\n]+", " ")


def known_pattern() -> str:
    """Any known sentence from one sentence end to another in a marked text, the longest first."""
    known = sorted(known_sentences(), key=lambda s: (-len(s), s))
    spelt = "|".join(f"(?: |{WRAP})".join(map(re.escape, s.split())) for s in known)
    return rf"(?<![^|\n])[ .]*(?:{SIGN_WORDS})?(?:{spelt})[ .]*(?![^|\n])"


def unwrapped(found: Column) -> Column:
    """A sentence found in a marked text as ``known_sentences`` spells it."""
    return F.regexp_replace(F.regexp_replace(found, WRAP, " "), rf"^[ .]*(?:{SIGN_WORDS})?|[ .]+$", "")


def with_licences(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``out``: sentences (sentence ends before it, line breaks too, and identifier, in order) and
    licences (distinct, sorted) whose rule matches. A rule inside a longer rule that matches does not count on its own.
    Null and empty texts have none.
    """
    whole = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(whole, F.lit(c))
    table = F.create_map(*(F.lit(x) for pair in known_sentences().items() for x in pair))
    pattern = F.lit(known_pattern())
    ends = lambda s: F.length(s) - F.length(F.translate(s, "|\n", ""))
    # what lies before a sentence and itself, so that the ends before it can be counted
    parts = lambda s: F.arrays_zip(
        F.split(s, known_pattern(), -1).alias("before"), F.regexp_extract_all(s, pattern, F.lit(0)).alias("found")
    )
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<place:int,id:string>>").alias("all"))
    placed = lambda acc, p: F.struct(
        (acc["n"] + ends(p["before"]) + ends(p["found"])).alias("n"),
        F.concat(
            acc["all"],
            F.array(F.struct((acc["n"] + ends(p["before"])).alias("place"), table[unwrapped(p["found"])].alias("id"))),
        ).alias("all"),
    )
    nothing = F.array().cast("array<struct<place:int,id:string>>")
    known = lambda s: F.aggregate(
        F.filter(parts(s), lambda p: p["found"].isNotNull()), start, placed, lambda acc: acc["all"]
    )
    # worked out once, not for each of its uses
    found = F.when(cue, F.get(F.transform(F.array(marked(F.col(text).cast("string"))), known), F.lit(0))).otherwise(nothing)
    line = lambda ids: F.concat(F.lit(";"), F.array_join(ids, ";"), F.lit(";"))
    rules = F.array(*(F.struct(F.lit(a).alias("licence"), F.lit(b).alias("ids")) for a, b in rule_sequences()))
    matched = lambda seq: F.filter(rules, lambda r: F.contains(seq, r["ids"]))
    outer = lambda hits: F.filter(
        hits, lambda r: ~F.exists(hits, lambda o: (F.length(o["ids"]) > F.length(r["ids"])) & F.contains(o["ids"], r["ids"]))
    )
    hits = docs.withColumn(out, F.struct(found.alias("sentences")))
    seq = line(F.col(f"{out}.sentences")["id"])
    names = lambda r: F.array_sort(F.array_distinct(F.transform(r, lambda x: x["licence"])))
    some = F.when(F.size(f"{out}.sentences") > 0, names(outer(matched(seq)))).otherwise(F.array().cast("array<string>"))
    return hits.withColumn(out, F.struct(F.col(f"{out}.sentences").alias("sentences"), some.alias("licences")))
