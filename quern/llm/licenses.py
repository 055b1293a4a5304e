"""License scan by sentence rules. DataFrame functions only.

A text is cut into pieces at sentence marks and line breaks, pieces are
normalised, and each run of pieces that makes up a known sentence becomes an
identifier (the longest one where several start at one piece). So marks inside a
known sentence, wrapped lines, indents, comment marks and ``\\r`` do not hide it. One
break stays a break: a bare line that starts with a capitalised word, after a
line of under ``FULL`` characters that ends in lower case, is a line of its own.
The sequence of identifiers is matched against ordered
rules: a rule takes the runs of identifiers that it matches, so that later rules
cannot use them again, and names a licence. What is left over stays visible as
unmatched sentences.

Defined results: null and empty texts have no sentences and no licence; rows
that repeat an id each give a row; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts, with identifiers.
# A number in a sentence stands as it is; years and holders are cut beforehand.
SENTENCES = {
    "released under the mit license": "MITref",
    "licensed under the mit license": "MITref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITgrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "licensed under the apache license version 2 0": "Apache2ref",
    "licensed under the apache license version 2 0 the license": "Apache2ref",
    "you may not use this file except in compliance with the license": "Apache2comply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "Apache2copy",
    "this work is licensed under the gnu general public license version 3": "GPL3ref",
    "this work is licensed under the gnu general public license version 2": "GPL2ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLnowarranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDgrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSDname",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2ref",
    "licensed under cc by 4 0": "CCBY4ref",
    "licensed under cc by sa 4 0": "CCBYSA4ref",
    "licensed under cc by nc 4 0": "CCBYNC4ref",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "AllRights",
    "copyright": "Copyright",
}

# Rules in order; identifiers in sequence, others may stand between
# where "..." stands. Longer texts come before the references they contain.
RULES = [
    ("MIT", ["MITgrant", "...", "MITnotice", "...", "MITasis"]),
    ("Apache-2.0", ["Apache2ref", "...", "Apache2comply", "...", "Apache2copy"]),
    ("GPL-3.0-or-later", ["GPL3plus", "...", "GPLnowarranty"]),
    ("GPL-3.0-or-later", ["GPL3plus"]),
    ("GPL-2.0-or-later", ["GPL2plus", "...", "GPLnowarranty"]),
    ("GPL-2.0-or-later", ["GPL2plus"]),
    ("BSD-3-Clause", ["BSDgrant", "...", "BSDsource", "...", "BSDbinary", "...", "BSDname"]),
    ("BSD-2-Clause", ["BSDgrant", "...", "BSDsource", "...", "BSDbinary"]),
    ("MIT", ["MITref"]),
    ("Apache-2.0", ["Apache2ref"]),
    ("GPL-3.0-only", ["GPL3ref"]),
    ("GPL-2.0-only", ["GPL2ref"]),
    ("MPL-2.0", ["MPL2ref"]),
    ("CC-BY-4.0", ["CCBY4ref"]),
    ("CC-BY-SA-4.0", ["CCBYSA4ref"]),
    ("CC-BY-NC-4.0", ["CCBYNC4ref"]),
    ("Unlicense", ["Unlicense"]),
    ("All-Rights-Reserved", ["Copyright", "AllRights"]),
    ("All-Rights-Reserved", ["AllRights"]),
]

# Every known sentence holds one of these words.
HINT = r"(?i)licens|copyright|copies|conditions|warrant|redistribut|rights|public"
# A line that goes on in lower case belongs to the sentence before it.
WRAP = r"([a-z,])\n([a-z])"
CUT = r"[.!?;:]\s+|[\r\n]+"
# A line this long was wrapped, whatever the next one starts with.
FULL = 50
# A short line before a capitalised word: no known sentence goes on there.
OWN_LINE = rf"(?m)^([^\r\n]{{0,{FULL - 2}}}[a-z])\r?\n(?=[A-Z][a-z])"
# Marks of cuts that a known sentence may hold, and of those it may not.
SOFT, HARD = "\x01", "\x02"
HOLDER = r"^(copyright)( c)?( [0-9]{4}.*)$"


def rule_pattern(parts: list[str]) -> str:
    """A rule as a pattern over `` a b c ``: identifiers with a space on either side."""
    return "".join("(?: [A-Za-z0-9]+)*?" if p == "..." else f" {p}" for p in parts) + "(?= |$)"


def normalised(text: Column) -> Column:
    """Normalised pieces, each between two marks."""
    cut = F.regexp_replace(F.translate(text, SOFT + HARD, "  "), WRAP, "$1 $2")
    cut = F.regexp_replace(cut, OWN_LINE, f"$1{HARD}")
    cut = F.concat(F.lit(HARD), F.regexp_replace(cut, CUT, SOFT), F.lit(HARD))
    plain = F.regexp_replace(F.lower(cut), f"[^a-z0-9{SOFT}{HARD}]+", " ")
    plain = F.regexp_replace(plain, f" ?{SOFT}[ {SOFT}]*+", SOFT)  # empty pieces go
    plain = F.regexp_replace(plain, f"[ {SOFT}]?{HARD}[ {SOFT}{HARD}]*+", HARD)
    return F.regexp_replace(plain, HOLDER.replace("^", f"(?<=[{SOFT}{HARD}])").replace(".*", f"[^{SOFT}{HARD}]*+").replace("$", f"(?=[{SOFT}{HARD}])"), "$1")


def known_pattern() -> str:
    """Any known sentence as a run of whole pieces, longer ones first."""
    runs = "|".join(s.replace(" ", f"[ {SOFT}]") for s in sorted(SENTENCES, key=lambda s: (-len(s), s)))
    return f"(?<=[{SOFT}{HARD}])(?:{runs})(?=[{SOFT}{HARD}])"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences, in order."""
    known = F.create_map(*[F.lit(x) for pair in SENTENCES.items() for x in pair])
    runs = F.regexp_extract_all(normalised(text), F.lit(known_pattern()), F.lit(0))
    found = F.transform(runs, lambda s: F.element_at(known, F.translate(s, SOFT, " ")))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licenses, unmatched)`` per row."""
    ids = sentence_ids(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select("doc_id", ids.alias("ids"))
    rest = F.when(F.size("ids") > 0, F.concat(F.lit(" "), F.array_join("ids", " "))).otherwise("")
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), rest.alias("rest"), F.array().cast("array<string>").alias("named"))
    for name, parts in RULES:
        pattern = rule_pattern(parts)
        # a taken run leaves a bar, so that what stood around it does not join up
        rows = rows.select("doc_id", "n_sentences", "sentence_ids",
                           F.when(F.col("rest").rlike(pattern), F.concat("named", F.array(F.lit(name)))).otherwise(F.col("named")).alias("named"),
                           F.regexp_replace("rest", pattern, " |").alias("rest"))
    left = F.filter(F.split(F.trim("rest"), " "), lambda i: (i != "|") & (i != ""))
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_distinct("named"), ",").alias("licenses"), F.array_join(left, " ").alias("unmatched"))
