"""Licence scans by canonical digest lookup.

Texts are brought to a canonical form - case, punctuation, copyright lines and
equivalent spellings normalised - and their digests hash-joined to those of
known licences. Whole documents and each of their lines are looked up, so
notices of one line are found inside other text.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What licences are called. Names are put into the templates below.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL v3", "GPL-3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0", "MPL 2.0"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"],
    "ISC": ["ISC License", "ISC"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
TEMPLATES = (
    "Released under the {}.", "Released under {}.", "Licensed under the {}.", "Licensed under {}.", "Distributed under the {}.", "Available under the {}.",
    "This work is licensed under the {}.", "This work is licensed under {}.", "This work is licensed under a {}.", "This project is licensed under the {}.",
    "This software is licensed under the {}.", "This file is licensed under the {}.", "License: {}", "SPDX-License-Identifier: {}",
)

#: Whole texts of short licences.
_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = [
    ("MIT", f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_NO_WARRANTY}"""),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies.")),
    ("0BSD", _ISC.format(".")),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", _BSD.format("\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n")),
]
TITLES = {"MIT": "MIT License", "ISC": "ISC License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License"}

#: (pattern, what replaces it), in order, on lower-case text. In patterns that
#: DuckDB and Java read alike; \1 stands for the first group.
STEPS = (
    (r"(?m)^[^a-z0-9\n]*(?:copyright (?:\(c\)|©|[0-9])|\(c\) [0-9]|©|all rights reserved)[^\n]*$", " "),
    (r"https?://[^ \t\r\n]*", " "),
    (r"&", " and "),
    (r"\b(sub|re)[- ]?licen[cs]", r"\1licens"),
    (r"licence", "license"),
    (r"(?:copyright|right) owner", "copyright holder"),
    (r"\bv(?:ersion|er\.)? ?([0-9])", r" version \1"),
    (r"gpl ?v(?:ersion)? ?([0-9])", r"gpl version \1"),
    (r"([0-9])\.0\b", r"\1"),
    (r"[^a-z0-9]+", " "),
)

#: MD5 of the canonical forms of whole texts that are too long to
#: keep here, as their publishers give them. They change with STEPS. Each text
#: holds the word licence in some spelling.
DIGESTS = [
    ("Apache-2.0", "31cb7d34ba7117a7800b989474d2c756"),  # whole
    ("Apache-2.0", "f1eb2ddf6c2d591210ff723bfe975f1f"),  # whole, the appendix's copyright line filled in
    ("Apache-2.0", "3af9e4095510eec3ebc61123d4b76030"),  # to the end of its terms
    ("Apache-2.0", "72ad57b9ca5c8ef5ce5afff9bf65e08f"),  # terms without their closing line
    ("Artistic-1.0-Perl", "01297679267ad921516667ccd889865e"),  # whole
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),  # whole
    ("CC0-1.0", "051963003b5c219734bed0ccfaf8875d"),  # whole
    ("GFDL-1.2", "15638eb44bc666296db792072583c6d0"),  # whole
    ("GFDL-1.3", "c4f8dc91dc260e4d2bc6358c75636c4e"),  # whole
    ("GPL-1.0", "738cc3b112640d95d4cd79a58967ecea"),  # whole
    ("GPL-1.0", "dbf3c47f5a8f127e58d08cabc1ebb916"),  # to the end of its terms
    ("GPL-1.0", "21fa8693acc5194a648fe02e11f65a72"),  # terms without their closing line
    ("GPL-2.0", "5e39ace6e62f5a7fe9c17b4da986ad8c"),  # whole
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7"),  # to the end of its terms
    ("GPL-2.0", "f2c06efe640b4a281cbe5337cdde80ab"),  # terms without their closing line
    ("GPL-3.0", "d4cf878a24108b96024a75261b13e813"),  # whole
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca"),  # to the end of its terms
    ("GPL-3.0", "17e434cc6db7003444b088cb4cc81e91"),  # terms without their closing line
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),  # whole
    ("LGPL-2.0", "c396ba2f94537628797123bc12cd2d6e"),  # to the end of its terms
    ("LGPL-2.0", "97832943be1e344d51af5aee1b658e4f"),  # terms without their closing line
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),  # whole
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),  # to the end of its terms
    ("LGPL-2.1", "eaf6afb73fc860a002bfbccbe6f07ce7"),  # terms without their closing line
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),  # whole
    ("MPL-1.1", "2ce0d4266659e18b421b004d4bf0bdcc"),  # whole
    ("MPL-2.0", "0f04aa49d4cb32dee15a8c38e250f862"),  # whole
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for pattern, new in STEPS:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(new.replace(r"\1", "$1")))
    return F.trim(out)


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of every known notice and whole licence, alone and under its title."""
    notices = [(k, t.format(n)) for k, names in NAMES.items() for n in names for t in TEMPLATES]
    return notices + TEXTS + [(k, f"{TITLES[k]}\n\n{t}") for k, t in TEXTS if k in TITLES] + [(k, f"The {TITLES[k]} ({k})\n\n{t}") for k, t in TEXTS if k in TITLES]


#: Words that a step of normalisation can write; "licen" is in whatever becomes one with "licens".
_WRITTEN = re.compile(r"licens|[0-9]|^(and|version|gpl|copyright|holder)$")


def literals(forms: list[str]) -> list[str] | None:
    """Strings of which every text with one of these canonical forms holds at least one, in lower case.

    A greedy cover by words that normalisation only copies. None if some form
    has no such word: then nothing can be ruled out.
    """
    words = [{w for w in f.split() if len(w) > 4 and not _WRITTEN.search(w)} | ({"licen"} if "licens" in f else set()) for f in forms]
    out = []
    while words:
        best = max(sorted(Counter(w for own in words for w in own).items()), key=lambda x: x[1], default=None)
        if best is None or not all(words):
            return None
        out.append(best[0])
        words = [own for own in words if best[0] not in own]
    return out


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Licences found: (id, licence, unit, line, digest), unit ``text`` for a whole document or ``line``.

    line counts from 0 and is -1 for whole documents; a document of one line is
    reported under both units. digest is the MD5 of the canonical form.
    ``extra`` adds (licence, text) pairs. A known text of several licences
    counts for the first in order of names.

    Null, empty and blank texts: no rows. Null ids and repeated rows: reported
    like any other. Other columns are ignored. Empty table: no rows. The known
    texts are a list of code and so bounded; every line of every whole text is
    looked up.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([*known_texts(), *extra], "licence string, text string").select("licence", canonical(F.col("text")).alias("form"))
    rows = known.groupBy("form").agg(F.min("licence").alias("licence")).collect()  # the list of code and what the caller adds
    known = spark.createDataFrame([(r["licence"], r["form"]) for r in rows], "licence string, form string").select("licence", F.md5("form").alias("digest"))
    known = known.unionByName(spark.createDataFrame(DIGESTS, "licence string, digest string")).groupBy("digest").agg(F.min("licence").alias("licence"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    needed = literals([*(r["form"] for r in rows), "license"])  # the last for those known by digest
    if needed is not None:
        # what holds none of the literals has no known form; the steps of normalisation are for the rest
        likely = lambda: reduce(Column.__or__, (F.contains(F.lower("text"), F.lit(w)) for w in needed))
        own = own.where(likely())
    units = own.select("id", F.posexplode(F.split("text", "\n")).alias("line", "text")).unionByName(own.select("id", F.lit(-1).alias("line"), "text"))
    if needed is not None:
        units = units.where(likely())
    form = units.withColumn("canonical", canonical(F.col("text"))).where("canonical <> ''")
    found = form.withColumn("digest", F.md5("canonical")).join(F.broadcast(known), "digest")
    return found.select(F.col("id").alias(id_col), "licence", F.when(F.col("line") < 0, "text").otherwise("line").alias("unit"), F.col("line").cast("long").alias("line"), "digest")


def oracle_sql() -> str:
    """The scan of ``documents`` as DuckDB SQL."""

    def form(text: str) -> str:
        out = f"lower({text})"
        for pattern, new in STEPS:
            out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
        return f"trim({out})"

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    rows = ", ".join(f"({quoted(k)}, {quoted(t)})" for k, t in known_texts())
    digests = ", ".join(f"({quoted(k)}, {quoted(d)})" for k, d in DIGESTS)
    return f"""
    WITH texts AS (SELECT licence, md5({form("text")}) AS digest FROM (VALUES {rows}) AS t(licence, text) UNION ALL SELECT * FROM (VALUES {digests}) AS d(licence, digest)),
    known AS (SELECT digest, min(licence) AS licence FROM texts GROUP BY 1),
    lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
    units AS (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS line FROM lines UNION ALL SELECT doc_id, text, -1 FROM documents WHERE text IS NOT NULL),
    forms AS (SELECT doc_id, line, {form("text")} AS canonical FROM units)
    SELECT doc_id, licence, CASE WHEN line < 0 THEN 'text' ELSE 'line' END AS unit, CAST(line AS BIGINT) AS line, md5(canonical) AS digest
    FROM forms JOIN known ON known.digest = md5(canonical) WHERE canonical <> ''"""
