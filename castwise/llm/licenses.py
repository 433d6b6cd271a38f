"""Licence texts by canonical digest lookup; column expressions only.

A text is brought to a canonical form: lower case, no copyright lines, one spelling of equivalent words, no
punctuation, single blanks. Its digest is looked up in a table of digests of known licences by a hash join. The unit is
always an entire text: the whole document, each of its lines (licence notices are one-line texts), and each block of several
lines: lines between blank lines, and runs of comment lines, whose markers the canonical form drops. A licence quoted
inside a line of other words is not a hit. A text of several paragraphs with blank lines between them is found as a whole
document or in a comment whose marker stands on the blank lines too, not in the middle of other text.

The table of known texts has a fixed size and is broadcast. Null and empty texts match nothing. Rows of
one id count as one document. An empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from castwise.llm.common import given_id, rows_of

# Equivalent spellings, (pattern, replacement), applied in this order to lower-cased words.
SPELLINGS = [
    (r"\blicence", "license"),
    (r"\blicences\b", "licenses"),
    (r"\bsub-?licen[cs]e", "sublicense"),
    (r"\bhttps?://", "https://"),
    (r"\bversion\b|\bver\b", "v"),
    (r"\bv ?([0-9]+)(\.0)*\b", "v$1"),
    (r"\borganis", "organiz"),
    (r"\bfavour", "favor"),
    (r"\bnoncommercial\b|\bnon-commercial\b", "non commercial"),
    (r"&", " and "),
]
COPYRIGHT = r"(?m)^[ \t*#/;-]*(copyright|\(c\)|©)[^\n]*$|all rights reserved"

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_LEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Known licence texts and one-line notices. Titles may stand before the long texts or not.
KNOWN: list[tuple[str, str]] = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", "\n".join([BSD_LEAD, BSD_END])),
    ("BSD-2-Clause", "\n".join(["BSD 2-Clause License", BSD_LEAD, BSD_END])),
    ("BSD-3-Clause", "\n".join([BSD_LEAD, BSD_THIRD, BSD_END])),
    ("BSD-3-Clause", "\n".join(["BSD 3-Clause License", BSD_LEAD, BSD_THIRD, BSD_END])),
    *[("MIT", f"{said} under the MIT License") for said in ("Released", "Licensed", "This work is licensed", "This software is released")],
    *[
        ("Apache-2.0", f"{said} under the Apache License, Version 2.0")
        for said in ("Released", "Licensed", "This work is licensed", "This software is released")
    ],
    *[
        (f"GPL-{v}.0", f"{said} under the GNU General Public License, version {v}")
        for v in (2, 3)
        for said in ("Released", "Licensed", "This work is licensed", "This software is released")
    ],
    *[
        (f"BSD-{v}-Clause", f"{said} under the BSD {v}-Clause License")
        for v in (2, 3)
        for said in ("Released", "Licensed", "This work is licensed")
    ],
    *[
        (f"CC-{kind}-{v}", f"{said} under {the}{name} {v}{end}")
        for kind, long in (
            ("BY", "Attribution"),
            ("BY-SA", "Attribution-ShareAlike"),
            ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC", "Attribution-NonCommercial"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
            ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
        for v in ("3.0", "4.0")
        for said in ("Released", "Licensed", "This work is licensed")
        for the, name, end in (("", f"CC {kind}", ""), ("a ", f"Creative Commons {long}", " International License"), ("a ", f"Creative Commons {long}", " License"))
    ],
    *[
        (name, f"SPDX-License-Identifier: {name}")
        for name in (
            *("MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "CC0-1.0", "Zlib"),
            *(f"{kind}-{which}" for kind in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for which in ("only", "or-later")),
            *(f"CC-{kind}-4.0" for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")),
        )
    ],
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words only, single blanks."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, " ")
    for pattern, put in SPELLINGS:
        out = F.regexp_replace(out, pattern, put)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


MARKED = r"[ \t]*(?:#|//|/?\*|;|--)"


def _blocks(text: Column) -> Column:
    """The text between blank lines, also cut where comment lines begin or end."""
    apart = F.regexp_replace(text, rf"(?m)^({MARKED}[^\n]*)\n(?!{MARKED})", "$1\n\n")
    apart = F.regexp_replace(apart, rf"(?m)^((?!{MARKED})[^\n]*)\n(?={MARKED})", "$1\n\n")
    return F.split(apart, r"\n[ \t\r]*\n")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, license``; one row for each known text."""
    texts = spark.createDataFrame(known or KNOWN, "license string, _text string")
    return texts.select(F.sha2(canonical(F.col("_text")), 256).alias("digest"), "license").distinct()


# Words that SPELLINGS make or lengthen; no stem is taken from them.
_RESPELLED = re.compile(r"licen[cs]e|organi|favo|commercial|https|^v|^and$|^non$")
SHARED_STEM = "licen"  # of all spellings of the word; no replacement makes it out of other letters


def stems_of(canon: list[str]) -> list[str] | None:
    """Parts of words such that every one of the canonical texts comes from a lower-case text with one of them; None if there are none.

    A text with the word licence has its stem. Of others the longest word of letters a to z that no replacement touches is
    taken: its letters stand together in the text as well, since replacements join no letters to others.
    """
    found = set()
    for text in canon:
        plain = [w for w in re.findall(r"(?<!\S)[a-z]{4,}(?!\S)", text) if not _RESPELLED.search(w)]
        if SHARED_STEM not in text and not plain:
            return None
        found.add(SHARED_STEM if SHARED_STEM in text else max(plain, key=lambda w: (len(w), w)))
    return sorted(found)


def license_hits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] | None = None
) -> DataFrame:
    """One row for each hit: ``_id, line`` (-1: the whole document, -2: a block of lines), ``license``."""
    rows = rows_of(docs, id_col, text_col)
    spark = rows.sparkSession
    table = F.broadcast(known_digests(spark, known))
    texts = spark.createDataFrame(known or KNOWN, "license string, _text string")
    stems = stems_of([r[0] for r in texts.select(canonical(F.col("_text"))).distinct().collect()])

    def may_hold(units: DataFrame) -> DataFrame:
        """Units with a stem: the rest cannot be a known text, and the canonical form is the dear part."""
        if stems is None:
            return units
        has = F.lit(False)
        for stem in stems:
            has = has | F.contains(F.lower("_text"), F.lit(stem))
        return units.filter(has)

    rows = may_hold(rows)
    whole = rows.select("_id", F.lit(-1).alias("line"), "_text")
    lined = rows.filter(F.instr("_text", "\n") > 0)
    lines = lined.select("_id", F.posexplode(F.split("_text", "\n")).alias("line", "_text"))
    blocks = lined.select("_id", F.lit(-2).alias("line"), F.explode(_blocks(F.col("_text"))).alias("_text")).filter(F.instr("_text", "\n") > 0)

    def found(units: DataFrame) -> DataFrame:
        return may_hold(units.filter(F.length("_text") > 0)).withColumn("digest", F.sha2(canonical(F.col("_text")), 256)).join(table, "digest")

    # a block with words on one line only is that line's hit, a document of one block is the document's
    several = F.size(F.filter(F.split("_text", "\n"), lambda t: canonical(t) != "")) > 1
    seen = F.when(F.col("license").isNotNull(), several)  # looks at both sides, so it stays behind the join
    extra = found(blocks).filter(seen).join(found(whole).select("_id", "digest"), ["_id", "digest"], "left_anti")
    return found(whole.union(lines)).select("_id", "line", "license").union(extra.select("_id", "line", "license"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document id once: ``id_col, n_hits, whole_text, licenses`` (distinct names in order, comma-joined)."""
    hits = license_hits(docs, id_col, text_col)
    every = rows_of(docs, id_col, text_col).select("_id", F.lit(None).cast("int").alias("line"), F.lit(None).cast("string").alias("license"))
    merged = every.union(hits.select("_id", "line", "license")).groupBy("_id")
    names = F.array_join(F.sort_array(F.collect_set("license")), ",")
    out = merged.agg(
        F.count("license").alias("n_hits"), F.coalesce(F.max(F.col("line") == -1), F.lit(False)).alias("whole_text"), names.alias("licenses")
    )
    return out.select(given_id().alias(id_col), "n_hits", "whole_text", "licenses")


def scan_sql() -> str:
    """The same scan for DuckDB."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def form(text: str) -> str:
        out = f"regexp_replace(lower({text}), {quoted(COPYRIGHT)}, ' ', 'g')"
        for pattern, put in SPELLINGS:
            out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(put.replace('$1', chr(92) + '1'))}, 'g')"
        return f"trim(regexp_replace({out}, {quoted(r'[^\p{L}\p{N}]+')}, ' ', 'g'))"

    values = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in KNOWN)
    return f"""
    WITH known AS (SELECT DISTINCT {form('t')} AS canon, license FROM (VALUES {values}) AS v(license, t)),
    lines AS (
      SELECT doc_id, u.i - 1 AS line, u.s AS t FROM (
        SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda s, i: {{'i': i, 's': s}})) AS u
        FROM documents WHERE contains(text, chr(10)))),
    units AS (SELECT doc_id, -1 AS line, text AS t FROM documents UNION ALL SELECT * FROM lines),
    hits AS (SELECT doc_id, line, license FROM units JOIN known ON {form('t')} = canon WHERE t <> '')
    SELECT d.doc_id, count(license) AS n_hits, coalesce(bool_or(line = -1), false) AS whole_text,
      coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses
    FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN hits USING (doc_id) GROUP BY d.doc_id
    """
