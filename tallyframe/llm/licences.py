"""Licence scans by canonical digests (native).

A text is brought to canonical form (lower case, copyright lines dropped, Unicode punctuation to blanks,
equivalent spellings to one, blanks collapsed) and hashed.  A copyright line has a year, a copyright sign or
a placeholder, or is a short line that begins a paragraph; a line that continues a sentence is none.  Digests of entire texts are joined to
the digests of known licences; the same is done for every line of a text, each as an entire text, to
find notices.  The known side is the fixed list below with the files of ``licence_texts``, so its broadcast
has a proven bound; a table of other texts can be given, whose broadcast is left to Spark's size check.

Defined cases: null text is empty and has the digest of the empty string, which matches nothing;
repeated rows get equal results; an empty table gives no rows; texts of any length are read whole; of licences with one
digest the first name counts.  Only the two named columns are read, so others may have any names.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, text_key

#: What may stand before the words of a line, and four words that end it.
LEAD, SHORT = "[ \t*#/;.-]*", "[ \t]*[^ \t\n]+(?:[ \t]+[^ \t\n]+){0,3}[ \t]*"
#: Steps on the lower-cased text with a line feed before it: plain replacements (cheap where nothing is
#: found) and, marked True, regular expressions (groups are written $1; no lookaround, which DuckDB lacks).
LINE_STEPS = [
    ("\r\n", "\n", False), ("\r", "\n", False),
    # lines that continue a sentence or are items of a list; ~ keeps them from being taken for copyright lines
    (f"\n({LEAD})(copyright[ \t]+(?:notice|holder|owner|law|licen[cs]e|act|statement|right|protect|claim|infring|interest"
     "|treat|and |or |in |is |of |to |for |that |which |as |has |may ))", "\n$1~$2", True),
    (f"\n({LEAD})(\\(c\\)[ \t]+(?:you|your|any|all|an|a|to|if|in|for|this|that|each|under|by|as|or|and|with|which|such|it|no|not"
     "|where|when)[ \t\n])", "\n$1~$2", True),
    # copyright lines
    (f"\n{LEAD}copyright[ \t:,]*(?:\\(c\\)|©|[\\[{{<]|[^\n]{{0,80}}(?:19|20)[0-9][0-9])[^\n]*", "\n", True),
    (f"\n{LEAD}(?:©|\\(c\\)[^\n]*(?:19|20)[0-9][0-9])[^\n]*", "\n", True),
    (f"(?:\n{LEAD}\\(c\\){SHORT})+(\n|\\z)", "\n$1", True),
    (f"(\\A|\n{LEAD})\n{LEAD}copyright[ \t]{SHORT}(\n|\\z)", "$1\n$2", True),
    # punctuation; & is a word, apostrophes and invisible characters join
    ("&", " and ", False), ("'", "", False), ("`", "", False), ("’", "", False), ("‘", "", False), ("ʼ", "", False), ("′", "", False),
    ("­", "", False), ("​", "", False), ("﻿", "", False),
    ("[^\\p{L}\\p{M}\\p{N}\n ]+", " ", True), (" {2,}", " ", True),
    # equivalent spellings
    ("licence", "license", False), ("licencing", "licensing", False), ("behaviour", "behavior", False),
    ("colour", "color", False), ("favour", "favor", False), ("honour", "honor", False), ("labour", "labor", False),
    ("acknowledgement", "acknowledgment", False), ("judgement", "judgment", False), ("authoris", "authoriz", False),
    ("customis", "customiz", False), ("initialis", "initializ", False), ("organis", "organiz", False),
    ("personalis", "personaliz", False), ("recognis", "recogniz", False), ("utilis", "utiliz", False),
    ("whilst", "while", False), ("https", "http", False),
]
#: Steps on one line, or on a whole text whose line feeds have become blanks.
PHRASE_STEPS = [
    ("sub licens", "sublicens", False), ("non commercial", "noncommercial", False), ("per cent", "percent", False),
    ("copyright holder", "copyright owner", False), ("version ([0-9])", "v$1", True),
]

# Texts of well-known licences and notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""
BSD_THREE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
END = "END OF TERMS AND CONDITIONS"


def _texts() -> list[tuple[str, str]]:
    """The licences of ``licence_texts``, whole and without what tells how to apply them."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    whole = [(f.stem, f.read_text(encoding="utf-8")) for f in files]
    return whole + [(name, t[:t.index(END) + len(END) * k]) for name, t in whole if END in t for k in (0, 1)]


LICENCES = [
    ("MIT", MIT), ("MIT", "MIT License\n\n" + MIT), ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC), ("ISC", "ISC License\n\n" + ISC), ("0BSD", ISC.replace(
        ", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("BSD-2-Clause", BSD_HEAD + BSD_TAIL), ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", BSD_HEAD + BSD_THREE + BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THREE + BSD_TAIL),
    ("Zlib", ZLIB), ("Zlib", "zlib License\n\n" + ZLIB), ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."), ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
] + [(x, f"SPDX-License-Identifier: {x}") for x in (
    "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Apache-2.0", "MPL-2.0", "GPL-2.0", "GPL-3.0",
    "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0")] + _texts()


def _apply(text: Column, steps: list[tuple[str, str, bool]]) -> Column:
    for old, new, regex in steps:
        text = F.regexp_replace(text, old, new) if regex else F.replace(text, F.lit(old), F.lit(new))
    return text


def canonical_lines(text: Column) -> Column:
    """The canonical text but for phrases, with its line feeds kept."""
    return _apply(F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit("")))), LINE_STEPS)


def joined(lines: Column) -> Column:
    """The canonical whole text: wrapped lines are one."""
    return F.trim(_apply(F.regexp_replace(F.replace(lines, F.lit("\n"), F.lit(" ")), " {2,}", " "), PHRASE_STEPS))


def canonical(text: Column) -> Column:
    return joined(canonical_lines(text))


def digest(canon: Column) -> Column:
    return F.sha2(canon.cast("binary"), 256)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """digest, licence of the fixed list, or of the rows (licence, text) of ``known`` (one row per digest)."""
    rows = spark.createDataFrame(LICENCES, "licence string, text string") if known is None else known
    canon = rows.select("licence", canonical(F.col("text")).alias("canon")).where("canon <> ''")
    return canon.groupBy(digest(F.col("canon")).alias("known")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licence_texts: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, digest of the whole text, licence (of the whole text, or null) and notices
    (licences of which a line is the entire text, sorted, comma-joined; empty if none).  The rows
    (licence, text) of ``licence_texts`` take the place of the fixed list if given."""
    known = known_digests(docs.sparkSession, licence_texts)
    known = F.broadcast(known) if licence_texts is None else known
    names = sorted({name for name, _ in LICENCES})  # under 64: a set of them is a long
    bit = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)]), F.col("licence")).cast("long")
    base = docs.select(col(id_col).alias("doc_id"), text_key(col(text_col)).alias("key"), canonical_lines(col(text_col)).alias("lines"))
    # one pass: the lines of a text meet again as a set of licences; the first line counts the rows that are equal
    # the digest of the whole is taken before the lines part, else it is taken once per line; the outer
    # form spares a filter on the number of lines, which would canonicalise a second time
    whole = base.select("doc_id", "key", digest(joined(F.col("lines"))).alias("digest"), F.split("lines", "\n").alias("lines"))
    lines = (whole.select("doc_id", "key", "digest", F.posexplode_outer("lines").alias("pos", "line"))
             .select("doc_id", "key", "digest", "pos", digest(F.trim(_apply(F.col("line"), PHRASE_STEPS))).alias("line")))
    texts = (lines.join(known.withColumnRenamed("known", "line"), "line", "left").groupBy("doc_id", "key", "digest")
             .agg(F.coalesce(F.bit_or(bit), F.lit(0)).alias("found") if licence_texts is None else F.collect_set("licence").alias("found"), F.sum((F.col("pos") == 0).cast("int")).alias("n")))
    flags = (F.filter(F.array(*[F.lit(n) for n in names]), lambda n, i: F.getbit("found", i) == 1) if licence_texts is None
             else F.array_sort("found"))
    return (texts.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
            .join(known, F.col("digest") == F.col("known"), "left")
            .select("doc_id", "digest", "licence", F.array_join(flags, ",").alias("notices")))


def oracle() -> str:
    """The scan in DuckDB SQL, from the same steps."""
    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def run(x: str, steps: list[tuple[str, str, bool]]) -> str:
        for old, new, regex in steps:
            x = (f"regexp_replace({x}, {q(old)}, {q(new.replace('$', chr(92)))}, 'g')" if regex else f"replace({x}, {q(old)}, {q(new)})")
        return x

    def lines(x: str) -> str:
        return run(f"chr(10) || lower(coalesce({x}, ''))", LINE_STEPS)

    whole = f"trim({run("regexp_replace(replace(lines, chr(10), ' '), ' {2,}', ' ', 'g')", PHRASE_STEPS)}, ' ')"
    values = ", ".join(f"({q(a)}, {q(b)})" for a, b in LICENCES)
    return f"""WITH lic(licence, txt) AS (VALUES {values}),
known AS (SELECT sha256({whole}) AS known, min(licence) AS licence FROM (SELECT licence, {lines('txt')} AS lines FROM lic) GROUP BY 1),
base AS (SELECT row_number() OVER () AS n, doc_id, {lines('text')} AS lines FROM documents),
found AS (SELECT n, string_agg(DISTINCT k.licence, ',' ORDER BY k.licence) AS notices
  FROM (SELECT n, trim({run("unnest(string_split(lines, chr(10)))", PHRASE_STEPS)}, ' ') AS line FROM base) l JOIN known k ON sha256(line) = k.known AND line <> '' GROUP BY n)
SELECT doc_id, sha256({whole}) AS digest, k.licence AS licence, coalesce(f.notices, '') AS notices
FROM base LEFT JOIN known k ON sha256({whole}) = k.known LEFT JOIN found f USING (n)"""
