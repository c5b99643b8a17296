"""License scan: Dice coefficient over word bigrams, in DataFrame operations only.

Units of a document are its lines, every run of up to ``RUN`` consecutive lines
(a notice wrapped over lines), its paragraphs (parts between blank lines) of more
lines than that, and the document as a whole. Templates are one-sentence notices
and the paragraphs of full licence texts and of the headers put on files, so a
licence inside a longer document is found by its paragraphs. Units and
templates are normalised alike (lower case, every run of other characters than
letters and digits becomes one blank) and compared by the Dice coefficient of
their bags of word bigrams, 2|A and B| / (|A| + |B|); a bag counts repetitions.

A coefficient of t needs t/(2-t) <= |A|/|B| <= (2-t)/t. So each template is
listed under every bigram count that a matching unit may have, and units meet
templates in an equality join on that count; other templates are never tried.
A match also shares t/(2-t) of the unit's bigrams, so a unit needs that many
words that stand in any template; both counts are summed by line, and only runs,
paragraphs and documents that pass are put together.
The expanded template list has at most (sum of template sizes)/t rows; it holds
ids, sizes and vocabularies, and is broadcast only if its words number at most
``BROADCAST_WORDS``; beyond that Spark joins by shuffle. Of what is left, pairs
whose vocabularies differ too much for the coefficient are dropped before any
bigram is built, and a template's bigrams come by its number.

Defined cases: null and empty texts and lines of one word have no bigram and
match nothing; ties between templates go to the smallest license id, then to the
smallest part, then to the shorter run; of the runs that begin at one line the
best is reported; repeated rows are reported as often as they occur; a document
of one line reports its line only (not the document again); an empty table gives
an empty result; other columns of the input are ignored. What is not found: a
notice in a line or paragraph with so much other prose that no unit reaches the
coefficient.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechframes.llm.common import table

THRESHOLD = 0.8
BROADCAST_WORDS = 4_000_000  # some 100 MB
RUN = 4
KNOWN_WORDS = 5_000  # of all templates; with more of them units are pruned by size alone

# fixed values: notices that publishers put below a text, by SPDX identifier
TEMPLATES = [
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_HOLDERS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_USE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.",
    "You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>.",
)


def _gnu(name: str, version: str) -> list[str]:
    return [part.format(name, version) for part in _GNU]


# fixed values: licence texts and file headers by paragraph, by SPDX identifier
TEXTS = {
    "0BSD": [_AS_IS],
    "AGPL-3.0": _gnu("Affero General Public License", "3"),
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [_USE, _SOURCE, _BINARY, _HOLDERS],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        " ".join([_USE, _SOURCE, _BINARY, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", _HOLDERS]),
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    ],
    "GPL-2.0": _gnu("General Public License", "2")[:1],
    "GPL-3.0": _gnu("General Public License", "3"),
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS,
    ],
    "LGPL-3.0": _gnu("Lesser General Public License", "3"),
    "MIT": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large "
        "and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "This notice may not be removed or altered from any source distribution.",
    ],
}
#: (license id, part, text): part 0 is the notice, full texts follow by paragraph and as a whole
PARTS = [(i, 0, t) for i, t in TEMPLATES]
PARTS += [(i, n, t) for i, ts in TEXTS.items() for n, t in enumerate([*ts, " ".join(ts)] if len(ts) > 1 else ts, 1)]


def normalised(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bigrams(words: F.Column) -> F.Column:
    """Word pairs, each numbered by its occurrence, so that set operations count copies."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(pairs, lambda p, i: F.concat_ws("#", p, F.size(F.filter(F.slice(pairs, 1, i + 1), lambda q: q == p)).cast("string")))


def units_of(docs: DataFrame, sizes: DataFrame, known: list[str], threshold: float, id_col: str, text_col: str) -> DataFrame:
    """(_id, unit, line_no, n_lines, _words, _n), _id being id and text hash, of the units that may match.

    Their bigram count n is one of sizes (_n), and n * threshold / (2 - threshold) + 1
    of their words or more are known ones, words of templates: a match shares that
    many bigrams. Words are counted by line before any unit is put together.
    """
    least = threshold / (2 - threshold)
    # explode(array(x)) keeps Spark from working x out anew for every use
    once = lambda x: F.explode(F.array(x))
    lines = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("doc")).alias("_id"), F.col(text_col).alias("_text"), once(F.transform(F.split(F.col(text_col), "\n"), lambda x: F.filter(F.split(normalised(x), " "), lambda w: w != ""))).alias("_lines"))
    n_lines = F.size("_lines")
    lines = lines.where(n_lines > 0)
    if known:
        lines = lines.select("*", once(F.array_intersect(F.flatten("_lines"), F.array(*map(F.lit, known)))).alias("_known")).where(F.size("_known") > 0)
        hits = lambda x: F.size(F.filter(x, lambda w: F.array_contains("_known", w)))
    else:
        hits = F.size
    # a paragraph is the lines between runs of blank ones, of which the text's first and last line are no part
    inner = F.transform(F.split("_text", "\n"), lambda x, i: (i > 0) & (i < n_lines - 1) & x.rlike(r"^\s*\z"))
    lines = lines.select("_id", "_lines", once(F.when(n_lines > RUN, inner)).alias("_inner"), once(F.transform("_lines", F.size)).alias("_counts"), once(F.transform("_lines", hits)).alias("_hits"))
    total = lambda c, first, n: F.aggregate(F.slice(c, first, n), F.lit(0), lambda a, x: a + x)
    numbers = F.sequence(F.lit(0), n_lines - 1)

    def unit(kind: str, line_no: F.Column, first: F.Column, n: F.Column) -> F.Column:
        return F.struct(F.lit(kind).alias("unit"), line_no.alias("line_no"), n.alias("n_lines"), first.alias("_first"), (total("_counts", first + 1, n) - 1).alias("_n"), total("_hits", first + 1, n).alias("_hit"))

    # runs of lines begin and end with a line of words
    begins = F.filter(numbers, lambda i: F.get("_hits", i) > 0 if known else F.get("_counts", i) > 0)
    begins = F.array_distinct(F.flatten(F.transform(begins, lambda i: F.sequence(F.greatest(i - RUN + 1, F.lit(0)), i)))) if known else begins
    begins = F.filter(begins, lambda i: F.get("_counts", i) > 0)
    ends = lambda i: F.filter(F.sequence(F.lit(1), F.least(F.lit(RUN), n_lines - i)), lambda k: F.get("_counts", i + k - 1) > 0)
    runs = F.flatten(F.transform(begins, lambda i: F.transform(ends(i), lambda k: unit("lines", i, i, k))))
    whole = F.transform(F.filter(F.array(n_lines), lambda n: n > 1), lambda n: unit("document", F.lit(-1), F.lit(0), n))
    outer = lambda i: ~F.coalesce(F.get("_inner", i), F.lit(True))
    first = F.filter(numbers, lambda i: outer(i) & ~outer(i - 1))
    last = F.filter(numbers, lambda i: outer(i) & ~outer(i + 1))
    spans = F.zip_with(first, last, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n")))
    spans = F.filter(F.transform(spans, lambda x, p: F.struct(p.alias("p"), x["at"].alias("at"), x["n"].alias("n"))), lambda x: x["n"] > RUN)
    parts = F.transform(spans, lambda x: unit("paragraph", x["p"], x["at"], x["n"]))
    enough = lambda u: (u["_n"] > 0) & (u["_hit"] >= u["_n"] * F.lit(least) + 1 - 1e-9)
    # all units of a document come from one reading of it
    units = lines.select("_id", "_lines", F.inline(F.filter(F.concat(runs, whole, parts), enough)))
    return units.select("_id", "unit", "line_no", "n_lines", F.flatten(F.slice("_lines", F.col("_first") + 1, F.col("n_lines"))).alias("_words"), "_n").join(sizes, "_n", "left_semi")


def scan(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches: (id, unit, line_no, n_lines, license_id, part, shared, dice).

    unit is "lines" (line_no from 0, and as many lines), "paragraph" (line_no is
    the paragraph's number) or "document" (line_no is -1). ``templates`` has
    license_id, part and text; of several that a unit matches, the one of the
    highest coefficient is kept.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    words = templates.select("license_id", "part", F.split(normalised(F.col("text")), " ").alias("_own")).where(F.size("_own") > 1)
    size = F.size("_own") - 1
    listed = (
        words.withColumn("_size", size)
        .withColumn("_n", F.explode(F.sequence(F.ceil(size * low - 1e-9).cast("int"), F.floor(size * high + 1e-9).cast("int"))))
        # a template pair that the unit lacks has two words at most
        .withColumn("_may_lack", 2 * (F.col("_size") - F.ceil((F.col("_size") + F.col("_n")) * (threshold / 2) - 1e-9)))
        .withColumn("_vocabulary", F.array_distinct("_own"))
        .drop("_own")
    )
    theirs = words.select("license_id", "part", bigrams(F.col("_own")).alias("_theirs"))
    sizes = listed.select("_n").distinct()
    known = [r[0] for r in words.select(F.explode("_own")).distinct().limit(KNOWN_WORDS + 1).collect()]
    known = sorted(known) if len(known) <= KNOWN_WORDS else []
    if (listed.agg(F.sum(F.size("_vocabulary"))).first()[0] or 0) <= BROADCAST_WORDS:
        listed, theirs, sizes = F.broadcast(listed), F.broadcast(theirs), F.broadcast(sizes)
    found = (
        units_of(docs, sizes, known, threshold, id_col, text_col)
        .join(listed, "_n")
        .where(F.size(F.array_except("_vocabulary", "_words")) <= F.col("_may_lack"))
        .join(theirs, ["license_id", "part"])
        .withColumn("shared", F.size(F.array_intersect(bigrams(F.col("_words")), "_theirs")))
        .withColumn("dice", F.col("shared") * 2 / (F.col("_n") + F.col("_size")))
        .where(F.col("dice") >= threshold)
    )
    # repeated rows tie and all stay; templates are few, so are the matches of a unit
    best = Window.partitionBy("_id", "unit", "line_no").orderBy(F.desc("dice"), "license_id", "part", "n_lines")
    return (
        found.withColumn("_rank", F.rank().over(best))
        .where("_rank = 1")
        .select(F.col("_id.id").alias(id_col), "unit", "line_no", "n_lines", "license_id", "part", F.col("shared").cast("long").alias("shared"), "dice")
    )


def template_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARTS, "license_id string, part int, text string")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and matched unit."""
    found = scan(table(spark, sf_dir, "documents"), template_frame(spark))
    return found.select("doc_id", "unit", F.col("line_no").cast("long").alias("line_no"), F.col("n_lines").cast("long").alias("n_lines"), "license_id", F.col("part").cast("long").alias("part"), "shared", F.round("dice", 6).alias("dice"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_PAIRS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
_WORDS = "string_split(trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
_NUMBERED = "list_transform(range(1, len(p) + 1), lambda i: p[i] || '#' || len(list_filter(p[1:i], lambda q: q = p[i])))"

ORACLE = f"""
WITH templates(license_id, part, text) AS (VALUES {", ".join(f"({_sql_text(i)}, {n}, {_sql_text(t)})" for i, n, t in PARTS)}),
theirs AS (
  SELECT license_id, part, {_NUMBERED} AS b FROM (SELECT license_id, part, {_PAIRS} AS p FROM (SELECT license_id, part, {_WORDS.format("text")} AS w FROM templates) WHERE len(w) > 1)
),
known AS (SELECT DISTINCT unnest({_WORDS.format("text")}) AS word FROM templates),
lined AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: list_filter({_WORDS.format("x")}, lambda y: y <> '')) AS ls FROM documents WHERE text IS NOT NULL),
hits AS (SELECT doc_id, list(DISTINCT word) AS ks FROM (SELECT DISTINCT doc_id, unnest(flatten(ls)) AS word FROM lined) JOIN known USING (word) GROUP BY doc_id),
docs AS (SELECT * FROM lined JOIN hits USING (doc_id)),
starts AS (SELECT doc_id, ls, ks, unnest(range(0, len(ls))) AS i FROM docs),
runs AS (SELECT doc_id, ls, ks, i, unnest(range(1, least({RUN}, len(ls) - i) + 1)) AS k FROM starts),
units AS (
  SELECT doc_id, 'lines' AS unit, i AS line_no, k AS n_lines, flatten(ls[i + 1:i + k]) AS w, ks FROM runs WHERE len(ls[i + 1]) > 0 AND len(ls[i + k]) > 0
  UNION ALL SELECT doc_id, 'document', -1, len(ls), flatten(ls), ks FROM docs WHERE len(ls) > 1
  UNION ALL SELECT doc_id, 'paragraph', i - 1, len(string_split(ps[i], chr(10))), list_filter({_WORDS.format("ps[i]")}, lambda y: y <> ''), ks
  FROM (SELECT doc_id, ks, ps, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, ks, string_split_regex(text, '\\n\\s*\\n') AS ps FROM docs WHERE len(ls) > {RUN})) WHERE len(string_split(ps[i], chr(10))) > {RUN}
),
near AS (
  SELECT doc_id, unit, line_no, n_lines, license_id, part, t.b AS b, w
  FROM (SELECT * FROM units WHERE len(w) > 1 AND len(list_filter(w, lambda x: list_contains(ks, x))) >= (len(w) - 1) * {THRESHOLD} / (2 - {THRESHOLD})) s JOIN theirs t
  ON len(s.w) - 1 BETWEEN len(t.b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(t.b) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9
),
scored AS (
  SELECT doc_id, unit, line_no, n_lines, license_id, part, len(list_intersect(a, b)) AS shared, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice
  FROM (SELECT doc_id, unit, line_no, n_lines, license_id, part, b, {_NUMBERED} AS a FROM (SELECT doc_id, unit, line_no, n_lines, license_id, part, b, {_PAIRS} AS p FROM near))
)
SELECT doc_id, unit, CAST(line_no AS BIGINT) AS line_no, CAST(n_lines AS BIGINT) AS n_lines, license_id, CAST(part AS BIGINT) AS part, CAST(shared AS BIGINT) AS shared, round(dice, 6) AS dice
FROM (SELECT *, rank() OVER (PARTITION BY doc_id, unit, line_no ORDER BY dice DESC, license_id, part, n_lines) AS r FROM scored WHERE dice >= {THRESHOLD})
WHERE r = 1
"""
