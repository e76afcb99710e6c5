"""Licence scans: normalised passages compared to templates by the Dice coefficient of word bigrams.

DataFrame functions only.  Passages are the lines of a text, its paragraphs (between blank
lines) of more than one line, and its sentences where they are not lines: so a notice is
found on a line of its own, wrapped over lines, or as a sentence inside a longer line.  A
licence text is found by its paragraphs, which are templates of their own; a template of
several sentences in the midst of a paragraph of other text is not found.  Passages and
templates are normalised alike (lower case, every run of characters that are not letters or
digits is one blank) and become sets of word bigrams.  With a and b bigrams and ``least`` as
threshold, Dice 2*|common|/(a+b) can only reach it if a*least/(2-least) <= b <=
a*(2-least)/least; these size bounds drop templates before any overlap is counted.  What is
left is counted by an equi-join of passage bigrams with template bigrams, so no passage meets
a template it shares nothing with.  Templates are a parameter; their bigrams are broadcast
only up to ``MOST_BROADCAST`` rows and joined by shuffle beyond that.

Null and empty texts have no passages and no matches; a passage of one word has that
word as its only gram.  Repeated rows are reported each for themselves: matches are
counted by (document, text), so rows that repeat give one row of findings with the
number of rows.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.shared import table

LEAST = 0.8
MOST_BROADCAST = 100_000

# Licence notices as they are commonly written, and the paragraphs of licence texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)
#: Where a text is cut for each kind of passage; a cut mark stands between passages.
CUT = "\x01"
PASSAGES = ("line", "paragraph", "sentence")


def templates(spark: SparkSession, rows: tuple = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "template_id int, license string, template string")


def grams(words: Column) -> Column:
    """Distinct bigrams of an array of words; a single word stands for itself."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(words) >= 2, pairs).otherwise(words))


def _once(value: Column) -> Column:
    """The value computed once a row: what a generator puts out is not inlined into the expressions that use it."""
    return F.explode(F.array(value))


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _passages(text: Column, kind: str) -> Column:
    """The passages of one kind in order; paragraphs of one line are left empty, as they are lines."""
    if kind == "line":
        return F.split(text, "\n")
    if kind == "paragraph":
        cut = F.split(F.regexp_replace(text, r"\n[ \t\r]*\n", CUT), CUT)
        return F.transform(cut, lambda p: F.when(F.contains(p, F.lit("\n")), p).otherwise(""))
    return F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n]+", "$1" + CUT), CUT)


def scan(docs: DataFrame, kinds: DataFrame, least: float = LEAST, text: str = "text", key: str = "doc_id", passages: tuple[str, ...] = PASSAGES) -> DataFrame:
    """Matches: key, passage (kind), place (1-based), license, template_id, dice, n_rows; the best template of a passage, the lowest id on ties."""
    words = F.split(normalised(F.col("template")), " ")
    kinds = kinds.withColumn("_tg", grams(words)).withColumn("_tn", F.size("_tg"))
    n_kinds, lo, hi = kinds.agg(F.sum("_tn"), F.min("_tn"), F.max("_tn")).first()
    small, large = least / (2 - least), (2 - least) / least
    if not n_kinds:
        lo = hi = 0
    kind_grams = kinds.select("template_id", "license", "_tn", F.explode("_tg").alias("_gram"))
    if (n_kinds or 0) <= MOST_BROADCAST:
        kind_grams = F.broadcast(kind_grams)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    every = F.array(*[F.struct(F.lit(k).alias("kind"), _passages(F.col("_text"), k).alias("of")) for k in passages])
    cut = rows.select("_key", F.xxhash64("_text").alias("_tid"), F.explode(every).alias("_p")).select("_key", "_tid", F.col("_p.kind").alias("_kind"), F.posexplode("_p.of").alias("_place", "_passage"))
    # a bigram takes three characters at least, but for a passage of one word
    cut = cut.where((F.length("_passage") > 0) & ((F.length("_passage") >= F.lit(2 * small * lo)) | F.lit(lo <= 1)))
    cut = cut.select("_key", "_tid", "_kind", "_place", _once(F.split(normalised(F.col("_passage")), " ")).alias("_words"))
    cut = cut.where((F.size("_words") >= F.lit(small * lo)) & (F.element_at("_words", 1) != ""))
    cut = cut.select("_key", "_tid", "_kind", "_place", _once(grams(F.col("_words"))).alias("_grams")).withColumn("_n", F.size("_grams"))
    cut = cut.where((F.col("_n") >= F.lit(small * lo)) & (F.col("_n") <= F.lit(large * hi)))
    own = ["_key", "_tid", "_kind", "_place"]
    hits = cut.select(*own, "_n", F.explode("_grams").alias("_gram")).join(kind_grams, "_gram")
    hits = hits.where((F.col("_tn") >= F.col("_n") * small) & (F.col("_tn") <= F.col("_n") * large))
    # rows that repeat count each gram once a row
    hits = hits.groupBy(*own, "template_id", "license", "_n", "_tn").agg(F.count("*").alias("_c"), F.count_distinct("_gram").alias("_common"))
    hits = hits.withColumn("dice", 2 * F.col("_common") / (F.col("_n") + F.col("_tn"))).where(F.col("dice") >= least)
    best = hits.groupBy(*own).agg(
        F.min_by(F.struct("license", "template_id", "dice", (F.col("_c") / F.col("_common")).cast("long").alias("n_rows")), F.struct(-F.col("dice"), "template_id")).alias("_b"))
    return best.select(F.col("_key").alias(key), F.col("_kind").alias("passage"), (F.col("_place") + 1).alias("place"), "_b.license", "_b.template_id", "_b.dice", "_b.n_rows")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole document: one row a matching line, paragraph or sentence."""
    out = scan(table(spark, sf_dir, "documents"), templates(spark))
    return out.select("doc_id", "passage", F.col("place").cast("long").alias("place"), "license", F.col("template_id").cast("long").alias("template_id"), F.round("dice", 6).alias("dice"))


_VALUES = ", ".join("(%d, '%s', '%s')" % (i, a, b.replace("'", "''")) for i, (a, b) in enumerate(TEMPLATES))
OP9_SQL = rf"""
WITH t AS (SELECT * FROM (VALUES {_VALUES}) v(template_id, license, template)),
tg AS (SELECT template_id, license, list_distinct(CASE WHEN len(w) >= 2
    THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g
  FROM (SELECT *, string_split(trim(regexp_replace(lower(template), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t)),
cut AS (SELECT doc_id, 'line' AS passage, string_split(text, chr(10)) AS c FROM documents
  UNION ALL SELECT doc_id, 'paragraph', list_transform(string_split(regexp_replace(text, '\n[ \t\r]*\n', chr(1), 'g'), chr(1)), lambda p: CASE WHEN contains(p, chr(10)) THEN p ELSE '' END) FROM documents
  UNION ALL SELECT doc_id, 'sentence', string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)) FROM documents),
lines AS (SELECT doc_id, passage, unnest(c) AS p, unnest(range(1, len(c) + 1)) AS place FROM cut),
lg AS (SELECT doc_id, passage, place, list_distinct(CASE WHEN len(w) >= 2
    THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g
  FROM (SELECT *, string_split(trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM lines) WHERE w[1] <> ''),
m AS (SELECT doc_id, passage, place, license, template_id, 2 * len(list_intersect(lg.g, tg.g)) / (len(lg.g) + len(tg.g))::DOUBLE AS dice FROM lg, tg
  WHERE len(tg.g) BETWEEN len(lg.g) * {LEAST / (2 - LEAST)} AND len(lg.g) * {(2 - LEAST) / LEAST})
SELECT doc_id, passage, place::BIGINT AS place, license, template_id::BIGINT AS template_id, round(dice, 6) AS dice FROM m WHERE dice >= {LEAST}
QUALIFY row_number() OVER (PARTITION BY doc_id, passage, place ORDER BY dice DESC, template_id) = 1
"""

QUERIES = {"op9_licenses": op9_licenses}
SQL = {"op9_licenses": OP9_SQL}
