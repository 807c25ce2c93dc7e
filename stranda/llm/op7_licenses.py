r"""Licence scan: sparse TF-IDF cosine of header blocks and licence files to templates, then inheritance from directories.

Units of a file, comment marks left out: its lines, its paragraphs (up to an empty line), its leading comment and, where
the name says that it is a licence (LICENSE, COPYING, ...), the whole text. Of other files, only those count that speak of
a licence (KEYWORDS). Equal units are scored once, however many files hold them: the words of each distinct unit and of each
template are weighted by tf * ln(1 + N / df), with df and N counted over all files' units and the templates, and units and
templates that share words are joined on them. A file's own licence is the template of the best unit of the largest kind
that has a cosine of LEAST at least, so what a notice says as a whole goes before its single lines. Files whose name says
so also give their licence to their directory. A file without an own licence inherits that of the nearest directory above
it that has one: each distinct directory is exploded into its ancestors, which are joined with the licensed directories.

Templates are fixed and few (broadcast); everything else is joined by whatever Spark picks. Null or empty text: no own
licence. Null path: no directory, so nothing is inherited. Repeated rows: a row of results each. Ties between templates or
between licence files of a directory go to the higher score, then the alphabetically first name. An empty table gives no rows;
other columns are kept, but for those that `scan` adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LEAST = 0.6
DIRECTORIES = 100_000  # that inherit; broadcast up to so many, joined (and split where skewed, by AQE) beyond
KEYWORDS = r"(?i)licen[cs]e|copyright|spdx|permission|public domain|warrant|redistribut"
LICENCE_FILE = r"(?i)^(?:un)?licen[cs]e|^copying|^notice"

_MARKS = r"^[\s#/*;%!<>-]+|[\s*/#]+$"  # of comments, around a line
_COMMENT = r"^\s*(?:#|//|;|%|--|\*|/\*|<!--|$)"
_QUOTED = (("/*", "*/"), ("<!--", "-->"), ('"""', '"""'))
LINE, PARAGRAPH, LEADING, WHOLE = range(4)  # kinds of units, the larger the later

# fixed values: what licences say of themselves
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_2 = _BSD + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = _BSD_2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_MIT_ALL = _MIT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_END = ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_END = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'


def _gnu(kind: str, version: int) -> tuple[str, str]:
    """The first paragraph of the notice that the GNU licences give for a file's head, and the whole notice."""
    first = f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    return first, first + f" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details. You should have received a copy of the GNU {kind} Public License along with this program."


TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004", _APACHE, _APACHE + _APACHE_END),
    "MIT": ("Released under the MIT License.", _MIT, _MIT_ALL, _MIT_ALL + _MIT_END),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD_2, _BSD_2 + _BSD_END),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", _BSD, _BSD_3, _BSD_3 + _BSD_END),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", *_gnu("General", 2)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("General", 3)),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", *_gnu("Lesser General", 3)),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", *_gnu("Affero General", 3)),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
TEMPLATES = {k: (*v, f"SPDX-License-Identifier: {k}") for k, v in TEMPLATES.items()}


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^a-z0-9.]+|\.(?=\s|$)"), lambda w: w != "")


def _counted(df: DataFrame, *key: str) -> DataFrame:
    """(key..., term, tf) of the column line."""
    return df.select(*key, F.explode(_terms(F.col("line"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def _units(text: Column, lines: Column, licence_file: Column) -> Column:
    """Structs (kind, line) of a file's units that count; a unit that a smaller kind has too is of that kind."""
    says = lambda x: licence_file & (x != "") | x.rlike(KEYWORDS)
    clean = F.transform(lines, lambda x: F.regexp_replace(x, _MARKS, ""))
    own = F.array_distinct(F.filter(clean, says))
    paragraphs = F.array_except(F.filter(F.split(F.array_join(clean, "\n"), "\n\n+"), says), own)
    # a quoted comment ends at its mark, others before the first line that is none
    start, code = F.ltrim(text), F.array_position(F.transform(lines, lambda x: ~x.rlike(_COMMENT)), True)
    leading = F.slice(clean, F.lit(1), F.when(code > 0, code - 1).otherwise(F.size(lines)).cast("int"))
    leading = F.array_join(leading, "\n")
    for opens, closes in _QUOTED:
        body = F.substring_index(F.expr(f"substring(ltrim(text), {len(opens) + 1})"), closes, 1)
        leading = F.when(start.startswith(opens), body).otherwise(leading)
    leading = F.array_except(F.filter(F.array(leading), says), F.concat(own, paragraphs))
    whole = F.array_except(F.filter(F.array(F.array_join(clean, "\n")), lambda x: licence_file & (x != "")), F.concat(own, paragraphs, leading))
    kinds = ((LINE, own), (PARAGRAPH, paragraphs), (LEADING, leading), (WHOLE, whole))
    return F.concat(*(F.arrays_zip(F.array_repeat(F.lit(k), F.size(a)).alias("kind"), a.alias("line")) for k, a in kinds))


def _scores(lines: DataFrame, spark: SparkSession) -> DataFrame:
    """(u, license, score) of distinct units (u, line, number of files n), where the best score is at least LEAST."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("license"), F.lit(i).alias("i"), F.lit(t).alias("line")) for k, ts in TEMPLATES.items() for i, t in enumerate(ts))))
    templates = spark.range(1).select(each.alias("t")).select("t.*")
    ours, theirs = _counted(lines, "u", "n"), _counted(templates, "license", "i")
    df = ours.select("term", "n").unionByName(theirs.select("term", F.lit(1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("df"))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + sum(map(len, TEMPLATES.values()))
    weight = F.col("tf") * F.log(1 + F.lit(total) / F.col("df"))
    a = ours.join(df, "term").select("u", "term", weight.alias("w"))
    b = theirs.join(df, "term").select("license", "i", "term", weight.alias("v"))
    norm_a = a.groupBy("u").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("na"))
    norm_b = b.groupBy("license", "i").agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("nb"))
    dot = a.join(F.broadcast(b), "term").groupBy("u", "license", "i").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    cosine = dot.join(F.broadcast(norm_b), ["license", "i"]).join(norm_a, "u").withColumn("score", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6))
    best = cosine.groupBy("u").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("u", "b.license", (-F.col("b.s")).alias("score")).filter(F.col("score") >= LEAST)


def scan(files: DataFrame) -> DataFrame:
    """files (path, text, ...) without text, with license, score, basis (header, file, inherited or none) and from_dir."""
    spark = files.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    added = ("license", "score", "basis", "from_dir")
    named = {"_dir": F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")), "_file": F.coalesce(F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENCE_FILE), F.lit(False))}
    # all other columns travel in one, so that no name can clash
    kept = [c for c in files.columns if c not in (*added, "text")]
    rows = files.select("path", text.alias("text"), F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")).withColumns({"_h": F.xxhash64("text"), **named})
    speaks = F.col("_file") | F.col("text").rlike(KEYWORDS)
    rows = cut(rows.withColumn("_units", F.when(speaks, _units(F.col("text"), F.split("text", "\n"), F.col("_file")))).drop("text"))
    held = rows.select(F.col("path").alias("_p"), "_h", "_dir", "_file", F.explode("_units").alias("x")).select("_p", "_h", "_dir", "_file", "x.kind", "x.line").withColumn("u", F.xxhash64("line"))
    scored = _scores(held.groupBy("u").agg(F.first("line").alias("line"), F.count("*").alias("n")), spark)
    rows = rows.drop("_units")
    own = held.drop("line").join(scored, "u").groupBy("_p", "_h", "_dir", "_file").agg(F.min(F.struct((-F.col("kind")).alias("k"), (-F.col("score")).alias("s"), "license")).alias("own"))
    own = cut(own.select("_p", F.col("_h").alias("_k"), F.col("_dir").alias("_d"), F.col("_file").alias("_f"), F.col("own.license").alias("_license"), (-F.col("own.s")).alias("_score")))
    licensed = own.filter("_f AND _d IS NOT NULL").groupBy(F.col("_d").alias("up")).agg(F.min(F.struct((-F.col("_score")).alias("s"), "_license")).alias("l")).select("up", F.col("l._license").alias("_given"))
    # a/b/c is under a/b/c, a/b, a and the root ""
    parts = F.split("_dir", "/")
    ups = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), F.array(F.lit(""))))
    above = rows.filter("_dir IS NOT NULL").select("_dir").distinct().select(F.col("_dir").alias("_under"), F.explode(ups).alias("up"))
    nearest = above.join(licensed, "up").groupBy("_under").agg(F.max(F.struct(F.length("up").alias("n"), "up", "_given")).alias("g")).select("_under", F.col("g.up").alias("_up"), F.col("g._given").alias("_given"))
    # a row for each directory under a licensed one; joined by directory, hot ones would fill a task
    nearest = cut(nearest)
    if nearest.count() <= DIRECTORIES:
        nearest = F.broadcast(nearest)
    out = rows.join(own, rows["path"].eqNullSafe(own["_p"]) & (rows["_h"] == own["_k"]), "left").join(nearest, F.col("_dir") == F.col("_under"), "left")
    basis = F.when(F.col("_license").isNotNull(), F.when(F.col("_file"), "file").otherwise("header")).when(F.col("_given").isNotNull(), "inherited").otherwise("none")
    inherited = F.col("_license").isNull()
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), F.coalesce("_license", "_given").alias("license"), F.col("_score").alias("score"), basis.alias("basis"), F.when(inherited, F.col("_up")).alias("from_dir"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files source/lang/doc_id.txt; texts that are half licence lines at least are their directory's LICENSE files."""
    docs = table(spark, sf_dir, "documents")
    said = F.aggregate(F.filter(F.split("text", "\n"), lambda x: x.rlike(KEYWORDS)), F.lit(0), lambda s, x: s + F.length(x))
    name = F.when(2 * said >= F.greatest(F.length("text"), F.lit(1)), F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    return scan(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", name).alias("path")))


QUERIES = {"op7_licenses": op7_licenses}
