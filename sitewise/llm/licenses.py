"""Licence scan: sparse TF-IDF cosine of notices to templates, then
nearest-ancestor inheritance by joins on directories.  DataFrame functions
only.

A unit is one line of a text (a notice in a header or anywhere else), its
leading block of lines (a header, or the title of a licence), and for licence
files also the whole text.  Vectors are over the template words; other words
of a unit count in its length with the weight of a word no template has.

By Cauchy-Schwarz a unit's cosine to any template is at most the share of the
unit's own length that lies on template words.  That share is bounded within
the unit's row (a bitmap of the template words, sorted words, run lengths;
m other words weigh at least as m different ones).  Where it reaches the
threshold, the unit's exact length and its template words are written, equal
units are scored once, and the join is of those words with the templates'
weights, whose number is fixed by the parameter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decontam import words
from .scratch import broadcast_if_small, drop, materialise
from .search import in_bitmap, word_bitmap

# fixed values: short forms of public licence notices, then standard headers, short licences and SPDX forms
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    # standard headers, by paragraph and as a block
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    *[(f"{short}-{v}", f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {v[0]} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>.")
      for short, v, name in (("GPL", "2.0", "GNU General Public License"), ("GPL", "3.0", "GNU General Public License"),
                             ("LGPL", "3.0", "GNU Lesser General Public License"), ("AGPL", "3.0", "GNU Affero General Public License"))],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    # titles of long licences, as their texts begin
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    # whole short licences
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    # SPDX forms
    *[(name, f"SPDX-License-Identifier: {name}") for name in (
        "Apache-2.0", "MIT", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0", "BSD-3-Clause", "MPL-2.0", "CC-BY-4.0",
        "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0", "ISC")],
]
BLOCK = 1 << 30  # line number of the leading block, after all lines
WHITE = r"[ \t\n\x0B\f\r]"
SLACK = 1e-6  # of squared lengths, for rounding
FILE_NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"


def vectors(spark, templates=None) -> tuple[DataFrame, dict[str, float], float]:
    """Template weights (template, license, word, w, idf) of unit length, the
    idf of each template word, and that of other words."""
    rows = [(i, name, text) for i, (name, text) in enumerate(templates or TEMPLATES)]
    t = spark.createDataFrame(rows, "template int, license string, text string")
    t = t.select("template", "license", F.explode(words(F.col("text"))).alias("word")).groupBy("template", "license", "word").agg(F.count("*").alias("tf"))
    n = len(rows)
    df = t.groupBy("word").agg(F.count("*").alias("df"))
    t = t.join(df, "word").withColumn("idf", F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    norm = t.groupBy("template").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2.0)))).alias("norm"))
    t = t.join(norm, "template").select("template", "license", "word", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w"), "idf")
    t = materialise(t, "lc-templates")
    idf = {r.word: r.idf for r in t.select("word", "idf").distinct().collect()}
    return t, idf, math.log(1.0 + n) + 1.0


def _starts(sorted_words: str) -> Column:
    """Places where another word begins in a sorted array."""
    n = F.size(sorted_words)
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: (i == 0) | (F.get(sorted_words, i) != F.get(sorted_words, i - 1)))


def _run(starts: str, sorted_words: str, s: Column, j: Column) -> Column:
    return F.coalesce(F.get(starts, j + 1), F.size(sorted_words)) - s


def within_reach(units: DataFrame, keep: list[str], bitmap: Column, idf: dict[str, float], other_idf: float,
                 threshold: float) -> DataFrame:
    """Units (keep, w: array of words) whose length lies on template words as
    far as the threshold needs -> keep, known (word, tf) and norm2, the
    squared length.  Each step is a column that the next uses more than once,
    so that none is evaluated per element."""
    weight = F.create_map(*[F.lit(x) for word, v in sorted(idf.items()) for x in (word, v)])
    u = units.select(*keep, "w", F.sort_array(F.filter("w", lambda x: in_bitmap(bitmap, F.xxhash64(x)))).alias("_s"))
    # a filter is not moved below a column that is not deterministic, where it
    # would repeat the columns' expressions inside each other
    u = u.select(*keep, "w", "_s", _starts("_s").alias("_i"), F.monotonically_increasing_id().alias("_no"))
    # a word that only shares its bit weighs nothing here: the bound grows
    lengths = F.transform("_i", lambda s, j: _run("_i", "_s", s, j) * F.coalesce(weight[F.get("_s", s)], F.lit(0.0)))
    on = F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x * x)
    off = (F.size("w") - F.size("_s")) * other_idf * other_idf
    t2 = threshold * threshold
    u = u.where((F.col("_no") >= 0) & (on > 0) & (on * (1 - t2) + SLACK >= t2 * off))
    runs = F.transform("_i", lambda s, j: F.struct(F.get("_s", s).alias("word"), _run("_i", "_s", s, j).alias("tf"), weight[F.get("_s", s)].alias("idf")))
    u = u.select(*keep, F.filter(runs, lambda r: r["idf"].isNotNull()).alias("known"), F.sort_array("w").alias("_a"))
    u = u.select(*keep, "known", "_a", _starts("_a").alias("_b"))
    squares = F.aggregate(F.transform("_b", lambda s, j: _run("_b", "_a", s, j).cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    more = F.aggregate("known", F.lit(0.0), lambda a, r: a + r["tf"] * r["tf"] * (r["idf"] * r["idf"] - other_idf * other_idf))
    return u.select(*keep, "known", (squares * other_idf * other_idf + more).alias("norm2"))


def best_matches(units: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """units (key, known, norm2) -> key, license, score: the most similar
    template of each unit, ties to the first one."""
    rows = units.select(key, "norm2", F.explode("known").alias("k")).select(key, "norm2", "k.word", (F.col("k.tf") * F.col("k.idf")).alias("v"))
    dot = (rows.join(F.broadcast(weights.select("template", "license", "word", "w")), "word")
           .groupBy(key, "template", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"), F.max("norm2").alias("norm2")))
    score = dot.withColumn("score", F.round(F.col("dot") / F.sqrt("norm2"), 9))
    best = score.groupBy(key).agg(F.max_by(F.struct("license", "score"), F.struct("score", -F.col("template"))).alias("m"))
    return best.select(key, "m.license", "m.score")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, '' for the root."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.7,
         license_file: Column | None = None, templates=None) -> DataFrame:
    """Licence of every document: doc_id, path, license, score (of the notice
    or the licence file), origin ('own', 'inherited', 'none'), from_dir; one
    row per input row.

    A document's own licence is its most similar line or leading block of
    lines of at least ``threshold`` (ties: first template, first line).  A licence file (by default, by its
    name) stands for its directory with its best line or whole text; of
    several the most similar, then the licence's name, counts.  A document
    without a licence of its own takes that of the nearest directory above
    it.  Defined cases: a null or empty text has no notice; a null path is in
    no directory and inherits nothing; rows equal in id, path and text get
    equal results; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    weights, idf, other_idf = vectors(spark, templates)
    bitmap = word_bitmap(weights.select(F.col("word").alias("term")))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    docs = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"),
                       F.coalesce(license_file if license_file is not None else name.rlike(FILE_NAMES), F.lit(False)).alias("is_file"))
    docs = docs.withColumns({"th": F.xxhash64("text"), "dir": F.regexp_replace(F.col("path"), r"/?[^/]*$", "")})
    # the leading block, up to the first empty line, if it is several lines
    head = F.split(F.regexp_replace("text", f"^{WHITE}+", ""), rf"\n{WHITE}*\n", 2)[0]
    unit = [F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("raw"))),
            F.when(head.contains("\n"), F.array(F.struct(F.lit(BLOCK).alias("pos"), head.alias("raw")))),
            F.when(F.col("is_file"), F.array(F.struct(F.lit(-1).alias("pos"), F.col("text").alias("raw"))))]
    none = F.array().cast("array<struct<pos:int,raw:string>>")
    units = docs.where("text is not null").select("doc_id", "th", F.explode(F.concat(*[F.coalesce(x, none) for x in unit])).alias("u"))
    units = units.select("doc_id", "th", "u.pos", words(F.col("u.raw")).alias("w"))
    units = units.select(F.to_json(F.struct("doc_id")).alias("id"), "th", "pos", F.sha2(F.array_join("w", " "), 256).alias("unit"), "w")
    units = materialise(within_reach(units, ["id", "th", "pos", "unit"], bitmap, idf, other_idf, threshold), "lc-units")
    # equal units are scored once
    scored = best_matches(units.groupBy("unit").agg(F.first("known").alias("known"), F.first("norm2").alias("norm2")), "unit", weights)
    scored = materialise(scored.where(F.col("score") >= threshold), "lc-scored")
    hits = units.select("id", "th", "pos", "unit").distinct().join(broadcast_if_small(scored), "unit")
    scored = materialise(hits.select("id", "th", "pos", "license", "score"), "lc-hits")
    pick = F.max_by(F.struct("license", "score"), F.struct("score", -F.col("pos"))).alias("m")
    own = scored.where("pos >= 0").groupBy("id", "th").agg(pick).select("id", "th", F.col("m.license").alias("own"), F.col("m.score").alias("own_score"))
    file = scored.groupBy("id", "th").agg(pick).select("id", "th", F.col("m.license").alias("file"), F.col("m.score").alias("file_score"))
    found = materialise(file.join(own, ["id", "th"], "left"), "lc-found")
    marked = docs.drop("text").withColumn("id", F.to_json(F.struct("doc_id"))).join(broadcast_if_small(found), ["id", "th"], "left")

    # one licence per directory, then the nearest for every directory in use
    of_dir = marked.where("is_file and file is not null and dir is not null").groupBy("dir").agg(
        F.min(F.struct((-F.col("file_score")).alias("s"), F.col("file").alias("license"))).alias("m"))
    of_dir = materialise(of_dir.select(F.col("dir").alias("up"), "m.license", (-F.col("m.s")).alias("score")), "lc-dirs")
    dirs = docs.select("dir").distinct().where("dir is not null")
    above = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "up"))
    above = (above.join(broadcast_if_small(of_dir), "up").groupBy("dir")
             .agg(F.max_by(F.struct("license", "score", "up"), "depth").alias("m")))
    above = materialise(above.select(F.col("dir").alias("d"), F.col("m.license").alias("dir_license"),
                                     F.col("m.score").alias("dir_score"), F.col("m.up").alias("from_dir")), "lc-above")
    out = marked.join(broadcast_if_small(above), F.col("dir") == F.col("d"), "left")
    has, can = F.col("own").isNotNull(), F.col("dir_license").isNotNull()
    drop(units, scored, of_dir)
    return out.select("doc_id", "path", F.coalesce("own", "dir_license").alias("license"),
                      F.when(has, F.col("own_score")).otherwise(F.col("dir_score")).alias("score"),
                      F.when(has, F.lit("own")).when(can, F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
                      F.when(~has & can, F.col("from_dir")).alias("from_dir"))
