import math
import re
from collections import Counter

from pyspark.sql import functions as F

from corpus_data import docs, empty, odd  # noqa: F401  (fixtures)
from sitewise.llm.licenses import TEMPLATES, scan
from test_decontam import words


def _template_vectors():
    tf = [Counter(words(t)) for _, t in TEMPLATES]
    df = Counter(x for c in tf for x in c)
    idf = {x: math.log((1 + len(TEMPLATES)) / (1 + n)) + 1 for x, n in df.items()}
    v = [{x: n * idf[x] for x, n in c.items()} for c in tf]
    return idf, [(c, math.sqrt(sum(a * a for a in c.values()))) for c in v]


IDF, VECTORS = _template_vectors()


def cosine_to_all(w):
    u = {x: n * IDF.get(x, math.log(1 + len(TEMPLATES)) + 1) for x, n in Counter(w).items()}
    nu = math.sqrt(sum(v * v for v in u.values()))
    best = (0.0, None)
    for (name, _), (v, nv) in zip(TEMPLATES, VECTORS):
        s = round(sum(u[x] * v[x] for x in u if x in v) / nu / nv, 9)
        best = max(best, (s, name), key=lambda b: b[0])
    return best


ROWS = [
    (1, "a/LICENSE", "MIT License\n\n" + TEMPLATES[3][1]), (2, "a/src/x.py", "plain text"), (3, "a/src/deep/er/y.py", "more text"),
    (4, "a/src/COPYING.txt", TEMPLATES[0][1]), (5, "a/src/z.py", "# " + TEMPLATES[6][1] + "\ncode"), (6, "b/q.py", "nothing"),
    (7, "NOTICE.md", "a licence of no template, version of public work"), (8, None, "text"), (9, "b/r.py", None),
    (10, "b/s.py", "x\ny\n   Released under the MIT license!!\nz"), (10, "b/s.py", "x\ny\n   Released under the MIT license!!\nz"),
    (None, "a/src/n.py", "text"), (11, "a/LICENSE-OTHER", TEMPLATES[4][1]), (12, "c/LICENSE", "use of the software, free of any " * 40),
]


def test_scan(spark):
    df = spark.createDataFrame([(*r, "m", "o", 1.0, "up") for r in ROWS],
                               "doc_id long, path string, text string, license string, origin string, score double, dir string")
    got = Counter((r.doc_id, r.license, r.origin, r.from_dir) for r in scan(df, F.col("path")).collect())
    assert got == Counter([
        (1, "MIT", "own", None), (2, "Apache-2.0", "inherited", "a/src"), (3, "Apache-2.0", "inherited", "a/src"),
        (4, "Apache-2.0", "own", None), (5, "LGPL-3.0", "own", None), (6, None, "none", None), (7, None, "none", None),
        (8, None, "none", None), (9, None, "none", None), (10, "MIT", "own", None), (10, "MIT", "own", None),
        (None, "Apache-2.0", "inherited", "a/src"), (11, "GPL-2.0", "own", None), (12, None, "none", None)])


def own_license(text):
    """The best of all lines and the leading block, the first of equal ones."""
    units = (text or "").split("\n")
    head = re.split(r"\n[ \t\n\x0b\f\r]*\n", (text or "").lstrip(" \t\n\x0b\f\r"), maxsplit=1)[0]
    if "\n" in head:
        units = units + [head]
    best = (0.0, None)
    for unit in units:
        if w := words(unit):
            best = max(best, cosine_to_all(w), key=lambda b: b[0])
    return best[1] if best[0] >= 0.7 else None


def test_own_notices_against_plain_cosine(odd, docs):
    d = docs.unionByName(odd.select("doc_id", "text"), allowMissingColumns=True)
    got = {(r.doc_id, r.license) for r in scan(d, F.lit("x/y")).where("origin = 'own'").collect()}
    want = {(r.doc_id, name) for r in d.select("doc_id", "text").collect() if (name := own_license(r.text))}
    assert got == want and len(got) > 0


HEADERS = [
    "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General\nPublic License as published by the Free Software\nFoundation, either version 3 of the License, or (at\nyour option) any later version.\n\nint main;",
    "plain words of a text\nthat has no licence\n\nat all", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C)",
    "MIT LICENSE\n\nfree text", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions", "\n \n  Released under the MIT License.  \nx",
    "the the the the license license license of of of\n" + "the work is under version of this file " * 30, None, ""]


def test_sql_and_scan_agree_on_headers(spark, tmp_path):
    """Licences that only the leading block shows, in Spark and in the SQL."""
    import duckdb
    from sitewise.llm.catalog import ORACLE, QUERIES
    df = spark.createDataFrame([(i, t, "en", f"s{i}", 0) for i, t in enumerate(HEADERS)], "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(ORACLE["op2_licenses"])
    names = [c[0] for c in want.description]
    want = sorted(map(str, want.fetchall()))
    got = QUERIES["op2_licenses"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    own = {r.doc_id: r.license for r in got if r.origin == "own"}
    assert own == {i: name for i, t in enumerate(HEADERS) if (name := own_license(t))}
    assert own[0] == own[2] == "GPL-3.0" and own[4] == "MPL-2.0" and own[5] == "MIT" and 1 not in own and 6 not in own


def test_empty(empty):
    assert scan(empty, F.col("kept")).count() == 0


def test_lines_of_common_words_are_scored(spark):
    """Lines over the threshold by common words and the name of a licence."""
    lines = ["under the MIT", "The MIT", "Under MIT", "mit dem Rad", "that is under the"]
    df = spark.createDataFrame([(i, f"{t}\nbody") for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in scan(df, F.lit("x/y")).collect()}
    assert got == {i: name if score >= 0.7 else None for i, (score, name) in enumerate(cosine_to_all(words(t)) for t in lines)}
    # with the short notices alone as templates the first three are over it
    got = {r.doc_id: r.license for r in scan(df, F.lit("x/y"), templates=TEMPLATES[:14]).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: None, 4: None}


def test_standard_notices(spark):
    """Notices as files have them, none of them in the test documents."""
    apache = ("# Copyright 2020 Some Body\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n"
              "# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n"
              "#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n"
              "# distributed under the License is distributed on an \"AS IS\" BASIS,\n\nimport os\n")
    gpl = ("/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n"
           " * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n *\n"
           " * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n"
           " * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n * GNU General Public License for more details. */\n\nint x;\n")
    notices = [("Apache-2.0", apache), ("GPL-3.0", gpl), ("MIT", "// SPDX-License-Identifier: MIT\nint x;"),
               ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport os"), (None, "plain words of a text\nthat has no licence\n")]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(notices)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in scan(df, F.lit("x/y")).collect()}
    assert got == {i: name for i, (name, _) in enumerate(notices)}
