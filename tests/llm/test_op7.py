import re
import textwrap

from pyspark.sql import functions as F

from stranda.llm import op7_licenses as op


def test_query_finds_each_licence_line(spark):
    said = {"Apache": "Apache-2.0", "MIT": "MIT", "GNU General": "GPL-3.0", "CC BY-NC": "CC-BY-NC-4.0"}
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op.op7_licenses(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        lines = [x for x in docs[r.doc_id].split("\n") if re.search(r"(?i)licen[cs]e", x)]
        want = {v for x in lines for k, v in said.items() if k in x}
        assert (r.basis in ("header", "file")) == bool(want) and (not want or r.license in want), (r, want)


def test_inheritance_nulls_repeats_and_empty(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [("a/LICENSE", mit), ("a/b/c/x.py", "code"), ("a/b/COPYING", apache), ("a/y.py", None), ("z.py", ""), (None, "code"), ("a/b/c/x.py", "code"), ("a/b/own.py", f"code\n  {mit}\nmore"), ("ab/q.py", "code"), (None, mit)]
    df = spark.createDataFrame(files, "path string, text string").withColumn("score", F.lit("clash")).withColumn("line", F.lit("clash"))
    got = sorted((str(r.path), str(r.license), r.basis, str(r.from_dir)) for r in op.scan(df).collect())
    assert got == sorted([
        ("a/LICENSE", "MIT", "file", "None"), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b"), ("a/b/c/x.py", "Apache-2.0", "inherited", "a/b"), ("a/b/COPYING", "Apache-2.0", "file", "None"),
        ("a/y.py", "MIT", "inherited", "a"), ("z.py", "None", "none", "None"), ("None", "None", "none", "None"), ("a/b/own.py", "MIT", "header", "None"), ("ab/q.py", "None", "none", "None"), ("None", "MIT", "header", "None"),
    ])
    assert op.scan(df.limit(0)).count() == 0


def found(spark, files):
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    return {r.path: (r.license, r.basis) for r in op.scan(df).collect()}


def commented(text, width=60):
    return "\n".join(f"# {x}" for x in textwrap.wrap(text, width)) + "\n\nimport os\n"


def test_wrapped_notices_and_licence_files(spark):
    bsd = op._BSD.replace("binary forms, ", "binary forms,\n") + ":\n"
    two = "\n\n1. Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright\nnotice, this list of conditions and the following disclaimer in the\ndocumentation and/or other materials provided with the distribution.\n"
    three = "\n3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version {}\n\n Copyright (C) Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n"
    files = {
        "g2/COPYING": title.format("2, June 1991"),
        "g3/COPYING": title.format("3, 29 June 2007"),
        "b2/LICENSE": "Copyright (c) 2020, A. Person\n\n" + bsd + two + op._BSD_END,
        "b3/LICENSE": "Copyright (c) 2020, A. Person\n\n" + bsd + two + three + op._BSD_END,
        "bsd/x.py": commented(op._BSD, 400),
        "h2/x.py": commented(op._gnu("General", 2)[1]),
        "h3/x.py": commented(op._gnu("General", 3)[1]),
        "ha/x.c": "/*\n" + "\n".join(textwrap.wrap(op._APACHE + op._APACHE_END, 50)) + "\n*/\nint main;\n",
        "s1/x.py": "# SPDX-License-Identifier: GPL-2.0-or-later\nimport os\n",
        "s2/x.py": "// SPDX-License-Identifier: BSD-3-Clause\nx\n",
        "s3/x.py": "# SPDX-License-Identifier: MIT\nx\n",
        "no/x.py": "# Copyright 2020 A. Person\nimport os\n",
    }
    got = found(spark, files)
    want = {"g2": "GPL-2.0", "g3": "GPL-3.0", "b2": "BSD-2-Clause", "b3": "BSD-3-Clause", "bsd": "BSD-3-Clause", "h2": "GPL-2.0", "h3": "GPL-3.0", "ha": "Apache-2.0", "s1": "GPL-2.0", "s2": "BSD-3-Clause", "s3": "MIT", "no": None}
    assert {k.split("/")[0]: v[0] for k, v in got.items()} == want
    assert all(got[k][1] == ("none" if k.startswith("no") else "file" if "." not in k else "header") for k in files)
