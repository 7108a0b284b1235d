"""The packaged table of licence texts and notices."""

import random
import re
import textwrap

from pyspark.sql import functions as F
from test_llm_rows import frame

from webloom.llm import licenses


def scanned(spark, texts):
    rows = [(i, text, None, None, 0) for i, text in enumerate(texts)]
    return [(r.license_id, r.n_notices, r.notice_id) for r in sorted(licenses.scan(frame(spark, rows)).collect(), key=lambda r: r.doc_id)]


def test_notices_and_whole_texts(spark):
    notices = {
        "Released under the MIT License.": "MIT-notice",
        "This project is licensed under the Mozilla Public License 2.0": "MPL-2.0-notice",
        "# SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0-only-notice",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0-notice",
    }
    assert scanned(spark, [f"Text.\n{line}\nText" for line in notices]) == [(None, 1, i) for i in notices.values()]
    wanted = {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense"}
    known = dict(licenses.KNOWN)
    assert [r[0] for r in scanned(spark, ["Copyright (c) 2021, A. Person\n\n" + known[i] for i in sorted(wanted)])] == sorted(wanted)


def test_forms_by_line_equal_whole_forms(spark):
    """Lines are brought to their form one by one; joined, they are the form of the whole text."""
    draw = random.Random(4)
    bits = ["Copyright (c) 2020 A", "(c)", "copyright", "All rights reserved", "licence", "sub-", "licence", "non", "commercial", "whilst", "organisation", "Copyright", "owner"]
    bits += ["behaviour", "judgement", "catalogue", "the", "and", "©", "É", "日本", "#", "//", "", " ", "\t", "\r", "2021", "x,y", "holder", "(C) you may", "authorised", "acknowledgement", "artefact"]
    texts = ["".join(draw.choice(bits) + draw.choice([" ", "\n", "\n\n", "-", "\r\n"]) for _ in range(draw.randint(0, 40))) for _ in range(800)]
    docs = frame(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)])
    whole = {r.doc_id: r.c for r in docs.select("doc_id", F.char_length(licenses.canonical(F.col("text"))).alias("c")).collect()}
    assert {r.doc_id: r.canonical_chars for r in licenses.scan(docs).collect()} == whole
    forms = {r.doc_id: r.c for r in docs.select("doc_id", licenses.canonical(F.col("text")).alias("c")).collect()}
    known = spark.createDataFrame([(f"L{i}", t) for i, t in enumerate(texts)], "license_id STRING, license_text STRING")
    found = {r.doc_id: r.license_id for r in licenses.scan(docs, known).collect()}
    smallest = {}
    for i in range(len(texts)):
        smallest[forms[i]] = min(f"L{i}", smallest.get(forms[i], f"L{i}"))
    assert found == {i: smallest[f] if f else None for i, f in forms.items()}


def test_titles_and_other_line_widths(spark):
    """Usual files have a title; a text wrapped at any width keeps its words, whatever its lines begin with."""
    known = dict(licenses.KNOWN)
    notice = "Copyright (c) 2020 A. Person\nAll rights reserved."
    files = [("MIT", f"{t}\n\n{notice}\n\n{known['MIT']}") for t in ("MIT License", "The MIT License (MIT)", "# MIT License")]
    files += [("ISC", f"ISC License\n\n{notice}\n\n{known['ISC']}"), ("BSD-2-Clause", f"BSD 2-Clause License\n\n{notice}\n\n{known['BSD-2-Clause']}")]
    for i in ("MIT", "ISC", "BSD-3-Clause", "Zlib", "Unlicense"):
        files += [(i, f"{notice}\n\n{wrapped(known[i], width)}") for width in (1, *range(20, 110, 3))]
    for i in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "CC0-1.0", "CC-BY-SA-4.0", "MPL-2.0"):
        text = known[i].split("How to Apply These Terms")[0]  # what follows has statements within sentences
        files += [(i, wrapped(text, width)) for width in range(50, 110, 6)]
    got = [r[0] for r in scanned(spark, [text for _, text in files])]
    assert [(i, g, text[:60]) for (i, text), g in zip(files, got) if i != g] == []


def wrapped(text, width):
    """Paragraphs wrapped anew; lines that are statements of copyright stay lines of their own."""
    out, words = [], []
    for line in [*text.split("\n"), ""]:
        statement = re.match(r"\W*(copyright \(c\)|copyright ©|copyright \[|copyright <|all rights reserved)", line.lower())
        if statement or not line.strip():
            out += [*textwrap.wrap(" ".join(words), width, break_long_words=False, break_on_hyphens=False), line]
            words = []
        else:
            words += line.split()
    return "\n".join(out)


def test_statements_of_copyright_go(spark):
    body = "Permission is granted."
    gone = ["Copyright 2020 A", "copyright: 1999, 2001 by B", "// Copyright Jane Doe", "© Jane Doe", "(c) Jane Doe", "(C) 2001 X", "Copyright (c) The X Authors", "Copyright The X Authors",
            "Copyright [yyyy] [name of copyright owner]", "Copyright, (c) 2020 X", "All rights reserved."]
    stay = ["COPYRIGHT HOLDERS BE LIABLE FOR", "copyright notice and this", "copyright", "copyright, patent and", "(c) You must retain", "copyright the software"]
    docs = spark.createDataFrame([(i, f"{line}\n{body}") for i, line in enumerate(gone + stay)], "i INT, text STRING")
    rows = sorted(docs.select("i", licenses.canonical(F.col("text")).alias("t"), "text").collect())
    assert [r.t for r in rows[: len(gone)]] == ["permission is granted"] * len(gone)
    assert all(len(r.t.split()) == len(re.findall("[A-Za-z]+", r.text)) for r in rows[len(gone) :])
