from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import licences as x

SCHEMA = "doc_id long, text string, licence string, line int, digest string"


def found(spark, texts, **options):
    df = spark.createDataFrame([(k, t, "", 0, "") for k, t in texts], SCHEMA)
    return sorted(((r["doc_id"] or 0, r["licence"], r["unit"], r["line"]) for r in x.scan_licences(df, **options).collect()))


MIT = dict(x.TEXTS)["MIT"]


def test_notices_in_other_text(spark):
    texts = [
        (1, "Some prose.\nReleased under the MIT License."),
        (2, "LICENSED UNDER CC BY-NC 4.0"),
        (3, "a\nb\n  * Licensed under the Apache Licence, version 2.0 *\nc"),
        (4, "This work is licensed under the GNU General Public License, v3."),
        (5, "It was released under the MIT License in May."),
        (6, "SPDX-License-Identifier: GPL-3.0"),
    ]
    assert found(spark, texts) == [(1, "MIT", "line", 1), (2, "CC-BY-NC-4.0", "line", 0), (2, "CC-BY-NC-4.0", "text", -1), (3, "Apache-2.0", "line", 2), (4, "GPL-3.0", "line", 0), (4, "GPL-3.0", "text", -1), (6, "GPL-3.0", "line", 0), (6, "GPL-3.0", "text", -1)]


def test_whole_licences(spark):
    texts = [
        (1, f"MIT License\n\nCopyright (c) 2019 A. Person\n\n{MIT}"),
        (2, "\n".join(f" * {line}" for line in f"Copyright (c) 2020 Someone\n(c) 2021 Other\n{MIT}".replace(". ", ".\n").upper().split("\n"))),
        (3, MIT + " And more."),
        (4, dict(x.TEXTS)["BSD-3-Clause"].replace("copyright holder nor", "Copyright Owner nor") + "\n" * 50_000),
        (5, dict(x.TEXTS)["BSD-2-Clause"].replace('"AS IS"', "``AS IS''")),
    ]
    assert [f for f in found(spark, texts) if f[2] == "text"] == [(1, "MIT", "text", -1), (2, "MIT", "text", -1), (4, "BSD-3-Clause", "text", -1), (5, "BSD-2-Clause", "text", -1)]


def test_odd_rows(spark):
    texts = [(None, "GPLv3"), (1, None), (2, ""), (3, " \n\n"), (4, "License: MIT"), (4, "License: MIT"), (5, "Our own terms apply")]
    assert found(spark, texts) == [(4, "MIT", "line", 0)] * 2 + [(4, "MIT", "text", -1)] * 2
    assert found(spark, texts, extra=[("own", "our own TERMS apply!"), ("own", "GPLv3")])[:2] == [(0, "own", "line", 0), (0, "own", "text", -1)]
    assert found(spark, []) == []


def test_literals_rule_out_nothing_known():
    forms = ["released under mit", "license mit", "mit", "permission is hereby granted"]
    assert x.literals(forms) is None
    kept = x.literals([f for f in forms if f != "mit"])
    assert all(any(w in f for w in kept) for f in forms if f != "mit") and "licen" in kept


def test_sql_gives_the_same(spark):
    texts = [(1, "x\nReleased under the MIT License.\ny"), (2, f"Copyright (c) 2000 X\n{MIT}"), (3, "Licensed under the GNU GPL v3."), (4, None), (5, "é\nLicensed under Apache-2.0")]
    documents = pd.DataFrame(texts, columns=["doc_id", "text"])  # noqa: F841
    rows = duckdb.connect().execute(x.oracle_sql().replace("FROM documents", "FROM df").replace("df WHERE", "documents WHERE")).fetchall()
    assert sorted(r[:4] for r in rows) == found(spark, texts)


PUBLISHED = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not PUBLISHED.is_dir(), reason="no published texts on this machine")
def test_long_licences_by_digest(spark):
    """Whole published texts, with and without copyright lines, in other line widths and as comments."""
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "GFDL-1.3": "GFDL-1.3", "BSD": "BSD-3-Clause"}
    texts, want = [], []
    for n, (file, licence) in enumerate(files.items()):
        text = (PUBLISHED / file).read_text(encoding="utf8")
        forms = [text, f"Copyright (c) 2021 A. Person\n\n{text}", text.replace("license", "licence").upper(), "".join(f" * {line}\n" for line in text.split("\n"))]
        if "END OF TERMS" in text:
            forms.append(text[: text.index("END OF TERMS")])
        if file == "Apache-2.0":
            forms.append(text.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Someone Else"))
        texts += [(100 * n + k, t) for k, t in enumerate(forms)] + [(100 * n + 50, text[: len(text) // 2]), (100 * n + 51, text + "\nAnd further terms.")]
        want += [(100 * n + k, licence, "text", -1) for k in range(len(forms))]
    assert [f for f in found(spark, texts) if f[2] == "text"] == want


def test_normalisation_by_hand(spark):
    """Canonical forms written out by hand, not derived from the steps."""
    pairs = {
        "The Licence,  VERSION 2.0\n(see https://x.org/a)": "the license version 2 see",
        "Copyright (c) 2020 Me\nUse & re-licensing": "use and relicensing",
        "# Copyright Owner: v3 of it": "copyright holder version 3 of it",
        "": "",
        " -- \n": "",
        "GNU GPL v2.0!": "gnu gpl version 2",
    }
    con = duckdb.connect()
    form = "lower(t)"
    for pattern, new in x.STEPS:
        form = f"regexp_replace({form}, '{pattern}', '{new}', 'g')"
    for text, want in pairs.items():
        assert con.execute(f"SELECT trim({form}) FROM (SELECT ? AS t)", [text]).fetchone()[0] == want
    rows = spark.createDataFrame(list(pairs.items()), "t string, want string").select("want", x.canonical(F.col("t")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
