"""op1 on whole licence texts as files have them."""

from pathlib import Path

import pytest

from estimara.llm import licenses

SHIPPED = Path("/usr/share/common-licenses")


def names(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.license for r in licenses.license_scan(docs, **options).orderBy("doc_id").collect()]


def test_titles_and_other_forms(spark):
    mit, bsd = licenses.LICENSES["MIT"], licenses.LICENSES["BSD-3-Clause"]
    bullets = bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ")
    texts = [f"MIT License\n\nCopyright (c) 2020 A\n\n{mit}", f"The MIT License (MIT)\n{mit}", f"BSD 3-Clause License\n{bsd}", bullets, licenses.UNLICENSE.replace("https", "http") + "/", f"A title of its own\n{mit}"]
    assert names(spark, texts) == ["MIT", "MIT", "BSD-3-Clause", "BSD-3-Clause", "Unlicense", None]


def test_copyright_lines(spark):
    mit = licenses.LICENSES["MIT"]
    texts = [f"Copyright The Foo Authors\n{mit}", f"MIT License\n\nCopyright the Bar contributors.\nAll rights reserved.\n\n{mit}", f"All rights reserved. Anything may stand here, nothing is granted.\n{mit}", f"Copyright law applies\n{mit}"]
    assert names(spark, texts) == ["MIT", "MIT", None, None]
    wrapped = mit.replace("COPYRIGHT HOLDERS BE", "\nCOPYRIGHT HOLDERS BE")
    assert names(spark, [wrapped]) == ["MIT"]


def test_terms_on_a_copyright_line_stay(spark):
    """A line that begins like a notice and goes on with terms isn't one; a notice sentence before the licence is."""
    mit = licenses.LICENSES["MIT"]
    no = ["Copyright (c) 2024 Foo. Commercial use is forbidden and no copies may be made.", "c 2024 nothing may be done with this", "Copyright c anything at all, all use forbidden", "Copyright (c) 2020 Foo. All rights reserved. Nothing is granted.", "(c) 2020 Foo, you may not copy"]
    yes = ["Copyright (c) 2024 Foo Bar, Inc. All rights reserved.", "© 1999-2003, 2005 J. R. Smith <j@smith.example>", "Copyright 2020 The Foo Authors", "(C) Copyright 2001 by A and B"]
    assert names(spark, [f"{line}\n{mit}" for line in no + yes]) == [None] * len(no) + ["MIT"] * len(yes)
    assert names(spark, [f"Copyright (c) 2020 Foo Inc. All rights reserved. {mit}", f"MIT License Copyright (c) 2020 Foo. {mit}"]) == ["MIT", None]


def test_equal_spellings_are_whole_words(spark):
    digest = lambda t: licenses.license_scan(spark.createDataFrame([(1, t)], "doc_id long, text string")).first().digest
    assert digest("Licences, licenced and sub-licenses") == digest("licenses licensed and sublicenses")
    assert digest("a canon commercial matter") != digest("a canoncommercial matter") and digest("non-commercial") == digest("noncommercial")


def test_sql_knows_all_texts(spark):
    """DuckDB's rows for all known texts with notices around them, and for lines that look like notices."""
    import duckdb
    import pandas as pd

    texts = [f"Copyright (c) 2020 A. All rights reserved.\n{t}" for _, t in licenses.known_texts()] + [None, "", "Copyright 2020 X. Do as you may. Really.", "copyright c y. all rights reserved. Z. w"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(f"select doc_id, digest, license, n_notices, notices from ({licenses.license_sql()}) order by doc_id").fetchall()
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want and [r.license for r in got][:-4] == [n for n, _ in licenses.known_texts()]


@pytest.mark.skipif(not SHIPPED.exists(), reason="no licence texts here")
def test_long_texts(spark):
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = [(SHIPPED / f).read_text() for f in files]
    filled = texts[0].replace("[yyyy] [name of copyright owner]", "2021 Some Body")
    assert names(spark, [*texts, filled, texts[0].split("END OF TERMS")[0], texts[0][100:]]) == [*files.values(), "Apache-2.0", "Apache-2.0", None]


def test_a_given_table_of_digests(spark):
    docs = spark.createDataFrame([(1, "Own terms: do as you like.")], "doc_id long, text string")
    digest = licenses.license_scan(docs).first().digest
    known = spark.createDataFrame([(digest, "Own"), (digest, "Own"), (None, "X")], "digest string, license string")
    assert names(spark, ["OWN terms -- do as you like", licenses.LICENSES["MIT"]], known=known) == ["Own", None]
