import hashlib
import json
import os
import textwrap
from pathlib import Path

import duckdb
import pytest

from sparkloom.llm import licences
from sparkloom.llm.licences import digest_texts, known_digests, licence_lookup, op5_canonical_digest, op5_sql

TEXT = """Copyright (c) 1999 Somebody
Permission is hereby granted, free of charge, to any person; the licence -- "as is" --
is without warranty of any organisation's merchantability and non-infringement.
"""


def test_variants_share_a_digest(spark):
    variants = [
        TEXT,
        TEXT.upper(),
        TEXT.replace("1999 Somebody", "2024 Some Body Else, Inc."),
        TEXT.replace("licence", "license").replace("organisation", "organization"),
        TEXT.replace(" -- ", "\n\n*** ").replace(";", ","),
        TEXT.replace("non-infringement", "noninfringement"),
        "  \n" + TEXT + "\n\n",
    ]
    docs = spark.createDataFrame(list(enumerate([*variants, TEXT + " and more", None, ""])), "doc_id long, text string")
    known = digest_texts(spark.createDataFrame([("Mine", TEXT), ("Zed", TEXT.upper())], "licence string, text string"))
    assert {r.licence for r in known.collect()} == {"Mine"}
    got = {r.doc_id: r for r in licence_lookup(docs, known).collect()}
    assert [got[k].licence for k in range(len(variants))] == ["Mine"] * len(variants)
    assert [got[len(variants) + k].licence for k in range(3)] == [None] * 3
    assert got[8].digest == got[9].digest == hashlib.sha256(b"").hexdigest()


def test_long_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(None, TEXT, "x"), (1, TEXT, "y"), (1, TEXT, "y"), (2, TEXT * 3000, "z")], "doc_id long, text string, digest string")
    known = digest_texts(docs.where("doc_id = 1").selectExpr("'Mine' as licence", "text"))
    got = licence_lookup(docs, known)
    assert got.columns == ["doc_id", "digest", "licence"]
    assert sorted((r.doc_id or 0, r.licence or "") for r in got.collect()) == [(0, "Mine"), (1, "Mine"), (1, "Mine"), (2, "")]
    assert licence_lookup(docs.limit(0), known).collect() == []
    assert {r.licence for r in licence_lookup(docs, known.limit(0)).collect()} == {None}


def test_spellings_are_settled():
    """No spelling's replacement is replaced in turn, so that the canonical form does not depend on the order."""
    assert not {w for v in licences.SPELLINGS.values() for w in v.split()} & set(licences.SPELLINGS)


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_table_knows_shipped_texts(spark):
    rows = [(f.name, f.read_text(errors="replace")) for f in Path("/usr/share/common-licenses").iterdir() if f.is_file() and f.name in ("Apache-2.0", "GPL-3", "MPL-2.0", "CC0-1.0", "LGPL-2.1", "GFDL-1.3")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.licence for r in licence_lookup(docs, known_digests(spark)).collect()}
    assert got == {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "LGPL-2.1": "LGPL-2.1", "GFDL-1.3": "GFDL-1.3"}


def rewrapped(text, width):
    """Paragraphs as one line each (width None: nothing between them; 0: the usual blank line), or filled to a width."""
    parts, held = [], []
    for line in [*text.splitlines(), ""]:
        if any(c.isalnum() for c in line):
            held.append(line)
        elif held:
            parts.append(" ".join(" ".join(held).split()))
            held = []
    return ("\n" if width is None else "\n\n").join(textwrap.fill(p, width) if width else p for p in parts)


NOTICED = """The Software License

Copyright (c) 1999-2003, Somebody Or Other <some@body.org>
Copyright 2004 Someone Else
All rights reserved.

The above copyright notice and this permission notice shall be included in all copies of it. In no event shall the authors or
COPYRIGHT HOLDERS BE LIABLE for any claim, (c) nor for any other liability of the copyright
owner or of copyright notices 1999.
"""


def test_forms_do_not_depend_on_wrapping(spark):
    holder = NOTICED.replace("1999-2003, Somebody Or Other <some@body.org>", "2020 Nobody").replace("Copyright 2004 Someone Else\n", "")
    texts = [rewrapped(t, w) for t in (NOTICED, holder) for w in (None, 0, 30, 47, 60, 72, 100, 500)] + [NOTICED.replace("\n", "\n * "), NOTICED.replace("shall", "need not"), NOTICED.replace("COPYRIGHT HOLDERS BE", "NOBODY BE")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = digest_texts(spark.createDataFrame([("Mine", NOTICED)], "licence string, text string"))
    got = {r.doc_id: r.licence for r in licence_lookup(docs, known).collect()}
    assert [got[k] for k in range(len(texts))] == ["Mine"] * (len(texts) - 2) + [None] * 2


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_shipped_texts_are_known_at_any_width_and_to_the_sql(spark):
    names = ("Apache-2.0", "Artistic", "BSD", "GPL-1", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-1.1", "MPL-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3")
    texts = [t for n in names for t in [Path("/usr/share/common-licenses", n).read_text(errors="replace")] for t in (t, *(rewrapped(t, w) for w in (None, 0, 60, 70, 76, 80, 100)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(tuple(r) for r in licence_lookup(docs, known_digests(spark)).collect())
    assert all(licence for *_, licence in rows) and {licence for *_, licence in rows} >= {"Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MPL-2.0"}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert sorted(con.sql(op5_sql()).fetchall()) == rows


def test_op5_has_one_row_per_document(spark):
    got = op5_canonical_digest(spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and len(json.loads((Path(licences.__file__).parent / "licence_digests.json").read_text())) > 10
