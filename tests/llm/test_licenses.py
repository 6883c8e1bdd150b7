import hashlib
from pathlib import Path

import duckdb
import pytest

from quillmesh.llm import licenses, registry
from quillmesh.llm.texts import KNOWN


def plain(text):
    digests = dict(licenses.known())
    one = licenses.whole(text or "")
    digest = hashlib.sha256(one.encode()).hexdigest() if one else None
    found = [digests[d] for line in licenses.plain(text or "").split("\n") if (d := hashlib.sha256(licenses.spelt(line).encode()).hexdigest()) in digests]
    return digest, digests.get(digest), len(found), ",".join(sorted(set(found)))


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op8_license_scan(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: plain(t) for i, t in texts.items()}


def test_variants_of_known_texts(spark):
    mit = dict(reversed(KNOWN[:1]))["MIT"]
    texts = [mit, "Copyright (c) 2020 A. Body\n© 2021 other\n\n" + mit.upper(), mit.replace("sublicense", "sublicence").replace('"', "“"), mit + " extra", "MIT License\n\nCopyright 1999 X\n" + mit, None, "", "...", "Released under the MIT licence!\nx\nReleased under the MIT License.", KNOWN[4][1].replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), "w " * 50_000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(8, texts[8], "z"), (None, mit, "z")], "doc_id long, text string, name string")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts) + 2
    by = {r.doc_id: tuple(r)[1:] for r in rows}
    assert {i: by[i] for i in range(len(texts))} == {i: plain(t) for i, t in enumerate(texts)}
    assert [by[i][1] for i in range(6)] == ["MIT", "MIT", "MIT", None, "MIT", None] and by[None][1] == "MIT"
    assert by[8][2:] == (2, "MIT") and by[9][1] == "BSD-2-Clause"
    assert licenses.scan(docs.limit(0)).count() == 0
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    assert {r[0]: r[1:] for r in con.execute(licenses.oracle()).fetchall()} == {i: by[i] for i in range(len(texts))}


def test_rows_of_one_id_get_their_own_answer(spark):
    docs = spark.createDataFrame([(1, "nothing here"), (1, "Released under the MIT License.\nx"), (1, "nothing here")], "doc_id long, text string")
    assert sorted((r.n_notices, r.notices) for r in licenses.scan(docs).collect()) == [(0, ""), (0, ""), (1, "MIT")]


FULL = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not (FULL / "Apache-2.0").exists(), reason="needs the public texts")
def test_full_texts_are_known_however_they_are_broken_into_lines(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    texts = {f: (FULL / f).read_text() for f in names}
    rows = [(f, t) for f, t in texts.items()] + [(f, " ".join(t.split()).upper()) for f, t in texts.items() if f in ("CC0-1.0", "MPL-2.0")] + [("Apache-2.0", texts["Apache-2.0"].split("END OF TERMS")[0])]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert [(r.doc_id, r.license) for r in licenses.scan(docs).collect()] == [(f, names[f]) for f, _ in rows]
    assert licenses.scan(spark.createDataFrame([("x", texts["MPL-2.0"] + " more")], docs.schema)).first().license is None
