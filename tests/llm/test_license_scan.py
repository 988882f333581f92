from pyspark.sql import functions as F

from millrace.llm import license_scan
from millrace.llm.license_files import FILES
from millrace.llm.license_texts import FULL, NOTICES


def scanned(spark, texts):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, license string")
    return [(r["license"], r["notices"], r["n_notices"]) for r in license_scan.scan(docs).orderBy("doc_id").collect()]


def test_every_known_text_is_found_in_other_dress(spark):
    for name, text in FULL.items():
        dressed = "Copyright (c) 2020 Somebody\n(c) 2021 Others\n  " + text.upper().replace(" ", "  ").replace(".", " ;")
        assert scanned(spark, [text, dressed, text + " more"])[:2] == [(name, "", 0)] * 2 or name in ("0BSD", "ISC")
        assert scanned(spark, [text + " more"]) == [(None, "", 0)]


def test_usual_license_files_are_found(spark):
    files = {n: FILES[n] for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")}
    titled = {n: f"{title}\n\nCopyright (c) 2020 Somebody\n\n{FULL[n]}" for n, title in [("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License")]}
    filled = FILES["Apache-2.0"].replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 Somebody")
    bare = FILES["Apache-2.0"].split("   APPENDIX:")[0]
    want = [*files, *titled, "Apache-2.0", "Apache-2.0"]
    assert filled != FILES["Apache-2.0"] != bare
    assert [r[0] for r in scanned(spark, [*files.values(), *titled.values(), filled, bare])] == want


def test_notices(spark):
    got = scanned(spark, ["text\nReleased under the MIT Licence.\nmore\nreleased under the mit license", None, "", "Licensed under CC-BY-NC 4.0", "a license of no kind"])
    assert got == [(None, "MIT", 2), (None, "", 0), (None, "", 0), ("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), (None, "", 0)]


def test_equal_spellings_and_distinct_digests(spark):
    pairs = [("permission, whilst the licence is recognised, by the copyright owner", "Permission while the license is recognized by the copyright holder!")]
    for one, other in pairs:
        r = spark.createDataFrame([(one, other)], "a string, b string").select(license_scan.digest(F.col("a")), license_scan.digest(F.col("b"))).first()
        assert r[0] == r[1]
    known = license_scan.known(spark).collect()
    assert {r["license"] for r in known} == {*FULL, *NOTICES}
    assert len({r["digest"] for r in known}) == len(known)


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = c.sql(license_scan.ORACLE).select("doc_id, license, notices, n_notices").fetchall()
    got = [tuple(r) for r in license_scan.query(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want, key=lambda r: r[0])
    assert any(r[2] for r in got)
