import duckdb
from pyspark.sql import functions as F

from inkwell.llm.licenses import KNOWN, TEXTS, canonical, canonical_sql, known_texts, scan_licenses


def test_whole_texts(spark):
    rows = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))]
    apache = dict(rows)["Apache-2.0"]
    rows += [("Apache-2.0", apache[: apache.index("END OF TERMS")]), ("Apache-2.0", apache.replace("[yyyy]", "2020").split("APPENDIX")[0])]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) >= 16 and all(r.license_id == r.doc_id for r in got)


def test_only_copyright_lines_go(spark):
    isc = next(t for name, t in KNOWN if name == "ISC")
    wrapped = isc.replace("that the above copyright", "that the above\ncopyright")
    assert wrapped != isc
    lines = ["Copyright 2020 Jane Doe", "Copyright (c) Jane Doe", "(c) Jane Doe", "© Jane", "Copyright Jane Doe", "All rights reserved."]
    rows = [(0, wrapped)] + [(k, f"{line}\n{isc}") for k, line in enumerate(lines, 1)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == dict.fromkeys(range(len(rows)), "ISC")


LINES = [
    "Copyright 2020 Me", "copyright notice and this", "Copyright Jane Doe", "(c) 2020 x", "(c) you must", "(c) Jane Doe", "Copyright", "Copyright (C) me", "All rights reserved.", "* © x", "(b) copyright 2020", "the copyright 2020",
    "copyright and permission", "(c) one two three four five six", "(c) jane any doe", "copyright owners 1999", "  (c)", "(c) anyone", "Copyright\tholder (c)", "body\nCopyright 2001 A\n(c) b\nmore licence", "The Foo License (v2)\n1. Favour\na) centre",
    "Licensed under CC BY-NC 4.0.", "", "é © ü", "copyright notices", "copyright noticed",
]


def test_sql_has_the_same_rules_and_lists(spark):
    texts = LINES + [own for _, own in known_texts()]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (n INT, x VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"SELECT n, {canonical_sql('x')} FROM t").fetchall())
    got = {r.n: r.c for r in spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", canonical(F.col("x")).alias("c")).collect()}
    assert got == want


def test_notices_and_row_names(spark):
    rows = [("a", "x\nLicensed under CC BY-NC 4.0.\nReleased under CC BY-SA 3.0."), ("b", "Licensed under the zlib License."), ("c|", "|"), ("c", "||")]
    docs = spark.createDataFrame(rows, "`doc.id` string, text string")
    got = {r[0]: (r.notice_ids, r.n_notices) for r in scan_licenses(docs, "doc.id").collect()}
    assert got == {"a": (["CC-BY-NC-4.0", "CC-BY-SA-3.0"], 2), "b": (["Zlib"], 1), "c|": ([], 0), "c": ([], 0)}
