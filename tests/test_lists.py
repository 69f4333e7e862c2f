"""List functions, extension slots and assembly helpers."""

import datetime as dt

from pyspark.sql import functions as F

from inkwell.functions import arrays as R
from inkwell.functions import ext as E
from inkwell.operators import assembly as A


def test_lists(spark):
    rows = spark.createDataFrame([("ab;c; de",), ("ab, cd",), (None,)], "v string")
    assert [r.x for r in rows.select(R.keyword_list(F.col("v")).alias("x")).collect()] == [["ab", "de"], ["ab", "cd"], []]
    rows = spark.createDataFrame([("['a', 'b']",), ("a->b;c",), (None,)], "v string")
    assert [r.x for r in rows.select(R.token_list(F.col("v")).alias("x")).collect()] == [["a", "b"], ["a", "b", "c"], []]
    assert spark.sql("select '[1, 2]' v").select(R.page_list(F.col("v")).alias("x")).first().x == [1, 2]


def test_connections(spark):
    rows = spark.createDataFrame([('[{"target":" t ","score":0.5},{"target":""}]',), ('["a","b"]',), ("x; y",), (None,)], "v string")
    got = [[(c.target, c.relation, c.score) for c in r.x] for r in rows.select(R.connections(F.col("v")).alias("x")).collect()]
    assert got == [[("t", "related", 0.5)], [("a", "related", 1.0), ("b", "related", 1.0)], [("x", "related", 1.0), ("y", "related", 1.0)], []]


def test_chunk_records(spark):
    rows = spark.createDataFrame([("d", 0, "text body", "a/b", "PTXT\nmore", None, "k1;k2", None, None, None, "1;2"), ("d", 1, "", "images/x.png", "Image", 3, None, "s", None, "t", None)], "document_id string, sort_order int, content string, path string, type string, length int, keywords string, summary string, tokens string, connectto string, page_nums string")
    a, b = R.chunk_records(rows).orderBy("sort_order").collect()
    assert (a.type, a.metadata.length, a.metadata.keywords, a.metadata.page_nums, a.metadata.file_path) == ("text", 9, ["k1", "k2"], [1, 2], None)
    assert (b.type, b.metadata.original_name, b.metadata.connect_to[0].target) == ("image", "x.png", "t") and a.chunk_id != b.chunk_id


def test_slots(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    embed = E.embedding(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [r.e for r in rows.select(embed(F.col("text")).alias("e")).collect()] == [[3.0, 1.0], [0.0, 1.0]]
    assert [r.compression_ratio for r in E.compression(lambda t: t[:1])(rows, "text").collect()] == [0.3333, 0.0]
    assert [(r.doc_id, r.sort_order, r.content) for r in E.parsed(rows, lambda t: [("p", "text", w) for w in t.split()]).collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert E.staged(rows, lambda d: d.filter("doc_id = 1"), lambda d: d.select("text")).columns == ["text"]


def test_documents_and_runs(spark):
    docs = spark.createDataFrame([("d", "u", "n", "active", None, dt.datetime(2024, 1, 2)), ("e", "u", "n", "archived", None, dt.datetime(2024, 1, 3))], "document_id string, user_id string, namespace string, status string, archived_at timestamp, updated_at timestamp")
    assert [r.document_id for r in A.listed_documents(docs, 5).collect()] == ["d"]
    gone = A.archived(docs, spark.createDataFrame([("d",)], "document_id string"), F.lit("2024-02-01").cast("timestamp"))
    assert {r.document_id: r.status for r in gone.collect()} == {"d": "archived", "e": "archived"}
    steps = spark.createDataFrame([(1, "q", "d", 5, 0.5), (1, "q", "d", 7, 0.25), (1, "q", None, 1, 0.1)], "run_id int, query string, document_id string, tokens int, seconds double")
    r = A.run_summary(steps).first()
    assert (r.n_results, r.documents, r.tokens, r.seconds, len(r.query_hash)) == (2, ["d"], 13, 0.85, 16)
    there, missing = A.lookup(docs, spark.createDataFrame([("d",), ("z",)], "document_id string"), "document_id")
    assert [x.document_id for x in there.collect()] == ["d"] and [x.document_id for x in missing.collect()] == ["z"]
