import hashlib
import re

import pytest
from pyspark.sql import functions as F

from inkwell.llm.exact_dedup import deduplicated, exact_dedup
from inkwell.llm.shared import possible

ROWS = [
    (5, "a  b", "x"), (1, "a\tb", "y"), (9, "a b", "z"), (2, None, "n"), (7, "", "e"), (3, " ", "s"), (4, "c", "c"), (4, "c", "c"), (None, "d", "d"), (8, "d", "d"),
    (6, "é" * 5000, "long"), (10, "A b", "case"), (11, "a b ", "tail"), (12, "a b", "nb"),
]


def expected(rows):
    groups = {}
    for k, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(k)
    out = []
    for t, ks in groups.items():
        keep = min((k for k in ks if k is not None), default=None)
        out += [(k, keep, len(ks), hashlib.sha256(t.encode()).hexdigest()) for k in ks]
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [lambda t: F.sha2(t, 256), lambda t: F.substring(F.sha2(t, 256), 1, 1)], ids=["sha256", "colliding"])
def test_groups_and_collisions(spark, digest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, _digest string").repartition(4)
    got = exact_dedup(docs, digest=digest, files_per_batch=1).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(ROWS)


def test_kept_rows_from_files(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, group_size string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = exact_dedup(docs).filter("kept").count()
    kept = deduplicated(docs)
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in ROWS}
    assert got == len(texts) and kept.columns == docs.columns and kept.count() == len(texts)


def test_any_frame_keeps_one_of_each_group(spark):
    rows = [(4, "c", 1, "a", "x"), (4, "c", 1, "b", "y"), (1, "z", None, None, None), (None, "q", 2, "", "w"), (None, " q", 3, "", "w"), (None, "q", 2, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _locator int, _metadata string, _digest string")
    assert sorted([(r.doc_id, r.kept) for r in exact_dedup(docs).collect()], key=str) == sorted([(4, True), (4, False), (1, True), (None, True), (None, False), (None, True)], key=str)
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and sorted([(r[0], r[1].strip()) for r in kept.collect()], key=str) == sorted([(4, "c"), (1, "z"), (None, "q"), (None, "q")], key=str)


def test_rows_made_from_a_scan(spark, tmp_path):
    """Exploded, joined and united scans have several rows of one place; one of each group stays."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a\na\nb"), (2, "b\nc"), (3, "d"), (3, "d")], "doc_id long, text string").coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    lines = scan.select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    assert sorted((r.doc_id, r.text) for r in deduplicated(lines).collect()) == [(1, "a"), (1, "b"), (2, "c"), (3, "d")]
    twice = scan.join(spark.createDataFrame([(3, 1), (3, 2)], "doc_id long, x int"), "doc_id").select("doc_id", "text")
    assert [tuple(r) for r in deduplicated(twice).collect()] == [(3, "d")] and exact_dedup(twice).filter("kept").count() == 1
    assert deduplicated(scan.unionByName(scan)).count() == 3
    assert deduplicated(scan.filter("doc_id > 0"), a_scan=True).count() == 3 == deduplicated(scan, a_scan=True).count()


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filter_of_hits(spark):
    """All hits pass, hardly any other row does."""
    texts = spark.range(20000).selectExpr("id", "sha2(cast(id as string), 256) _digest")
    hits = texts.filter("id % 7 = 0")
    got = {r.id for r in possible(texts, hits.select("_digest"), "_digest").collect()}
    assert got >= set(range(0, 20000, 7)) and len(got) < 20000 / 7 + 20
    assert possible(texts, hits.limit(0), "_digest").count() == 0
