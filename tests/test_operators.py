"""Operators against small hand-computed frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkwell.operators import assembly as A
from inkwell.operators import filters as L
from inkwell.operators import graph as G
from inkwell.operators import ledger as M
from inkwell.operators import pages as P
from inkwell.operators import search as S
from inkwell.operators import sections as N
from inkwell.operators import structure as R
from inkwell.operators import tables as B
from inkwell.operators.chunking import lines_of, packed_lines
from inkwell.operators.ranking import importance, importance_multiplier
from inkwell.sources import scans as X


@pytest.mark.parametrize("sizes, groups", [([900, 900, 900, 300], [[900, 900], [900, 300]]), ([1200, 900, 400], [[1200], [900, 400]]), ([2500, 100], [[2500, 100]]), ([10], [[10]]), ([2500], [[2500]])])
def test_packing(spark, sizes, groups):
    docs = spark.createDataFrame([(1, "\n\n".join("x" * n for n in sizes))], "doc_id long, text string")
    got = packed_lines(docs).orderBy("chunk_no").collect()
    assert [[len(x) for x in r.content.split("\n")] for r in got] == groups and [r.n_chars for r in got] == [sum(g) for g in groups]


def test_packing_of_nothing(spark):
    assert packed_lines(spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "doc_id long, text string")).count() == 0


BM = [("d1", "alpha beta alpha"), ("d2", "alpha gamma"), ("d3", "delta beta"), ("d4", "gamma delta")]


@pytest.mark.parametrize("query, scores", [("alpha", {"d1": -0.180027, "d2": -0.147384}), ("alpha delta", {"d1": 0.0, "d2": 0.0, "d3": 0.0, "d4": 0.0})])
def test_bm25(spark, query, scores):
    chunks = spark.createDataFrame(BM, "document_id string, content string")
    asked = spark.createDataFrame([(1, query)], "query_id int, query string")
    got = S.bm25(S.postings(chunks, F.col("content"), ["document_id"]), S.query_terms(asked), ["document_id"])
    assert {r.document_id: round(r.score, 6) for r in got.collect()} == pytest.approx(scores, abs=2e-6)


def test_fusion(spark):
    rows = [("path", "c2", 0), ("content", "c1", 0), ("content", "c2", 1), ("term", "c3", 0), ("term", "c1", 1)]
    ranked = spark.createDataFrame([(1, *r) for r in rows], "query_id int, channel string, chunk_id string, rank0 int")
    got = S.normalised(S.fused(ranked, ["chunk_id"]), ["query_id"])
    assert {r.chunk_id: (r.score, r.norm_score) for r in got.collect()} == {"c1": (0.05698, 1.0), "c2": (0.048652, 0.742884), "c3": (0.02459, 0.0)}
    own = ranked.withColumn("w", F.create_map(F.lit("term"), F.lit(0.0)))
    assert {r.chunk_id: r.score for r in S.fused(own, ["chunk_id"], own="w").collect()}["c3"] == 0.0


def test_term_search(spark):
    chunks = spark.createDataFrame([(1, "An Alphabet of things"), (2, "alpha beta gamma"), (3, "nothing")], "chunk_id int, content string")
    asked = spark.createDataFrame([(7, "Alpha Beta"), (8, "the")], "query_id int, query string")
    assert {(r.query_id, r.chunk_id): r.score for r in S.term_hits(chunks, F.col("content"), asked, ["chunk_id"]).collect()} == {(7, 1): 1.0, (7, 2): 100.0}


def test_small_corpus(spark):
    chunks = spark.createDataFrame([("u", 1), ("u", 2), ("v", 3)], "user_id string, sort_order int")
    asked = spark.createDataFrame([(1, "u", 1), (2, "v", 10)], "query_id int, user_id string, top_k int")
    assert [(r.query_id, r.sort_order, r.score, r.route) for r in S.small_corpus(chunks, asked, ["user_id"], ["sort_order"]).collect()] == [(2, 3, 1.0, "small_corpus_all")]


def test_exclusions(spark):
    rows = spark.createDataFrame([("d", "a / keep"), ("d", "a / cut"), ("d", "a / cut / b"), ("d", "a / cutter"), ("e", "a / cut"), ("d", "Root")], "document_id string, section_path string")
    cut = spark.createDataFrame([("d", "a / cut")], "document_id string, section_path string")
    assert sorted((r.document_id, r.section_path) for r in L.without_sections(rows, cut).collect()) == [("d", "Root"), ("d", "a / cutter"), ("d", "a / keep"), ("e", "a / cut")]


def test_signals_and_types(spark):
    rows = spark.createDataFrame([("A / Intro",), ("B",), (None,)], "p string")
    s = F.array(F.lit("intro"))
    got = rows.select(L.by_signals(F.col("p"), s, "keep").alias("k"), L.by_signals(F.col("p"), s).alias("d"), L.by_signals(F.col("p"), s, "keep", True).alias("n")).collect()
    assert [(r.k, r.d, r.n) for r in got] == [(True, False, True), (False, True, False), (False, True, True)]
    assert [r.x for r in spark.range(1, 7).select(L.types_allowed(F.lit("image"), F.col("id").cast("int")).alias("x")).collect()] == [True, False, True, False, True, False]


def test_importance(spark):
    now = dt.datetime(2024, 1, 31)
    rows = spark.createDataFrame([(4, now, now), (4, now - dt.timedelta(30), now - dt.timedelta(60))], "n int, last timestamp_ntz, made timestamp_ntz")
    got = [r.x for r in rows.select(importance(F.col("n"), F.col("last"), F.col("made"), F.lit(now).cast("timestamp_ntz")).alias("x")).collect()]
    assert got == [3.1, 1.4752]
    m = importance_multiplier(spark.createDataFrame([(1, float(k)) for k in range(4)], "q int, v double"), ["q"], "v")
    assert [r.multiplier for r in m.orderBy("v").collect()] == [0.7096, 0.9319, 1.1681, 1.3904]


def test_graph_edges(spark):
    words = {1: ["alpha", "beta", "gamma", "delta"], 2: ["alpha", "beta", "gamma", "zeta"], 3: ["alpha", "beta", "gamma", "delta"]}
    rows = spark.createDataFrame([(d, w) for d, ws in words.items() for w in ws], "document_id int, keyword string")
    when = spark.createDataFrame([(d, d) for d in words], "document_id int, published_at int")
    edges = G.edges(rows, rows, when)
    assert [(r.source, r.target, r.n_shared, r.weight) for r in edges.collect()] == [(1, 3, 4, 1.0)]
    assert {r.node: r.degree for r in G.degrees(edges).collect()} == {1: 1, 3: 1}


def test_sections(spark):
    chunks = spark.createDataFrame([("d", "B / x", 0, "text", "aa"), ("d", "A", 1, "image", "b"), ("d", "B", 2, "text", "c"), ("d", "Root", 3, "table", "d")], "document_id string, section_path string, sort_order int, chunk_type string, content string")
    assert [(r.section_path, r.parent_path, r.sort_order) for r in N.section_table(chunks).orderBy("sort_order").collect()] == [("B", None, 0), ("B / x", "B", 1), ("A", None, 2), ("Root", None, 3)]
    got = {r.section_path: (r.n_text, r.n_image, r.n_table, r.n_chars) for r in N.rolled_up(N.direct_counts(chunks)).collect()}
    assert got == {"B": (2, 0, 0, 3), "B / x": (1, 0, 0, 2), "A": (0, 1, 0, 1), "Root": (0, 0, 0, 1)}


def test_renamed_repeats(spark):
    rows = spark.createDataFrame([("d", 0, "r/a"), ("d", 1, "r/a/x"), ("d", 2, "r/a"), ("d", 3, "r/a/y"), ("d", 4, "r/b")], "document_id string, sort_order int, path string")
    assert [r.path for r in N.renamed_repeats(rows).orderBy("sort_order").collect()] == ["r/a", "r/a/x", "r/a_2", "r/a_2/y", "r/b"]


def test_lineage_and_levels(spark):
    chunks = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6)], "chunk_id int, parent_id int")
    assert {r.chunk_id: (r.root, r.depth) for r in N.lineage(chunks).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (None, None), 7: (None, None)}
    steps = spark.createDataFrame([(1, s) for s in "abcdxy"], "plan_id int, step_id string")
    needs = spark.createDataFrame([(1, "b", "a"), (1, "c", "b"), (1, "c", "a"), (1, "d", "zz"), (1, "x", "y"), (1, "y", "x")], "plan_id int, step_id string, needed string")
    assert {r.step_id: r.level for r in N.plan_levels(steps, needs).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "x": None, "y": None}


def test_heading_paths(spark):
    lines = [("# A", 1), ("t1", -1), ("## B", 2), ("### C", 3), ("## B", 2), ("# D/E", 1), ("### F", 3)]
    rows = spark.createDataFrame([(1, k, t, t.lstrip("# "), n) for k, (t, n) in enumerate(lines)], "doc_id int, line_no int, line string, title string, level int")
    assert [r.path for r in R.heading_paths(rows).orderBy("line_no").collect()] == ["Root/A", "Root/A/B", "Root/A/B/C", "Root/A/B (2)", "Root/D∕E", "Root/D∕E/F"]
    got = R.sections_from_lines(rows).orderBy("section_no").collect()
    assert [(r.section, r.content) for r in got][:2] == [("Root/A", "t1"), ("Root/A/B", "")]
    assert [r.parent for r in R.heading_parents(rows.filter("level > 0")).orderBy("line_no").collect()] == [None, 0, 2, 0, None, 5]
    assert [(r.line_no, r.level) for r in R.without_single_leaves(rows.filter("level > 0")).orderBy("line_no").collect()] == [(0, 1), (2, 2), (4, 2), (5, 1)]


def test_body_runs(spark):
    rows = spark.createDataFrame([(1, 0, "Head", 1), (1, 1, "one", -1), (1, 2, "two.", -1), (1, 3, "three", -1), (1, 5, "four", -1)], "doc_id int, line_no int, title string, level int")
    assert [r.title for r in R.joined_body(rows).orderBy("line_no").collect()] == ["Head", "one two.", "three", "four"]
    assert [r.text for r in R.compacted(rows).orderBy("first_line").collect()] == ["Head", "[4 BODY LINES]"]
    marked = spark.createDataFrame([(1, 0, "A", 1, ""), (1, 1, "more", 1, "<"), (1, 2, "B", 2, "")], "doc_id int, line_no int, title string, level int, mark string")
    assert [(r.title, r.level) for r in R.continued_headings(marked.withColumn("level", F.when(F.col("mark") == "<", 0).otherwise(F.col("level")))).orderBy("line_no").collect()] == [("A more", 1), ("more", -1), ("B", 2)]


def test_shards(spark):
    rows = spark.createDataFrame([(1, 450, [1, 90, 180, 260, 390]), (2, 407, [1])], "doc_id int, page_count int, h1_pages array<int>")
    cut = P.page_cuts(rows, 200)
    assert {r.doc_id: r.cuts for r in cut.collect()} == {1: [179, 259], 2: []}
    plan = P.shards(cut)
    assert [(r.page_start, r.page_end) for r in plan.filter("doc_id = 1").orderBy("shard_index").collect()] == [(1, 179), (180, 259), (260, 450)]
    assert [r.error for r in P.shard_errors(plan, 200).collect() if r.doc_id == 2] == ["shard 0 exceeds max_pages=200"]


def test_page_kinds_and_grep(spark):
    rows = spark.createDataFrame([(10, 0.0, 0, 0, "portrait"), (500, 0.0, 0, 0, "landscape"), (100, 0.5, 0, 0, "portrait"), (500, 0.0, 1, 0, "portrait"), (500, 0.0, 0, 0, "portrait")], "a int, b double, c int, d int, e string")
    assert [r.k for r in rows.select(P.page_kind(*map(F.col, "abcde"))["kind"].alias("k")).collect()] == ["low_content", "landscape", "image_heavy", "table_heavy", "normal"]
    text = spark.createDataFrame([(1, "one two one"), (2, None)], "doc_id int, text string")
    assert [(r.match, r.offset, r.snippet) for r in P.grep(text, "one", "doc_id", around=2).orderBy("n").collect()] == [("one", 0, "one t"), ("one", 8, "o one")]


def test_tables(spark):
    html = spark.createDataFrame([(1, "<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><th>B1</th><th>B2</th></tr><tr><td>x</td><td>1</td><td>2</td></tr></table>")], "doc_id int, html string")
    cells = B.html_cells(html, "doc_id")
    assert [r.header for r in B.header_grid(cells.filter("row < 2"), ["doc_id", "table_no"]).orderBy("col").collect()] == ["A", "B > B1", "B > B2"]
    pipes = spark.createDataFrame([(1, "x\n| a | b |\n|---|:-:|\n| 1 |\n| 2 | 3 | 4 |\ny")], "doc_id int, text string")
    assert sorted((r.row, r.col, r.value) for r in B.pipe_cells(lines_of(pipes)).collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, ""), (2, 0, "2"), (2, 1, "3")]
    grid = spark.createDataFrame([(1, r, c, v) for r, row in enumerate([["Region", "Value"], ["North", "10"]]) for c, v in enumerate(row)], "table_id int, row int, col int, value string")
    assert [(r.header_rows, r.header_cols) for r in B.header_region(grid, ["table_id"]).collect()] == [(1, 1)]
    assert B.records(grid, ["table_id"]).first().record == {"Region": "North", "Value": "10"} and [r.col for r in B.index_columns(grid, ["table_id"]).collect()] == [0]
    blank = spark.createDataFrame([(1, r, c, v) for r, c, v in [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (1, 1, "d"), (3, 0, "e"), (3, 1, "f"), (4, 0, "g"), (4, 1, "h"), (6, 5, "z")]], "table_id int, row int, col int, value string")
    assert {(r.row, r.part) for r in B.sheet_parts(blank, ["table_id"]).collect()} == {(0, 0), (1, 0), (3, 1), (4, 1), (6, 1)}


def test_ledger(spark):
    paid = spark.createDataFrame([("u", 50, "succeeded"), ("u", 60, "succeeded"), ("v", 500, "failed")], "user_id string, amount int, status string")
    tiers = spark.createDataFrame([("pro", 100), ("basic", 10)], "tier string, threshold int")
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    assert {r.user_id: r.tier for r in M.tiers_of(paid, tiers, users).collect()} == {"u": "pro", "v": "free"}
    rules = spark.createDataFrame([("all", 9, "*", "/api/*"), ("get", 1, "GET", "/api/docs*")], "rule_id string, priority int, method string, path string")
    asked = spark.createDataFrame([(1, "GET", "/api/docs/3"), (2, "POST", "/api/docs"), (3, "GET", "/x")], "request_id int, method string, path string")
    assert {r.request_id: r.rule_id for r in M.first_rules(asked, rules).collect()} == {1: "get", 2: "all", 3: "default"}
    charges = spark.createDataFrame([("c", 1, "p", 300), ("c", 2, "p", 500), ("d", 1, "p", 100)], "charge_id string, event_at int, price_id string, refunded_cents long")
    had = spark.createDataFrame([("c", 200), ("d", 100)], "charge_id string, cents long")
    prices = spark.createDataFrame([("p", 9000, 1000)], "price_id string, credits_amount long, amount_cents long")
    assert [(r.charge_id, r.new_cents, r.credits) for r in M.reconciled(charges, had, prices).collect()] == [("c", 300, 2700)]


def test_assembly(spark):
    kind = "query_id int, document_id string, chunk_id string, chunk_type string, content string, sort_order int, connect_to array<struct<target:string,relation:string>>"
    rows = spark.createDataFrame([(1, "d", "t", "text", "see [images/i.png] now", 0, [("i", "embeds"), ("b", "related")]), (1, "d", "i", "image", "pic", 1, [])], kind)
    chunks = spark.createDataFrame([("d", "b", "table", "cells", 2)], "document_id string, chunk_id string, chunk_type string, content string, sort_order int")
    got = A.assembled(rows, chunks).collect()
    assert [(r.chunk_id, r.content) for r in got] == [("t", "see  now\ncells")]
    owned = spark.createDataFrame([("d", "i", "A / B / C"), ("d", "j", "X")], "document_id string, chunk_id string, owner_path string")
    here = spark.createDataFrame([("d", "A"), ("d", "A / B")], "document_id string, section_path string")
    assert {r.chunk_id: r.placed_at for r in A.placed_assets(owned, here).collect()} == {"i": "A / B", "j": "Root"}


def test_sources(spark):
    files = spark.createDataFrame([("a.TXT",), ("b.exe",), ("c.tar.md",)], "path string")
    good, bad = X.routed(files)
    assert {r.path: r.format for r in good.collect()} == {"a.TXT": "text", "c.tar.md": "markdown"} and [r.path for r in bad.collect()] == ["b.exe"]
    rows, wrong = X.from_canonical(X.to_canonical(spark.createDataFrame([(1, "x")], "id int, t string")).unionByName(spark.createDataFrame([("{}",), ('{"canonical_model_version":"2.1.0"}',)], "value string")), "id int, t string")
    assert [tuple(r) for r in rows.collect()] == [(1, "x")] and sorted(r.reason for r in wrong.collect()) == ["missing version", "other version"]
    layout = '[{"page":1,"blocks":[{"type":"t","lines":[{"spans":[{"content":"Hi","height":9.0}]}],"blocks":[{"type":"u","lines":[{"spans":[{"content":"In","height":7.0}]}]}],"cells":["c"]}]}]'
    assert {(r.text, r.height) for r in X.layout_spans(spark.createDataFrame([(1, layout)], "doc_id int, layout string")).collect()} == {("Hi", 9.0), ("In", 7.0), ("c", 0.0)}


def test_long_chains_and_plans(spark):
    """Chains of two hundred and plans of fifty levels come out whole; cycles, and what leads into them, are null."""
    chain = [(k, k - 1 if k else None) for k in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 2999), (2001, 2001)]
    got = {r.chunk_id: (r.root, r.depth) for r in N.lineage(spark.createDataFrame(chain, "chunk_id int, parent_id int")).collect()}
    assert [got[k] for k in range(200)] == [(0, k) for k in range(200)] and got[2000] == (2000, 0)
    assert all(got[k] == (None, None) for k in (1000, 1001, 1002, 1003, 2001)) and len(got) == len(chain)
    steps = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 0), (2, 1), (2, 2)], "plan_id int, step_id int")
    needs = spark.createDataFrame([(1, k, k - 1) for k in range(1, 50)] + [(1, 40, 3), (2, 0, 1), (2, 1, 0), (2, 2, 9)], "plan_id int, step_id int, needed int")
    got = {(r.plan_id, r.step_id): r.level for r in N.plan_levels(steps, needs).collect()}
    assert [got[1, k] for k in range(50)] == list(range(50)) and got[2, 0] is got[2, 1] is got[2, 2] is None
