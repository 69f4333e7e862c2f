"""Small tables on which findings of the third round showed."""

import duckdb
import pytest
from test_queries import plain

from inkwell.plans.all_queries import ORACLES, QUERIES


def same_as_sql(spark, sf, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.sql(ORACLES[name]).df(), QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    rows = lambda d: sorted(str(tuple(map(plain, r))) for r in d[columns].itertuples(index=False))
    assert rows(want) == rows(got)
    return got


@pytest.mark.parametrize("name", ["renamed_media", "merged_connections", "embed_edges"])
def test_reference_to_media_beyond_the_table(spark, sf, tmp_path, name):
    """The last text refers to a chunk that is not there: no connection, nothing renamed."""
    duckdb.connect().sql(f"COPY (SELECT * FROM '{sf}/documents.parquet' WHERE doc_id < 183) TO '{tmp_path}/documents.parquet'")
    got = same_as_sql(spark, str(tmp_path), name, "documents")
    assert name == "renamed_media" or "c182" not in set(got["chunk_id"])


def test_best_vectors_in_tiles():
    """A task's best vectors are the same whatever the tiles, ties by key included, and no product spans all vectors."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from inkwell.operators.search import best_vectors

    x = np.random.default_rng(3).integers(-2, 3, (3000, 4)).astype(float)
    lists = lambda v: pa.array(v.tolist(), pa.list_(pa.float64()))
    asked, found = pa.table({"_q": pa.array(range(40)), "_x": lists(x[:40])}), pa.table({"_v": pa.array(range(3000)), "_x": lists(x)})
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    score = np.round(unit[:40] @ unit.T, 6)
    want = [(q, v) for q in range(40) for v in sorted(range(3000), key=lambda v: (-score[q, v], v))[:5]]  # noqa: B023
    for tile, part in ((7, 11), (64, 4096)):
        got = best_vectors(asked, found, 5, tile=tile, part=part)
        assert list(zip(got["_q"].to_pylist(), got["_v"].to_pylist(), strict=True)) == want
    many = pa.table({"_v": pa.array(range(60000)), "_x": lists(np.tile(x, (20, 1)))})
    tracemalloc.start()
    best_vectors(pa.table({"_q": pa.array(range(600)), "_x": lists(x[:600])}), many, 5)
    assert tracemalloc.get_traced_memory()[1] < 100e6  # 600 * 60,000 products at once take 288 MB


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_header_grids_of_many_tables_in_one_batch(spark):
    from inkwell.operators import tables as B

    cells = [(f"t{k}", r, c, v, rs, cs) for k in range(600) for r, c, v, rs, cs in ((0, 0, "A", 2, 1), (0, 1, None if k % 2 else f"B{k}", 1, 2), (1, 1, "b2", 1, 1), (1, 0, "b1", 1, 1), (2, 0, "body", 1, 1))]
    df = spark.createDataFrame(cells + [(None, 3, 0, "x", 1, 1)], "t string, row int, col int, value string, rowspan int, colspan int")
    grids = B.header_grid(df, ["t"])
    assert "FlatMapGroupsInPandas" not in plan_of(grids)  # a data frame per table took milliseconds each
    got = sorted((str(r.t), r.col, r.header, r.header_rows) for r in grids.collect())
    want = [(f"t{k}", c, h if k % 2 == 0 or c == 0 else h.split(" > ")[1], 2) for k in range(600) for c, h in enumerate(("A", f"B{k} > b1", f"B{k} > b2"))]
    assert got == sorted(want)


def test_sheet_parts_of_many_sheets_in_one_batch(spark):
    from inkwell.operators import tables as B

    cells = [(f"t{k}", r, c, "" if r == 3 else f"{r}-{c}", r * c) for k in range(600) for r in range(6 + k % 2) for c in range(3)]
    df = spark.createDataFrame(cells, "t string, row int, col int, value string, more int").select("row", "t", "value", "col", "more")
    parts = B.sheet_parts(df, ["t"])
    assert "FlatMapGroupsInPandas" not in plan_of(parts) and parts.columns == ["row", "t", "value", "col", "more", "part"]
    got = sorted((r.t, r.row, r.col, r.value, r.more, r.part) for r in parts.collect())
    assert got == sorted((t, r, c, v, m, int(r > 3)) for t, r, c, v, m in cells if r != 3)


def test_nested_tables_shuffle_nothing(spark):
    """Nested tables come from one pass over a page: stray and missing tags, texts between cells, tables in cells and outside of them."""
    from inkwell.operators import tables as B

    html = "</table>x<table><td>a<tr><TH rowspan=2>b <i>c</i><table><tr><td>in</table> d<tr>lost<td colspan='3'>e</td>gone<table><td>f<table></table></table></table><table><tr><td>g"
    got = B.html_tables(spark.createDataFrame([(1, html), (2, None), (3, "<table><tr><td>")], "id int, html string"), "id")
    assert "Exchange" not in plan_of(got) and "Window" not in plan_of(got)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [
            (1, 0, 1, 0, 0, "a", False, 1, 1, None, None, None), (1, 0, 1, 0, 1, "b c d", True, 2, 1, None, None, None), (1, 1, 2, 0, 0, "in", False, 1, 1, 0, 0, 1),
            (1, 0, 1, 1, 0, "e", False, 1, 3, None, None, None), (1, 2, 2, 0, 0, "f", False, 1, 1, None, None, None), (1, 4, 1, 0, 0, "g", False, 1, 1, None, None, None), (3, 0, 1, 0, 0, "", False, 1, 1, None, None, None),
        ], key=str,
    )


def slot_memory(n_terms=20000, width=256):
    """Peak MB of numpy while a task counts the terms of a full slot, of which each block has its own terms."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from inkwell.operators import topk as K

    n = K.SLOT * n_terms
    at = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), pa.array((np.arange(n) % K.ROWS).astype(np.int32)))
    met = pa.table({"_block": pa.array(np.repeat(np.arange(K.SLOT), n_terms)), "term": pa.array([f"t{k}" for k in range(n)]), "_at": at})
    every = np.packbits(np.ones(K.ROWS, bool)).tobytes()
    masks = pa.table({"_block": pa.array(np.repeat(np.arange(K.SLOT), width)), "_q": pa.array(np.tile(np.arange(width, dtype=np.int32), K.SLOT)), "_mask": pa.array([every] * (K.SLOT * width), pa.binary())})
    tracemalloc.start()
    got = K._term_counts(masks, met)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert got.num_rows == n and got["_counts"][n - 1].as_py() == b"\x01\x00" * width
    return peak


def test_counts_of_a_slot_stay_small():
    assert slot_memory() < 150


def test_edges_between_blocks_and_slots(spark, monkeypatch):
    """Edges equal those of all pairs, also where several blocks meet several slots; no candidate pair is shuffled."""
    import random

    from inkwell.operators import graph as G

    monkeypatch.setattr(G, "BLOCK", 20, raising=False)
    monkeypatch.setattr(G, "SLOT", 15, raising=False)
    rng = random.Random(4)
    full = {d: {f"w{'x' * (k % 5)}{k}" for k in range(14) if rng.random() < 0.6} for d in range(70)}
    top = {d: set(sorted(own)[:6]) for d, own in full.items()}
    when = {d: rng.randrange(20) for d in full}
    pairs = lambda of: spark.createDataFrame([(d, w) for d, own in of.items() for w in own], "document_id long, keyword string")
    got = G.edges(pairs(full), pairs(top), spark.createDataFrame(list(when.items()), "document_id long, published_at int"))
    assert "CoGroupsInArrow" in plan_of(got)  # pairs used to meet in joins by keyword
    letters = lambda own: sum(map(len, own))
    want = []
    for a in full:
        for b in full:
            both = full[a] & top[b]
            if (when[b], b) < (when[a], a) and len(both) >= 3 and letters(both) / min(letters(full[a]), letters(top[b])) >= 0.8:
                want.append((min(a, b), max(a, b), len(both), letters(both) / min(letters(full[a]), letters(top[b]))))
    got = sorted(tuple(r) for r in got.collect())
    assert [x[:3] for x in got] == [x[:3] for x in sorted(want)] and want
    assert all(abs(x[3] - y[3]) < 1e-4 for x, y in zip(got, sorted(want), strict=True))


def test_minute_counts_join_no_state(spark, tmp_path):
    """Limits meet the requests below the counts, so that no batch of one row broadcasts what the state hands on."""
    from inkwell.streaming import jobs as J

    rows = [(u, f"2024-01-01 00:00:{s:02d}") for u in (1, 2, 3) for s in (0, 5, 7)]
    spark.createDataFrame(rows, "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) as ts").write.parquet(f"{tmp_path}/in")
    tiers = spark.createDataFrame([("open", -1), ("two", 2)], "tier string, per_minute int")
    users = spark.createDataFrame([(1, "two"), (1, "two"), (2, "open"), (3, "two"), (4, "two")], "user_id long, tier string")
    got = J.minute_counts(spark.read.parquet(f"{tmp_path}/in"), tiers, users).collect()
    assert sorted((r.user_id, r.n) for r in got) == [(1, 3)] * 6 + [(3, 3)] * 6
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")
    plan = J.minute_counts(stream, tiers, users)._jdf.queryExecution().analyzed().toString()
    assert plan.index("Aggregate [user_id") < plan.index("Join Inner")


@pytest.mark.parametrize(("group", "terms"), [(512, 1 << 15), (3, 5)])
def test_mean_idf_shuffles_no_counts(spark, monkeypatch, group, terms):
    """The mean idf over matched rows, also where groups of queries meet parts of the terms; queries times terms are not shuffled."""
    import math
    import random

    from pyspark.sql import functions as F

    from inkwell.operators import topk as K

    for name, value in (("GROUP", group), ("TERMS", terms), ("FEW", 4)):
        monkeypatch.setattr(K, name, value, raising=False)
    plans, together, means = [], K._together, K._means
    monkeypatch.setattr(K, "_together", lambda *a: plans.append(plan_of(got := together(*a))) or got)
    rng = random.Random(5)
    rows = {r: [f"t{int(rng.random() ** 2 * 30)}" for _ in range(8)] for r in range(60)}
    asked = {q: rng.sample([f"t{k}" for k in range(8)], 3) for q in range(10)}
    monkeypatch.setattr(K, "_means", lambda *a: found.append(got := means(*a)) or got)
    found = []
    index = K.packed(spark.createDataFrame(list(rows.items()), "row long, words array<string>").repartition(3), F.col("words"), ["row"])
    terms_ = spark.createDataFrame([(q, t) for q, own in asked.items() for t in own], "query_id long, term string")
    K.bm25_top(index, terms_, 5)
    assert not any("_counts" in p for p in [*plans, plan_of(found[0])])
    got, want = sorted(r._mean for r in found[0].collect()), []
    for own in asked.values():
        match = [set(w) for w in rows.values() if set(w) & set(own)]
        df = {t: sum(t in w for w in match) for t in set().union(*match)}
        idf = lambda d: math.log(len(match) - d + 0.5) - math.log(d + 0.5)  # noqa: E731, B023
        if min(idf(df.get(t, 0)) for t in own) < 0:
            want.append(sum(map(idf, df.values())) / len(df))
    assert want and len(got) == len(want) and all(abs(x - y) < 1e-9 for x, y in zip(got, sorted(want), strict=True))


def test_lookup_deals_keys_before_it_counts_them(spark):
    """Wanted keys repeat up to the joins, nothing is broadcast; keys that are null or repeat stay as they were."""
    from inkwell.operators import assembly as A

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (4, "e")], "id long, name string")
    wanted = spark.createDataFrame([(k,) for k in (1, 2, 2, 3, 3, 5, None, None)], "id long")
    there, missing = A.lookup(rows, wanted, "id")
    assert sorted(tuple(r) for r in there.collect()) == [(1, "a"), (2, "b"), (2, "c")]
    assert sorted(str(r.id) for r in missing.collect()) == ["3", "5", "None"]
    for df in (there, missing):
        plan = plan_of(df).split("== Initial Plan ==")[-1]
        below = plan[plan.index("SortMergeJoin") :]
        assert "Broadcast" not in plan and "HashAggregate" not in below  # distinct keys of a whole file filled a task


def test_keywords_shuffle_chunks_once(spark):
    """Keywords are counted behind one shuffle of chunks; a keyword that repeats in a chunk counts that chunk once."""
    from inkwell.operators import graph as G

    chunks = spark.createDataFrame([(1, 0, "Apple apple pear 12"), (1, 1, "pear and apple"), (1, 2, "42"), (2, 0, "plum plum"), (3, 0, None)], "document_id long, chunk_no int, content string")
    counts = G.keyword_counts(chunks)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 3, "apple", 3, 2), (1, 3, "pear", 2, 2), (2, 1, "plum", 2, 1)]
    top = G.top_keywords(counts, 1)
    plan = plan_of(top).split("== Physical Plan ==")[-1].split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1  # five before
    assert [(r.document_id, r.keyword, r.rank0) for r in sorted(top.collect())] == [(1, "apple", 0), (2, "plum", 0)]


def test_citations_make_only_wanted_runs(spark):
    """Runs of words are made in the lengths that citations have, also at the end of a text, and citations of every length are found."""
    from inkwell.operators import assembly as A

    chunks = spark.createDataFrame([(1, 0, "one two  three four five six seven"), (2, 0, "xone twox"), (3, 0, None), (4, 0, "five six seven")], "document_id long, chunk_no int, content string")
    items = [(1, "two three four five six seven"), (2, "five six seven"), (3, "one two"), (4, "e two three four fi"), (5, "six"), (6, "three two one"), (7, " ")]
    find = lambda own: A.citations(spark.createDataFrame(own, "item long, citation string"), chunks, "item", ["document_id", "chunk_no"])
    assert sorted((r.item, r.document_id) for r in find(items).collect()) == [(1, 1), (2, 1), (2, 4), (3, 1), (3, 2), (4, 1), (5, 1), (5, 4)]
    assert plan_of(find(items[:1])).split("== Physical Plan ==")[0].count("slice(_split") < plan_of(find(items)).split("== Physical Plan ==")[0].count("slice(_split")


@pytest.mark.parametrize("letters", [1 << 19, 6])
def test_texts_are_read_whole_for_wanted_texts(spark, monkeypatch, letters):
    """Wanted texts are found in one pass over texts, also where their blocks meet slots of rows; neither words nor their letters are shuffled."""
    from pyspark.sql import functions as F

    from inkwell.operators import search as S

    monkeypatch.setattr(S, "LETTERS", letters, raising=False)
    monkeypatch.setattr(S, "FOUND", 2, raising=False)
    texts = ["the cat sat", "a  cat", "concat the\tend", None, "", "日本語 the", "ananas", "the the the"]
    wanted = ["the", "the", "cat", "a  c", "he c", "\t", " ", "", None, "nan", "anana", "an", "本語 t", "e\te", "absent"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    items = spark.createDataFrame([(f"q{k}", w) for k, w in enumerate(wanted)], "q string, w string")
    got = S.rows_holding(rows, F.col("t"), items, ["id"], "q", F.col("w"))
    assert got.columns == ["q", "id"] and "Join" not in plan_of(got) and plan_of(got).split("== Physical Plan ==")[-1].count("Exchange") == 1
    assert sorted(map(tuple, got.collect())) == sorted((f"q{k}", i) for k, w in enumerate(wanted) for i, t in enumerate(texts) if w and w.strip() and w in (t or ""))


def test_heading_prediction_deals_lines_once(spark):
    """Titles, areas that touch, marks, gaps and depths against plain Python; lines are shuffled once, where each step shuffled them."""
    import random

    from test_structure import titles_by_hand

    from inkwell.operators import structure as U

    rng, docs, extra = random.Random(6), {}, {}
    for d in range(60):
        made = (lambda w: "#" * rng.randrange(1, 7) + f" {w}", lambda w: ".".join("123456"[: rng.randrange(2, 7)]) + f" {w}", lambda w: w, lambda w: f"{w}.", lambda w: "---", lambda w: " ", lambda w: "<!-- c -->", lambda w: f"（一）{w}", lambda w: f"## **{w}**", lambda w: f"A. {w}")
        docs[d] = [(n, rng.choice(made)(rng.choice(("alpha", "beta gamma", "delta", "one two three four five")))) for n in range(rng.randrange(1, 30))]
        areas = [(1, 0, 1), (2, 2, 3), (3, 8, 9)][: rng.randrange(4)]
        extra[d] = ([rng.choice(docs[d])[1] for _ in range(rng.randrange(3))], areas, {n for n, _ in docs[d] if rng.random() < 0.2})
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = U.predicted_titles(
        frame([(d, n, x) for d, own in docs.items() for n, x in own], "doc_id long, line_no int, line string"), frame([(d, t) for d, (own, _, _) in extra.items() for t in own], "doc_id long, title string"),
        frame([(d, *a) for d, (_, own, _) in extra.items() for a in own], "doc_id long, area int, first_line int, last_line int"), frame([(d, n) for d, (_, _, own) in extra.items() for n in own], "doc_id long, line_no int"), word_text=True,
    )
    plan = plan_of(got).split("== Physical Plan ==")[-1].split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 4  # lines, titles, and areas twice
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.line_no, r.title, r.level))
    for d, own in docs.items():
        assert sorted(found.get(d, [])) == titles_by_hand(own, *extra[d]), d
    assert sum(map(len, found.values())) > 200
