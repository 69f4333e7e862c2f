"""Small tables on which findings of the fourth round showed."""

import random

import pytest


def plan_of(df):
    return df._jdf.queryExecution().toString()


def letters(own):
    return sum(map(len, own))


@pytest.mark.parametrize(("pack", "often", "kind"), [(8192, 2048, "long"), (9, 4, "long"), (9, 0, "string")])
def test_edges_shuffle_no_pairs(spark, monkeypatch, pack, often, kind):
    """Edges and degrees equal those of all pairs, whatever the packs; neither postings nor edges are joined or dealt by keyword or block."""
    from inkwell.operators import graph as G

    for name, value in (("PACK", pack), ("OFTEN", often), ("EDGES", 7)):
        monkeypatch.setattr(G, name, value, raising=False)
    rng = random.Random(4)
    long = "x" * 140
    full = {d: {f"{long if k > 11 else 'x' * (k % 5)}{k}" for k in range(14) if rng.random() < 0.6} for d in range(70)}
    top = {d: sorted(own, key=lambda w: (-len(w) * (d % 3), w))[:6] for d, own in full.items()}
    when = {d: rng.randrange(20) for d in full}
    name = (lambda d: d) if kind == "long" else (lambda d: f"d{d:02d}")
    rows = [(name(d), when[d], letters(own), sorted(own), top[d]) for d, own in full.items()]
    rows += [rows[3]]  # a document that comes twice has its edges twice
    sets = spark.createDataFrame(rows, f"document_id {kind}, _p int, _letters long, _own array<string>, _top array<string>").repartition(3)
    got = G.set_edges(sets)
    assert "CoGroup" not in plan_of(got) and "CartesianProduct" in plan_of(got)
    want = []
    for a, when_a, size, own, _ in rows:
        for b, when_b, _, _, best in rows:
            both = set(own) & set(best)
            least = min(size, letters(best))
            if (when_b, b) < (when_a, a) and len(both) >= 3 and letters(both) / least >= 0.8:
                want.append((min(a, b), max(a, b), len(both), (20000 * letters(both) + least) // (2 * least) / 10000))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 100
    nodes = {}
    for a, b, _, w in want:
        for x, y in ((a, b), (b, a)):
            n, sum_, least = nodes.get(x, (0, 0, y))
            nodes[x] = (n + 1, round(sum_ + w, 4), min(least, y))
    assert {r.node: (r.degree, r.weight, r.least_neighbour) for r in G.set_degrees(sets).collect()} == nodes


def test_keyword_sets_stay_where_documents_are(spark):
    """Sets equal those of counts that are dealt by document, also for keys that repeat or are null; texts of other documents are not shuffled."""
    from pyspark.sql import functions as F

    from inkwell.operators import graph as G
    from inkwell.operators.chunking import packed_lines

    rng = random.Random(8)
    words = [f"w{k}x" for k in range(40)] + ["the", "12", "Ünï"]
    text = lambda n: "\n".join(" ".join(rng.choices(words, k=60)) for _ in range(n))
    rows = [(k, text(k % 20)) for k in range(50)] + [(60, None), (61, "a 1"), (None, text(2))]

    def check(own):
        docs = spark.createDataFrame(own, "doc_id long, text string").repartition(4)
        got = G.keyword_sets(docs, 5)
        counts = G.keyword_counts(packed_lines(docs.filter("doc_id is not null")).withColumnRenamed("doc_id", "document_id"))
        full = {r.document_id: sorted(r.w) for r in counts.groupBy("document_id").agg(F.collect_list("keyword").alias("w")).collect()}
        top = {}
        for r in sorted(G.top_keywords(counts, 5).collect(), key=lambda r: r.rank0):
            top.setdefault(r.document_id, []).append(r.keyword)
        found = sorted((r.document_id, sorted(r._own), list(r._top), r._letters) for r in got.collect() if r._own)
        copies = {d: sum(x == d for x, _ in own) for d in full}
        assert found == sorted((d, w, top[d], letters(w)) for d, w in full.items() for _ in range(copies[d]))
        return got

    assert "Exchange hashpartitioning" not in plan_of(check(rows)).split("== Physical Plan ==")[-1]
    check(rows + rows[5:9] + [(7, text(3))])


def small_corpus(spark, seed, n=60):
    rng = random.Random(seed)
    words = [f"w{int(rng.random() ** 3 * 40)}x" for _ in range(4000)]
    rows = [(k // 3, k % 3, " ".join(rng.sample(words, rng.randrange(1, 30)))) for k in range(n)] + [(900, 0, None), (901, 0, "")]
    rows += [(902 + k, 0, "w1x w2x w3x") for k in range(5)]  # equal scores: keys decide
    asked = [(q, " ".join(rng.sample(words, rng.randrange(1, 6)))) for q in range(25)] + [(100, "w1x w2x"), (101, "the"), (102, None), (103, "1x w2"), (104, "W1X  w2x")]
    return spark.createDataFrame(rows, "document_id int, chunk_no int, content string").repartition(3), spark.createDataFrame(asked, "query_id int, query string"), rows


def ranked(df):
    return sorted((r.query_id, r.rank0, r.document_id, r.chunk_no, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"ROWS": 16, "QUERIES": 4, "READERS": 4, "GROUP": 3, "PART": 40, "FEW": 1, "MEET": 2, "COUNTS": 9, "HITS": 500, "READ": 3}])
def test_searches_meet_blocks_without_a_shuffle(spark, monkeypatch, sizes):
    """BM25 and substring search equal the scores of all rows, whatever the blocks; no posting or text is dealt by a key."""
    from pyspark.sql import functions as F

    from inkwell.functions import text as T
    from inkwell.operators import search as S
    from inkwell.operators import topk as K

    for name, value in sizes.items():
        monkeypatch.setattr(K, name, value, raising=False)
    plans, keep = [], K.written
    monkeypatch.setattr(K, "written", lambda df, *a, **kw: plans.append(plan_of(df)) or keep(df, *a, **kw))
    keys = ["document_id", "chunk_no"]
    chunks, queries, _ = small_corpus(spark, 3)
    terms = S.query_terms(queries)
    want = S.top_rows(S.bm25(S.postings(chunks, F.col("content"), keys), terms, keys).withColumn("score", F.round("score", 9)), 7, keys)
    assert ranked(K.bm25_top(K.packed(chunks, T.tokens(F.col("content")), keys), terms, 7)) == ranked(want)
    want = S.top_rows(S.term_hits(chunks, F.col("content"), queries, keys), 7, keys)
    assert ranked(K.term_top(chunks, F.col("content"), queries, keys, 7)) == ranked(want)
    assert sum("CartesianProduct" in p for p in plans) >= 3 and not any("CoGroups" in p for p in plans)
    for plan in plans:
        assert "hashpartitioning(document_id" not in plan and "hashpartitioning(term" not in plan


def test_sums_of_part_by_hand():
    """Terms of one row, of few, of more than 255 and of nearly all rows count alike."""
    import numpy as np

    from inkwell.operators import topk as K

    rng = np.random.default_rng(2)
    rows, width = 900, 5
    hit = (rng.random((rows, width)) < [0.9, 0.5, 0.02, 1, 0]).astype(np.uint8)
    total = np.array(sorted([*rng.integers(1, 12, 300), 30, 200, 254, 255, 256, 511, 700, 900, *[1] * 50], reverse=True))
    of = [np.sort(rng.choice(rows, k, replace=False)) for k in total]
    n = hit.sum(0).astype(np.int64)
    for counts in (K.COUNTS, 10):
        K.COUNTS, kept = counts, K.COUNTS
        sums, terms = K._sums_of_part(hit, n, total, np.concatenate(of))
        K.COUNTS = kept
        for q in range(width):
            df = [x for x in (int(hit[at, q].sum()) for at in of) if x]
            assert terms[q] == len(df) and abs(sums[q] - sum(np.log(n[q] - x + 0.5) - np.log(x + 0.5) for x in df)) < 1e-8


def test_chunks_are_named_in_their_row(spark):
    """A document's chunks need no shuffle; documents that share an id count together and stand for each, one without an id has none."""
    from inkwell.operators.chunking import chunk_table

    line = "x" * 900
    rows = [(k, "\n".join([line] * (k % 7)), "en", f"s{k}") for k in range(30)] + [(None, line, "en", "s")]
    frame = lambda own: spark.createDataFrame(own, "doc_id long, text string, lang string, source string").repartition(4)
    got = chunk_table(frame(rows))
    assert "Exchange hashpartitioning" not in plan_of(got).split("== Physical Plan ==")[-1]
    rest = sorted((r.document_id, r.chunk_no, r.section_path, r.path, r.user_id) for r in got.collect())
    assert {x[0] for x in rest} == {k for k in range(30) if k % 7} and (2, 0, "Root", "doc_2.txt", "s2") in rest
    assert [x[1:4] for x in rest if x[0] == 3] == [(0, "part 1", "doc_3.txt/part 1"), (1, "part 2", "doc_3.txt/part 2")]
    again = sorted((r.document_id, r.chunk_no, r.section_path, r.path, r.user_id) for r in chunk_table(frame([*rows, (1, line, "fr", "t")])).collect())
    assert [x for x in again if x[0] != 1] == [x for x in rest if x[0] != 1]
    assert [x[1:] for x in again if x[0] == 1] == sorted((0, "part 1", "doc_1.txt/part 1", s) for s in ("s1", "s1", "t", "t"))
