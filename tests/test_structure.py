"""Operators whose work SQL does not express: heading prediction, merging of gaps, evidence trees, contents anchors."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import assembly as A
from inkwell.operators import pages as P
from inkwell.operators import structure as U
from inkwell.operators import tables as B
from inkwell.operators.search import rows_holding, vector_top


@pytest.mark.parametrize(
    "line,level",
    [("1.2.3 Scope", 3), ("2.1 Terms", 2), ("## Title", 2), ("plain words", -1), ("1.2 Results were good.", -1), ("https://x.org/a", -1), ("2024 was a year", -1), ("第三章 总则", -2), ("(2) item", -2), ("### 1.1 both", 3), ("0.75 of all", -1)],
)
def test_heading_levels(spark, line, level):
    assert spark.createDataFrame([(line,)], "l string").select(T.heading_level(F.col("l")).alias("x")).first().x == level


def test_heading_evidence(spark):
    rows = spark.createDataFrame([("1.2.3 Scope",), ("一、总则",), ("（三）x",), ("Appendix B",), ("nothing",), (None,)], "l string")
    got = [r.x for r in rows.select(T.heading_evidence(F.col("l")).alias("x")).collect()]
    assert max(got[0]) == 3 and all(max(g) == 1 for g in got[1:4]) and max(got[4]) == 0 and max(got[5]) == 0


def test_predicted_titles(spark):
    lines = ["Cover", "1.1 Zeroth", "# First", "text of it goes on and on here", "## 1.1 Part", "more text here", "## 1.2 Part", "even more", "# Second", "## alone", "end"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id int, line_no int, line string")
    titles = spark.createDataFrame([(1, "1.1 First ..... 3")], "doc_id int, title string")
    got = sorted((r.line_no, r.title, r.level) for r in U.predicted_titles(rows, titles).collect())
    assert got == [(2, "First", 1), (4, "1.1 Part", 2), (6, "1.2 Part", 2), (8, "Second", 1)]


def gaps_by_hand(items, few=3):
    """Each heading with the next one of any kind, one after the other."""
    count = lambda t: len(t.split())
    heads = [n for n, x in enumerate(items) if x[1] > 0]
    gone, out = set(), dict(enumerate(items))
    for k, n in zip(heads, heads[1:]):
        title, level, reason = items[k]
        own = items[k + 1 : n]
        between = sum(count(x[0]) for x in own)
        if own and items[n][1:] == (level, reason) and (between <= few or between < count(title) // 2):
            gone |= set(range(k + 1, n))
            more = "\n".join(x[0].strip() for x in own if x[0].strip())
            out[k] = (f"{title.strip()} {more}" if more else title, level, reason)
    return [x for n, x in out.items() if n not in gone]


@pytest.mark.parametrize("seed", range(3))
def test_merged_gaps(spark, seed):
    rng = random.Random(seed)
    docs = {d: [(" ".join(rng.choice(("ab", "cd")) for _ in range(rng.randrange(1, 6))), rng.choice((-1, -1, 1, 1, 2)), rng.choice("xy")) for _ in range(30)] for d in range(3)}
    rows = spark.createDataFrame([(d, k, *x) for d, items in docs.items() for k, x in enumerate(items)], "doc_id int, line_no int, title string, level int, reason string")
    got = {}
    for r in U.merged_gaps(rows).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append((r.title, r.level, r.reason))
    assert got == {d: gaps_by_hand(items) for d, items in docs.items()}


def test_media_in_texts(spark):
    rows = spark.createDataFrame([("see [images/a.png] here", [("[images/a.png]", "A"), ("[tables/b]", "B")]), ("none", [])], "content string, media array<struct<ref:string,text:string>>")
    assert [r.content for r in A.with_media(rows).collect()] == ["see A here\nB", "none"]


def test_contents_anchors(spark):
    texts = ["Table of Contents\n1 a", "body", "CONTENTS", "contents of a box", "目 录\nx", "body"]
    pages = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)] + [(2, k, "Contents\nx") for k in range(10)], "doc_id int, page int, text string")
    assert sorted((r.doc_id, r.page) for r in P.toc_anchors(pages, ["doc_id"]).collect()) == [(1, 0), (1, 2), (1, 4)]


def test_labelled_areas(spark):
    blocks = spark.createDataFrame([(1, 0, "text", "a"), (1, 1, "TOC", "x\n\ny"), (1, 2, "toc", "z"), (1, 3, None, "b"), (1, 4, "toc", " ")], "doc_id int, block_no int, label string, text string")
    assert sorted((r.area, r.block_no, r.entry) for r in U.labelled_areas(blocks).collect()) == [(1, 1, "x"), (1, 1, "y"), (1, 2, "z")]


def test_header_grid_and_records(spark):
    cells = spark.createDataFrame([(1, 0, 0, "A", 2, 1), (1, 0, 1, "B", 1, 2), (1, 1, 0, "b1", 1, 1), (1, 1, 1, "b1", 1, 1)], "t int, row int, col int, value string, rowspan int, colspan int")
    assert [(r.col, r.header) for r in B.header_grid(cells, ["t"]).orderBy("col").collect()] == [(0, "A"), (1, "B > b1"), (2, "B > b1>>>1")]


@pytest.mark.parametrize("block,slot", [(512, 65536), (3, 7)])
def test_vectors_by_blocks(spark, block, slot):
    rng = random.Random(5)
    vectors = [(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(60)] + [(60, [0.0] * 4), (61, [1.0, 0.0, 0.0, 0.0]), (62, [2.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 10 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in vector_top(df, asked, 5, block=block, slot=slot).orderBy("query_id", "rank0").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    for q, own in got.items():
        v = dict(vectors)[q]
        want = sorted(((round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 6), k) for k, w in vectors), key=lambda x: (-x[0], x[1]))[:5]
        assert [k for k, _ in own] == [k for _, k in want] and all(abs(s - x) < 1e-6 for (_, s), (x, _) in zip(own, want))


def test_rows_holding(spark):
    rng = random.Random(2)
    texts = [(k, " ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(6)))) for k in range(80)] + [(99, None)]
    asked = [(k, rng.choice(["a", "ab", "b a", "c  a", "abc ab", "", " ", "cab", "bc b"])) for k in range(30)]
    rows, items = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(asked, "q int, w string")
    got = sorted((r.q, r.id) for r in rows_holding(rows, T.text_or_empty(F.col("t")), items, ["id"], "q", F.col("w")).collect())
    assert got == sorted((q, k) for q, w in asked for k, t in texts if w.strip() and w in (t or ""))


def test_entry_levels(spark):
    rows = [(1, 1, 0, "1.2 A", None, None, 0), (1, 1, 1, "1.2.3 B", None, 1, 0), (1, 1, 2, "x", 4, 1, 0), (1, 1, 3, "plain", None, None, 8), (1, 1, 4, "other", None, None, 2), (1, 1, 5, "gone", 0, None, 0), (1, 2, 6, "plain", None, None, 8), (1, 2, 7, "Contents", None, None, 9)]
    got = U.entry_levels(spark.createDataFrame(rows, "doc_id int, area int, block_no int, entry string, explicit_level int, outline_level int, indent int"))
    assert {r.block_no: r.level for r in got.collect()} == {0: 2, 1: 1, 2: 4, 3: 2, 4: 1, 6: 1, 7: 2}


def test_merged_gaps_of_one_long_document(spark):
    """A hundred thousand lines in one document take seconds."""
    import time

    rows = spark.range(100_000).selectExpr("1 doc_id", "cast(id as int) line_no", "if(id % 3 = 0, concat('heading number ', id), 'x') title", "if(id % 3 = 0, 1, -1) level", "'r' reason")
    began = time.perf_counter()
    got = U.merged_gaps(rows)
    assert got.count() == 33334 + (100_000 - 1) % 3 and time.perf_counter() - began < 10
    assert got.filter("title like '% x\nx'").count() == 33333


def titles_by_hand(lines, titles, areas, marks):
    """Plain Python: the same steps, line by line, for the decorated lines of the registered query."""
    import re
    import unicodedata

    trim = lambda t: t.strip(" ")
    folded = lambda t: "".join(unicodedata.normalize("NFKC", c) if "\uff01" <= c <= "\uff5e" or c == "\u3000" else c for c in t)
    tokens = lambda t: len(re.findall(r"[\u4e00-\u9fff]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?", t))

    def evidence(t):
        head = folded(t)[:20]
        out = []
        for p in T.HEADING_PATTERNS:
            m = re.search(p.replace("(?i:appendix)", "[Aa][Pp][Pp][Ee][Nn][Dd][Ii][Xx]"), head, re.A)
            out.append(sum(c in ".-" for c in m.group(0)) + 1 if m else 0)
        return out

    def against(t):
        cjk = len(re.findall(r"[\u4e00-\u9fff]", t))
        zh = tokens(t) > 0 and cjk / max(tokens(t), 1) >= 0.3
        return [int(bool(re.search(p, t, re.A))) for p in T.BODY_PATTERNS] + [int(bool(re.search(r"[.,;，。；]$", t))), int(tokens(t) > (30 if zh else 10))]

    rows = []
    for n, line in lines:
        bare = trim(line)
        if not bare:
            continue
        if ("<!--" in bare and "-->" in bare) or bare.startswith(("|", "<table>")) or ("![" in bare and "](" in bare):
            rows.append([n, "Figure/Image", -1, "Figure/Image"])
            continue
        m = re.match(r"^\s*(#+)\s*(.*)$", bare)
        marker, title = (len(m.group(1)), trim(m.group(2))) if m else (-1, bare)
        title = trim(re.sub(r"^\s*(\*\*|__)(.+?)\1\s*$", r"\2", title))
        pos, neg = evidence(title), against(title)
        depth = max(pos)
        level = -1 if max(neg) and marker < 0 else max(marker, depth if depth > 1 else -2)
        rows.append([n, title, (1 if depth else -1) if level <= 0 and not (max(neg) and marker < 0) else level, f"{pos} {neg}"])
    clean = lambda t: re.sub("^(?:" + "|".join(T.LEADING_NUMBERS) + ")", "", trim(re.sub(T.PAGE_SUFFIX, "", t)), flags=re.I).strip(" ")
    normal = lambda t: trim(re.sub(r"\s+", " ", folded(clean(t)))).lower()
    heading = lambda line: trim(re.sub(r"^\s*#+\s*", "", line)) if re.match(r"^\s*#+", line) else line
    wanted = {t for t in (normal(heading(t)) for t in titles) if len(t) >= 2}
    start = min((n for n, line in lines if normal(heading(line)) in wanted), default=None)
    if start is not None:
        for r in rows:
            r[2] = -1 if r[0] < start else r[2]
    parts = {0: rows}
    if len(areas) > 1:
        gone, zones, ordered = 0, [], sorted(areas, key=lambda a: a[1])
        total = max(n for n, _ in lines) + 1 + sum(z - a + 1 for _, a, z in areas)
        for k, (name, first, last) in enumerate(ordered):
            gone += last - first + 1
            end = ordered[k + 1][1] - 1 if k + 1 < len(ordered) else total - 1
            zones.append((last + 1 - gone, end - gone, name))
        parts = {}
        for r in rows:
            before = [z for z in zones if z[0] <= r[0]]
            if before and r[0] <= before[-1][1]:
                parts.setdefault(before[-1][2], []).append(r)
    merged = []
    for own in parts.values():
        joined = []
        for r in own:
            last = joined[-1] if joined else None
            if last and r[2] <= 0 and last[2] <= 0 and last[4] == r[0] - 1 and not re.search(r"[.!?。！？；;:：]\s*$", last[5]):
                last[1] += " " + r[1]
                last[4], last[5] = r[0], r[1]
            else:
                joined.append([*r, r[0], r[1]])
        heads = [k for k, r in enumerate(joined) if r[2] > 0]
        drop = set()
        for a, b in zip(heads, heads[1:]):
            between = sum(tokens(trim(r[1])) for r in joined[a + 1 : b])
            if b > a + 1 and joined[a][2:4] == joined[b][2:4] and (between <= 3 or between < tokens(trim(joined[a][1])) // 2):
                drop |= set(range(a + 1, b))
                more = "\n".join(trim(r[1]) for r in joined[a + 1 : b] if trim(r[1]))
                joined[a][1] = trim(joined[a][1]) + " " + more if more else joined[a][1]
        merged += [r[:3] for k, r in enumerate(joined) if k not in drop]
    merged.sort(key=lambda r: r[0])
    last, more = None, {}
    for r in merged:
        # the run is that of the levels before marks are applied
        if r[2] > 0:
            last = r
        if r[0] in marks and last is not None:
            more.setdefault(id(last), []).append(r[1])
    for r in merged:
        if r[2] > 0 and id(r) in more:
            r[1] = " ".join([r[1], *more[id(r)]])
    for r in merged:
        if r[0] in marks:
            r[2] = -1
    heads, parent = [r for r in merged if r[2] > 0], {}
    for k, r in enumerate(heads):
        parent[k] = next((j for j in range(k - 1, -1, -1) if heads[j][2] < r[2]), None)
    kids = {k: [j for j in parent if parent[j] == k] for k in range(len(heads))}
    kept = [k for k in range(len(heads)) if not (parent[k] is not None and not kids[k] and len(kids[parent[k]]) == 1)]
    depth = {}
    for k in kept:
        depth[k] = depth.get(parent[k], 0) + 1
    return sorted((heads[k][0], heads[k][1], min(depth[k], 6)) for k in kept)


def test_predicted_headings_by_hand(spark, sf):
    """The registered query over all documents against plain Python, every step included."""
    from inkwell.plans.all_queries import QUERIES
    from inkwell.plans.feature_queries import decorated_lines

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines, got = {}, {}
    for r in decorated_lines(docs).orderBy("doc_id", "line_no").collect():
        lines.setdefault(r.doc_id, []).append((r.line_no, r.line))
    for r in QUERIES["predicted_headings"](spark, sf).collect():
        got.setdefault(r.doc_id, []).append((r.line_no, r.title, r.level))
    n = 0
    for d, own in lines.items():
        areas = [(1, 0, 1), (2, 6, 7)] if d % 3 == 0 and max(k for k, _ in own) >= 12 else []
        titles = [x for k, x in own if k == 5] if d % 4 == 1 else []
        marks = {k for k, _ in own if k % 7 == 3} if d % 5 == 2 else set()
        want = titles_by_hand(own, titles, areas, marks)
        assert sorted(got.get(d, [])) == want, d
        n += len(want)
    assert n > 100


def test_nested_tables_by_hand(spark):
    html = [
        (1, "<table><tr><td>outer<table><tr><td>inner</td></tr></table>after</td></tr></table>"),
        (2, "</td></table>x<table><tr><th colspan=2>a</th></tr>loose<tr><td>b<table><tr><td>c<table><tr><td>d</td></tr></table></td><td>e</td></tr></table>f<table><tr><td>g</td></tr></table>h</td></tr></table><table><tr><td>i"),
        (3, None), (4, "<p>none</p>"), (5, "<table></table><table><td>no row</td></table>"),
    ]
    got = {}
    for r in B.html_tables(spark.createDataFrame(html, "page_id int, html string"), "page_id").collect():
        got.setdefault(r.page_id, set()).add((r.table_no, r.depth, r.row, r.col, r.value, (r.parent_table, r.parent_row, r.parent_col)))
    none = (None, None, None)
    assert got == {
        1: {(0, 1, 0, 0, "outer after", none), (1, 2, 0, 0, "inner", (0, 0, 0))},
        2: {(0, 1, 0, 0, "a", none), (0, 1, 1, 0, "b f h", none), (1, 2, 0, 0, "c", (0, 1, 0)), (1, 2, 0, 1, "e", (0, 1, 0)), (2, 3, 0, 0, "d", (1, 0, 0)), (3, 2, 0, 0, "g", (0, 1, 0)), (4, 1, 0, 0, "i", none)},
        5: {(1, 1, 0, 0, "no row", none)},
    }


def test_repositories_unfold_to_their_tables(spark, sf):
    from inkwell.operators import graph as G
    from inkwell.plans.feature_queries import canonical_tables

    files, symbols, chunks, links, refs = canonical_tables(spark, sf)
    flat = G.flat_entities(G.rebuilt(files, symbols, chunks, links, refs))
    rows = lambda d: sorted(map(str, (tuple(r[c] for c in sorted(d.columns)) for r in d.collect())))
    there = links.join(files.select("id").unionByName(symbols.select("id")).unionByName(chunks.select("id")).withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    for name, want in (("symbols", symbols), ("chunks", chunks), ("relationships", there), ("references", refs)):
        own = want.join(files.select(F.col("id").alias("f")), want[want.columns[0] if name != "relationships" else "source_id"] == F.col("f"), "left_semi") if name in ("symbols", "chunks", "references") else want
        assert rows(flat[name].select(*sorted(own.columns))) == rows(own.select(*sorted(own.columns))), name
