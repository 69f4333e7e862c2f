import random
import time

import pytest

from inkwell.llm import page_diff
from inkwell.llm.page_diff import extract_pages


def page(outside, article=("body",)):
    inner = "".join(f"<p>{a}</p>" for a in article)
    return f"<body><div><p>Site motto</p></div><article>{inner}</article><div><p>{outside}</p></div></body>"


def texts(spark, rows):
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract_pages(docs).collect()}


def test_differencing_decides_with_an_article(spark):
    rows = [(k, f"http://h.org/{k}", page(f"only {k}", ["A quote", f"body {k}"])) for k in range(1, 6)]
    assert texts(spark, rows) == {k: f"A quote\nbody {k}\nonly {k}" for k in range(1, 6)}
    alone = texts(spark, [(1, "http://a.org/x", page("more")), (2, "http://b.org/x", page("other"))])
    assert alone == {1: "Site motto\nbody\nmore", 2: "Site motto\nbody\nother"}


def test_copies_are_not_differenced_away(spark):
    rows = [(k, f"http://h.org/a?x={k}", "<body><p>Menu</p><p>same words</p></body>") for k in range(3)] + [(9, "http://h.org/b", "<body><p>Menu</p><p>other words</p></body>")]
    assert texts(spark, rows) == {0: "same words", 1: "same words", 2: "same words", 9: "other words"}


def test_neighbours_over_ranges(spark, monkeypatch):
    """Every page is compared with both neighbours, wherever ranges end."""
    rows = [(k, f"http://h.org/{k:03}", f"<body><p>left {k // 2}</p><p>right {(k + 1) // 2}</p><p>own {k}</p></body>") for k in range(60)]
    want = {k: f"own {k}" for k in range(1, 59)}
    for ranges in (1, 7, 4096):
        monkeypatch.setattr(page_diff, "RANGES", ranges)
        monkeypatch.setattr(page_diff, "SPREAD", ranges)
        got = texts(spark, rows)
        assert len(got) == 60 and {k: got[k] for k in want} == want


def longest(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("table", [page_diff.TABLE, 20])
def test_longest_common_subsequence(monkeypatch, table):
    """Against the plain table, repeated lines included; with the small limit long alignments are halved."""
    monkeypatch.setattr(page_diff, "TABLE", table)
    rng = random.Random(table)
    assert len(page_diff.common_lines(list("yx"), list("xyx"))) == 2
    for _ in range(500):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(14))] for _ in range(2))
        pairs = page_diff.common_lines(a, b)
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a "' * 200_000 + "'>", "<!-- " * 200_000, "<![CDATA[" * 100_000, "<p " * 300_000, "<div>" * 100_000 + "</b>" * 100_000, "<a<a" * 200_000 + " '", "<head>" * 150_000])
def test_broken_pages_take_linear_time(page):
    began = time.perf_counter()
    page_diff.blocks(page)
    assert time.perf_counter() - began < 10


def test_unclosed_quotes_are_text():
    assert page_diff.blocks('a <b "x> c') == [('a <b "x> c', 1)] and page_diff.blocks("a <b 'x>'> c") == [("a c", 1)]
