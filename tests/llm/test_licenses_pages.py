from inkwell.llm.licenses import KNOWN, scan_licenses
from inkwell.llm.page_diff import blocks, common_lines, extract_pages


def test_licences(spark):
    mit = KNOWN[0][1]
    rows = [
        (1, mit, "x"), (2, "The MIT License (MIT)\n\nCopyright (c) 2020 Jane Doe\n\n" + mit.upper().replace(",", " ,"), "x"), (3, "hello\nReleased under the MIT licence.\nbye", "x"), (4, "Licensed under the Apache License, Version 2.0.", "x"),
        (5, None, "x"), (6, "", "x"), (7, "Copyright 2020 Me. All rights reserved.", "x"), (8, mit + " and more", "x"), (None, mit, "x"), (9, "Released under the MIT License.\n" * 2, "x"), (9, "Released under the MIT License.\n" * 2, "x"), (10, "word " * 40000, "x"),
    ]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license_id string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.license_id) for r in got} == {(1, "MIT"), (2, "MIT"), (3, None), (4, "Apache-2.0"), (5, None), (6, None), (7, None), (8, None), (None, "MIT"), (9, None), (10, None)}
    assert {r.doc_id: (r.notice_ids, r.n_notices) for r in got if r.n_notices and r.doc_id in (3, 4, 9)} == {3: (["MIT"], 1), 4: (["Apache-2.0"], 1), 9: (["MIT"], 2)}
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article class="post"><header><h1>Head &amp; more</h1></header><p>One <b>bold</b>,
two&nbsp;three.<br>four<p>Unclosed<ul><li>x<li>y</ul><form><input value="q"><button>Go</button></form><div class="comments"><p>First!</p></div><p>Last &lt;tag&gt;</p></article>
<aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_blocks():
    assert [t for t, place in blocks(PAGE) if place == 2] == ["Head & more", "One bold, two three. four", "Unclosed", "x", "y", "Last <tag>"]
    assert [t for t, place in blocks(PAGE) if place == 1] == []
    assert blocks(None) == [] and blocks("<p>a<!-- b <p>c") == [("a", 1)] and blocks("plain") == [("plain", 1)]
    assert [t for t, p in blocks('<div class="menu">open <article><p>body</p></article>') if p == 2] == ["body"]


def test_names_inside_an_article():
    """Only whole class and id names frame there; elements and roles do as everywhere."""
    body = '<section class="notice-period"><p>Notice period is three months.</p></section><div id="social-policy">Policy</div><div class="x comments">First!</div><div role="alert">Alert</div><div class="ad">Buy</div><p class="promotion-rules">Rules</p>'
    assert blocks(f"<article>{body}</article>") == [("Notice period is three months.", 2), ("Policy", 2), ("First!", 0), ("Alert", 0), ("Buy", 0), ("Rules", 2)]
    assert [p for _, p in blocks('<div class="cookie-notice">a</div><div class="site-nav">b</div><div>c</div>')] == [0, 0, 1]


def test_common_lines():
    assert common_lines(list("abcd"), list("xbyd")) == [(1, 1), (3, 3)]
    assert common_lines(["a", "a", "b"], ["a", "b", "a"]) in ([(0, 0), (2, 1)], [(0, 0), (1, 2)])
    assert common_lines([], ["a"]) == []


def test_pages(spark):
    plain = lambda *body: "<body><p>Menu here</p>" + "".join(f"<p>{b}</p>" for b in body) + "<p>All rights</p></body>"
    rows = [(1, "http://h.org/a/1", plain("one")), (2, "http://h.org/a/2?x=1", plain("two")), (3, "http://www.other.org/a", plain("three")), (4, None, plain("four")), (5, "http://h.org/p", PAGE), (None, "", None), (6, "http://h.org/p", PAGE), (7, "http://z.org/", "<article>" + "long " * 60000 + "</article>")]
    docs = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string").coalesce(1)
    got = {r.page_id: r for r in extract_pages(docs).collect()}
    assert got[1].text == "one" and got[2].text == "two" and got[3].text == "Menu here\nthree\nAll rights" and got[4].text == "Menu here\nfour\nAll rights"
    assert got[5].text == got[6].text and got[5].text.startswith("Head & more\nOne bold") and got[None].text == "" and got[None].n_chars == 0
    assert len(got[7].text) == got[7].n_chars == 60000 * 5 - 1 and extract_pages(docs.limit(0)).count() == 0
