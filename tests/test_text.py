"""Text functions against hand-computed rows."""

import uuid

import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators import sections as N


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    schema = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([values], schema).select(column(*map(F.col, names)).alias("out")).first().out


@pytest.mark.parametrize("text, n", [("alpha contract", 2), ("施工方案", 4), ("a1.5b 施", 4), (None, 0), ("", 0), ("...", 0)])
def test_token_count(spark, text, n):
    assert one(spark, T.token_count, text) == n


@pytest.mark.parametrize("text, n", [("alpha contract", 5), ("施工方案", 2), ("", 0), (None, 0), ("a", 1)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.token_estimate, text) == n


def test_tokens(spark):
    assert one(spark, T.tokens, "The CAT, a [images/x.png] sat-on 42 ünder image-3 施工方案") == ["the", "cat", "sat", "on", "42", "ünder", "施工", "工方", "方案"]
    assert one(spark, lambda c: T.tokens(c, ("the",), distinct=True), "the cat the cat") == ["cat"]
    assert one(spark, T.tokens, None) == []


def test_ids(spark):
    assert one(spark, T.uuid5, "alpha contract") == "e8dd4f70-46ff-52e0-b3f5-0a2eb4d98294" == str(uuid.uuid5(uuid.NAMESPACE_DNS, "alpha contract"))
    assert one(spark, T.uuid5, "é施") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "é施"))
    assert one(spark, lambda a, b: T.canonical_id(a, b), "https://example.org/r", None) == one(spark, lambda a: F.sha2(F.concat(a, F.lit("|")), 256), "https://example.org/r")


@pytest.mark.parametrize(
    "path, file, section",
    [
        ("report.pdf-->Intro-->Subsection", "report.pdf", "Intro / Subsection"), ("report.pdf/Inputs --> Outputs/Details", "report.pdf", "Inputs --> Outputs / Details"), ("report.pdf/Inputs --> Outputs", "report.pdf", "Inputs --> Outputs"),
        ("report.pdf/input.csv-->output/Details", "report.pdf", "input.csv-->output / Details"), ("report.pdf/appendix.pdf/Details", "report.pdf", "appendix.pdf / Details"), ("images/photo.png", None, "Root"), ("tables/table.html", None, "Root"), (None, None, "Root"),
    ],
)
def test_path_split(spark, path, file, section):
    got = one(spark, N.split_path, path, file)
    assert got.section == section


def test_refs(spark):
    text = "see [images/a.png] and [tables/t.html] and [images/a.png]"
    assert one(spark, T.chunk_refs, text) == ["[images/a.png]", "[tables/t.html]"]
    assert [(r.ref, r.start, r.end) for r in one(spark, T.chunk_ref_spans, text)] == [("[images/a.png]", 4, 18), ("[tables/t.html]", 23, 38), ("[images/a.png]", 43, 57)]
    assert one(spark, T.without_refs, "a\nimage: [images/a.png]\nb") == "a\n\nb"


def test_headings(spark):
    assert tuple(one(spark, T.markdown_heading, "## Two words")) == ("Two words", 2) and tuple(one(spark, T.markdown_heading, "plain")) == ("plain", -1)
    assert one(spark, T.heading_level, "# Top") == 1 and one(spark, T.heading_level, "1.2.3 Scope") == 3 and one(spark, T.heading_level, "This sentence ends with a stop and has many more than ten words.") == -1
    assert max(one(spark, T.heading_evidence, "第三章 总则")) == 1 and one(spark, T.body_evidence, "2024 was good")[0] == 1
    assert one(spark, T.toc_title, "1.2 Scope of work .... 17") == "Scope of work"


def test_previews(spark):
    words = " ".join(f"w{'x' * (k % 3)}" for k in range(400))
    got = one(spark, lambda c: T.preview(c, 3, 2), words)
    assert got == "w wx wxx...wxx w" and one(spark, lambda c: T.preview(c, 3, 2), "a b c") == "a b c"
    assert one(spark, lambda c: T.truncated(c, 2), "one, two, three") == "one, two"


def test_locations(spark):
    assert one(spark, T.location_text, 1, 2, 3, 4) == "1:2-3:4"
    assert one(spark, T.location_parts, "3:1-2:9").valid is False and one(spark, T.location_parts, "1:1-1:1").valid is True and one(spark, T.location_parts, "x").valid is False
