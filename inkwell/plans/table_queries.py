"""Text functions, routing, tables as cells, and loosely typed records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as R
from ..functions import text as T
from ..operators import tables as B
from ..operators.chunking import lines_of
from ..sources import scans as X
from .content_queries import LINES, STOP
from .registry import query, table
from .search_queries import tokens_sql

# --- text functions ----------------------------------------------------------------------------------


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(table(spark, sf, "documents"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_distinct_ordered, lambda t: t NOT IN ({STOP})), ';') AS keywords FROM (SELECT doc_id, list_transform(list_filter(list_zip(ts, range(1, len(ts) + 1)), lambda x: list_position(ts, x[1]) = x[2]), lambda x: x[1]) AS list_distinct_ordered FROM (SELECT doc_id, {tokens_sql('text')} AS ts FROM documents))")
def keyword_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.keyword_text(F.col("text")).alias("keywords"))


@query(rf"""WITH {LINES}, t AS (SELECT doc_id, line_no, CASE line_no % 4 WHEN 0 THEN '## ' || line WHEN 1 THEN ' # **' || line || '**' WHEN 2 THEN '####' || line ELSE line END AS l FROM ln)
SELECT doc_id, line_no, CASE WHEN regexp_matches(l, '^\s*#+\s*.*$') THEN length(regexp_extract(l, '^\s*(#+)', 1)) ELSE -1 END AS level,
CASE WHEN regexp_matches(l, '^\s*#+\s*.*$') THEN trim(regexp_replace(trim(regexp_extract(l, '^\s*#+\s*(.*)$', 1), ' '), '^\s*\*\*(.+?)\*\*\s*$', '\1'), ' ') ELSE trim(l, ' ') END AS title FROM t""")
def markdown_headings(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no") % 4
    line = F.when(n == 0, F.concat(F.lit("## "), "line")).when(n == 1, F.concat(F.lit(" # **"), "line", F.lit("**"))).when(n == 2, F.concat(F.lit("####"), "line")).otherwise(F.col("line"))
    rows = lines(spark, sf).withColumn("_h", T.markdown_heading(line))
    return rows.select("doc_id", "line_no", F.col("_h.level").alias("level"), F.trim(T.without_bold(F.col("_h.title"))).alias("title"))


@query(rf"""WITH {LINES} SELECT doc_id, line_no, trim(regexp_replace(replace(line, ' ', '   '), '\s+', ' ', 'g'), ' ') AS normal FROM ln""")
def normal_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in full-width letters and loose spaces, brought to one form."""
    plain = "".join(chr(c) for c in range(0x21, 0x7F))
    wide = F.translate("line", plain, "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)))
    return lines(spark, sf).select("doc_id", "line_no", T.normal_heading(F.replace(wide, F.lit(" "), F.lit("   "))).alias("normal"))


@query(rf"""WITH {LINES} SELECT doc_id, line_no, regexp_extract(line, '^[A-Z][a-z]+ [a-z]+') AS title FROM ln WHERE regexp_matches(line, '^[A-Z][a-z]*[abefghjknopqrstuwyz][a-z]* [a-z]')""")
def toc_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Contents entries with numbering and page numbers around them; first words that could be Roman numerals are left out."""
    n = F.col("line_no") % 4
    bare = F.regexp_extract("line", "^[A-Z][a-z]+ [a-z]+", 0)
    entry = F.when(n == 0, F.concat(F.lit("3.1 "), bare, F.lit(" ..... 17"))).when(n == 1, F.concat(F.lit("第二章 "), bare, F.lit("··· 4"))).when(n == 2, F.concat(F.lit("（三）"), bare)).otherwise(F.concat(bare, F.lit(" 9 ")))
    return lines(spark, sf).filter("line rlike '^[A-Z][a-z]*[abefghjknopqrstuwyz][a-z]* [a-z]'").select("doc_id", "line_no", T.toc_title(entry).alias("title"))


@query(rf"""WITH {LINES}, t AS (SELECT doc_id, line_no, CASE line_no % 6 WHEN 0 THEN '<!-- Page 3 -->' WHEN 1 THEN ' <table> x' WHEN 2 THEN '![a](b)' WHEN 3 THEN line || ' \frac{{1}}{{2}}' ELSE line END AS l FROM ln) SELECT doc_id, line_no, line_no % 6 > 3 AS is_content FROM t""")
def content_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no") % 6
    line = F.when(n == 0, "<!-- Page 3 -->").when(n == 1, " <table> x").when(n == 2, "![a](b)").when(n == 3, F.concat("line", F.lit(" \\frac{1}{2}"))).otherwise(F.col("line"))
    return lines(spark, sf).select("doc_id", "line_no", T.is_content_line(line).alias("is_content"))


@query(rf"""WITH {LINES} SELECT doc_id, line_no, '中' || trim(regexp_replace(line, '\s+', ' ', 'g'), ' ') || '文字' AS spaced FROM ln""")
def cjk_spaces(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("doc_id", "line_no", T.without_spaces(F.concat(F.lit("中  "), F.trim("line"), F.lit("  文 字"))).alias("spaced"))


@query("""SELECT l_orderkey, l_linenumber, l_linenumber || ':1-' || (l_linenumber + l_suppkey % 3 - 1) || ':' || (l_partkey % 5) AS location, l_suppkey % 3 > 1 OR (l_suppkey % 3 = 1 AND l_partkey % 5 >= 1) AS valid FROM lineitem""")
def locations(spark: SparkSession, sf: str) -> DataFrame:
    """Places in files written, read back and judged."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.location_text(F.col("l_linenumber"), F.lit(1), F.col("l_linenumber") + F.col("l_suppkey") % 3 - 1, F.col("l_partkey") % 5).alias("location"))
    return rows.withColumn("valid", T.location_parts(F.col("location"))["valid"])


@query(rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls FROM documents)
SELECT doc_id, coalesce(left(CASE WHEN regexp_matches(ls[1], '\p{{L}}') THEN ls[1] WHEN regexp_matches(ls[-1], '\p{{L}}') THEN ls[-1] END, 60), 'Page ' || doc_id) AS title FROM l""")
def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.page_title(F.col("text"), F.col("doc_id")).alias("title"))


@query("""SELECT p_partkey, left(concat_ws('_', split_part(p_name, ' ', 1), CASE WHEN split_part(p_name, ' ', 2) <> split_part(p_name, ' ', 1) THEN nullif(split_part(p_name, ' ', 2), '') END, p_partkey), 80) AS name FROM part""")
def table_names(spark: SparkSession, sf: str) -> DataFrame:
    word = lambda k: F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(k)), F.lit(""))
    header = F.concat(F.lit("| "), word(1), F.lit(" | -- | "), word(2), F.lit(" , "), word(1), F.lit(" * "), F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", T.table_name(header).alias("name"))


@query("""SELECT doc_id, ['img/' || doc_id || '.png', source || '.jpg'] AS images, 'image-' || doc_id || CASE WHEN coalesce(text, '') = '' THEN '' ELSE '-' || left(text, 10) END AS name FROM documents""")
def markdown_images(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(T.text_or_empty(F.col("text")), F.lit("\n![a b](img/"), F.col("doc_id"), F.lit(".png \"t\") and ![]("), F.col("source"), F.lit(".jpg)"))
    return table(spark, sf, "documents").select("doc_id", T.markdown_images(text).alias("images"), T.image_name(F.col("doc_id"), F.col("text")).alias("name"))


@query("""SELECT doc_id, substr('[images/a' || doc_id || ']', 2, length('images/a' || doc_id)) AS first_ref, 2 AS n_refs, length(coalesce(text, '')) AS start, length(coalesce(text, '')) + length('[images/a' || doc_id || ']') AS "end" FROM documents""")
def chunk_references(spark: SparkSession, sf: str) -> DataFrame:
    """Media references with their places; one stands twice."""
    one = F.concat(F.lit("[images/a"), F.col("doc_id"), F.lit("]"))
    text = F.concat(T.text_or_empty(F.col("text")), one, F.lit(" [tables/t.html] "), one)
    rows = table(spark, sf, "documents").select("doc_id", T.chunk_refs(text).alias("r"), T.chunk_ref_spans(text)[0].alias("s"))
    return rows.select("doc_id", F.regexp_replace(F.col("r")[0], r"^\[|\]$", "").alias("first_ref"), F.size("r").alias("n_refs"), "s.start", "s.end")


TOKEN = r"(?:[A-Za-z]+|[0-9]+(?:\.[0-9]+)?)"


@query(rf"""SELECT doc_id, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) <= 8 THEN coalesce(text, '') ELSE array_to_string(regexp_extract_all(text, '[^A-Za-z0-9]*{TOKEN}')[1:8], '') END AS cut FROM documents""")
def truncated_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.truncated(F.col("text"), 8).alias("cut"))


@query(rf"""SELECT doc_id, CASE WHEN len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) <= 14 THEN coalesce(text, '') ELSE array_to_string(regexp_extract_all(text, '[^A-Za-z0-9]*{TOKEN}')[1:10], '') || '...' || rtrim(array_to_string(regexp_extract_all(text, '{TOKEN}[^A-Za-z0-9]*')[-4:], ''), ' ') END AS shown FROM documents""")
def text_previews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.preview(F.col("text"), 10, 4).alias("shown"))


# --- routing and records -----------------------------------------------------------------------------

SUFFIXES = (".txt", ".PDF", ".xlsx", ".py", ".rs", ".exe", "", ".md")
SUFFIX_SQL = "['.txt', '.PDF', '.xlsx', '.py', '.rs', '.exe', '', '.md'][doc_id % 8 + 1]"


def named_files(spark: SparkSession, sf: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("dir.x/f"), F.col("doc_id"), suffix).alias("path"))


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'text' WHEN 1 THEN 'pdf' WHEN 2 THEN 'xlsx' WHEN 7 THEN 'markdown' ELSE 'rejected' END AS format, CASE doc_id % 8 WHEN 3 THEN 'python' WHEN 4 THEN 'rust' WHEN 7 THEN 'markdown' ELSE 'unknown' END AS language FROM documents""")
def routed_files(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = X.routed(named_files(spark, sf))
    return good.unionByName(bad.withColumn("format", F.lit("rejected"))).select("doc_id", "format", X.code_language(F.col("path")).alias("language"))


@query("""SELECT doc_id, lang, source, 'ok' AS reason FROM documents WHERE doc_id % 5 < 3 UNION ALL SELECT doc_id, NULL, NULL, CASE doc_id % 5 WHEN 3 THEN 'missing version' ELSE 'other version' END FROM documents WHERE doc_id % 5 >= 3""")
def canonical_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as canonical JSON and read back; some lost their version, some have another one."""
    rows = X.to_canonical(table(spark, sf, "documents").select("doc_id", "lang", "source"))
    k = F.get_json_object("value", "$.doc_id").cast("long") % 5
    spoilt = F.when(k == 3, F.replace("value", F.lit("canonical_model_version"), F.lit("version"))).when(k == 4, F.replace("value", F.lit('"1.0.0"'), F.lit('"2.0.0"'))).otherwise(F.col("value"))
    good, bad = X.from_canonical(rows.withColumn("value", spoilt), "doc_id long, lang string, source string")
    rest = bad.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), "reason")
    return good.withColumn("reason", F.lit("ok")).unionByName(rest)


@query("""SELECT doc_id, page, [source || ' a', 'b', 'cell ' || doc_id][s + 1] AS text, [12.5, 9.0, 0.0][s + 1] AS height, ['title', 'list', 'table'][s + 1] AS type FROM (SELECT *, unnest([1, 2]) AS page FROM documents), (SELECT unnest([0, 1, 2]) AS s)""")
def layout_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Layout JSON of two pages with a title, a nested list and a table, read as spans."""
    span = lambda text, h: F.array(F.struct(F.array(F.struct(text.alias("content"), F.lit(h).alias("height"))).alias("spans")))
    block = F.array(
        F.to_json(F.struct(F.lit("title").alias("type"), span(F.concat("source", F.lit(" a ")), 12.5).alias("lines"))),
        F.to_json(F.struct(F.lit("list").alias("type"), F.array(F.struct(F.lit("text").alias("type"), span(F.lit("b"), 9.0).alias("lines"))).alias("blocks"))),
        F.to_json(F.struct(F.lit("table").alias("type"), F.array(F.concat(F.lit("cell "), "doc_id"), F.lit(" ")).alias("cells"))),
    )
    page = lambda n: F.concat(F.lit(f'{{"page":{n},"blocks":['), F.array_join(block, ","), F.lit("]}"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("["), page(1), F.lit(","), page(2), F.lit("]")).alias("layout"))
    return X.layout_spans(docs).select("doc_id", "page", "text", "height", "type")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['a' || event_id, 'b'] WHEN 1 THEN ['x' || event_id] WHEN 2 THEN ['p', 'q'] ELSE []::VARCHAR[] END AS targets, CASE event_id % 4 WHEN 1 THEN 'embeds' ELSE 'related' END AS relation FROM events""")
def connection_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Connections given as list of texts, list of objects, one text, or not at all."""
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit('["a'), "event_id", F.lit('", " b "]'))).when(k == 1, F.concat(F.lit('[{"target":"x'), "event_id", F.lit('","relation":"embeds"}]'))).when(k == 2, " p ; q")
    rows = table(spark, sf, "events").select("event_id", R.connections(raw).alias("c"))
    return rows.select("event_id", F.transform("c", lambda c: c["target"]).alias("targets"), F.coalesce(F.try_element_at("c", F.lit(1))["relation"], F.lit("related")).alias("relation"))


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'image' ELSE 'table' END AS type, CASE WHEN doc_id % 3 > 0 THEN 'dir/m' || doc_id END AS file_path, CASE WHEN doc_id % 3 > 0 THEN 'm' || doc_id END AS original_name, [lang || 'x', source] AS keywords, [doc_id::INT, 7] AS page_nums, length(coalesce(text, '')) AS length FROM documents""")
def chunk_records(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed rows with loose types as chunk records."""
    k = F.col("doc_id") % 3
    rows = table(spark, sf, "documents").select(
        F.lit("d").alias("document_id"), F.col("doc_id").alias("sort_order"), T.text_or_empty(F.col("text")).alias("content"), F.concat(F.lit("dir/m"), "doc_id").alias("path"), F.when(k == 0, "PTXT").when(k == 1, " Image\nwide").otherwise("table").alias("type"),
        F.lit(None).cast("int").alias("length"), F.concat_ws(";", F.concat("lang", F.lit("x")), F.lit("y"), "source").alias("keywords"), F.lit(None).cast("string").alias("summary"), F.lit("[a, b]").alias("tokens"), F.lit("z").alias("connectto"), F.concat(F.lit("["), "doc_id", F.lit(", 7]")).alias("page_nums"),
    )
    return R.chunk_records(rows).select(F.col("sort_order").alias("doc_id"), "type", "metadata.file_path", "metadata.original_name", "metadata.keywords", "metadata.page_nums", "metadata.length")


@query("""WITH p AS (SELECT DISTINCT source, lang, doc_id % 3 AS leaf FROM documents), n AS (SELECT DISTINCT unnest([[source], [source, lang], [source, lang, leaf::VARCHAR]]) AS path FROM p) SELECT array_to_string(path, '/') AS path FROM n WHERE len(path) = 3""")
def leaf_paths(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").select(F.array("source", "lang", (F.col("doc_id") % 3).cast("string")).alias("p")).distinct()
    nodes = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.slice("p", 1, i))).alias("path")).distinct()
    return R.leaf_paths(nodes).select(F.array_join("path", "/").alias("path"))


@query("""SELECT event_id, k AS channel, CASE WHEN k = 'path' AND event_id % 2 = 0 THEN 3.0 WHEN k = 'path' THEN 1.0 WHEN k = 'content' THEN 2.0 WHEN k = 'term' THEN 1.5 ELSE 0.5 END AS weight FROM events, (SELECT unnest(['path', 'content', 'term', 'own']) AS k) WHERE k <> 'own' OR event_id % 2 = 0""")
def effective_weights(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.search import WEIGHTS

    own = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("path"), F.lit(3.0), F.lit("own"), F.lit(0.5)))
    return table(spark, sf, "events").select("event_id", F.explode(R.merged_weights(WEIGHTS, own)).alias("channel", "weight"))


# --- tables ------------------------------------------------------------------------------------------

CELLS = """cel AS (SELECT o_custkey AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, o_orderkey::VARCHAR AS a, o_orderpriority AS b, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS c FROM orders),
cells AS (SELECT t AS table_id, 0 AS "row", k AS col, ['Kind', 'Kind', ''][k + 1] AS value FROM (SELECT DISTINCT t FROM cel), (SELECT unnest([0, 1, 2]) AS k) UNION ALL SELECT t, r, k, [b, c, a][k + 1] FROM cel, (SELECT unnest([0, 1, 2]) AS k))"""


def order_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of each customer as a table of cells: priority, state (sometimes blank), key, below a loose header."""
    from pyspark.sql import Window

    o = table(spark, sf, "orders").withColumn("row", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    body = o.select(F.col("o_custkey").alias("table_id"), "row", F.posexplode(F.array("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")), F.col("o_orderkey").cast("string"))).alias("col", "value"))
    heads = body.select("table_id").distinct().select("table_id", F.lit(0).alias("row"), F.posexplode(F.array(F.lit("Kind"), F.lit("Kind"), F.lit(""))).alias("col", "value"))
    return heads.unionByName(body)


@query(f"WITH {CELLS} SELECT table_id, col, ['Kind', 'Kind>>>1', 'Kind>>>2'][col + 1] AS header FROM cells WHERE \"row\" = 0")
def unique_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Blank headers filled from the left, repeated ones numbered."""
    heads = B.filled_headers(order_cells(spark, sf).filter("row = 0"), ["table_id"]).withColumnRenamed("value", "header")
    return B.unique_names(heads, ["table_id"]).select("table_id", "col", "header")


@query(f"""WITH {CELLS}, ok AS (SELECT table_id, col, min((trim(value) <> '' AND NOT regexp_matches(value, '^\\s*[-+]?[$¥€]?\\d[\\d,]*(?:\\.\\d+)?%?\\s*$'))::INT) = 1 AS ok FROM cells WHERE "row" > 0 GROUP BY ALL)
SELECT table_id, col FROM ok o WHERE col < 3 AND NOT EXISTS (SELECT 1 FROM ok x WHERE x.table_id = o.table_id AND x.col <= o.col AND NOT x.ok)""")
def index_columns(spark: SparkSession, sf: str) -> DataFrame:
    return B.index_columns(order_cells(spark, sf), ["table_id"])


@query(f"""WITH {CELLS} SELECT c.table_id, c."row", c.col, CASE WHEN c."row" IN (1, 2) AND c.col <= 1 THEN x.value ELSE c.value END AS value FROM cells c LEFT JOIN cells x ON x.table_id = c.table_id AND x."row" = 1 AND x.col = 0""")
def merged_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The first two data rows and columns merged into one range per table."""
    cells = order_cells(spark, sf)
    merges = cells.select("table_id").distinct().select("table_id", F.lit(1).alias("min_row"), F.lit(2).alias("max_row"), F.lit(0).alias("min_col"), F.lit(1).alias("max_col"))
    return B.filled_merges(cells, merges, ["table_id"])


@query(f"""WITH {CELLS} SELECT table_id, "row", max(value) FILTER (col = 0) AS "first", max(value) FILTER (col = 1) AS "second", max(value) FILTER (col = 2) AS "third" FROM cells WHERE "row" > 0 GROUP BY ALL""")
def table_records(spark: SparkSession, sf: str) -> DataFrame:
    """Rows as maps from unique headers to values."""
    r = B.records(order_cells(spark, sf), ["table_id"])
    return r.select("table_id", "row", F.col("record")["Kind"].alias("first"), F.col("record")["Kind>>>1"].alias("second"), F.col("record")["Kind>>>2"].alias("third"))


@query(f"""WITH {CELLS}, v AS (SELECT table_id, "row", col, CASE WHEN "row" % 4 = 3 THEN '' WHEN col = 2 AND "row" > 0 THEN '2024-01-05' ELSE value END AS value FROM cells), f AS (SELECT * FROM v WHERE value <> '')
SELECT * FROM v WHERE EXISTS (SELECT 1 FROM f WHERE f.table_id = v.table_id AND f."row" = v."row") AND EXISTS (SELECT 1 FROM f WHERE f.table_id = v.table_id AND f.col = v.col)""")
def cleaned_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth row blank, dates with a midnight time."""
    dirty = F.when(F.col("row") % 4 == 3, F.lit(" ")).when((F.col("col") == 2) & (F.col("row") > 0), F.lit("2024-01-05 00:00:00")).otherwise(F.col("value"))
    return B.cleaned(order_cells(spark, sf).withColumn("value", dirty), ["table_id"])


@query(f"""WITH {CELLS}, d AS (SELECT table_id, left(trim(value), 20) AS v, min("row") AS r FROM cells WHERE col = 0 AND trim(value) <> '' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY r) AS n FROM d)
SELECT table_id, 'Kind' AS first_row, string_agg(v, ' | ' ORDER BY r) AS first_col FROM n WHERE n <= 10 GROUP BY table_id""")
def table_previews(spark: SparkSession, sf: str) -> DataFrame:
    return B.previews(order_cells(spark, sf), ["table_id"])


@query("""WITH s AS (SELECT s_nationkey AS workbook, s_suppkey AS sheet_no, 'sheet ' || s_suppkey % 3 AS sheet FROM supplier), n AS (SELECT *, row_number() OVER (PARTITION BY workbook, sheet ORDER BY sheet_no) AS n FROM s) SELECT workbook, sheet_no, sheet || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS name FROM n""")
def sheet_names(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("workbook"), F.col("s_suppkey").alias("sheet_no"), F.concat(F.lit(" sheet "), F.col("s_suppkey") % 3, F.lit(" ")).alias("sheet"))
    return B.sheet_names(s).select("workbook", "sheet_no", "name")


@query(f"""WITH {CELLS} SELECT table_id, 0 AS table_no, "row", col, value, "row" = 0 AS is_header, 1 AS rowspan, CASE WHEN "row" = 0 AND col = 0 THEN 2 ELSE 1 END AS colspan FROM cells""")
def html_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders written as an HTML table and read as cells."""
    c = order_cells(spark, sf)
    cell = F.when(F.col("row") == 0, F.concat(F.lit("<TH"), F.when(F.col("col") == 0, F.lit(" colspan='2'")).otherwise(F.lit("")), F.lit("><b>"), "value", F.lit("</b></TH>"))).otherwise(F.concat(F.lit("<td class=x> "), "value", F.lit(" <br/></td>")))
    rows = c.withColumn("h", cell).groupBy("table_id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "h"))), lambda x: x["h"]), "\n").alias("h"))
    html = rows.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "h"))), lambda x: F.concat(F.lit("<tr>"), x["h"], F.lit("</tr>"))), "").alias("h"))
    return B.html_cells(html.select("table_id", F.concat(F.lit("<p>x</p><table border=1>"), "h", F.lit("</table>")).alias("html")), "table_id")


@query(f"""WITH {CELLS}, s AS (SELECT table_id, count(DISTINCT "row") - 1 AS n FROM cells GROUP BY ALL) SELECT table_id, k AS col, CASE k WHEN 0 THEN 'Order' WHEN 1 THEN 'Ship > Date' ELSE 'Ship > ' || n END AS header, 2 AS header_rows FROM s, (SELECT unnest([0, 1, 2]) AS k)""")
def header_grids(spark: SparkSession, sf: str) -> DataFrame:
    """Two header rows with row and column spans per customer's table."""
    n = order_cells(spark, sf).groupBy("table_id").agg((F.count_distinct("row") - 1).cast("string").alias("n"))
    cell = lambda r, c, v, rs, cs: F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), v.alias("value"), F.lit(rs).alias("rowspan"), F.lit(cs).alias("colspan"))
    cells = n.select("table_id", F.explode(F.array(cell(0, 0, F.lit("Order"), 2, 1), cell(0, 1, F.lit("Ship"), 1, 2), cell(1, 0, F.lit("Date"), 1, 1), cell(1, 1, F.col("n"), 1, 1))).alias("x")).select("table_id", "x.*")
    return B.header_grid(cells, ["table_id"])


@query(f"""WITH {CELLS} SELECT table_id, "row", col, CASE WHEN "row" <= 3 THEN 0 ELSE 1 END AS part FROM cells WHERE "row" <> 4 AND table_id IN (SELECT table_id FROM cells GROUP BY table_id HAVING max("row") >= 8)""")
def sheet_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Sheets of at least eight rows, split where a row is blank."""
    c = order_cells(spark, sf)
    big = c.groupBy("table_id").agg(F.max("row").alias("_m")).filter("_m >= 8").select("table_id")
    return B.sheet_parts(c.join(big, "table_id").filter("row <> 4").withColumn("value", F.when(F.col("value") == "", "x").otherwise(F.col("value"))), ["table_id"]).select("table_id", "row", "col", "part")


# --- provider records --------------------------------------------------------------------------------


@query(f"""SELECT doc_id AS record_id, source AS repository_id, 'dir.x/f' || doc_id || {SUFFIX_SQL} AS path, CASE WHEN doc_id % 2 = 0 THEN lang WHEN doc_id % 8 = 3 THEN 'python' WHEN doc_id % 8 = 7 THEN 'markdown' ELSE 'unknown' END AS language,
sha256(coalesce(text, '')) AS checksum, strlen(coalesce(text, '')) AS size_bytes FROM documents""")
def adapted_files(spark: SparkSession, sf: str) -> DataFrame:
    """Provider files: every second one tells its language, the others' follows from the suffix."""
    d = table(spark, sf, "documents").join(named_files(spark, sf), "doc_id")
    rows = d.select(F.col("doc_id").alias("record_id"), F.col("source").alias("repository_id"), "path", F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("language"))
    return X.adapted(rows, "file").select("record_id", "repository_id", "path", "language", "checksum", "size_bytes")


@query("""SELECT doc_id AS record_id, sha256(coalesce(text, '')) AS text_sha, 'code' AS chunk_type, 0 AS ordering, CASE WHEN doc_id % 2 = 0 THEN doc_id || ':1-' || (doc_id + 3) || ':1' ELSE '1:1-' || (doc_id + 3) || ':1' END AS location FROM documents""")
def adapted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Provider chunks that call their text content, some without a start line."""
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("record_id"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text"), F.col("text").alias("content"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("start_line"), (F.col("doc_id") + 3).alias("end_line"))
    return X.adapted(rows, "chunk").select("record_id", F.sha2("text", 256).alias("text_sha"), "chunk_type", "ordering", "location")


@query("""SELECT event_id AS record_id, 's' || user_id AS source_id, '' AS target_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown' END AS type, value AS weight FROM events""")
def adapted_links(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("record_id"), F.concat(F.lit("s"), "user_id").alias("source_id"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("type"), F.col("value").alias("weight"))
    return X.adapted(rows, "relationship").select("record_id", "source_id", "target_id", "type", "weight")
