"""Heading evidence and prediction, page features, views, nested tables, repositories, manifests, live deliveries, plug-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ext as E
from ..functions import text as T
from ..operators import assembly as A
from ..operators import graph as G
from ..operators import pages as P
from ..operators import sections as N
from ..operators import structure as U
from ..operators import tables as B
from ..operators.chunking import lines_of
from ..sources import scans as X
from ..sources.store import by_keys, shared_dir, written
from ..streaming import jobs as J
from .content_queries import LINES
from .registry import query, table
from .shelf_queries import MODES, SHELF, shelf
from .table_queries import CELLS, order_cells

# --- headings ----------------------------------------------------------------------------------------


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(table(spark, sf, "documents"))


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, line_no, regexp_extract(line, '^[A-Z][a-z]+ [a-z]+') AS bare FROM ln WHERE regexp_matches(line, '^[A-Z][a-z]+ [a-z]+'))
SELECT doc_id, line_no, [3, 1, 0, 0, 0, 0][line_no % 6 + 1] AS depth, CASE line_no % 6 WHEN 3 THEN 1 WHEN 5 THEN 1 ELSE 0 END AS against, [3, -2, -1, -1, 2, -1][line_no % 6 + 1] AS level,
CASE line_no % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS toc_level, CASE line_no % 6 WHEN 1 THEN CASE WHEN length(bare) >= 12 THEN 'other' ELSE 'zh' END WHEN 5 THEN 'en' ELSE NULL END AS lang FROM b""")
def heading_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence for and against a heading, its level and its level as a contents entry, for lines with six kinds of decoration."""
    bare, n = F.regexp_extract("line", "^[A-Z][a-z]+ [a-z]+", 0), F.col("line_no") % 6
    told = F.array(F.concat(F.lit("1.2.3 "), bare), F.concat(F.lit("一、总则总则总则总"), F.lit("")), bare, F.concat(F.lit("2024 "), bare), F.concat(F.lit("## "), bare), F.concat(bare, F.lit(" and so on with many more words than a heading has")))
    rows = lines(spark, sf).filter("line rlike '^[A-Z][a-z]+ [a-z]+'").withColumn("_l", F.element_at(told, n.cast("int") + 1)).withColumn("_b", bare)
    title = T.markdown_heading(F.col("_l"))["title"]
    # eight CJK characters are Chinese up to sixteen ASCII letters beside them
    mixed = F.when(n == 1, T.dominant_language(F.concat(F.lit("总则总则总则总则"), F.rpad(F.lit(""), 0, "x"), F.when(F.length("_b") >= 12, F.lit("abcdefghijklmnopq")).otherwise(F.lit("ab"))))).when(n == 5, T.dominant_language(F.col("_l")))
    return rows.select("doc_id", "line_no", F.array_max(T.heading_evidence(title)).alias("depth"), F.array_max(T.body_evidence(title)).alias("against"), T.heading_level(F.col("_l")).alias("level"), T.toc_level(F.col("_l")).alias("toc_level"), mixed.alias("lang"))


@query(rf"""WITH {LINES}, t AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN line ELSE left(line, 2 + (line_no * 7 + doc_id) % 15) END AS title, CASE WHEN line_no % 3 = 0 THEN 1 + (line_no % 12 = 9)::INT ELSE -1 END AS level, 'r' || doc_id % 2 AS reason FROM ln),
s AS (SELECT *, len(regexp_extract_all(trim(title, ' '), '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?')) AS n, sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap FROM t),
g AS (SELECT doc_id, gap, max(level) FILTER (level > 0) AS level, coalesce(sum(n) FILTER (level > 0), 0) AS own, coalesce(sum(n) FILTER (level <= 0), 0) AS between_, count(*) FILTER (level <= 0) AS k,
  string_agg(trim(title, ' '), chr(10) ORDER BY line_no) FILTER (level <= 0 AND trim(title, ' ') <> '') AS more FROM s GROUP BY doc_id, gap),
h AS (SELECT *, lead(level) OVER (PARTITION BY doc_id ORDER BY gap) AS after FROM g), ok AS (SELECT doc_id, gap, more FROM h WHERE gap > 0 AND k > 0 AND level = after AND (between_ <= 3 OR between_ < own // 2))
SELECT s.doc_id, line_no, CASE WHEN level > 0 AND ok.more IS NOT NULL THEN trim(title, ' ') || ' ' || ok.more ELSE title END AS title, level FROM s LEFT JOIN ok ON ok.doc_id = s.doc_id AND ok.gap = s.gap WHERE level > 0 OR ok.gap IS NULL""")
def merged_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Every third line a heading, cut lines between them."""
    n = F.col("line_no")
    title = F.when(n % 3 == 0, F.col("line")).otherwise(F.left("line", (2 + (n * 7 + F.col("doc_id")) % 15).cast("int")))
    level = F.when(n % 3 == 0, F.when(n % 12 == 9, 2).otherwise(1)).otherwise(-1)
    rows = lines(spark, sf).select("doc_id", "line_no", title.alias("title"), level.alias("level"), F.concat(F.lit("r"), F.col("doc_id") % 2).alias("reason"))
    return U.merged_gaps(rows).drop("reason")


@query()
def predicted_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings of documents whose lines are decorated, with contents areas, a first title and continued lines; compared with plain Python in tests."""
    rows = written(decorated_lines(table(spark, sf, "documents")))  # read four times
    areas = rows.filter("doc_id % 3 = 0").groupBy("doc_id").agg(F.max("line_no").alias("_n")).filter("_n >= 12").select("doc_id", F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(x).alias("first_line"), F.lit(y).alias("last_line")) for a, x, y in ((1, 0, 1), (2, 6, 7))])).alias("_a")).select("doc_id", "_a.*")
    titles = rows.filter("doc_id % 4 = 1 and line_no = 5").select("doc_id", F.col("line").alias("title"))
    marks = rows.filter("doc_id % 5 = 2 and line_no % 7 = 3").select("doc_id", "line_no")
    return U.predicted_titles(rows, titles, areas, marks, word_text=True)


def decorated_lines(docs: DataFrame) -> DataFrame:
    n, few = F.col("line_no") % 7, F.array_join(F.slice(F.split("line", r"\s+", 4), 1, 3), " ")
    line = F.when(n == 0, F.concat(F.lit("# "), few)).when(n == 1, F.concat(F.lit("1.2 "), few)).when(n == 2, F.lit("<!-- Page 3 -->")).when(n == 3, few).when(n == 4, F.concat(F.lit("## **"), few, F.lit("**"))).when(n == 5, F.concat(F.lit("（一）"), few)).otherwise(F.col("line"))
    return lines_of(docs).select("doc_id", F.col("line_no").cast("int").alias("line_no"), line.alias("line"))


# --- pages, files, languages -------------------------------------------------------------------------


PAGED = """pl AS (SELECT doc_id, (pos - 1) // 10 + 1 AS page, pos, line FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) AS pos FROM documents) WHERE trim(line, ' ') <> ''),
pt AS (SELECT doc_id, page, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\\s+', ''), '\\s+$', '') AS t, string_agg(trim(line, ' '), '|' ORDER BY pos) AS preview FROM pl GROUP BY doc_id, page)"""


@query(f"""WITH {PAGED} SELECT doc_id, page, length(t) AS raw_text_length, round(length(t) / greatest((500 + doc_id % 400) * 600.0, 1) * 10000, 4) AS text_density, CASE WHEN 500 + doc_id % 400 > 600 THEN 'landscape' ELSE 'portrait' END AS orientation,
length(t) < 20 AND (doc_id % 3) / 100.0 < 0.02 AND doc_id % 9 < 5 AS is_blank_like, preview AS text_lines_preview FROM pt""")
def page_texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents dealt to pages of ten lines, with geometry by number."""
    i = F.col("doc_id")
    rows = P.page_lines(table(spark, sf, "documents"), "doc_id", "text", per_page=10)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    pages = rows.groupBy("doc_id", "page").agg(text.alias("text")).withColumns({"width": 500 + i % 400, "height": F.lit(600), "image_coverage": (i % 3) / 100.0, "drawings_count": i % 9})
    return P.text_features(pages).select("doc_id", "page", "raw_text_length", "text_density", "orientation", "is_blank_like", F.array_join("text_lines_preview", "|").alias("text_lines_preview"))


@query("""SELECT 'folder=' || doc_id // 20 AS folder, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10)) AS sha, len(string_split(string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) || chr(10), chr(10)))::INT AS n_lines FROM documents GROUP BY doc_id // 20""")
def whole_files(spark: SparkSession, sf: str) -> DataFrame:
    """documents written as text files, twenty to a file, and read as whole files."""
    path = shared_dir(spark)
    folder = F.floor(F.col("doc_id") / 20).cast("long").alias("folder")
    rows = table(spark, sf, "documents").select("doc_id", folder, F.coalesce("text", F.lit("")).alias("text"))
    rows.repartition("folder").sortWithinPartitions("folder", "doc_id").drop("doc_id").write.partitionBy("folder").text(path)
    read = X.text_files(spark, path)
    return read.select(F.regexp_extract("path", "folder=[0-9]+", 0).alias("folder"), F.sha2("text", 256).alias("sha"), F.size(F.split("text", "\n", -1)).alias("n_lines"))


@query(r"""WITH c AS (SELECT doc_id, left(coalesce(text, ''), 4000) AS h FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(h, '[\x{4e00}-\x{9fff}]')) AS zh, len(regexp_extract_all(h, '[A-Za-z]')) AS en FROM c)
SELECT doc_id, CASE WHEN zh >= greatest(8, en * 0.5) THEN 'zh' WHEN en >= greatest(20, zh * 3) THEN 'en' ELSE 'other' END AS language FROM n""")
def dominant_languages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.dominant_language(F.col("text")).alias("language"))


# --- sections, hydration, manifests ------------------------------------------------------------------

VIEWS = {2: ["chap 0", "chap 1 / sec 3"]}
HIDDEN = {1: ["chap 1"], 2: ["chap 0 / sec 1"]}


def _per_file(docs: DataFrame, paths: dict[int, list[str]], name: str) -> DataFrame:
    every = F.array(*[F.struct(F.lit(v).alias("view_id"), F.lit(p).alias(name)) for v, ps in paths.items() for p in ps])
    return docs.select("document_id", F.explode(every).alias("_x")).select("document_id", "_x.*")


@query(f"""WITH {SHELF}, r AS (SELECT view_id, t.*, greatest(section_level, 1) AS depth FROM tree t, (VALUES (1), (2)) v(view_id)), sc(view_id, scope) AS (VALUES (2, 'chap 0'), (2, 'chap 1 / sec 3')), ex(view_id, path) AS (VALUES (1, 'chap 1'), (2, 'chap 0 / sec 1')),
ins AS (SELECT r.view_id, document_id, section_path, depth, scope FROM r JOIN sc ON r.view_id = sc.view_id AND starts_with(section_path, scope || ' / ') UNION ALL SELECT view_id, document_id, section_path, depth, NULL FROM r WHERE view_id = 1),
sh AS (SELECT * FROM ins WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.view_id = ins.view_id AND (section_path = path OR starts_with(section_path, path || ' / ')))),
dd AS (SELECT *, dense_rank() OVER (PARTITION BY view_id, document_id, scope ORDER BY depth) AS d FROM sh), ok AS (SELECT DISTINCT view_id, document_id, depth FROM dd WHERE d <= 2),
shown AS (SELECT DISTINCT sh.view_id, sh.document_id, section_path, TRUE AS show_summary FROM sh JOIN ok ON ok.view_id = sh.view_id AND ok.document_id = sh.document_id AND ok.depth = sh.depth),
anc(view_id, up) AS (VALUES (2, 'chap 0'), (2, 'chap 1'), (2, 'chap 1 / sec 3')),
ctx AS (SELECT r.view_id, document_id, section_path, FALSE FROM r JOIN anc ON r.view_id = anc.view_id AND anc.up = CASE WHEN depth = 1 THEN section_path ELSE parent_path END
  WHERE depth <= 2 AND NOT EXISTS (SELECT 1 FROM ins WHERE ins.view_id = r.view_id AND ins.document_id = r.document_id AND ins.section_path = r.section_path)),
c AS (SELECT document_id, spot AS section_path, count(*) FILTER (chunk_type = 'text') AS n_text, CASE WHEN spot = 'Root' THEN 0 ELSE count(*) FILTER (chunk_type = 'image') END AS n_image FROM ups GROUP BY document_id, spot)
SELECT v.view_id, document_id, section_path, show_summary, NOT EXISTS (SELECT 1 FROM tree x WHERE x.document_id = v.document_id AND x.parent_path = v.section_path) AS is_leaf, n_text, n_image FROM (SELECT * FROM shown UNION ALL SELECT * FROM ctx) v JOIN c USING (document_id, section_path)""")
def section_view(spark: SparkSession, sf: str) -> DataFrame:
    """Two views of every file: all but a chapter, and two scopes without a section, with the context around them."""
    s = shelf(spark, sf)
    docs = s.select("document_id").distinct()
    views = docs.select("document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("view_id"))
    got = N.section_view(N.section_table(s), views, _per_file(docs, VIEWS, "scope"), _per_file(docs, HIDDEN, "path"), counts=N.rolled_up(N.direct_counts(s)))
    return got.select("view_id", "document_id", "section_path", "show_summary", "is_leaf", "n_text", "n_image")


@query(f"""WITH {SHELF}, sel AS (SELECT document_id, section_path AS path, sort_order AS selection, ['outline', 'self_only', 'shallow', 'chunks', 'assets_only', 'image_only', 'table_only'][(sort_order + document_id) % 7 + 1] AS mode FROM tree),
m AS (SELECT u.document_id, u.chunk_id, l.selection, l.mode, row_number() OVER (PARTITION BY u.document_id, u.chunk_id ORDER BY l.selection) AS n FROM ups u JOIN sel l ON l.document_id = u.document_id AND l.path = u.spot
WHERE mode <> 'outline' AND CASE l.mode WHEN 'chunks' THEN TRUE WHEN 'shallow' THEN len(u.ps) - u.dep - 1 <= 1 OR spot = 'Root' WHEN 'assets_only' THEN chunk_type <> 'text' WHEN 'image_only' THEN chunk_type = 'image' WHEN 'table_only' THEN chunk_type = 'table' ELSE spot = 'Root' OR len(u.ps) = u.dep + 1 END),
f AS (SELECT document_id, section_path, min_by(summary, sort_order) FILTER (trim(summary, ' ') <> '') AS summary FROM shelf GROUP BY ALL)
SELECT document_id, chunk_id, selection, mode, NULL AS outline FROM m WHERE n = 1 UNION ALL
SELECT document_id, 'outline_' || document_id || '_' || t.sort_order, selection, mode, '[Outline] ' || section_title || CASE WHEN trim(coalesce(f.summary, ''), ' ') <> '' THEN chr(10) || trim(f.summary, ' ') ELSE '' END
FROM sel JOIN tree t USING (document_id) LEFT JOIN f USING (document_id, section_path) WHERE t.section_path = sel.path AND mode = 'outline'""")
def outline_and_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every section selected with one of the seven modes in turn: outline rows and chunk rows together."""
    s = shelf(spark, sf)
    said = s.groupBy("document_id", "section_path").agg(F.min_by("summary", F.when(F.trim("summary") != "", F.col("sort_order"))).alias("summary"))
    t = N.section_table(s).join(said, ["document_id", "section_path"], "left")
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), ((F.col("sort_order") + F.col("document_id")) % 7 + 1).cast("int"))
    chosen = t.select("document_id", F.col("section_path").alias("path"), F.col("sort_order").alias("selection"), mode.alias("mode"))
    return A.hydrated(chosen, s, t).select("document_id", "chunk_id", "selection", "mode", F.when(F.col("mode") == "outline", F.col("content")).alias("outline"))


@query(f"""WITH {SHELF}, t AS (SELECT document_id, coalesce(parent_path, '') AS up, section_path, section_title, greatest(section_level, 1) AS lv, sort_order FROM tree),
l3 AS (SELECT document_id, up AS section_path, string_agg('"' || section_title || '":{{}}', ',' ORDER BY sort_order) AS j FROM t WHERE lv = 3 GROUP BY ALL),
l2 AS (SELECT t.document_id, t.up AS section_path, string_agg('"' || section_title || '":{{' || coalesce(l3.j, '') || '}}', ',' ORDER BY sort_order) AS j FROM t LEFT JOIN l3 USING (document_id, section_path) WHERE lv = 2 GROUP BY t.document_id, t.up),
l1 AS (SELECT t.document_id, string_agg('"' || section_title || '":{{' || coalesce(l2.j, '') || '}}', ',' ORDER BY sort_order) AS j FROM t LEFT JOIN l2 USING (document_id, section_path) WHERE lv = 1 GROUP BY t.document_id),
n AS (SELECT document_id, count(*) AS total, count(*) FILTER (chunk_type = 'text') AS a, count(*) FILTER (chunk_type = 'image') AS b, count(*) FILTER (chunk_type = 'table') AS c FROM shelf GROUP BY document_id)
SELECT document_id, '{{"version":"2.0","job_id":"job' || document_id || '","source_file_name":"file' || document_id || '.txt","processing_date":"' || strftime(TIMESTAMP '2024-01-01' + to_seconds(document_id), '%Y-%m-%dT%H:%M:%SZ') || '","processing":{{"page_count":' || total || ',"billing_status":"done","cost":{{"micro_dollars":' || total * 1500 || ',"credits":' || total * 15 || '}},"timing":{{"started_at":"2024-01-01T00:00:00","completed_at":"'
|| strftime(TIMESTAMP '2024-01-01' + to_seconds(document_id), '%Y-%m-%dT%H:%M:%S') || '","duration_ms":' || document_id * 1000 || '}},"stages":{{"parse":' || document_id || '}}}},"statistics":{{"total":' || total || ',"text":' || a || ',"image":' || b || ',"table":' || c || '}},"HIERARCHY":{{' || j || '}}}}' AS manifest FROM n JOIN l1 USING (document_id)""")
def full_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest per file: job, cost, times, stages, statistics and the tree of its titles."""
    s, d = shelf(spark, sf), F.col("document_id")
    n = s.groupBy("document_id").agg(F.count(F.lit(1)).alias("page_count"))
    done = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, document_id)")
    jobs = n.select(
        "document_id", F.concat(F.lit("job"), d).alias("job_id"), F.lit(None).cast("string").alias("data_id"), F.concat(F.lit("file"), d, F.lit(".txt")).alias("source_file_name"), done.alias("processed_at"), "page_count",
        F.lit("done").alias("billing_status"), (F.col("page_count") * 1500).alias("micro_dollars"), (F.col("page_count") * 15).alias("credits"), F.expr("timestamp_ntz'2024-01-01 00:00:00'").alias("started_at"), done.alias("completed_at"), F.create_map(F.lit("parse"), d).alias("stages"),
    )
    return X.full_manifests(jobs, s, N.hierarchies(N.section_table(s)))


@query(f"""WITH {SHELF}, k AS (SELECT document_id, chunk_type, count(*) AS n FROM shelf GROUP BY ALL)
SELECT document_id, (SELECT count(*) FROM shelf s WHERE s.document_id = k.document_id) AS n_chunks, string_agg(chunk_type || '=' || n, ',' ORDER BY chunk_type) AS types,
(SELECT min_by(trim(summary, ' '), sort_order) FROM shelf s WHERE s.document_id = k.document_id AND trim(summary, ' ') <> '') AS top_summary FROM k GROUP BY document_id""")
def summary_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Graph nodes with the number of chunks of each type and the first summary that is not blank."""
    got = G.nodes(shelf(spark, sf), summary="summary", order="sort_order")
    kinds = F.transform(F.map_entries("types"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return got.select("document_id", "n_chunks", F.array_join(kinds, ",").alias("types"), "top_summary")


@query(f"""WITH {SHELF} SELECT chunk_id, chunk_type AS type, coalesce(summary, '') AS summary, CASE WHEN chunk_type = 'text' THEN 't' || sort_order ELSE '' END AS tokens, 'k' || document_id AS keywords, CASE WHEN chunk_type = 'text' THEN coalesce(target, '') END AS targets,
CASE WHEN sort_order % 2 = 0 THEN file_path WHEN chunk_type = 'table' THEN file_path END AS file_path FROM shelf""")
def bundle_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their metadata by type; tables without a file are named after their path, images without one stay so."""
    s = shelf(spark, sf).withColumn("namespace", F.col("lang")).withColumns({"tokens": F.array(F.concat(F.lit("t"), "sort_order")), "keywords": F.array(F.concat(F.lit("k"), "document_id")), "file_path": F.when(F.col("sort_order") % 2 == 0, F.col("file_path"))})
    m = X.bundle_rows(s).select("chunk_id", "type", "metadata.*")
    return m.select("chunk_id", "type", "summary", F.array_join("tokens", ",").alias("tokens"), F.array_join("keywords", ",").alias("keywords"), F.trim(F.array_join("connect_to.target", ",")).alias("targets"), "file_path")


# --- tables, repositories ----------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_custkey AS t, o_orderkey AS k, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r FROM orders)
SELECT t AS table_id, 0 AS table_no, 1 AS depth, r AS "row", c AS col, CASE c WHEN 0 THEN 'order ' || k ELSE 'before after' END AS value, FALSE AS is_header, 1 AS colspan, NULL::BIGINT AS parent_table, NULL::BIGINT AS parent_row, NULL::BIGINT AS parent_col FROM o, (VALUES (0), (1)) x(c)
UNION ALL SELECT t, r + 1, 2, 0, c, CASE c WHEN 0 THEN 'Kind' ELSE p END, c = 0, CASE c WHEN 0 THEN 1 ELSE 2 END, 0, r, 1 FROM o, (VALUES (0), (1)) x(c)""")
def nested_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders as an HTML table whose second cells hold a table of their own, with text around it."""
    o = table(spark, sf, "orders")
    inner = lambda x: F.concat(F.lit("<TABLE border=1><tr><th> Kind</th><td colspan='2'><b>"), x["o_orderpriority"], F.lit("</b></td></tr></TABLE>"))
    row = lambda x: F.concat(F.lit("<tr>\n<td>order "), x["o_orderkey"], F.lit("</td><td>before "), inner(x), F.lit(" after</td> loose </tr>"))
    html = by_keys(o, "o_custkey").groupBy(F.col("o_custkey").alias("table_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), row), "").alias("h"))
    got = B.html_tables(html.select("table_id", F.concat(F.lit("</table><p>x</p><table>"), "h", F.lit("</table>")).alias("html")), "table_id")
    return got.select("table_id", "table_no", "depth", "row", "col", "value", "is_header", "colspan", "parent_table", "parent_row", "parent_col")


@query(f"""WITH {CELLS} SELECT table_id, "row" AS "row", col, value, 'Top' AS header FROM cells WHERE table_id % 2 = 0 UNION ALL SELECT table_id, "row" - 1, col, value, '>Kind' FROM cells WHERE table_id % 2 = 1 AND "row" > 0""")
def multi_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's cells below one more row, which is blank or has one value: header levels filled from both sides."""
    c = order_cells(spark, sf)
    top = c.filter("row = 0").withColumn("value", F.when((F.col("table_id") % 2 == 0) & (F.col("col") == 1), "Top").otherwise(" "))
    got = B.with_header_levels(c.withColumn("row", F.col("row") + 1).unionByName(top), ["table_id"])
    return got.select("table_id", "row", "col", "value", F.array_join("levels", ">").alias("header"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS file_id, l_linenumber AS n, 1000000000000 + l_orderkey * 8 + l_linenumber AS id FROM lineitem), s AS (SELECT file_id, 'sym' || n AS name, -id AS id FROM c WHERE n % 2 = 0),
lk AS (SELECT id AS source, id + 1 AS target FROM c UNION ALL SELECT id, -id FROM s UNION ALL SELECT o_orderkey, o_custkey FROM orders), l AS (SELECT source, string_agg(target::VARCHAR, '+' ORDER BY target) AS links FROM lk GROUP BY source),
a AS (SELECT file_id, string_agg(n || ':' || c.id || ':' || coalesce(links, ''), ',' ORDER BY n) AS chunks FROM c LEFT JOIN l ON l.source = c.id GROUP BY file_id),
b AS (SELECT file_id, string_agg(name || ':' || coalesce(links, ''), ',' ORDER BY name) AS symbols FROM s LEFT JOIN l ON l.source = s.id GROUP BY file_id),
r AS (SELECT l_orderkey AS file_id, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS refs FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS file_id, o_custkey AS repository_id, coalesce(chunks, '') AS chunks, coalesce(symbols, '') AS symbols, coalesce(refs, '') AS refs, f.links AS links FROM orders LEFT JOIN a ON a.file_id = o_orderkey LEFT JOIN b ON b.file_id = o_orderkey LEFT JOIN r ON r.file_id = o_orderkey
LEFT JOIN l f ON f.source = o_orderkey""")
def repositories(spark: SparkSession, sf: str) -> DataFrame:
    """orders as files of their customer's repository, lines as chunks and symbols, with relationships and references nested."""
    got = G.rebuilt(*canonical_tables(spark, sf))
    told = lambda c: F.coalesce(F.array_join(F.array_sort(F.transform(c, lambda x: x["target_id"])), "+"), F.lit(""))
    chunks = F.transform("chunks", lambda x: F.concat_ws(":", x["start_line"], x["id"], told(x["links"])))
    symbols = F.transform("symbols", lambda x: F.concat_ws(":", x["qualified_name"], told(x["links"])))
    refs = F.array_sort(F.array_distinct(F.transform("references", lambda x: x["target_id"].cast("string"))))
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return got.select(F.col("id").alias("file_id"), "repository_id", text(chunks).alias("chunks"), text(symbols).alias("symbols"), text(refs).alias("refs"), told(F.col("links")).alias("links"))


def canonical_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """files, symbols, chunks, relationships, references."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    id_ = F.lit(10**12) + F.col("l_orderkey") * 8 + F.col("l_linenumber")  # apart from the keys of orders
    chunks = li.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("start_line"), id_.alias("id")).distinct()
    symbols = chunks.filter("start_line % 2 = 0").select("file_id", F.concat(F.lit("sym"), "start_line").alias("qualified_name"), (-F.col("id")).alias("id"))
    link = lambda rows, source, target, kind: rows.select(F.concat_ws("-", F.lit(kind), source).alias("id"), source.alias("source_id"), target.alias("target_id"), F.lit(kind).alias("type"))
    links = link(chunks, F.col("id"), F.col("id") + 1, "next").unionByName(link(symbols, F.col("id"), -F.col("id"), "in")).unionByName(link(o, F.col("o_orderkey"), F.col("o_custkey"), "of"))
    refs = li.select(F.col("l_orderkey").alias("source_file_id"), id_.alias("id"), F.col("l_suppkey").alias("target_id")).distinct()
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repository_id")), symbols, chunks, links, refs


# --- streams -----------------------------------------------------------------------------------------


def _replayed(rows: DataFrame, end: DataFrame, path: str) -> DataFrame:
    """rows as one file of a stream, then the row of end three times, so that event time leaves all rows behind."""
    spark = rows.sparkSession
    rows.coalesce(1).write.parquet(path)
    for _ in range(3):
        end.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drained(stream: DataFrame, path: str) -> DataFrame:
    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).outputMode("append").format("parquet").start(f"{path}/out").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query("""WITH kinds AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), s AS (SELECT event_id, user_id AS key, ts FROM events, kinds WHERE event_type = a), c AS (SELECT user_id AS key, ts, event_id % 3 AS k FROM events, kinds WHERE event_type = b)
SELECT s.event_id, s.key, ['pending', 'delivering', 'failed', 'delivered'][coalesce(max(c.k) + 2, 1)] AS status, max(c.k) IS NULL AS orphan FROM s LEFT JOIN c ON c.key = s.key AND c.ts BETWEEN s.ts AND s.ts + INTERVAL 5 MINUTE GROUP BY s.event_id, s.key""")
def live_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """events of one type as deliveries, of another as their callbacks: two streams, each delivery with its strongest status or as an orphan."""
    path = shared_dir(spark)
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kinds = e.agg(F.min("event_type").alias("_a"), F.max("event_type").alias("_b"))
    key = F.col("user_id").cast("long").alias("key")
    sent = e.join(F.broadcast(kinds), F.col("event_type") == F.col("_a")).select(F.col("event_id").cast("long").alias("event_id"), key, "ts")
    status = F.element_at(F.array(F.lit("delivering"), F.lit("failed"), F.lit("delivered")), (F.col("event_id") % 3 + 1).cast("int"))
    back = e.join(F.broadcast(kinds), F.col("event_type") == F.col("_b")).select(key, "ts", status.alias("status"))
    end = e.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    one = _replayed(sent, end.select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("key"), "ts"), f"{path}/sent")
    two = _replayed(back, end.select(F.lit(-2).cast("long").alias("key"), "ts", F.lit("failed").alias("status")), f"{path}/back")
    return _drained(J.recovered_deliveries(one, two), path).filter("event_id >= 0").select("event_id", "key", "status", "orphan")


@query("""WITH w AS (SELECT user_id, to_timestamp(floor(epoch(ts) / 10) * 10)::TIMESTAMP - to_seconds(10 * k) AS start FROM events, (SELECT unnest(range(0, 6)) AS k)), n AS (SELECT user_id, start, count(*) AS n FROM w GROUP BY ALL)
SELECT user_id, start, n, user_id % 3 - 1 AS per_minute FROM n WHERE user_id % 3 > 0 AND n > user_id % 3 - 1""")
def live_rates(spark: SparkSession, sf: str) -> DataFrame:
    """events as a stream of requests: sliding minutes in which a user of a limited tier asked too often."""
    path = shared_dir(spark)
    e = table(spark, sf, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"))
    tiers = spark.createDataFrame([("open", -1), ("none", 0), ("one", 1)], "tier string, per_minute int")
    tier = F.element_at(F.array(F.lit("open"), F.lit("none"), F.lit("one")), (F.col("user_id") % 3 + 1).cast("int"))
    end = e.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), "ts")
    got = J.minute_counts(_replayed(e, end, f"{path}/in"), tiers, e.select("user_id").distinct().withColumn("tier", tier))
    return _drained(got, path).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "per_minute")


# --- plug-ins ----------------------------------------------------------------------------------------


def _records(text: str) -> list[tuple[str, str, str]]:
    return [(f"line/{k}", "number" if x[:1].isdigit() else "text", x) for k, x in enumerate(text.split("\n")) if x]


def _lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS k FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sort_order, 'line/' || k AS path, CASE WHEN regexp_matches(line, '^[0-9]') THEN 'number' ELSE 'text' END AS type, sha256(line) AS content_sha FROM l WHERE line <> ''""")
def adapter_rows(spark: SparkSession, sf: str) -> DataFrame:
    """documents through a format adapter as a table function, once per document by LATERAL."""
    E.adapter_function(spark, "inkwell_records", _records)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spark.sql("SELECT d.doc_id, r.sort_order, r.path, r.type, sha2(r.content, 256) AS content_sha FROM {docs} d, LATERAL inkwell_records(d.text) r", docs=docs)


@query("""SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS x, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'e', '')))::DOUBLE AS y FROM documents""")
def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents through an embedding provider."""
    embed = E.embedding(lambda: _lengths)
    got = table(spark, sf, "documents").select("doc_id", embed(F.col("text")).alias("_e"))
    return got.select("doc_id", F.element_at("_e", 1).cast("double").alias("x"), F.element_at("_e", 2).cast("double").alias("y"))


def _first_line(text: str) -> str:
    return text.split("\n")[0]


@query("""SELECT doc_id, sha256(string_split(coalesce(text, ''), chr(10))[1]) AS compressed_sha, round(length(string_split(coalesce(text, ''), chr(10))[1]) / greatest(length(coalesce(text, '')), 1), 4) AS compression_ratio FROM documents""")
def compressed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """documents through a chunk compressor."""
    got = E.compression(_first_line)(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return got.select("doc_id", F.sha2("compressed", 256).alias("compressed_sha"), "compression_ratio")


@query("""WITH d AS (SELECT source, text, min(doc_id) AS doc_id FROM documents GROUP BY source, text), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS n FROM d) SELECT source, doc_id, n FROM r WHERE n <= 3""")
def staged_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """A ranking strategy and a context builder as stages: one document per text, the three longest per source."""
    from pyspark.sql import Window

    once = lambda rows: rows.groupBy("source", "text").agg(F.min("doc_id").alias("doc_id"))
    longest = lambda rows: rows.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.length("text")), "doc_id"))).filter("n <= 3")
    return E.staged(table(spark, sf, "documents").select("doc_id", "source", "text"), once, longest).select("source", "doc_id", "n")
