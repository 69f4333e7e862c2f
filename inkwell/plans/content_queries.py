"""Pages, tables, keywords, graph and canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import pages as P
from ..operators import sections as N
from ..operators import structure as R
from ..operators import tables as B
from ..operators.chunking import chunk_table, lines_of, packed_lines, surrounding
from ..sources import scans as X
from ..sources.store import dealt, written
from .registry import query, table
from .search_queries import CHUNKS, STOP, tokens_sql

PLAIN = """regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"""
for _name, _value in X.ENTITIES.items():
    PLAIN = f"replace({PLAIN}, '{_name}', '{_value.replace(chr(39), chr(39) * 2)}')"
PLAIN = f"trim(regexp_replace({PLAIN}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, sha256({PLAIN}) AS text_sha, length({PLAIN}) AS n_chars FROM pages")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    text = X.plain_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.sha2(text, 256).alias("text_sha"), F.length(text).alias("n_chars"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>(.*?)</h[1-6]>', 1)) AS level, unnest(regexp_extract_all(html, '(?is)<h([1-6])\\b[^>]*>(.*?)</h[1-6]>', 2)) AS title FROM pages)
SELECT page_id, level::INT AS level, title, count(*) AS n FROM h GROUP BY ALL""")
def html_headings(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.html_titles(table(spark, sf, "pages"), "page_id")
    return rows.groupBy("page_id", "level", "title").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, nullif(lower(regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\\.[A-Za-z0-9]{1,5}$')), '') AS suffix FROM pages""")
def url_type(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.url_suffix(F.col("url")).alias("suffix"))


PAGE_LINES = """pl AS (SELECT doc_id, (pos - 1) // 10 + 1 AS page, pos - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) AS pos FROM documents) WHERE trim(line, ' ') <> ''),
feats AS (SELECT doc_id, page, sum(length(line)) AS raw_text_length, round(sum(length(line)) / count(*), 4) AS text_density, count(*) AS lines, doc_id % 10 / 10.0 AS image_coverage, (doc_id % 17 = 0)::INT AS table_count, doc_id % 90 AS drawings_count,
  CASE WHEN page % 7 = 0 THEN 'landscape' ELSE 'portrait' END AS orientation FROM pl GROUP BY doc_id, page)"""


def page_features(spark: SparkSession, sf: str) -> DataFrame:
    """documents dealt to pages of ten lines; geometry, which the tables do not have, follows from the numbers."""
    lines = P.page_lines(table(spark, sf, "documents"), "doc_id", "text", per_page=10)
    rows = lines.groupBy("doc_id", "page").agg(F.sum(F.length("line")).alias("raw_text_length"), F.round(F.sum(F.length("line")) / F.count(F.lit(1)), 4).alias("text_density"))
    i = F.col("doc_id")
    return rows.withColumns({"image_coverage": i % 10 / 10.0, "table_count": (i % 17 == 0).cast("int"), "drawings_count": i % 90, "orientation": F.when(F.col("page") % 7 == 0, "landscape").otherwise("portrait")})


@query(f"""WITH {PAGE_LINES}, m AS (UNPIVOT (SELECT doc_id, page, raw_text_length::DOUBLE AS raw_text_length, text_density::DOUBLE AS text_density, image_coverage::DOUBLE AS image_coverage, table_count::DOUBLE AS table_count, drawings_count::DOUBLE AS drawings_count FROM feats)
ON raw_text_length, text_density, image_coverage, table_count, drawings_count INTO NAME metric VALUE value)
SELECT doc_id, metric, round(avg(value), 7) AS mean, round(quantile_cont(value, 0.5), 7) AS p50, round(quantile_cont(value, 0.9), 7) AS p90, min(value) AS least, min_by(page, (value, page)) AS least_page, max(value) AS most, min_by(page, (-value, page)) AS most_page
FROM m GROUP BY doc_id, metric""")
def page_profile(spark: SparkSession, sf: str) -> DataFrame:
    return P.profile(page_features(spark, sf), ["doc_id"], digits=7)


@query(f"""WITH {PAGE_LINES} SELECT doc_id, round(avg((orientation = 'landscape')::INT), 4) AS landscape, round(avg((raw_text_length < 50 AND image_coverage >= 0.5)::INT), 4) AS scan_like, round(avg((image_coverage >= 0.35)::INT), 4) AS image_heavy,
round(avg((table_count > 0 OR drawings_count >= 25)::INT), 4) AS table_signal FROM feats GROUP BY doc_id""")
def page_shape(spark: SparkSession, sf: str) -> DataFrame:
    return P.shape(page_features(spark, sf), ["doc_id"])


@query(f"""WITH {PAGE_LINES}, k AS (SELECT doc_id, page, CASE WHEN raw_text_length < 80 AND image_coverage < 0.02 AND drawings_count < 5 THEN 'low_content' WHEN orientation = 'landscape' THEN 'landscape'
WHEN image_coverage >= 0.35 AND raw_text_length < 250 THEN 'image_heavy' WHEN table_count > 0 OR drawings_count >= 80 THEN 'table_heavy' ELSE 'normal' END AS kind FROM feats),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY page) AS n FROM k)
SELECT doc_id, kind, count(*) AS n_pages, string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (n <= 8) AS pages FROM n GROUP BY doc_id, kind""")
def page_kinds(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = page_features(spark, sf).withColumn("kind", P.page_kind(c("raw_text_length"), c("image_coverage"), c("table_count"), c("drawings_count"), c("orientation"))["kind"])
    return P.kind_samples(rows, ["doc_id"]).withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


@query(f"""WITH {PAGE_LINES}, p AS (SELECT d.source, l.doc_id AS page, l.line FROM pl l JOIN documents d USING (doc_id)), n AS (SELECT source, count(DISTINCT page) AS k FROM p GROUP BY source)
SELECT source, line, count(DISTINCT page) AS n_pages FROM p JOIN n USING (source) GROUP BY source, line, k HAVING count(DISTINCT page) > greatest(floor(0.02 * k), 1)""")
def recurring_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source as pages: lines on more than 2 % of them."""
    d = table(spark, sf, "documents")
    rows = lines_of(d).join(d.select("doc_id", "source"), "doc_id").select("source", F.col("doc_id").alias("page"), "line")
    return P.recurring(rows, ["source"], share=0.02)


@query("""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[Tt]ion[a-z]+') AS m, string_split_regex(text, '[Tt]ion[a-z]+') AS s FROM documents),
r AS (SELECT doc_id, unnest(m) AS match, generate_subscripts(m, 1) AS i, s, m FROM p)
SELECT doc_id, i - 1 AS n, match, (coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INT AS "offset" FROM r""")
def text_grep(spark: SparkSession, sf: str) -> DataFrame:
    return P.grep(table(spark, sf, "documents"), "[Tt]ion[a-z]+", "doc_id").drop("snippet")


# --- tables ------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT o_custkey AS table_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS "row", o_orderkey::VARCHAR AS a, o_orderpriority AS b FROM orders)
SELECT table_id, 0 AS "row", c AS col, ['key', 'priority'][c + 1] AS value FROM (SELECT DISTINCT o_custkey AS table_id FROM orders), (SELECT unnest([0, 1]) AS c)
UNION ALL SELECT table_id, "row", 0, a FROM v UNION ALL SELECT table_id, "row", 1, CASE WHEN a::BIGINT % 5 = 0 THEN '' ELSE b END FROM v""")
def pipe_table_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's orders written as a pipe table and read again; some rows are too short, others too long."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderpriority")
    k = F.col("o_orderkey")
    line = F.concat(F.lit("| "), k, F.when(k % 5 == 0, F.lit(" |")).otherwise(F.concat(F.lit(" | "), "o_orderpriority", F.lit(" |"))), F.when(k % 7 == 1, F.lit(" more |")).otherwise(F.lit("")))
    body = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.when(k % 5 == 0, F.concat(F.lit("| "), k, F.lit(" |"))).otherwise(line).alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    text = body.select("doc_id", F.concat(F.lit("intro\n| key | priority |\n|---|---|\n"), "b", F.lit("\nend")).alias("text"))
    return B.pipe_cells(lines_of(text)).select(F.col("doc_id").alias("table_id"), "row", "col", "value")


@query("""SELECT n_regionkey AS table_id, 1 AS header_rows, 0 AS header_cols FROM nation GROUP BY n_regionkey UNION ALL SELECT 100 + s_nationkey, 1, 0 FROM supplier GROUP BY s_nationkey""")
def header_region(spark: SparkSession, sf: str) -> DataFrame:
    """nation and supplier as tables whose first row names the columns, numbers first."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("table_id"), "n_nationkey", "n_name")
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") + 100).cast("long").alias("table_id"), "s_suppkey", "s_name")
    return B.header_region(B.unpivoted(n, "table_id").unionByName(B.unpivoted(s, "table_id")), ["table_id"])


@query("""WITH h AS (SELECT l_orderkey AS table_id, CASE l_linenumber % 4 WHEN 0 THEN 'nan' WHEN 1 THEN 'p' || l_suppkey % 5 WHEN 2 THEN 'Unnamed: 3' ELSE l_returnflag END AS header, l_linenumber AS col FROM lineitem),
d AS (SELECT table_id, header, min(col) AS col FROM h WHERE trim(header) <> '' AND header <> 'nan' AND NOT starts_with(header, 'Unnamed') GROUP BY ALL) SELECT table_id, string_agg(header, ';' ORDER BY col, header) AS keywords FROM d GROUP BY table_id""")
def table_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order as header cells, some without a real name."""
    k = F.col("l_linenumber") % 4
    header = F.when(k == 0, "nan").when(k == 1, F.concat(F.lit("p"), F.col("l_suppkey") % 5)).when(k == 2, "Unnamed: 3").otherwise(F.col("l_returnflag"))
    return B.keywords(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("table_id"), header.alias("header"), F.col("l_linenumber").alias("col")), ["table_id"])


# --- keywords, graph, canonical records ----------------------------------------------------------------

KEYS = f"""ck AS (SELECT document_id, chunk_no, unnest(list_filter({tokens_sql("content")}, lambda t: NOT regexp_matches(t, '^[0-9]+[.,%]*$'))) AS keyword FROM chunks),
kw AS (SELECT * FROM ck WHERE keyword NOT IN ({STOP})), sizes AS (SELECT document_id, count(*) AS n_chunks FROM chunks GROUP BY document_id),
tf AS (SELECT document_id, keyword, count(*) AS tf, count(DISTINCT chunk_no) AS df FROM kw GROUP BY ALL),
tops AS (SELECT document_id, keyword, round(tf * (ln(n_chunks / df) + 1), 6) AS weight, row_number() OVER (PARTITION BY document_id ORDER BY round(tf * (ln(n_chunks / df) + 1), 6) DESC, keyword) - 1 AS rank0
  FROM tf JOIN sizes USING (document_id) QUALIFY rank0 < 10)"""
EDGES = f"""WITH {CHUNKS}, {KEYS}, ful AS (SELECT DISTINCT document_id, keyword FROM kw), wa AS (SELECT document_id, sum(length(keyword)) AS w FROM ful GROUP BY ALL), wb AS (SELECT document_id, sum(length(keyword)) AS w FROM tops GROUP BY ALL),
met AS (SELECT f.document_id AS a, t.document_id AS b, count(*) AS n_shared, sum(length(f.keyword)) AS s FROM ful f JOIN tops t ON f.keyword = t.keyword AND t.document_id < f.document_id GROUP BY ALL HAVING count(*) >= 3),
edges AS (SELECT least(a, b) AS source, greatest(a, b) AS target, n_shared, round(s / least(x.w, y.w), 4) AS weight FROM met JOIN wa x ON x.document_id = a JOIN wb y ON y.document_id = b WHERE s / least(x.w, y.w) >= 0.8)"""


def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    chunks = packed_lines(dealt(table(spark, sf, "documents")).filter("doc_id is not null"))
    return G.keyword_counts(chunks.select(F.col("doc_id").alias("document_id"), "chunk_no", "content"))


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword sets of documents, which are published in the order of their ids."""
    return G.keyword_sets(dealt(table(spark, sf, "documents"))).withColumn("_p", F.col("document_id"))


@query(f"WITH {CHUNKS}, {KEYS} SELECT * FROM tops")
def doc_keywords(spark: SparkSession, sf: str) -> DataFrame:
    return G.top_keywords(_keywords(spark, sf))


@query(f"{EDGES} SELECT * FROM edges")
def doc_graph(spark: SparkSession, sf: str) -> DataFrame:
    return G.set_edges(_sets(spark, sf))


@query(f"""{EDGES}, ends AS (SELECT source AS node, target AS other, weight FROM edges UNION ALL SELECT target, source, weight FROM edges)
SELECT node, count(*) AS degree, round(sum(weight), 4) AS weight, min(other) AS least_neighbour FROM ends GROUP BY node""")
def graph_degree(spark: SparkSession, sf: str) -> DataFrame:
    return G.set_degrees(_sets(spark, sf))


@query(f"WITH {CHUNKS} SELECT document_id, count(*) AS n_chunks, 'text' AS kinds FROM chunks GROUP BY document_id")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return G.nodes(chunk_table(table(spark, sf, "documents"))).select("document_id", "n_chunks", F.array_join(F.map_keys("types"), ",").alias("kinds"))


@query("""WITH r AS (SELECT doc_id, sha256(source || '|' || 'crawl') AS repository_id, 'doc_' || doc_id || '.txt' AS path, text FROM documents), f AS (SELECT *, sha256(path || '|' || repository_id) AS file_id FROM r)
SELECT doc_id, repository_id, file_id, sha256(repository_id || '|' || file_id || '|' || '1:1-' || len(string_split(text, chr(10))) || ':1') AS chunk_id, sha256(text) AS semantic_hash FROM f""")
def canonical_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    rows = d.withColumn("repository_id", T.canonical_id(F.col("source"), F.lit("crawl"))).withColumn("file_id", T.canonical_id(F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")), F.col("repository_id")))
    out = X.canonical_chunks(rows.withColumn("start_line", F.lit(1)).withColumn("end_line", F.size(F.split("text", "\n"))))
    return out.select("doc_id", "repository_id", "file_id", F.col("id").alias("chunk_id"), "semantic_hash")


@query("""WITH e AS (SELECT o_orderkey AS id FROM orders UNION ALL SELECT o_custkey + 10000000 FROM orders), l AS (SELECT l_orderkey + l_linenumber % 3 AS source, l_orderkey AS target FROM lineitem)
SELECT DISTINCT 'missing source' AS issue, source AS id FROM l WHERE source NOT IN (SELECT id FROM e) UNION ALL SELECT DISTINCT 'missing target', target FROM l WHERE target NOT IN (SELECT id FROM e)
UNION ALL SELECT 'duplicate', id FROM e GROUP BY id HAVING count(*) > 1""")
def entity_integrity(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    entities = o.select(F.col("o_orderkey").alias("id")).unionByName(o.select((F.col("o_custkey") + 10000000).alias("id")))
    links = li.select((F.col("l_orderkey") + F.col("l_linenumber") % 3).alias("source"), F.col("l_orderkey").alias("target"))
    return G.integrity(entities, links)


# --- lines -------------------------------------------------------------------------------------------

LINES = """ln AS (SELECT doc_id, pos - 1 AS line_no, line FROM (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\r?\\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\\r?\\n'), 1) AS pos FROM documents) WHERE trim(line, ' ') <> '')"""


@query(f"""WITH {LINES} SELECT doc_id, line_no, sha256(coalesce(first_value(line IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no DESC ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '')) AS before_sha,
sha256(coalesce(first_value(line IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), '')) AS after_sha FROM ln""")
def line_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = surrounding(lines_of(table(spark, sf, "documents")))
    return rows.select("doc_id", "line_no", F.sha2(F.coalesce("line_before", F.lit("")), 256).alias("before_sha"), F.sha2(F.coalesce("line_after", F.lit("")), 256).alias("after_sha"))


@query(f"""WITH {LINES}, h AS (SELECT *, length(line) < 40 AS is_head FROM ln), s AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM h)
SELECT doc_id, section_no, count(*) FILTER (NOT is_head) AS n_lines, sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_head), '')) AS content_sha FROM s GROUP BY doc_id, section_no HAVING count(*) FILTER (NOT is_head) > 0 OR section_no > 0""")
def line_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of under 40 characters as headings of one level; the others gather below them."""
    lines = lines_of(table(spark, sf, "documents"))
    rows = lines.withColumn("level", F.when(F.length("line") < 40, 1).otherwise(-1)).withColumn("title", F.concat(F.col("line_no"), F.lit(" "), F.col("line")))
    out = R.sections_from_lines(rows)
    return out.select("doc_id", "section_no", "n_lines", F.sha2("content", 256).alias("content_sha"))


@query(f"""WITH {CHUNKS} SELECT document_id, chunk_no, path, 'doc_' || document_id || '.txt' AS root, CASE WHEN contains(path, '/') THEN split_part(path, '/', 2) ELSE 'Root' END AS section FROM chunks""")
def path_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunk_table(table(spark, sf, "documents"))
    return rows.select("document_id", "chunk_no", "path", N.split_path(F.col("path"), F.concat(F.lit("doc_"), F.col("document_id"), F.lit(".txt"))).alias("_s")).select("document_id", "chunk_no", "path", "_s.*")
