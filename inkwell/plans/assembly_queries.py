"""Evidence, budgets, relevance, bundles and listings over documents × benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as R
from ..functions import text as T
from ..operators import assembly as A
from ..operators import topk as K
from ..operators import sections as N
from ..operators.chunking import chunk_table
from ..sources import scans as X
from .operations_queries import LIBRARY, library
from .registry import query, table
from .search_queries import CHUNKS, HYBRID, KEYS, asked, corpus

ESTIMATE = r"CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, floor(greatest(len(regexp_extract_all(content, '[\x{4e00}-\x{9fff}]')) / 1.5 + (length(content) - length(regexp_replace(content, '[A-Za-z0-9_]', '', 'g'))) / 4.0 + (length(regexp_replace(content, '[A-Za-z0-9_]', '', 'g')) - len(regexp_extract_all(content, '[\x{4e00}-\x{9fff}]'))) / 3.0, length(content) / 2.5))) END"


def found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = corpus(spark, sf)
    return K.hybrid(chunks, asked(spark, sf)).join(chunks.select(*KEYS, "chunk_id", "section_path", "content", F.col("chunk_no").alias("sort_order"), F.concat(F.lit("doc_"), "document_id", F.lit(".txt")).alias("source_file_name")), KEYS)


@query(f"""{HYBRID}, r AS (SELECT b.query_id, b.document_id, b.chunk_no, c.section_path, c.content, lag(c.section_path) OVER w AS prev, row_number() OVER w AS n FROM best b JOIN chunks c USING (document_id, chunk_no)
WINDOW w AS (PARTITION BY b.query_id, b.document_id ORDER BY c.section_path, b.chunk_no)),
l AS (SELECT *, CASE WHEN prev IS NOT DISTINCT FROM section_path THEN '' ELSE '▸ ' || section_path || chr(10) END || array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: '┈ ' || x), chr(10)) AS part FROM r)
SELECT query_id, document_id, sha256('[Document] doc_' || document_id || '.txt' || chr(10) || string_agg(part, chr(10) ORDER BY n)) AS evidence_sha FROM l GROUP BY query_id, document_id""")
def evidence_text(spark: SparkSession, sf: str) -> DataFrame:
    return A.evidence_text(found(spark, sf)).select("query_id", "document_id", F.sha2("evidence", 256).alias("evidence_sha"))


@query(f"""{HYBRID}, r AS (SELECT b.query_id, b.rank0, c.content, {ESTIMATE} AS cost, row_number() OVER (PARTITION BY b.query_id, c.content ORDER BY b.rank0) AS n FROM best b JOIN chunks c USING (document_id, chunk_no)),
u AS (SELECT query_id, rank0, sum(cost) OVER (PARTITION BY query_id ORDER BY rank0) AS used_tokens FROM r WHERE n = 1) SELECT * FROM u WHERE used_tokens <= 3000""")
def budget_context(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct chunk texts in rank order within 3,000 estimated tokens per query."""
    return A.context(found(spark, sf), 3000).select("query_id", "rank0", "used_tokens")


@query(f"""{HYBRID}, n AS (SELECT query_id, document_id, count(*) AS n_chunks FROM best GROUP BY ALL)
SELECT query_id, document_id, n_chunks, least(greatest(floor(8000 * n_chunks / sum(n_chunks) OVER (PARTITION BY query_id)), 500), 8000)::BIGINT AS cap FROM n""")
def doc_caps(spark: SparkSession, sf: str) -> DataFrame:
    return A.doc_caps(found(spark, sf).groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("n_chunks")), 8000, 500)


@query(f"""WITH {LIBRARY}, hints AS (SELECT document_id, section_path, 0.5 + (sort_order % 5) / 10.0 AS score FROM sections WHERE section_title IN ('en', 'short')),
s AS (SELECT x.document_id, x.section_path, CASE WHEN h.section_path = x.section_path THEN h.score WHEN starts_with(x.section_path, h.section_path || ' / ') THEN 0.9 * h.score WHEN starts_with(h.section_path, x.section_path || ' / ') THEN 0.65 * h.score END AS v
FROM sections x JOIN hints h USING (document_id)) SELECT x.document_id, x.section_path, round(CASE WHEN max(v) IS NULL THEN 0.0 ELSE least(max(v), 1.0) END, 6) AS relevance FROM sections x LEFT JOIN s USING (document_id, section_path) GROUP BY ALL""")
def section_relevance(spark: SparkSession, sf: str) -> DataFrame:
    tree = N.section_table(library(spark, sf))
    hints = tree.filter(F.col("section_title").isin("en", "short")).select("document_id", "section_path", (0.5 + (F.col("sort_order") % 5) / 10.0).alias("score"))
    return A.section_relevance(tree, hints).select("document_id", "section_path", F.round("relevance", 6).alias("relevance"))


@query(f"""WITH {LIBRARY} SELECT document_id, '{{"version":"2.0","document_id":"' || document_id || '","statistics":{{"total":' || count(*) || ',"text":' || count(*) FILTER (chunk_type = 'text') || ',"image":' || count(*) FILTER (chunk_type = 'image') || ',"table":' || count(*) FILTER (chunk_type = 'table') || '}}}}' AS manifest FROM lib GROUP BY document_id""")
def manifests(spark: SparkSession, sf: str) -> DataFrame:
    return X.manifests(library(spark, sf))


@query(r"""SELECT event_id, list_filter(list_transform(string_split(event_type || ';' || event_id || ';x', ';'), lambda x: trim(x)), lambda x: length(x) > 1) AS keywords, list_transform(regexp_extract_all(event_id || ';' || user_id, '[0-9]+'), lambda x: x::INT) AS pages FROM events""")
def keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", R.keyword_list(F.concat_ws(";", "event_type", "event_id", F.lit("x"))).alias("keywords"), R.page_list(F.concat_ws(";", "event_id", "user_id")).alias("pages"))


@query(f"""WITH {CHUNKS}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id, namespace ORDER BY document_id, chunk_no) AS n FROM chunks) SELECT user_id, namespace, document_id, chunk_no FROM p WHERE n > 10 AND n <= 20""")
def chunk_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of ten chunks of each user and namespace."""
    return N.paged(chunk_table(table(spark, sf, "documents")), ["user_id", "namespace"], KEYS, 2, 10).select("user_id", "namespace", *KEYS)


@query("""SELECT doc_id, sha256(coalesce(text, '') || '|10|' || source || ',' || lang) AS digest FROM documents WHERE source <= lang UNION ALL SELECT doc_id, sha256(coalesce(text, '') || '|10|' || lang || ',' || source) FROM documents WHERE source > lang""")
def shape_digests(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of queries: text, top_k and a list whose order does not matter."""
    return table(spark, sf, "documents").select("doc_id", T.shape_digest(F.col("text"), F.lit(10), T.listed(F.array("source", "lang"))).alias("digest"))


@query("""WITH r AS (SELECT o_custkey AS table_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
e AS (SELECT *, i <= 3 OR i > n - 3 AS edge FROM r), h AS (SELECT *, row_number() OVER (PARTITION BY table_id, edge ORDER BY o_orderkey * 7919 % 1009, o_orderkey) AS h FROM e) SELECT table_id, o_orderkey FROM h WHERE n <= 10 OR edge OR h <= 3""")
def edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Head, middle and tail of each customer's orders; the middle is drawn by a hash that SQL has, too."""
    from ..operators.tables import sampled_rows

    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("table_id"), "o_orderkey")
    return sampled_rows(rows, ["table_id"], "o_orderkey", 3, F.col("o_orderkey") * 7919 % 1009)
