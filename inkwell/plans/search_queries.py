"""Chunks and search over documents × benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filters as L
from ..operators import search as S
from ..operators import topk as K
from ..operators.chunking import chunk_table, packed_lines
from ..sources.store import written
from .registry import query, table

KEYS = ["document_id", "chunk_no"]
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)

CHUNKS = """
lines AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\r?\\n'), lambda l: trim(l, ' ') <> '') AS ls FROM documents),
folded AS (
  SELECT doc_id, ls, list_reduce(list_transform(ls, lambda l: {'t': length(l), 'g': 0, 'o': [0]}),
    lambda a, x: CASE WHEN a.t + x.t <= 2000 THEN {'t': a.t + x.t, 'g': a.g, 'o': list_append(a.o, a.g)}
                      ELSE {'t': x.t, 'g': a.g + 1, 'o': list_append(a.o, a.g + 1)} END) AS f
  FROM lines WHERE len(ls) > 0),
numbered AS (
  SELECT doc_id, unnest(ls) AS line, unnest(f.o) AS g, generate_subscripts(ls, 1) AS pos, f.g AS last FROM folded),
tails AS (SELECT doc_id, sum(length(line)) AS tail FROM numbered WHERE g = last GROUP BY doc_id),
placed AS (
  SELECT n.doc_id, n.pos, n.line, CASE WHEN n.g = n.last AND t.tail < 500 AND n.last > 0 THEN n.g - 1 ELSE n.g END AS chunk_no
  FROM numbered n JOIN tails t USING (doc_id)),
packed AS (
  SELECT doc_id, chunk_no, count(*) AS n_lines, sum(length(line)) AS n_chars, string_agg(line, chr(10) ORDER BY pos) AS content
  FROM placed GROUP BY doc_id, chunk_no),
parts AS (
  SELECT p.*, count(*) OVER (PARTITION BY p.doc_id) AS k FROM packed p),
chunks AS (
  SELECT d.lang AS namespace, d.source AS user_id, p.doc_id AS document_id, p.chunk_no, p.doc_id || '-' || p.chunk_no AS chunk_id,
         p.content, p.n_lines, p.n_chars, CASE WHEN k > 1 THEN 'part ' || (p.chunk_no + 1) ELSE 'Root' END AS section_path,
         'doc_' || p.doc_id || '.txt' || CASE WHEN k > 1 THEN '/part ' || (p.chunk_no + 1) ELSE '' END AS path
  FROM parts p JOIN documents d USING (doc_id))"""


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2)"


def bm25_sql(name: str, text: str) -> str:
    """CTEs name_p (index), name_h (hits), name (scores), over chunks and terms(query_id, term)."""
    return f"""
{name}_t AS (SELECT document_id, chunk_no, {tokens_sql(text)} AS ts FROM chunks),
{name}_p AS (SELECT document_id, chunk_no, len(ts) AS dl, term, count(*) AS tf FROM (SELECT document_id, chunk_no, ts, unnest(ts) AS term FROM {name}_t) GROUP BY ALL),
{name}_h AS (SELECT t.query_id, p.* FROM {name}_p p JOIN terms t USING (term)),
{name}_m AS (SELECT DISTINCT query_id, document_id, chunk_no, dl FROM {name}_h),
{name}_s AS (SELECT query_id, count(*) AS n, avg(dl) AS a FROM {name}_m GROUP BY query_id),
{name}_d AS (SELECT query_id, term, count(*) AS df, any_value(s.n) AS n, any_value(s.a) AS a FROM {name}_h JOIN {name}_s s USING (query_id) GROUP BY query_id, term),
{name}_i AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM {name}_d),
{name}_w AS (SELECT m.query_id, p.term, count(*) AS df FROM {name}_m m JOIN {name}_p p USING (document_id, chunk_no)
             WHERE m.query_id IN (SELECT query_id FROM {name}_i WHERE idf < 0) GROUP BY m.query_id, p.term),
{name}_v AS (SELECT w.query_id, avg(ln(s.n - w.df + 0.5) - ln(w.df + 0.5)) AS mean FROM {name}_w w JOIN {name}_s s USING (query_id) GROUP BY w.query_id),
{name} AS (SELECT h.query_id, h.document_id, h.chunk_no,
             sum((CASE WHEN i.idf < 0 THEN 0.25 * v.mean ELSE i.idf END) * h.tf * 2.5 / (h.tf + 1.5 * (0.25 + 0.75 * h.dl / i.a))) AS score
           FROM {name}_h h JOIN {name}_i i USING (query_id, term) LEFT JOIN {name}_v v USING (query_id) GROUP BY h.query_id, h.document_id, h.chunk_no)"""


TERMS = f"""
queries AS (SELECT item_id AS query_id, text AS query FROM benchmark),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens_sql("query")}) AS term FROM queries) WHERE term NOT IN ({STOP}))"""

TERM_SEARCH = f"""
asked AS (SELECT q.query_id, lower(trim(q.query, ' ')) AS whole, list(t.term) AS ts FROM queries q JOIN terms t USING (query_id) GROUP BY q.query_id, q.query),
texts AS (SELECT document_id, chunk_no, lower(content || chr(10) || path) AS low FROM chunks),
term AS (SELECT query_id, document_id, chunk_no, CASE WHEN full_ THEN 100.0 ELSE hits END AS score FROM (
  SELECT query_id, document_id, chunk_no, contains(low, whole) AS full_, len(list_filter(ts, lambda t: contains(low, t)))::DOUBLE AS hits FROM asked, texts) WHERE full_ OR hits > 0)"""


def ranked_sql(name: str, k: int) -> str:
    return f"(SELECT *, '{name}' AS channel, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id, chunk_no) - 1 AS rank0 FROM {name} QUALIFY rank0 < {k})"


FUSED = f"""
path AS (SELECT * FROM path0),
ranked AS (SELECT query_id, document_id, chunk_no, channel, rank0 FROM {ranked_sql("content", 20)} UNION ALL BY NAME
           SELECT query_id, document_id, chunk_no, channel, rank0 FROM {ranked_sql("path", 20)} UNION ALL BY NAME
           SELECT query_id, document_id, chunk_no, channel, rank0 FROM {ranked_sql("term", 20)}),
fused AS (SELECT query_id, document_id, chunk_no, round(sum(CASE channel WHEN 'path' THEN 1.0 WHEN 'content' THEN 2.0 ELSE 1.5 END / (60 + rank0 + 1)), 6) AS score
          FROM ranked GROUP BY query_id, document_id, chunk_no),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_no) - 1 AS rank0 FROM fused QUALIFY rank0 < 10)"""
HYBRID = f"WITH {CHUNKS}, {TERMS}, {bm25_sql('content', 'content')}, {bm25_sql('path0', chr(39) + chr(39) + ' || path || ' + chr(39) + ' ' + chr(39) + ' || section_path')}, {TERM_SEARCH}, {FUSED}"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table, made once."""
    return written(chunk_table(docs(spark, sf)), codec="zstd")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


UUID = "substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr(h,18,3)||'-'||substr(h,21,12)"


@query(f"""WITH {CHUNKS}, hashed AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(content)) AS h FROM packed)
SELECT doc_id, chunk_no, n_lines, n_chars, sha256(content) AS content_sha, {UUID} AS chunk_id FROM hashed""")
def chunk_pack(spark: SparkSession, sf: str) -> DataFrame:
    out = packed_lines(docs(spark, sf))
    return out.select("doc_id", "chunk_no", "n_lines", "n_chars", F.sha2("content", 256).alias("content_sha"), T.uuid5(F.col("content")).alias("chunk_id"))


@query(r"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS size, len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?')) AS n_tokens,
  len(regexp_extract_all(t, '[\x{4e00}-\x{9fff}]')) AS zh, length(t) - length(regexp_replace(t, '[A-Za-z0-9_]', '', 'g')) AS plain FROM c)
SELECT doc_id, n_tokens, CASE WHEN n_tokens > 0 AND zh / n_tokens >= 0.3 THEN 'zh' ELSE 'en' END AS language,
  CASE WHEN size = 0 THEN 0 ELSE greatest(1, floor(greatest(zh / 1.5 + plain / 4.0 + (size - zh - plain) / 3.0, size / 2.5))) END AS estimate FROM n""")
def token_profile(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf).select("doc_id", T.token_count(t).alias("n_tokens"), T.language(t).alias("language"), T.token_estimate(t).alias("estimate"))


@query(f"""WITH {CHUNKS}, {TERMS}, {bm25_sql("content", "content")},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id, chunk_no) - 1 AS rank0 FROM content QUALIFY rank0 < 10)
SELECT b.query_id, b.document_id, b.chunk_no, b.rank0, round(b.score, 6) AS score, c.chunk_id, c.section_path FROM best b JOIN chunks c USING (document_id, chunk_no)""")
def bm25_content(spark: SparkSession, sf: str) -> DataFrame:
    chunks = corpus(spark, sf)
    best = K.bm25_top(K.packed(chunks, T.tokens(F.col("content")), KEYS), S.query_terms(asked(spark, sf)), 10).withColumn("score", F.round("score", 6))
    return L.cited(best.join(chunks.select(*KEYS, "chunk_id", "section_path"), KEYS)).drop("citation")


@query(f"""WITH {CHUNKS}, {TERMS}, {TERM_SEARCH}
SELECT query_id, document_id, chunk_no, rank0, score FROM {ranked_sql("term", 10)}""")
def term_search(spark: SparkSession, sf: str) -> DataFrame:
    chunks = corpus(spark, sf)
    return K.term_top(chunks, F.concat_ws("\n", F.col("content"), F.col("path")), asked(spark, sf), KEYS, 10)


@query(f"""WITH {CHUNKS}, {TERMS}, own AS (SELECT document_id, chunk_no, unnest(list_distinct({tokens_sql("content")})) AS term FROM chunks),
content AS (SELECT query_id, document_id, chunk_no, count(*)::DOUBLE AS score FROM own JOIN terms USING (term) GROUP BY ALL)
SELECT query_id, document_id, chunk_no, rank0, score FROM {ranked_sql("content", 10)}""")
def overlap_search(spark: SparkSession, sf: str) -> DataFrame:
    index = K.packed(chunk_table(docs(spark, sf)), T.tokens(F.col("content")), KEYS)
    return K.overlap_top(index, S.query_terms(asked(spark, sf)), 10)


@query(f"{HYBRID} SELECT query_id, document_id, chunk_no, rank0, score FROM best")
def hybrid_discovery(spark: SparkSession, sf: str) -> DataFrame:
    return K.hybrid(corpus(spark, sf), asked(spark, sf))


@query(f"""{HYBRID}, sections AS (
SELECT b.query_id, b.document_id, c.section_path, min(b.rank0) + 1 AS rank, min_by(c.chunk_id, b.rank0) AS chunk_id, max(b.score) AS score, count(*) AS n_chunks,
       sha256(string_agg(c.content, chr(10) ORDER BY b.rank0)) AS content_sha FROM best b JOIN chunks c USING (document_id, chunk_no) GROUP BY b.query_id, b.document_id, c.section_path)
SELECT *, CASE WHEN max(score) OVER w <= 0 THEN 0 WHEN max(score) OVER w = min(score) OVER w THEN 0.5
  ELSE round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) END AS norm_score FROM sections WINDOW w AS (PARTITION BY query_id)""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Fused rows merged by section, with scores from 0 to 1."""
    chunks = corpus(spark, sf)
    best = K.hybrid(chunks, asked(spark, sf)).join(chunks.select(*KEYS, "chunk_id", "section_path", "content"), KEYS)
    out = S.normalised(S.same_section(best, KEYS, F.col("section_path")), ["query_id"])
    return out.withColumn("content_sha", F.sha2("content", 256)).drop("content")


@query(f"""{HYBRID}, counts AS (SELECT query_id, document_id, count(*) AS n_rows FROM best GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_rows DESC, document_id) - 1 AS rank0 FROM counts QUALIFY rank0 < 5""")
def top_documents(spark: SparkSession, sf: str) -> DataFrame:
    return S.top_documents(K.hybrid(corpus(spark, sf), asked(spark, sf)))


@query(f"""{HYBRID}, firsts AS (SELECT b.query_id, b.document_id, c.section_path, min(b.rank0) AS r FROM best b JOIN chunks c USING (document_id, chunk_no)
WHERE c.section_path <> 'Root' GROUP BY ALL) SELECT query_id, document_id, string_agg(section_path, '|' ORDER BY r, section_path) AS paths FROM firsts GROUP BY ALL""")
def discovery_signals(spark: SparkSession, sf: str) -> DataFrame:
    chunks = corpus(spark, sf)
    best = K.hybrid(chunks, asked(spark, sf)).join(chunks.select(*KEYS, "section_path"), KEYS)
    return S.discovery_signals(best).withColumn("paths", F.array_join("paths", "|"))


MULTI = f"""WITH {CHUNKS},
queries AS (SELECT conv_id AS parent_id, turn AS step_id, conv_id || '/' || turn AS query_id, text AS query FROM conversations WHERE role = 'user'),
terms AS (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest({tokens_sql("query")}) AS term FROM queries) WHERE term NOT IN ({STOP})), {bm25_sql("content", "content")},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id, chunk_no) - 1 AS rank0 FROM content QUALIFY rank0 < 3),
refs AS (SELECT q.parent_id, q.step_id, b.rank0, b.document_id, b.chunk_no, row_number() OVER (PARTITION BY q.parent_id, b.document_id, b.chunk_no ORDER BY q.step_id, b.rank0) AS n
         FROM best b JOIN queries q USING (query_id))
SELECT parent_id, document_id, chunk_no, step_id, row_number() OVER (PARTITION BY parent_id ORDER BY step_id, rank0, document_id, chunk_no) - 1 AS position FROM refs WHERE n = 1"""


@query(MULTI)
def multi_query_workflow(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as steps of a conversation's plan: searched in one job, references united in step order."""
    from ..operators.assembly import union_references

    steps = table(spark, sf, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("parent_id"), F.col("turn").alias("step_id"), F.concat_ws("/", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    chunks = corpus(spark, sf)
    best = K.bm25_top(K.packed(chunks, T.tokens(F.col("content")), KEYS), S.query_terms(steps), 3).join(steps.select("query_id", "parent_id", "step_id"), "query_id")
    return union_references(best, KEYS).select("parent_id", *KEYS, "step_id", "position")


@query(f"""WITH {CHUNKS}, queries AS (SELECT row_number() OVER (ORDER BY source, lang) AS query_id, source AS user_id, lang AS namespace, 200 AS top_k FROM (SELECT DISTINCT source, lang FROM documents)),
few AS (SELECT query_id FROM queries JOIN chunks USING (user_id, namespace) GROUP BY query_id, top_k HAVING count(*) <= top_k)
SELECT query_id, document_id, chunk_no, row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_no) - 1 AS rank0, 1.0 AS score, 'small_corpus_all' AS route
FROM queries JOIN chunks USING (user_id, namespace) WHERE query_id IN (SELECT query_id FROM few)""")
def small_corpus(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    pairs = docs(spark, sf).select(F.col("source").alias("user_id"), F.col("lang").alias("namespace")).distinct()
    queries = pairs.withColumn("query_id", F.row_number().over(Window.orderBy("user_id", "namespace"))).withColumn("top_k", F.lit(200))
    out = S.small_corpus(chunk_table(docs(spark, sf)), queries, ["user_id", "namespace"], KEYS)
    return out.select("query_id", *KEYS, "rank0", "score", "route")


@query(f"""WITH {CHUNKS}, banned AS (SELECT doc_id AS document_id FROM documents WHERE source = 'src1')
SELECT document_id, chunk_no FROM chunks WHERE document_id NOT IN (SELECT document_id FROM banned)
AND NOT (document_id IN (SELECT doc_id FROM documents WHERE source = 'src2') AND (section_path = 'part 2' OR starts_with(section_path, 'part 2 / ')))""")
def exclude_sections(spark: SparkSession, sf: str) -> DataFrame:
    d, chunks = docs(spark, sf), chunk_table(docs(spark, sf))
    banned = d.filter("source = 'src1'").select(F.col("doc_id").alias("document_id"))
    cut = d.filter("source = 'src2'").select(F.col("doc_id").alias("document_id"), F.lit("part 2").alias("section_path"))
    return L.without_sections(L.without_documents(chunks, banned), cut).select(*KEYS)


@query(f"""WITH {CHUNKS} SELECT document_id, chunk_no, contains(lower(section_path), 'art 1') AS kept, NOT contains(lower(section_path), 'art 1') AS left_over,
coalesce(nullif(trim(namespace), ''), 'default') AS namespace FROM chunks""")
def signal_paths(spark: SparkSession, sf: str) -> DataFrame:
    signals, path = F.array(F.lit("ART 1")), F.col("section_path")
    return chunk_table(docs(spark, sf)).select(*KEYS, L.by_signals(path, signals, "keep").alias("kept"), L.by_signals(path, signals, "delete").alias("left_over"), L.namespace_of(F.col("namespace")).alias("namespace"))


@query(f"""WITH {CHUNKS}, c AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS cite FROM benchmark), n AS (SELECT document_id, chunk_no, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS norm FROM chunks)
SELECT item_id, document_id, min(chunk_no) AS chunk_no FROM c JOIN n ON contains(norm, cite) GROUP BY item_id, document_id""")
def citation_containment(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.assembly import citations

    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("citation"))
    return citations(items, chunk_table(docs(spark, sf)), "item_id", KEYS).groupBy("item_id", "document_id").agg(F.min("chunk_no").alias("chunk_no"))


@query("""SELECT sha256(text) AS semantic_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1""")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.scans import duplicate_groups

    return duplicate_groups(docs(spark, sf))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM u),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])), 6) AS score FROM n q, n v WHERE q.vec_id % 100 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank0 FROM s QUALIFY rank0 < 10""")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth vector is a query against all vectors."""
    vectors = table(spark, sf, "embeddings")
    return S.vector_top(vectors, vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
