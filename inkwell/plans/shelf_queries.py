"""Scopes, hydration, links, assembly and navigation over a shelf: documents dealt to files of twenty chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as R
from ..functions import text as T
from ..operators import assembly as A
from ..operators import chunking as C
from ..operators import filters as L
from ..operators import graph as G
from ..operators import sections as N
from ..operators import structure as U
from ..sources import scans as X
from .registry import query, table


def shelf(spark: SparkSession, sf: str) -> DataFrame:
    """documents as chunks: twenty to a file, in chapters and sections, some of them images and tables that texts refer to."""
    k, d = F.pmod(F.col("doc_id"), F.lit(20)), F.floor(F.col("doc_id") / 20).cast("long")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("text", "text", "text", "image", "table")]), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.when(k < 2, F.lit("Root")).otherwise(F.concat(F.lit("chap "), F.floor(k / 8), F.lit(" / sec "), F.floor(k / 4), F.when(k % 4 == 3, F.lit(" / leaf")).otherwise(F.lit(""))))
    media = F.concat(F.when(kind == "image", "images/i").otherwise("tables/t"), F.col("doc_id"), F.when(kind == "image", ".png").otherwise(".html"))
    ahead = F.col("doc_id") + 1 + F.col("doc_id") % 2
    goes = (kind == "text") & (F.floor(ahead / 20) == d) & (ahead % 5 >= 3)
    ref = F.concat(F.when(ahead % 5 == 3, "[images/i").otherwise("[tables/t"), ahead, F.when(ahead % 5 == 3, ".png]").otherwise(".html]"))
    one = F.struct(F.concat(F.lit(" c"), ahead).alias("target"), F.lit("embeds").alias("relation"), ref.alias("ref"))
    rows = table(spark, sf, "documents").withColumn("text", T.text_or_empty(F.col("text")))
    return rows.select(
        d.alias("document_id"), (d % 3).alias("revision_id"), F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"), k.alias("sort_order"), path.alias("section_path"), kind.alias("chunk_type"),
        F.when(goes, F.concat("text", F.lit("\n"), ref)).otherwise(F.col("text")).alias("content"), F.when(kind != "text", media).alias("file_path"), F.when(kind != "text", media).otherwise(F.concat(F.lit("file"), d, F.lit("/"), k)).alias("path"),
        F.when(goes, F.array(one)).otherwise(F.array().cast("array<struct<target:string,relation:string,ref:string>>")).alias("connect_to"), F.when(F.col("doc_id") % 3 == 0, F.substring("text", 1, 30)).alias("summary"),
        F.concat(F.lit("file"), d, F.lit(".txt")).alias("source_file_name"), "lang", "source",
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """The shelf's files: owner, namespace, state, current revision, time."""
    rows = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 20).cast("long").alias("document_id")).agg(F.min("source").alias("user_id"), F.min("lang").alias("namespace"))
    d = F.col("document_id")
    return rows.select("document_id", "user_id", F.when(d % 6 == 0, "  ").otherwise(F.col("namespace")).alias("namespace"), F.when(d % 7 == 0, "archived").otherwise("active").alias("status"), (d % 2 + d % 3 * (d % 2 == 0).cast("int")).alias("current_revision_id"), (d * 13 % 101).alias("updated_at"))


SHELF = """docs0 AS (SELECT doc_id, coalesce(text, '') AS text, lang, source FROM documents),
base AS (SELECT *, doc_id // 20 AS d, doc_id % 20 AS k, ['text', 'text', 'text', 'image', 'table'][doc_id % 5 + 1] AS kind, doc_id + 1 + doc_id % 2 AS ahead FROM docs0),
linked AS (SELECT *, kind = 'text' AND ahead // 20 = d AND ahead % 5 >= 3 AS goes, CASE WHEN ahead % 5 = 3 THEN '[images/i' || ahead || '.png]' ELSE '[tables/t' || ahead || '.html]' END AS ref,
  CASE WHEN kind = 'image' THEN 'images/i' || doc_id || '.png' ELSE 'tables/t' || doc_id || '.html' END AS media FROM base),
shelf AS (SELECT d AS document_id, d % 3 AS revision_id, 'c' || doc_id AS chunk_id, k AS sort_order,
  CASE WHEN k < 2 THEN 'Root' ELSE 'chap ' || (k // 8) || ' / sec ' || (k // 4) || CASE WHEN k % 4 = 3 THEN ' / leaf' ELSE '' END END AS section_path, kind AS chunk_type,
  CASE WHEN goes THEN text || chr(10) || ref ELSE text END AS content, CASE WHEN kind <> 'text' THEN media END AS file_path, CASE WHEN kind <> 'text' THEN media ELSE 'file' || d || '/' || k END AS path,
  CASE WHEN goes THEN 'c' || ahead END AS target, CASE WHEN goes THEN ref END AS ref, CASE WHEN doc_id % 3 = 0 THEN left(text, 30) END AS summary, 'file' || d || '.txt' AS source_file_name, lang, source FROM linked),
files AS (SELECT d AS document_id, min(source) AS user_id, CASE WHEN d % 6 = 0 THEN '  ' ELSE min(lang) END AS namespace, CASE WHEN d % 7 = 0 THEN 'archived' ELSE 'active' END AS status,
  d % 2 + d % 3 * (d % 2 = 0)::INT AS current_revision_id, d * 13 % 101 AS updated_at FROM base GROUP BY d),
parts AS (SELECT *, CASE WHEN section_path = 'Root' THEN []::VARCHAR[] ELSE string_split(section_path, ' / ') END AS ps FROM shelf),
ups AS (SELECT *, unnest(CASE WHEN len(ps) = 0 THEN ['Root'] ELSE list_transform(range(1, len(ps) + 1), lambda i: array_to_string(ps[1:i], ' / ')) END) AS spot,
  unnest(CASE WHEN len(ps) = 0 THEN [0] ELSE range(0, len(ps)) END) AS dep FROM parts),
tree AS (SELECT document_id, spot AS section_path, any_value(CASE WHEN spot = 'Root' THEN 0 ELSE dep + 1 END) AS section_level, any_value(CASE WHEN dep > 0 THEN array_to_string(ps[1:dep], ' / ') END) AS parent_path,
  any_value(CASE WHEN spot = 'Root' THEN 'Root' ELSE ps[dep + 1] END) AS section_title, row_number() OVER (PARTITION BY document_id ORDER BY min({'o': sort_order, 'd': dep}), spot) - 1 AS sort_order FROM ups GROUP BY document_id, spot)"""


# --- scopes ------------------------------------------------------------------------------------------


@query(f"""WITH {SHELF}, f AS (SELECT *, coalesce(nullif(trim(namespace), ''), 'default') AS ns FROM files), q AS (SELECT DISTINCT user_id || '/' || ns AS query_id, user_id, ns FROM f)
SELECT q.query_id, s.document_id, s.chunk_id, t.section_title, t.section_level FROM q JOIN f USING (user_id, ns) JOIN shelf s ON s.document_id = f.document_id AND s.revision_id = f.current_revision_id
LEFT JOIN tree t ON t.document_id = s.document_id AND t.section_path = s.section_path WHERE f.status = 'active'""")
def scoped_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """What each user may search in each namespace."""
    s, f = shelf(spark, sf), files(spark, sf)
    asked = f.select("user_id", L.namespace_of(F.col("namespace")).alias("namespace")).distinct().withColumn("query_id", F.concat_ws("/", "user_id", "namespace"))
    return L.in_scope(s, f, asked, N.section_table(s)).select("query_id", "document_id", "chunk_id", "section_title", "section_level")


@query(f"""WITH {SHELF} SELECT s.document_id, count(*) AS total, count(*) FILTER (chunk_type = 'text') AS text, count(*) FILTER (chunk_type = 'image') AS image, count(*) FILTER (chunk_type = 'table') AS "table" FROM shelf s
JOIN files f ON f.document_id = s.document_id AND f.current_revision_id = s.revision_id WHERE f.status = 'active' GROUP BY ALL""")
def bundle_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return N.statistics(L.scoped(shelf(spark, sf), files(spark, sf)), ["document_id"])


@query(f"""WITH {SHELF} SELECT f.user_id, count(*) AS n_chunks, count(DISTINCT s.document_id) AS n_documents, round(count(*) / count(DISTINCT s.document_id), 4) AS chunks_per_document FROM shelf s JOIN files f USING (document_id) GROUP BY ALL""")
def corpus_inventory(spark: SparkSession, sf: str) -> DataFrame:
    rows = shelf(spark, sf).join(files(spark, sf).select("document_id", "user_id"), "document_id")
    return N.inventory(rows, ["user_id"])


@query(f"""WITH {SHELF}, n AS (SELECT document_id, count(*) AS n_chunks, count(*) FILTER (chunk_type <> 'text') AS n_media FROM shelf GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, namespace ORDER BY updated_at DESC, document_id) AS n FROM files WHERE status = 'active')
SELECT document_id, user_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_media, 0) AS n_media FROM r LEFT JOIN n USING (document_id) WHERE n <= 50""")
def document_overview(spark: SparkSession, sf: str) -> DataFrame:
    return N.overview(shelf(spark, sf), files(spark, sf)).select("document_id", "user_id", "n_chunks", "n_media")


@query(f"""WITH {SHELF}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, namespace ORDER BY updated_at DESC, document_id) AS n FROM files WHERE status <> 'archived') SELECT document_id, user_id FROM r WHERE n <= 3""")
def newest_documents(spark: SparkSession, sf: str) -> DataFrame:
    return A.listed_documents(files(spark, sf), 3).select("document_id", "user_id")


@query(f"""WITH {SHELF} SELECT document_id, CASE WHEN document_id % 4 = 1 THEN 'archived' ELSE status END AS status, CASE WHEN document_id % 4 = 1 THEN 7 END AS archived_at FROM files""")
def archived_documents(spark: SparkSession, sf: str) -> DataFrame:
    f = files(spark, sf).withColumn("archived_at", F.lit(None).cast("int"))
    return A.archived(f, f.filter("document_id % 4 = 1"), F.lit(7)).select("document_id", "status", "archived_at")


@query(f"""WITH {SHELF} SELECT chunk_id, t AS data_type FROM shelf, (SELECT unnest(range(1, 7)) AS t) WHERE CASE t WHEN 2 THEN chunk_type = 'text' WHEN 3 THEN chunk_type = 'image' WHEN 4 THEN chunk_type = 'table' WHEN 5 THEN chunk_type IN ('text', 'image') WHEN 6 THEN chunk_type IN ('text', 'table') ELSE TRUE END""")
def chunk_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = shelf(spark, sf).withColumn("data_type", F.explode(F.sequence(F.lit(1), F.lit(6))))
    return rows.filter(L.types_allowed(F.col("chunk_type"), F.col("data_type"))).select("chunk_id", "data_type")


@query(f"""WITH {SHELF} SELECT a.document_id, a.section_path AS path, b.section_path AS other, a.section_path = b.section_path OR starts_with(a.section_path, b.section_path || ' / ') AS same_or_below,
starts_with(b.section_path, a.section_path || ' / ') AS is_ancestor FROM tree a JOIN tree b USING (document_id) WHERE a.section_path <> 'Root' AND b.section_path <> 'Root'""")
def path_predicates(spark: SparkSession, sf: str) -> DataFrame:
    t = N.section_table(shelf(spark, sf)).filter("section_path <> 'Root'").select("document_id", "section_path")
    both = t.withColumnRenamed("section_path", "path").join(t.withColumnRenamed("section_path", "other"), "document_id")
    a, b = L.section_parts(F.col("path")), L.section_parts(F.col("other"))
    below = L.covered(a, F.array(b))
    return both.withColumn("same_or_below", below & L.same_or_below(F.col("path"), F.col("other"))).withColumn("is_ancestor", L.is_ancestor(a, b))


@query(f"""WITH {SHELF} SELECT chunk_id, CASE WHEN section_path = 'Root' THEN 'Root' ELSE section_path END AS normal, CASE WHEN section_path = 'Root' THEN 0 ELSE len(string_split(section_path, ' / ')) END AS depth FROM shelf""")
def section_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with stray blanks around their separators, brought to their normal form."""
    loose = F.concat(F.lit(" "), F.replace("section_path", F.lit(" / "), F.lit("  /   ")), F.lit(" "))
    return shelf(spark, sf).select("chunk_id", L.normal_section(loose).alias("normal"), F.size(L.section_parts(loose)).alias("depth"))


# --- hydration ---------------------------------------------------------------------------------------


@query(f"""WITH {SHELF}, r AS (SELECT * FROM shelf WHERE sort_order % 3 <> 1), t AS (SELECT DISTINCT document_id, revision_id, target FROM r WHERE chunk_type = 'text' AND target IS NOT NULL)
SELECT s.document_id, s.chunk_id, 0.0 AS score FROM shelf s JOIN t ON t.document_id = s.document_id AND t.revision_id = s.revision_id AND t.target = s.chunk_id WHERE s.sort_order % 3 = 1""")
def connected_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Media that found texts connect to and that were not found themselves."""
    s = shelf(spark, sf)
    return A.connected(s.filter("sort_order % 3 <> 1"), s).select("document_id", "chunk_id", "score")


@query(f"""WITH {SHELF} SELECT 'r' || chunk_id AS ref_id, document_id, CASE WHEN sort_order % 4 <> 3 THEN chunk_id END AS found_id FROM shelf""")
def reference_hydration(spark: SparkSession, sf: str) -> DataFrame:
    """References with their section, the file's name instead of Root, or an id that does not exist."""
    s = shelf(spark, sf)
    wanted = F.when(F.col("section_path") == "Root", F.col("source_file_name")).when(F.col("sort_order") % 5 == 0, F.lit("elsewhere")).otherwise(F.col("section_path"))
    refs = s.select(F.concat(F.lit("r"), F.col("chunk_id")).alias("ref_id"), "document_id", F.when(F.col("sort_order") % 4 == 3, F.concat(F.lit("x"), F.col("chunk_id"))).otherwise(F.col("chunk_id")).alias("chunk_id"), wanted.alias("section_path"))
    got = A.referenced(refs, s)
    return got.select("ref_id", "document_id", F.when(F.col("section_path").isNotNull(), F.col("chunk_id")).alias("found_id"))


MODES = ("outline", "self_only", "shallow", "chunks", "assets_only", "image_only", "table_only")


@query(f"""WITH {SHELF}, sel AS (SELECT document_id, section_path AS path, sort_order AS selection, ['outline', 'self_only', 'shallow', 'chunks', 'assets_only', 'image_only', 'table_only'][(sort_order + document_id) % 7 + 1] AS mode FROM tree),
m AS (SELECT u.document_id, u.chunk_id, l.selection, row_number() OVER (PARTITION BY u.document_id, u.chunk_id ORDER BY l.selection) AS n FROM ups u JOIN sel l ON l.document_id = u.document_id AND l.path = u.spot
WHERE CASE l.mode WHEN 'chunks' THEN TRUE WHEN 'shallow' THEN len(u.ps) - u.dep - 1 <= 1 OR spot = 'Root' WHEN 'assets_only' THEN chunk_type <> 'text' WHEN 'image_only' THEN chunk_type = 'image' WHEN 'table_only' THEN chunk_type = 'table' ELSE spot = 'Root' OR len(u.ps) = u.dep + 1 END)
SELECT document_id, chunk_id, selection FROM m WHERE n = 1""")
def path_hydration(spark: SparkSession, sf: str) -> DataFrame:
    """Every section selected with one of the seven modes in turn; a chunk comes with its first selection."""
    s = shelf(spark, sf)
    t = N.section_table(s)
    mode = F.element_at(F.array(*[F.lit(m) for m in MODES]), ((F.col("sort_order") + F.col("document_id")) % 7 + 1).cast("int"))
    chosen = t.select("document_id", F.col("section_path").alias("path"), F.col("sort_order").alias("selection"), mode.alias("mode"))
    return A.by_paths(chosen, s).select("document_id", "chunk_id", "selection")


@query(f"""WITH {SHELF}, e AS (SELECT DISTINCT document_id, target FROM shelf WHERE target IS NOT NULL),
body AS (SELECT s.document_id, s.chunk_id, trim(regexp_replace(regexp_replace(s.content, '\\[(images|tables)/[^\\]\\n]+\\]', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ') AS b, t.content AS more
  FROM shelf s LEFT JOIN shelf t ON t.document_id = s.document_id AND t.chunk_id = s.target AND t.chunk_type = 'table' WHERE (s.document_id, s.chunk_id) NOT IN (SELECT (document_id, target) FROM e))
SELECT document_id, chunk_id, sha256(b || CASE WHEN more IS NOT NULL THEN chr(10) || more ELSE '' END) AS content_sha FROM body""")
def result_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks as one result: embedded media go, connected tables follow their text."""
    s = shelf(spark, sf).withColumn("query_id", F.lit(1))
    got = A.assembled(s, s)
    return got.select("document_id", "chunk_id", F.sha2("content", 256).alias("content_sha"))


@query(f"""WITH {SHELF}, r AS (SELECT *, sort_order % 2 AS query_id, row_number() OVER (PARTITION BY sort_order % 2, document_id, chunk_id ORDER BY sort_order) AS n FROM shelf)
SELECT query_id, document_id, chunk_id, CASE WHEN section_path = 'Root' THEN source_file_name ELSE section_path END AS section_path FROM r WHERE n = 1""")
def result_references(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf).withColumn("query_id", F.col("sort_order") % 2).withColumn("position", F.col("sort_order"))
    return A.referenced_ids(s.unionByName(s.withColumn("position", F.col("position") + 50))).select("query_id", "document_id", "chunk_id", "section_path")


COST = r"CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, floor(greatest((length(content) - length(regexp_replace(content, '[A-Za-z0-9_]', '', 'g'))) / 4.0 + length(regexp_replace(content, '[A-Za-z0-9_]', '', 'g')) / 3.0, length(content) / 2.5))) END"


@query(f"""WITH {SHELF}, c AS (SELECT document_id AS query_id, chunk_id, sort_order % 3 AS confidence, sort_order % 4 AS discovery, sort_order % 5 AS importance, {COST} AS cost FROM shelf),
u AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY confidence DESC, discovery DESC, importance DESC, cost, chunk_id) AS used_tokens FROM c) SELECT query_id, chunk_id, used_tokens FROM u WHERE used_tokens <= 4500""")
def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf).select(F.col("document_id").alias("query_id"), "chunk_id", "content", (F.col("sort_order") % 3).alias("confidence"), (F.col("sort_order") % 4).alias("discovery_score"), (F.col("sort_order") % 5).alias("importance"))
    return A.within_budget(s, 5000).select("query_id", "chunk_id", "used_tokens")


@query(f"""WITH {SHELF}, o AS (SELECT document_id, target AS chunk_id, min_by(section_path, sort_order) AS owner FROM shelf WHERE target IS NOT NULL GROUP BY ALL)
SELECT m.document_id, m.chunk_id, coalesce(o.owner, nullif(m.section_path, 'Root')) AS owner_path FROM shelf m LEFT JOIN o USING (document_id, chunk_id) WHERE m.chunk_type <> 'text' AND coalesce(o.owner, nullif(m.section_path, 'Root')) IS NOT NULL""")
def asset_owners(spark: SparkSession, sf: str) -> DataFrame:
    return A.asset_owners(shelf(spark, sf)).select("document_id", "chunk_id", "owner_path")


@query(f"""WITH {SHELF}, o AS (SELECT document_id, target AS chunk_id, min_by(section_path, sort_order) AS owner FROM shelf WHERE target IS NOT NULL GROUP BY ALL),
a AS (SELECT m.document_id, m.chunk_id, coalesce(o.owner, nullif(m.section_path, 'Root')) AS owner_path FROM shelf m LEFT JOIN o USING (document_id, chunk_id) WHERE m.chunk_type <> 'text' AND coalesce(o.owner, nullif(m.section_path, 'Root')) IS NOT NULL),
p AS (SELECT document_id, section_path FROM tree WHERE section_level < 3 AND (document_id + sort_order) % 3 > 0)
SELECT a.document_id, a.chunk_id, coalesce((SELECT max_by(section_path, length(section_path)) FROM p WHERE p.document_id = a.document_id AND (a.owner_path = p.section_path OR starts_with(a.owner_path, p.section_path || ' / '))), 'Root') AS placed_at FROM a""")
def placed_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Media placed at the nearest section that is shown."""
    s = shelf(spark, sf)
    shown = N.section_table(s).filter("section_level < 3 and (document_id + sort_order) % 3 > 0")
    return A.placed_assets(A.asset_owners(s), shown).select("document_id", "chunk_id", "placed_at")


# --- navigation --------------------------------------------------------------------------------------


@query(f"""WITH {SHELF}, f AS (SELECT document_id, section_path, min_by(summary, sort_order) AS s FROM shelf WHERE summary IS NOT NULL GROUP BY ALL) SELECT t.document_id, t.section_path, CASE WHEN t.section_level = 2 THEN 'own' ELSE f.s END AS summary FROM tree t LEFT JOIN f USING (document_id, section_path)""")
def summary_backfill(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf)
    found = s.filter("summary is not null").groupBy("document_id", "section_path").agg(F.min_by("summary", "sort_order").alias("summary"))
    t = N.section_table(s).withColumn("summary", F.when(F.col("section_level") == 2, "own"))
    return N.with_summaries(t, found).select("document_id", "section_path", "summary")


@query(f"""WITH {SHELF}, c AS (SELECT document_id, spot AS section_path, count(*) AS n_chunks, count(*) FILTER (chunk_type <> 'text') AS n_media FROM ups GROUP BY ALL)
SELECT t.document_id, t.section_path, row_number() OVER (PARTITION BY t.document_id ORDER BY t.sort_order % 2 DESC, n_chunks DESC, n_media DESC, t.sort_order) - 1 AS rank0 FROM tree t JOIN c USING (document_id, section_path)""")
def ranked_sections(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf)
    counts = N.rolled_up(N.direct_counts(s).withColumn("n_chars", F.lit(0)))
    all_ = s.withColumn("_at", F.explode(N._paths(F.col("section_path")))).groupBy("document_id", F.col("_at").alias("section_path")).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("chunk_type") != "text").alias("n_media"))
    rows = N.section_table(s).join(all_, ["document_id", "section_path"]).join(counts.select("document_id", "section_path"), ["document_id", "section_path"]).withColumn("relevance", F.col("sort_order") % 2)
    return N.ranked_sections(rows).select("document_id", "section_path", "rank0")


@query(f"""WITH {SHELF}, c AS (SELECT document_id, section_path, count(*) FILTER (chunk_type <> 'text') AS m FROM shelf GROUP BY ALL),
l AS (SELECT DISTINCT u.document_id, u.spot AS section_path, t.chunk_id, t.chunk_type FROM ups u JOIN shelf t ON t.document_id = u.document_id AND t.chunk_id = u.target WHERE u.chunk_type = 'text')
SELECT c.document_id, c.section_path, count(*) FILTER (l.chunk_type = 'image') AS linked_images, count(*) FILTER (l.chunk_type = 'table') AS linked_tables FROM c LEFT JOIN l USING (document_id, section_path) WHERE m = 0 GROUP BY ALL""")
def linked_media(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf).withColumn("connect_to", F.transform("connect_to", lambda c: F.struct(F.trim(c["target"]).alias("target"))))
    return N.connected_media(s, N.direct_counts(s))


@query(f"""WITH {SHELF} SELECT document_id * 100 + 1 AS scope_id, count(*) FILTER (chunk_type = 'image') AS n_image, count(*) FILTER (chunk_type = 'table') AS n_table FROM ups WHERE spot = 'chap 1' GROUP BY document_id
UNION ALL SELECT document_id * 100 + 2, count(*) FILTER (chunk_type = 'image'), count(*) FILTER (chunk_type = 'table') FROM ups WHERE spot = 'chap 0 / sec 1' GROUP BY document_id""")
def scope_media(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf)
    one = s.select("document_id").distinct()
    scopes = one.select((F.col("document_id") * 100 + 1).alias("scope_id"), "document_id", F.lit("chap 1").alias("path")).unionByName(one.select((F.col("document_id") * 100 + 2).alias("scope_id"), "document_id", F.lit("chap 0 / sec 1").alias("path")))
    return N.under_scopes(s, scopes)


@query(f"""WITH {SHELF}, t AS (SELECT *, row_number() OVER (PARTITION BY document_id, parent_path, section_level % 2 ORDER BY sort_order) AS n FROM tree) SELECT document_id, section_path, CASE section_level % 2 WHEN 0 THEN 'even' ELSE 'odd' END || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS section_title FROM t""")
def sibling_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = N.section_table(shelf(spark, sf)).withColumn("section_title", F.when(F.col("section_level") % 2 == 0, "even").otherwise("odd"))
    return N.unique_titles(t).select("document_id", "section_path", "section_title")


@query(f"""WITH {SHELF}, q AS (SELECT item_id AS query_id, lower(trim(left(text, 4))) AS q FROM benchmark UNION ALL SELECT 100000 + k, ['sec 3', 'CHAP 1 / SEC 2', 'leaf', 'nowhere at all'][k + 1] FROM (SELECT unnest([0, 1, 2, 3]) AS k)),
a AS (SELECT query_id, lower(q) AS q FROM q WHERE q <> ''), t AS (SELECT DISTINCT query_id, document_id, 'title' AS via FROM a JOIN tree ON contains(lower(section_title), q) OR contains(lower(section_path), q))
SELECT * FROM t UNION ALL SELECT DISTINCT query_id, document_id, 'content' FROM a JOIN shelf ON contains(lower(content), q) WHERE query_id NOT IN (SELECT query_id FROM t)""")
def entry_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Short queries, and words of section titles, as the way into documents."""
    s = shelf(spark, sf)
    short = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.substring("text", 1, 4).alias("query"))
    more = spark.createDataFrame([(100000, "sec 3"), (100001, "CHAP 1 / SEC 2"), (100002, "leaf"), (100003, "nowhere at all")], "query_id long, query string")
    return A.entry_documents(short.unionByName(more), N.section_table(s), s)


@query(f"""WITH {SHELF}, k AS (SELECT *, list_filter(regexp_extract_all(lower(regexp_replace(content, '(?i)\\[(?:images|tables)/[^\\]\\n]+\\]', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2) AS ts FROM shelf),
r AS (SELECT f.document_id % 10 AS query_id, k.document_id, k.chunk_id, row_number() OVER (PARTITION BY f.document_id % 10 ORDER BY k.document_id, k.sort_order, k.chunk_id) - 1 AS rank0 FROM files f JOIN k USING (document_id) WHERE list_has_any(k.ts, ['zwei', 'ion', 'reer', 'thth', 'der', 'la']))
SELECT query_id, document_id, chunk_id, rank0, 2.0 AS score FROM r WHERE rank0 < 5""")
def candidate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf)
    entries = files(spark, sf).select((F.col("document_id") % 10).alias("query_id"), "document_id")
    asked = entries.select("query_id").distinct().withColumn("query", F.lit("Zwei ION reer, thth and der la"))
    return A.candidate_chunks(entries, asked, s, 5).select("query_id", "document_id", "chunk_id", "rank0", "score")


@query(f"""WITH {SHELF}, b AS (SELECT document_id AS query_id, chunk_id AS key, CASE WHEN sort_order % 3 = 0 THEN NULL ELSE (sort_order % 4) * 0.25 END AS agent_score, (sort_order % 5) * 0.1 AS discovery_score, sort_order AS place FROM shelf),
r AS (SELECT query_id, key, round(coalesce(agent_score, 0.0), 6) AS agent_score, round(discovery_score, 6) AS discovery_score, row_number() OVER (PARTITION BY query_id ORDER BY agent_score IS NULL, round(coalesce(agent_score, 0.0), 6) DESC, round(discovery_score, 6) DESC, place, key) - 1 AS rank0 FROM b)
SELECT * FROM r WHERE rank0 < 8""")
def ranked_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Routed chunks first, by their score, discovered ones fill up; equal importance leaves scores as they are."""
    s = shelf(spark, sf).withColumn("importance", F.lit(0.5))
    found = s.select(F.col("document_id").alias("query_id"), F.col("chunk_id").alias("key"), ((F.col("sort_order") % 5) * 0.1).alias("discovery_score"), "importance", F.col("sort_order").alias("place"))
    routed = s.filter("sort_order % 3 <> 0").select(F.col("document_id").alias("query_id"), F.col("chunk_id").alias("key"), ((F.col("sort_order") % 4) * 0.25).alias("agent_score"), F.col("sort_order").alias("place"))
    return A.ranked_candidates(found, routed, 8).select("query_id", "key", "agent_score", "discovery_score", "rank0")


# --- links and media ---------------------------------------------------------------------------------


@query(f"""WITH {SHELF} SELECT document_id, unnest([file_path, '[' || file_path || ']']) AS alias, chunk_id AS target FROM shelf WHERE chunk_type <> 'text'""")
def alias_map(spark: SparkSession, sf: str) -> DataFrame:
    return G.aliases(shelf(spark, sf))


@query(f"""WITH {SHELF} SELECT document_id, chunk_id, target, 'embeds' AS relation, ref, length(content) - length(ref) AS start, length(content) AS "end" FROM shelf s WHERE EXISTS (SELECT 1 FROM shelf m WHERE m.document_id = s.document_id AND m.chunk_type <> 'text' AND '[' || m.file_path || ']' = s.ref)""")
def embed_edges(spark: SparkSession, sf: str) -> DataFrame:
    """References in texts as connections, with their places."""
    s = shelf(spark, sf)
    return G.embeds(s, G.aliases(s))


@query(f"""WITH {SHELF} SELECT document_id, chunk_id, target, 'embeds' AS relation, ref, length(content) - length(ref) AS start, 2.0 AS score FROM shelf s WHERE EXISTS (SELECT 1 FROM shelf m WHERE m.document_id = s.document_id AND m.chunk_type <> 'text' AND '[' || m.file_path || ']' = s.ref)""")
def merged_connections(spark: SparkSession, sf: str) -> DataFrame:
    """Connections found twice: with and without a position, with two scores."""
    s = shelf(spark, sf)
    e = G.embeds(s, G.aliases(s)).withColumn("score", F.lit(1.0))
    bare = e.withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int"))
    return G.merged_connections(e.unionByName(e.withColumn("score", F.lit(2.0))).unionByName(bare)).select("document_id", "chunk_id", "target", "relation", "ref", "start", "score")


@query(f"""WITH {SHELF} SELECT chunk_id, CASE WHEN sort_order % 2 = 0 THEN 'bundle/' || file_path WHEN sort_order % 3 = 0 THEN 'orig' || chunk_id || '.bin' END AS file FROM shelf WHERE chunk_type <> 'text'""")
def matched_files(spark: SparkSession, sf: str) -> DataFrame:
    """Media chunks and the files of a bundle, by path, original name, or not at all."""
    m = shelf(spark, sf).filter("chunk_type <> 'text'").withColumn("original_name", F.concat(F.lit("orig"), F.col("chunk_id"), F.lit(".bin")))
    even, third = F.col("sort_order") % 2 == 0, F.col("sort_order") % 3 == 0
    have = m.filter(even).select(F.concat(F.lit("bundle/"), F.col("file_path")).alias("file")).unionByName(m.filter(~even & third).select(F.col("original_name").alias("file")))
    return G.matched_files(m, have).select("chunk_id", "file")


@query(f"""WITH {SHELF} SELECT document_id, chunk_id, CASE WHEN chunk_type = 'image' THEN replace(path, 'images/i', 'images/new-') ELSE path END AS path, sha256(CASE WHEN EXISTS (SELECT 1 FROM shelf m WHERE m.chunk_type = 'image' AND '[' || m.path || ']' = s.ref) THEN replace(content, ref, replace(ref, 'images/i', 'images/new-')) ELSE content END) AS content_sha FROM shelf s""")
def renamed_media(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf)
    names = s.filter("chunk_type = 'image'").select(F.col("path").alias("old"), F.replace("path", F.lit("images/i"), F.lit("images/new-")).alias("new"))
    return G.renamed_refs(s, names).select("document_id", "chunk_id", "path", F.sha2("content", 256).alias("content_sha"))


@query(f"""WITH {SHELF} SELECT sha256(content) AS digest, count(*) AS n, min(path) AS first_path FROM shelf WHERE chunk_type <> 'text' GROUP BY content HAVING count(*) > 1""")
def same_assets(spark: SparkSession, sf: str) -> DataFrame:
    return G.same_assets(shelf(spark, sf).filter("chunk_type <> 'text'").select("path", "content"))


@query(f"""WITH {SHELF}, u AS (SELECT DISTINCT ref FROM shelf WHERE ref IS NOT NULL) SELECT path FROM shelf WHERE chunk_type <> 'text' AND '[' || path || ']' NOT IN (SELECT ref FROM u)""")
def unused_assets(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf)
    return G.unused_assets(s.filter("chunk_type <> 'text'").select("path"), s)


@query(f"""WITH {SHELF} SELECT document_id, section_path AS path, sha256(string_agg(content, chr(10) ORDER BY sort_order)) AS content_sha, string_agg(DISTINCT chunk_type, ';' ORDER BY chunk_type) AS type, sum(length(content)) AS length, count(*) AS n_rows FROM shelf GROUP BY document_id, section_path""")
def merged_paths(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf).select("document_id", F.col("section_path").alias("path"), "sort_order", "content", F.col("chunk_type").alias("type"), F.length("content").alias("length"))
    return C.merge_same_path(s, ["document_id", "path"], "sort_order").select("document_id", "path", F.sha2("content", 256).alias("content_sha"), "type", "length", "n_rows")


@query(f"""WITH {SHELF}, d AS (SELECT document_id, count(*) AS n, sum(length(content)) AS bytes FROM shelf GROUP BY ALL), x AS (SELECT document_id AS bundle_id, n + CASE WHEN document_id % 5 = 0 THEN 1 ELSE 0 END AS a, n AS b, bytes + CASE WHEN document_id % 7 = 0 THEN 1 ELSE 0 END AS c, bytes AS e FROM d)
SELECT bundle_id, CASE WHEN bundle_id % 11 = 0 THEN NULL ELSE a END AS declared, CASE WHEN bundle_id % 13 = 0 THEN NULL ELSE b END AS actual, CASE WHEN bundle_id % 13 = 0 THEN 'missing' WHEN bundle_id % 11 = 0 THEN 'undeclared' WHEN a <> b THEN 'count' ELSE 'size' END AS issue
FROM x WHERE NOT (bundle_id % 11 = 0 AND bundle_id % 13 = 0) AND (bundle_id % 11 = 0 OR bundle_id % 13 = 0 OR a <> b OR c <> e)""")
def bundle_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles whose declared and real numbers or sizes differ, or that one side lacks."""
    d = shelf(spark, sf).groupBy(F.col("document_id").alias("bundle_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("bytes"))
    k = F.col("bundle_id")
    said = d.filter(k % 11 != 0).withColumn("n", F.col("n") + (k % 5 == 0).cast("int")).withColumn("bytes", F.col("bytes") + (k % 7 == 0).cast("int"))
    return N.issues(said, d.filter(k % 13 != 0)).select("bundle_id", "declared", "actual", "issue")


@query(f"""WITH {SHELF} SELECT chunk_id, chunk_type AS type, length(content) AS length, file_path, CASE WHEN file_path IS NOT NULL THEN split_part(file_path, '/', 2) END AS original_name FROM shelf""")
def bundle_rows(spark: SparkSession, sf: str) -> DataFrame:
    return X.bundle_rows(shelf(spark, sf).withColumn("namespace", F.col("lang"))).select("chunk_id", "type", "metadata.length", "metadata.file_path", "metadata.original_name")


@query(f"""WITH {SHELF}, n AS (SELECT document_id, chunk_id || '-new' AS chunk_id FROM shelf WHERE document_id % 3 = 0) SELECT document_id, chunk_id FROM shelf WHERE document_id % 3 <> 0 UNION ALL SELECT * FROM n""")
def published_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A new revision of every third document replaces its rows."""
    s = shelf(spark, sf).select("document_id", "chunk_id")
    return N.published(s, s.filter("document_id % 3 = 0").withColumn("chunk_id", F.concat("chunk_id", F.lit("-new"))))


@query(f"""WITH {SHELF}, w AS (SELECT document_id, sort_order, split_part(section_path, ' / ', 1) AS path FROM shelf), n AS (SELECT *, row_number() OVER (PARTITION BY document_id, path ORDER BY sort_order) AS n FROM w) SELECT document_id, sort_order, path || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS path FROM n""")
def repeated_paths(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf).select("document_id", "sort_order", F.split("section_path", " / ")[0].alias("path"))
    return N.renamed_repeats(s)


@query(f"""WITH {SHELF} SELECT chunk_id, CASE WHEN chunk_type <> 'text' THEN 'file' || document_id || '/Assets/' || path WHEN sort_order % 6 = 0 THEN 'file' || document_id || '/Default_Root' ELSE path END AS published FROM shelf""")
def publication_paths(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when((F.col("chunk_type") == "text") & (F.col("sort_order") % 6 == 0), F.lit(" ")).otherwise(F.col("path"))
    return shelf(spark, sf).select("chunk_id", N.publication_path(F.concat(F.lit("file"), F.col("document_id")), raw).alias("published"))


@query(f"""WITH {SHELF} SELECT chunk_id, nullif(concat_ws(chr(10), nullif(trim(content, ' '), ''), nullif(trim(summary, ' '), '')), '') AS content_search_text, concat_ws(chr(10), source_file_name, section_path, list_extract(string_split(section_path, ' / '), -1), nullif(trim(summary, ' '), '')) AS path_search_text FROM shelf""")
def search_columns(spark: SparkSession, sf: str) -> DataFrame:
    return N.search_columns(shelf(spark, sf)).select("chunk_id", "content_search_text", "path_search_text")


@query(f"""WITH {SHELF} SELECT chunk_id, list_filter([target], lambda x: x IS NOT NULL) AS ids FROM shelf""")
def connected_ids(spark: SparkSession, sf: str) -> DataFrame:
    return shelf(spark, sf).select("chunk_id", R.connected_ids(F.col("connect_to")).alias("ids"))


@query(f"""WITH {SHELF} SELECT document_id, sort_order, CASE WHEN chunk_type <> 'text' THEN right(trim((SELECT max_by(x.content, x.sort_order) FROM shelf x WHERE x.document_id = s.document_id AND x.section_path = s.section_path AND x.chunk_type = 'text' AND x.sort_order < s.sort_order AND trim(x.content, ' ') <> ''), ' '), 100) END AS context FROM shelf s""")
def text_before_assets(spark: SparkSession, sf: str) -> DataFrame:
    s = shelf(spark, sf).select("document_id", "section_path", "sort_order", F.col("chunk_type").alias("kind"), F.col("content").alias("text"))
    return U.text_before(s, ["document_id", "section_path"], "sort_order").select("document_id", "sort_order", F.when(F.col("kind") != "text", F.col("context")).alias("context"))


@query(f"""WITH {SHELF}, g AS (SELECT document_id AS node FROM files), e AS (SELECT document_id AS source, document_id + 1 AS target FROM files) SELECT source, target FROM e WHERE source % 5 <> 0 AND target % 5 <> 0""")
def removed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Edges left in a chain of documents after every fifth is removed."""
    f = files(spark, sf).select("document_id")
    gone = f.filter("document_id % 5 = 0").unionByName(f.filter("document_id % 5 = 4").select((F.col("document_id") + 1).alias("document_id")))
    return G.without_document(f, f.select(F.col("document_id").alias("source"), (F.col("document_id") + 1).alias("target")), gone)[1]


@query(f"""WITH {SHELF}, c AS (SELECT s.document_id, t.sort_order AS s, s.sort_order AS c, repeat('  ', t.section_level) || '┈ ' || CASE WHEN s.ref IS NOT NULL THEN replace(s.content, s.ref, '<' || s.target || '>') ELSE s.content END AS line FROM shelf s JOIN tree t ON t.document_id = s.document_id AND t.section_path = s.section_path WHERE s.chunk_type = 'text'
UNION ALL SELECT document_id, sort_order, -1, repeat('  ', section_level - 1) || '▸ ' || section_title FROM tree WHERE section_path <> 'Root') SELECT document_id, sha256(string_agg(line, chr(10) ORDER BY s, c)) AS evidence_sha FROM c GROUP BY document_id""")
def tree_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Whole files as trees, media named where texts refer to them."""
    s = shelf(spark, sf)
    shown = F.transform("connect_to", lambda c: F.struct(c["ref"].alias("ref"), F.concat(F.lit("<"), F.trim(c["target"]), F.lit(">")).alias("text")))
    texts = A.with_media(s.filter("chunk_type = 'text'").withColumn("media", shown))
    return A.tree_evidence(N.section_table(s), texts).select("document_id", F.sha2("evidence", 256).alias("evidence_sha"))


@query(f"""WITH {SHELF}, t AS (SELECT document_id, coalesce(parent_path, '') AS up, section_path, sort_order, CASE section_level % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS title FROM tree), n AS (SELECT *, row_number() OVER (PARTITION BY document_id, up, title ORDER BY sort_order) AS n FROM t)
SELECT document_id, up AS section_path, string_agg(title || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '=' || section_path, ';' ORDER BY sort_order) AS children FROM n GROUP BY ALL""")
def hierarchy_maps(spark: SparkSession, sf: str) -> DataFrame:
    t = N.section_table(shelf(spark, sf)).withColumn("section_title", F.when(F.col("section_level") % 2 == 0, "even").otherwise("odd"))
    shown = F.array_join(F.transform(F.map_entries("children"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return N.hierarchy_maps(t).select("document_id", "section_path", shown.alias("children"))


@query(f"""WITH {SHELF}, p AS (SELECT CASE WHEN len(ps) = 0 THEN ['Root'] ELSE ps END AS ps FROM parts), u AS (SELECT unnest(list_transform(range(1, len(ps) + 1), lambda i: ps[1:i])) AS node FROM p)
SELECT array_to_string(node, '/') AS node, CASE WHEN len(node) > 1 THEN array_to_string(node[1:len(node) - 1], '/') END AS parent, node[-1] AS name, count(*) AS n_leaves FROM u GROUP BY node""")
def path_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The tree of all section paths with the number of chunks below each node."""
    rows = shelf(spark, sf).select(F.split("section_path", " / ").alias("path"))
    return R.path_nodes(rows).select(F.array_join("node", "/").alias("node"), F.array_join("parent", "/").alias("parent"), "name", "n_leaves")
