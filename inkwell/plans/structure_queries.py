"""Headings, contents, runs of lines and shards over the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import structure as U
from ..operators.chunking import lines_of, pack_ids
from .content_queries import LINES
from .registry import query, table

HEADS = f"""{LINES}, hd AS (SELECT doc_id, line_no, line, CASE WHEN line_no % 4 = 0 THEN (line_no // 4 * 5 + doc_id) % 3 + 1 ELSE -1 END AS level, CASE WHEN line_no % 4 = 0 THEN 't' || (line_no // 4 % 5) ELSE line END AS title FROM ln),
ahead AS (SELECT *, max(CASE WHEN level = 1 THEN line_no END) OVER w AS a1, max(CASE WHEN level = 2 THEN line_no END) OVER w AS a2, max(CASE WHEN level = 3 THEN line_no END) OVER w AS a3 FROM hd WHERE level > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
parents AS (SELECT *, CASE level WHEN 1 THEN NULL WHEN 2 THEN a1 ELSE greatest(a1, a2) END AS parent FROM ahead)"""


def heads(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents, every fourth one a heading of a level that goes up and down."""
    rows = lines_of(table(spark, sf, "documents"))
    n = F.floor(F.col("line_no") / 4).cast("long")
    head = F.col("line_no") % 4 == 0
    return rows.withColumn("level", F.when(head, (n * 5 + F.col("doc_id")) % 3 + 1).otherwise(-1).cast("int")).withColumn("title", F.when(head, F.concat(F.lit("t"), n % 5)).otherwise(F.col("line")))


@query(f"""WITH {HEADS}, p AS (SELECT doc_id, line_no, concat_ws('/', 'Root', 't' || (a1 // 4 % 5), CASE WHEN level >= 2 AND a2 > coalesce(a1, -1) THEN 't' || (a2 // 4 % 5) END, CASE WHEN level >= 3 AND a3 > greatest(coalesce(a1, -1), coalesce(a2, -1)) THEN 't' || (a3 // 4 % 5) END) AS path FROM ahead),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY line_no) AS n FROM p) SELECT doc_id, line_no, path || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END AS path FROM n""")
def heading_paths(spark: SparkSession, sf: str) -> DataFrame:
    return U.heading_paths(heads(spark, sf)).select("doc_id", "line_no", "path")


@query(f"WITH {HEADS} SELECT doc_id, line_no, parent FROM parents")
def heading_parents(spark: SparkSession, sf: str) -> DataFrame:
    return U.heading_parents(heads(spark, sf).filter("level > 0")).select("doc_id", "line_no", "parent")


@query(f"""WITH {HEADS}, k AS (SELECT *, (SELECT count(*) FROM parents c WHERE c.doc_id = p.doc_id AND c.parent = p.line_no) AS kids, count(*) OVER (PARTITION BY doc_id, parent) AS same FROM parents p),
kept AS (SELECT * FROM k WHERE NOT (kids = 0 AND same = 1 AND parent IS NOT NULL))
SELECT a.doc_id, a.line_no, 1 + (b.line_no IS NOT NULL)::INT + (c.line_no IS NOT NULL)::INT AS level FROM kept a LEFT JOIN kept b ON b.doc_id = a.doc_id AND b.line_no = a.parent LEFT JOIN kept c ON c.doc_id = b.doc_id AND c.line_no = b.parent""")
def lone_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Headings without leaves that are only children."""
    return U.without_single_leaves(heads(spark, sf).filter("level > 0")).select("doc_id", "line_no", "level")


@query(f"""WITH {HEADS}, g AS (SELECT *, level <= 0 AND lag(level) OVER w <= 0 AND lag(line_no) OVER w = line_no - 1 AND NOT regexp_matches(lag(title) OVER w, '[.!?。！？；;:：]\\s*$') AS goes FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
r AS (SELECT *, sum(CASE WHEN goes THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM g)
SELECT doc_id, min(line_no) AS line_no, max(line_no) AS last_line, sha256(string_agg(title, ' ' ORDER BY line_no)) AS title_sha, count(*) AS n_rows FROM r GROUP BY doc_id, run""")
def joined_body(spark: SparkSession, sf: str) -> DataFrame:
    """Broken lines put together again."""
    return U.joined_body(heads(spark, sf)).select("doc_id", "line_no", "last_line", F.sha2("title", 256).alias("title_sha"), "n_rows")


@query(f"""WITH {HEADS}, g AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM hd), m AS (SELECT doc_id, run, string_agg(title, ' ' ORDER BY line_no) AS more FROM g WHERE line_no % 5 = 3 AND run > 0 GROUP BY ALL)
SELECT doc_id, line_no, sha256(CASE WHEN level > 0 AND more IS NOT NULL THEN title || ' ' || more ELSE title END) AS title_sha, CASE WHEN line_no % 5 = 3 THEN -1 ELSE level END AS level FROM g LEFT JOIN m USING (doc_id, run)""")
def continued_headings(spark: SparkSession, sf: str) -> DataFrame:
    rows = heads(spark, sf).withColumn("mark", F.when(F.col("line_no") % 5 == 3, "<"))
    return U.continued_headings(rows).select("doc_id", "line_no", F.sha2("title", 256).alias("title_sha"), "level")


@query(f"""WITH {HEADS}, g AS (SELECT *, CASE WHEN level <= 0 AND lag(level) OVER (PARTITION BY doc_id ORDER BY line_no) <= 0 THEN 0 ELSE 1 END AS new FROM hd), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM g)
SELECT doc_id, min(line_no) AS first_line, max(line_no) AS last_line, CASE WHEN max(level) <= 0 THEN '[' || count(*) || ' BODY LINES]' ELSE min(title) END AS text FROM r GROUP BY doc_id, run""")
def compacted_body(spark: SparkSession, sf: str) -> DataFrame:
    return U.compacted(heads(spark, sf)).select("doc_id", "first_line", "last_line", "text")


@query(f"""WITH {LINES}, s AS (SELECT doc_id, list(len(regexp_extract_all(line, '[\\x{{4e00}}-\\x{{9fff}}]|[A-Za-z]+|[0-9]+(?:\\.[0-9]+)?')) ORDER BY line_no) AS ts FROM ln GROUP BY doc_id),
f AS (SELECT doc_id, ts, list_reduce(list_transform(ts, lambda x: {{'t': x, 'o': [0]}}), lambda a, x: CASE WHEN a.t + x.t <= 3000 THEN {{'t': a.t + x.t, 'o': list_append(a.o, a.o[-1])}} ELSE {{'t': x.t, 'o': list_append(a.o, a.o[-1] + 1)}} END) AS f FROM s),
u AS (SELECT doc_id, unnest(ts) AS n, unnest(f.o) AS g FROM f) SELECT doc_id, g AS "group", count(*) AS n_lines, sum(n)::BIGINT AS n_tokens FROM u GROUP BY doc_id, g""")
def token_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of a document split to groups of at most 3,000 tokens."""
    from ..functions.text import token_count

    rows = lines_of(table(spark, sf, "documents")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", token_count(F.col("line")).cast("long").alias("n")))), lambda x: x["n"]).alias("_n"))
    pairs = rows.select("doc_id", F.explode(F.arrays_zip(F.col("_n").alias("n"), pack_ids(F.col("_n"), 3000).alias("group"))).alias("x")).select("doc_id", "x.group", "x.n")
    return pairs.groupBy("doc_id", "group").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_tokens"))


MARKED = f"""{LINES}, tl AS (SELECT doc_id, line_no, CASE WHEN line_no % 6 = 1 THEN '<table>' || line WHEN line_no % 6 = 3 AND line_no % 5 > 0 THEN line || '</table>' ELSE line END AS line FROM ln),
o AS (SELECT *, sum(len(regexp_extract_all(lower(line), '<table')) - len(regexp_extract_all(lower(line), '</table>'))) OVER (PARTITION BY doc_id ORDER BY line_no) AS open FROM tl),
q AS (SELECT *, coalesce(lag(open) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS was, coalesce(max(CASE WHEN open <= 0 THEN line_no END) OVER (PARTITION BY doc_id), -1) AS last FROM o),
z AS (SELECT *, sum(CASE WHEN was > 0 AND line_no <= last THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM q)"""


@query(f"WITH {MARKED} SELECT doc_id, min(line_no) AS line_no, sha256(string_agg(line, '' ORDER BY line_no)) AS line_sha FROM z GROUP BY doc_id, run")
def table_lines(spark: SparkSession, sf: str) -> DataFrame:
    """HTML tables that span lines, some never closed."""
    n = F.col("line_no")
    line = F.when(n % 6 == 1, F.concat(F.lit("<table>"), "line")).when((n % 6 == 3) & (n % 5 > 0), F.concat("line", F.lit("</table>"))).otherwise(F.col("line"))
    rows = lines_of(table(spark, sf, "documents")).withColumn("line", line)
    return U.merged_tables(rows).select("doc_id", "line_no", F.sha2("line", 256).alias("line_sha"))


# --- contents ----------------------------------------------------------------------------------------

TOC = f"""{LINES}, tc AS (SELECT doc_id, line_no, CASE WHEN line_no % 9 = 2 THEN 'Contents' ELSE line END AS line FROM ln), ar AS (SELECT *, sum(CASE WHEN line = 'Contents' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS area FROM tc),
an AS (SELECT *, row_number() OVER (PARTITION BY doc_id, area ORDER BY line_no) AS n FROM ar WHERE area > 0), areas AS (SELECT doc_id, area, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM an WHERE n <= 4 GROUP BY ALL)"""


def toc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(table(spark, sf, "documents")).withColumn("line", F.when(F.col("line_no") % 9 == 2, "Contents").otherwise(F.col("line")))


@query(f"WITH {TOC} SELECT * FROM areas")
def toc_areas(spark: SparkSession, sf: str) -> DataFrame:
    return U.toc_areas(toc_lines(spark, sf), limit=3)


@query(f"""WITH {TOC}, f AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS f FROM tc), a AS (SELECT r.*, x.f AS fa, y.f AS fb FROM areas r JOIN f x ON x.doc_id = r.doc_id AND x.line_no = r.first_line JOIN f y ON y.doc_id = r.doc_id AND y.line_no = r.last_line),
n AS (SELECT *, CASE WHEN fa - lag(fb) OVER (PARTITION BY doc_id ORDER BY first_line) - 1 <= 5 THEN 0 ELSE 1 END AS new FROM a), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY first_line) AS area2 FROM n)
SELECT doc_id, area2 AS area, min(first_line) AS first_line, max(last_line) AS last_line FROM g GROUP BY doc_id, area2""")
def toc_merged_areas(spark: SparkSession, sf: str) -> DataFrame:
    rows = toc_lines(spark, sf)
    return U.merged_areas(U.toc_areas(rows, limit=3), rows)


@query(f"""WITH {TOC} SELECT t.doc_id, t.line_no FROM tc t WHERE NOT EXISTS (SELECT 1 FROM areas a WHERE a.doc_id = t.doc_id AND t.line_no BETWEEN a.first_line AND a.last_line)""")
def lines_outside_toc(spark: SparkSession, sf: str) -> DataFrame:
    rows = toc_lines(spark, sf)
    return U.without_areas(rows, U.toc_areas(rows, limit=3)).select("doc_id", "line_no")


@query(f"""WITH {TOC}, sz AS (SELECT doc_id, max(line_no) + 1 AS n_lines FROM tc GROUP BY doc_id), z0 AS (SELECT r.*, s.n_lines AS total, sum(last_line - first_line + 1) OVER w AS gone, lead(first_line) OVER w AS nxt FROM areas r JOIN sz s USING (doc_id) WINDOW w AS (PARTITION BY r.doc_id ORDER BY first_line)),
z AS (SELECT doc_id, area, last_line + 1 - gone AS a, coalesce(nxt - 1, total - 1) - gone AS b FROM z0)
SELECT t.doc_id, t.line_no, (SELECT max_by(CASE WHEN t.line_no <= b THEN area END, a) FROM (SELECT * FROM z WHERE z.doc_id = t.doc_id AND z.a <= t.line_no ORDER BY a DESC LIMIT 1)) AS zone FROM tc t""")
def toc_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with the contents area that governs it, in numbers after the areas are taken out."""
    rows = toc_lines(spark, sf)
    sizes = rows.groupBy("doc_id").agg((F.max("line_no") + 1).alias("n_lines"))
    return U.governed(rows, U.zones(U.toc_areas(rows, limit=3).drop("n_lines"), sizes)).select("doc_id", "line_no", "zone")


@query(f"""WITH {LINES}, e AS (SELECT doc_id, line_no AS entry_no, CASE WHEN line_no % 3 = 0 THEN NULL ELSE line_no % 2 + 1 END AS level, line_no % 4 AS indent FROM ln) SELECT doc_id, entry_no, coalesce(level, dense_rank() OVER (PARTITION BY doc_id, level IS NULL ORDER BY indent)) AS level FROM e""")
def indent_levels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no")
    rows = lines_of(table(spark, sf, "documents")).select("doc_id", n.alias("entry_no"), F.when(n % 3 != 0, n % 2 + 1).alias("level"), (n % 4).alias("indent"))
    return U.indent_levels(rows).select("doc_id", "entry_no", "level")


@query(f"""WITH {HEADS}, e AS (SELECT doc_id, line_no AS entry_no, CASE WHEN line_no % 8 = 0 THEN -1 ELSE least(level, 2) END AS l0 FROM hd WHERE level > 0), d AS (SELECT *, CASE WHEN l0 = -1 THEN max(l0) OVER (PARTITION BY doc_id) + 1 ELSE l0 END AS level FROM e),
a AS (SELECT *, max(CASE WHEN level = 1 THEN entry_no END) OVER w AS a1, max(CASE WHEN level = 2 THEN entry_no END) OVER w AS a2, max(CASE WHEN level = 0 THEN entry_no END) OVER w AS a0 FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY entry_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, entry_no, level, CASE WHEN level = 2 THEN a1 WHEN level = 3 THEN greatest(a1, a2) END AS parent FROM a""")
def toc_tree(spark: SparkSession, sf: str) -> DataFrame:
    rows = heads(spark, sf).filter("level > 0").select("doc_id", F.col("line_no").alias("entry_no"), F.when(F.col("line_no") % 8 == 0, -1).otherwise(F.least("level", F.lit(2))).alias("level"))
    return U.toc_tree(rows).select("doc_id", "entry_no", "level", "parent")


@query(f"""WITH {LINES}, v AS (SELECT doc_id, line_no, length(line) AS h, list_sort(list(length(line)) OVER (PARTITION BY doc_id)) AS v FROM ln) SELECT doc_id, line_no, CASE WHEN h >= v[len(v) * 80 // 100 + 1] THEN 1 WHEN h >= v[len(v) * 60 // 100 + 1] THEN 2 WHEN h >= v[len(v) * 40 // 100 + 1] THEN 3 WHEN h >= v[len(v) * 20 // 100 + 1] THEN 4 ELSE 5 END AS size_level FROM v""")
def size_levels(spark: SparkSession, sf: str) -> DataFrame:
    return U.size_levels(lines_of(table(spark, sf, "documents")).withColumn("height", F.length("line"))).select("doc_id", "line_no", "size_level")


@query(f"""WITH {HEADS}, t AS (SELECT doc_id, min(line_no) AS body_line FROM hd WHERE title = 't1' GROUP BY doc_id) SELECT h.doc_id, h.line_no, CASE WHEN h.line_no < t.body_line THEN -1 ELSE level END AS level FROM hd h LEFT JOIN t USING (doc_id) WHERE h.line_no % 4 = 0""")
def demoted_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings before the first line that is a contents title of level 1 become body."""
    rows = heads(spark, sf)
    marked = rows.withColumn("line", F.when(F.col("level") > 0, F.concat(F.lit("# "), F.upper("title"))).otherwise(F.lit("-")))
    titles = rows.select("doc_id").distinct().withColumn("title", F.lit("1.2 t1 .... 17"))
    return U.demoted(rows, U.body_start(marked, titles)).filter("line_no % 4 = 0").select("doc_id", "line_no", "level")


@query(f"""WITH {HEADS}, s AS (SELECT *, line_no // 8 AS shard_no FROM hd), e AS (SELECT doc_id, shard_no, min_by({{'t': title, 'l': level}}, line_no) AS f, max_by({{'t': title, 'l': level}}, line_no) AS l, max(line_no) AS spot FROM s WHERE level > 0 GROUP BY ALL),
g AS (SELECT doc_id, spot, l, lead(f) OVER (PARTITION BY doc_id ORDER BY shard_no) AS nxt FROM e), k AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = s.doc_id AND g.spot = s.line_no AND g.l = g.nxt))
SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS position FROM k""")
def merged_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = heads(spark, sf).withColumn("shard_no", F.floor(F.col("line_no") / 8).cast("int"))
    return U.merged_shards(rows).select("doc_id", "line_no", "position")


@query(f"""WITH {HEADS}, a AS (SELECT doc_id, line_no, title, row_number() OVER (PARTITION BY doc_id, title ORDER BY line_no) AS n FROM hd WHERE level > 0), b AS (SELECT doc_id, 't' || (line_no // 4 % 5) AS title, line_no * 1.5 AS height, row_number() OVER (PARTITION BY doc_id, line_no // 4 % 5 ORDER BY line_no) AS n FROM hd WHERE level > 0 AND line_no % 8 = 0),
l AS (SELECT doc_id, title, max_by(height, n) AS last FROM b GROUP BY ALL) SELECT a.doc_id, a.line_no, coalesce(b.height, l.last) AS height FROM a LEFT JOIN b USING (doc_id, title, n) LEFT JOIN l USING (doc_id, title)""")
def heading_heights(spark: SparkSession, sf: str) -> DataFrame:
    """Heights from layout spans: every second heading has one; spaces and case don't count."""
    rows = heads(spark, sf).filter("level > 0")
    spans = rows.filter("line_no % 8 = 0").select("doc_id", F.col("line_no").alias("span_no"), F.concat(F.lit(" T "), F.substring("title", 2, 9)).alias("text"), (F.col("line_no") * 1.5).alias("height"))
    return U.heights(rows, spans).select("doc_id", "line_no", "height")


@query(f"WITH {HEADS} SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id, title) AS n_same FROM hd WHERE level > 0")
def heading_totals(spark: SparkSession, sf: str) -> DataFrame:
    rows = heads(spark, sf).filter("level > 0").withColumn("title", F.when(F.col("line_no") % 8 == 0, F.upper("title")).otherwise(F.concat(F.lit(" "), "title")))
    return U.occurrences(rows).select("doc_id", "line_no", "n_same")


@query(f"""WITH RECURSIVE {HEADS}, t AS (SELECT doc_id, line_no AS node, parent, title, parent IS NULL AS top FROM parents), up AS (SELECT doc_id, node, title AS path FROM t WHERE top UNION ALL SELECT t.doc_id, t.node, u.path || '/' || t.title FROM t JOIN up u ON u.doc_id = t.doc_id AND u.node = t.parent),
lv AS (SELECT u.*, row_number() OVER (PARTITION BY u.doc_id, u.path ORDER BY u.node) AS n FROM up u WHERE u.node % 12 <> 0 AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = u.doc_id AND t.parent = u.node)) SELECT doc_id, node, path || CASE WHEN n > 1 THEN ' part ' || n ELSE '' END AS path FROM lv""")
def leaf_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of heading trees with their paths; every third node is empty."""
    rows = U.heading_parents(heads(spark, sf).filter("level > 0")).select("doc_id", F.col("line_no").alias("node"), "parent", "title", F.when(F.col("line_no") % 12 == 0, " ").otherwise("text").alias("content"))
    return U.leaf_rows(rows).select("doc_id", "node", "path")


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_no // 3 + 1 AS page, lower(regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '\\s+', '', 'g')) AS t FROM ln GROUP BY ALL), x AS (SELECT doc_id, line_no AS title_no, line AS title FROM ln WHERE line_no % 5 = 4),
f AS (SELECT x.doc_id, x.title_no, min(p.page) AS page FROM x JOIN p ON p.doc_id = x.doc_id AND contains(p.t, lower(regexp_replace(x.title, '\\s+', '', 'g'))) GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY title_no) AS n FROM f) SELECT doc_id, title_no, page FROM n WHERE n = 1""")
def title_pages(spark: SparkSession, sf: str) -> DataFrame:
    lines = lines_of(table(spark, sf, "documents"))
    pages = lines.groupBy("doc_id", (F.floor(F.col("line_no") / 3) + 1).cast("int").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    titles = lines.filter("line_no % 5 = 4").select("doc_id", F.col("line_no").alias("title_no"), F.col("line").alias("title"))
    return P.title_pages(titles, pages, ["doc_id"]).select("doc_id", "title_no", "page")


@query(f"""WITH {LINES}, b AS (SELECT doc_id, line_no AS block_no, line_no // 4 AS page, CASE WHEN line_no % 7 IN (2, 3, 4) THEN 'toc' ELSE 'text' END AS label, line FROM ln), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS i, row_number() OVER (PARTITION BY doc_id, label ORDER BY block_no) AS j FROM b),
r AS (SELECT *, i - j AS run FROM t WHERE label = 'toc') SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) AS area, block_no, sha256(line) AS entry_sha FROM r""")
def labelled_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of contents areas from blocks that the layout labels so."""
    rows = lines_of(table(spark, sf, "documents"))
    blocks = rows.select("doc_id", F.col("line_no").alias("block_no"), F.when((F.col("line_no") % 7).isin(2, 3, 4), "TOC").otherwise("text").alias("label"), F.col("line").alias("text"))
    return U.labelled_areas(blocks).select("doc_id", "area", "block_no", F.sha2("entry", 256).alias("entry_sha"))


@query(f"""WITH {TOC}, pg AS (SELECT doc_id, line_no // 5 + 1 AS page, min(line_no) AS a, max(line_no) AS b FROM tc GROUP BY ALL) SELECT DISTINCT r.doc_id, pg.page FROM areas r JOIN pg ON pg.doc_id = r.doc_id AND pg.a <= r.last_line AND pg.b >= r.first_line""")
def toc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages on which contents areas lie, by markers in the text."""
    rows = toc_lines(spark, sf).filter("trim(line) <> ''")
    marks = rows.groupBy("doc_id", (F.floor(F.col("line_no") / 5) + 1).cast("int").alias("page")).agg(F.min("line_no").alias("_at"))
    lines = rows.select("doc_id", (F.col("line_no") * 2 + 1).alias("line_no"), "line").unionByName(marks.select("doc_id", (F.col("_at") * 2).alias("line_no"), F.concat(F.lit("<!-- Page "), "page", F.lit(" -->")).alias("line")))
    areas = U.toc_areas(rows, limit=3).select("doc_id", "area", (F.col("first_line") * 2 + 1).alias("first_line"), (F.col("last_line") * 2 + 1).alias("last_line"))
    return P.toc_pages(lines, areas)


# --- shards ------------------------------------------------------------------------------------------

BOOKS = """b AS (SELECT o_custkey AS doc_id, count(*)::INT * 9 AS page_count, list_sort(list_distinct(list((o_orderkey * 7 % (SELECT 9 * count(*) FROM orders x WHERE x.o_custkey = o.o_custkey) + 1)::INT))) AS h1 FROM orders o GROUP BY o_custkey),
walk AS (SELECT doc_id, page_count, h1, 1 AS start, 0 AS k FROM b UNION ALL SELECT doc_id, page_count, h1, list_max(list_filter(h1, lambda h: h > start AND h - start <= 20)), k + 1 FROM walk WHERE page_count - start + 1 > 20 AND len(list_filter(h1, lambda h: h > start AND h - start <= 20)) > 0),
cut AS (SELECT doc_id, page_count, k AS shard_index, start AS page_start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY k) - 1, page_count) AS page_end FROM walk)"""


def books(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as books: nine pages an order, headings spread over them."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey")
    n = o.groupBy("doc_id").agg((F.count(F.lit(1)) * 9).cast("int").alias("page_count"))
    return o.join(n, "doc_id").groupBy("doc_id", "page_count").agg(F.array_sort(F.collect_set((F.col("o_orderkey") * 7 % F.col("page_count") + 1).cast("int"))).alias("h1_pages"))


@query(f"WITH RECURSIVE {BOOKS} SELECT doc_id, shard_index, page_start, page_end, page_start - 1 AS page_offset, shard_index > 0 AS is_continuation FROM cut")
def page_shards(spark: SparkSession, sf: str) -> DataFrame:
    return P.shards(P.page_cuts(books(spark, sf), 20)).select("doc_id", "shard_index", "page_start", "page_end", "page_offset", "is_continuation")


@query(f"WITH RECURSIVE {BOOKS} SELECT doc_id, 'shard ' || shard_index || ' exceeds max_pages=20' AS error FROM cut WHERE page_end - page_start + 1 > 20")
def shard_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Shards that no heading could keep short enough."""
    return P.shard_errors(P.shards(P.page_cuts(books(spark, sf), 20)), 20)
