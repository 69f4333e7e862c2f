"""Structure of texts: headings, levels, trees, contents, sections from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _before(key: str | list[str], order: str) -> Window:
    return Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def _listed(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _others(rows: DataFrame, keys: list[str]) -> Column:
    """A row without its keys; these stay columns of a group, so that its rows stay dealt by them."""
    return F.struct(*[F.col(c) for c in rows.columns if c not in keys])


def _texts(rows: Column, sep: str) -> Column:
    """Texts (order, text) of a group joined in order; nulls are left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["t"]), sep)


def line_levels(lines: DataFrame, key: str = "doc_id", order: str = "line_no", markdown_only: bool = False) -> DataFrame:
    """Lines with title and level (-1: body): markdown markers count first, else numbering evidence."""
    md = T.markdown_heading(F.col("line"))
    level = md["level"] if markdown_only else F.when(md["level"] > 0, md["level"]).otherwise(F.greatest(T.heading_level(F.col("line")), F.lit(-1)))
    return lines.withColumn("title", F.trim(T.without_bold(md["title"]))).withColumn("level", level)


def heading_paths(lines: DataFrame, key: str = "doc_id", order: str = "line_no", root: str = "Root") -> DataFrame:
    """Headings with their path: a heading stands below the nearest one before it with a smaller level.

    For each level the last heading of that level is carried forward, and cut off by any later heading that is
    not deeper; paths are the carried titles of smaller levels. Slashes in titles become ∕. A path that
    repeats within a document gets ' (k)'. Levels are at most 6.
    """
    w = _before(key, order)
    heads = lines.filter("level > 0").withColumn("level", F.least("level", F.lit(6)))
    at = {k: F.max(F.when(F.col("level") <= k, F.struct(order, "level"))).over(w) for k in range(1, 7)}
    name = F.replace(F.col("title"), F.lit("/"), F.lit("∕"))
    own = {k: F.last(F.when(F.col("level") == k, F.struct(F.col(order).alias("o"), name.alias("t"))), True).over(w) for k in range(1, 7)}
    rows = heads.withColumns({f"_a{k}": v for k, v in at.items()} | {f"_o{k}": v for k, v in own.items()})
    # a level's last heading counts if no heading of a smaller level came after it, and it is above this one
    parts = [F.when((F.col("level") >= k) & F.col(f"_o{k}").isNotNull() & (F.col(f"_a{k}.{order}") == F.col(f"_o{k}.o")), F.col(f"_o{k}.t")) for k in range(1, 7)]
    out = rows.withColumn("path", F.concat_ws("/", F.lit(root), *parts)).drop(*[f"_{c}{k}" for c in "ao" for k in range(1, 7)])
    n = F.row_number().over(Window.partitionBy(key, "path").orderBy(order))
    return out.withColumn("_n", n).withColumn("path", F.when(F.col("_n") > 1, F.concat("path", F.lit(" ("), F.col("_n"), F.lit(")"))).otherwise(F.col("path"))).drop("_n")


def heading_parents(heads: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Each heading with the place of its parent: the nearest one before with a smaller level."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col(order))).over(w) for k in range(1, 7)]
    rows = heads.withColumn("_last", F.array(*last))
    up = F.array_max(F.transform("_last", lambda x, i: F.when(i + 1 < F.col("level"), x)))
    return rows.withColumn("parent", up).drop("_last")


def sections_from_lines(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Body lines gathered under the heading before them; headings without body stay as empty rows; lines before the
    first heading stand under Root."""
    paths = heading_paths(lines, key, order).select(key, order, "path")
    rows = lines.join(paths, [key, order], "left")
    w = _before(key, order)
    rows = rows.withColumn("section_no", F.count("path").over(w)).withColumn("section", F.coalesce(F.last("path", True).over(w), F.lit("Root")))
    body = F.transform(F.array_sort(F.collect_list(F.when((F.col("level") <= 0) & (F.trim("line") != ""), F.struct(order, "line")))), lambda x: x["line"])
    return rows.groupBy(key, "section_no", "section").agg(F.array_join(body, "\n").alias("content"), F.count_if((F.col("level") <= 0) & (F.trim("line") != "")).alias("n_lines")).filter("n_lines > 0 or section <> 'Root'")


def without_single_leaves(heads: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Headings without the leaves that are only children; levels become depths (at most 6).

    A heading has children exactly if the next one is deeper. Its ancestors are, of the last headings before it of each smaller
    level, those that no heading of a still smaller level follows.
    """
    w = Window.partitionBy(key).orderBy(order)
    lasts = [F.col(f"_l{k}") for k in range(1, 7)]
    rows = heads.withColumns({f"_l{k}": F.max(F.when(F.col("level") == k, F.col(order))).over(w.rowsBetween(Window.unboundedPreceding, -1)) for k in range(1, 7)} | {"_next": F.lead("level").over(w)})
    own = [F.when(F.col("level") > k, x) for k, x in enumerate(lasts, 1)]
    above = [F.coalesce((x > F.greatest(*own[:k], F.lit(None))) if k else x.isNotNull(), x.isNotNull()).cast("int") for k, x in enumerate(own)]
    rows = rows.withColumns({"_up": F.greatest(*own), "_d": F.least(sum(above, F.lit(1)), F.lit(6)), "_leaf": ~F.coalesce((F.col("_next") > F.col("level")) & (F.col("level") <= 6), F.lit(False))})
    rows = rows.withColumn("_siblings", F.count(F.lit(1)).over(Window.partitionBy(key, "_up")))
    kept = rows.filter(~(F.col("_leaf") & (F.col("_siblings") == 1) & F.col("_up").isNotNull()))
    return kept.withColumn("level", F.col("_d")).select(*heads.columns)


def joined_body(rows: DataFrame, key: str | list[str] = "doc_id", order: str = "line_no", first: tuple[str, ...] = ()) -> DataFrame:
    """Runs of body rows whose text lacks closing punctuation and whose numbers follow each other become one row, with
    the columns `first` of its first row."""
    keys = _listed(key)
    w = Window.partitionBy(keys).orderBy(order)
    body = F.col("level") <= 0
    goes_on = body & F.lag(body).over(w) & (F.lag(order).over(w) == F.col(order) - 1) & ~F.lag("title").over(w).rlike(r"[.!?。！？；;:：]\s*$")
    marked = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(_before(keys, order)))
    more = [F.min_by(c, order).alias(c) for c in first]
    return marked.groupBy(*keys, "_run").agg(F.min(order).alias(order), F.max(order).alias("last_line"), _texts(F.struct(order, F.col("title").alias("t")), " ").alias("title"), F.first("level").alias("level"), F.count(F.lit(1)).alias("n_rows"), *more).drop("_run")


def merged_gaps(rows: DataFrame, key: str | list[str] = "doc_id", order: str = "line_no", few: int = 3) -> DataFrame:
    """Little body text between two headings of one level and reason (at most `few` tokens, or less than half of the first
    heading's) belongs to the first heading: its lines are appended to the title and go.

    Only neighbouring headings can have nothing but body between them, so each gap is judged by itself: sums per gap, and
    the texts of those gaps alone that are short. Rows stay in order; columns: key, order, title, level, reason and more.
    All is dealt by key once: the rows of a short gap become one row with its heading, any other row stands for itself.
    """
    keys, head = _listed(key), F.col("level") > 0
    size = T.token_count(F.trim(T.text_or_empty(F.col("title"))))
    after = Window.partitionBy(keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    code = F.when(head, F.struct("level", "reason"))
    marked = rows.withColumn("_size", size).withColumn("_next", F.last(code, True).over(after)).withColumn("_gap", F.sum(head.cast("int")).over(_before(keys, order)))
    gap = Window.partitionBy(*keys, "_gap")
    sums = {"_code": F.max(code).over(gap), "_own": F.sum(F.when(head, F.col("_size")).otherwise(0)).over(gap), "_between": F.sum(F.when(head, 0).otherwise(F.col("_size"))).over(gap), "_n": F.count_if(~head).over(gap), "_at": F.min(F.when(head, F.col(order))).over(gap)}
    met = marked.withColumns(sums)
    short = (F.col("_gap") > 0) & (F.col("_n") > 0) & F.col("_code").eqNullSafe(F.col("_next")) & ((F.col("_between") <= few) | (F.col("_between") < F.floor(F.col("_own") / 2)))
    met = met.withColumn("_id", F.when(short, F.col("_at")).otherwise(F.col(order)))
    itself = F.col("_id") == F.col(order)
    text = F.when(~itself & (F.trim("title") != ""), F.struct(order, F.trim("title").alias("t")))
    out = met.groupBy(*keys, "_id").agg(F.first(F.when(itself, _others(rows, keys)), True).alias("_row"), _texts(text, "\n").alias("_more")).select(*keys, "_row.*", "_more")
    return out.withColumn("title", F.when(F.col("_more") != "", F.concat_ws(" ", F.trim("title"), "_more")).otherwise(F.col("title"))).select(*rows.columns)


def continued_headings(rows: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Rows marked '<' are appended to the last heading before them and become body (level -1).

    A marked row goes to its heading's group beside its own, so that all is dealt by key once.
    """
    head = F.col("level") > 0
    marked = rows.withColumn("_at", F.max(F.when(head, F.col(order))).over(_before(key, order)))
    to = F.when((F.col("mark") == "<") & F.col("_at").isNotNull(), F.array(F.struct(F.col(order).alias("id"), F.lit(True).alias("own")), F.struct(F.col("_at").alias("id"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col(order).alias("id"), F.lit(True).alias("own"))))
    each = marked.withColumn("_to", F.explode(to))
    own = F.col("_to.own")
    out = each.groupBy(key, F.col("_to.id").alias("_id")).agg(F.first(F.when(own, _others(rows, [key])), True).alias("_row"), F.count_if(~own).alias("_n"), _texts(F.when(~own, F.struct(order, F.coalesce("title", F.lit("")).alias("t"))), " ").alias("_more")).select(key, "_row.*", "_n", "_more")
    title = F.when(head & (F.col("_n") > 0), F.concat_ws(" ", "title", "_more")).otherwise(F.col("title"))
    return out.withColumns({"title": title, "level": F.when(F.col("mark") == "<", -1).otherwise(F.col("level"))}).select(*rows.columns)


def compacted(rows: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Runs of body rows as one row '[n BODY LINES]' with the range of their numbers."""
    w = Window.partitionBy(key).orderBy(order)
    body = F.col("level") <= 0
    change = F.when(body & F.coalesce(F.lag(body).over(w), F.lit(False)), 0).otherwise(1)
    marked = rows.withColumn("_new", change).withColumn("_run", F.sum("_new").over(_before(key, order)))
    out = marked.groupBy(key, "_run").agg(F.min(order).alias("first_line"), F.max(order).alias("last_line"), F.count(F.lit(1)).alias("n"), F.first("title").alias("_t"), F.max("level").alias("level"))
    return out.withColumn("text", F.when(F.col("level") <= 0, F.concat(F.lit("["), F.col("n"), F.lit(" BODY LINES]"))).otherwise(F.col("_t"))).drop("_run", "_t")


def merged_tables(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """HTML tables that span lines become one line; a table that is never closed keeps its lines."""
    w, all_ = _before(key, order), Window.partitionBy(key)
    count = lambda p: F.size(F.regexp_extract_all(F.lower("line"), F.lit(p), F.lit(0)))
    opened = F.sum(count("<table")).over(w)
    closed = F.sum(count("</table>")).over(w)
    marked = lines.withColumn("_open", opened - closed).withColumn("_was", F.coalesce(F.lag("_open").over(Window.partitionBy(key).orderBy(order)), F.lit(0)))
    marked = marked.withColumn("_left", F.last("_open").over(all_.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    last = F.max(F.when(F.col("_open") <= 0, F.col(order))).over(all_)
    new = F.when((F.col("_was") > 0) & (F.col(order) <= F.coalesce(last, F.lit(-1))), 0).otherwise(1)
    marked = marked.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(key, "_run").agg(F.min(order).alias(order), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"]), "").alias("line")).drop("_run")


# --- tables of contents ------------------------------------------------------------------------------


def toc_areas(lines: DataFrame, key: str = "doc_id", order: str = "line_no", limit: int = 50) -> DataFrame:
    """Candidate areas: from each line that announces contents, up to `limit` content lines, or the next such line."""
    from .pages import TOC_WORDS

    w = _before(key, order)
    marked = lines.withColumn("_head", F.col("line").rlike(TOC_WORDS)).withColumn("area", F.sum(F.col("_head").cast("int")).over(w)).filter("area > 0")
    good = marked.filter(T.is_content_line(F.col("line")) & (F.trim("line") != ""))
    n = F.row_number().over(Window.partitionBy(key, "area").orderBy(order))
    return good.withColumn("_n", n).filter(F.col("_n") <= limit + 1).groupBy(key, "area").agg(F.min(order).alias("first_line"), F.max(order).alias("last_line"), F.count(F.lit(1)).alias("n_lines"))


def merged_areas(areas: DataFrame, lines: DataFrame, key: str = "doc_id", order: str = "line_no", gap: int = 5) -> DataFrame:
    """Areas with at most `gap` filled lines between them become one."""
    filled = lines.withColumn("_f", F.sum((F.trim("line") != "").cast("int")).over(_before(key, order))).select(key, order, "_f")
    a = areas.join(filled.select(key, F.col(order).alias("first_line"), F.col("_f").alias("_fa")), [key, "first_line"]).join(filled.select(key, F.col(order).alias("last_line"), F.col("_f").alias("_fb")), [key, "last_line"])
    w = Window.partitionBy(key).orderBy("first_line")
    near = F.coalesce(F.col("_fa") - F.lag("_fb").over(w) - 1 <= gap, F.lit(False))
    out = a.withColumn("_new", F.when(near, 0).otherwise(1)).withColumn("area", F.sum("_new").over(_before(key, "first_line")))
    return out.groupBy(key, "area").agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))


def without_areas(lines: DataFrame, areas: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    inside = (F.col(f"l.{key}") == F.col(f"a.{key}")) & (F.col(f"l.{order}") >= F.col("a.first_line")) & (F.col(f"l.{order}") <= F.col("a.last_line"))
    return lines.alias("l").join(areas.alias("a"), inside, "left_anti")


def zones(areas: DataFrame, sizes: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """The lines that each contents area governs: from behind it to the next area, or the end; numbers are shifted by
    the lines removed before. Without sizes the last zone of a document has no end."""
    w = Window.partitionBy(key).orderBy("first_line")
    gone = F.sum(F.col("last_line") - F.col("first_line") + 1).over(_before(key, "first_line"))
    rows = areas.withColumn("n_lines", F.lit(1 << 40)) if sizes is None else areas.join(sizes, key)
    end = F.coalesce(F.lead("first_line").over(w) - 1, F.col("n_lines") - 1)
    return rows.withColumn("zone_start", F.col("last_line") + 1 - gone).withColumn("zone_end", end - gone).select(key, "area", "zone_start", "zone_end")


def governed(lines: DataFrame, zone: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Each line with its zone: the last zone that starts at or before it, and whether it is still inside."""
    marks = lines.select(key, F.col(order).alias("_at"), F.lit(1).alias("_k"), F.lit(None).cast("struct<area:int,zone_end:int>").alias("_z")).unionByName(
        zone.select(key, F.col("zone_start").cast("int").alias("_at"), F.lit(0).alias("_k"), F.struct(F.col("area").cast("int").alias("area"), F.col("zone_end").cast("int").alias("zone_end")).alias("_z"))
    )
    w = Window.partitionBy(key).orderBy("_at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("_z", F.last("_z", True).over(w)).filter("_k = 1")
    return lines.join(found.select(key, F.col("_at").alias(order), F.when(F.col("_at") <= F.col("_z.zone_end"), F.col("_z.area")).alias("zone")), [key, order])


def indent_levels(entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """Levels of entries that have none, by the rank of their indentation among these."""
    rank = F.dense_rank().over(Window.partitionBy(key, F.col("level").isNull()).orderBy("indent"))
    return entries.withColumn("level", F.coalesce("level", rank))


def toc_tree(entries: DataFrame, key: str = "doc_id", order: str = "entry_no") -> DataFrame:
    """Entries with parents; level -1 stands one below the deepest."""
    deep = F.max("level").over(Window.partitionBy(key))
    return heading_parents(entries.withColumn("level", F.when(F.col("level") == -1, F.least(deep + 1, F.lit(6))).otherwise(F.col("level"))), key, order)


def size_levels(heads: DataFrame, key: str = "doc_id") -> DataFrame:
    """Levels 1 to 5 of headings by height: above the values at 80, 60, 40 and 20 per cent of the sorted heights."""
    w = Window.partitionBy(key)
    rows = heads.withColumn("_v", F.array_sort(F.collect_list("height").over(w)))
    at = lambda p: F.element_at("_v", (F.floor(F.size("_v") * p / 100) + 1).cast("int"))
    h = F.col("height")
    return rows.withColumn("size_level", F.when(h >= at(80), 1).when(h >= at(60), 2).when(h >= at(40), 3).when(h >= at(20), 4).otherwise(5)).drop("_v")


def _contents_title(c: str) -> Column:
    """A line or a contents entry, cleaned so that both are alike."""
    return F.lower(T.normal_heading(T.toc_title(T.markdown_heading(F.col(c))["title"])))


def body_start(lines: DataFrame, titles: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """The first line that is a level-1 contents title, after cleaning."""
    return lines.withColumn("_t", _contents_title("line")).join(titles.select(key, _contents_title("title").alias("_t")).filter(F.length("_t") >= 2).distinct(), [key, "_t"]).groupBy(key).agg(F.min(order).alias("body_line"))


def demoted(rows: DataFrame, boundary: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Headings before the boundary of their document become body."""
    return rows.join(boundary.select(key, F.col("body_line").alias("_b")), key, "left").withColumn("level", F.when(F.col(order) < F.col("_b"), -1).otherwise(F.col("level"))).drop("_b")


def merged_shards(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines of shards (shard_no, line_no, title, level) in one order; a shard's last heading goes if the next shard that
    has headings begins with the same title and level."""
    w = Window.partitionBy(key).orderBy("shard_no")
    heads = lines.filter("level > 0").groupBy(key, "shard_no").agg(F.min_by(F.struct("title", "level"), "line_no").alias("_first"), F.max_by(F.struct("title", "level"), "line_no").alias("_last"), F.max("line_no").alias("_at"))
    gone = heads.withColumn("_next", F.lead("_first").over(w)).filter("_last = _next").select(key, "shard_no", F.col("_at").alias("line_no"))
    kept = lines.join(gone, [key, "shard_no", "line_no"], "left_anti")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy("shard_no", "line_no")) - 1)


def heights(heads: DataFrame, spans: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Heights of headings from layout spans: the n-th heading of a text takes the n-th span of it, more of them the
    last; long texts without any take the first span that holds them."""
    norm = F.lower(F.regexp_replace(T.folded_width(T.text_or_empty(F.col("_s"))), r"\s+", ""))
    a = heads.withColumn("_s", F.col("title")).withColumn("_t", norm).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_t").orderBy(order)))
    b = spans.withColumn("_s", F.col("text")).withColumn("_t", norm).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_t").orderBy("span_no")))
    exact = a.join(b.select(key, "_t", "_n", F.col("height").alias("_h")), [key, "_t", "_n"], "left")
    last = b.groupBy(key, "_t").agg(F.max_by("height", "_n").alias("_l"))
    out = exact.join(last, [key, "_t"], "left").withColumn("height", F.coalesce("_h", "_l")).drop("_h", "_l")
    left = out.filter(F.col("height").isNull() & (F.length("_t") >= 10)).select(key, order, F.col("_t").alias("_x"))
    inside = left.join(b.select(key, "_t", "height", "span_no").filter("height > 0"), key).filter(F.contains("_t", "_x")).groupBy(key, order).agg(F.min_by("height", "span_no").alias("_f"))
    return out.join(inside, [key, order], "left").withColumn("height", F.coalesce("height", "_f")).drop("_f", "_s", "_t", "_n")


def occurrences(heads: DataFrame, key: str = "doc_id") -> DataFrame:
    return heads.withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy(key, F.lower(T.normal_heading(F.col("title"))))))


def leaf_rows(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Leaves of a section tree (node, parent, title, content) with their path; empty leaves go, repeated paths get part numbers.

    Paths are built from the top, level by level (at most 8).
    """
    inner = nodes.select(key, F.col("parent").alias("node")).filter("node is not null").distinct()
    paths = nodes.filter("parent is null").select(key, "node", F.col("title").alias("path"))
    all_ = paths
    for _ in range(7):
        paths = nodes.join(paths.select(key, F.col("node").alias("parent"), F.col("path").alias("_up")), [key, "parent"]).select(key, "node", F.concat_ws("/", "_up", "title").alias("path"))
        all_ = all_.unionByName(paths)
    leaves = nodes.join(inner, [key, "node"], "left_anti").filter(F.trim(T.text_or_empty(F.col("content"))) != "").join(all_, [key, "node"])
    n = F.row_number().over(Window.partitionBy(key, "path").orderBy("node"))
    return leaves.withColumn("_n", n).withColumn("path", F.when(F.col("_n") > 1, F.concat("path", F.lit(" part "), F.col("_n"))).otherwise(F.col("path"))).drop("_n")


def text_before(rows: DataFrame, keys: list[str], order: str = "line_no", most: int = 100) -> DataFrame:
    """The nearest usable text before each asset in its section, its last `most` characters."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    usable = F.when((F.col("kind") == "text") & (F.trim("text") != ""), F.trim("text"))
    return rows.withColumn("context", F.right(F.last(usable, True).over(w), F.lit(most)))


#: Lines that hold a comment, a table or an image are no headings; they stand as this text.
FIGURE = "Figure/Image"


def heading_candidates(lines: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Filled lines with title, level (-1: body) and reason, the codes of the evidence for and against a heading.

    A level is the larger of the marker's and the numbering's depth; numbering of one depth alone counts as level 1.
    """
    bare = F.trim("line")
    other = (F.contains(bare, F.lit("<!--")) & F.contains(bare, F.lit("-->"))) | F.startswith(bare, F.lit("|")) | F.startswith(bare, F.lit("<table>")) | (F.contains(bare, F.lit("![")) & F.contains(bare, F.lit("](")))
    md = T.markdown_heading(bare)
    rows = lines.filter(bare != "").withColumns({"title": F.when(other, FIGURE).otherwise(F.trim(T.without_bold(md["title"]))), "_marker": F.when(~other, md["level"])})
    # in steps, so that what several expressions go by is made once
    codes = rows.withColumn("_head", T.numbering(F.col("title"))).withColumns({"_for": T.numbering_depths(F.col("_head")), "_against": T.body_evidence(F.col("title"), punctuation=True)})
    codes = codes.withColumns({"_depth": F.array_max("_for"), "_body": F.array_max("_against") > 0})
    level = F.when(F.col("_marker").isNull(), -1).otherwise(T.level_by(F.col("_marker"), F.col("_depth"), F.col("_body"), fallback=True))
    reason = F.when(F.col("_marker").isNull(), FIGURE).otherwise(F.concat(F.lit("POS "), F.col("_for").cast("string"), F.lit(" NEG "), F.col("_against").cast("string")))
    return codes.withColumns({"level": level, "reason": reason}).drop("_marker", "_head", "_for", "_against", "_depth", "_body")


def predicted_titles(lines: DataFrame, titles: DataFrame | None = None, areas: DataFrame | None = None, marks: DataFrame | None = None, key: str = "doc_id", order: str = "line_no", word_text: bool = False) -> DataFrame:
    """Headings of documents: key, order, title, level.

    1. Candidates by markers and numbering (heading_candidates). 2. Lines before the first level-1 title of a document's
    contents (titles) become body. 3. Where areas gives a document two or more contents areas (area, first_line, last_line,
    numbered before their lines were taken out), each line belongs to the zone of the area before it, and lines of no zone are
    no headings; a document with one area or none is one zone. 4. In word_text broken body lines are joined and short gaps
    between like headings closed, within zones. 5. Lines named in marks (key, order) go on the heading before them. 6. Leaves that
    are only children go, levels become depths.

    Lines are dealt by key once, with marks and the starts of zones as rows between them; all steps are windows and groups within a key.
    """
    kind = lines.schema[order].dataType
    rows = lines.filter(F.trim("line") != "").select(key, order, "line", F.lit(1).alias("_k"))
    if areas is not None:
        zone = zones(areas.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).filter("_n > 1"), None, key)
        start = zone.select(key, F.col("zone_start").cast(kind).alias(order), F.struct(F.col("zone_end").alias("end"), F.col("area").alias("area")).alias("_z"))
        # no zone governs what stands before the first one
        none = start.groupBy(key).agg(F.lit(-(1 << 31)).cast(kind).alias(order)).withColumn("_z", F.lit(None).cast(start.schema["_z"].dataType)).withColumn("_z", F.struct(F.col("_z.end").alias("end"), F.col("_z.area").alias("area")))
        rows = rows.unionByName(start.unionByName(none).withColumn("_k", F.lit(0)), allowMissingColumns=True)
    if marks is not None:
        rows = rows.unionByName(marks.select(key, order, F.lit(0).alias("_k"), F.col(order).alias("_m")), allowMissingColumns=True)
    if titles is not None:
        wanted = titles.select(key, _contents_title("title").alias("_t")).filter(F.length("_t") >= 2).groupBy(key).agg(F.collect_set("_t").alias("_titles"))
        rows = rows.join(wanted, key, "left")
    last = Window.partitionBy(key).orderBy(order, "_k", *(["_z"] if areas is not None else [])).rowsBetween(Window.unboundedPreceding, 0)
    placed = {c: F.last(c, True).over(last) for c in ("_z", "_m") if c in rows.columns}
    rows = rows.withColumns(placed).filter("_k = 1") if placed else rows
    if titles is not None:
        at = F.when(F.col("_titles").isNotNull() & F.array_contains("_titles", _contents_title("line")), F.col(order))
        rows = rows.withColumn("_at", at).withColumn("_start", F.min("_at").over(Window.partitionBy(key)))
    if areas is not None:
        rows = rows.filter(F.col("_z").isNull() | (F.col(order) <= F.col("_z.end")))
    rows = heading_candidates(rows, key, order)
    if titles is not None:
        rows = rows.withColumn("level", F.when(F.col(order) < F.col("_start"), -1).otherwise(F.col("level")))
    part = F.lit(0) if areas is None else F.coalesce("_z.area", F.lit(0))
    mark = F.lit(None).cast("string") if marks is None else F.when(F.col("_m") == F.col(order), "<")
    rows = rows.select(key, part.alias("_part"), order, "title", "level", "reason", mark.alias("mark"))
    if word_text:
        rows = merged_gaps(joined_body(rows, [key, "_part"], order, ("reason", "mark")).drop("last_line", "n_rows"), [key, "_part"], order)
    rows = rows.select(key, order, "title", "level", "mark")
    if marks is not None:
        rows = continued_headings(rows.filter("level > 0 or mark = '<'"), key, order)
    return without_single_leaves(rows.filter("level > 0").select(key, order, "title", "level"), key, order)


def labelled_areas(blocks: DataFrame, key: str = "doc_id", order: str = "block_no", label: str = "toc") -> DataFrame:
    """Contents areas from the layout's labels: runs of blocks with that label (whatever its case), an entry per filled line."""
    w = Window.partitionBy(key).orderBy(order)
    is_ = F.lower(T.text_or_empty(F.col("label"))) == label
    new = (is_ & ~F.coalesce(F.lag(is_).over(w), F.lit(False))).cast("int")
    rows = blocks.withColumn("_is", is_).withColumn("_new", new).withColumn("area", F.sum("_new").over(_before(key, order))).filter("_is")
    entries = F.filter(F.split("text", "\r?\n"), lambda x: F.trim(x) != "")
    return rows.select(key, "area", order, F.posexplode(entries).alias("entry_no", "entry"))


def entry_levels(entries: DataFrame, key: str = "doc_id", order: str = "block_no") -> DataFrame:
    """Contents entries (entry, explicit_level, outline_level, indent) with their level: explicit, else the outline's, else that
    of the numbering, else the rank of the indentation among the entries of the area that have none; levels below 1 go."""
    own = F.coalesce("explicit_level", "outline_level", T.toc_level(F.col("entry")))
    rows = indent_levels(entries.withColumn("level", own).withColumn("_area", F.struct(key, "area")), "_area").drop("_area")
    return rows.filter("level > 0")
