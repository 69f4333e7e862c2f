"""Sections of documents: order, counts, roll-ups, navigation, summaries, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import written
from .filters import SEP, ancestors, section_parts

DOC = ["document_id"]


def _paths(path: Column) -> Column:
    """A path's prefixes as texts, itself last; Root for an empty path."""
    parts = section_parts(path)
    return F.when(F.size(parts) == 0, F.array(F.lit("Root"))).otherwise(F.transform(ancestors(parts), lambda p: F.array_join(p, SEP)))


def section_table(chunks: DataFrame, order: str = "sort_order", keys: list[str] | None = None) -> DataFrame:
    """Every section with its parent, title, level and place: first appearance, ancestors first."""
    keys = keys or DOC
    seen = chunks.select(*keys, order, F.posexplode(_paths(F.col("section_path"))).alias("_depth", "section_path"))
    first = seen.groupBy(*keys, "section_path").agg(F.min(F.struct(order, "_depth")).alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_first", "section_path")
    parts = section_parts(F.col("section_path"))
    n = F.size(parts)
    return first.select(
        *keys, "section_path", F.when(n > 1, F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), SEP)).alias("parent_path"),
        F.when(n > 0, F.element_at(parts, -1)).otherwise("Root").alias("section_title"), n.alias("section_level"), (F.row_number().over(w) - 1).alias("sort_order"),
    )


def direct_counts(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Chunks by type and characters of each section itself."""
    other = ~F.col("chunk_type").isin("image", "table")
    return chunks.groupBy(*(keys or DOC), "section_path").agg(
        F.count_if(other).alias("n_text"), F.count_if(F.col("chunk_type") == "image").alias("n_image"), F.count_if(F.col("chunk_type") == "table").alias("n_table"), F.sum(F.length("content")).alias("n_chars")
    )


def rolled_up(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """direct_counts summed over subtrees; Root counts itself only and shows no media.

    A row goes to each of its prefixes once, so the rows multiply by the depth of the paths, not by their number.
    """
    keys = keys or DOC
    up = counts.withColumn("_at", F.explode(_paths(F.col("section_path"))))
    sums = up.groupBy(*keys, F.col("_at").alias("section_path")).agg(*[F.sum(c).alias(c) for c in ("n_text", "n_image", "n_table", "n_chars")])
    root = F.col("section_path") == "Root"
    return sums.withColumn("n_image", F.when(root, 0).otherwise(F.col("n_image"))).withColumn("n_table", F.when(root, 0).otherwise(F.col("n_table")))


def connected_media(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """For sections without own media: distinct media that their text chunks, or those below, connect to."""
    none = counts.filter("n_image + n_table = 0").select(*DOC, "section_path")
    links = chunks.filter("chunk_type = 'text'").select(*DOC, "section_path", F.explode("connect_to.target").alias("chunk_id")).distinct()
    media = links.join(chunks.filter(F.col("chunk_type").isin("image", "table")).select(*DOC, "chunk_id", "chunk_type"), [*DOC, "chunk_id"])
    up = media.select(*DOC, "chunk_id", "chunk_type", F.explode(_paths(F.col("section_path"))).alias("section_path")).distinct()
    sums = up.groupBy(*DOC, "section_path").agg(F.count_if(F.col("chunk_type") == "image").alias("linked_images"), F.count_if(F.col("chunk_type") == "table").alias("linked_tables"))
    return none.join(sums, [*DOC, "section_path"], "left").fillna(0)


def overview(chunks: DataFrame, documents: DataFrame, newest: int = 50) -> DataFrame:
    """Chunk and media counts of each user's newest documents in a namespace."""
    counts = chunks.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("chunk_type") != "text").alias("n_media"))
    w = Window.partitionBy("user_id", "namespace").orderBy(F.desc("updated_at"), "document_id")
    return documents.filter("status = 'active'").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= newest).drop("_n").join(counts, DOC, "left").fillna(0, ["n_chunks", "n_media"])


def under_scopes(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """Media counts under scopes (scope_id, document_id, path)."""
    up = chunks.select(*DOC, "chunk_type", F.explode(_paths(F.col("section_path"))).alias("path"))
    return up.join(scopes, [*DOC, "path"]).groupBy("scope_id").agg(F.count_if(F.col("chunk_type") == "image").alias("n_image"), F.count_if(F.col("chunk_type") == "table").alias("n_table"))


def statistics(chunks: DataFrame, by: list[str]) -> DataFrame:
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("chunk_type") == k).alias(k) for k in ("text", "image", "table")])


def navigation(chunks: DataFrame, order: str = "sort_order") -> DataFrame:
    """Flat navigation: per section its first summary or preview that is not blank, subtree chunk count, depth below."""
    up = chunks.withColumn("_at", F.explode(_paths(F.col("section_path"))))
    sums = up.groupBy(*DOC, "_at").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.size(section_parts(F.col("section_path")))).alias("_deep"))
    said = F.coalesce(F.nullif(F.trim("summary"), F.lit("")), F.nullif(F.trim(F.substring("content", 1, 200)), F.lit("")))
    own = chunks.withColumn("_said", said).filter("_said is not null").groupBy(*DOC, F.col("section_path").alias("_at")).agg(F.min_by("_said", order).alias("summary"))
    return sums.join(own, [*DOC, "_at"], "left").select(*DOC, F.col("_at").alias("section_path"), "summary", "n_chunks", (F.col("_deep") - F.size(section_parts(F.col("_at")))).alias("depth_below"))


def summaries(sections: DataFrame, max_depth: int = 10) -> DataFrame:
    """Summaries from the leaves up: a leaf keeps its own, one child lends its own, several are listed by title.

    One join per level, from the deepest (at most max_depth) to the first; a document's row has path ''.
    """
    rows = sections.withColumn("summary", F.coalesce("summary", F.lit("")))
    for level in range(max_depth - 1, -1, -1):
        kids = rows.filter(F.col("section_level") == level + 1).groupBy(*DOC, F.coalesce("parent_path", F.lit("")).alias("section_path")).agg(
            F.count(F.lit(1)).alias("_k"), F.min_by("summary", "sort_order").alias("_one"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "section_title"))), lambda x: x["section_title"]), ", ").alias("_titles")
        )
        if level == 0:
            top = kids.select(*DOC, "section_path", F.lit(None).cast("string").alias("parent_path"), F.lit("").alias("section_title"), F.lit(0).alias("section_level"), F.lit(-1).alias("sort_order"), F.concat(F.lit("This document includes: "), "_titles").alias("summary"))
            return rows.select(*DOC, "section_path", "parent_path", "section_title", "section_level", "sort_order", "summary").unionByName(top)
        here = F.col("section_level") == level
        made = F.when(F.col("_k") == 1, F.col("_one")).when(F.col("_k") > 1, F.concat(F.lit("This section covers: "), "_titles")).otherwise(F.col("summary"))
        rows = rows.join(kids, [*DOC, "section_path"], "left").withColumn("summary", F.when(here, made).otherwise(F.col("summary"))).drop("_k", "_one", "_titles")
    return rows


def with_summaries(sections: DataFrame, found: DataFrame) -> DataFrame:
    """Sections with summaries filled in from (document_id, section_path, summary) where they have none."""
    return sections.join(found.select(*DOC, "section_path", F.col("summary").alias("_new")), [*DOC, "section_path"], "left").withColumn("summary", F.coalesce("summary", "_new")).drop("_new")


def unique_titles(sections: DataFrame) -> DataFrame:
    """Sibling titles that repeat get ' (k)'."""
    w = Window.partitionBy(*DOC, "parent_path", "section_title").orderBy("sort_order")
    n = F.row_number().over(w)
    return sections.withColumn("_n", n).withColumn("section_title", F.when(F.col("_n") > 1, F.concat("section_title", F.lit(" ("), "_n", F.lit(")"))).otherwise(F.col("section_title"))).drop("_n")


def section_view(sections: DataFrame, views: DataFrame, scopes: DataFrame | None = None, excluded: DataFrame | None = None, levels: int = 2, counts: DataFrame | None = None) -> DataFrame:
    """What each view (view_id, document_id) shows of its document's sections: the sections below its scopes, of each scope the
    next `levels` depths that occur, and as context (show_summary false) the scopes' ancestors and what stands beside these.

    scopes (view_id, document_id, scope) and excluded (view_id, document_id, path) may hold any number of paths per view;
    a view without scopes shows the whole document. Excluded paths go with all below them, from what is shown, not from the
    context. Root stands at depth 1. With counts (rolled_up) each row has the counts of its subtree. is_leaf: nothing is below.

    Paths meet scopes and exclusions through their own prefixes, at most as many as they are deep, so any number of views is one job.
    """
    at = ["view_id", *DOC]
    parts = section_parts(F.col("section_path"))
    own = F.when(F.size(parts) == 0, F.array(F.lit("Root"))).otherwise(parts)
    rows = views.select(*at).distinct().join(sections, DOC).withColumn("_parts", own).withColumn("depth", F.size("_parts"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", 1, i), SEP))
    ups = rows.select(*at, "section_path", "depth", F.explode(prefixes).alias("_up"))
    if scopes is None:
        scopes = views.sparkSession.createDataFrame([], views.select(*at).withColumn("scope", F.lit("")).schema)
    scopes = scopes.select(*at, "scope").distinct()
    scope_parts = F.split("scope", SEP, -1)
    deepest = scopes.groupBy(*at).agg(F.max(F.size(scope_parts)).alias("_deepest"))
    below = ups.join(scopes.withColumnRenamed("scope", "_up"), [*at, "_up"]).filter("_up <> section_path").select(*at, "section_path", "depth", F.col("_up").alias("_scope"))
    all_ = rows.join(deepest, at, "left_anti").select(*at, "section_path", "depth", F.lit(None).cast("string").alias("_scope"))
    inside = below.unionByName(all_)
    shown = inside
    if excluded is not None:
        out = ups.join(excluded.select(*at, F.col("path").alias("_up")), [*at, "_up"]).select(*at, "section_path").distinct()
        shown = inside.join(out, [*at, "section_path"], "left_anti")
    near = shown.withColumn("_d", F.dense_rank().over(Window.partitionBy(*at, "_scope").orderBy("depth"))).filter(F.col("_d") <= levels).select(*at, "depth").distinct()
    shown = shown.select(*at, "section_path", "depth").distinct().join(near, [*at, "depth"], "left_semi").select(*at, "section_path", F.lit(True).alias("show_summary"))
    chain = scopes.select(*at, F.explode(F.transform(F.sequence(F.lit(1), F.size(scope_parts)), lambda i: F.array_join(F.slice(scope_parts, 1, i), SEP))).alias("_up")).distinct()
    beside = rows.join(deepest, at).filter("depth <= _deepest").withColumn("_up", F.when(F.col("depth") == 1, F.col("section_path")).otherwise(F.array_join(F.slice("_parts", 1, F.greatest(F.col("depth") - 1, F.lit(1))), SEP)))
    context = beside.join(chain, [*at, "_up"], "left_semi").join(inside.select(*at, "section_path").distinct(), [*at, "section_path"], "left_anti").select(*at, "section_path", F.lit(False).alias("show_summary"))
    inner = sections.filter("parent_path is not null").select(*DOC, F.col("parent_path").alias("section_path")).distinct().withColumn("_inner", F.lit(True))
    view = rows.drop("_parts").join(shown.unionByName(context), [*at, "section_path"]).join(inner, [*DOC, "section_path"], "left").withColumn("is_leaf", F.col("_inner").isNull()).drop("_inner")
    return view if counts is None else view.join(counts, [*DOC, "section_path"], "left").fillna(0, [c for c in counts.columns if c.startswith("n_")])


def hierarchies(sections: DataFrame) -> DataFrame:
    """A JSON tree of titles per document: {"title": {children}}, in section order; sibling titles that repeat are numbered.

    Built from the deepest level up, one join per level: what moves are a section's children as one text.
    """
    quoted = lambda c: F.expr(f"substring(to_json(struct({c} AS k)), 6, length(to_json(struct({c} AS k))) - 6)")
    level_of = F.greatest("section_level", F.lit(1)).alias("_level")  # Root stands beside the first level
    rows = written(unique_titles(sections).select(*DOC, "section_path", F.coalesce("parent_path", F.lit("")).alias("_up"), "section_title", level_of, "sort_order"))
    deepest = rows.agg(F.max("_level")).first()[0] or 1
    kids = rows.limit(0).select(*DOC, "section_path", F.lit("{}").alias("_json"))
    for level in range(deepest, 0, -1):
        own = rows.filter(F.col("_level") == level).join(kids, [*DOC, "section_path"], "left")
        own = own.withColumn("_entry", F.concat(quoted("section_title"), F.lit(":"), F.coalesce("_json", F.lit("{}"))))
        kids = own.groupBy(*DOC, F.col("_up").alias("section_path")).agg(_json_object().alias("_json"))
    return kids.select(*DOC, F.col("_json").alias("hierarchy"))


def _json_object() -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "_entry"))), lambda x: x["_entry"]), ","), F.lit("}"))


def ranked_sections(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy(*DOC).orderBy(F.desc("relevance"), F.desc("n_chunks"), F.desc("n_media"), "sort_order")
    return rows.withColumn("rank0", F.row_number().over(w) - 1)


def latest_revisions(revisions: DataFrame, key: str = "document_id", at: str = "job_created_at", revision: str = "revision_id") -> DataFrame:
    """The revision of each document whose job is newest: a completion of an older job changes nothing."""
    return revisions.groupBy(key).agg(F.max_by(F.struct(revision, at), F.struct(at, revision)).alias("_r")).select(key, f"_r.{revision}", f"_r.{at}")


def published(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows after replacing each document's revision that new holds."""
    return old.join(new.select(*DOC).distinct(), DOC, "left_anti").unionByName(new, allowMissingColumns=True)


def renamed_repeats(rows: DataFrame, key: str = "document_id", order: str = "sort_order") -> DataFrame:
    """Paths that repeat get _2, _3 and so on; a row below takes the nearest such parent's new name before it."""
    n = F.row_number().over(Window.partitionBy(key, "path").orderBy(order))
    own = rows.withColumn("_n", n).withColumn("_new", F.when(F.col("_n") > 1, F.concat("path", F.lit("_"), "_n")).otherwise(F.col("path")))
    parents = own.filter("_n > 1").select(key, F.col(order).alias("_at"), F.col("path").alias("_parent"), F.col("_new").alias("_to"))
    ups = own.select(key, order, "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("_parent")).filter("_parent <> path")
    met = ups.join(parents, [key, "_parent"]).filter(F.col("_at") < F.col(order))
    best = met.groupBy(key, order, "path").agg(F.max_by(F.struct("_parent", "_to"), F.struct("_at", F.length("_parent"))).alias("_b"))
    out = own.join(best, [key, order, "path"], "left")
    moved = F.concat(F.col("_b._to"), F.expr("substring(path, length(_b._parent) + 1)"))
    return out.withColumn("path", F.when((F.col("_n") == 1) & F.col("_b").isNotNull(), moved).otherwise(F.col("_new"))).drop("_n", "_new", "_b")


def lineage(chunks: DataFrame, key: str = "chunk_id", parent: str = "parent_id") -> DataFrame:
    """key, root, depth of each chunk, by doubling: each round a pointer jumps twice as far, so rounds grow with the logarithm of
    the deepest chain, however deep. Chains that meet a missing parent end there. Of rows with the same id the least parent counts.

    A cycle, and what leads into one, has root and depth null: rounds end when none has ended a chain, and as long as any chain is
    still open, each round ends one. Every round is written and looks at the open chains only.
    """
    once = chunks.groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("to"))  # repeated ids would multiply with each jump
    jump = once.join(once.select(F.col("node").alias("to"), F.lit(True).alias("_there")), "to", "left")
    known = written(jump.select("node", F.when(F.col("_there"), F.col("to")).otherwise(F.col("node")).alias("to"), F.when(F.col("_there"), 1).otherwise(0).cast("long").alias("far"), F.col("_there").isNull().alias("ended")))
    done, open_ = known.filter("ended"), known.filter("not ended")
    left = open_.count()
    while left:
        ahead = done.unionByName(open_).select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("far").alias("_far"), F.col("ended").alias("_ended"))
        moved = written(open_.join(ahead, "to").select("node", F.col("_to").alias("to"), (F.col("far") + F.col("_far")).alias("far"), F.col("_ended").alias("ended")))
        done, open_, before = done.unionByName(moved.filter("ended")), moved.filter("not ended"), left
        left = open_.count()
        if left == before:
            break
    none = open_.select(F.col("node").alias(key), F.lit(None).cast(chunks.schema[parent].dataType).alias("root"), F.lit(None).cast("long").alias("depth"))
    return done.select(F.col("node").alias(key), F.col("to").alias("root"), F.col("far").alias("depth")).unionByName(none)


def plan_levels(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """steps(plan_id, step_id), needs(plan_id, step_id, needed) -> level of each step, null for steps in or behind a
    cycle or behind a missing step; duplicate ids are marked. There is no limit of levels.

    Each round takes the steps that became free in the last one away from the open needs, and writes what is left.
    """
    rows = steps.groupBy("plan_id", "step_id").agg((F.count(F.lit(1)) > 1).alias("duplicate"))
    open_ = written(needs.select("plan_id", "step_id", "needed").distinct().join(rows.select("plan_id", "step_id"), ["plan_id", "step_id"], "left_semi"))
    free = written(rows.join(open_.select("plan_id", "step_id").distinct(), ["plan_id", "step_id"], "left_anti").select("plan_id", "step_id"))
    done, level = free.withColumn("level", F.lit(0)), 0
    while not free.isEmpty():
        level += 1
        met = free.select("plan_id", F.col("step_id").alias("needed"))
        touched = open_.join(met, ["plan_id", "needed"], "left_semi").select("plan_id", "step_id").distinct()
        open_ = written(open_.join(met, ["plan_id", "needed"], "left_anti"))
        free = written(touched.join(open_.select("plan_id", "step_id"), ["plan_id", "step_id"], "left_anti"))
        done = done.unionByName(free.withColumn("level", F.lit(level)))
    return rows.join(done, ["plan_id", "step_id"], "left")


def issues(declared: DataFrame, actual: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Bundles whose declared count or size differs from what is there, or that miss on one side."""
    both = declared.select(key, F.col("n").alias("declared"), F.col("bytes").alias("declared_bytes")).join(actual.select(key, F.col("n").alias("actual"), F.col("bytes").alias("actual_bytes")), key, "full")
    kind = F.when(F.col("actual").isNull(), "missing").when(F.col("declared").isNull(), "undeclared").when(F.col("declared") != F.col("actual"), "count").when(F.col("declared_bytes") != F.col("actual_bytes"), "size")
    return both.withColumn("issue", kind).filter("issue is not null")


def paged(rows: DataFrame, by: list[str], order: list, page: int, size: int) -> DataFrame:
    """The page-th page (from 1) per group in a stable order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") > (page - 1) * size) & (F.col("_n") <= page * size)).drop("_n")


def split_path(path: Column, file: Column) -> Column:
    """struct<root, section> of a chunk's path: 'file/a/b', 'file-->a-->b', with a leading namespace where the second
    part is the file; media paths stay at Root.

    An arrow splits the first part, or the second if the first is no file name or the second begins with the file.
    """
    suffix = r"(?i)\.(?:txt|md|pdf|docx?|xlsx?|pptx|csv|json|html?|fragment|png|jpe?g)$"
    raw = F.split(F.trim(F.coalesce(path, F.lit(""))), "/")
    name = F.lower(F.element_at(F.split(F.trim(F.coalesce(file, F.lit(""))), r"[/\\]"), -1))

    def arrows(part: Column, may: Column) -> Column:
        parts = F.filter(F.transform(F.split(part, "-->"), lambda x: F.trim(x)), lambda p: p != "")
        good = may & F.contains(part, F.lit("-->")) & F.coalesce(F.try_element_at(parts, F.lit(1)).rlike(suffix), F.lit(False))
        return F.when(F.trim(part) == "", F.array().cast("array<string>")).when(good, parts).otherwise(F.array(F.trim(part)))

    first = F.trim(F.try_element_at(raw, F.lit(1)))
    own = lambda p: (name != "") & (F.lower(F.trim(F.element_at(F.split(p, "-->"), 1))) == name)
    parts = F.flatten(F.transform(raw, lambda p, i: arrows(p, (i == 0) | ((i == 1) & (~first.rlike(suffix) | own(p))))))
    a, b = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    same = lambda p: F.coalesce((name != "") & (F.lower(p) == name), F.lit(False))
    spaced = (F.size(parts) >= 3) & b.rlike(suffix) & F.when(name != "", F.lower(b) == name).otherwise(~a.rlike(suffix))
    at = F.when(same(a), 1).when(same(b), 2).when(spaced, 2).otherwise(1)
    media = a.isin("images", "tables") & ~spaced
    section = F.when(media | (F.size(parts) <= at), F.array().cast("array<string>")).otherwise(F.slice(parts, at + 1, F.greatest(F.size(parts) - at, F.lit(1))))
    return F.struct(F.when(media, a).otherwise(F.try_element_at(parts, at)).alias("root"), F.when(F.size(section) == 0, "Root").otherwise(F.array_join(section, SEP)).alias("section"))


def publication_path(source: Column, raw: Column) -> Column:
    """A chunk's published path: below its source; media under Assets; nothing known under Default_Root."""
    parts = F.filter(F.split(F.coalesce(raw, F.lit("")), "/"), lambda p: F.trim(p) != "")
    first = F.try_element_at(parts, F.lit(1))
    return (
        F.when(F.size(parts) == 0, F.concat_ws("/", source, F.lit("Default_Root"))).when(first == source, F.array_join(parts, "/"))
        .when(first.isin("images", "tables"), F.concat_ws("/", source, F.lit("Assets"), F.array_join(parts, "/"))).otherwise(F.concat_ws("/", source, F.array_join(parts, "/")))
    )


def search_columns(chunks: DataFrame) -> DataFrame:
    """Derived text columns that search reads."""
    title = F.element_at(F.split("section_path", SEP), -1)
    return chunks.withColumns(
        {
            "content_search_text": T.search_text(F.col("content"), F.col("summary")), "path_search_text": T.search_text(F.col("source_file_name"), F.col("section_path"), title, F.col("summary")),
            "term_search_text": T.search_text(F.col("content"), F.col("section_path")), "content_lexical_text": T.lexical_text(F.col("content")), "path_lexical_text": T.lexical_text(F.concat_ws(" ", "source_file_name", "section_path")),
        }
    )


def inventory(chunks: DataFrame, by: list[str]) -> DataFrame:
    """Chunks, documents and chunks per document of each group, whatever sections and signals a query names."""
    n, d = F.count(F.lit(1)), F.count_distinct("document_id")
    return chunks.groupBy(*by).agg(n.alias("n_chunks"), d.alias("n_documents"), F.round(n / d, 4).alias("chunks_per_document"))


def hierarchy_maps(sections: DataFrame) -> DataFrame:
    """For each section with children (and '' for the document) a map from their titles, made unique, to their paths."""
    rows = unique_titles(sections.withColumn("parent_path", F.coalesce("parent_path", F.lit(""))))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "section_title", "section_path"))), lambda x: F.struct(x["section_title"], x["section_path"]))
    return rows.groupBy(*DOC, F.col("parent_path").alias("section_path")).agg(F.map_from_entries(entries).alias("children"))
