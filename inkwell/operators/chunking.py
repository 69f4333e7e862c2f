"""Lines of documents packed into chunks, and chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import dealt

MOST, LEAST = 2000, 500


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text", blank: bool = False) -> DataFrame:
    """key, line_no (from 0) and line of every line; blank ones only if asked."""
    out = docs.select(key, F.posexplode(F.split(T.text_or_empty(F.col(text)), "\r?\n")).alias("line_no", "line"))
    return out if blank else out.filter(F.trim("line") != "")


def pack_bounds(sizes: Column, most: int = MOST) -> Column:
    """array of sizes -> places (from 1) at which groups begin: items join the open group while the sum stays within most."""
    kind = "struct<sum:bigint,at:int,out:array<int>>"
    start = F.struct(F.lit(-1).cast("bigint").alias("sum"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("out")).cast(kind)

    def step(s: Column, n: Column) -> Column:
        fits = (s["sum"] >= 0) & (s["sum"] + n <= most)
        return F.struct(F.when(fits, s["sum"] + n).otherwise(n).cast("bigint").alias("sum"), (s["at"] + 1).alias("at"), F.when(fits, s["out"]).otherwise(F.concat(s["out"], F.array(s["at"]))).alias("out")).cast(kind)

    return F.aggregate(sizes, start, step, lambda s: s["out"])


def pack_ids(sizes: Column, most: int = MOST) -> Column:
    """array of sizes -> array of group numbers, see pack_bounds."""
    bounds = pack_bounds(sizes, most)
    ends = F.concat(F.slice(bounds, 2, F.greatest(F.size(bounds) - 1, F.lit(0))), F.array(F.size(sizes) + 1))
    return F.flatten(F.zip_with(bounds, F.transform(ends, lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda b, x: F.array_repeat(x["i"], x["e"] - b)))


def packed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST, least: int = LEAST, more: tuple[str, ...] = ()) -> DataFrame:
    """key, chunk_no, n_lines, n_chars, content: lines that are not blank, packed in order to at most `most` characters;
    a last group below `least` joins the one before. An oversize line is a group of its own. The document's columns named as more follow, and
    with any the number _n of its groups.

    The fold runs inside one row's array, so documents are packed where they stand, without a shuffle; it keeps the bounds
    of groups only, and each group is a slice, so the work grows with the lines.
    """
    lines = F.filter(F.split(T.text_or_empty(F.col(text)), "\r?\n"), lambda x: F.trim(x) != "")
    base = docs.select(key, *more, lines.alias("_lines")).filter(F.size("_lines") > 0)
    base = base.withColumn("_bounds", pack_bounds(F.transform("_lines", lambda x: F.length(x).cast("bigint")), most))
    chars = lambda own: F.aggregate(own, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    tail = chars(F.slice("_lines", F.element_at("_bounds", -1), F.size("_lines")))
    base = base.withColumn("_bounds", F.when((F.size("_bounds") > 1) & (tail < least), F.slice("_bounds", 1, F.size("_bounds") - 1)).otherwise(F.col("_bounds")))
    groups = F.transform("_bounds", lambda b, i: F.slice("_lines", b, F.coalesce(F.try_element_at("_bounds", i + 2), F.size("_lines") + 1) - b))
    more = (*more, "_n") if more else ()
    out = base.withColumn("_n", F.size("_bounds")).select(key, *more, F.posexplode(groups).alias("chunk_no", "_own"))
    return out.select(key, "chunk_no", F.size("_own").alias("n_lines"), chars(F.col("_own")).alias("n_chars"), F.array_join("_own", "\n").alias("content"), *more)


def named_parts(packed: DataFrame) -> DataFrame:
    """Chunks of documents of _n chunks with their path: the document's file, and 'part k' below it where it has several chunks."""
    file = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt"))
    path = F.when(F.col("_n") > 1, F.concat(file, F.lit("/part "), F.col("chunk_no") + 1)).otherwise(file)
    return packed.withColumn("path", path).withColumn("section_path", F.when(F.col("_n") > 1, F.concat(F.lit("part "), F.col("chunk_no") + 1)).otherwise("Root")).drop("_n")


def chunk_table(docs: DataFrame) -> DataFrame:
    """The corpus as chunks: namespace (language), user_id (source), document_id, chunk_id, chunk_no, content,
    section_path, source_file_name and chunk_type.

    A document's chunks are made and named in its own row. Only documents whose id repeats are dealt by id, as they are one there: their chunks count
    together, and each stands there for each of them. Documents without an id have no chunks.
    """
    docs = dealt(docs)
    meta = [F.col("lang").alias("namespace"), F.col("source").alias("user_id")]
    known = docs.select("doc_id", "text", *meta).filter("doc_id is not null")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("doc_id")
    several = bool(repeated.limit(1).count())
    parts = named_parts(packed_lines(known.join(repeated, "doc_id", "left_anti") if several else known, more=("namespace", "user_id")))
    if several:
        again = known.join(repeated, "doc_id", "left_semi")
        counted = packed_lines(again).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
        parts = parts.unionByName(named_parts(counted).join(again.drop("text"), "doc_id"))
    return parts.select(
        "namespace", "user_id", F.col("doc_id").alias("document_id"), "chunk_no", F.concat(F.col("doc_id"), F.lit("-"), F.col("chunk_no")).alias("chunk_id"),
        "content", "n_lines", "n_chars", "section_path", "path", F.lit("text").alias("chunk_type"),
    )


def merge_same_path(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with one path become one: contents by line, types united, lengths summed, a new id."""
    merged = rows.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "content"))), lambda x: x["content"]), "\n").alias("content"),
        F.array_join(F.array_sort(F.collect_set("type")), ";").alias("type"), F.sum("length").alias("length"), F.count(F.lit(1)).alias("n_rows"),
    )
    return merged.withColumn("chunk_id", T.uuid5(F.col("content")))


def surrounding(lines: DataFrame, key: str = "doc_id", reach: int = 5) -> DataFrame:
    """line_before and line_after: the nearest usable line among the `reach` lines on each side."""
    usable = F.when((F.trim("line") != "") & T.is_content_line(F.col("line")), F.col("line"))
    w = Window.partitionBy(key).orderBy("line_no")
    return lines.withColumn("line_before", F.last(usable, True).over(w.rowsBetween(-reach, -1))).withColumn("line_after", F.first(usable, True).over(w.rowsBetween(1, reach)))
