"""Lists, connections and chunk records from loosely typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

CONNECTION = "struct<target:string,relation:string,ref:string,position:struct<start:int,end:int>,score:double,keywords:array<string>>"


def keyword_list(value: Column) -> Column:
    """Keywords separated by ';', else by ','; single characters are left out."""
    value = F.coalesce(value, F.lit(""))
    parts = F.when(F.contains(value, F.lit(";")), F.split(value, ";")).otherwise(F.split(value, ","))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def token_list(value: Column) -> Column:
    """Tokens of a list literal, or separated by ';' or '->'."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s*\[|\]\s*$", "")
    parts = F.split(bare, r"\s*(?:;|->)\s*")
    literal = F.transform(F.split(bare, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.filter(F.when(F.coalesce(value, F.lit("")).rlike(r"^\s*\[.*\]\s*$"), literal).otherwise(F.transform(parts, lambda x: F.trim(x))), lambda x: x != "")


def page_list(value: Column) -> Column:
    """Whole numbers of a list such as '1;2' or '[1, 2]'."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def connections(value: Column, relation: str = "related", score: float = 1.0) -> Column:
    """Connections from JSON: a list of objects, a list of texts, one text; missing relation and score get defaults."""
    value = F.coalesce(F.trim(value), F.lit(""))
    empty = F.array().cast(f"array<{CONNECTION}>")
    named = lambda t: F.struct(F.trim(t).alias("target"), F.lit(relation).alias("relation"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("struct<start:int,end:int>").alias("position"), F.lit(score).alias("score"), F.array().cast("array<string>").alias("keywords")).cast(CONNECTION)
    full = F.transform(F.from_json(value, f"array<{CONNECTION}>"), lambda c: F.struct(F.trim(c["target"]).alias("target"), F.coalesce(c["relation"], F.lit(relation)).alias("relation"), c["ref"].alias("ref"), c["position"].alias("position"), F.coalesce(c["score"], F.lit(score)).alias("score"), F.coalesce(c["keywords"], F.array().cast("array<string>")).alias("keywords")).cast(CONNECTION))
    texts = F.transform(F.from_json(value, "array<string>"), named)
    plain = F.transform(F.split(value, r"\s*[;,]\s*"), named)
    kind = F.when(value == "", empty).when(value.rlike(r"^\[\s*\{"), full).when(value.rlike(r"^\["), texts).otherwise(plain)
    return F.filter(F.coalesce(kind, empty), lambda c: F.coalesce(c["target"], F.lit("")) != "")


def connected_ids(value: Column) -> Column:
    """Targets of a connection array that are not blank."""
    return F.filter(F.transform(value, lambda c: F.trim(c["target"])), lambda t: t != "")


def chunk_records(rows: DataFrame) -> DataFrame:
    """Parsed rows (content, path, type, length, keywords, summary, tokens, connectto, page_nums) as chunk records.

    The type is the raw type's first line in lower case, ptxt is text; media get a file path and a name."""
    kind = F.lower(F.trim(F.element_at(F.split(F.coalesce("type", F.lit("text")), "\n"), 1)))
    kind = F.when(kind.isin("ptxt", ""), "text").otherwise(kind)
    media = kind.isin("image", "table")
    meta = F.struct(
        keyword_list(F.col("keywords")).alias("keywords"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce(F.col("length"), F.length("content")).alias("length"), token_list(F.col("tokens")).alias("tokens"),
        connections(F.col("connectto")).alias("connect_to"), page_list(F.col("page_nums")).alias("page_nums"), F.when(media, F.col("path")).alias("file_path"), F.when(media, F.element_at(F.split("path", "/"), -1)).alias("original_name"),
    )
    return rows.select("document_id", "sort_order", T.chunk_id(F.col("content"), F.col("path"), F.col("page_nums")).alias("chunk_id"), kind.alias("type"), "content", "path", meta.alias("metadata"))


def leaf_paths(nodes: DataFrame, key: str = "path") -> DataFrame:
    """Of array paths those that no other path continues."""
    inner = nodes.filter(F.size(key) > 1).select(F.slice(key, 1, F.size(key) - 1).alias(key)).distinct()
    return nodes.join(inner, key, "left_anti")


def merged_weights(default: dict[str, float], own: Column) -> Column:
    """Default weights overridden by a query's map."""
    base = F.create_map(*[F.lit(x) for pair in default.items() for x in pair])
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(own, k), F.lit(False))), F.coalesce(own, F.create_map().cast("map<string,double>")))


def path_nodes(leaves: DataFrame, key: str = "path") -> DataFrame:
    """The tree of array paths as rows: every prefix once, with its parent (null at the top), name and number of leaves below."""
    ups = leaves.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(key)), lambda i: F.slice(key, 1, i))).alias("node"))
    rows = ups.groupBy("node").agg(F.count(F.lit(1)).alias("n_leaves"))
    return rows.select("node", F.when(F.size("node") > 1, F.slice("node", 1, F.greatest(F.size("node") - 1, F.lit(1)))).alias("parent"), F.element_at("node", -1).alias("name"), "n_leaves")
