"""Scopes, exclusions and path predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk types by data_type (fixed values); 1 allows all.
ALLOWED_TYPES = {2: ["text"], 3: ["image"], 4: ["table"], 5: ["text", "image"], 6: ["text", "table"]}
SEP = " / "


def namespace_of(name: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("default"))


def section_parts(path: Column) -> Column:
    """A section path as an array; blank and Root are empty."""
    parts = F.filter(F.transform(F.split(F.coalesce(path, F.lit("")), r"\s+/\s+"), lambda x: F.trim(x)), lambda p: p != "")
    return F.when(F.trim(F.coalesce(path, F.lit(""))) == "Root", F.array().cast("array<string>")).otherwise(parts)


def normal_section(path: Column) -> Column:
    parts = section_parts(path)
    return F.when(F.size(parts) == 0, "Root").otherwise(F.array_join(parts, SEP))


def same_or_below(path: Column, scope: Column) -> Column:
    return (path == scope) | F.startswith(path, F.concat(scope, F.lit(SEP)))


def is_ancestor(a: Column, b: Column) -> Column:
    """Array path a is a strict prefix of array path b."""
    return (F.size(a) < F.size(b)) & (F.slice(b, 1, F.greatest(F.size(a), F.lit(0))) == a)


def covered(path: Column, scopes: Column) -> Column:
    """Array path is, or is below, one of the scopes (array of array paths)."""
    return F.exists(scopes, lambda s: (s == path) | is_ancestor(s, path))


def ancestors(path: Column) -> Column:
    """All prefixes of an array path, itself last."""
    return F.when(F.size(path) > 0, F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.slice(path, 1, i))).otherwise(F.array().cast("array<array<string>>"))


def scoped(chunks: DataFrame, documents: DataFrame, revision: str = "revision_id") -> DataFrame:
    """Chunks of active documents' current revision."""
    current = documents.filter("status = 'active'").select("document_id", F.col("current_revision_id").alias(revision))
    return chunks.join(current, ["document_id", revision])


def in_scope(chunks: DataFrame, documents: DataFrame, queries: DataFrame, sections: DataFrame | None = None, revision: str = "revision_id") -> DataFrame:
    """query_id and the chunks that each query (query_id, user_id, namespace) may see: of its user's active documents in its
    namespace (blank: default), the current revision; with the section's title and level where sections are given."""
    asked = queries.select("query_id", "user_id", namespace_of(F.col("namespace")).alias("namespace"))
    own = documents.filter("status = 'active'").select("document_id", "user_id", namespace_of(F.col("namespace")).alias("namespace"), F.col("current_revision_id").alias(revision))
    rows = chunks.drop("user_id", "namespace").join(own, ["document_id", revision]).join(asked, ["user_id", "namespace"])
    if sections is None:
        return rows
    return rows.join(sections.select("document_id", "section_path", "section_title", "section_level"), ["document_id", "section_path"], "left")


def without_documents(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    return rows.join(excluded.select("document_id").distinct(), "document_id", "left_anti")


def without_sections(rows: DataFrame, excluded: DataFrame, path: str = "section_path") -> DataFrame:
    """Rows outside the excluded subtrees (document_id, section_path): each row's path prefixes are looked up, so
    the join is an equi join however deep the paths are."""
    cut = excluded.select("document_id", F.col(path).alias("_cut")).distinct()
    parts = section_parts(F.col(path))
    prefixes = F.when(F.size(parts) == 0, F.array(F.lit("Root"))).otherwise(F.transform(ancestors(parts), lambda p: F.array_join(p, SEP)))
    hit = rows.select("document_id", path, F.explode(prefixes).alias("_cut")).join(cut, ["document_id", "_cut"], "left_semi").select("document_id", path).distinct()
    return rows.join(hit, ["document_id", path], "left_anti")


def types_allowed(chunk_type: Column, data_type: Column) -> Column:
    allowed = F.create_map(*[x for k, v in ALLOWED_TYPES.items() for x in (F.lit(k), F.lit(v))])
    own = F.try_element_at(allowed, data_type)
    return own.isNull() | F.array_contains(own, chunk_type)


def by_signals(path: Column, signals: Column, mode: str = "delete", null_passes: bool = False) -> Column:
    """Whether a row passes: its path holds (keep) or does not hold (delete) any signal, whatever the case.

    A null path is the empty path; with null_passes it passes both modes, as small scopes want it.
    """
    hit = F.exists(signals, lambda s: F.contains(F.lower(F.coalesce(path, F.lit(""))), F.lower(s)))
    keep = F.size(signals) == 0
    keep = keep | (hit if mode == "keep" else ~hit)
    return keep | path.isNull() if null_passes else keep


def cited(rows: DataFrame) -> DataFrame:
    """Public columns and the citation struct."""
    return rows.withColumn("citation", F.struct("document_id", "chunk_id", "section_path"))
