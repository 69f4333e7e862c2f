"""Scans and source-side projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Format by file suffix (fixed values).
FORMATS = {
    ".txt": "text", ".fragment": "fragment", ".png": "image", ".jpg": "image", ".jpeg": "image", ".pdf": "pdf", ".doc": "doc", ".docx": "docx",
    ".xls": "xls", ".xlsx": "xlsx", ".pptx": "pptx", ".md": "markdown", ".json": "json",
}
#: File suffix by content type (fixed values).
CONTENT_TYPES = {
    "text/plain": ".txt", "text/markdown": ".md", "text/html": ".html", "application/json": ".json", "application/pdf": ".pdf", "image/png": ".png", "image/jpeg": ".jpg", "application/msword": ".doc",
    "application/vnd.ms-excel": ".xls", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
}
#: Programming language by file suffix (fixed values).
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "javascript", ".tsx": "typescript", ".java": "java", ".cpp": "cpp", ".c": "c", ".h": "c", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby",
    ".php": "php", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".sh": "shell", ".pl": "perl", ".sql": "sql", ".html": "html", ".css": "css", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".md": "markdown",
}
#: Named character references that plain text keeps (fixed values).
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (path, text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.[^./\\]+$", 0))


def routed(files: DataFrame, name: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files with their format, and the rejected rest."""
    rows = files.withColumn("format", _lookup(FORMATS, suffix(F.col(name))))
    return rows.filter("format is not null"), rows.filter("format is null").drop("format")


def code_language(path: Column) -> Column:
    return F.coalesce(_lookup(LANGUAGES, suffix(path)), F.lit("unknown"))


def url_suffix(url: Column, content_type: Column | None = None) -> Column:
    """A file suffix from the URL's path, else from the content type."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own = F.nullif(F.lower(F.regexp_extract(path, r"\.[A-Za-z0-9]{1,5}$", 0)), F.lit(""))
    return own if content_type is None else F.coalesce(own, _lookup(CONTENT_TYPES, F.lower(F.trim(F.element_at(F.split(content_type, ";"), 1)))))


def plain_html(html: Column) -> Column:
    """Plain text of simple HTML: comments, scripts, styles and tags go, common references are decoded."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, value in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


SPAN = "array<struct<spans:array<struct<content:string,height:double>>>>"
LAYOUT = f"array<struct<page:int,blocks:array<struct<type:string,lines:{SPAN},cells:array<string>,blocks:array<struct<type:string,lines:{SPAN}>>>>>>"


def layout_spans(docs: DataFrame, key: str = "doc_id", layout: str = "layout") -> DataFrame:
    """Spans of layout JSON (pages, blocks that may nest once, lines, spans): page, block type, text, height; table cells have height 0."""
    pages = docs.select(key, F.explode(F.from_json(layout, LAYOUT)).alias("p")).select(key, "p.page", F.posexplode("p.blocks").alias("block", "b"))
    line = lambda path: F.flatten(F.transform(F.coalesce(path, F.array().cast(SPAN)), lambda x: x["spans"]))
    inner = F.flatten(F.transform(F.coalesce("b.blocks", F.array().cast(f"array<struct<type:string,lines:{SPAN}>>")), lambda x: line(x["lines"])))
    cells = F.transform(F.coalesce("b.cells", F.array().cast("array<string>")), lambda c: F.struct(c.alias("content"), F.lit(0.0).alias("height")))
    return pages.select(key, "page", "block", F.col("b.type").alias("type"), F.explode(F.concat(line(F.col("b.lines")), inner, cells)).alias("s")).select(key, "page", "block", "type", F.trim("s.content").alias("text"), "s.height").filter("text <> ''")


def html_titles(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, position, level and title (as it stands between the tags) of the headings h1 to h6 of pages, in order."""
    pattern = F.lit(r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]>")
    text = F.coalesce(F.col(html), F.lit(""))
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("level"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("title"))
    rows = pages.select(F.col(key).alias("_key"), F.posexplode(found).alias("position", "_h"))
    return rows.select(F.col("_key").alias(key), "position", F.col("_h.level").cast("int").alias("level"), "_h.title")


# --- bundles and canonical records --------------------------------------------------------------------


def bundle_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with metadata by type, ready to be written by namespace: all have length, summary and page numbers, texts also tokens,
    keywords and connections, media their keywords and file (a table without one is named after the end of its path).

    Columns that chunks lacks (summary, page_nums, tokens, keywords, connect_to, file_path, document_top_summary) count as null.
    """
    kinds = {"summary": "string", "page_nums": "array<int>", "tokens": "array<string>", "keywords": "array<string>", "file_path": "string", "document_top_summary": "string", "connect_to": "array<struct<target:string,relation:string,ref:string>>"}
    at = {c: F.col(c) if c in chunks.columns else F.lit(None).cast(t) for c, t in kinds.items()}
    first = F.lower(F.trim(F.split(F.trim("chunk_type"), "\n")[0]))
    kind = F.when(first.isin("image", "table"), first).otherwise("text")
    text, table = kind == "text", kind == "table"
    named = F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), -1)).otherwise(F.concat(F.lit("table_"), F.col("chunk_id"), F.lit(".html")))
    file = F.when(table, F.coalesce(F.nullif(at["file_path"], F.lit("")), F.concat(F.lit("tables/"), named))).when(~text, at["file_path"])
    meta = F.struct(
        F.length("content").alias("length"), F.coalesce(at["summary"], F.lit("")).alias("summary"), F.coalesce(at["page_nums"], F.array().cast("array<int>")).alias("page_nums"),
        F.nullif(F.trim(F.coalesce(at["document_top_summary"], F.lit(""))), F.lit("")).alias("document_top_summary"), F.when(text, at["tokens"]).otherwise(F.array().cast("array<string>")).alias("tokens"),
        F.coalesce(at["keywords"], F.array().cast("array<string>")).alias("keywords"), F.when(text, at["connect_to"]).alias("connect_to"), file.alias("file_path"), F.element_at(F.split(file, "/"), -1).alias("original_name"),
    )
    return chunks.select("namespace", "document_id", "chunk_id", kind.alias("type"), "content", "path", meta.alias("metadata"), F.col("sort_order").alias("order"))


def manifests(chunks: DataFrame, version: str = "2.0") -> DataFrame:
    """A JSON manifest per document, of its statistics alone (see full_manifests)."""
    stats = _statistics(chunks)
    return stats.select("document_id", F.to_json(F.struct(F.lit(version).alias("version"), "document_id", "statistics")).alias("manifest"))


def _statistics(chunks: DataFrame) -> DataFrame:
    stats = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("chunk_type") == k).alias(k) for k in ("text", "image", "table")])
    return stats.select("document_id", F.struct("total", "text", "image", "table").alias("statistics"))


def full_manifests(jobs: DataFrame, chunks: DataFrame, trees: DataFrame, version: str = "2.0") -> DataFrame:
    """document_id and its JSON manifest: names, time, cost and stages of the job that made it, statistics of its chunks and the tree of
    its titles (trees: document_id, hierarchy, see sections.hierarchies).

    jobs: document_id, job_id, data_id, source_file_name, processed_at, page_count, billing_status, micro_dollars, credits, started_at,
    completed_at, stages (a map of milliseconds). Fields that are null are left out; a document without chunks has an empty tree.
    """
    took = (F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))).alias("duration_ms")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    cost, timing = F.struct("micro_dollars", "credits").alias("cost"), F.struct(stamp("started_at"), stamp("completed_at"), took).alias("timing")
    rows = jobs.join(_statistics(chunks), "document_id", "left").join(trees, "document_id", "left")
    head = F.to_json(F.struct(
        F.lit(version).alias("version"), "job_id", "data_id", "source_file_name", F.concat(F.date_format("processed_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("processing_date"),
        F.struct("page_count", "billing_status", cost, timing, F.coalesce("stages", F.create_map().cast("map<string,long>")).alias("stages")).alias("processing"), "statistics",
    ))
    body = F.substring(head, F.lit(1), F.length(head) - 1)
    return rows.select("document_id", F.concat(body, F.lit(',"HIERARCHY":'), F.coalesce("hierarchy", F.lit("{}")), F.lit("}")).alias("manifest"))


def write_bundles(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("namespace").parquet(path)


MODEL = "1.0.0"


def to_canonical(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(F.lit(MODEL).alias("canonical_model_version"), *rows.columns)).alias("value"))


def from_canonical(values: DataFrame, schema: str, body: str = "value") -> tuple[DataFrame, DataFrame]:
    """Records of this major version, and the rest with a reason."""
    marked = values.withColumn("_v", F.get_json_object(body, "$.canonical_model_version"))
    good = F.split("_v", r"\.")[0] == MODEL.split(".")[0]
    rows = marked.filter(good).select(F.from_json(body, schema).alias("r")).select("r.*")
    bad = marked.filter(~F.coalesce(good, F.lit(False))).select(body, F.when(F.col("_v").isNull(), "missing version").otherwise("other version").alias("reason"))
    return rows, bad


#: For each kind of record its columns: the names that providers use, in order of priority, and the default (fixed values).
FIELDS = {
    "file": {"repository_id": (["repository_id"], None), "path": (["path"], ""), "content": (["content"], ""), "language": (["language"], None)},
    "symbol": {
        "name": (["name"], ""), "qualified_name": (["qualified_name"], ""), "repository_id": (["repository_id"], ""), "file_id": (["file_id"], ""), "kind": (["kind"], "unknown"), "scope": (["scope"], ""),
        "signature": (["signature"], ""), "documentation": (["documentation"], ""),
    },
    "chunk": {"text": (["text", "content"], ""), "repository_id": (["repository_id"], ""), "file_id": (["file_id"], ""), "chunk_type": (["chunk_type"], "code"), "ordering": (["ordering"], 0)},
    "relationship": {"source_id": (["source_id"], ""), "target_id": (["target_id"], ""), "type": (["type"], "unknown"), "repository_id": (["repository_id"], ""), "weight": (["weight"], None)},
}
PLACES = ("start_line", "start_column", "end_line", "end_column")


def adapted(records: DataFrame, kind: str) -> DataFrame:
    """Provider records as canonical entities: of the names present the first value that is not null, else the default.

    Files get the language of their suffix where none is given, the size and the SHA-256 of their UTF-8 content; symbols and
    chunks get their place (lines and columns from 1) as location. provider and record_id stay.
    """
    columns = set(records.columns)

    def value(names: list[str], default) -> Column:
        here = [F.col(n) for n in names if n in columns]
        return F.coalesce(*here, F.lit(default)) if default is not None else F.coalesce(*here) if here else F.lit(None).cast("string")

    out = {c: value(names, default) for c, (names, default) in FIELDS[kind].items()}
    if kind == "file":
        content = out.pop("content")
        out["language"] = F.coalesce(out["language"], code_language(out["path"]))
        out |= {"checksum": F.sha2(content, 256), "size_bytes": F.octet_length(content).cast("long")}
    elif kind in ("symbol", "chunk"):
        out["location"] = T.location_text(*[value([c], 1) for c in PLACES])
    return records.select(*[c for c in ("provider", "record_id") if c in columns], *[v.alias(c) for c, v in out.items()])


def duplicate_groups(chunks: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Texts that several rows of any file or provider hold: semantic hash, number, least key."""
    rows = chunks.select(F.sha2(F.col(text), 256).alias("semantic_hash"), F.col(key).alias("first_id")).filter("semantic_hash is not null")
    return rows.groupBy("semantic_hash").agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("first_id")).filter("n > 1")


def canonical_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with canonical ids and hashes of their text."""
    place = T.location_text(F.col("start_line"), F.lit(1), F.col("end_line"), F.lit(1))
    return chunks.withColumn("location", place).withColumn("id", T.canonical_id(F.col("repository_id"), F.col("file_id"), F.col("location"))).withColumn("semantic_hash", F.sha2(T.text_or_empty(F.col("text")), 256))
