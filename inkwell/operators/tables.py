"""Tables as cells (table_id, row, col, value): pipes, HTML, headers, regions, records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import by_keys

NUMBER = r"^\s*[-+]?[$¥€]?\d[\d,]*(?:\.\d+)?%?\s*$"
DATE = r"^\s*\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?\s*$"


#: Tables that a task turns into Python objects at once.
AT_ONCE = 256


def _each_table(cells: DataFrame, keys: list[str], columns: list[str], work: Callable[[list[dict]], pa.RecordBatch], kinds: str) -> DataFrame:
    """work on the cells of each table (dicts of columns) -> a batch, whose rows get the table's keys and, if it has a column _at, the
    table's other columns of the cell at that place. Many tables go to Python at once, as most are small."""
    rest = [c for c in cells.columns if c not in keys]
    sent = by_keys(cells, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("_cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(a, AT_ONCE)
                lists = some.column(len(keys))
                flat, offsets = lists.flatten(), [0]
                table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(flat)]).select(columns).to_pylist()
                table_of, made, at = [], [], []
                for n, size in enumerate(lists.value_lengths().to_pylist()):
                    one = work(table[offsets[-1] : offsets[-1] + size])
                    if "_at" in one.schema.names:
                        at += [offsets[-1] + k for k in one.column("_at").to_pylist()]
                        one = one.drop_columns(["_at"])
                    offsets.append(offsets[-1] + size)
                    table_of += [n] * one.num_rows
                    made.append(one)
                places = pa.array(table_of, pa.int64())
                own = [(k, some.column(i).take(places)) for i, k in enumerate(keys)]
                own += [(c, flat.field(c).take(pa.array(at, pa.int64()))) for c in rest] if at else []
                made = pa.Table.from_batches(made).combine_chunks()
                if made.num_rows:
                    own += [(c, made.column(c).chunk(0)) for c in made.schema.names]
                    yield pa.RecordBatch.from_arrays([x for _, x in own], names=[c for c, _ in own])

    return sent.mapInArrow(run, kinds)


def pipe_cells(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Runs of pipe lines as cells: the first row sets the width, longer rows are cut, shorter ones padded, separator rows go."""
    w = Window.partitionBy(key).orderBy("line_no")
    is_ = F.col("line").rlike(r"^\s*\|.*\|\s*$")
    marked = lines.withColumn("_is", is_)
    marked = marked.withColumn("_new", (F.col("_is") & ~F.coalesce(F.lag("_is").over(w), F.lit(False))).cast("int")).withColumn("table_no", F.sum("_new").over(w)).filter("_is")
    body = marked.filter(~F.col("line").rlike(r"^\s*\|(?:\s*:?-+:?\s*\|)+\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    t = Window.partitionBy(key, "table_no").orderBy("line_no")
    rows = body.withColumn("_c", cells).withColumn("row", F.row_number().over(t) - 1).withColumn("_w", F.first(F.size("_c")).over(t))
    fit = F.slice(F.concat("_c", F.array_repeat(F.lit(""), F.col("_w"))), 1, F.col("_w"))
    return rows.select(key, "table_no", "row", F.posexplode(fit).alias("col", "value"))


def html_cells(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Cells of the innermost HTML tables, with one look at each table; html_tables() also reads tables that hold tables."""
    tables = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"(?is)<table\b[^>]*>((?:(?!<table\b).)*?)</table>"), F.lit(1))
    rows = pages.select(key, F.posexplode(tables).alias("table_no", "_t")).select(key, "table_no", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))).alias("row", "_r"))
    heads = F.regexp_extract_all("_r", F.lit(r"(?is)<(t[dh])\b"), F.lit(1))
    cells = F.regexp_extract_all("_r", F.lit(r"(?is)<t[dh]\b([^>]*>.*?)</t[dh]>"), F.lit(1))
    out = rows.select(key, "table_no", "row", F.posexplode(F.arrays_zip(cells.alias("c"), heads.alias("h"))).alias("col", "_x"))
    span = lambda kind: F.coalesce(F.regexp_extract("_x.c", rf"(?i){kind}\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1))
    value = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("_x.c", r"(?s)^[^>]*>", ""), r"(?s)<[^>]+>", " "), r"\s+", " "))
    return out.select(key, "table_no", "row", "col", value.alias("value"), (F.lower("_x.h") == "th").alias("is_header"), span("rowspan").alias("rowspan"), span("colspan").alias("colspan"))


def _nested_cells(tags: list[str], texts: list[str]) -> list[tuple]:
    """The tags of a page and the texts behind them -> its cells: table_no, depth, row, col, tag, own texts, and the parent's table_no, row, col.

    A stack holds the tables that are open: number, rows begun, cell open (or none), cells begun in the row, parent. A row begins a table's
    first row only once, so cells before the first row tag stand in it, too.
    """
    out: list[tuple] = []
    stack: list[list] = []
    number = 0
    for tag, text in zip(tags, texts, strict=True):
        low = tag[:7].lower()
        shut = low[1] == "/"
        kind = low[1 + shut : 3 + shut]
        if kind == "ta":
            if shut:
                if stack:
                    stack.pop()
            else:
                up = stack[-1] if stack else None
                inside = up is not None and up[2] is not None
                stack.append([number, 0, None, 0, (up[0], max(up[1] - 1, 0), up[3] - 1) if inside else (None, None, None)])
                number += 1
        elif stack:
            top = stack[-1]
            if kind == "tr":
                top[2] = None
                if not shut:
                    top[1] += 1
                    if top[1] > 1:
                        top[3] = 0
            elif shut:
                top[2] = None
            else:
                top[3] += 1
                top[2] = (top[0], len(stack), max(top[1] - 1, 0), top[3] - 1, tag, [], *top[4])
                out.append(top[2])
        if stack and stack[-1][2] is not None:
            stack[-1][2][5].append(text)
    return out


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Cells of all HTML tables, of those inside tables, too: key, table_no, depth, row, col, value, is_header, rowspan, colspan,
    and for a table inside another one the parent_table, parent_row and parent_col that hold it.

    Tags and the texts behind them are lists of a page, which one pass with a stack of open tables turns into cells, so that nothing is
    shuffled. A cell's value is its own text, before and behind a table inside it, without that table's.
    Tables are numbered in the order in which they open; a closing tag without an opening one is left out, an open end ends with the page.
    """
    tag = r"(?is)<(/?)(table|tr|t[dh])\b[^>]*>"
    text = F.coalesce(F.col(html), F.lit(""))
    texts = F.transform(F.slice(F.split(text, tag, -1), F.lit(2), F.greatest(F.size(F.split(text, tag, -1)) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"(?s)<[^>]*>", " "))
    sent = pages.select(F.col(key).alias("_key"), F.regexp_extract_all(text, F.lit(tag), F.lit(0)).alias("_tags"), texts.alias("_texts"))
    names = ["table_no", "depth", "row", "col", "_tag", "_text", "parent_table", "parent_row", "parent_col"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(a, AT_ONCE)
                at, made = [], []
                for n, (tags, own) in enumerate(zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)):
                    cells = _nested_cells(tags, own)
                    at += [n] * len(cells)
                    made += [(*c[:5], " ".join(c[5]), *c[6:]) for c in cells]
                if made:
                    columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), *columns], names=["_key", *names])

    kind = sent.schema["_key"].dataType.simpleString()
    out = sent.mapInArrow(run, f"_key {kind}, table_no long, depth int, row long, col long, _tag string, _text string, parent_table long, parent_row long, parent_col long")
    span = lambda c: F.coalesce(F.regexp_extract("_tag", rf"(?i){c}\s*=\s*[\"']?(\d+)", 1).try_cast("int"), F.lit(1))
    value = F.trim(F.regexp_replace("_text", r"\s+", " "))
    is_header = F.lower(F.regexp_extract("_tag", tag, 2)) == "th"
    return out.select(F.col("_key").alias(key), "table_no", "depth", "row", "col", value.alias("value"), is_header.alias("is_header"), span("rowspan").alias("rowspan"), span("colspan").alias("colspan"), "parent_table", "parent_row", "parent_col")


def header_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Headers with row and column spans as names by column: values from top to bottom joined by ' > ', repeats once.

    Header rows are those of <th> cells, at least the first; a table's cells are one group of bounded size.
    """

    def expand(rows: list[dict]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: (r["row"], r["col"]))
        deep = max([1, *(r["rowspan"] for r in rows if r["row"] == 0)])
        grid: dict[tuple[int, int], str] = {}
        for r in rows:
            if r["row"] >= deep:
                continue
            c = 0
            while (r["row"], c) in grid:
                c += 1
            for y in range(r["row"], min(r["row"] + r["rowspan"], deep)):
                for x in range(c, c + r["colspan"]):
                    grid[(y, x)] = r["value"]
        names, seen = [], {}
        for x in range(1 + max((x for _, x in grid), default=-1)):
            parts: list[str] = []
            for y in range(deep):
                v = grid.get((y, x), "")
                if v and (not parts or parts[-1] != v):
                    parts.append(v)
            name = " > ".join(parts)
            seen[name] = seen.get(name, -1) + 1
            names.append(name if not seen[name] else f"{name}>>>{seen[name]}")
        n = len(names)
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(names, pa.string()), pa.array([deep] * n, pa.int32())], names=["col", "header", "header_rows"])

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in keys)
    return _each_table(cells, keys, ["row", "col", "value", "rowspan", "colspan"], expand, f"{kinds}, col int, header string, header_rows int")


def unique_names(columns: DataFrame, keys: list[str], name: str = "header") -> DataFrame:
    """Names that repeat get >>>k."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy("col")) - 1
    return columns.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 0, F.concat(name, F.lit(">>>"), "_n")).otherwise(F.col(name))).drop("_n")


def filled_headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Blank header cells filled from the left, then from the right."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    v = F.nullif(F.trim("value"), F.lit(""))
    left = F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(v, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return cells.withColumn("value", F.coalesce(left, right))


def with_header_levels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Body cells with the names of their columns, one level per header row (an array, from the top).

    Header rows are those up to the first row that has a value, or row 0 if none has; each is filled from the left, then from the right, and is
    '' where it has no value at all. Body rows are numbered from 0.
    """
    filled = F.max((F.trim(F.coalesce("value", F.lit(""))) != "").cast("int"))
    first = cells.groupBy(*keys, "row").agg(filled.alias("_f")).groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_f") == 1, F.col("row"))), F.lit(0)).alias("_head"))
    placed = cells.join(first, keys)
    heads = filled_headers(placed.filter(F.col("row") <= F.col("_head")), keys)
    levels = F.transform(F.array_sort(F.collect_list(F.struct("row", F.coalesce("value", F.lit("")).alias("v")))), lambda x: x["v"])
    names = heads.groupBy(*keys, "col").agg(levels.alias("levels"))
    return placed.filter(F.col("row") > F.col("_head")).withColumn("row", F.col("row") - F.col("_head") - 1).drop("_head").join(names, [*keys, "col"], "left")


def is_data(value: Column) -> Column:
    return value.rlike(NUMBER) | value.rlike(DATE)


def header_region(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Leading rows without numbers and dates, and leading columns without them below those rows."""
    rows = cells.groupBy(*keys, "row").agg(F.max(F.coalesce(is_data(F.col("value")), F.lit(False))).alias("_data"))
    top = rows.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_data"), F.col("row"))), F.max("row") + 1).alias("header_rows"))
    below = cells.join(top, keys).filter(F.col("row") >= F.col("header_rows"))
    cols = below.groupBy(*keys, "col").agg(F.max(F.coalesce(is_data(F.col("value")), F.lit(False))).alias("_data"))
    side = cols.groupBy(*keys).agg(F.coalesce(F.min(F.when(F.col("_data"), F.col("col"))), F.max("col") + 1).alias("header_cols"))
    return top.join(side, keys, "left").fillna(0, ["header_cols"])


def index_columns(cells: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Up to three leading columns that are filled and not numeric in all data rows (row 0 is the header)."""
    ok = cells.filter("row > 0").groupBy(*keys, "col").agg(F.min((F.trim(F.coalesce("value", F.lit(""))) != "") & ~is_data(F.coalesce("value", F.lit("")))).alias("_ok"))
    w = Window.partitionBy(*keys).orderBy("col")
    return ok.withColumn("_all", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_all") & (F.col("col") < most)).select(*keys, "col")


def filled_merges(cells: DataFrame, merges: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the value of the top-left cell of the merged range (min_row, max_row, min_col, max_col) they are in."""
    c, m = cells.alias("c"), merges.alias("m")
    near = [F.col(f"c.{k}") == F.col(f"m.{k}") for k in keys]
    inside = (F.col("c.row") >= F.col("m.min_row")) & (F.col("c.row") <= F.col("m.max_row")) & (F.col("c.col") >= F.col("m.min_col")) & (F.col("c.col") <= F.col("m.max_col"))
    for n in near:
        inside = inside & n
    met = c.join(m, inside, "left").select("c.*", F.col("m.min_row").alias("_r"), F.col("m.min_col").alias("_c"))
    own = cells.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_v"))
    return met.join(own, [*keys, "_r", "_c"], "left").withColumn("value", F.when(F.col("_r").isNotNull(), F.col("_v")).otherwise(F.col("value"))).drop("_r", "_c", "_v")


def sheet_parts(cells: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Sheets split at blank rows and columns, again and again; parts with fewer than `least` cells join the nearest.

    One sheet is one group; a sheet is bounded by its format.
    """

    def split(rows: list[dict]) -> pa.RecordBatch:
        filled = [(r["row"], r["col"]) for r in rows if r["value"] is not None and str(r["value"]).strip()]
        parts, work = [], [filled] if filled else []
        while work:
            part = work.pop()
            for axis in (0, 1):
                groups, last = [], None
                for x in sorted({p[axis] for p in part}):
                    if last is None or x - last > 1:
                        groups.append([])
                    groups[-1].append(x)
                    last = x
                if len(groups) > 1:
                    of = {x: n for n, g in enumerate(groups) for x in g}
                    cut: list[list] = [[] for _ in groups]
                    for p in part:
                        cut[of[p[axis]]].append(p)
                    work += cut
                    break
            else:
                parts.append(sorted(part))
        parts.sort()
        while len(parts) > 1 and len(small := min(parts, key=len)) < least:
            rest = [p for p in parts if p is not small]
            near = min(rest, key=lambda p: min(abs(a - x) + abs(b - y) for a, b in small for x, y in p))
            near += small
            near.sort()
            parts = sorted(rest)
        part_of = {cell: n for n, part in enumerate(parts) for cell in part}
        at = [k for k, r in enumerate(rows) if (r["row"], r["col"]) in part_of]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([part_of[rows[k]["row"], rows[k]["col"]] for k in at], pa.int32())], names=["_at", "part"])

    names = ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in [*keys, *(c for c in cells.columns if c not in keys)])
    return _each_table(cells, keys, ["row", "col", "value"], split, f"{names}, part int").select(*cells.columns, "part")


def records(cells: DataFrame, keys: list[str], header_rows: int = 1) -> DataFrame:
    """Rows below the headers as maps from header to value; multi-row headers are joined by ' > '."""
    heads = cells.filter(F.col("row") < header_rows)
    heads = filled_headers(heads, keys).groupBy(*keys, "col").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"])), " > ").alias("header"))
    heads = unique_names(heads, keys)
    body = cells.filter((F.col("row") >= header_rows) & F.col("value").isNotNull())
    return body.join(heads, [*keys, "col"]).groupBy(*keys, "row").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("col", "header", "value"))), lambda x: F.struct(x["header"], x["value"]))).alias("record"))


def cleaned(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Without blank rows and columns; line breaks become spaces, times at midnight become dates."""
    v = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("value", F.lit(""))), r"[\r\n]+", " "), r"^(\d{4}-\d{2}-\d{2})[ T]00:00:00$", "$1")
    rows = cells.withColumn("value", v)
    full = rows.filter("value <> ''")
    return rows.join(full.select(*keys, "row").distinct(), [*keys, "row"], "left_semi").join(full.select(*keys, "col").distinct(), [*keys, "col"], "left_semi")


def keywords(headers: DataFrame, keys: list[str], name: str = "header") -> DataFrame:
    """Distinct header names in order, without blanks, nan and Unnamed."""
    good = headers.filter(F.col(name).isNotNull() & (F.trim(name) != "") & (F.lower(name) != "nan") & ~F.col(name).rlike("^Unnamed"))
    return good.groupBy(*keys).agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("col", name))), lambda x: x[name])), ";").alias("keywords"))


def previews(cells: DataFrame, keys: list[str], items: int = 10, size: int = 20) -> DataFrame:
    """The first row and column: distinct values, cut, joined by ' | '."""
    def shown(rows: DataFrame, order: str, out: str) -> DataFrame:
        values = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order, "value"))), lambda x: F.substring(F.trim(x["value"]), 1, size)), lambda x: x != ""))
        return rows.groupBy(*keys).agg(F.array_join(F.slice(values, 1, items), " | ").alias(out))

    return shown(cells.filter("row = 0"), "col", "first_row").join(shown(cells.filter("col = 0"), "row", "first_col"), keys, "full")


def sheet_names(sheets: DataFrame, workbook: str = "workbook", sheet: str = "sheet") -> DataFrame:
    """Sheet names that repeat after trimming get _k."""
    n = F.row_number().over(Window.partitionBy(workbook, F.trim(sheet)).orderBy("sheet_no"))
    return sheets.withColumn("_n", n).withColumn("name", F.when(F.col("_n") > 1, F.concat(F.trim(sheet), F.lit("_"), F.col("_n"))).otherwise(F.trim(sheet))).drop("_n")


def sampled_rows(rows: DataFrame, keys: list[str], order: str, n: int, draw: Column | None = None) -> DataFrame:
    """The first, middle (those with the least draw, a hash by default) and last n rows of tables with more than 3n + 1 rows;
    others whole. Tables are bounded by their format."""
    draw = F.xxhash64(order) if draw is None else draw
    w, t = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(order)
    ranked = rows.withColumn("_i", F.row_number().over(t)).withColumn("_k", F.count(F.lit(1)).over(w))
    ends = (F.col("_i") <= n) | (F.col("_i") > F.col("_k") - n)
    mid = ranked.withColumn("_end", ends).withColumn("_h", F.row_number().over(Window.partitionBy(*keys, "_end").orderBy(draw, order)))
    return mid.filter((F.col("_k") <= 3 * n + 1) | F.col("_end") | (F.col("_h") <= n)).drop("_i", "_k", "_end", "_h")


def unpivoted(rows: DataFrame, key: str) -> DataFrame:
    """A relational table as cells, one table per key, with its column names as row 0."""
    names = [c for c in rows.columns if c != key]
    heads = rows.select(F.col(key)).distinct().select(key, F.lit(0).alias("row"), F.posexplode(F.lit(names)).alias("col", "value"))
    w = Window.partitionBy(key).orderBy(*names)
    body = rows.withColumn("row", F.row_number().over(w)).select(key, "row", F.posexplode(F.array(*[F.col(c).cast("string") for c in names])).alias("col", "value"))
    return heads.unionByName(body)
