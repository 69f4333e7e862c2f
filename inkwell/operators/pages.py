"""Pages: features, kinds, contents anchors, profiles, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunking import lines_of

METRICS = ("raw_text_length", "text_density", "image_coverage", "table_count", "drawings_count")


def text_features(pages: DataFrame, text: str = "text", lines: int = 30) -> DataFrame:
    """Text features of pages: length without white space around it, characters per 10,000 units of area, orientation, whether the page is as good
    as blank, and its first lines. Geometry (width, height, image_coverage, drawings_count) comes with the pages; null counts as 0."""
    bare = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", "")
    size = F.length(bare)
    at = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("width", "height", "image_coverage", "drawings_count")}
    filled = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.withColumns({
        "raw_text_length": size, "text_density": F.round(size / F.greatest(at["width"] * at["height"], F.lit(1.0)) * 10000, 4), "orientation": F.when(at["width"] > at["height"], "landscape").otherwise("portrait"),
        "is_blank_like": (size < 20) & (at["image_coverage"] < 0.02) & (at["drawings_count"] < 5), "text_lines_preview": F.slice(filled, 1, lines),
    })


def page_kind(length: Column, coverage: Column, tables: Column, drawings: Column, orientation: Column) -> Column:
    """struct<kind, confidence>; the first rule that holds counts."""
    rules = [
        ((length < 80) & (coverage < 0.02) & (drawings < 5), "low_content", 0.78), (orientation == "landscape", "landscape", 0.78), ((coverage >= 0.35) & (length < 250), "image_heavy", 0.84),
        ((tables > 0) | (drawings >= 80), "table_heavy", 0.72),
    ]
    out = None
    for test, kind, sure in rules:
        value = F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit("normal").alias("kind"), F.lit(0.65).alias("confidence")))


def kind_samples(labelled: DataFrame, by: list[str], most: int = 8) -> DataFrame:
    """Pages per kind and the first few of them."""
    w = Window.partitionBy(*by, "kind").orderBy("page")
    rows = labelled.withColumn("_n", F.row_number().over(w))
    return rows.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n_pages"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col("page")))).alias("pages"))


def profile(pages: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS, digits: int = 4) -> DataFrame:
    """Mean, median, 90th percentile and extremes (with the lowest page) of each metric."""
    long = pages.select(*by, "page", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select(*by, "page", "_m.*")
    return long.groupBy(*by, "metric").agg(
        F.round(F.avg("value"), digits).alias("mean"), F.round(F.percentile("value", F.lit(0.5)), digits).alias("p50"), F.round(F.percentile("value", F.lit(0.9)), digits).alias("p90"), F.min("value").alias("least"),
        F.min_by("page", F.struct("value", "page")).alias("least_page"), F.max("value").alias("most"), F.min_by("page", F.struct((-F.col("value")).alias("v"), F.col("page").alias("p"))).alias("most_page"),
    )


def shape(pages: DataFrame, by: list[str]) -> DataFrame:
    share = lambda test: F.round(F.avg(test.cast("double")), 4)
    c = F.col
    return pages.groupBy(*by).agg(
        share(c("orientation") == "landscape").alias("landscape"), share((c("raw_text_length") < 50) & (c("image_coverage") >= 0.5)).alias("scan_like"),
        share(c("image_coverage") >= 0.35).alias("image_heavy"), share((c("table_count") > 0) | (c("drawings_count") >= 25)).alias("table_signal"),
    )


def recurring(lines: DataFrame, by: list[str], share: float = 0.3) -> DataFrame:
    """Lines (by, page, line) that stand on more than share of a document's pages (on more than one): template."""
    pages = lines.groupBy(*by).agg(F.countDistinct("page").alias("_pages"))
    on = lines.select(*by, "page", "line").distinct().groupBy(*by, "line").agg(F.count(F.lit(1)).alias("n_pages"))
    return on.join(pages, by).filter(F.col("n_pages") > F.greatest(F.floor(share * F.col("_pages")), F.lit(1))).drop("_pages")


#: Words that announce a table of contents (fixed values).
TOC_WORDS = r"(?i)^\s*(?:#+\s*)?(?:table\s+of\s+contents|contents|目\s*录|目\s*次)\s*$"


def toc_anchors(pages: DataFrame, by: list[str], text: str = "text", first: int = 30) -> DataFrame:
    """Pages with a line that announces contents, or whose first ten lines do when joined; fingerprints that recur on
    more than 30 % of the pages are dropped; the first ones per document."""
    lines = pages.select(*by, "page", F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("_l"))
    hit = F.filter("_l", lambda x: x.rlike(TOC_WORDS))
    joined = F.array_join(F.slice("_l", 1, 10), "").rlike(r"(?i)tableofcontents|目\s*录")
    found = lines.filter((F.size(hit) > 0) | joined).withColumn("fingerprint", F.lower(F.array_join(hit, "|")))
    number = pages.groupBy(*by).agg(F.countDistinct("page").alias("_pages"))
    again = found.groupBy(*by, "fingerprint").agg(F.count(F.lit(1)).alias("_times"))
    kept = found.join(again, [*by, "fingerprint"]).join(number, by).filter(F.col("_times") <= F.greatest(F.floor(0.3 * F.col("_pages")), F.lit(1)))
    w = Window.partitionBy(*by).orderBy("page")
    return kept.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= first).select(*by, "page", "fingerprint")


def grep(pages: DataFrame, pattern: str, key: str, text: str = "text", around: int = 20, most: int | None = None) -> DataFrame:
    """Places of a pattern: offset from 0 and the snippet around it, the first `most` per row if asked.

    Text is cut at the matches, so offsets are sums of the lengths before.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1)).alias("m"), F.split(t, pattern, -1).alias("b"))
    kind = "struct<at:int,out:array<struct<match:string,offset:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<match:string,offset:int>>").alias("out")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + F.length(x["b"])
        return F.when(x["m"].isNull(), s).otherwise(F.struct((at + F.length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct(x["m"].alias("match"), at.alias("offset")))).alias("out")).cast(kind))

    places = F.aggregate(pairs, start, step, lambda s: s["out"])
    places = F.slice(places, 1, most) if most is not None else places
    cut = lambda x: F.substring(t, F.greatest(x["offset"] - around, F.lit(0)) + 1, F.least(x["offset"], F.lit(around)) + F.length(x["match"]) + around)
    rows = pages.select(key, F.posexplode(F.transform(places, lambda x: F.struct(x["match"].alias("match"), x["offset"].alias("offset"), cut(x).alias("snippet")))).alias("n", "_x"))
    return rows.select(key, "n", "_x.match", "_x.offset", "_x.snippet")


def title_pages(titles: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """The first page of the same document whose text holds a title; of titles with the same page the first by order.

    Documents are the blocks of the comparison; titles are few per document.
    """
    norm = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", ""))
    met = pages.select(*by, "page", norm("text").alias("_t")).join(titles.withColumn("_x", norm("title")).filter("_x <> ''"), by).filter(F.contains("_t", "_x"))
    first = met.groupBy(*by, "title_no", "title").agg(F.min("page").alias("page"))
    w = Window.partitionBy(*by, "page").orderBy("title_no")
    return first.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def page_cuts(headings: DataFrame, most: int, least: int = 1) -> DataFrame:
    """(doc_id, page_count, h1_pages sorted) -> cuts: while more than `most` pages remain, cut before the last heading
    in reach; without one, stop."""
    kind = "struct<start:int,cuts:array<int>,open:boolean>"
    start = F.struct(F.lit(1).alias("start"), F.array().cast("array<int>").alias("cuts"), F.lit(True).alias("open")).cast(kind)

    def step(s: Column, _: Column) -> Column:
        more = s["open"] & (F.col("page_count") - s["start"] + 1 > most)
        fit = F.array_max(F.filter("h1_pages", lambda h: (h > s["start"]) & (h - s["start"] <= most)))
        go = more & fit.isNotNull()
        return F.when(go, F.struct(fit.cast("int").alias("start"), F.concat(s["cuts"], F.array((fit - 1).cast("int"))).alias("cuts"), F.lit(True).alias("open")).cast(kind)).otherwise(F.struct(s["start"], s["cuts"], F.lit(False)).cast(kind))

    return headings.withColumn("cuts", F.aggregate(F.sequence(F.lit(1), F.greatest(F.size("h1_pages"), F.lit(1))), start, step, lambda s: s["cuts"]))


def shards(cut: DataFrame) -> DataFrame:
    """Cuts as page ranges with offsets and a continuation flag."""
    ends = cut.select("doc_id", "page_count", F.posexplode(F.concat("cuts", F.array(F.col("page_count").cast("int")))).alias("shard_index", "page_end"))
    w = Window.partitionBy("doc_id").orderBy("shard_index")
    begin = F.coalesce(F.lag("page_end").over(w), F.lit(0)) + 1
    return ends.select("doc_id", "shard_index", begin.alias("page_start"), "page_end", (begin - 1).alias("page_offset"), (F.col("shard_index") > 0).alias("is_continuation"), "page_count")


def shard_errors(plan: DataFrame, most: int) -> DataFrame:
    """What is wrong with a shard plan."""
    w = Window.partitionBy("doc_id").orderBy("shard_index")
    size = F.col("page_end") - F.col("page_start") + 1
    name = F.concat(F.lit("shard "), F.col("shard_index"))
    tests = F.array(
        F.when(F.col("page_start") != F.coalesce(F.lag("page_end").over(w), F.lit(0)) + 1, F.concat(name, F.lit(" is not contiguous"))), F.when(F.col("page_offset") != F.col("page_start") - 1, F.concat(name, F.lit(" has a wrong offset"))),
        F.when(size > most, F.concat(name, F.lit(f" exceeds max_pages={most}"))), F.when(size < 1, F.concat(name, F.lit(" is empty"))), F.when(F.lead("page_end").over(w).isNull() & (F.col("page_end") != F.col("page_count")), F.concat(name, F.lit(" does not end at the last page"))),
    )
    return plan.select("doc_id", F.array_compact(tests).alias("_e")).select("doc_id", F.explode("_e").alias("error"))


def page_lines(docs: DataFrame, key: str, text: str, per_page: int = 40) -> DataFrame:
    """Lines of texts dealt to pages of per_page lines."""
    return lines_of(docs, key, text).select(key, (F.floor(F.col("line_no") / per_page) + 1).cast("int").alias("page"), "line_no", "line")


def toc_pages(lines: DataFrame, areas: DataFrame, key: str = "doc_id", order: str = "line_no") -> DataFrame:
    """Pages that hold lines of contents areas (first_line, last_line): a line is on the page of the last marker
    <!-- page n --> at or before it; lines before the first marker are on page 1."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.regexp_extract("line", r"(?i)^\s*<!--\s*page\s+(\d+)\s*-->", 1).try_cast("int")
    rows = lines.select(key, order, mark.alias("_mark")).withColumn("page", F.coalesce(F.last("_mark", True).over(w), F.lit(1))).filter("_mark is null").alias("l")
    inside = (F.col(f"l.{key}") == F.col(f"a.{key}")) & F.col(f"l.{order}").between(F.col("a.first_line"), F.col("a.last_line"))
    return rows.join(areas.alias("a"), inside, "left_semi").select(key, "page").distinct()
