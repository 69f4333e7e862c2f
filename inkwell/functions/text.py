"""Text column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"
#: References that stand in chunk text for media.
CHUNK_REF = r"\[(?:images|tables)/[^\]\n]+\]"
#: Words that queries leave out by default (fixed values); pass another list as a parameter.
STOPWORDS = tuple(
    "a about after all also an and any are as at be because been before being between both but by can could did do does during each few for from further had has have having he her here him his how if in into is it its just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who why will with would you your".split()
)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def token_count(text: Column) -> Column:
    """Number of CJK characters, letter runs and numbers."""
    return F.size(F.regexp_extract_all(text_or_empty(text), F.lit(rf"[{CJK}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?"), F.lit(0)))


def tokens(text: Column, stopwords: tuple[str, ...] = (), distinct: bool = False, least: int = 2) -> Column:
    """Search tokens: runs of letters and digits in lower case, runs of CJK characters as bigrams; media
    references and tokens shorter than least are left out."""
    once = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731 - value is made once, however often it is used

    def cut(clean: Column) -> Column:
        runs = F.regexp_extract_all(clean, F.lit(rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"), F.lit(0))
        pairs = lambda own: F.flatten(F.transform(own, lambda r: F.when(r.rlike(rf"^[{CJK}]{{3,}}"), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))).otherwise(F.array(r))))
        # a text that is all ASCII is spared the slower patterns
        return F.when(F.octet_length(clean) == F.length(clean), F.regexp_extract_all(clean, F.lit("[a-z0-9]+"), F.lit(0))).when(clean.rlike(rf"[{CJK}]{{3}}"), pairs(runs)).otherwise(runs)

    text = text_or_empty(text)
    named = lambda low: F.contains(low, F.lit("image")) | F.contains(low, F.lit("table"))
    bare = F.lower(F.regexp_replace(text, rf"(?i){CHUNK_REF}|image-\d+|table-\d+", " "))
    found = once(F.lower(text), lambda low: once(F.when(named(low), bare).otherwise(low), cut))
    if stopwords and not distinct:
        return F.filter(found, lambda t: (F.length(t) >= least) & ~t.isin(*stopwords))
    out = F.filter(found, lambda t: F.length(t) >= least)
    out = F.array_distinct(out) if distinct else out
    return F.array_except(out, F.lit(list(stopwords))) if stopwords else out


def keyword_text(text: Column, stopwords: tuple[str, ...] = STOPWORDS, link: str = ";") -> Column:
    """Distinct tokens without stopwords, joined."""
    return F.array_join(tokens(text, stopwords, distinct=True), link)


def search_text(*parts: Column) -> Column:
    """Parts that are not blank, trimmed, a line each; null if there are none."""
    kept = F.filter(F.array(*[F.trim(text_or_empty(p)) for p in parts]), lambda p: p != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))


def lexical_text(text: Column) -> Column:
    """The text followed by its distinct tokens."""
    return search_text(text, F.array_join(tokens(text, distinct=True), " "))


def language(text: Column) -> Column:
    """zh if at least three of ten tokens are CJK characters, else en."""
    cjk = F.size(F.regexp_extract_all(text_or_empty(text), F.lit(f"[{CJK}]"), F.lit(0)))
    all_ = token_count(text)
    return F.when((all_ > 0) & (cjk / F.greatest(all_, F.lit(1)) >= 0.3), "zh").otherwise("en")


def dominant_language(text: Column) -> Column:
    """zh, en or other by the first 4,000 characters: CJK characters must be 8 or more and half as many as ASCII letters, else
    ASCII letters 20 or more and three times as many as CJK characters (fixed values)."""
    head = F.substring(text_or_empty(text), 1, 4000)
    cjk, ascii_ = F.regexp_count(head, F.lit(f"[{CJK}]")), F.regexp_count(head, F.lit("[A-Za-z]"))
    return F.when(cjk >= F.greatest(F.lit(8.0), ascii_ * 0.5), "zh").when(ascii_ >= F.greatest(F.lit(20), cjk * 3), "en").otherwise("other")


def token_estimate(text: Column) -> Column:
    """Estimated model tokens: CJK/1.5 + word characters/4 + others/3, at least length/2.5 and 1; empty: 0."""
    text = text_or_empty(text)
    size = F.length(text)
    cjk = size - F.length(F.regexp_replace(text, f"[{CJK}]", ""))
    plain = size - F.length(F.regexp_replace(text, "[A-Za-z0-9_]", ""))
    guess = cjk / 1.5 + plain / 4.0 + F.greatest(size - cjk - plain, F.lit(0)) / 3.0
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.greatest(guess, size / 2.5)))).cast("int")


def preview(text: Column, head: int = 200, tail: int = 50) -> Column:
    """The first head and last tail tokens with what stands between them, joined by '...', if there are more."""
    token = rf"(?:[{CJK}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?)"
    other = rf"(?:(?![{CJK}A-Za-z0-9])[\s\S])*+"
    first = F.regexp_extract(text, rf"^({other}(?:{token}{other}){{{head - 1}}}{token})", 1)
    spots = F.regexp_extract_all(text, F.lit(token + other), F.lit(0))
    last = F.array_join(F.slice(spots, -tail, tail), "")
    return F.when(token_count(text) <= head + tail, text_or_empty(text)).otherwise(F.concat(first, F.lit("..."), F.rtrim(last)))


def truncated(text: Column, limit: int) -> Column:
    """The text up to its limit-th token."""
    spots = F.regexp_extract_all(text_or_empty(text), F.lit(rf"[^{CJK}A-Za-z0-9]*(?:[{CJK}]|[A-Za-z]+|[0-9]+(?:\.[0-9]+)?)"), F.lit(0))
    return F.when(F.size(spots) <= limit, text_or_empty(text)).otherwise(F.array_join(F.slice(spots, 1, limit), ""))


def chunk_refs(text: Column) -> Column:
    """Distinct media references in order."""
    return F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit(f"({CHUNK_REF})"), F.lit(1)))


def chunk_ref_spans(text: Column) -> Column:
    """array<struct<ref, start, end>> of media references, offsets from 0."""
    refs = F.regexp_extract_all(text_or_empty(text), F.lit(f"({CHUNK_REF})"), F.lit(1))
    kind = "struct<at:int,out:array<struct<ref:string,start:int,end:int>>>"
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<ref:string,start:int,end:int>>").alias("out")).cast(kind)

    def step(state: Column, ref: Column) -> Column:
        at = F.call_function("locate", ref, text_or_empty(text), state["at"])
        one = F.struct(ref.alias("ref"), (at - 1).alias("start"), (at - 1 + F.length(ref)).alias("end"))
        return F.struct((at + F.length(ref)).alias("at"), F.concat(state["out"], F.array(one)).alias("out")).cast(kind)

    return F.aggregate(refs, start, step, lambda s: s["out"])


def without_refs(text: Column) -> Column:
    """Text without media references and the lines that only label them."""
    clean = F.regexp_replace(text_or_empty(text), rf"(?m)^\s*(?:image|table)\s*:?\s*{CHUNK_REF}\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(clean, CHUNK_REF, ""), r"\n{3,}", "\n\n"))


def uuid5(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """Version-5 UUID of a name; the default namespace is DNS."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(text: Column, path: Column, pages: Column) -> Column:
    """Id of a chunk: of its text without references, or of path and pages if nothing is left."""
    pure = without_refs(text)
    return uuid5(F.when(pure != "", pure).otherwise(F.concat_ws("::", path, pages)))


def canonical_id(*fields: Column) -> Column:
    """SHA-256 of the fields joined by '|'; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[text_or_empty(f.cast("string")) for f in fields]), 256)


def location_text(start_line: Column, start_column: Column, end_line: Column, end_column: Column) -> Column:
    return F.concat(start_line, F.lit(":"), start_column, F.lit("-"), end_line, F.lit(":"), end_column)


def location_parts(text: Column) -> Column:
    """struct of the four numbers and whether they are valid: from 1 on, the end not before the start."""
    n = [F.regexp_extract(text, r"^(\d+):(\d+)-(\d+):(\d+)$", k).try_cast("int") for k in (1, 2, 3, 4)]
    good = (n[0] >= 1) & (n[1] >= 1) & ((n[2] > n[0]) | ((n[2] == n[0]) & (n[3] >= n[1])))
    return F.struct(n[0].alias("start_line"), n[1].alias("start_column"), n[2].alias("end_line"), n[3].alias("end_column"), F.coalesce(good, F.lit(False)).alias("valid"))


def shape_digest(*fields: Column) -> Column:
    """Fingerprint of what shapes a query's result; lists are taken in order of their values."""
    return F.sha2(F.concat_ws("|", *[text_or_empty(f.cast("string")) for f in fields]), 256)


def listed(values: Column, sep: str = ",") -> Column:
    return F.array_join(F.array_sort(F.coalesce(values, F.array().cast("array<string>"))), sep)


# --- headings ------------------------------------------------------------------------------------------

#: Numbering patterns of headings, on the first 20 characters (fixed values).
HEADING_PATTERNS = (
    r"^\d+(?:\s*\.\s*\d+)+(?![、，。！？；：])(?=\s|$|\w|[一-龥])",
    r"^\d、\s{0,4}(?=\S|$)",
    r"^\d+\.(?!\d)\s{0,4}(?=\S)",
    r"^[0-9]{1,2}\s{1,8}(?=\S)",
    r"^\d+(?:\.\d+)*、\s*(?=[A-Za-z一-龥])",
    r"^[一二三四五六七八九十百千万]+、\s{0,4}(?=\S|$)",
    r"^[一二三四五六七八九十百千万]+(?:\s*\.[一二三四五六七八九十百千万\d]+)+",
    r"^[一二三四五六七八九十百千万]+(?=\s|$)",
    r"^[\(\（]\s*\d+(?:\.\d+)*(?!\.0)\s*[\)\）]",
    r"^\d+(?:\.\d+)*(?!\.0)\s*[\)\）]",
    r"^[\(\（]\s*[一二三四五六七八九十百千万]+(?:\.[一二三四五六七八九十百千万\d]+)*\s*[\)\）]",
    r"^[一二三四五六七八九十百千万]+(?:\.[一二三四五六七八九十百千万\d]+)*\s*[\)\）]",
    r"^第[一二三四五六七八九十百千万\d]+(?:\.[一二三四五六七八九十百千万\d]+)*(章|节|条|部分|款|目|项|编|篇|卷|辑)?(?=$|\s|[A-Za-z0-9一-龥])",
    r"^[A-Za-z](?:\.\d+)*[\.、](?=\s*\S)",
    r"^[\(\（]\s*[A-Za-z](?:\.\d+)*(?!\.0)\s*[\)\）]",
    r"^[A-Za-z](?:\.\d+)*(?!\.0)\s*[\)\）]",
    r"^((附件|附录|附表|附图)|(?i:appendix))[\s_\-—]{0,4}(?:\[)?[一二三四五六七八九十A-Za-z\d]",
)
#: How every text begins that one of these matches (fixed value).
NUMBERED = r"^(?:[\d(（一二三四五六七八九十百千万第附]|[A-Za-z][\s.、)）]|(?i:appendix))"
#: Patterns of lines that are no headings (fixed values).
BODY_PATTERNS = (
    r"^\d{3,}",
    r"(?i)(^https?://\S+|^www\.\S+|^P\.S|^\b\d{0,2}\s*(?:a\.m|p\.m)\b)",
    r"(?:\$[^$]*\\[A-Za-z]+(?:\s*\{[^{}]*\})?[^$]*\$|\\(?:times|div|cdot|pm|mp|leq|geq|neq|approx|equiv|sim|infty|sum|prod|int|sqrt|frac|mathrm|mathbf|mathit|mathcal|text(?:bf|it|rm)?|alpha|beta|gamma|delta|epsilon|theta|lambda|mu|sigma|pi|omega|partial|nabla|left|right|begin|end|overline|underline|hat|vec|tilde)\b)",
    r"^0\.\d+\S*",
    r"^\d*\.\d+$",
    r"[。！；].+",
    r"^\d+\.?\d*\s{0,2}(?:mm|cm|km|nm|μm|inch(?:es)?|ft|yd|mi|kg|mg|μg|lb|oz|kPa|MPa|GPa|Pa|psi|bar|°[CFK]|Hz|kHz|MHz|GHz|mol|mL|dL|dB|Nm|kN|MN|kW|MW|GW|hp|rpm|cc|cal|kcal)\b",
)
#: Most tokens of a heading, by language (fixed values).
HEADING_TOKENS = {"zh": 30, "en": 10}


def folded_width(text: Column) -> Column:
    """Full-width ASCII and the ideographic space as their plain forms."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def heading_evidence(text: Column) -> Column:
    """For each numbering pattern its depth: dots and dashes of the match plus one, or 0."""
    return numbering_depths(folded_width(F.substring(text_or_empty(text), 1, 20)))


def numbering(text: Column) -> Column:
    """What numbering_depths goes by: the first characters, or nothing where no pattern can match. To be a column of its own, so that
    it is made once for all patterns."""
    head = folded_width(F.substring(text_or_empty(text), 1, 20))
    return F.when(head.rlike(NUMBERED), head).otherwise("")


def numbering_depths(head: Column) -> Column:
    def depth(pattern: str) -> Column:
        found = F.regexp_extract(head, pattern, 0)
        return F.when(head.rlike(pattern), F.length(found) - F.length(F.translate(found, ".-", "")) + 1).otherwise(0)

    return F.array(*[depth(p) for p in HEADING_PATTERNS])


def body_evidence(text: Column, punctuation: bool = False) -> Column:
    """0/1 for each body pattern, closing punctuation (if asked) and too many tokens."""
    text = text_or_empty(text)
    flags = [text.rlike(p) for p in BODY_PATTERNS]
    flags.append(text.rlike(r"[.,;，。；]$") if punctuation else F.lit(False))
    flags.append(token_count(text) > F.when(language(text) == "zh", HEADING_TOKENS["zh"]).otherwise(HEADING_TOKENS["en"]))
    return F.array(*[f.cast("int") for f in flags])


def markdown_heading(line: Column) -> Column:
    """struct<title, level>: level -1 and the line itself if it is no heading."""
    pattern = r"^\s*(#+)\s*(.*)$"
    is_ = line.rlike(pattern)
    return F.struct(F.when(is_, F.trim(F.regexp_extract(line, pattern, 2))).otherwise(line).alias("title"), F.when(is_, F.length(F.regexp_extract(line, pattern, 1))).otherwise(-1).alias("level"))


def heading_level(line: Column, fallback: bool = False) -> Column:
    """Estimated level: the larger of the marker's and the numbering's depth (only depths over 1 count);
    -1 with body evidence; -2, or 1 in the fallback, if nothing tells."""
    md = markdown_heading(line)
    return level_by(md["level"], F.array_max(heading_evidence(md["title"])), F.array_max(body_evidence(md["title"], punctuation=True)) > 0, fallback)


def level_by(marker: Column, depth: Column, body: Column, fallback: bool = False) -> Column:
    """heading_level from what it goes by: the marker's level (-1: none), the numbering's depth and whether there is body evidence."""
    level = F.greatest(marker, F.when(depth > 1, depth).otherwise(-2))
    none = F.when(depth > 0, F.lit(1 if fallback else -2)).otherwise(-1)
    return F.when(body & (marker < 0), -1).when(level > 0, level).otherwise(none).cast("int")


def without_bold(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), r"^\s*(\*\*|__)(.+?)\1\s*$", "$2")


def normal_heading(text: Column) -> Column:
    return F.trim(F.regexp_replace(folded_width(text_or_empty(text)), r"\s+", " "))


#: What may stand before a contents title, one of these, in any case (fixed values).
LEADING_NUMBERS = (
    r"[#]+\s*",
    r"第\s*[零一二三四五六七八九十百千\d]+\s*[章节篇部分]",
    r"[零一二三四五六七八九十百千]+\s*[、。，,]",
    r"[（(]\s*[零一二三四五六七八九十百千\d]+\s*[）)]",
    r"\d+(?:\.\d+)*\.?\s*",
    r"[IVXLCDM]+\.?\s+",
    r"[A-Za-z]\.\s+",
    r"Chapter\s+\w+\s*",
)
#: A page number at the end of a contents title (fixed value).
PAGE_SUFFIX = r"[\s\.\-·…]+\d+\s*$"


def toc_title(text: Column) -> Column:
    """A contents entry without its page number and without what numbers it."""
    bare = F.trim(F.regexp_replace(text_or_empty(text), PAGE_SUFFIX, ""))
    return F.trim(F.regexp_replace(bare, "(?i)^(?:" + "|".join(LEADING_NUMBERS) + ")", ""))


#: LaTeX commands that mark a line as no contents entry (fixed values).
LATEX = (
    "mathrm", "frac", "sum", "int", "sqrt", "alpha", "beta", "gamma", "delta", "theta", "lambda", "sigma", "omega", "partial", "infty", "left", "right", "text", "mathbf", "mathit", "times", "cdot", "leq",
    "geq", "neq", "approx",
)


def is_content_line(line: Column) -> Column:
    """Whether a line can stand in a table of contents: no page marker, table, image or formula."""
    line = text_or_empty(line)
    return ~line.rlike(r"(?i)^\s*<!--\s*page\s+\d+\s*-->") & ~line.rlike(r"(?i)^\s*<table>") & ~line.rlike(r"^\s*!\[") & ~line.rlike(r"(?i)\\(?:(?:" + "|".join(LATEX) + r")\b|(?:begin|end)\{)")


def without_spaces(text: Column, punctuation: bool = False) -> Column:
    """Spaces next to CJK characters go; other runs become one space; punctuation goes if asked."""
    out = F.regexp_replace(text_or_empty(text), rf"(?<=[{CJK}])\s+|\s+(?=[{CJK}])", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.regexp_replace(out, r"[\p{P}\p{S}]", "") if punctuation else out


def page_title(text: Column, page: Column, most: int = 60) -> Column:
    """A page's title: its first line that is not blank if that has letters, else the last one that has, cut; else 'Page n'."""
    lines = F.filter(F.transform(F.split(text_or_empty(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    said = lambda at: F.filter(F.array(F.try_element_at(lines, F.lit(at))), lambda x: x.rlike(r"\p{L}"))
    best = F.try_element_at(F.concat(said(1), said(-1)), F.lit(1))
    return F.coalesce(F.substring(best, 1, most), F.concat(F.lit("Page "), page.cast("string")))


def table_name(header: Column, most: int = 80) -> Column:
    """A name from header text: its distinct words of letters or digits."""
    parts = F.array_distinct(F.filter(F.split(text_or_empty(header), r"[|,;\s/\\:*?\"<>]+"), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    return F.substring(F.array_join(parts, "_"), 1, most)


def markdown_images(text: Column) -> Column:
    """Targets of markdown images, in order."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), F.lit(1))


def image_name(number: Column, context: Column) -> Column:
    return F.concat_ws("-", F.lit("image"), number.cast("string"), F.nullif(F.substring(text_or_empty(context), 1, 10), F.lit("")))


def toc_level(text: Column) -> Column:
    """A contents entry's level from its numbering: the deepest pattern that matches; null for titles of contents, lines with
    body evidence, and without numbering."""
    text = F.trim(text_or_empty(text))
    title = F.lower(F.regexp_replace(text, r"\s+", " ")).rlike(r"^(?:table of contents|contents|目 ?录|目 ?次)?$")
    depth = F.array_max(heading_evidence(text))
    return F.when(~title & (depth > 0) & (F.array_max(body_evidence(text)) <= 0), depth)
