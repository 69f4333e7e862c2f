"""Main text of web pages: template lines go by page structure and by differencing with the nearest URL."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean

#: Fixed values of HTML: elements whose content is not text, elements without content, and inline elements.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "textarea", "title", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
#: Elements and roles that frame a page, and words of class and id names that say so.
FRAME = {"nav", "footer", "aside", "form", "select", "button", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "toolbar"}
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead topbar cookie cookies consent gdpr notice notices alert banner popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond replies pagination pager widget widgets toolbar skip copyright".split()
)
MAIN = {"article", "main"}
#: Ranges of the URL order: so many per shuffle partition, so many at most; pages drawn to place their bounds (by hash).
SPREAD, RANGES, SAMPLE = 4, 4096, 16384
#: What ends a tag's name, and what ends its attributes or opens a quoted one.
NAME_END, MARK = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


def _frames(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element frames the page. The header of an article (inside) belongs to it, and in an article a class or id
    frames only as a whole (comments, ad), not by a part of it: a notice-period or social-policy is what the article tells."""
    if name in FRAME or (name == "header" and not inside):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        kind, value = kind.lower(), (a or b or c).lower()
        if kind == "hidden" or (kind == "style" and "display:none" in value.replace(" ", "")):
            return True
        if kind == "role" and value in ROLES:
            return True
        if kind in ("class", "id") and name not in ("body", "html") and name not in MAIN - {"article"}:
            parts = set(value.split()) if inside else set(re.split(r"[^a-z]+", value))
            if parts & NAMES and not (name == "article" and not parts & {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo", "related"}):
                return True
            if "header" in parts and not inside and name != "article" and not parts & {"article", "entry", "post", "content"}:
                return True
    return False


class Tags:
    """The tags, comments and declarations of a page, one by one: (begin, end, literal text, closing, name, attributes).

    A tag ends at the first > outside quotes; < without such an end is text. What a failed search met is remembered, so
    that the work grows with the page, whatever it holds.
    """

    def __init__(self, page: str):
        self.page, self.last, self.last_literal = page, page.rfind(">"), page.rfind("]]>")
        self.name_end = -1
        self.dead: set[int] = set()  # opening quotes from which no end is reached

    def after(self, at: int) -> tuple[int, int, str | None, bool, str | None, str] | None:
        while (start := self.page.find("<", at)) >= 0:
            found = self._at(start)
            if found:
                return found
            at = start + 1
        return None

    def _at(self, start: int) -> tuple[int, int, str | None, bool, str | None, str] | None:
        page = self.page
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return start, end + 3 if end >= 0 else len(page), None, False, None, ""
        if page.startswith("<![CDATA[", start) and self.last_literal >= start + 9:
            end = page.find("]]>", start + 9)
            return start, end + 3, page[start + 9 : end], False, None, ""
        if self.last < start:
            return None
        if page.startswith(("<!", "<?"), start):
            return start, page.find(">", start) + 1, None, False, None, ""
        close = page.startswith("</", start)
        begin = start + 1 + close
        if not (page[begin : begin + 1].isascii() and page[begin : begin + 1].isalpha()):
            return None
        if self.name_end < begin:
            self.name_end = NAME_END.search(page, begin).start()
        place, opened = self.name_end, []
        while mark := MARK.search(page, place):
            k = mark.start()
            if page[k] == ">":
                return start, k + 1, None, close, page[begin : self.name_end], page[self.name_end : k]
            opened.append(k)
            place = 0 if k in self.dead else page.find(page[k], k + 1) + 1
            if not place:
                break
        self.dead.update(opened)
        return None


#: Elements that end where the next one begins, and in which they stand.
SIBLINGS = {"p": (), "li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Open:
    """The open elements: name, in a frame from here on, in the article from here on."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.number: Counter[str] = Counter()

    def push(self, name: str, frame: bool, main: bool) -> None:
        self.stack.append((name, frame, main))
        self.number[name] += 1

    def cut(self, k: int) -> None:
        for name, _, _ in self.stack[k:]:
            self.number[name] -= 1
        del self.stack[k:]

    def inside(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def close(self, name: str) -> None:
        """Closes the last element of that name; an inline one only within its block."""
        if self.number[name]:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    return self.cut(k)
                if name in INLINE and self.stack[k][0] not in INLINE:
                    return None
        return None

    def end_sibling(self, name: str) -> None:
        if self.number[name]:
            for k in range(len(self.stack) - 1, -1, -1):
                own = self.stack[k][0]
                if own in SIBLINGS[name] or (name == "p" and own not in INLINE and own != name):
                    return None
                if own == name:
                    return self.cut(k)
        return None


def blocks(page: str | None) -> list[tuple[str, int]]:
    """The text blocks of a page in order, each with its place: 2 in the article, 1 elsewhere, 0 in a frame."""
    out: list[tuple[str, int]] = []
    page = page or ""
    open_, tags = Open(), Tags(page)
    text: list[str] = []
    endless: set[str] = set()  # elements whose end was looked for in vain

    def flush() -> None:
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if own:
                frame, main = open_.inside()
                out.append((own, 0 if frame else 2 if main else 1))

    at = 0
    while at < len(page):
        found = tags.after(at)
        text.append(page[at : found[0] if found else len(page)])
        if not found:
            break
        _, at, literal, close, name, attributes = found
        if literal is not None:
            text.append(html.escape(literal))
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        elif name in ("br", "img", "input"):
            text.append(" ")
        if close:
            open_.close(name)
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if name == "head" and not end and name not in endless:
                end = re.compile(r"(?=<body[\s>])", re.I).search(page, at)
            if not end:
                endless.add(name)
            if not attributes.rstrip().endswith("/") or end and name in ("script", "style", "title"):
                at = end.end() if end else (at if name == "head" else len(page))
            continue
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in SIBLINGS:
            open_.end_sibling(name)
        frame, main = open_.inside()
        own = _frames(name, attributes, main)
        if name in MAIN and not own and not main:
            frame = False  # an article does not stand in a menu or an advert: that one was left open
        open_.push(name, frame or own, main or (name in MAIN and not own))
    flush()
    return out


#: Bits of the table of one alignment; longer ones are halved first.
TABLE = 1 << 28


def _rows(a: list[str], b: list[str]) -> list[int]:
    """For each prefix of a, a number whose 0 bits mark the places of b where the length of the common subsequence grows."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    all_ = (1 << len(b)) - 1
    out = [all_]
    for x in a:
        v, hit = out[-1], where.get(x, 0)
        u = v & hit
        out.append(((v + u) | (v - u)) & all_)
    return out


def _aligned(a: list[str], b: list[str], at: int, to: int) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places, counted from at and to. Long tables are cut at half of a, where the
    lengths of both halves (forward and backward) sum up to the most."""
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE:
        half = len(a) // 2
        ahead, back = _last(a[:half], b), _last(a[half:][::-1], b[::-1])[::-1]
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + back[j])
        return _aligned(a[:half], b[:cut], at, to) + _aligned(a[half:], b[cut:], at + half, to + cut)
    rows, out = _rows(a, b), []
    i, j = len(a), len(b)
    length = len(b) - rows[i].bit_count()
    while length:
        mask = (1 << j) - 1
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif j - (rows[i - 1] & mask).bit_count() == length:
            i -= 1
        else:
            i, j, length = i - 1, j - 1, length - 1
            out.append((at + i, to + j))
    return out[::-1]


def _last(a: list[str], b: list[str]) -> list[int]:
    """Lengths of the common subsequence of a with each prefix of b."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    all_ = v = (1 << len(b)) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & all_
    out = [0]
    for bit in bin(v | 1 << len(b))[:2:-1]:
        out.append(out[-1] + (bit == "0"))
    return out


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of lines, as pairs of places. Equal ends and lines that only one list has
    are taken off first; the rest goes bit-parallel, so that the work grows with the product of the lines / 64."""
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    m = next((k for k, (x, y) in enumerate(zip(a[n:][::-1], b[n:][::-1], strict=False)) if x != y), min(len(a), len(b)) - n)
    both = set(a[n : len(a) - m]) & set(b[n : len(b) - m])
    i, j = ([k for k in range(n, len(own) - m) if own[k] in both] for own in (a, b))
    middle = _aligned([a[k] for k in i], [b[k] for k in j], 0, 0)
    return [(k, k) for k in range(n)] + [(i[x], j[y]) for x, y in middle] + [(len(a) - m + k, len(b) - m + k) for k in range(m)]


def main_text(parts: list[tuple[str, int]], shared: set[int]) -> str:
    """The article's blocks and, of those outside article and frames, the ones that the nearest pages don't share."""
    return "\n".join(t for k, (t, place) in enumerate(parts) if place == 2 or (place == 1 and k not in shared))


class Compared:
    """A page and what its neighbours by URL share with it; identical pages that follow each other stand for one."""

    def __init__(self, part: int, host: str, parts: list[tuple[str, int]]):
        self.part, self.host, self.parts = part, host, parts
        self.members: list[tuple] = []  # key and url of each row to return
        self.shared: set[int] = set()
        self.outside = [k for k, (_, place) in enumerate(parts) if place != 2]

    def compare(self, other: Compared) -> None:
        """Notes what this page and the next one share outside their articles."""
        a, b = ([page.parts[k][0] for k in page.outside] for page in (self, other))
        for i, j in common_lines(a, b):
            self.shared.add(self.outside[i])
            other.shared.add(other.outside[j])

    def text(self) -> str:
        return main_text(self.parts, self.shared)


def _beside(at: int, step: int, near: dict[int, list], first: tuple, parts: list[int]):
    """The order of the page nearest to range parts[at], before (step -1) or behind it (1), that is of the host of first
    (order, digest) and has another digest; None if there is none."""
    at += step
    while 0 <= at < len(parts):
        for order, digest in near[parts[at]]:
            if order[0] != first[0][0]:
                return None
            if digest != first[1]:
                return order
        at += step
    return None


def _ranges(rows: DataFrame) -> DataFrame:
    """rows (with _order) dealt to ranges of _order: adds _part and _own. The nearest page on either side of a range that
    differs from the range's own outermost page also comes to it, with _own false, so that no neighbours are cut apart."""
    spark, kind = rows.sparkSession, rows.schema["_order"].dataType.simpleString()
    n, most = rows.count(), min(RANGES, SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions")))
    draw = F.pmod(F.xxhash64("_order"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = [r[0] for r in rows.filter(draw < SAMPLE / max(1, n)).select("_order").orderBy("_order").collect()]
    cuts = [drawn[k * len(drawn) // most] for k in range(1, most)] if len(drawn) >= most else drawn
    bounds = spark.createDataFrame([(cuts,)], f"_bounds array<{kind}>")
    middle = "cast((s.lo + s.hi) div 2 as int)"
    step = f"if(s.lo >= s.hi, s, if(get(_bounds, {middle}) <= _order, named_struct('lo', {middle} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {middle})))"
    part = F.expr(f"aggregate(sequence(1, {len(cuts).bit_length() + 1}), named_struct('lo', 0, 'hi', {len(cuts)}), (s, i) -> {step}, s -> s.lo)")
    placed = rows.crossJoin(F.broadcast(bounds)).withColumn("_part", part).drop("_bounds")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [hashlib.blake2b(repr(blocks(x)).encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["_part", "_order", "_digest"])

    each = placed.filter("_host <> ''").select("_part", "_order", "_html").mapInArrow(lean(digests), f"_part int, _order {kind}, _digest binary")
    each = each.groupBy("_part", "_digest").agg(F.min("_order").alias("_low"), F.max("_order").alias("_high"))
    rank = lambda by: F.row_number().over(Window.partitionBy("_part").orderBy(by))
    each = each.withColumn("_a", rank(F.col("_low"))).withColumn("_z", rank(F.col("_high").desc())).filter("_a <= 2 or _z <= 2")
    lows, highs = {}, {}
    for r in each.collect():  # four rows a range at most
        lows.setdefault(r["_part"], []).append((r["_a"], r["_low"], bytes(r["_digest"])))
        highs.setdefault(r["_part"], []).append((r["_z"], r["_high"], bytes(r["_digest"])))
    lows, highs = ({k: [x[1:] for x in sorted(v, key=lambda x: x[0])[:2]] for k, v in d.items()} for d in (lows, highs))
    sent: dict = {}
    parts = sorted(lows)
    for at, k in enumerate(parts):
        for order in (_beside(at, -1, highs, lows[k][0], parts), _beside(at, 1, lows, highs[k][0], parts)):
            if order is not None:
                sent.setdefault(order, []).append(k)
    also = spark.createDataFrame(list(sent.items()), f"_order {kind}, _also array<int>")
    placed = placed.join(F.broadcast(also), "_order", "left").withColumn("_to", F.explode(F.concat(F.array("_part"), F.coalesce("_also", F.array().cast("array<int>")))))
    return placed.withColumn("_own", F.col("_to") == F.col("_part")).withColumn("_part", F.col("_to"))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per row of pages: key, url, text, n_chars.

    Pages are ordered by host and URL path, spread over tasks by ranges of these, so that a host may hold any
    share of them; each page is compared with its neighbours of the same host, those of the ranges beside
    included. Lines outside the article that a longest common subsequence shares with a neighbour are
    template and are deleted, as are frames (menus, headers, footers, sidebars, notices, adverts, forms,
    comments), scripts and styles; what is left outside the article belongs to the text. Blocks of an article
    are never deleted for being shared: articles quote common lines. Identical pages are not compared with
    each other, but with the pages around them.

    Null html: empty text. Null urls: one host of their own, not compared. Null keys are kept, repeated rows
    give repeated results, empty input an empty result; other columns are not read.
    """
    address = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(address, r"^([^/?#]*)", 1), r"^www\.", ""))
    path = F.regexp_extract(address, r"^[^/?#]*([^?#]*)", 1)
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_html"), host.alias("_host"), F.struct(host.alias("h"), path.alias("p"), F.col(key).alias("k"), F.xxhash64(url, page).alias("x")).alias("_order"))
    kinds = f"_key {rows.schema['_key'].dataType.simpleString()}, _url {rows.schema['_url'].dataType.simpleString()}, text string, n_chars long"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Compared | None = None

        def emit(done: list[Compared]) -> pa.RecordBatch:
            texts = [(*m, text) for x in done if x.members for text in [x.text()] for m in x.members]
            columns = list(zip(*texts, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array([len(t) for t in columns[2]], pa.int64())], names=["_key", "_url", "text", "n_chars"])

        kind = None
        for batch in batches:
            done, kind = [], batch.column(0).type
            for own, link, source, host, part, returned in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                here = Compared(part, host, blocks(source))
                near = last is not None and host and (last.part, last.host) == (part, host)
                if near and last.parts == here.parts:
                    here = last
                else:
                    if near:
                        last.compare(here)
                    if last is not None:
                        done.append(last)
                    last = here
                if returned:
                    here.members.append((own, link))
            yield emit(done)
        if last is not None:
            yield emit([last])

    ordered = _ranges(rows).repartitionByRange("_part").sortWithinPartitions("_part", "_order")
    return ordered.select("_key", "_url", "_html", "_host", "_part", "_own").mapInArrow(lean(extract), kinds).select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")
