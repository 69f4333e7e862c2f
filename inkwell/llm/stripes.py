"""Divergence of a language's sources by their words, with stripes that are folded inside the mappers.

A partition folds whole documents into hash stripes: for each language and term the number of documents and a count per
source. Stripes leave a task when it ends or its tables are full, meet by language and term, and are merged as they stream
by. A merged stripe of a frequent term gives its share of every divergence at once; what a task adds up is one sum per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, named, shared_dir, slices, utf8, written

#: What a task holds at most before it hands its stripes on: terms, bytes of terms, counts.
MOST_TERMS, MOST_BYTES, MOST_COUNTS = 1 << 18, 32 << 20, 1 << 21
#: Terms, about, that a task gets of a language's merged stripes; sources per block.
CHUNK, BLOCK = 8192, 512
WORK_BYTES = 2 << 20
#: Cells of a dense terms-by-sources tile.
TILE = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of the texts in a UTF-8 buffer, A-Z lower-cased, and the number of the text that each stands in."""
    inner = _LETTER[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    start = inner.copy()
    start[1:] &= ~inner[:-1] | edge[1:-1]
    at = np.flatnonzero(start)
    owner = np.searchsorted(offsets, at, side="right") - 1
    letters = _LOWER[raw[inner]]
    begin = np.cumsum(inner)[at] - 1 if len(at) else np.zeros(0, np.int64)
    to = np.append(begin, len(letters)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(to), pa.py_buffer(letters)), owner


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sums of their values."""
    by = np.argsort(keys, kind="stable")
    keys, values = keys[by], values[by]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


def _stripes(lang: pa.Array, term: pa.Array, mark: pa.Array, df: np.ndarray, sources: pa.Array, counts: np.ndarray, each: np.ndarray) -> pa.RecordBatch:
    to = pa.array(np.append(0, np.cumsum(each)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(to, sources), pa.ListArray.from_arrays(to, pa.array(counts))]
    return pa.RecordBatch.from_arrays([lang, term, mark, pa.array(df), *lists], names=["lang", "term", "mark", "df", "sources", "counts"])


STRIPE = "lang string, term string, mark string, df long, sources array<string>, counts array<long>"


class _Held:
    """The hash stripes of a task: a row per (language, term), counts per (row, source)."""

    def __init__(self) -> None:
        self.rows: dict[tuple[str, str], int] = {}
        self.names: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.df = np.zeros(1024, np.int64)
        self.cells = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.bytes = self.pending = 0

    def add(self, lang: pa.Array, source: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> None:
        """Folds texts in: lang and source are dictionary arrays, one entry per text."""
        langs, sources = lang.dictionary.to_pylist(), [self.names.setdefault(s, len(self.names)) for s in source.dictionary.to_pylist()]
        of_lang, of_source = lang.indices.to_numpy().astype(np.int64), source.indices.to_numpy().astype(np.int64)
        met, n = np.unique(of_lang * max(1, len(sources)) + of_source, return_counts=True)
        for k, c in zip(met.tolist(), n.tolist(), strict=True):
            group = (langs[k // len(sources)], source.dictionary[k % len(sources)].as_py())
            self.groups[group] = self.groups.get(group, 0) + c
        term, owner = terms(raw, offsets)
        if not len(term):
            return
        term = term.dictionary_encode()
        code = term.indices.to_numpy().astype(np.int64)
        n_texts = len(offsets) - 1
        seen = np.unique(code * n_texts + owner)  # a term and a text that holds it
        stripe, df = np.unique(seen // n_texts * len(langs) + of_lang[seen % n_texts], return_counts=True)
        words = term.dictionary.take(pa.array(stripe // len(langs))).to_pylist()
        place = np.empty(len(stripe), np.int64)
        for k, (word, x) in enumerate(zip(words, (stripe % len(langs)).tolist(), strict=True)):
            name = (langs[x], word)
            row = self.rows.get(name)
            if row is None:
                row = self.rows[name] = len(self.rows)
                self.bytes += len(word)
            place[k] = row
        if len(self.rows) > len(self.df):
            self.df = np.concatenate([self.df, np.zeros(len(self.rows), np.int64)])
        self.df[place] += df
        cell, n = np.unique((code * len(langs) + of_lang[owner]) * len(sources) + of_source[owner], return_counts=True)
        row = place[np.searchsorted(stripe, cell // len(sources))]
        self.cells.append((row << 32 | np.array(sources, np.int64)[cell % len(sources)], n))
        self.pending += len(cell)
        if self.pending > MOST_COUNTS:
            self.compact()

    def compact(self) -> None:
        self.cells = [summed(np.concatenate([k for k, _ in self.cells]), np.concatenate([n for _, n in self.cells]))]
        self.pending = 0

    def full(self) -> bool:
        return len(self.rows) > MOST_TERMS or self.bytes > MOST_BYTES or len(self.cells[0][0]) > MOST_COUNTS or len(self.groups) > MOST_TERMS

    def out(self, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
        """The stripes and, with null terms, a mark per group; the tables are empty then."""
        self.compact()
        cell, n = self.cells[0]
        keys, names = list(self.rows), pa.array(list(self.names), pa.string())
        for a in range(0, len(keys), rows):
            some = keys[a : a + rows]
            x, y = np.searchsorted(cell, [a << 32, a + len(some) << 32])
            lang, term = pa.array([k for k, _ in some], pa.string()), pa.array([t for _, t in some], pa.string())
            each = np.bincount((cell[x:y] >> 32) - a, minlength=len(some))
            yield _stripes(lang, term, pa.nulls(len(some), pa.string()), self.df[a : a + len(some)], names.take(pa.array(cell[x:y] & 0xFFFFFFFF)), n[x:y], each)
        if self.groups:
            lang, source = pa.array([k for k, _ in self.groups], pa.string()), pa.array([s for _, s in self.groups], pa.string())
            docs = np.array(list(self.groups.values()), np.int64)
            yield _stripes(lang, pa.nulls(len(docs), pa.string()), source, docs, source, docs, np.ones(len(docs), np.int64))
        self.__init__()


def folded(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """The stripes of each partition (STRIPE): per language and term the documents and the occurrences by source. Rows with a
    null term mark the groups that occur; df counts their documents."""
    rows = docs.select(*(F.coalesce(named(c), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source"), (text, "text"))))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a, b in slices(offsets, WORK_BYTES) if batch.num_rows else ():
                lang, source = (batch.column(k).slice(a, b - a).dictionary_encode() for k in (0, 1))
                held.add(lang, source, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if held.full():
                    yield from held.out()
        yield from held.out()

    return rows.mapInArrow(lean(fold), STRIPE)


def merged(stripes: DataFrame, least_docs: int) -> DataFrame:
    """Stripes merged by language and term; those of terms in fewer than least_docs documents go, marks stay."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept(x: pa.RecordBatch) -> pa.RecordBatch:
            return x.filter(pa.array((x.column("df").to_numpy() >= least_docs) | x.column("term").is_null().to_numpy(zero_copy_only=False)))

        open_: pa.RecordBatch | None = None  # the last stripe, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch if open_ is None else pa.Table.from_batches([open_, batch]).combine_chunks().to_batches()[0]
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in ("lang", "term", "mark"):
                code = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()
                new[1:] |= code[1:] != code[:-1]
            first = np.flatnonzero(new)
            each = np.diff(batch.column("sources").offsets.to_numpy())
            source = batch.column("sources").flatten().dictionary_encode()
            n = max(1, len(source.dictionary))
            run = np.repeat(np.cumsum(new) - 1, each)
            cell, counts = summed(run * n + source.indices.to_numpy(), batch.column("counts").flatten().to_numpy())
            head = batch.take(pa.array(first))
            done = _stripes(head.column("lang"), head.column("term"), head.column("mark"), np.add.reduceat(batch.column("df").to_numpy(), first), source.dictionary.take(pa.array(cell % n)), counts, np.bincount(cell // n, minlength=len(first)))
            yield kept(done.slice(0, len(first) - 1))
            open_ = done.slice(len(first) - 1)
        if open_ is not None:
            yield kept(open_)

    dealt = stripes.repartition("lang", "term", "mark").sortWithinPartitions("lang", "term", "mark")
    return dealt.mapInArrow(lean(merge), STRIPE)


def shares(count: np.ndarray, total: np.ndarray | int, n_terms: int, smooth: int) -> np.ndarray:
    """1 + floor(10**9 * (count + smooth) / (total + smooth * n_terms)), by long division, exact for totals below 9 * 10**15."""
    whole = np.asarray(total, np.int64) + smooth * n_terms
    if (whole > (1 << 63) // 1000 - 1).any():
        raise OverflowError("a source has too many words for 64-bit division")
    out, rest = np.divmod(count + smooth, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _divergences(batches: Iterator[pa.RecordBatch], smooth: int, top: int) -> Iterator[pa.RecordBatch]:
    """Rows of one (language, block) after the other, its totals before its stripes -> lang, source, part, item, value."""
    unit: tuple[str, int] | None = None
    names: dict[int, str] = {}
    totals: dict[int, int] = {}
    state: dict = {}

    def rows(lang: str, source: list, part: str, item: list, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(source), pa.string()), pa.array(source, pa.string()), pa.array([part] * len(source), pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])

    def begin() -> None:
        state["names"] = [names[k] for k in range(len(names))]
        state["total"] = np.array([totals[k] for k in range(len(names))], np.int64)
        state["own"] = range(unit[1] * BLOCK, min(len(names), (unit[1] + 1) * BLOCK))
        state["sums"] = np.zeros((len(state["own"]), len(names)), np.int64)

    def end() -> Iterator[pa.RecordBatch]:
        if not state:
            begin()
        for k, a in enumerate(state["own"]):
            other, value = state["names"][a + 1 :], state["sums"][k, a + 1 :]
            own = [state["names"][a]] * len(other)
            yield rows(unit[0], own, "pair", other, value)
            yield rows(unit[0], other, "pair", own, value)
        names.clear()
        totals.clear()
        state.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, block = batch.column("lang").dictionary_encode(), batch.column("block").to_numpy()
        code, stripe = lang.indices.to_numpy(), batch.column("stripe").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((code[1:] != code[:-1]) | (block[1:] != block[:-1]) | (stripe[1:] != stripe[:-1])) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            some = batch.slice(a, b - a)
            at = (lang.dictionary[code[a]].as_py(), int(block[a]))
            if at != unit:
                if unit is not None:
                    yield from end()
                unit = at
            if not stripe[a]:
                index = some.column("place").to_pylist()
                names.update(zip(index, some.column("name").to_pylist(), strict=True))
                totals.update(zip(index, some.column("total").to_pylist(), strict=True))
                continue
            if not state:
                begin()
            n_terms, everything, n = some.column("n_terms")[0].as_py(), some.column("lang_total")[0].as_py(), len(state["names"])
            known = pa.array(state["names"], pa.string())
            for x in range(0, some.num_rows, max(1, TILE // n)):
                tile = some.slice(x, max(1, TILE // n))
                each = np.diff(tile.column("sources").offsets.to_numpy())
                count = np.zeros((tile.num_rows, n), np.int64)
                count[np.repeat(np.arange(tile.num_rows), each), pc.index_in(tile.column("sources").flatten(), known).to_numpy()] = tile.column("counts").flatten().to_numpy()
                p = shares(count, state["total"], n_terms, smooth)
                q = shares(count.sum(1), everything, n_terms, smooth)
                for k, s in enumerate(state["own"]):
                    state["sums"][k, s + 1 :] += np.abs(p[:, s + 1 :] - p[:, s : s + 1]).sum(0)
                    value = p[:, s] - q
                    found = np.flatnonzero((count[:, s] > 0) & (value > 0))
                    if len(found) > top:  # what may rank: all that reach the top-th value here, ties included
                        found = found[value[found] >= np.partition(value[found], len(found) - top)[len(found) - top]]
                    if len(found):
                        yield rows(at[0], [state["names"][s]] * len(found), "term", tile.column("name").take(pa.array(found)).to_pylist(), value[found])
    if unit is not None:
        yield from end()


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """How far apart a language's sources are: lang, source, part, item, value, rank.

    Terms are runs of letters A-Z (lower-cased) and characters beyond ASCII; a language keeps those in least_docs of its
    documents or more. Each source and the language as a whole give a kept term the share
    p = 1 + floor(10**9 * (count + smooth) / (N + smooth * kept terms)). Part pair: item is another source, value the sum of
    |p - its p| over all kept terms. Part term: the top terms of the source by p less the language's p, where above 0.

    Null lang, source and text count as ''. A group whose documents have no terms, or whose language keeps none, has its pairs
    (value 0 where no term is kept). Ties: item in UTF-8 order. Repeated rows count as often as they stand. A language with
    one source has no pairs. Empty input: empty result. Other columns are not read. Documents are read once.

    A task holds tables of fixed size, a language's sources and sums for BLOCK of them; stripes of languages with more
    sources pass once per block.
    """
    path = shared_dir(docs.sparkSession)
    stripes = written(merged(folded(docs, lang, source, text), least_docs), f"{path}/stripes")
    kept = stripes.filter("term IS NOT NULL")
    n = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("_c")).groupBy("lang", F.col("_c.sources").alias("source")).agg(F.sum("_c.counts").alias("_n"))
    groups = stripes.filter("term IS NULL").select("lang", F.col("mark").alias("source"))
    totals = groups.join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("_n", F.lit(0)).alias("_n"))
    size = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("_v"))
    whole = totals.groupBy("lang").agg(F.sum("_n").alias("lang_total"), F.count(F.lit(1)).alias("_s")).join(size, "lang", "left")
    whole = written(whole.select("lang", "lang_total", F.coalesce("_v", F.lit(0)).alias("n_terms"), F.ceil(F.col("_s") / BLOCK).cast("int").alias("_blocks"), F.greatest(F.lit(1), F.ceil(F.col("_v") / CHUNK)).cast("int").alias("_chunks")), f"{path}/languages")
    block = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block")
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("sources", "array<string>"), ("counts", "array<long>"))]
    heads = totals.select("lang", "source", "_n", place).join(whole, "lang").select("*", block).select("*", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))
    heads = heads.select("lang", "block", "chunk", F.lit(False).alias("stripe"), F.col("source").alias("name"), "place", F.col("_n").alias("total"), "n_terms", "lang_total", *empty)
    rows = kept.join(whole, "lang").select("lang", block, F.pmod(F.hash("term"), F.col("_chunks")).alias("chunk"), F.lit(True).alias("stripe"), F.col("term").alias("name"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("long").alias("total"), "n_terms", "lang_total", "sources", "counts")
    dealt = heads.unionByName(rows).repartition("lang", "block", "chunk").sortWithinPartitions("lang", "block", "stripe")
    found = dealt.mapInArrow(lean(lambda batches: _divergences(batches, smooth, top)), "lang string, source string, part string, item string, value long")
    sums = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top))


DIVERGENCE_SQL = r"""
    WITH t AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    o AS (SELECT r, lang, source, unnest(w) AS term FROM t),
    k AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT t.lang, source, coalesce(v, 0) AS v FROM t LEFT JOIN v ON v.lang = t.lang),
    c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY ALL),
    n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
    m AS (SELECT lang, sum(n) AS n FROM n GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(n.n, 0) + 5 * v) AS p
          FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN n ON n.lang = g.lang AND n.source = g.source),
    q AS (SELECT p.lang, p.term, 1 + (1000000000::HUGEINT * (sum(p.c) + 5)) // (any_value(m.n) + 5 * any_value(v.v)) AS q FROM p JOIN m USING (lang) JOIN v USING (lang) GROUP BY ALL),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
          UNION ALL SELECT p.lang, p.source, 'term', p.term, p.p - q.q FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
    e AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM e WHERE part = 'pair' OR rank <= 50"""
