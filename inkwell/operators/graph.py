"""Keywords, the document graph, and integrity of entities and links."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import lean, written
from .chunking import packed_lines

SHARED, SCORE = 3, 0.8


def _keywords(content: str):
    """Normalised tokens of a text column without stopwords, single characters and numbers, as an array."""
    return F.filter(T.tokens(F.col(content), T.STOPWORDS), lambda t: ~t.rlike(r"^\d+[.,%]*$"))


def keyword_counts(chunks: DataFrame) -> DataFrame:
    """document_id, n_chunks, keyword, tf, df: keywords of documents (normalised tokens without stopwords, single characters and numbers),
    how often they stand there and in how many of the chunks.

    Chunks are dealt by document once, each with its tokens as one sorted array; all counts are made behind that, so no keyword is shuffled.
    A token that differs from the one before it counts its chunk. A larger input has more parts, so that a task's counts stay small.
    """
    words = F.array_sort(_keywords("content"))
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * chunks.rdd.getNumPartitions())
    own = chunks.select("document_id", words.alias("_w")).repartition(parts, "document_id").withColumn("n_chunks", F.count(F.lit(1)).over(Window.partitionBy("document_id")))
    each = own.select("document_id", "n_chunks", "_w", F.posexplode("_w").alias("_at", "keyword"))
    first = (F.col("_at") == 0) | (F.get("_w", F.col("_at") - 1) != F.col("keyword"))
    return each.select("document_id", "n_chunks", "keyword", first.alias("_first")).groupBy("document_id", "n_chunks", "keyword").agg(F.count(F.lit(1)).alias("tf"), F.count_if("_first").alias("df"))


def top_keywords(counts: DataFrame, k: int = 10) -> DataFrame:
    """The k keywords of each document with the largest tf * (ln(chunks / df) + 1), from keyword_counts."""
    scored = counts.withColumn("weight", F.round(F.col("tf") * (F.log(F.col("n_chunks") / F.col("df")) + 1), 6))
    w = Window.partitionBy("document_id").orderBy(F.desc("weight"), "keyword")
    return scored.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k).select("document_id", "keyword", "weight", "rank0")


def _counted(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (document_id, _w: array of words) of chunks, those of a document one after the other -> a row per document: document_id,
    n_chunks, _letters of its different words, _own (these words), and words that hold its k best ones (of equal counts the first k in order, near
    the k-th weight), with how often they stand there and in how many chunks."""

    def counted(rows: pa.Table) -> pa.RecordBatch:
        ids, own = (rows.column(k).combine_chunks() for k in range(2))
        ids, own = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, own))
        new = np.append(True, pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) if len(ids) else np.zeros(0, bool)
        document, first = np.cumsum(new) - 1, np.flatnonzero(new)
        each = pc.fill_null(pc.list_value_length(own), 0).to_numpy().astype(np.int64)
        coded = own.flatten().dictionary_encode()
        known = coded.dictionary.cast(pa.string())
        order = pc.array_sort_indices(known).to_numpy().astype(np.int64)
        n, rank, known = max(1, len(order)), np.argsort(order), known.take(pa.array(order))
        pair, times = np.unique(np.repeat(np.arange(len(ids)), each) * n + rank[coded.indices.to_numpy()], return_counts=True)
        word, at, df = np.unique(document[pair // n] * n + pair % n, return_inverse=True, return_counts=True)
        d, word = word // n, word % n
        tf, chunks = np.bincount(at, times, len(word)).astype(np.int64), np.diff(np.append(first, len(ids)))
        weight = tf * (np.log(chunks[d] / df) + 1)
        by = np.lexsort((df, tf, -weight, d))  # stable: words stay in order
        same = np.append(False, (d[by][1:] == d[by][:-1]) & (tf[by][1:] == tf[by][:-1]) & (df[by][1:] == df[by][:-1])) if len(by) else np.zeros(0, bool)
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(by)))) if len(by) else by
        start = np.searchsorted(d[by], np.arange(len(first)))
        kth = np.minimum(start + k, np.append(start[1:], len(by))) - 1
        least = weight[by][np.maximum(kth, 0)] - 1e-5 if len(by) else np.zeros(len(first))
        best = by[(place < k) & (weight[by] >= least[d[by]])]

        def lists(some: np.ndarray, *values: np.ndarray) -> list[pa.ListArray]:
            to = pa.array(np.append(0, np.cumsum(np.bincount(d[some], minlength=len(first)))).astype(np.int32))
            return [pa.ListArray.from_arrays(to, known.take(pa.array(word[some]))), *(pa.ListArray.from_arrays(to, pa.array(v[some])) for v in values)]

        letters = np.bincount(d, pc.utf8_length(known).to_numpy()[word], len(first)).astype(np.int64)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(chunks), pa.array(letters), *lists(np.arange(len(word))), *lists(best, tf, df)], names=["document_id", "n_chunks", "_letters", "_own", "_best", "_tf", "_df"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        differs = pc.not_equal(ids, ids[-1]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0  # the last document may go on in the next batch
        if held and (cut or ids[-1] != held[-1].column(0)[0]):
            done = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
            yield counted(done)
        elif cut:
            yield counted(pa.Table.from_batches([batch.slice(0, cut)]))
        held.append(batch.slice(cut))
    if held:
        yield counted(pa.Table.from_batches(held))


def keyword_sets(docs: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """document_id, _letters (of all different keywords), _own (these), _top (the k best, see top_keywords) of documents whose key is not
    null, a row for each row of docs.

    A document's chunks lie in its own row, so they are counted where they stand and nothing is shuffled but keys. Only documents
    whose key repeats are dealt by key, as they count together.
    """
    docs = docs.select(key, text).filter(F.col(key).isNotNull())
    repeated = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    kind = docs.schema[key].dataType.simpleString()

    def sets(rows: DataFrame, deal: bool) -> DataFrame:
        words = packed_lines(rows, key, text).select(F.col(key).alias("document_id"), _keywords("content").alias("_w"))
        if deal:
            words = words.repartition("document_id").sortWithinPartitions("document_id")
        out = words.mapInArrow(lean(lambda batches: _counted(batches, k)), f"document_id {kind}, n_chunks long, _letters long, _own array<string>, _best array<string>, _tf array<long>, _df array<long>")
        weight = lambda x: F.round(x["_tf"] * (F.log(F.col("n_chunks") / x["_df"]) + 1), 6)
        best = F.array_sort(F.transform(F.arrays_zip("_best", "_tf", "_df"), lambda x: F.struct((-weight(x)).alias("w"), x["_best"].alias("keyword"))))
        return out.select("document_id", "_letters", "_own", F.transform(F.slice(best, 1, k), lambda x: x["keyword"]).alias("_top"))

    if not repeated.limit(1).count():
        return sets(docs, False)
    again = sets(docs.join(repeated, key, "left_semi"), True).join(repeated.withColumnRenamed(key, "document_id"), "document_id")
    again = again.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copy", "_copies")
    return sets(docs.join(repeated, key, "left_anti"), False).unionByName(again)


def nodes(chunks: DataFrame, summary: str | None = None, order: str = "chunk_no") -> DataFrame:
    """Documents with their number of chunks, the number of each type (a map) and, if a column of summaries is named, the first one
    in order that is not blank."""
    kinds = chunks.groupBy("document_id", F.coalesce("chunk_type", F.lit("text")).alias("_t")).agg(F.count(F.lit(1)).alias("_n"), *([F.min_by(F.trim(F.col(summary)), F.when(F.trim(summary) != "", F.col(order))).alias("_s"), F.min(F.when(F.trim(summary) != "", F.col(order))).alias("_o")] if summary else []))
    out = kinds.groupBy("document_id").agg(F.sum("_n").alias("n_chunks"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_t", "_n")))).alias("types"), *([F.min_by("_s", "_o").alias("top_summary")] if summary else []))
    return out


#: Earlier documents of a block and later documents of a slot that meet in one task.
BLOCK, SLOT = 8192, 4096


def edges_of_slot(olds: pa.Table, met: pa.Table, shared: int, score: float) -> pa.Table:
    """_new, _old, n_shared, _s, _least of the edges between a block of earlier documents and a slot of later ones.

    olds: _old, _p, _wb, _own (top keywords). met: per keyword the places _n of the slot's documents that have it, and a row without
    keyword whose _all lists these documents (_n, document_id, _p, _wa). A keyword is one row of bytes over the slot.
    """
    names = ["_new", "_old", "n_shared", "_s", "_least"]
    word, there = met["keyword"].to_pylist(), met["_n"].to_pylist()
    news = next((x for w, x in zip(word, met["_all"].to_pylist(), strict=True) if w is None), []) if olds.num_rows else []
    kind = met.schema.field("_all").type.value_type.field("document_id").type
    at_new, at_old, values, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)], pa.array([], kind)
    if news:
        news.sort(key=lambda x: x["_n"])
        ids = pa.array([x["document_id"] for x in news], kind)
        place = {w: k for k, w in enumerate(w for w in word if w is not None)}
        has = np.zeros((len(place), len(news)), np.uint8)
        for w, at in zip(word, there, strict=True):
            if w is not None:
                has[place[w], at] = 1
        wa, first = np.array([x["_wa"] for x in news]), olds.to_pylist()
        when = [(x["_p"], x["document_id"]) for x in news], [(x["_p"], x["_old"]) for x in first]
        order = {x: k for k, x in enumerate(sorted({*when[0], *when[1]}))}
        new_at = np.array([order[x] for x in when[0]])
        for n, (x, at) in enumerate(zip(first, when[1], strict=True)):
            own = [w for w in x["_own"] if w in place]
            if len(own) >= shared:
                rows = has[[place[w] for w in own]].astype(np.float32)
                letters, number = np.array([[len(w) for w in own], [1] * len(own)], np.float32) @ rows
                least = np.minimum(wa, x["_wb"])
                good = np.flatnonzero((number >= shared) & (letters / least.astype(float) >= score) & (new_at > order[at]))
                at_new.append(good)
                at_old.append(np.full(len(good), n))
                values.append(np.stack([number[good], letters[good], least[good]]).astype(np.int64))
    a, b, v = np.concatenate(at_new), np.concatenate(at_old), np.concatenate(values, axis=1)
    return pa.table([ids.take(pa.array(a)), olds["_old"].take(pa.array(b)), *map(pa.array, v)], names=names)


def edges(full: DataFrame, top: DataFrame, published: DataFrame, shared: int = SHARED, score: float = SCORE) -> DataFrame:
    """Undirected edges between documents by shared keywords: all keywords of the later document against the top
    ones of the earlier; score = letters shared / letters of the smaller set.

    Blocks of earlier documents meet slots of later ones in a task each, so that what is shuffled are postings of top keywords, once per
    block that has the keyword, and edges, never candidate pairs. The edges themselves may grow with the square of the documents.
    full and top: (document_id, keyword), each pair once; both are read several times: pass written tables.
    """
    size = F.sum(F.length("keyword"))
    when = published.select("document_id", F.col("published_at").alias("_p"))
    n = published.count()
    slots, blocks = max(1, -(-n // SLOT)), max(1, -(-n // BLOCK))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    place = F.row_number().over(Window.partitionBy("_slot").orderBy("document_id")) - 1
    news = written(full.groupBy("document_id").agg(size.alias("_wa")).join(when, "document_id").withColumn("_slot", deal("document_id", slots)).withColumn("_n", place))
    olds = top.groupBy("document_id").agg(size.alias("_wb"), F.collect_list("keyword").alias("_own")).join(when, "document_id").withColumn("_block", deal("document_id", blocks))
    olds = written(olds.select("_block", F.col("document_id").alias("_old"), "_p", "_wb", "_own"))
    wanted = olds.select("_block", F.explode("_own").alias("keyword")).distinct()
    own = full.join(wanted.select("keyword").distinct(), "keyword", "left_semi").join(news.select("document_id", "_slot", "_n"), "document_id").groupBy("_slot", "keyword").agg(F.collect_list("_n").alias("_n"))
    heads = news.groupBy("_slot").agg(F.collect_list(F.struct("_n", "document_id", "_p", "_wa")).alias("_all")).withColumn("_block", every(blocks))
    met = own.join(wanted, "keyword").unionByName(heads, allowMissingColumns=True).select("_block", "_slot", "keyword", "_n", "_all")
    parts = 2 * blocks * slots  # hardly two meet in one task
    left, right = (x.repartition(parts, "_block", "_slot") for x in (olds.withColumn("_slot", every(slots)), met))
    kind = full.schema["document_id"].dataType.simpleString()
    got = left.groupBy("_block", "_slot").cogroup(right.groupBy("_block", "_slot")).applyInArrow(lambda x, y: edges_of_slot(x, y, shared, score), f"_new {kind}, _old {kind}, n_shared long, _s long, _least long")
    return got.select(F.least("_new", "_old").alias("source"), F.greatest("_new", "_old").alias("target"), "n_shared", F.round(F.col("_s") / F.col("_least"), 4).alias("weight"))


#: Documents that are packed in one row (as earlier and as later ones), the most frequent keywords of such a row that are kept as a matrix, and
#: edges that a task hands on at once.
PACK, OFTEN, EDGES = 8192, 2048, 1 << 17


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (document_id, _p, _letters, _own, _top) -> packs of PACK documents: _news and _olds as bytes, the later ones in the order of falling
    letters with their postings, the earlier ones in the order of their ids with their top keywords."""

    def numbers(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
        coded = lists.flatten().dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32), pc.list_value_length(lists).to_numpy()

    def pack(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.sort_by([("_letters", "descending")]).combine_chunks()
        one = lambda c: x.combine_chunks() if isinstance(x := rows.column(c).combine_chunks(), pa.ChunkedArray) else x
        ids, when, letters = rows.column("document_id").to_pylist(), rows.column("_p").to_pylist(), one("_letters").to_numpy().astype(np.int64)
        both = list(zip(when, ids, strict=True))
        words, own, each = numbers(one("_own"))
        by = np.argsort(own, kind="stable")
        bounds = np.append(0, np.cumsum(np.bincount(own, minlength=len(words)))).astype(np.int64)
        news = (max(both), min(both), ids, when, letters, words, np.repeat(np.arange(len(ids), dtype=np.uint16 if len(ids) <= 1 << 16 else np.int32), each)[by], bounds)
        rows = rows.sort_by("document_id").combine_chunks()
        ids, when = rows.column("document_id").to_pylist(), rows.column("_p").to_pylist()
        words, own, each = numbers(one("_top"))
        olds = (min(both), ids, when, words, own.tolist(), np.append(0, np.cumsum(each)).tolist())
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(x, 5)], pa.binary()) for x in (news, olds)], names=["_news", "_olds"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, PACK - sum(x.num_rows for x in held)))
            batch = batch.slice(held[-1].num_rows)
            if sum(x.num_rows for x in held) == PACK:
                yield pack(pa.Table.from_batches(held))
                held = []
    if held:
        yield pack(pa.Table.from_batches(held))


class _Later:
    """A pack's documents as later ones: postings of their keywords, of the most frequent ones also as rows of letters."""

    def __init__(self, packed: bytes) -> None:
        self.last, self.first, ids, when, self.letters, words, self.at, self.bounds = pickle.loads(packed)
        self.ids, self.when = _values(ids), _values(when)
        self.number = {w: k for k, w in enumerate(words)}
        size, length = np.diff(self.bounds), np.array([len(w) for w in words], np.int64)
        often = [k for k in np.argsort(-size, kind="stable")[:OFTEN].tolist() if length[k] < 256]
        self.row = {k: n for n, k in enumerate(often)}
        self.dense = np.zeros((len(often), len(ids)), np.uint8)
        for n, k in enumerate(often):
            self.dense[n, self.postings(k)] = length[k]

    def postings(self, k: int) -> np.ndarray:
        return self.at[self.bounds[k] : self.bounds[k + 1]]


def _values(values: list) -> np.ndarray:
    """An array whose values compare as those of the list: numbers as such, others as objects."""
    plain = all(type(x) is int for x in values) or all(type(x) is float for x in values)
    return np.array(values) if plain else np.array([*values, None], object)[:-1]


def _least_shared(score: float, most: int) -> np.ndarray:
    """Per number n of letters up to most, the least number of shared ones of which n is a share of at least score."""
    n = np.arange(1, most + 1)
    least = np.maximum(np.ceil(score * n).astype(np.int64) - 1, 0)
    for _ in range(2):
        least += least / n < score
    return np.append(0, least)


def _met(later: _Later, olds: tuple, shared: int, score: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edges between the documents of a pack as earlier ones and the later ones: place of the earlier, and as arrays places of the later ones, n_shared, letters
    shared and letters of the smaller set."""
    _, ids, when, words, own, bounds = olds
    number, size = [later.number.get(w, -1) for w in words], [len(w) for w in words]
    weights = [sum(size[w] for w in own[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    needed = _least_shared(score, max(weights, default=0))
    least, bytes_ = needed.tolist(), np.minimum(needed, 255).astype(np.uint8)
    smaller, most, everyone = np.negative(later.letters), later.letters.tolist(), len(later.letters)  # ascending
    sums, small = np.empty(everyone, np.uint8), least[min(most[-1], len(least) - 1)]
    whole_of: dict[int, int] = {}
    for n, weight in enumerate(weights):
        there = [w for w in own[bounds[n] : bounds[n + 1]] if number[w] >= 0]
        if len(there) < shared or sum([size[w] for w in there]) < min(small, least[weight]):
            continue
        rows = [row for w in there if (row := later.row.get(number[w])) is not None] if weight < 256 else []
        rare = [w for w in there if number[w] not in later.row] if weight < 256 else there
        letters = sums if weight < 256 else np.zeros(everyone, np.int64)  # sums of letters fit in a byte
        if rows:
            np.add.reduce(later.dense[rows], axis=0, dtype=np.uint8, out=sums)
        else:
            letters[:] = 0
        for w in rare:
            letters[later.postings(number[w])] += letters.dtype.type(size[w])
        whole = whole_of.get(weight)
        if whole is None:
            whole = whole_of[weight] = int(np.searchsorted(smaller, -weight, side="right"))  # later documents with as many letters or more
        good = (letters[:whole] >= least[weight]).nonzero()[0]
        if whole < everyone:
            own_least = (bytes_ if weight < 256 else needed)[later.letters[whole:]]
            good = np.concatenate([good, whole + (letters[whole:] >= own_least).nonzero()[0]])
        if not later.first > (when[n], ids[n]):
            p, i = later.when[good], later.ids[good]
            good = good[((p > when[n]) | ((p == when[n]) & (i > ids[n]))).astype(bool)]
        if not len(good):
            continue
        many = np.count_nonzero(later.dense[np.ix_(rows, good)], axis=0) if rows else np.zeros(len(good), np.int64)
        for w in rare:
            at = later.postings(number[w])
            many = many + (at[np.minimum(np.searchsorted(at, good), len(at) - 1)] == good)
        some = many >= shared
        if not some.all():
            good, many = good[some], many[some]
        if len(good):
            yield n, good, many, letters[good].astype(np.int64), np.minimum(later.letters[good], weight)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Later, bool, tuple]]:
    """The pairs of packs in which a later document may stand: later ones, whether they are new to the task, earlier ones."""
    last, later = None, None
    for batch in batches:
        for news, olds in zip(batch.column(0), batch.column(1), strict=True):
            fresh = news.as_buffer() if news.is_valid else None
            if last is None or not fresh.equals(last):
                last, later, told = fresh, _Later(fresh.to_pybytes()), False
            own = pickle.loads(olds.as_py())
            if later.last > own[0]:
                yield later, not told, own
                told = True


def _edges(shared: int, score: float, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_new", "_old", "n_shared", "_s", "_least"]
        for later, _, olds in _pairs(batches):
            news, held, n_held = pa.array(later.ids.tolist(), kind), [], 0
            met = _met(later, olds, shared, score)
            while (x := next(met, None)) or held:
                if x:
                    held.append(x)
                    n_held += len(x[1])
                if not x or n_held >= EDGES:
                    first = pa.array([olds[1][n] for n, *_ in held], kind).take(pa.array(np.repeat(np.arange(len(held)), [len(y[1]) for y in held])))
                    good, *values = (np.concatenate([y[c] for y in held]) for c in range(1, 5))
                    yield pa.RecordBatch.from_arrays([news.take(pa.array(good)), first, *map(pa.array, values)], names=names)
                    held, n_held = [], 0

    return run


def _degrees(shared: int, score: float, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per node of a pair of packs: its edges there, their weight in ten thousandths, and the least neighbour."""

    def rows(ids: list, degree: np.ndarray, weight: np.ndarray, least: list) -> pa.RecordBatch:
        some = np.flatnonzero(degree).tolist()
        pick = lambda of: pa.array([of[k] for k in some], kind)
        return pa.RecordBatch.from_arrays([pick(ids), pa.array(degree[some]), pa.array(weight[some]), pick(least)], names=["node", "_n", "_w", "_o"])

    share, small = np.arange(256), np.arange(1, 256)[:, None]
    table = np.append(np.zeros((1, 256), np.int64), (20000 * share + small) // (2 * small), axis=0)  # rounded half up, in whole numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for later, fresh, olds in _pairs(batches):
            if fresh or held is None:
                if held is not None:
                    yield rows(*held)
                held = (later.ids.tolist(), np.zeros(len(later.ids), np.int64), np.zeros(len(later.ids), np.int64), [None] * len(later.ids))
            _, degree, weight, least = held
            ids = olds[1]
            n, none = len(ids), np.ones(len(later.ids), bool)
            own, own_weight, other = np.zeros(n, np.int64), np.zeros(n, np.int64), list(ids)
            for k, good, _, s, of in _met(later, olds, shared, score):
                w = table[of, s] if of[0] < 256 and of.max() < 256 else (20000 * s + of) // (2 * of)
                own[k], own_weight[k], other[k] = len(good), w.sum(), later.ids[good].min()
                degree[good] += 1
                weight[good] += w
                for at in good[none[good]].tolist():  # once for a later document: earlier ones stand in the order of their ids
                    least[at] = ids[k] if least[at] is None else min(least[at], ids[k])
                none[good] = False
            yield rows(ids, own, own_weight, other)
        if held is not None:
            yield rows(*held)

    return run


def _all_pairs(sets: DataFrame, work, kinds: str) -> DataFrame:
    """work on every pair of packs of documents. Packs are written once and read by the tasks of a product of two tables, so that the
    pairs grow with the square of the documents, but what is shuffled or written only with the documents."""
    bare = sets.select("document_id", "_p", "_letters", "_own", "_top").filter(F.size("_top") > 0)
    packs = written(bare.mapInArrow(lean(_packs), "_news binary, _olds binary"))
    n = max(1, packs.count())
    cores = sets.sparkSession.sparkContext.defaultParallelism
    few = min(n, -(-3 * cores // n))  # parts of the earlier ones, so that all cores have pairs
    left, right = packs.select("_news").repartition(min(n, 64 * cores)), packs.select("_olds").repartition(max(few, -(-n // 64)))
    return left.join(right.hint("shuffle_replicate_nl")).mapInArrow(lean(work), kinds)


def set_edges(sets: DataFrame, shared: int = SHARED, score: float = SCORE) -> DataFrame:
    """The edges of edges() from sets: document_id, _p (when it was published), _letters, _own and _top, see keyword_sets."""
    kind = sets.schema["document_id"].dataType.simpleString()
    got = _all_pairs(sets, _edges(shared, score, _arrow(kind)), f"_new {kind}, _old {kind}, n_shared long, _s long, _least long")
    return got.select(F.least("_new", "_old").alias("source"), F.greatest("_new", "_old").alias("target"), "n_shared", F.round(F.col("_s") / F.col("_least"), 4).alias("weight"))


def set_degrees(sets: DataFrame, shared: int = SHARED, score: float = SCORE) -> DataFrame:
    """degrees() of set_edges(): edges are counted in the tasks that find them, so no edge is shuffled."""
    kind = sets.schema["document_id"].dataType.simpleString()
    got = _all_pairs(sets, _degrees(shared, score, _arrow(kind)), f"node {kind}, _n long, _w long, _o {kind}")
    return got.groupBy("node").agg(F.sum("_n").alias("degree"), F.round(F.sum("_w") / 10000, 4).alias("weight"), F.min("_o").alias("least_neighbour"))


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(kind))


def without_document(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left after documents are removed."""
    ids = gone.select("document_id")
    return nodes.join(ids, "document_id", "left_anti"), edges.join(ids, F.col("source") == F.col("document_id"), "left_anti").join(ids, F.col("target") == F.col("document_id"), "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """Degree, weight and least neighbour of each node."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight").unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "weight"))
    return both.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.round(F.sum("weight"), 4).alias("weight"), F.min("other").alias("least_neighbour"))


def integrity(entities: DataFrame, links: DataFrame, key: str = "id") -> DataFrame:
    """Links whose ends are missing and ids that repeat: issue, id."""
    ids = entities.select(key).distinct()
    miss = [links.select(F.col(end).alias(key)).join(ids, key, "left_anti").distinct().select(F.lit(f"missing {end}").alias("issue"), key) for end in ("source", "target")]
    twice = entities.groupBy(key).count().filter("count > 1").select(F.lit("duplicate").alias("issue"), key)
    return miss[0].unionByName(miss[1]).unionByName(twice)


def rebuilt(files: DataFrame, symbols: DataFrame, chunks: DataFrame, relationships: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """Repositories put together again, a row per file (files: id, repository_id, …): its symbols and chunks, each with the relationships
    that start there, its references, and the relationships that start at the file itself.

    symbols: file_id, qualified_name, id. chunks: file_id, start_line, id. relationships: id, source_id, target_id, type.
    references: source_file_id, id, target_id. Lists are sorted. Files are the largest thing in one row: a repository may have
    millions of them, so its rows share repository_id and are not folded further. flat_entities() undoes this.
    """
    if relationships is not None:
        links = relationships.groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("link_id"), "type", "target_id"))).alias("links"))
        symbols, chunks, files = (x.join(links, "id", "left") for x in (symbols, chunks, files))
    own = lambda c: [c] if relationships is not None else []
    one = symbols.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("qualified_name", "id", *own("links")))).alias("symbols"))
    two = chunks.groupBy(F.col("file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start_line", "id", *own("links")))).alias("chunks"))
    out = files.join(one, "id", "left").join(two, "id", "left")
    if references is not None:
        out = out.join(references.groupBy(F.col("source_file_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("reference_id"), "target_id"))).alias("references")), "id", "left")
    return out


def flat_entities(nested: DataFrame) -> dict[str, DataFrame]:
    """The tables that rebuilt() nested: symbols, chunks, relationships, references."""
    from functools import reduce

    def rows(kind: str) -> DataFrame:
        return nested.select(F.col("id").alias("file_id"), F.inline(kind))

    ends = [nested.select("id", "links"), rows("symbols").select("id", "links"), rows("chunks").select("id", "links")]
    links = reduce(DataFrame.unionByName, ends).select(F.col("id").alias("source_id"), F.inline("links")).select(F.col("link_id").alias("id"), "source_id", "target_id", "type")
    refs = nested.select(F.col("id").alias("source_file_id"), F.inline("references")).select("source_file_id", F.col("reference_id").alias("id"), "target_id")
    return {"symbols": rows("symbols").drop("links"), "chunks": rows("chunks").drop("links"), "relationships": links, "references": refs}


# --- links between chunks and media ---------------------------------------------------------------------


def aliases(chunks: DataFrame) -> DataFrame:
    """Names under which text refers to media chunks: file path, chunk path, both in brackets; the last chunk wins."""
    names = F.array_distinct(F.filter(F.array("file_path", "path", F.concat(F.lit("["), "file_path", F.lit("]")), F.concat(F.lit("["), "path", F.lit("]"))), lambda x: x.isNotNull() & (x != "")))
    rows = chunks.filter(F.col("chunk_type").isin("image", "table")).select("document_id", "chunk_id", "sort_order", F.explode(names).alias("alias"))
    return rows.groupBy("document_id", "alias").agg(F.max_by("chunk_id", "sort_order").alias("target"))


def embeds(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """References in text as connections: the reference, or it without brackets, by alias; with positions."""
    refs = chunks.select("document_id", "chunk_id", F.explode(T.chunk_ref_spans(F.col("content"))).alias("s")).select("document_id", "chunk_id", "s.*")
    own = refs.join(names.select("document_id", F.col("alias").alias("ref"), F.col("target").alias("_a")), ["document_id", "ref"], "left")
    bare = own.withColumn("_bare", F.regexp_replace("ref", r"^\[|\]$", "")).join(names.select("document_id", F.col("alias").alias("_bare"), F.col("target").alias("_b")), ["document_id", "_bare"], "left")
    return bare.withColumn("target", F.coalesce("_a", "_b")).filter("target is not null").select("document_id", "chunk_id", "target", F.lit("embeds").alias("relation"), "ref", "start", "end")


def merged_connections(rows: DataFrame, keys: tuple[str, ...] = ("document_id", "chunk_id", "target", "relation", "ref")) -> DataFrame:
    """Connections once per key and position; a key with a position drops its entries without."""
    some = F.max(F.col("start").isNotNull()).over(Window.partitionBy(*keys))
    kept = rows.withColumn("_some", some).filter("start is not null or not _some")
    w = Window.partitionBy(*keys, "start", "end").orderBy(F.desc("score"))
    return kept.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_some")


def matched_files(media: DataFrame, files: DataFrame) -> DataFrame:
    """Media chunks with the first of their candidate names (file path, original name, end of the path) that is a file."""
    names = media.select("chunk_id", F.posexplode(F.array("file_path", "original_name", F.element_at(F.split("path", "/"), -1))).alias("_p", "_name")).filter("_name is not null").withColumn("_base", F.element_at(F.split("_name", "/"), -1))
    listed = files.select(F.col("file"), F.element_at(F.split("file", "/"), -1).alias("_base"))
    best = names.join(listed, "_base").groupBy("chunk_id").agg(F.min_by("file", F.struct("_p", "file")).alias("file"))
    return media.join(best, "chunk_id", "left")


def renamed_refs(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Chunk paths and references in contents after renaming (old, new). Only the names that a chunk refers to reach it."""
    refs = chunks.select("document_id", "chunk_id", F.explode(T.chunk_refs(F.col("content"))).alias("_ref")).withColumn("old", F.regexp_replace("_ref", r"^\[|\]$", ""))
    own = refs.join(names, "old").groupBy("document_id", "chunk_id").agg(F.collect_list(F.struct("_ref", "new")).alias("_m"))
    out = chunks.join(own, ["document_id", "chunk_id"], "left").join(names.select(F.col("old").alias("path"), F.col("new").alias("_path")), "path", "left")
    fixed = F.aggregate(F.coalesce("_m", F.array().cast("array<struct<_ref:string,new:string>>")), F.col("content"), lambda a, m: F.replace(a, m["_ref"], F.concat(F.lit("["), m["new"], F.lit("]"))))
    return out.withColumn("content", fixed).withColumn("path", F.coalesce("_path", "path")).drop("_m", "_path")


def same_assets(assets: DataFrame) -> DataFrame:
    """Assets (path, content) with equal bytes: digest, number, first path."""
    return assets.groupBy(F.sha2("content", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).filter("n > 1")


def unused_assets(assets: DataFrame, chunks: DataFrame) -> DataFrame:
    used = chunks.select(F.explode(T.chunk_refs(F.col("content"))).alias("_r")).select(F.regexp_replace("_r", r"^\[|\]$", "").alias("path")).distinct()
    return assets.join(used, "path", "left_anti")
