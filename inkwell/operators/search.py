"""Search over chunks: many queries in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Constants of Okapi BM25 and of reciprocal-rank fusion, and default channel weights (fixed values).
K1, B, EPSILON, RRF_K = 1.5, 0.75, 0.25, 60
WEIGHTS = {"path": 1.0, "content": 2.0, "term": 1.5}
#: 64-bit numbers that hold the queries which a row matches.
WORDS = 4
#: Letters of the wanted texts that a task keeps in memory, and rows found that it hands on at once.
LETTERS, FOUND = 1 << 19, 1 << 16


def postings(chunks: DataFrame, text: Column, keys: list[str]) -> DataFrame:
    """Inverted index: term, keys, tf and the row's number of tokens dl."""
    rows = chunks.select(*keys, T.tokens(text).alias("_t")).withColumn("dl", F.size("_t"))
    return rows.select(*keys, "dl", F.explode("_t").alias("term")).groupBy("term", *keys, "dl").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "query", stopwords: tuple[str, ...] = T.STOPWORDS) -> DataFrame:
    return queries.select(query_id, F.explode(T.tokens(F.col(text), stopwords, distinct=True)).alias("term"))


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (_block, term, masks) in the order of block and term -> how many terms have a count of _df under bit _at."""

    def counted(block: int, counts: np.ndarray) -> pa.RecordBatch:
        flat = counts.ravel()
        some = np.flatnonzero(flat)
        pairs, terms = np.unique(flat[some] << 8 | some % counts.shape[1], return_counts=True)  # 64 * WORDS bits: 8 of a pair
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), block, np.int32)), pa.array((pairs & 255).astype(np.int32)), pa.array(pairs >> 8), pa.array(terms)], names=["_block", "_at", "_df", "_terms"])

    last, rest = None, np.zeros(64 * WORDS, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        block, term = batch.column(0).to_numpy(), batch.column(1).dictionary_encode().indices.to_numpy()
        bits = np.unpackbits(np.stack([batch.column(k).to_numpy() for k in range(2, 2 + WORDS)], axis=1).view(np.uint8), axis=1, bitorder="little")
        starts = np.append(0, np.flatnonzero((block[1:] != block[:-1]) | (term[1:] != term[:-1])) + 1)
        counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int32).astype(np.int64)
        if last == (block[0], batch.column(1)[0].as_py()):
            counts[0] += rest
        elif last is not None:
            yield counted(last[0], rest[None, :])
        last, rest = (block[-1], batch.column(1)[-1].as_py()), counts[-1]
        for own in np.unique(block[starts[:-1]]):
            yield counted(own, counts[:-1][block[starts[:-1]] == own])
    if last is not None:
        yield counted(last[0], rest[None, :])


def _mean_idf(index: DataFrame, matched: DataFrame, stats: DataFrame, low: DataFrame, keys: list[str], query_id: str) -> DataFrame:
    """query_id and _mean: the mean idf over the vocabulary of the rows that match each query of low.

    The queries that a row matches are the bits of masks, WORDS numbers for each block of 64 * WORDS queries. So a posting is
    joined with a block's masks, not with each query, and the bits of a term's postings are summed up in Arrow batches.
    """
    number = Window.orderBy(query_id)  # over the queries alone
    bits = 64 * WORDS
    place = low.select(query_id, (F.row_number().over(number) - 1).alias("_bit")).select(query_id, F.floor(F.col("_bit") / bits).cast("int").alias("_block"), (F.col("_bit") % bits).cast("int").alias("_at"))
    mask = [F.expr(f"bit_or(if(_at div 64 = {k}, shiftleft(1L, _at % 64), 0L))").alias(f"_m{k}") for k in range(WORDS)]
    masks = matched.join(place, query_id).groupBy(*keys, "_block").agg(*mask)
    rows = index.select(*keys, "term").join(masks, keys).select("_block", "term", *[f"_m{k}" for k in range(WORDS)])
    each = rows.repartition("_block", "term").sortWithinPartitions("_block", "term").mapInArrow(_bit_counts, "_block int, _at int, _df long, _terms long")
    wide = each.groupBy("_block", "_at", "_df").agg(F.sum("_terms").alias("_terms")).join(place, ["_block", "_at"]).join(stats, query_id)
    idf = F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5)
    return wide.groupBy(query_id).agg((F.sum(idf * F.col("_terms")) / F.sum("_terms")).alias("_mean"))


def bm25(index: DataFrame, terms: DataFrame, keys: list[str], query_id: str = "query_id") -> DataFrame:
    """query_id, keys, score of all rows that share a term with a query. The index is read three times: pass a written one.

    Statistics are those of the rows that match the query. A negative idf becomes EPSILON times the mean idf over
    the vocabulary of the matching rows; that mean is computed only for queries that have such a term.
    """
    hits = index.join(terms, "term")
    matched = hits.select(query_id, *keys, "dl").distinct()
    stats = matched.groupBy(query_id).agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avg"))
    df = hits.groupBy(query_id, "term").agg(F.count(F.lit(1)).alias("_df")).join(stats, query_id)
    df = df.withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    mean = _mean_idf(index, matched, stats, df.filter("_idf < 0").select(query_id).distinct(), keys, query_id)
    df = df.join(mean, query_id, "left").withColumn("_idf", F.when(F.col("_idf") < 0, EPSILON * F.col("_mean")).otherwise(F.col("_idf")))
    part = F.col("_idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("_avg")))
    return hits.join(df.select(query_id, "term", "_idf", "_avg"), [query_id, "term"]).groupBy(query_id, *keys).agg(F.sum(part).alias("score"))


def overlap(index: DataFrame, terms: DataFrame, keys: list[str], query_id: str = "query_id") -> DataFrame:
    """The number of different query terms in each row that has one."""
    return index.join(terms, "term").groupBy(query_id, *keys).agg(F.count(F.lit(1)).cast("double").alias("score"))


def words_holding(words: DataFrame, tokens: DataFrame, gram: int = 2) -> DataFrame:
    """_word, _token of all pairs in which the word holds the token (columns _word and _token, distinct, tokens not empty).

    They meet through the token's first `gram` letters at any place of the word, so nothing is compared with everything.
    """
    places = F.sequence(F.lit(1), F.greatest(F.length("_word"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda n: F.transform(places, lambda i: F.substring("_word", i, n)))))
    at = words.select("_word", F.explode(grams).alias("_gram"))
    return at.join(tokens.select("_token", F.substring("_token", 1, gram).alias("_gram")), "_gram").filter(F.contains("_word", "_token")).select("_word", "_token").distinct()


def _finder(item: str, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow on rows in the order of _group, a group's wanted texts (_whole) before its rows' texts (_low): item and keys of
    rows that hold a wanted text. One automaton of the group's wanted texts reads each text once."""

    def out(some: pa.RecordBatch, found: list, at: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found, some.schema.field(item).type), *[some.column(k).take(pa.array(at, pa.int64())) for k in keys]], names=[item, *keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        group, automaton, owners = None, ahocorasick.Automaton(), []
        for batch in batches:
            place = batch.column("_group").to_numpy()
            cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True) if len(place) else ():
                if place[a] != group:
                    group, automaton, owners = place[a], ahocorasick.Automaton(), []
                some = batch.slice(a, b - a)
                n = b - a - some.column("_whole").null_count
                for whole, own in zip(some.column("_whole").slice(0, n).to_pylist(), some.column(item).slice(0, n).to_pylist(), strict=True):
                    if automaton.add_word(whole, automaton.get(whole, len(owners))):
                        owners.append([])
                    owners[automaton.get(whole)].append(own)
                if n == b - a or not owners:
                    continue
                if automaton.kind == ahocorasick.TRIE:
                    automaton.make_automaton()
                found, at = [], []
                for row, text in enumerate(some.column("_low").slice(n).to_pylist(), n):
                    own = [x for k in {k for _, k in automaton.iter(text)} for x in owners[k]]
                    found += own
                    at += [row] * len(own)
                    if len(found) > FOUND:
                        yield out(some, found, at)
                        found, at = [], []
                if found:
                    yield out(some, found, at)

    return run


def rows_holding(rows: DataFrame, text: Column, items: DataFrame, keys: list[str], item: str, wanted: Column) -> DataFrame:
    """item, keys of all rows whose text holds the item's wanted text, exactly. Blank items hold nowhere.

    Wanted texts are cut into blocks of about LETTERS letters, rows into slots, and each block meets each slot in a partition of its own, so what
    is shuffled are the texts once per block and the wanted texts once per slot, never words of texts. A task keeps the wanted texts of a
    block in memory; texts pass by.
    """
    asked = items.select(item, wanted.alias("_whole")).filter(F.rlike("_whole", F.lit(r"\S")))
    blocks = max(1, -(-(asked.agg(F.sum(F.length("_whole"))).first()[0] or 0) // LETTERS))
    slots = max(1, -(-int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    group = (F.col("_block") * slots + F.col("_slot")).cast("int").alias("_group")
    asked = asked.select(item, "_whole", F.pmod(F.xxhash64("_whole"), F.lit(blocks)).alias("_block"), every(slots).alias("_slot")).select(item, "_whole", group)
    own = rows.select(*keys, text.alias("_low")).filter("_low is not null")
    own = own.select(*keys, "_low", F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("_slot"), every(blocks).alias("_block")).select(*keys, "_low", group)
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for d, cs in ((asked, [item]), (own, keys)) for c in cs)
    both = asked.unionByName(own, allowMissingColumns=True).repartitionById(blocks * slots, "_group")
    return both.sortWithinPartitions("_group", F.isnull("_whole")).mapInArrow(_finder(item, keys), kinds)


def term_hits(chunks: DataFrame, text: Column, queries: DataFrame, keys: list[str], query_id: str = "query_id", query: str = "query", stopwords: tuple[str, ...] = T.STOPWORDS, gram: int = 2) -> DataFrame:
    """Substring search: 100 if the whole query stands in the text, else the number of its tokens that do.

    Query tokens are located through the texts' different words: a token stands in a text exactly if it
    stands in one of the text's words (tokens have no white space). chunks is read twice: pass a written table.
    """
    low = F.lower(T.text_or_empty(text))
    rows = chunks.select(*keys, low.alias("_low"))
    words = rows.select(*keys, F.explode(F.array_distinct(F.split("_low", r"\s+"))).alias("_word"))
    asked = queries.select(query_id, F.lower(F.trim(query)).alias("_whole"), T.tokens(F.col(query), stopwords, distinct=True).alias("_tokens"))
    asked = asked.filter((F.col("_whole") != "") & (F.size("_tokens") > 0))
    inside = words_holding(words.select("_word").distinct(), asked.select(F.explode("_tokens").alias("_token")).distinct(), gram)
    per_token = words.join(inside, "_word").select(*keys, "_token").distinct()
    counted = per_token.join(asked.select(query_id, F.explode("_tokens").alias("_token")), "_token").groupBy(query_id, *keys).agg(F.count(F.lit(1)).cast("double").alias("_hits"))
    # the whole query can only stand in rows that have all its tokens
    full = counted.join(asked.select(query_id, "_whole", F.size("_tokens").alias("_all")), query_id).filter(F.col("_hits") == F.col("_all"))
    full = full.join(rows, keys).filter(F.contains("_low", "_whole")).select(query_id, *keys, F.lit(100.0).alias("_full"))
    return counted.join(full, [query_id, *keys], "left").select(query_id, *keys, F.coalesce("_full", "_hits").alias("score"))


def top_rows(scored: DataFrame, k: int | Column, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """The k best rows per query (and channel), rank0 from 0: by score, then by keys."""
    w = Window.partitionBy(*(by or ["query_id"])).orderBy(F.desc("score"), *keys)
    return scored.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k)


def fused(ranked: DataFrame, keys: list[str], weights: dict[str, float] | None = None, own: str | None = None) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, channel, keys, rank0): sums of weight/(RRF_K + rank + 1).

    A map column `own` overrides the default weights query by query.
    """
    default = F.create_map(*[F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair])
    weight = F.coalesce(default[F.col("channel")], F.lit(1.0))
    if own:
        weight = F.coalesce(F.col(own)[F.col("channel")], weight)
    return ranked.groupBy("query_id", *keys).agg(F.round(F.sum(weight / (RRF_K + F.col("rank0") + 1)), 6).alias("score"))


def normalised(scored: DataFrame, by: list[str], score: str = "score", out: str = "norm_score", default: float = 0.5) -> DataFrame:
    """Min-max scores per query: all not above 0 give 0, equal ones the default."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    value = F.when((high <= 0) & (low <= 0), 0.0).when(high == low, default).otherwise(F.round((F.col(score) - low) / (high - low), 6))
    return scored.withColumn(out, value)


def same_section(scored: DataFrame, keys: list[str], section: Column) -> DataFrame:
    """One row per query, document and section: contents in rank order, the largest score, the first row's chunk."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    ranked = scored.withColumn("_rank", F.row_number().over(w)).withColumn("_section", section)
    return ranked.groupBy("query_id", "document_id", "_section").agg(
        F.min("_rank").alias("rank"), F.min_by("chunk_id", "_rank").alias("chunk_id"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n_chunks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "content"))), lambda x: x["content"]), "\n").alias("content"),
    ).withColumnRenamed("_section", "section_path")


def top_documents(scored: DataFrame, k: int = 5) -> DataFrame:
    """The k documents with most fused rows per query."""
    counts = scored.groupBy("query_id", "document_id").agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n_rows"), "document_id")
    return counts.withColumn("rank0", F.row_number().over(w) - 1).filter(F.col("rank0") < k)


def discovery_signals(scored: DataFrame) -> DataFrame:
    """Section paths per query and document in order of their best rank; Root is left out."""
    first = scored.filter("section_path <> 'Root'").groupBy("query_id", "document_id", "section_path").agg(F.min("rank0").alias("_r"))
    return first.groupBy("query_id", "document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "section_path"))), lambda x: x["section_path"]).alias("paths"))


def small_corpus(chunks: DataFrame, queries: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """All rows of a query's scope with score 1 where the scope has at most top_k rows. Scopes are counted first, so that only
    rows of scopes that are small enough for some query meet queries."""
    size = chunks.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    few = queries.join(size, scope).filter("_n <= top_k").drop("_n")
    w = Window.partitionBy("query_id").orderBy(*order)
    return few.join(chunks, scope).withColumn("rank0", F.row_number().over(w) - 1).withColumn("score", F.lit(1.0)).withColumn("route", F.lit("small_corpus_all"))


def best_vectors(asked: pa.Table, found: pa.Table, k: int, tile: int = 256, part: int = 4096) -> pa.Table:
    """The k rows of found (_v, _x) with the largest cosine to each row of asked (_q, _x): _q, _v, score; ties by _v.

    Products are made tile by part, so that work arrays stay at tile * (part + k) numbers.
    """
    if not asked.num_rows or not found.num_rows:
        return pa.table({"_q": asked["_q"].slice(0, 0), "_v": found["_v"].slice(0, 0), "score": pa.array([], pa.float64())})

    def unit(column: pa.ChunkedArray) -> np.ndarray:
        x = pc.list_flatten(column).to_numpy().reshape(len(column), -1)
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    found = found.sort_by("_v")
    units, out_at, out_score = unit(asked["_x"]), [], []
    parts = [(b, unit(found["_x"].slice(b, part))) for b in range(0, found.num_rows, part)]
    for a in range(0, len(units), tile):
        own = units[a : a + tile]
        score, at = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64)
        for b, x in parts:
            score = np.concatenate([score, np.round(own @ x.T, 6)], axis=1)
            at = np.concatenate([at, np.broadcast_to(np.arange(b, b + len(x)), (len(own), len(x)))], axis=1)
            by = np.argsort(-score, axis=1, kind="stable")[:, :k]  # columns are in the order of keys among equal scores
            score, at = np.take_along_axis(score, by, 1), np.take_along_axis(at, by, 1)
        out_score.append(score)
        out_at.append(at)
    score, at = np.concatenate(out_score), np.concatenate(out_at)
    rows = np.repeat(np.arange(len(score)), score.shape[1])
    return pa.table({"_q": asked["_q"].take(pa.array(rows)), "_v": found["_v"].take(pa.array(at.ravel())), "score": pa.array(score.ravel())})


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", block: int = 4096, slot: int = 16384) -> DataFrame:
    """The k vectors with the largest cosine per query, exactly.

    Queries are cut into blocks of `block` at most, vectors into slots of about `slot`. Each block meets each slot once, in tiles of
    a matrix product in a task of its own that keeps the k best per query, so a task's memory does not grow with either side.
    """
    numbers = queries.agg(F.count(F.lit(1)).alias("q")).crossJoin(vectors.agg(F.count(F.lit(1)).alias("v"))).first()
    blocks, slots = max(1, -(-numbers.q // block)), max(1, -(-numbers.v // slot))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(F.col(query_id).alias("_q"), F.transform(vector, lambda x: x.cast("double")).alias("_x"), F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int").alias("_block"), every(slots).alias("_slot"))
    right = vectors.select(F.col(key).alias("_v"), F.transform(vector, lambda x: x.cast("double")).alias("_x"), every(blocks).alias("_block"), F.pmod(F.xxhash64(key), F.lit(slots)).cast("int").alias("_slot"))
    kinds = f"_q {left.schema['_q'].dataType.simpleString()}, _v {right.schema['_v'].dataType.simpleString()}, score double"
    parts = 2 * blocks * slots  # hardly two meet in one task
    left, right = (x.repartition(parts, "_block", "_slot") for x in (left, right))
    met = left.groupBy("_block", "_slot").cogroup(right.groupBy("_block", "_slot")).applyInArrow(lambda a, b: best_vectors(a, b, k), kinds)
    return top_rows(met.select(F.col("_q").alias(query_id), F.col("_v").alias(key), "score"), k, [key], [query_id])