"""Similarity join of word shingles by chosen paths: sets are split on sampled minima until buckets are small.

A run starts with one sampled position of a set's minima; a bucket that is still large is split again on
sampled positions, some branching twice so that a similar pair is expected to stay together about once a
level. Small buckets are compared exhaustively. Runs are repeated until the target recall. Pairs are
neither emitted nor counted twice: a pair belongs to the least bucket that both sets share, and a bucket
returns one row per member, with its number of links and the least member it is linked to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .grams import min_hashes, sequence_digests, shingles, words
from .shared import lean, named, row_key, sealed, shared_dir, slices, unsealed, utf8, written

#: Minima kept per set; the first ones are the roots of the runs.
FUNCTIONS = 64
#: Buckets of up to SMALL sets are compared exhaustively, others are split, at most DEPTH times; what can't
#: be split by then, or kept the share DENSE of its parent (near-equal sets), is compared block by block, so that
#: no pair is lost.
SMALL, DEPTH, DENSE = 256, 8, 0.75
#: One in so many large buckets branches twice; standard deviations allowed to the sketches' estimate.
TWICE, DEVIATIONS = 4, 4.0
WORK_BYTES = (2 << 20) - 8


def runs_for(recall: float, threshold: float) -> int:
    """Runs after which a pair at the threshold has met with the wanted probability even in buckets of the deepest level.

    One level keeps a pair together with probability threshold; a bucket that branches twice gives it two chances.
    Raises ValueError where the positions kept as roots don't suffice: the recall or the threshold is to be changed then.
    """
    meets = 1.0
    for _ in range(DEPTH):
        meets = threshold * ((1 - 1 / TWICE) * meets + 1 / TWICE * (1 - (1 - meets) ** 2))
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))
    if runs > FUNCTIONS // 2:
        raise ValueError(f"recall {recall} at similarity {threshold} takes {runs} runs, {FUNCTIONS // 2} are possible")
    return runs


def signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, _row, _set (names the word sequence), _minima, _size (number of shingles), per row of docs."""
    rows = docs.select(named(key).alias("_key"), row_key(key, text).alias("_row"), F.coalesce(named(text), F.lit("")).alias("_text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a, b in slices(offsets, WORK_BYTES):
                word, bounds = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                shingle, to = shingles(word, bounds, width)
                minima = min_hashes(shingle, to, FUNCTIONS)
                names = sequence_digests(word, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.tobytes() for x in names], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * FUNCTIONS), pa.array(minima.ravel())), pa.array(np.diff(to), pa.int64())],
                    names=["_key", "_row", "_set", "_minima", "_size"],
                )

    return rows.mapInArrow(lean(sign), f"_key {rows.schema['_key'].dataType.simpleString()}, _row string, _set binary, _minima array<int>, _size long")


def leaves(sets: DataFrame, runs: int, path: str) -> DataFrame:
    """_set, _leaf, _n of all buckets of two or more sets at which the splitting ends. sets is written."""
    first = [F.xxhash64(F.lit(r), F.element_at("_minima", r + 1)) for r in range(runs)]
    at = sets.filter("_size > 0").select("_set", F.explode(F.array(*first)).alias("_leaf"), F.lit(None).cast("long").alias("_parent"))
    ended = None
    for level in range(1, DEPTH + 1):
        number = at.groupBy("_leaf").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        met = written(at.join(number, "_leaf"), f"{path}/level-{level}")
        done = (F.col("_n") <= SMALL) | (F.col("_n") >= F.coalesce(F.col("_parent") * DENSE, F.lit(float("inf"))))
        out = (met if level == DEPTH else met.filter(done)).select("_set", "_leaf", "_n")
        ended = out if ended is None else ended.unionByName(out)
        large = met.filter(~done)
        if level == DEPTH or large.isEmpty():
            break
        pick = [F.pmod(F.xxhash64(F.col("_leaf"), F.lit(f"{level}/{k}")), F.lit(FUNCTIONS - runs)).cast("int") + runs + 1 for k in (0, 1)]
        twice = F.pmod(F.xxhash64(F.col("_leaf"), F.lit(f"{level}/twice")), F.lit(TWICE)) == 0
        next_ = [F.xxhash64(F.col("_leaf"), p, F.element_at("_minima", p)) for p in pick]
        branch = F.explode(F.when(twice & (pick[0] != pick[1]), F.array(*next_)).otherwise(F.array(next_[0])))
        at = large.join(sets.select("_set", "_minima"), "_set").select("_set", branch.alias("_leaf"), F.col("_n").alias("_parent"))
    return ended.distinct()


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a sorted partition; a run may span batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
            if rest:
                change[0] |= v[0] != rest[-1].column(k)[-1].as_py()
        cuts = np.flatnonzero(change)
        if not len(cuts):
            rest.append(batch)
            continue
        if cuts[0] or rest:
            yield pa.Table.from_batches([*rest, batch.slice(0, cuts[0])])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        rest = [batch.slice(cuts[-1])]
    if rest:
        yield pa.Table.from_batches(rest)


def _lists(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy().astype(kind, copy=False)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _own_pairs(leaf: int, minima: np.ndarray, paths: list[np.ndarray], side: np.ndarray, cross: bool, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each member i, the later members j whose pair belongs here and whose sketches agree in least places."""
    lower = [frozenset(p[p < leaf].tolist()) for p in paths]
    for i in range(len(minima) - 1):
        j = np.flatnonzero((minima[i + 1 :] == minima[i]).sum(1) >= least) + i + 1
        if cross:
            j = j[side[j] != side[i]]
        if len(j) and lower[i]:
            j = np.array([k for k in j if lower[i].isdisjoint(lower[k])], np.int64)
        if len(j):
            yield i, j


def candidates(sets: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """_leaf, _a, _b, _set, _side, _minima, _paths of the members that have a likely partner in their bucket."""
    paths = found.groupBy("_set").agg(F.sort_array(F.collect_list("_leaf")).alias("_paths"), F.collect_list(F.struct("_leaf", "_n")).alias("_at"))
    rows = paths.join(sets.select("_set", "_minima"), "_set").select("_set", "_minima", "_paths", F.explode("_at").alias("_x")).select("_set", "_minima", "_paths", "_x.*")
    blocks = F.ceil(F.col("_n") / SMALL).cast("int")
    rows = rows.withColumn("_blocks", F.when(F.col("_n") <= SMALL, F.lit(1)).otherwise(blocks)).withColumn("_side", F.pmod(F.hash("_set"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("_leaf", F.least("_side", "_other").alias("_a"), F.greatest("_side", "_other").alias("_b"), "_side", "_set", "_minima", "_paths")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["_leaf", "_a", "_b"]):
            if group.num_rows < 2:
                continue
            minima = np.stack(_lists(group.column("_minima"), np.int32))
            side = group.column("_side").to_numpy()
            use = np.zeros(group.num_rows, bool)
            for i, j in _own_pairs(group.column("_leaf")[0].as_py(), minima, _lists(group.column("_paths"), np.int64), side, group.column("_a")[0] != group.column("_b")[0], least):
                use[i] = True
                use[j] = True
            if use.any():
                yield from group.filter(pa.array(use)).combine_chunks().to_batches()

    return rows.repartition("_leaf", "_a", "_b").sortWithinPartitions("_leaf", "_a", "_b").mapInArrow(lean(likely), rows.schema)


def linked(likely: DataFrame, texts: DataFrame, threshold: float, width: int, least: int) -> DataFrame:
    """_set, _links, _least: for each member of a bucket with links there, their number and a lesser member of
    its group of linked members (itself if none). likely: from candidates(), with _row; texts: _row, _text."""
    rows = likely.join(texts, "_row").select("_leaf", "_a", "_b", "_side", "_set", "_minima", "_paths", "_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, ["_leaf", "_a", "_b"]):
            names = group.column("_set").to_pylist()
            new = np.array([n not in names[:k] for k, n in enumerate(names)]) if len(set(names)) < len(names) else np.ones(len(names), bool)
            group = group.filter(pa.array(new)).combine_chunks()
            names = group.column("_set").to_pylist()
            if len(names) < 2:
                continue
            raw, offsets = utf8(group.column("_text"))
            each: list[np.ndarray] = []
            for a, b in slices(offsets, WORK_BYTES):
                shingle, to = shingles(*words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), width)
                each += [np.unique(shingle[x:y]) for x, y in zip(to[:-1], to[1:], strict=True)]
            sizes = np.array([len(x) for x in each])
            # postings of the bucket: for each shingle, its members in order
            flat = np.concatenate(each)
            owner = np.repeat(np.arange(len(each)), sizes)
            code = np.unique(flat, return_inverse=True)[1]
            by = np.argsort(code, kind="stable")
            members = owner[by]
            begin = np.append(0, np.cumsum(np.bincount(code)))
            ends = np.append(0, np.cumsum(sizes))
            links, parent = np.zeros(len(each), np.int64), list(range(len(each)))

            def root(x: int, parent: list[int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            minima = np.stack(_lists(group.column("_minima"), np.int32))
            cross = group.column("_a")[0] != group.column("_b")[0]
            for i, j in _own_pairs(group.column("_leaf")[0].as_py(), minima, _lists(group.column("_paths"), np.int64), group.column("_side").to_numpy(), cross, least):
                if len(j) < 4:
                    both = np.array([len(np.intersect1d(each[i], each[k], assume_unique=True)) for k in j])
                else:
                    own = code[ends[i] : ends[i + 1]]
                    size = begin[own + 1] - begin[own]
                    at = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    both = np.bincount(members[at], minlength=len(each))[j]
                for k in j[both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9]:
                    links[i] += 1
                    links[k] += 1
                    parent[root(int(k))] = root(i)
            some = np.flatnonzero(links)
            if len(some):
                low: dict[int, bytes] = {}
                for x in some:
                    low[root(int(x))] = min(low.get(root(int(x)), names[x]), names[x])
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in some], pa.binary()), pa.array(links[some]), pa.array([low[root(int(x))] for x in some], pa.binary())], names=["_set", "_links", "_least"])

    return rows.repartition("_leaf", "_a", "_b").sortWithinPartitions("_leaf", "_a", "_b").mapInArrow(lean(compare), "_set binary, _links long, _least binary")


def chosen_path_join(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8, width: int = 5, recall: float = 0.99) -> DataFrame:
    """One row per row of docs: key, class_id, text_id, n_links, kept and row_key.

    text_id is the least key with the same word sequence. n_links counts the other word sequences whose
    sets of width-word shingles have a Jaccard similarity of threshold or more with this one's (checked
    exactly; found with probability recall or more each). class_id is the least key of the documents
    connected by equal texts and links; kept marks one document of each class.

    Null text counts as empty; all texts without words are one class without links. Null keys come after
    all others. Repeated rows belong to one class; row_key, a hash of key and text, tells which row is
    meant. Empty input: empty result. Columns other than key and text are not read.
    """
    path = shared_dir(docs.sparkSession)
    runs = runs_for(recall, threshold)
    least = max(1, math.floor(FUNCTIONS * (threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / FUNCTIONS))))
    signed = written(signatures(docs, key, text, width), f"{path}/signatures")
    first = F.min(F.struct(F.col("_key").isNull().alias("no_key"), F.col("_key").alias("key"), F.col("_row").alias("row"))).alias("_first")
    sets = written(signed.groupBy("_set").agg(first, F.first("_minima").alias("_minima"), F.first("_size").alias("_size")), f"{path}/sets")
    found = leaves(sets, runs, path)
    likely = written(candidates(sets, found, least).join(sets.select("_set", F.col("_first.row").alias("_row")), "_set"), f"{path}/likely")
    needed = likely.select("_row").distinct().hint("merge")  # the same plan at every size
    texts = docs.select(row_key(key, text).alias("_row"), F.coalesce(named(text), F.lit("")).alias("_text")).join(needed, "_row", "left_semi")
    links = written(linked(likely, texts, threshold, width, least), f"{path}/links")
    roots = components(links.select(F.col("_set").alias("a"), F.col("_least").alias("b")))
    roots_of = sets.select("_set", "_first").join(roots.select(F.col("node").alias("_set"), F.col("root").alias("_root")), "_set", "left").withColumn("_root", F.coalesce("_root", "_set"))
    roots_of = roots_of.join(links.groupBy("_set").agg(F.sum("_links").alias("_links")), "_set", "left")
    heads = roots_of.groupBy("_root").agg(F.min("_first").alias("_head"))
    roots_of = roots_of.join(heads, "_root").select("_set", "_first", "_head", F.coalesce("_links", F.lit(0)).alias("_links"))
    kept = F.col("_row") == F.col("_head.row")
    return signed.join(roots_of, "_set").select(F.col("_key").alias(key), F.col("_head.key").alias("class_id"), F.col("_first.key").alias("text_id"), F.col("_links").alias("n_links"), kept.alias("kept"), F.col("_row").alias("row_key"))


def one_per_class(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each class of chosen_path_join, all columns as they are. Of rows with equal key and text
    any one stays; columns may have any name."""
    names = docs.columns
    rows = docs.select(*sealed(docs), row_key(key, text).alias("_row"))
    kept = chosen_path_join(docs.select(named(key), named(text)), key, text, **how).filter("kept").select(F.col("row_key").alias("_row")).distinct()
    return rows.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*unsealed(names))
