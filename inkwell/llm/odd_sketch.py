"""Near-duplicate detection by MinHash bands and odd sketches.

A text's MinHash samples are folded into a bitmap of parities, its odd sketch: two sketches differ in few bits if the sets are
similar, and how many tells a high similarity more precisely than as many bits of plain samples. Texts that share a band of samples
are candidates; their sketches are compared first, their full shingle sets last.

No bucket's pairs are listed. Every member is compared with its bucket's head, which joins a group of near copies in linear work.
Where a bucket still holds several components then, the texts outside its largest one are compared with all that are in
another component, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .grams import STEP, min_hashes, sequence_digests, shingles, words
from .shared import lean, mixed, named, possible, row_key, shared_dir, slices, utf8, written

#: Bands and samples in each; at 85 percent a link is missed in all of them once in 13,000 times.
BANDS, ROWS = 20, 6
#: Samples folded into a sketch (the first ones are the bands'), bits of a sketch, and the deviations that a link may be off.
SAMPLES, BITS, DEVIATIONS = 240, 512, 4.5
#: Texts compared with at a time, and texts streamed past them in a task.
PIVOTS, MEMBERS = 128, 4096
WORK_BYTES, WORK_ROWS = 1 << 20, 1024

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def most_bits(percent: int) -> int:
    """Bits in which the sketches of linked sets differ at most, DEVIATIONS standard deviations of both estimates included."""
    j = percent / 100
    differ = 2 * SAMPLES * (1 - j)
    met = differ * differ / (2 * BITS)  # pairs that fall on one bit, each of which takes two bits away
    wide = math.sqrt(j * (1 - j) / SAMPLES + 4 * met / (math.exp(-2 * differ / BITS) * 2 * SAMPLES) ** 2)
    return math.floor(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - max(0.0, j - DEVIATIONS * wide)) / BITS)))


def odd_sketches(minima: np.ndarray) -> np.ndarray:
    """texts x BITS / 64 numbers: the parities of the samples that fall on each bit."""
    rows = np.arange(len(minima))
    odd = np.zeros((len(minima), BITS), np.uint8)
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            place = mixed(minima[:, k].view(np.uint32).astype(np.uint64) + np.uint64(k + 1 << 32)) % np.uint64(BITS)
            odd[rows, place.astype(np.int64)] ^= 1
    return np.packbits(odd, axis=1).view(np.int64)


def band_hashes(minima: np.ndarray) -> np.ndarray:
    """texts x BANDS hashes of the samples of each band."""
    out = np.zeros((len(minima), BANDS), np.uint64)
    samples = minima.view(np.uint32).astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(BANDS):
            out[:, k] = mixed(np.uint64(k + 1) * STEP)
            for row in range(ROWS):
                out[:, k] = mixed(out[:, k] * STEP + samples[:, k * ROWS + row])
    return out.view(np.int64)


def _sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their bounds by text, shingle hashes, their bounds by text; A-Z lower-cased."""
    word, bounds = words(_LOWER[raw], offsets)
    return (word, bounds, *shingles(word, bounds, width))


def sketched(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """_key, _row, _set (names the word sequence), _size (distinct shingles), _bands, _sketch, per row of docs."""
    rows = docs.select(named(key).alias("_key"), row_key(key, text).alias("_row"), F.coalesce(named(text), F.lit("")).alias("_text"))

    def lists(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for a, b in slices(offsets, WORK_BYTES, WORK_ROWS) if batch.num_rows else ():
                word, bounds, shingle, to = _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                minima = min_hashes(shingle, to, SAMPLES)
                size = np.array([len(np.unique(shingle[x:y])) for x, y in zip(to[:-1], to[1:], strict=True)], np.int64)
                name = pa.array([x.tobytes() for x in sequence_digests(word, bounds)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), name, pa.array(size), lists(band_hashes(minima)), lists(odd_sketches(minima))], names=["_key", "_row", "_set", "_size", "_bands", "_sketch"])

    return rows.mapInArrow(lean(sign), f"_key {rows.schema['_key'].dataType.simpleString()}, _row string, _set binary, _size long, _bands array<long>, _sketch array<long>")


#: A text in a group of comparisons: the pivots come first, the members stream past them.
MEMBER = "_g long, _pivot boolean, _set binary, _row string, _label binary, _size long, _sketch array<long>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.RecordBatch]]:
    """(group, whether these are its pivots, rows) of a sorted partition; a group may take several segments."""
    for batch in batches:
        if batch.num_rows:
            group, pivot = batch.column("_g").to_numpy(), batch.column("_pivot").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((group[1:] != group[:-1]) | (pivot[1:] != pivot[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
                for c in range(a, b, WORK_ROWS):
                    yield int(group[a]), bool(pivot[a]), batch.slice(c, min(b - c, WORK_ROWS))


def _likely(a: pa.RecordBatch, b: pa.RecordBatch, percent: int, most: int) -> np.ndarray:
    """Which rows of a (down) may be linked with which of b (across): by label, size and sketch."""

    def sketches(x: pa.RecordBatch) -> np.ndarray:
        return x.column("_sketch").flatten().to_numpy().view(np.uint64).reshape(x.num_rows, -1)

    def labels(x: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(x.column("_label").to_pylist()), np.uint64).reshape(x.num_rows, 2)

    x, y, la, lb = a.column("_size").to_numpy()[:, None], b.column("_size").to_numpy()[None, :], labels(a), labels(b)
    fit = (la[:, None, :] != lb[None, :, :]).any(2) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
    sa, sb = sketches(a), sketches(b)
    apart = np.zeros(fit.shape, np.int32)
    for k in range(sa.shape[1]):
        apart += np.bitwise_count(sa[:, k, None] ^ sb[None, :, k])
    return fit & (apart <= most)


def flagged(rows: DataFrame, percent: int) -> DataFrame:
    """The rows (MEMBER) of each group that have a likely partner there, by sketches alone."""
    most = most_bits(percent)

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivots, met = None, [], []

        def end() -> Iterator[pa.RecordBatch]:
            for p, m in zip(pivots, met, strict=True):
                if m.any():
                    yield p.filter(pa.array(m))

        for group, pivot, some in _segments(batches):
            if group != at:
                yield from end()
                at, pivots, met = group, [], []
            if pivot:
                pivots.append(some)
                met.append(np.zeros(some.num_rows, bool))
                continue
            own = np.zeros(some.num_rows, bool)
            for p, m in zip(pivots, met, strict=True):
                likely = _likely(some, p, percent, most)
                own |= likely.any(1)
                m |= likely.any(0)
            if own.any():
                yield some.filter(pa.array(own))
        yield from end()

    return rows.repartition("_g").sortWithinPartitions("_g", F.desc("_pivot")).mapInArrow(lean(flag), MEMBER)


def confirmed(rows: DataFrame, docs: DataFrame, key: str, text: str, percent: int, width: int) -> DataFrame:
    """(a, b): links between a pivot and a member of one group (rows: MEMBER), checked on the full shingle sets. A pair that links
    of its group connect already is not checked. Texts are read again from docs, those needed only."""
    most = most_bits(percent)
    whole = docs.select(row_key(key, text).alias("_row"), F.coalesce(named(text), F.lit("")).alias("_text"))
    needed = rows.select("_row").distinct()
    texts = possible(whole, needed, "_row")
    with_text = rows.join(texts, "_row").select("_g", "_pivot", "_set", "_label", "_size", "_sketch", "_text")

    def sets(some: pa.RecordBatch) -> Iterator[np.ndarray]:
        raw, offsets = utf8(some.column("_text"))
        for a, b in slices(offsets, WORK_BYTES, WORK_ROWS) if some.num_rows else ():
            _, _, shingle, to = _sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
            yield from (np.unique(shingle[x:y]) for x, y in zip(to[:-1], to[1:], strict=True))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        pivots: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for group, pivot, some in _segments(batches):
            if group != at:
                at, pivots, parent = group, [], {}
            if pivot:
                pivots.append((some, list(sets(some))))
                continue
            links: list[tuple[bytes, bytes]] = []
            for block, full in pivots:
                likely = _likely(some, block, percent, most)
                own = np.flatnonzero(likely.any(1))
                mine = some.take(pa.array(own))
                for i, got in zip(own.tolist(), sets(mine), strict=True):
                    label, name = some.column("_label")[i].as_py(), some.column("_set")[i].as_py()
                    for k in np.flatnonzero(likely[i]).tolist():
                        other = block.column("_label")[k].as_py()
                        if root(label) == root(other):
                            continue
                        both = len(np.intersect1d(got, full[k], assume_unique=True))
                        if 100 * both >= percent * (len(got) + len(full[k]) - both):
                            parent[root(label)] = root(other)
                            links.append((block.column("_set")[k].as_py(), name))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], names=["a", "b"])

    return with_text.repartition("_g").sortWithinPartitions("_g", F.desc("_pivot")).mapInArrow(lean(confirm), "a binary, b binary")


def _with_heads(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Groups (MEMBER) of each bucket's head and its likely partners; a head's partners are dealt in parts of about MEMBERS."""
    pairs = at.filter("_set <> _head").select("_head", "_set").distinct()
    heads = sets.select(F.col("_set").alias("_head"), F.col("_size").alias("_head_size"), F.col("_sketch").alias("_head_sketch"))
    pairs = pairs.join(sets.select("_set", "_row", "_size", "_sketch"), "_set").join(heads, "_head")
    differ = sum((F.bit_count(F.element_at("_sketch", k + 1).bitwiseXOR(F.element_at("_head_sketch", k + 1))) for k in range(BITS // 64)), F.lit(0))
    fit = 100 * F.least("_size", "_head_size") >= percent * F.greatest("_size", "_head_size")
    likely = written(pairs.filter(fit & (differ <= most_bits(percent))).select("_head", "_set", "_row", "_size", "_sketch"))
    parts = likely.groupBy("_head").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("_parts"))
    group = F.xxhash64(F.lit("head"), F.col("_head"), F.col("_part")).alias("_g")
    members = likely.join(parts, "_head").withColumn("_part", F.pmod(F.hash("_set"), F.col("_parts"))).select(group, F.lit(False).alias("_pivot"), "_set", "_row", F.col("_set").alias("_label"), "_size", "_sketch")
    pivots = parts.select("_head", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")).join(sets.select(F.col("_set").alias("_head"), "_row", "_size", "_sketch"), "_head")
    return members.unionByName(pivots.select(group, F.lit(True).alias("_pivot"), F.col("_head").alias("_set"), "_row", F.col("_head").alias("_label"), "_size", "_sketch"))


def _across(at: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups (MEMBER) of the buckets that hold several components: the texts outside the largest one are pivots in blocks, past
    which all texts of the bucket go; of two such texts, one is a pivot for the other."""
    at = at.select("_bucket", "_set").join(labels, "_set", "left").select("_bucket", "_set", F.coalesce("_label", "_set").alias("_label"))
    open_ = at.groupBy("_bucket").agg(F.min("_label").alias("_x"), F.max("_label").alias("_y")).filter("_x <> _y").select("_bucket")
    at = written(at.join(open_, "_bucket"))
    each = at.groupBy("_bucket", "_label").agg(F.count(F.lit(1)).alias("_n"))
    size = each.groupBy("_bucket").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", "_label")).alias("_top"))
    size = size.select("_bucket", F.col("_top._label").alias("_top"), F.ceil((F.col("_all") - F.col("_top._n")) / PIVOTS).cast("int").alias("_blocks"), F.ceil(F.col("_all") / MEMBERS).cast("int").alias("_parts"))
    rows = at.join(size, "_bucket").join(sets.select("_set", "_row", "_size", "_sketch"), "_set")
    rows = rows.withColumn("_block", F.when(F.col("_label") != F.col("_top"), F.pmod(F.hash("_set"), F.col("_blocks")))).withColumn("_part", F.pmod(F.hash("_set", F.lit(1)), F.col("_parts")))
    group = F.xxhash64(F.lit("across"), F.col("_bucket"), F.col("_b"), F.col("_p")).alias("_g")
    pivots = rows.filter("_block IS NOT NULL").select("*", F.col("_block").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_p"))
    members = rows.select("*", F.col("_part").alias("_p"), F.explode(F.sequence(F.lit(0), F.coalesce("_block", F.col("_blocks") - 1))).alias("_b"))
    columns = ["_set", "_row", "_label", "_size", "_sketch"]
    return pivots.select(group, F.lit(True).alias("_pivot"), *columns).unionByName(members.select(group, F.lit(False).alias("_pivot"), *columns))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, width: int = 5) -> DataFrame:
    """key, n_shingles, component_id, kept per row of docs.

    A text's set holds its distinct runs of width words (A-Z lower-cased), or its whole word sequence if it has fewer words.
    Texts are linked where 100 * intersection >= percent * union, which is checked on the full sets. component_id is the smallest key
    that links (and equal sets) lead to; kept marks the rows whose key that is.

    Null or wordless text: no shingles, linked with nothing, its own component. Null key: after all other keys. Repeated rows have one
    component, and as their keys are equal all of them are kept. Empty docs: empty result. Other columns are not read.
    """
    path = shared_dir(docs.sparkSession)
    signed = written(sketched(docs, key, text, width), f"{path}/signed")
    first = F.min(F.struct(F.col("_key").isNull().alias("no"), F.col("_key").alias("key"))).alias("_first")
    sets = written(signed.filter("_size > 0").groupBy("_set").agg(first, F.min("_row").alias("_row"), F.first("_size").alias("_size"), F.first("_bands").alias("_bands"), F.first("_sketch").alias("_sketch")), f"{path}/sets")
    rows = sets.select("_set", F.explode("_bands").alias("_bucket"))
    heads = rows.groupBy("_bucket").agg(F.min("_set").alias("_head"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    at = written(rows.join(heads, "_bucket"), f"{path}/buckets")
    near = written(confirmed(_with_heads(at, sets, percent), docs, key, text, percent, width), f"{path}/near")
    labels = written(components(near).select(F.col("node").alias("_set"), F.col("root").alias("_label")), f"{path}/labels")
    likely = written(flagged(_across(at, sets, labels), percent), f"{path}/likely")
    far = written(confirmed(likely, docs, key, text, percent, width), f"{path}/far")
    named_ = labels.select(F.col("_set").alias("_n"), "_label")
    ends = far.join(named_.withColumnRenamed("_n", "a").withColumnRenamed("_label", "_a"), "a", "left").join(named_.withColumnRenamed("_n", "b").withColumnRenamed("_label", "_b"), "b", "left")
    roots = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))).select(F.col("node").alias("_label"), F.col("root").alias("_root"))
    found = sets.select("_set", "_first").join(labels, "_set", "left").select("_set", "_first", F.coalesce("_label", "_set").alias("_label"))
    found = found.join(roots, "_label", "left").select("_set", "_first", F.coalesce("_root", "_label").alias("_root"))
    least = found.groupBy("_root").agg(F.min("_first").alias("_least"))
    found = found.join(least, "_root").select("_set", F.col("_least.key").alias("_component"))
    out = signed.select("_key", "_set", "_size").join(found, "_set", "left")
    component = F.when(F.col("_size") == 0, F.col("_key")).otherwise(F.col("_component"))
    return out.select(F.col("_key").alias(key), F.col("_size").alias("n_shingles"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"))


#: All pairs of texts that share a shingle: for small tables only.
NEAR_SQL = r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    t AS (SELECT min(doc_id) AS text_id, ws FROM w WHERE len(ws) > 0 GROUP BY ws),
    s AS (SELECT text_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) ELSE [array_to_string(ws, ' ')] END) AS g FROM t),
    n AS (SELECT text_id, count(*) AS n FROM s GROUP BY text_id),
    p AS (SELECT a.text_id AS x, b.text_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.text_id < b.text_id GROUP BY ALL),
    l AS (SELECT p.x, p.y FROM p JOIN n a ON a.text_id = p.x JOIN n b ON b.text_id = p.y WHERE 100 * c >= 85 * (a.n + b.n - c)),
    e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
    r AS (SELECT text_id, text_id AS root FROM t UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.text_id),
    c AS (SELECT text_id, min(root) AS root FROM r GROUP BY text_id)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.root, w.doc_id) AS component_id, w.doc_id = coalesce(c.root, w.doc_id) AS kept
    FROM w LEFT JOIN t USING (ws) LEFT JOIN n USING (text_id) LEFT JOIN c USING (text_id)"""
