"""Removal of long repeated byte strings with run-compressed Burrows-Wheeler indexes.

The corpus is cut so that equal strings meet: each string of `long` bytes is named by its anchor, the span of
ANCHOR bytes in it with the least hash, and consecutive strings with one anchor form a run. Anchors found
at one place only are dropped; of the others, the distinct run texts of an anchor come to one task, which
indexes them (run-compressed transform, sampled run ends) and streams their matching statistics. Equal
run texts are counted before that, so copies cost nothing. An anchor with very many distinct run texts is
split by a longer anchor, the WIDE bytes that all strings at about the same distance from it share, and the
parts are indexed in the same way; what is still too large for one index is counted string by string in Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chosen_path import _grouped
from .grams import prefix, spans
from .shared import lean, mixed, shared_dir, slices, utf8, written

ANCHOR = 50
#: Distinct run texts of an anchor in one index at most; bytes that share an index; bytes hashed at once (longer texts in blocks).
GROUP, INDEX_BYTES, WORK_BYTES = 4096, 512 << 10, (1 << 20) - 8
#: Distances of strings from their anchor that share a longer anchor.
STEP = 16
#: The two hashes that name a text together.
TID = ["_tid", "_tid2"]
#: Bits of an anchor's hash that decide between anchors; the others hold a position.
ORDER_BITS = 34
NONE = np.zeros(0, np.int64)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values: suffix and prefix minima of blocks of that width."""
    n = len(values)
    block = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    block[:n] = values
    block = block.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_runs(raw: np.ndarray, offsets: np.ndarray, long: int) -> tuple[np.ndarray, ...]:
    """Of all runs: text number, first and last string's start and the anchor's (in its text), hash of the anchor and of the run."""
    n = len(raw)
    if n < long:
        return (NONE, NONE, NONE, NONE, NONE.astype(np.uint64), NONE.astype(np.uint64))
    sums = prefix(raw)
    at = np.arange(n - ANCHOR + 1)
    hashes = spans(sums, at, at + ANCHOR)
    place = np.uint64(64 - ORDER_BITS)
    least = sliding_least((hashes >> place << place) | at.astype(np.uint64), long - ANCHOR + 1)
    anchor = (least & np.uint64((1 << (64 - ORDER_BITS)) - 1)).astype(np.int64)
    size = np.maximum(np.diff(offsets) - long + 1, 0)
    row = np.repeat(np.arange(len(size)), size)
    start = np.repeat(offsets[:-1] - (np.cumsum(size) - size), size) + np.arange(len(row))
    if not len(row):
        return (NONE, NONE, NONE, NONE, NONE.astype(np.uint64), NONE.astype(np.uint64))
    anchor = anchor[start]
    new = np.ones(len(row), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    row, a, b, p = row[first], start[first], start[last], anchor[first]
    with np.errstate(over="ignore"):
        text = mixed(spans(sums, a, b + long) + mixed((p - a).astype(np.uint64) << np.uint64(32) | (b - a).astype(np.uint64)))
    base = offsets[:-1][row]
    return row, a - base, b - base, p - base, hashes[p], text


def runs(docs: DataFrame, long: int) -> DataFrame:
    """_tid, _tid2, _anchor, _run, _a, _b, _p of all texts (columns _tid, _tid2, _text): see anchored_runs. A long text is cut
    into blocks of starts, which also ends runs there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            for x, y in slices(offsets, WORK_BYTES):
                size = int(offsets[y] - offsets[x])
                for begin in range(0, max(1, size - long + 1) if y == x + 1 else 1, WORK_BYTES):
                    end = min(size, begin + WORK_BYTES + long - 1) if y == x + 1 else size
                    at = np.array([0, end - begin]) if y == x + 1 else offsets[x : y + 1] - offsets[x]
                    row, a, b, p, anchor, run = anchored_runs(raw[offsets[x] + begin : offsets[x] + end], at, long)
                    names = [batch.column(k).take(pa.array(row + x)) for k in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*names, pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), *(pa.array((v + begin).astype(np.int32)) for v in (a, b, p))], names=[*TID, "_anchor", "_run", "_a", "_b", "_p"])

    return docs.select(*TID, "_text").mapInArrow(lean(cut), "_tid long, _tid2 long, _anchor long, _run long, _a int, _b int, _p int")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order, by prefix doubling from 8 bytes on."""
    n = len(text)
    padded = np.append(text, np.zeros(8, np.uint8))
    rank = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64)
    order = np.argsort(rank, kind="stable")
    h = 8
    while True:
        sorted_ = rank[order]
        step = np.zeros(n, np.int64)
        step[1:] = sorted_[1:] != sorted_[:-1]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(step)
        if step.sum() == n - 1 or h >= n:
            return order
        rank = dense * (n + 1)
        rank[: n - h] += dense[h:] + 1
        order = np.argsort(rank, kind="stable")
        h *= 2


def common_prefixes(text: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, pair by pair; 8 bytes a step."""
    n = len(text)
    padded = np.append(text, np.arange(16, dtype=np.uint8))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + 9].copy().view("<u8").ravel()
    out = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        differ = eight[x[live] + out[live]] ^ eight[y[live] + out[live]]
        same = differ == 0
        ended = live[~same]
        low = differ[~same]
        out[ended] += (np.log2((low & (~low + np.uint64(1))).astype(np.float64)) // 8).astype(np.int64)
        live = live[same]
        out[live] += 8
        room = n - np.maximum(x[live], y[live])
        over = out[live] >= room
        out[live[over]] = room[over]
        live = live[~over]
    return np.minimum(out, n - np.maximum(x, y)) if len(x) else out


class RunIndex:
    """A run-compressed Burrows-Wheeler transform with suffix positions sampled at the ends of its runs.

    Only the runs are kept: heads, and for both ends of each run the suffix there and how far it agrees
    with its neighbour beyond the run. Between samples, that agreement falls by one a byte, which gives the
    matching statistics of the indexed text against all its other places.
    """

    def __init__(self, text: np.ndarray):
        self.size = len(text)
        order = suffix_array(text)
        transform = np.where(order == 0, -1, text[order - 1].astype(np.int16))  # before the text stands an end mark
        heads = np.append(0, np.flatnonzero(transform[1:] != transform[:-1]) + 1)
        self.heads = transform[heads]
        tails = np.append(heads[1:], self.size) - 1
        self.up = self._samples(text, order[heads], order[heads - 1], heads > 0)
        self.down = self._samples(text, order[tails], order[(tails + 1) % self.size], tails < self.size - 1)

    @staticmethod
    def _samples(text: np.ndarray, own: np.ndarray, other: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        agree = np.zeros(len(own), np.int64)
        agree[real] = common_prefixes(text, own[real], other[real])
        by = np.argsort(own)
        return own[by], agree[by]

    def matching_statistics(self, at: np.ndarray) -> np.ndarray:
        """For each position, the length of the longest prefix of its suffix that also starts elsewhere."""
        best = np.zeros(len(at), np.int64)
        for place, agree in (self.up, self.down):
            k = np.searchsorted(place, at, side="right") - 1
            got = agree[k] - (at - place[k])
            best = np.maximum(best, np.where(k >= 0, got, 0))
        return best


def _covers(starts: np.ndarray, long: int) -> list[int]:
    """Sorted starts of strings -> the bytes they cover, as flat list of begins and ends."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > long)
    return np.column_stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + long]).ravel().tolist()


def repeats_in(texts: list[bytes], before: list[int], long: int) -> list[list[int]]:
    """For each text, the bytes (counted from before) covered by strings of long bytes that start elsewhere, too."""
    size = np.array([len(t) for t in texts])
    index = RunIndex(np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8))
    begin = np.append(0, np.cumsum(size + 1))
    strings = np.maximum(size - long + 1, 0)
    at = np.repeat(begin[:-1] - (np.cumsum(strings) - strings), strings) + np.arange(int(strings.sum()))
    found = at[index.matching_statistics(at) >= long]
    cut = np.searchsorted(found, begin)
    return [_covers(found[cut[i] : cut[i + 1]] - begin[i] - before[i], long) for i in range(len(texts))]


FOUND = "_anchor long, _run long, _cover array<int>"


def _found(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["_anchor", "_run", "_cover"])


def indexed(contexts: DataFrame, long: int) -> DataFrame:
    """Repeated parts of the run texts (_anchor, _run, _before, _bytes) of anchors with few of them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            once = list({(h[0], h[1]): h for h in held}.values())
            if len(once) > 1:
                rows = [(h[0], h[1], c) for h, c in zip(once, repeats_in([h[3] for h in once], [h[2] for h in once], long), strict=True) if c]
                if rows:
                    yield _found(rows)

        for group in _grouped(batches, ["_anchor"]):
            columns = [group.column(c).to_pylist() for c in ("_anchor", "_run", "_before", "_bytes")]
            size = sum(map(len, columns[3]))
            if held and total + size > INDEX_BYTES:
                yield from flush()
                held, total = [], 0
            held += zip(*columns, strict=True)
            total += size
        yield from flush()

    return contexts.select("_anchor", "_run", "_before", "_bytes").repartition("_anchor").sortWithinPartitions("_anchor").mapInArrow(lean(search), FOUND)


def split(contexts: DataFrame, long: int) -> DataFrame:
    """Parts of run texts (_anchor, _run, _before, _bytes) by a longer anchor: _anchor, _run, _wide, _part, _before, _bytes.

    The strings of a run text whose distance from the anchor lies in the same STEP share long - STEP + 1 bytes around it; _wide
    names these bytes, _part the text of the part. Equal strings have equal distances, so they stay together.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            out = []
            for anchor, run, before, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                sums = prefix(np.frombuffer(data, np.uint8))
                k = np.arange(max(0, before - len(data) + long) // STEP, before // STEP + 1)
                low, high = np.maximum(before - STEP * k - STEP + 1, 0), np.minimum(before - STEP * k, len(data) - long)
                use = low <= high
                k, low, high = k[use], low[use], high[use]
                begin = before - STEP * k
                with np.errstate(over="ignore"):
                    wide = mixed(spans(sums, begin, begin + long - STEP + 1) + mixed(np.uint64(anchor & (1 << 64) - 1) + mixed(k.astype(np.uint64))))
                    part = mixed(spans(sums, low, high + long) + mixed((begin - low).astype(np.uint64) << np.uint64(32) | (high - low).astype(np.uint64)))
                out += [(anchor, run, w, r, before - int(a), data[a : b + long]) for w, r, a, b in zip(wide.view(np.int64).tolist(), part.view(np.int64).tolist(), low.tolist(), high.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["_anchor", "_run", "_wide", "_part", "_before", "_bytes"])

    return contexts.select("_anchor", "_run", "_before", "_bytes").mapInArrow(lean(cut), "_anchor long, _run long, _wide long, _part long, _before int, _bytes binary")


def counted_strings(contexts: DataFrame, long: int) -> DataFrame:
    """Repeated parts of run texts (_anchor, _run, _before, _bytes), each string counted in Spark under two hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, run, before, data in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = np.frombuffer(data, np.uint8)
                at = np.arange(len(raw) - long + 1)
                names = [spans(prefix(v), at, at + long).view(np.int64) for v in (raw, raw ^ 0xFF)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v)) for v in (anchor, run)] + [pa.array((at - before).astype(np.int32)), *(pa.array(n) for n in names)], names=["_anchor", "_run", "_at", "_x", "_y"])

    strings = written(contexts.select("_anchor", "_run", "_before", "_bytes").mapInArrow(lean(cut), "_anchor long, _run long, _at int, _x long, _y long"))
    name = ["_anchor", "_x", "_y"]
    many = strings.groupBy(*name).agg(F.min(F.struct("_run", "_at")).alias("_i"), F.max(F.struct("_run", "_at")).alias("_j")).filter("_i <> _j").select(*name)
    found = strings.join(many, name).groupBy("_anchor", "_run").agg(F.sort_array(F.collect_list("_at")).alias("_at"))
    return found.select("_anchor", "_run", F.flatten(F.transform("_at", lambda s: F.array(s, s + long))).alias("_cover"))


def divided(contexts: DataFrame, long: int, path: str) -> DataFrame:
    """The same as indexed() for anchors with very many run texts, which are split by longer anchors first."""
    parts = written(split(contexts, long), f"{path}/split")
    ends = [f(F.struct("_anchor", "_run")).alias(n) for f, n in ((F.min, "_i"), (F.max, "_j"))]
    kinds = parts.groupBy("_wide", "_part").agg(*ends, F.first("_before").alias("_before"), F.first("_bytes").alias("_bytes"))
    kinds = written(kinds.withColumn("_whole", F.col("_i") != F.col("_j")).drop("_i", "_j"), f"{path}/split-kinds")
    number = kinds.groupBy("_wide").agg(F.count(F.lit(1)).alias("_n"), F.min("_whole").alias("_all")).filter("_n > 1 and not _all").select("_wide", "_n")
    around = written(kinds.join(number, "_wide").select(F.col("_wide").alias("_anchor"), F.col("_part").alias("_run"), "_before", "_bytes", "_n"), f"{path}/split-contexts")
    found = indexed(around.filter(F.col("_n") <= GROUP), long).unionByName(counted_strings(around.filter(F.col("_n") > GROUP), long))
    found = found.select(F.col("_anchor").alias("_wide"), F.col("_run").alias("_part"), "_cover")
    all_of = F.array(-F.col("_before"), F.octet_length("_bytes") - F.col("_before"))
    marked = kinds.join(found, ["_wide", "_part"], "left").select("_wide", "_part", F.when(F.col("_whole"), all_of).otherwise(F.col("_cover")).alias("_cover")).filter("_cover is not null")
    marked = written(marked, f"{path}/split-marks")
    return parts.select("_anchor", "_run", "_wide", "_part").join(marked, ["_wide", "_part"]).groupBy("_anchor", "_run").agg(F.flatten(F.collect_list("_cover")).alias("_cover"))


def text_names(text: str) -> list[Column]:
    """TID of a text (null counts as empty): 128 bits."""
    own = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(own).alias(TID[0]), F.xxhash64(F.lit(1), own, F.octet_length(own)).alias(TID[1])]


def repeated_spans(docs: DataFrame, text: str = "text", long: int = 200, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables by TID, the hashes of a text: texts (TID, _text of each text with repeated anchors, once) and
    marks (TID, _marks: begins and ends of byte spans to remove, flat, unsorted, overlapping)."""
    path = path or shared_dir(docs.sparkSession)
    base = docs.select(*text_names(text), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = runs(base, long)
    where = F.xxhash64(*TID, "_p")
    twice = found.select("_anchor", where.alias("_w")).groupBy("_anchor").agg(F.min("_w").alias("_x"), F.max("_w").alias("_y")).filter("_x <> _y").select("_anchor")
    twice = written(twice, f"{path}/anchors")
    kept = written(found.join(twice, "_anchor", "left_semi").dropDuplicates([*TID, "_p", "_a"]), f"{path}/runs")
    place = F.struct(*TID, "_p", "_a", "_b")
    kinds = kept.groupBy("_anchor", "_run").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    kinds = written(kinds.select("_anchor", "_run", "_first", (F.col("_first") != F.col("_last")).alias("_whole")), f"{path}/kinds")
    number = kinds.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"), F.min("_whole").alias("_all")).filter("_n > 1 and not _all")
    need = kinds.join(number.select("_anchor", "_n"), "_anchor").select("_anchor", "_run", "_n", "_first.*")
    need = need.groupBy(*TID).agg(F.collect_list(F.struct("_anchor", "_run", "_n", F.col("_p").alias("p"), F.col("_a").alias("a"), F.col("_b").alias("b"))).alias("_need"))
    tids = kept.select(*TID).distinct().join(need, TID, "left")
    texts = written(base.join(tids, TID).dropDuplicates(TID), f"{path}/texts")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, need in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = data.encode()
                out += [(x["_anchor"], x["_run"], x["_n"], x["p"] - x["a"], data[x["a"] : x["b"] + long]) for x in need]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["_anchor", "_run", "_n", "_before", "_bytes"])

    around = written(texts.filter("_need is not null").select("_text", "_need").mapInArrow(lean(contexts), "_anchor long, _run long, _n long, _before int, _bytes binary"), f"{path}/contexts")
    part = indexed(around.filter(F.col("_n") <= GROUP), long).unionByName(divided(around.filter(F.col("_n") > GROUP), long, path))
    part = written(part.groupBy("_anchor", "_run").agg(F.flatten(F.collect_list("_cover")).alias("_cover")), f"{path}/parts")
    state = kinds.select("_anchor", "_run", "_whole").join(part, ["_anchor", "_run"], "left").filter("_whole or _cover is not null")
    state = written(state, f"{path}/state")  # so that both sides of the next join are dealt anew, and a hot run can be split
    spans_ = F.when(F.col("_whole"), F.array("_a", F.col("_b") + long)).otherwise(F.transform("_cover", lambda c: c + F.col("_p")))
    marks = kept.join(state, ["_anchor", "_run"]).groupBy(*TID).agg(F.flatten(F.collect_list(spans_)).alias("_marks"))
    return texts.select(*TID, "_text"), marks


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", long: int = 200, with_text: bool = False) -> DataFrame:
    """One row per row of docs: key, n_bytes, n_removed, n_spans, kept_sha256 (and, if asked, kept_text as binary).

    Of each text's UTF-8 bytes, those go that are covered by a string of long bytes which also starts anywhere
    else in the corpus, the same text included. Null text counts as empty, keys may be null or repeat, equal
    rows are copies of each other; copies of a text of long bytes or more lose all their bytes. Texts are
    told apart by two 64-bit hashes and run texts by those of anchor and run. Texts may have up to 2**31 - 1 bytes, the most
    that a cell of Spark holds. Empty input: empty result. Other columns are not read.
    """
    path = shared_dir(docs.sparkSession)
    texts, marks = repeated_spans(docs, text, long, path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, flat in zip(*(batch.column(k).to_pylist() for k in (2, 3)), strict=True):
                data = data.encode()
                edges = np.zeros(len(data) + 1, np.int32)
                np.add.at(edges, flat[0::2], 1)
                np.add.at(edges, flat[1::2], -1)
                gone = np.cumsum(edges[:-1]) > 0
                rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((int(gone.sum()), spans, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=[*TID, "_removed", "_spans", "_sha", "_rest"])

    done = texts.join(marks, TID).select(*TID, "_text", "_marks").mapInArrow(lean(cut), "_tid long, _tid2 long, _removed long, _spans long, _sha string, _rest binary")
    own = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), *text_names(text), F.octet_length(own).cast("long").alias("n_bytes"), F.sha2(own, 256).alias("_own"), *([own.cast("binary").alias("_all")] if with_text else []))
    copies = docs.groupBy(*text_names(text)).agg(F.count(F.lit(1)).alias("_copies")).filter("_copies > 1")
    got = rows.join(copies, TID, "left").join(done, TID, "left")
    all_gone = F.col("_copies").isNotNull() & (F.col("n_bytes") >= long)
    out = [
        F.col(key),
        "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_sha", "_own")).alias("kept_sha256"),
    ]
    return got.select(*out, *([F.when(all_gone, F.lit(b"")).otherwise(F.coalesce("_rest", "_all")).alias("kept_text")] if with_text else []))
