"""Packing token sequences into fixed lengths: large-item matching, then best fit of small items."""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, running, slices, spread, utf8, written

PIECES = "piece int, start long, length long, ids_crc32 long"
#: Bytes of text that are tokenised at once; words that a worker remembers before it starts afresh, and the longest of them in
#: characters, so that its memory stays below about 16 MB.
WORK_BYTES, WORDS, REMEMBERED = 512 << 10, 30_000, 100
#: Letters and digits (fixed values) of the characters in PLAIN, as the vocabulary's pattern splits them.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
#: A character outside this set, or an apostrophe, sends its whole text to the tokenizer itself.
NOT_PLAIN = re.compile("[^\t\n\r -&(-~¡-ſ]")


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """0 white space, 1 letter, 2 digit, 3 other: by byte for ASCII, by code point - 128 below U+0180."""
    kind = [0 if c in " \t\n\r" else 1 if re.match(f"[{LETTERS}]", c) else 2 if re.match(f"[{DIGITS}]", c) else 3 for c in map(chr, range(0x180))]
    return np.array(kind[:128] + [3] * 128, np.uint8), np.array(kind[128:], np.uint8)


class Encoder:
    """Token ids of whole texts by a byte-level BPE vocabulary of the tokenizers library.

    Such vocabularies split a text at fixed places into words and encode each word by itself, so words
    are found in one pass over the bytes and each different word is encoded once. Special tokens'
    strings are ordinary text.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {x["content"] for x in vocabulary.get("added_tokens", ())}
        # byte-level vocabularies write each byte as a printable character: those that are printable as themselves, the others from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(byte[c] for c in token): rank for token, rank in vocabulary["model"]["vocab"].items() if token not in special}
        self.words = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.ascii, self.latin = _classes()
        self.known: dict[str, array] = {}

    @cached_property
    def tokenizer(self):
        """The library's own tokenizer, loaded for the texts that need it."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(self.path)
        own.encode_special_tokens = True
        return own

    def _word(self, word: str) -> array:
        ids = self.known.get(word)
        if ids is None:
            ids = array("I", self.words._encode_single_piece(word) if len(word) < 500 else self.tokenizer.encode(word, add_special_tokens=False).ids)
            if len(word) <= REMEMBERED:
                if len(self.known) >= WORDS:
                    self.known.clear()
                self.known[word] = ids
        return ids

    def _starts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte positions at which the pattern's words start, for texts of plain characters."""
        kind = self.ascii[raw]
        lead = np.flatnonzero((raw >= 0xC2) & (raw <= 0xC5))
        two = self.latin[((raw[lead] & 31).astype(np.int32) << 6 | (raw[lead + 1] & 63)) - 128]
        kind[lead], kind[lead + 1] = two, two
        new = np.ones(len(raw) + 1, bool)  # a text or a run of one class starts here
        new[1:-1] = kind[1:] != kind[:-1]
        edge = offsets[:-1][np.diff(offsets) > 0]
        new[edge] = True
        last = np.zeros(len(raw) + 1, bool)  # the last white space before other characters of the same text
        last[:-2] = (kind[:-1] == 0) & (kind[1:] != 0)
        last[edge[edge > 0] - 1] = False
        after_space = np.zeros(len(raw) + 1, bool)
        after_space[1:-1] = last[:-2] & (raw[:-1] == 32)
        return np.flatnonzero((new[:-1] & ~after_space[:-1]) | last[:-1])

    def _plain(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self._starts(raw, offsets)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = pc.dictionary_encode(words)
        each = [self._word(w) for w in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.frombuffer(b"".join(each), np.uint32)
        begin = np.cumsum(size) - size
        code = coded.indices.to_numpy()
        sizes = size[code]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(begin[code] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        return ids, np.append(0, ends)[np.searchsorted(starts, offsets)]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in order."""
        raw, offsets = utf8(texts)
        for a, b in slices(offsets, WORK_BYTES):
            part = raw[offsets[a] : offsets[b]]
            at = offsets[a : b + 1] - offsets[a]
            if NOT_PLAIN.search(str(part.tobytes(), "utf-8")):
                # only the texts that need it leave the common path
                own = [str(part[at[i] : at[i + 1]].tobytes(), "utf-8") for i in range(b - a)]
                odd = [bool(NOT_PLAIN.search(t)) for t in own]
                plain = pa.array(["" if o else t for t, o in zip(own, odd, strict=True)], pa.large_string())
                ids, ends = self._plain(*utf8(plain))
                for i, (t, o) in enumerate(zip(own, odd, strict=True)):
                    yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) if o else ids[ends[i] : ends[i + 1]]
            else:
                ids, ends = self._plain(part, at)
                for i in range(b - a):
                    yield ids[ends[i] : ends[i + 1]]


def token_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids).

    A document is its ids and end_id. Longer ones than capacity are cut into pieces of capacity tokens;
    the first piece takes what is left over, so it may be shorter.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            row, rows = [], []
            for n, ids in enumerate(encoder.encode(batch.column(1))):
                whole = np.append(ids, np.uint32(end_id)).astype("<u4")
                cut, at = len(whole) % capacity or capacity, 0
                for k in range(-(-len(whole) // capacity)):
                    row.append(n)
                    rows.append((k, at, cut - at, zlib.crc32(whole[at:cut].tobytes())))
                    at, cut = cut, cut + capacity
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=[key, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(lean(pieces), f"`{key}` {rows.schema[key].dataType.simpleString()}, {PIECES}")


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Which pieces go where, from the number of pieces of each length: rows (length, first rank, end
    rank, sequence of the first rank, offset); the n-th piece of a length goes n - first sequences on.

    Lengths above a third of the capacity fit at most twice: from the longest down, each is matched with
    the longest partner that fits. Then shorter ones, from the longest down, go to the least gap that
    holds them. Work and result depend on the number of different lengths, at most capacity, not on
    the number of pieces.
    """
    left, used, plan, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, number) with it
    sizes: list[int] = []

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + n, sequence, offset))
        used[length] += n
        left[length] -= n

    def free(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    large = sorted(x for x in counts if 3 * x > capacity)
    for a in reversed(large):
        while left[a]:
            fit = bisect.bisect_right(large, min(a, capacity - a)) - 1
            while fit >= 0 and not (left[large[fit]] > (large[fit] == a)):
                fit -= 1
            if fit < 0:
                n, gap = left[a], capacity - a
                put(a, n, sequences, 0)
            else:
                b = large[fit]
                n, gap = (left[a] // 2 if a == b else min(left[a], left[b])), capacity - a - b
                put(a, n, sequences, 0)
                put(b, n, sequences, a)
            free(gap, sequences, n)
            sequences += n
    for s in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[s]:
            at = bisect.bisect_left(sizes, s)
            if at == len(sizes):
                n = -(-left[s] // (capacity // s))
                free(capacity, sequences, n)
                sequences += n
                continue
            gap = sizes[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], sizes[at]
            n, rest = min(n, left[s]), n
            put(s, n, first, capacity - gap)
            free(gap - s, first, n)
            free(gap, first + n, rest - n)
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: every piece has a place in a sequence of at most capacity tokens.

    Only the counts by length (at most capacity rows) reach the driver, and the plan made from them is
    broadcast; ranks within a length come from two-level running counts, so that a length may hold any
    share of the rows. pieces is read twice: pass a written table.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if counts and (min(counts) < 1 or max(counts) > capacity):
        raise ValueError(f"lengths are to be from 1 to {capacity}")
    plan = spark.createDataFrame(packing_plan(counts, capacity), f"`{length}` long, _lo long, _hi long, _sequence long, _offset long")
    ranked = pieces.withColumn("_hash", F.xxhash64(*order)).withColumn("_bucket", spread(F.col("_hash"), 10)).withColumn("_each", F.lit(1))
    ranked = running(ranked, [length], "_bucket", ["_hash", *order], "_each", "_rank").withColumnRenamed(length, "_length")
    placed = ranked.join(F.broadcast(plan), (F.col("_length") == F.col(length)) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return placed.select(*pieces.columns, (F.col("_sequence") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), F.col("_offset").alias("offset"))


def packed_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 2048) -> DataFrame:
    """token_pieces of docs, packed. Null text: empty, one piece of the end id alone. Null key: kept.
    Repeated rows are documents of their own. Empty input: empty result. Other columns are not read."""
    pieces = token_pieces(docs, vocabulary, key, text, capacity)
    return pack(written(pieces), capacity, order=(key, "piece", "ids_crc32"))
