import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from inkwell.llm.packing import Encoder, packed_documents, packing_plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a", "don't we'll 'tis", "a  b\n\n c\t", " lead", "trail  ", "x\r\ny", "12ab3 ½²", "é à ß ſ", "日本語 text", "<|endoftext|> hi", "a\x85b\xa0c", "\x1c\x1d", "🙂🙂 ok", "A" * 3000, "!!! ??? ...", "\n", "  \n  x"]


def test_ids_are_the_tokenizers(spark, sf):
    reference = Tokenizer.from_file(PATH)
    reference.encode_special_tokens = True
    rng = random.Random(3)
    made = ["".join(rng.choice("ab1é'.\n\t  -ÿſ½") for _ in range(rng.randrange(40))) for _ in range(400)]
    own = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = [*ODD, None, *made, *own]
    for size in (64, 8 << 20):
        import inkwell.llm.packing as packing

        packing.WORK_BYTES = size
        got = list(Encoder(PATH).encode(pa.array(texts)))
        assert len(got) == len(texts)
        for t, ids in zip(texts, got):
            assert ids.tolist() == reference.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 2048])
    counts = dict(Counter(rng.randrange(1, capacity + 1) if seed % 2 else min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(3000)))
    used, bins = defaultdict(list), defaultdict(list)
    for length, a, b, sequence, offset in packing_plan(counts, capacity):
        used[length] += range(a, b)
        for k in range(b - a):
            bins[sequence + k].append((offset, length))
    assert all(sorted(used[x]) == list(range(n)) for x, n in counts.items())
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(bins) == list(range(len(bins)))
    total = sum(x * n for x, n in counts.items())
    half = sum(n for x, n in counts.items() if 2 * x > capacity)
    assert len(bins) <= 1.06 * max(-(-total // capacity), half) + 1


def test_documents(spark):
    long = "word " * 5000
    rows = [(1, "a b", "q"), (2, None, "q"), (3, "", "q"), (4, long, "q"), (None, "c", "q"), (5, "same", "q"), (5, "same", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    got = packed_documents(docs, PATH).collect()
    reference = Tokenizer.from_file(PATH)
    pieces = sorted([r for r in got if r.doc_id == 4], key=lambda r: r.piece)
    ids = np.array([*reference.encode(long, add_special_tokens=False).ids, 0], "<u4")
    assert [r.start for r in pieces] == [0, *[len(ids) % 2048 + 2048 * k for k in range(len(pieces) - 1)]]
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces) and sum(r.length for r in pieces) == len(ids)
    assert [r.length for r in got if r.doc_id in (2, 3)] == [1, 1] and sum(r.doc_id == 5 for r in got) == 2
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b[1] == a[1] + a[2] if a[0] == b[0] else b[1] == 0 for a, b in zip(spots, spots[1:]))


def test_empty(spark):
    assert packed_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
