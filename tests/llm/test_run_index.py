import hashlib
import random

import numpy as np
import pytest

import inkwell.llm.run_index as R
from inkwell.llm.run_index import RunIndex, remove_repeats, suffix_array


def longest_elsewhere(text: bytes, p: int) -> int:
    best = 0
    for q in range(len(text)):
        if q != p:
            k = 0
            while max(p, q) + k < len(text) and text[p + k] == text[q + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_index(seed):
    rng = random.Random(seed)
    text = bytes(rng.choice(b"ab") for _ in range(300)) if seed % 2 else b"abcabc" * 20 + bytes(rng.choice(b"abcd") for _ in range(100)) + b"abcabc" * 7
    raw = np.frombuffer(text, np.uint8)
    assert suffix_array(raw).tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    got = RunIndex(raw).matching_statistics(np.arange(len(text)))
    assert got.tolist() == [longest_elsewhere(text, p) for p in range(len(text))]


def brute(rows, long):
    data = [(t or "").encode() for _, t in rows]
    seen = {}
    for d in data:
        for i in range(len(d) - long + 1):
            seen[d[i : i + long]] = seen.get(d[i : i + long], 0) + 1
    out = []
    for (k, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - long + 1):
            if seen[d[i : i + long]] > 1:
                gone[i : i + long] = 1
        spans = int((np.diff(np.append(0, gone[: len(d)])) == 1).sum())
        rest = bytes(b for b, g in zip(d, gone) if not g)
        out.append((k, len(d), int(gone[: len(d)].sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefé ") for _ in range(n))
    passage, other = word(400), word(230)
    rows = []
    for k in range(60):
        parts = [word(rng.randrange(20, 500))]
        if k % 3 == 0:
            parts.insert(rng.randrange(2), passage[rng.randrange(60) : 400 - rng.randrange(60)])
        if k % 5 == 0:
            parts += [other, word(9), other]
        if k % 7 == 0:
            parts.append("ab" * 150)
        rows.append((k, "".join(parts)))
    near = list(word(1500))
    for k in range(100, 112):
        near[rng.randrange(len(near))] = "#"
        rows.append((k, "".join(near)))
    return [*rows, (200, rows[0][1]), (201, None), (202, ""), (203, "x" * 199), (204, "x" * 199), (205, "q" * 450), (None, "short"), (206, "short"), (207, rows[5][1]), (207, rows[5][1])]


@pytest.mark.parametrize("group,work", [(4096, R.WORK_BYTES), (3, R.WORK_BYTES), (1, 300)])
def test_against_brute_force(spark, monkeypatch, group, work):
    monkeypatch.setattr(R, "GROUP", group)  # 3: anchors are split; 1: strings are counted; texts are cut into blocks
    monkeypatch.setattr(R, "WORK_BYTES", work)
    rows = corpus(group)
    docs = spark.createDataFrame([(k, t, "n") for k, t in rows], "doc_id long, text string, n_bytes string")
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()], key=str)
    assert got == brute(rows, 200)


def test_texts_and_empty(spark):
    docs = spark.createDataFrame([(1, "a" * 300), (2, "b"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept_text) for r in remove_repeats(docs, with_text=True).collect()}
    assert got == {1: b"", 2: b"b", 3: b""}
    assert remove_repeats(docs.limit(0)).count() == 0
