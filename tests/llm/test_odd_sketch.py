import random

import numpy as np
import pytest

import inkwell.llm.odd_sketch as O
from inkwell.llm.grams import min_hashes
from inkwell.llm.odd_sketch import most_bits, near_duplicates, odd_sketches


def shingled(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    w = low.split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), k) if x is not None], default=None)
    return sorted(((k, len(sets[i]), least[find(i)], k == least[find(i)]) for i, (k, _) in enumerate(rows)), key=str)


def corpus(seed, groups=5, members=30, words=120, edits=3):
    """Groups of near copies, some only linked by others, documents that share a passage, and edge cases."""
    rng = random.Random(seed)
    vocabulary = [f"W{k}" if k % 3 else f"w{k}" for k in range(500)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
            if rng.random() < 0.3:
                base = own  # drifts away, so that the first and the last are not similar
    for _ in range(60):
        rows.append((n, " ".join([rng.choice(vocabulary) for _ in range(30)] + common)))
        n += 1
    rows += [(n, "A b  c"), (n + 1, "a B\tc"), (n + 2, "a b"), (n + 3, None), (n + 4, ""), (n + 5, " \n"), (n + 6, rows[0][1]), (n + 6, rows[0][1]), (None, rows[1][1]), (None, "alone here"), (n + 7, rows[2][1].upper()), (n + 8, "long " * 30000)]
    rng.shuffle(rows)
    return rows


def got(spark, rows, **how):
    docs = spark.createDataFrame([(*r, b"x", "clash") for r in rows], "doc_id long, text string, _set binary, _label string").repartition(4)
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs, **how).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert got(spark, rows) == brute(rows)


def test_small_blocks_and_parts(spark, monkeypatch):
    """Three pivots and five members a task, and bands of one sample, so that many different texts share buckets."""
    for name, value in (("PIVOTS", 3), ("MEMBERS", 5), ("ROWS", 1)):
        monkeypatch.setattr(O, name, value)
    rows = corpus(5, groups=3, members=15)
    assert got(spark, rows) == brute(rows)


def test_links_across_components(spark, monkeypatch):
    """Heads alone don't connect a chain of drifting copies; the comparison across components does."""
    rng = random.Random(3)
    base = [f"v{k}" for k in range(200)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(base)))
        base = list(base)
        for _ in range(2):
            base[rng.randrange(200)] = f"n{k}x{rng.randrange(9)}"
    want = brute(rows)
    assert got(spark, rows) == want and len({r[2] for r in want}) < 10


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 1000, dtype=np.uint64)
    off = []
    for same in (1000, 970, 919, 850, 700, 300):
        other = np.concatenate([base[:same], rng.integers(0, 1 << 62, 1000 - same, dtype=np.uint64)])
        minima = min_hashes(np.concatenate([base, other]), np.array([0, 1000, 2000]), O.SAMPLES)
        a, b = odd_sketches(minima).view(np.uint64)
        off.append(int(np.bitwise_count(a ^ b).sum()))
        assert ((off[-1] <= most_bits(85)) if same >= 919 else True) and ((off[-1] > most_bits(85)) if same <= 700 else True)
    assert off == sorted(off) and off[0] == 0


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
