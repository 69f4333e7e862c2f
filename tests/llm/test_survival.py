import itertools
import random

import numpy as np
import pytest

from inkwell.llm.survival import filter_interactions, positional_popcounts, truth_words

SCHEMA = "doc_id long, text string, source string, part string, failed int"


def fails(rows):
    """Per row, the letters of the filters that it fails."""
    out = []
    for k, t, _ in rows:
        t = t or ""
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        copies = [a for a, b, _ in rows if (b or "") == t]
        smaller = any(a is not None and (k is None or a < k) for a in copies)
        tests = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": smaller}
        out.append({x for x, bad in tests.items() if bad})
    return out


def brute(rows, labels):
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    failed, out, totals = fails(rows), [], {}
    for part in {s or "" for _, _, s in rows}:
        own = [(rows[i][0], failed[i]) for i in range(len(rows)) if (rows[i][2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = own
            for step, f in enumerate(order):
                gone = [x for x in alive if f in x[1]]
                alive = [x for x in alive if f not in x[1]]
                totals[part, f] = totals.get((part, f), 0) + len(gone)
                out.append((part, order, step + 1, len(alive), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f))
    return sorted((*r[:-1], totals[r[0], r[-1]]) for r in out)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(150):
        n = rng.choice([0, 3, 49, 50, 51, 80])
        words = [rng.choice(["aa", "Bb", "CC", "d#", "é"] if rng.random() < 0.1 else [f"w{i}" for i in range(200)]) for _ in range(n)]
        rows.append((k, rng.choice([" ", "\t", "\n"]).join(words), rng.choice(["hot", "hot", "hot", "a", None, ""])))
    rows += [(1000 + k, rows[7][1], "hot") for k in range(40)]  # copies
    rows += [rows[3], rows[3], (None, rows[5][1], "n"), (None, "only here", "n"), (None, "only here", "n"), (2000, None, "a"), (2001, "", "a"), (2002, "Long tail " * 4000, "a")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng, rows = random.Random(seed), corpus(seed)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k, _, _ in rows if k is not None and rng.random() < 0.5] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(5)
    got = filter_interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == columns
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_interactions(spark.createDataFrame([], SCHEMA), none).count() == 0
    assert filter_interactions(spark.createDataFrame([(1, "x", None, None, 0)], SCHEMA), none).count() == 600


def test_truth_words():
    words = truth_words(5)
    assert words[0] == 0xFFFFFFFF and words[31] == 1
    for failed, subset in itertools.product(range(32), range(32)):
        assert (int(words[failed]) >> subset & 1) == ((failed & subset) == 0)


@pytest.mark.parametrize("n, groups", [(0, 3), (1, 1), (2, 1), (7, 3), (1000, 1), (5000, 40)])
def test_popcounts_by_position(n, groups):
    rng = np.random.default_rng(n)
    word, group = rng.integers(0, 1 << 32, n, dtype=np.uint32), np.minimum(rng.integers(0, groups * 3, n), groups - 1)
    want = np.zeros((groups, 32), np.int64)
    np.add.at(want, group, ((word[:, None] >> np.arange(32, dtype=np.uint32)) & 1).astype(np.int64))
    assert (positional_popcounts(word, group, groups) == want).all()
