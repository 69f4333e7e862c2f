import random
from collections import Counter

import inkwell.llm.chosen_path as C
from inkwell.llm.chosen_path import chosen_path_join, one_per_class


def brute(rows, width=5, threshold=0.8):
    text = [tuple((t or "").encode().split()) for _, t in rows]
    sets = {t: frozenset(t[i : i + width] for i in range(len(t) - width + 1)) if len(t) >= width else frozenset([t] if t else []) for t in set(text)}
    names = sorted(sets)
    links, root = Counter(), {n: n for n in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = 0
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                links[a] += 1
                links[b] += 1
                pairs += 1
                root[find(a)] = find(b)
    return text, links, find, pairs


def corpus(seed, groups=6, members=40, words=90):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [rng.choice(vocabulary) for _ in range(30)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    for _ in range(80):
        rows.append((n, " ".join([rng.choice(vocabulary) for _ in range(60)] + common)))
        n += 1
    rng.shuffle(rows)
    return rows


def check(spark, rows, least):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in chosen_path_join(docs).collect()}
    text, links, find, pairs = brute(rows)
    by_class, by_text = {}, {}
    for (k, _), t in zip(rows, text):
        by_class.setdefault(find(t), []).append(k)
        by_text.setdefault(t, []).append(k)
    found = sum(got[min(ks)].n_links for ks in by_text.values()) / 2
    assert found <= pairs and found >= least * pairs, (found, pairs)
    assert all(got[k].text_id == min(ks) for ks in by_text.values() for k in ks)
    if found == pairs:
        assert all(got[k].class_id == min(ks) for ks in by_class.values() for k in ks)
    assert sum(r.kept for r in got.values()) == len({r.class_id for r in got.values()})


def test_against_all_pairs(spark):
    check(spark, corpus(1), 0.99)


def test_large_and_dense_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "SMALL", 8)
    check(spark, corpus(2, groups=3, members=60), 0.97)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "a b"), (5, "a  b"), (6, "b a"), (7, "a"), (None, "a b"), (8, "x y z u v w"), (8, "x y z u v w"), (9, "x " * 30000)]
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, class_id string")
    got = chosen_path_join(docs).collect()
    assert len(got) == len(rows)
    ids = {(r.doc_id, r.class_id) for r in got}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (6, 6), (7, 7), (8, 8), (9, 9)} == ids and all(r.n_links == 0 for r in got)
    kept = one_per_class(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8, 9]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert chosen_path_join(docs).count() == 0 and one_per_class(docs).count() == 0


def test_keys_with_separators(spark):
    """Key and text can't be cut in two ways: no document takes another one's name."""
    rows = [("a", "false|b c d e f g h"), ("a|false", "b c d e f g h"), ("a|false|b", "c d e f g h i j k")]
    docs = spark.createDataFrame(rows, "`doc.id` string, text string")
    assert sorted(tuple(r) for r in one_per_class(docs, "doc.id").collect()) == sorted(rows)
    assert chosen_path_join(docs, "doc.id").select("row_key").distinct().count() == 3
