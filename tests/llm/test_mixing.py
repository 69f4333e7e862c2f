from collections import Counter

import pytest

from inkwell.llm.mixing import mix_sources, mix_summary, mixed_documents


def wanted(sizes, weights=(5, 2, 1), most=3):
    """Water filling by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = {s: w[s] for s in names if s not in capped}
        share = (total - sum(capped.values())) / sum(rest.values()) if rest else 0
        over = [s for s in rest if share * w[s] > most * sizes[s]]
        if not over:
            return capped | {s: share * w[s] for s in rest}
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("hot", [False, True])
def test_targets_are_met(spark, hot):
    rows = [(k, "w " * (k % 37), f"s{k % 5}" if not hot or k % 3 else "s0") for k in range(600)] + [(1000, "one two three", None), (1001, None, None), (1002, "", "s9"), (1003, "x y", ""), (None, "a b c", "s1"), (5, "w " * 5, "s0"), (5, "w " * 5, "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, of = Counter(), {}
    for k, t, s in rows:
        sizes[s] += len((t or "").split())
        of.setdefault(k, []).append(s)
    goal = wanted(sizes)
    got = mix_summary(mix_sources(docs)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = of[r.doc_id][0]
        assert r.source_size == sizes[s] and abs(r.target - goal[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(goal[s] - 1 <= taken[s] <= goal[s] + 1e-6 for s in sizes)
    again = mix_summary(mix_sources(docs.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_budget_and_order(spark):
    docs = spark.createDataFrame([(k, "w " * 10, f"s{k % 2}") for k in range(100)], "doc_id long, text string, source string")
    rows = [r for r in mix_sources(docs, budget_share=0.5).collect() if r.taken]
    rows.sort(key=lambda r: r.mix_start)
    assert sum(r.taken for r in rows) in (499, 500)
    assert all(a.finish <= b.finish and a.mix_start + a.taken <= b.mix_start for a, b in zip(rows, rows[1:]))


def test_documents_of_the_mix(spark):
    docs = spark.createDataFrame([(k, "w  " * (k + 1), f"s{k % 2}", "en", 3 * k + 3, "x") for k in range(50)], "doc_id long, text string, source string, lang string, n_chars long, taken string")
    got = mixed_documents(docs)
    assert got.columns == docs.columns
    words = sum(len(r.text.split()) for r in got.collect())
    assert abs(words - sum(range(1, 51))) <= 2


def test_clashing_names(spark):
    names = ["_hash", "_null", "_src", "_size", "_bucket", "_one", "_key", "c0", "size"]
    docs = spark.createDataFrame([(k, "w " * 10, f"s{k % 2}", *range(9)) for k in range(20)], "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    got = mix_sources(docs).filter("copy = 1").collect()
    assert len(got) == 20 and all([r[n] for n in names[:-1]] == list(range(8)) and r["size"] == 10 for r in got)
    rows = mixed_documents(docs).collect()
    assert [list(r)[3:] for r in rows] == [list(range(9))] * len(rows)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
