import random
import re
from collections import Counter

import numpy as np
import pytest

import inkwell.llm.stripes as S
from inkwell.llm.stripes import shares, source_divergence, terms

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def found(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least, smooth=5, top=50):
    rows = [(lang or "", source or "", found(text)) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= least)
        counts = {s: Counter() for s in {r[1] for r in own}}
        for _, s, ts in own:
            counts[s].update(t for t in ts if df[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + smooth) // (sum(c.values()) + smooth * len(kept)) for t in kept}
        whole = share(sum(counts.values(), Counter()))
        p = {s: share(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            best = [(p[s][t] - whole[t], t) for t in kept if counts[s][t] and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", best, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (v, x) in enumerate(items[:most])]
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "straße", "Ünder", "ünder", "x1y", "don't", "naïve", "日本", "z"] + [f"w{c}" for c in "abcdefghij"]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot"] * 4 + ["a", "b", None, "ä"])
        rows.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))))
    return rows + [("xx", "only", "one two"), ("yy", "s", None), ("yy", "t", "rare words here"), ("en", "hot", "Alpha " * 5000), ("en", "silent", "12 34"), ("en", None, "")] + rows[:20]


SCHEMA = "lang string, source string, text string, term string, counts int"


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("least, top", [(30, 50), (3, 4)])
def test_equals_brute_force(spark, least, top):
    rows = corpus(least)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    assert rows_of(source_divergence(docs, least_docs=least, top=top)) == brute(rows, least, top=top)


def test_spills_and_blocks(spark, monkeypatch):
    """Tables of a few entries, blocks of two sources, tiny tiles: the same result, through many partial stripes."""
    rows = corpus(9, 120)
    docs = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).repartition(3)
    for name, value in (("BLOCK", 2), ("CHUNK", 3)):
        monkeypatch.setattr(S, name, value)
    held = S._Held()
    assert not held.full()
    want = brute(rows, 5)

    def small(docs, lang, source, text, fold=S.folded):
        return fold(docs.repartition(40), lang, source, text)  # forty tasks hand their stripes on

    monkeypatch.setattr(S, "folded", small)
    assert rows_of(source_divergence(docs, least_docs=5)) == want


def test_held_stripes_empty_themselves():
    held = S._Held()
    import pyarrow as pa

    for _ in range(3):
        raw = np.frombuffer(b"Aa bb aA", np.uint8)
        held.add(pa.array(["en", "en"]).dictionary_encode(), pa.array(["s", "t"]).dictionary_encode(), raw, np.array([0, 5, 8]))
    out = pa.Table.from_batches(list(held.out())).to_pylist()
    got = {(r["lang"], r["term"]): (r["df"], dict(zip(r["sources"], r["counts"]))) for r in out if r["term"]}
    assert got == {("en", "aa"): (6, {"s": 3, "t": 3}), ("en", "bb"): (3, {"s": 3})}
    assert {r["mark"]: r["df"] for r in out if not r["term"]} == {"s": 3, "t": 3} and list(held.out()) == []


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(10**rng.randrange(1, 16) * 5)
        count, v = rng.randrange(total + 1), rng.randrange(1, 50)
        assert shares(np.array([count]), total, v, 5)[0] == 1 + 10**9 * (count + 5) // (total + 5 * v)
    with pytest.raises(OverflowError):
        shares(np.array([1]), 10**16, 1, 5)


def test_terms_equal_the_pattern():
    texts = ["", "A", "aB-cD", "ÄÖ'x", "1a2", "日本 語", " ", "é" * 300]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    term, owner = terms(np.frombuffer(raw, np.uint8), offsets)
    assert [(int(o), t) for o, t in zip(owner, term.to_pylist())] == [(k, t) for k, text in enumerate(texts) for t in found(text)]


def test_empty(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
