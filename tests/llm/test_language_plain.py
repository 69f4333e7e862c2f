"""Language predictions against a plain re-implementation, character by character."""

import math

import pytest

from inkwell.llm.language_id import DIMS, LanguageModel, fit, fold, identify


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def counts(text):
    """Hashed grams of two and three characters that begin with a letter and hold no two other characters in a row."""
    low, out = text.lower(), {}
    for n in (2, 3):
        for k in range(len(low) - n + 1):
            gram = low[k : k + n]
            if gram[0].isalpha() and all(a.isalpha() or b.isalpha() for a, b in zip(gram, gram[1:])):
                key = n
                for c in gram:
                    key = (key * 0x110003 + (ord(c) if c.isalpha() else 32)) % 2**64
                slot = mixed(key) % DIMS
                out[slot] = out.get(slot, 0) + 1
    return out


def predicted(model: LanguageModel, text):
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    x = {k: math.log1p(n) * float(model.weight[k]) for k, n in counts(text).items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    near = [sum(v * float(centre[k]) for k, v in x.items()) / norm for centre in model.centres]
    best = max(range(len(near)), key=near.__getitem__)
    return model.languages[model.of[best]], min(max(near[best], 0.0), 1.0)


def test_predictions_equal_plain_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold() != 1))
    odd = spark.createDataFrame([(-1, None, None), (-2, "", None), (-3, "12 34 !", None), (-4, "İstanbul ßẞ ǅ é", None), (-5, "a", None), (-6, "x " * 30000, None)], docs.schema)
    rows = docs.unionByName(odd)
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(rows, model).collect()}
    assert len(got) == len(texts) > 200
    for k, text in texts.items():
        name, score = predicted(model, text)
        assert got[k][1] == pytest.approx(score, abs=2e-5), k
        assert got[k][0] == name or abs(score) < 1e-9, k
