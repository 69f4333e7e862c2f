import random
import re
import sys
from collections import Counter
from pathlib import Path

from tokenizers import Tokenizer

import corpus_pipeline
from inkwell.llm.queries import vocabulary
from inkwell.llm.shared import written

sys.path.insert(0, str(Path(__file__).parent))
from test_chosen_path import brute  # noqa: E402
from test_language_quality import FOREIGN  # noqa: E402
from test_mixing import wanted  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[1] == counts[0] and counts[2] == docs.sparkSession.read.parquet(f"{sf}/documents.parquet").selectExpr("count(distinct regexp_replace(text, '[ \\t-\\r]+', ' '))").first()[0] >= counts[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and sum(r.piece == 0 for r in packed) == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_against_brute_force(spark, sf):
    """Planted cases, stage by stage, against plain Python on each stage's own input."""
    rng = random.Random(11)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = [tuple(r) for r in docs.collect()]
    columns = docs.columns
    at = {c: k for k, c in enumerate(columns)}
    row = lambda key, text, lang="en", source="planted": tuple({"doc_id": key, "text": text, "lang": lang, "source": source, "n_chars": len(text or "")}[c] for c in columns)
    clean = [r[at["text"]] for r in own if r[at["lang"]] == "en" and r[at["text"]] and len(r[at["text"]].split()) > 60][:6]
    foreign = [row(10_000 + k, t, None) for k, t in enumerate(FOREIGN)] + [row(10_100, None), row(10_101, "12 34 !!")]
    copies = [row(10_200 + k, clean[0].replace(" ", "  ") if k % 2 else clean[0]) for k in range(30)]
    near = []
    for k in range(20):
        words = clean[1 + k % 3].split()
        words[rng.randrange(len(words))] = f"new{k}"
        near.append(row(10_300 + k, " ".join(words)))
    start = written(spark.createDataFrame(own + foreign + copies + near, docs.schema).repartition(5))

    kept = written(corpus_pipeline.language_id(spark, start, sf))
    assert {r.doc_id for r in start.collect()} - {r.doc_id for r in kept.collect()} == {r[at["doc_id"]] for r in foreign}

    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in kept.collect():
        first[normal(r.text)] = min(r.doc_id, first.get(normal(r.text), r.doc_id))
    once = written(corpus_pipeline.exact_dedup(spark, kept, sf))
    assert sorted(r.doc_id for r in once.collect()) == sorted(first.values())

    rows = [(r.doc_id, r.text) for r in once.collect()]
    text, _, find, _ = brute(rows)
    classes = {}
    for (k, _), t in zip(rows, text):
        classes.setdefault(find(t), []).append(k)
    single = written(corpus_pipeline.ngram_jaccard_join(spark, once, sf))
    assert sorted(r.doc_id for r in single.collect()) == sorted(min(c) for c in classes.values())

    sizes = Counter()
    for r in single.collect():
        sizes[r.source] += len((r.text or "").split())
    goal, taken = wanted(sizes), Counter()
    mixed = written(corpus_pipeline.source_mixing(spark, single, sf))
    texts = {r.doc_id: (r.text or "").split() for r in single.collect()}
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
        assert texts[r.doc_id][: len(r.text.split())] == r.text.split()
    assert all(goal[s] - 1 <= taken[s] <= goal[s] + 1e-6 for s in sizes)

    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.encode_special_tokens = True
    want = Counter((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed.collect())
    bins, pieces = {}, Counter()
    packed = corpus_pipeline.best_fit_packing(spark, mixed, sf).collect()
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id] += r.length
    assert pieces == sum((Counter({k: n * times}) for (k, n), times in want.items()), Counter())
    for own_ in bins.values():
        own_.sort()
        assert [o for o, _ in own_] == [sum(n for _, n in own_[:k]) for k in range(len(own_))] and sum(n for _, n in own_) <= 2048
