"""Language identification by nearest centroids of TF-IDF n-gram vectors, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import lean, slices, utf8
from .textstats import gram_counts, letter_counts, lowered

#: Hashed n-grams; centroids per language; labelled texts that the model is fitted on, over all languages
#: (the bound of the sample: of each language's different texts, those with the least hashes).
DIMS, CENTROIDS, SAMPLE = 8192, 4, 1600
#: A text is rejected if its cosine is below this factor of the one that all but this share of held-back texts with as
#: many different n-grams reach. Few n-grams give low cosines in any language, so the limit depends on their number.
FARTHEST, FACTOR = 0.01, 0.7
#: Numbers of different n-grams between which limits are interpolated, and one in so many texts that is held back for them.
SIZES, BACK = 2.0 ** np.arange(1, 12), 4
#: A centroid that fewer than this share of its language's texts (or one text) are nearest to is dropped: a stray or
#: mislabelled text founds no centroid.
STRAY = 0.02
#: A new start is the text at this place, as a share, when texts are ordered from the farthest on.
APART = 0.2
#: Bytes and rows whose vectors are made at once.
WORK_BYTES, WORK_ROWS = 1 << 20, 128
UNDECIDED = "und"


def vectors(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Rows of unit length: log of 1 + counts, times weight."""
    x = counts.astype(np.float32)
    np.log1p(x, out=x)
    x *= weight
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    return x


def clustered(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means. The first start is the mean direction, each next one a text far from all
    before, though not among the farthest, which are odd ones."""
    centres = x.mean(0, keepdims=True)
    for _ in range(min(k, len(x)) - 1):
        centres = np.vstack([centres, x[np.argsort((x @ centres.T).max(1), kind="stable")[int(APART * (len(x) - 1))]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = np.vstack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-12)
    members = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
    good = members >= max(2, STRAY * len(x))
    return centres[good if good.any() else members == members.max()].astype(np.float32)


class LanguageModel:
    """Weights of n-grams, centroids with their languages, and the least cosine that is accepted by number of n-grams."""

    def __init__(self, counts: np.ndarray, labels: list[str], k: int = CENTROIDS):
        self.weight = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        x, names = vectors(counts, self.weight), np.array(labels)
        self.languages = sorted(set(labels))
        back = np.zeros(len(names), bool)  # held back, where a language has texts enough
        for name in self.languages:
            own = np.flatnonzero(names == name)
            back[own[::BACK]] = len(own) >= 4 * BACK
        self._place([clustered(x[(names == name) & ~back], k) for name in self.languages], counts.shape[1])
        self.limit = self._limits(counts[back])
        if back.any():
            self._place([clustered(x[names == name], k) for name in self.languages], counts.shape[1])

    def _place(self, parts: list[np.ndarray], dims: int) -> None:
        self.centres = np.vstack(parts) if parts else np.zeros((0, dims), np.float32)
        self.of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])

    def _limits(self, counts: np.ndarray) -> np.ndarray:
        """Accepted cosines at SIZES, from held-back texts and the parts of them that have as few n-grams."""
        draw, sizes, scores = np.random.default_rng(7), [], []
        for size in SIZES:
            n = (counts > 0).sum(1)
            use = np.flatnonzero(n >= size)
            use = np.tile(use, max(1, 400 // max(1, len(use))))  # few texts give several parts each
            for a in range(0, len(use), 128):
                own = use[a : a + 128]
                part = np.where(draw.random((len(own), counts.shape[1])) < (size / n[own])[:, None], counts[own], 0)
                scores.append((vectors(part, self.weight) @ self.centres.T).max(1, initial=0))
                sizes.append((part > 0).sum(1))
        if not sizes:
            return np.zeros(len(SIZES))
        at, score = np.log2(np.maximum(np.concatenate(sizes), 1)), np.concatenate(scores)
        near = [score[np.abs(at - np.log2(size)) <= 0.5] for size in SIZES]
        limit = np.array([FACTOR * float(np.quantile(own, FARTHEST)) if len(own) >= 50 else np.nan for own in near])
        known = np.flatnonzero(~np.isnan(limit))
        return np.maximum.accumulate(np.interp(np.arange(len(SIZES)), known, limit[known])) if len(known) else np.zeros(len(SIZES))

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the language's number, the cosine with its nearest centroid, and whether that is too little."""
        near = vectors(counts, self.weight) @ self.centres.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(near)), best], 0, 1)
        n = np.log2(np.maximum((counts > 0).sum(1), 1))
        return self.of[best], score.astype(np.float64), score < np.interp(n, np.log2(SIZES), self.limit)


def counted(texts: DataFrame, dims: int = DIMS) -> DataFrame:
    """_label and _counts (n-gram counts up to 65535 as binary) of each row of (_label, _text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, WORK_BYTES, WORK_ROWS):
                got = gram_counts(*lowered(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), dims)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in np.minimum(got, 65535).astype("<u2")], pa.binary())], names=["_label", "_counts"])

    return texts.select("_label", "_text").mapInArrow(lean(count), "_label string, _counts binary")


def fit(labelled: DataFrame, label: str = "lang", text: str = "text", sample: int = SAMPLE) -> LanguageModel:
    """A model from a bounded sample of labelled texts: of each language's different texts, those with the least hashes, so many
    that each language gets its equal part of the sample. Copies count once, so a language of copies is learnt as well as
    others. Null labels and texts without letters are left out. More labels than half the sample raise ValueError."""
    rows = labelled.select(F.col(label).cast("string").alias("_label"), F.col(text).alias("_text")).filter("_label is not null").filter(F.col("_text").rlike(r"\p{L}"))
    rows = rows.withColumn("_hash", F.xxhash64("_text", F.lit(1)))
    labels = rows.select("_label").distinct().limit(sample).count()
    if labels > sample // 2:
        raise ValueError(f"more than {sample // 2} labels: the sample is too small for them")
    # Spark cuts by rank within each task, before the shuffle
    least = Window.partitionBy("_label").orderBy("_hash")
    chosen = rows.select("_label", "_hash").distinct().withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= sample // max(1, labels)).drop("_n")
    drawn = rows.join(F.broadcast(chosen), ["_label", "_hash"]).select("_label", "_text").distinct()
    got = sorted((r[0], bytes(r[1])) for r in counted(drawn).collect())  # the same order on every run
    names, counts = [r[0] for r in got], np.frombuffer(b"".join(r[1] for r in got), "<u2").reshape(-1, DIMS)
    del got
    return LanguageModel(counts, names)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, lang_pred, score (cosine, 0 to 1), rejected.

    lang_pred is und and score 0 where the text is null or has no letter, or the model has no language;
    these are rejected, as are texts too far from every centroid. Null keys are kept, repeated rows give
    repeated results, empty input an empty result; only key and text are read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of vectors per language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, WORK_BYTES, WORK_ROWS):
                points, bounds = lowered(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                some = letter_counts(points, bounds) > 0
                if model.languages:
                    best, score, far = model.predict(gram_counts(points, bounds, DIMS))
                else:
                    best, score, far, some = np.zeros(b - a, int), np.zeros(b - a), np.ones(b - a, bool), np.zeros(b - a, bool)
                names = [model.languages[i] if s else UNDECIDED for i, s in zip(best, some, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0)), pa.array(far | ~some)], names=["_key", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(lean(predict), f"_key {rows.schema['_key'].dataType.simpleString()}, lang_pred string, score double, rejected boolean").withColumnRenamed("_key", key)


def fold(key: str = "doc_id"):
    """crc32 of the key's text modulo 3; fold 1 is held out from fitting."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3, F.lit(0))


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """docs without the rows whose language is undecided or too far, all columns as they are, by a model fitted on the folds of docs
    that are not held out. The text itself is carried through the prediction, so no join is needed."""
    model = fit(docs.filter(fold(key) != 1), label, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column(at))
            for a, b in slices(offsets, WORK_BYTES, WORK_ROWS):
                points, bounds = lowered(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                use = letter_counts(points, bounds) > 0
                if model.languages:
                    use &= ~model.predict(gram_counts(points, bounds, DIMS))[2]
                else:
                    use[:] = False
                yield batch.slice(a, b - a).filter(pa.array(use))

    return docs.mapInArrow(lean(keep), docs.schema)
