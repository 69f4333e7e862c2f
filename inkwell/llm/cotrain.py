"""Quality scores by co-training a text view and a page-metadata view."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .language_id import fold
from .shared import lean, slices, utf8
from .textstats import gram_counts, lowered, word_counts

#: Hashed n-grams and words of the text view; hashed sources and languages of the metadata view.
GRAMS, WORDS, NAMES = 1024, 1024, 64
#: Bound of the labelled sample (drawn by hash); rounds, and pseudo-labels that a view gives the other one per round and class:
#: its most confident ones among all unlabelled documents. Parameters of fit().
LABELLED, ROUNDS, EXCHANGED = 4000, 3, 100
#: Buckets of the distributed choice of the most confident documents.
CHOICE = 64
#: Bytes and rows whose vectors are made at once.
WORK_BYTES, WORK_ROWS = 1 << 20, 256
TEXT_DIMS, META_DIMS = GRAMS + WORDS, NAMES + 8


def text_view(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit rows of log counts: hashed letter n-grams and words."""
    x = np.hstack([gram_counts(*lowered(raw, offsets), GRAMS, (3,)), word_counts(raw, offsets, WORDS)]).astype(np.float32)
    np.log1p(x, out=x)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)
    return x


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flag))[offsets]).astype(np.float32)


def meta_view(raw: np.ndarray, offsets: np.ndarray, names: list[tuple[str | None, ...]]) -> np.ndarray:
    """Page metadata: source, language, size, layout and shares of character classes; nothing of the words."""
    n = np.diff(offsets).astype(np.float32)
    one = np.maximum(n, 1)
    lines, spaces = _per_text(raw == 10, offsets), _per_text(raw == 32, offsets)
    upper = _per_text((raw >= 65) & (raw <= 90), offsets)
    digit = _per_text((raw >= 48) & (raw <= 57), offsets)
    mark = _per_text(((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126)), offsets)
    out = np.zeros((len(n), META_DIMS), np.float32)
    for row, own in enumerate(names):
        for k, name in enumerate(own):
            out[row, zlib.crc32(f"{k}{name}".encode()) % NAMES] = 1
    shape = [np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / (lines + 1)) / 8, spaces / one * 3, upper / one * 3, digit / one * 3, mark / one * 3, np.minimum(n, 400) / 400]
    out[:, NAMES:] = np.column_stack(shape)
    return out


class Logistic:
    """Weighted logistic regression by full-batch gradient steps with momentum, and a Platt scale."""

    def __init__(self, x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 4.0, ridge: float = 1e-4):
        self.mean, self.w, self.b, self.scale = x.mean(0), np.zeros(x.shape[1], np.float32), 0.0, (1.0, 0.0)
        spread = x.std(0)
        self.unit = (1 / np.where(spread > 1e-6, spread, 1)).astype(np.float32) if x.shape[1] == META_DIMS else np.float32(np.sqrt(x.shape[1]) / 4)
        x = (x - self.mean) * self.unit
        rate = rate / max(1.0, float((x * x).sum(1).mean()) / 4)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
        step, shift = np.zeros_like(self.w), 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))
            g = (p - y) * weight
            step = 0.9 * step - rate * (x.T @ g + ridge * self.w)
            shift = 0.9 * shift - rate * float(g.sum())
            self.w, self.b = self.w + step, self.b + shift

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.unit) @ self.w + self.b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """A slope and an intercept by Newton steps on the log-loss of held-back labelled rows."""
        m = self.margin(x)
        m = m / max(1e-6, float(np.abs(m).mean()))
        base = max(1e-6, float(np.abs(self.margin(x)).mean()))
        a, b = 1.0, 0.0
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            g = np.array([((p - y) * m).sum() + 1e-2 * a, (p - y).sum()])
            s = p * (1 - p)
            h = np.array([[(s * m * m).sum() + 1e-2, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
        self.scale = (float(a) / base, float(b))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale[0] * self.margin(x) + self.scale[1], -20, 20)


class QualityModel:
    """Two views that teach each other; calibrated at the end, with the weights that combine their log-odds."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray):
        part = np.arange(len(y)) % 8
        self.back = [((v[part == 0], y[part == 0]), (v[part == 4], y[part == 4])) for v in (text, meta)]  # for calibration, for the combination
        own = part % 4 != 0
        self.x, self.y = [v[own] for v in (text, meta)], [y[own].astype(np.float32)] * 2
        self.share = float(y[own].mean()) if own.any() else 0.5
        self.taken: list[set[int]] = [set(), set()]  # documents that a view has been taught
        self.learn()

    def learn(self) -> None:
        self.views = [Logistic(x, t) for x, t in zip(self.x, self.y, strict=True)]

    def wanted(self, exchanged: int) -> tuple[int, int]:
        """Pseudo-labels a round, bad and good, in the proportion of the labels."""
        return exchanged, max(1, int(exchanged * self.share / max(1 - self.share, 0.05)))

    def teach(self, view: int, good: int, names: list[int], text: np.ndarray, meta: np.ndarray) -> None:
        """The other view learns these documents with the label that this one gives them."""
        other = 1 - view
        self.taken[other].update(names)
        self.x[other] = np.vstack([self.x[other], (text, meta)[other]])
        self.y[other] = np.concatenate([self.y[other], np.full(len(names), good, np.float32)])

    def finish(self) -> QualityModel:
        for model, ((x, y), _) in zip(self.views, self.back, strict=True):
            model.calibrate(x, y.astype(np.float32))
        y = self.back[0][1][1].astype(np.float32)
        self.mix = self._combined(np.column_stack([m.logit(b[1][0]) for m, b in zip(self.views, self.back, strict=True)]), y)
        self.x = self.y = self.back = self.taken = None  # only weights are sent to the tasks
        return self

    @staticmethod
    def _combined(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Non-negative weights of the views' log-odds and an intercept that minimise the log-loss."""
        w = np.array([0.5, 0.5, 0.0])
        x = np.column_stack([logits, np.ones(len(logits))])
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w - 0.05 * (x.T @ (p - y)) / max(1, len(y))
            w[:2] = np.maximum(w[:2], 0.0)
        return w

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of good quality: by text, by metadata, combined."""
        a, b = self.views[0].logit(text), self.views[1].logit(meta)
        total = self.mix[0] * a + self.mix[1] * b + self.mix[2]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))).astype(np.float64) for v in (a, b, total))


def _viewed(batch: pa.RecordBatch, text: int, names: tuple[int, ...]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = utf8(batch.column(text))
    own = list(zip(*(batch.column(k).to_pylist() for k in names), strict=True))
    for a, b in slices(offsets, WORK_BYTES, WORK_ROWS):
        part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        yield a, b, text_view(part, at), meta_view(part, at, own[a:b])


def _drawn(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views and the labels of (_label, _text, _source, _lang) rows, a bounded sample, in a fixed order."""

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, z in _viewed(batch, 1, (2, 3)):
                small = np.clip(np.rint(x * 255), 0, 255).astype(np.uint8)  # a quarter of the driver's memory
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([r.tobytes() for r in small], pa.binary()), pa.array([r.tobytes() for r in z], pa.binary())], names=["_label", "_x", "_z"])

    got = rows.select("_label", "_text", "_source", "_lang").mapInArrow(lean(view), "_label int, _x binary, _z binary").toPandas().sort_values(["_x", "_z", "_label"])
    x = np.frombuffer(b"".join(got["_x"]), np.uint8).reshape(-1, TEXT_DIMS).astype(np.float32) / 255
    return x, np.frombuffer(b"".join(got["_z"]), np.float32).reshape(-1, META_DIMS), got["_label"].fillna(-1).to_numpy(int)


def _confident(rows: DataFrame, model: QualityModel, exchanged: int) -> list:
    """The most confident documents of rows by view and class: (_view, _good, _name, _x, _z), at most so many as wanted.

    Every document is scored; a task keeps its best of each view and class, and two ranks (within buckets of the
    documents' names, then over all) choose from these. Copies count once.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.views, [np.array(sorted(t), np.int64) for t in model.taken]))
    most = model.wanted(exchanged)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, taken = shared.value
        held = {(k, good): (np.zeros(0), np.zeros(0, np.int64), np.zeros((0, TEXT_DIMS), np.uint8), np.zeros((0, META_DIMS), np.float32)) for k in (0, 1) for good in (0, 1)}
        for batch in batches:
            names = batch.column(0).to_numpy()
            for a, b, x, z in _viewed(batch, 1, (2, 3)):
                for k, model in enumerate(views):
                    margin = model.margin((x, z)[k])
                    free = ~np.isin(names[a:b], taken[1 - k])
                    for good in (0, 1):
                        strength = margin if good else -margin
                        use = np.flatnonzero(free & (strength > 0))
                        use = use[np.lexsort((names[a:b][use], -strength[use]))[: 2 * most[good]]]
                        new = (strength[use], names[a:b][use], np.clip(np.rint(x[use] * 255), 0, 255).astype(np.uint8), z[use])
                        all_ = [np.concatenate(c) for c in zip(held[k, good], new, strict=True)]
                        order = np.lexsort((all_[1], -all_[0]))
                        first = np.zeros(len(order), bool)
                        first[np.unique(all_[1][order], return_index=True)[1]] = True
                        held[k, good] = tuple(c[order[first][: most[good]]] for c in all_)
        for (k, good), (strength, names, x, z) in held.items():
            n = len(names)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int32()), pa.array([good] * n, pa.int32()), pa.array(strength, pa.float64()), pa.array(names), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in z], pa.binary())], names=["_view", "_good", "_strength", "_name", "_x", "_z"])

    got = rows.select("_name", "_text", "_source", "_lang").mapInArrow(lean(best), "_view int, _good int, _strength double, _name long, _x binary, _z binary")
    got = got.dropDuplicates(["_view", "_good", "_name"]).withColumn("_bucket", F.pmod("_name", F.lit(CHOICE)))
    limit = F.when(F.col("_good") == 1, F.lit(most[1])).otherwise(F.lit(most[0]))
    for keys in (["_view", "_good", "_bucket"], ["_view", "_good"]):
        got = got.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_strength"), "_name"))).filter(F.col("_n") <= limit)
    return got.select("_view", "_good", "_name", "_x", "_z").orderBy("_view", "_good", "_name").collect()


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", source: str = "source", lang: str = "lang",
    labelled: int = LABELLED, rounds: int = ROUNDS, exchanged: int = EXCHANGED,
) -> QualityModel | None:
    """A model from labelled documents of the folds that are not held out (a sample of so many at most, half of each class) and
    from all unlabelled ones of these folds: every round scores them all and each view hands its most confident ones to the
    other. None if the labels do not have both classes. Of rows with equal keys one is learnt; documents without a key are
    unlabelled."""
    rows = docs.filter(fold(key) != 1).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).cast("string").alias("_source"), F.col(lang).cast("string").alias("_lang"))
    given = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(key) != 1)).groupBy(F.col(key).alias("_key")).agg((F.max(F.col(label).cast("int")) > 0).cast("int").alias("_label"))
    draw = F.pmod(F.xxhash64("_key", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    each = given.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    if each.count() < 2:
        return None
    chosen = given.join(F.broadcast(each), "_label").filter(draw < F.lit(labelled / 2) / F.col("_n")).select("_key", "_label")
    learnt = rows.join(F.broadcast(chosen), "_key").groupBy("_key", "_label").agg(F.min(F.struct("_text", "_source", "_lang")).alias("_row"))
    x, z, y = _drawn(learnt.select("_label", "_row.*"))
    if min((y == 0).sum(), (y == 1).sum()) < 4:
        return None
    model = QualityModel(x, z, y)
    free = rows.join(F.broadcast(chosen.select("_key")), "_key", "left_anti").withColumn("_name", F.xxhash64("_text", "_source", "_lang"))
    for _ in range(rounds):
        found: dict[tuple[int, int], list] = {}
        for r in _confident(free, model, exchanged):
            found.setdefault((r[0], r[1]), []).append(r)
        for (view, good), own in found.items():
            seen = np.frombuffer(b"".join(r[3] for r in own), np.uint8).reshape(-1, TEXT_DIMS).astype(np.float32) / 255
            model.teach(view, good, [r[2] for r in own], seen, np.frombuffer(b"".join(r[4] for r in own), np.float32).reshape(-1, META_DIMS))
        model.learn()
    return model.finish()


def score_quality(docs: DataFrame, model: QualityModel | None, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: key, p_text, p_meta, score (all 0 to 1, of good quality) and good.

    Null text counts as empty, null source and lang are values of their own. Without a model (labels of one
    class or none) all scores are 0.5. Null keys are kept, repeated rows give repeated results, empty input
    an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).cast("string").alias("_source"), F.col(lang).cast("string").alias("_lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, x, z in _viewed(batch, 1, (2, 3)):
                got = model.scores(x, z) if model else (np.full(b - a, 0.5),) * 3
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(v) for v in got), pa.array(got[2] >= threshold)], names=["_key", "p_text", "p_meta", "score", "good"])

    return rows.mapInArrow(lean(score), f"_key {rows.schema['_key'].dataType.simpleString()}, p_text double, p_meta double, score double, good boolean").withColumnRenamed("_key", key)
