"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Each view has a logistic model of its own. Its evidence is cross-fitted: every labelled row is scored by a model that
was fitted on the other folds, which gives the view's calibration, its loss, and how often it is right where it is
sure. A view may teach a label only if that share is high (PRECISE, smoothed); where there is no such evidence, none
are taught. In every round the rows of the pool that a view is surest of go with its label to the other view's training
rows, in the labels' own proportion and at most SHARE times as many as there are labelled rows, or TAUGHT. A view keeps what it was taught in a round
only if its cross-fitted loss on labelled rows falls; else it stays as it was, so a useless view does no harm. In the
end a document's score combines the calibrated log-odds of both views, weighted by how well each does.

The models are fitted on at most SAMPLE labelled rows, by a hash of the id, and on those pseudo-labelled rows;
the pool that pseudo-labels come from is every document, and every document is scored, on its whole text.
The metadata view reads language, source and size as the table states them, never the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import features as X
from quern.llm import words as W
from quern.llm.shared import cut

SAMPLE = 8_000
ROUNDS = 2
#: Rows that each view labels for the other in a round, as a share of the labelled rows and at most; how sure it has to be of
#: one, by its calibrated chance; how often it has to be right where it is that sure; and folds of the evidence.
SHARE = 2.0
TAUGHT = 2_000
SURE = 0.9
PRECISE = 0.8
FOLDS = 3
#: Bins of hashed words in the text view; classes of sizes in the metadata view.
WORD_BINS = 256
SIZES = 20
SOURCES = 64
LANGS = 16
META = LANGS + SOURCES + 3 + SIZES

#: Classes of bytes; letters and space first, then marks that are counted one by one.
_MARKS = b"#*$%&|<>!?.,:;'\"-_()[]{}=/\\@+~`^\n\t"
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:], _CLASS[32] = 1, 2, 3, 4, 5
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = 6 + _k
CLASSES = 6 + len(_MARKS)


def text_view(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares of byte classes and of hashed words, square roots of them, and sizes and repeats of words."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1)
    owner = np.repeat(np.arange(n), np.diff(offs))
    share = np.bincount(owner * CLASSES + _CLASS[buf], minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]
    words = W.cut(buf, offs, lower=True)
    count = np.diff(words.first)
    doc = np.repeat(np.arange(n), count)
    length = np.bincount(doc, words.ends - words.starts, minlength=n) / np.maximum(count, 1)
    order = np.lexsort((words.hashes, doc))
    h, d = words.hashes[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[fresh], minlength=n) / np.maximum(count, 1)
    marks = share[:, 6:].sum(axis=1, keepdims=True)
    rest = np.stack((length / 10, np.log1p(length), distinct, count == 0, np.log1p(count) / 5), axis=1)
    bins = np.bincount(doc * WORD_BINS + X.terms(words.hashes, WORD_BINS), minlength=n * WORD_BINS).reshape(n, WORD_BINS) / np.maximum(count, 1)[:, None]
    return np.concatenate((share, np.sqrt(share), marks, np.sqrt(marks), rest, np.sqrt(bins)), axis=1)


def _slot(value: str | None, slots: int) -> int:
    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (slots - 1)


def meta_view(lang: list, source: list, n_chars: np.ndarray) -> np.ndarray:
    """Language, source and size, and classes of sizes; nulls have a slot, and a size of 0."""
    n = len(lang)
    out = np.zeros((n, META))
    out[np.arange(n), [_slot(x, LANGS) for x in lang]] = 1
    out[np.arange(n), [LANGS + _slot(x, SOURCES) for x in source]] = 1
    size, at = np.log1p(np.maximum(n_chars, 0)), LANGS + SOURCES
    out[:, at] = size / 8
    out[:, at + 1] = (size / 8) ** 2
    out[:, at + 2] = size < np.log1p(100)
    large = np.clip(np.log2(np.maximum(n_chars, 0) + 1), 0, SIZES - 1).astype(np.int64)
    out[np.arange(n), at + 3 + large] = 1
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z, -8, 8) @ self.w[:-1] + self.w[-1]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1.0, rounds: int = 25) -> Logistic:
    """Logistic regression by Newton steps; both labels weigh the same in all."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.concatenate((np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))), axis=1)
    up, down = (weight * (y > 0)).sum(), (weight * (y <= 0)).sum()
    weight = weight * np.where(y > 0, 0.5 / max(up, 1e-9), 0.5 / max(down, 1e-9)) * len(x)
    w = np.zeros(z.shape[1])
    keep = np.full(len(w), decay)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = X.logistic(z @ w)
        g = z.T @ (weight * (p - y)) + keep * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


@dataclass
class Views:
    models: list[Logistic]
    scales: list[tuple[float, float]]
    trust: list[float]
    prior: float

    def score(self, views: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        odds = [a * np.clip(m.raw(x), -X.MOST_SURE, X.MOST_SURE) + b for m, x, (a, b) in zip(self.models, views, self.scales, strict=True)]
        both = self.prior + sum(t * (o - self.prior) for t, o in zip(self.trust, odds, strict=True))
        return X.logistic(both), [X.logistic(o) for o in odds]


@dataclass
class Evidence:
    """How a view does on labelled rows, each scored by a model that was not fitted on it."""

    scale: tuple[float, float]
    loss: float
    gain: float
    quota: list[int]


def _evidence(x: np.ndarray, y: np.ndarray, taught: list[np.ndarray]) -> Evidence:
    """Calibration, loss, gain over the base rate, and how many rows of each label the view may teach."""
    raw, fold = np.zeros(len(y)), np.arange(len(y)) % FOLDS
    for f in range(FOLDS):
        rest = fold != f
        model = fit(*(np.concatenate(z) for z in zip((x[rest], y[rest].astype(float), np.ones(int(rest.sum()))), taught, strict=True)))
        raw[~rest] = model.raw(x[~rest])
    a, b = X.calibrate(raw, y)
    scale = max(a, 0.0), b
    p = np.clip(X.logistic(scale[0] * np.clip(raw, -X.MOST_SURE, X.MOST_SURE) + b), 1e-6, 1 - 1e-6)
    loss = float(-np.mean(np.where(y > 0, np.log(p), np.log(1 - p))))
    rate = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    base = -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
    quota = []
    for label, sure in ((0, 1 - p >= SURE), (1, p >= SURE)):
        right = (int((y[sure] == label).sum()) + 1) / (int(sure.sum()) + 2)
        quota.append(int(min(SHARE * len(y), TAUGHT) * (rate if label else 1 - rate)) if right >= PRECISE else 0)
    return Evidence(scale, loss, max(base - loss, 0.0), quota)


def co_train(views: list[np.ndarray], y: np.ndarray, surest, rounds: int = ROUNDS) -> Views:
    """Fit both views on the labelled rows and let them teach each other where their evidence allows it.

    surest(models, scales, quotas) gives for each view up to so many rows of each label (views, labels) that its model
    is surest of and that weren't given before.
    """
    n = len(y)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if min(y.sum(), n - y.sum()) < FOLDS or any(y[np.arange(n) % FOLDS != f].min() == y[np.arange(n) % FOLDS != f].max() for f in range(FOLDS)):
        flat = [Logistic(np.zeros(v.shape[1]), np.ones(v.shape[1]), np.zeros(v.shape[1] + 1)) for v in views]
        return Views(flat, [(0.0, base)] * 2, [0.5, 0.5], base)

    def fitted(v: int, more: list[np.ndarray]) -> Logistic:
        return fit(*(np.concatenate(z) for z in zip((views[v], y.astype(float), np.ones(n)), more, strict=True)))

    taught = [[v[:0], np.zeros(0), np.zeros(0)] for v in views]
    models = [fitted(v, taught[v]) for v in (0, 1)]
    held = [_evidence(x, y, t) for x, t in zip(views, taught, strict=True)]
    for _ in range(rounds):
        if not any(q for h in held for q in h.quota):
            break
        given = surest(models, [h.scale for h in held], [h.quota for h in held])
        kept = False
        for v in (0, 1):
            rows, label = given[1 - v]
            if not len(label):
                continue
            more = [np.concatenate(z) for z in zip(taught[v], (rows[v], label, np.ones(len(label))), strict=True)]
            after = _evidence(views[v], y, more)
            if after.loss < held[v].loss:
                taught[v], models[v], held[v], kept = more, fitted(v, more), after, True
        if not kept:
            break
    whole = sum(h.gain for h in held) or 1.0
    return Views(models, [h.scale for h in held], [h.gain / whole for h in held], base)


WIDTHS = (2 * CLASSES + 7 + WORD_BINS, META)


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Views of batches with text, lang, source and n_chars in columns 1 to 4."""
    for a, b, buf, offs in W.slices(batch.column(1)):
        part = batch.slice(a, b - a)
        chars = np.nan_to_num(part.column(4).to_numpy(zero_copy_only=False).astype(float))
        yield a, b, [text_view(buf, offs), meta_view(part.column(2).to_pylist(), part.column(3).to_pylist(), chars)]


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, views in _views(batch):
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in views]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(5).slice(a, b - a), *lists], names=["label", "place", "text_view", "meta_view"])


def _prepared(docs: DataFrame, first: str) -> DataFrame:
    text = F.col("text").cast("string")
    get = lambda c, kind: F.col(c).cast(kind) if c in docs.columns else F.lit(None).cast(kind)
    return docs.select(F.col(first), text.alias("text"), get("lang", "string").alias("lang"), get("source", "string").alias("source"), get("n_chars", "double").alias("n_chars"), F.xxhash64("doc_id", text).alias("place"))


def _matrix(rows: DataFrame, name: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and views of rows (prepared, with a label first), in an order that doesn't depend on how they come in."""
    schema = "label double, place long, text_view array<double>, meta_view array<double>"
    held = cut(_prepared(rows, "label").mapInArrow(_vectors, schema), name).toArrow().combine_chunks()
    label = np.nan_to_num(held.column("label").to_numpy(zero_copy_only=False).astype(float))
    views = [held.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(label), w) if len(label) else np.zeros((0, w)) for c, w in zip(("text_view", "meta_view"), WIDTHS, strict=True)]
    order = np.lexsort((label, held.column("place").to_numpy())) if len(label) else np.zeros(0, np.int64)
    return label[order], [v[order] for v in views]


class Pool:
    """All documents as the pool: scores every one of them in each round and keeps only what the surest need."""

    def __init__(self, docs: DataFrame) -> None:
        self.docs = docs.filter("doc_id IS NOT NULL")
        self.before: DataFrame | None = None

    def surest(self, models: list[Logistic], scales: list[tuple[float, float]], quotas: list[list[int]]) -> list[tuple[list[np.ndarray], np.ndarray]]:
        held = self.docs.sparkSession.sparkContext.broadcast((models, scales))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, views in _views(batch):
                    p = [X.logistic(k * np.clip(m.raw(v), -X.MOST_SURE, X.MOST_SURE) + c) for m, v, (k, c) in zip(held.value[0], views, held.value[1], strict=True)]
                    sure = np.flatnonzero(np.max([np.maximum(x, 1 - x) for x in p], axis=0) >= SURE)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(pa.array(sure)), *(pa.array(x[sure]) for x in p)], names=["doc_id", "p0", "p1"])

        kind = self.docs.schema["doc_id"].dataType.simpleString()
        found = cut(_prepared(self.docs, "doc_id").mapInArrow(run, f"doc_id {kind}, p0 double, p1 double"), "sure").dropDuplicates(["doc_id"])
        if self.before is not None:
            found = found.join(F.broadcast(self.before), "doc_id", "left_anti")  # at most 2 * TAUGHT ids a round
        taught = None
        for v in (0, 1):
            for label in (0, 1):
                sure = F.col(f"p{v}") if label else 1 - F.col(f"p{v}")
                top = found.filter(sure >= SURE).orderBy(F.desc(sure), X.drawn("doc_id"), "doc_id").limit(quotas[v][label]).select("doc_id", F.lit(2.0 * v + label).alias("label"))
                taught = top if taught is None else taught.unionByName(top)
        taught = cut(taught, "taught")
        ids = taught.select("doc_id").distinct()
        self.before = ids if self.before is None else self.before.unionByName(ids)
        code, views = _matrix(self.docs.drop("label").join(F.broadcast(taught), "doc_id"), "taught-views")
        return [([x[code // 2 == v] for x in views], code[code // 2 == v] % 2) for v in (0, 1)]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Views:
    """Fit on labelled rows of `docs` (doc_id, text, lang, source, n_chars); labels has doc_id and quality.

    Rows and labels with a null doc_id teach nothing; a repeated id has one of its labels.
    """
    marked = labels.select("doc_id", F.col("quality").cast("double").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(X.bounded_sample(marked, sample))  # about `sample` rows
    y, views = _matrix(docs.drop("label").join(chosen, "doc_id"), "labelled-views")
    return co_train(views, y, Pool(docs).surest, rounds)


def score(docs: DataFrame, model: Views) -> DataFrame:
    """(doc_id, score, text_score, meta_score) of every row: the chance of good quality; nulls and empty texts too.

    Rows are scored one by one: repeated rows score alike, and columns other than those of the views are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, views in _views(batch):
                both, each = held.value.score(views)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(both), pa.array(each[0]), pa.array(each[1])], names=["doc_id", "score", "text_score", "meta_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _prepared(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, score double, text_score double, meta_score double")
