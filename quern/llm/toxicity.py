"""Toxicity: a factorization machine over hashed terms.

score = logistic(w0 + sum w_i x_i + sum over pairs i < j of <v_i, v_j> x_i x_j), x being the presence of a
term anywhere in the text. The pair part learns what an additive model can't: a term that is harmless
alone and harmful beside another. It is computed as half of (sum v x)^2 - sum (v x)^2, so a text costs
its distinct terms times the number of factors.

It is fitted in three steps. The first takes the MODEL_TERMS bins that differ most between the labels. The
second adds bins that what is still unexplained points at: a rare term that no marginal count would show stands
out among the rows that the model gets wrong. The third goes on over every bin that LEAST_ROWS labelled rows
hold, so terms that are neutral alone get factors too; after each pass it is measured on held-back labelled
rows, and the best pass is kept if it beats the second step. Scores are calibrated on the held-back rows.

A term is a word without the punctuation at its edges, or the first few bytes of one. The model is fitted
on at most SAMPLE labelled rows, half of them toxic where there are so many; scoring takes every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import features as X
from quern.llm.shared import cut

BINS = 1 << 20
FACTORS = 4
#: Bytes from a word's start that are terms of their own, so inflected forms share weight.
STEMS = (4, 5, 6, 7)
SAMPLE = 8_000
MODEL_TERMS = 1024
EPOCHS = 30
#: Labelled rows that hold a term, at the least; passes over all such terms, and those without gain before it stops.
LEAST_ROWS = 3
WIDE_EPOCHS = 40
#: Rounds of the second step, deviations by which what is unexplained has to point at a term, and rows' worth of it.
MORE_ROUNDS = 2
RESIDUAL_GAP = 4.0
RESIDUAL_ROWS = 2.5
PATIENCE = 8
#: Weight decay, and standard errors by which a term's share has to differ between the labels.
DECAY = 5e-4
LEAST_GAP = 3.2
SEED = 3


def distinct_terms(words) -> tuple[np.ndarray, np.ndarray]:
    """(document, bin) pairs, each once, in order of document."""
    docs = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first)) * BINS
    both = np.unique(np.concatenate([docs + X.terms(h, BINS) for h in X.word_stems(words, STEMS)]))
    return both // BINS, both % BINS


def _labelled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words in X.word_runs(batch.column(2)):
            doc, term = distinct_terms(words)
            starts = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(pa.array(starts), pa.array(term.astype(np.int32)))], names=["place", "label", "terms"])


def _only(known):
    """Lists of bins without those that `known`, a broadcast mask, leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy()
            keep = known.value[values]
            before = np.concatenate(([0], np.cumsum(keep)))
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(before[bounds].astype(np.int32)), pa.array(values[keep]))], names=["place", "label", "terms"])

    return run


class Machine:
    """A factorization machine over chosen bins; other bins weigh nothing."""

    def __init__(self, bins: np.ndarray, factors: int) -> None:
        rng = np.random.default_rng(SEED)
        self.place = np.full(BINS, len(bins), np.int32)
        self.place[bins] = np.arange(len(bins))
        self.bias = 0.0
        self.w = np.zeros(len(bins) + 1)
        self.v = rng.normal(0, 0.05, (len(bins) + 1, factors))
        self.v[-1] = 0
        self.scale = (1.0, 0.0)

    def widened(self, bins: np.ndarray) -> Machine:
        """The same machine with more bins, theirs at the start."""
        known = np.flatnonzero(self.place < len(self.w) - 1)
        wide = Machine(np.union1d(known, bins), self.v.shape[1])
        wide.bias, wide.w[wide.place[known]], wide.v[wide.place[known]] = self.bias, self.w[self.place[known]], self.v[self.place[known]]
        return wide

    def raw(self, doc: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        out = self.bias + np.bincount(doc, self.w[place], minlength=n)
        for f in range(self.v.shape[1]):
            v = self.v[place, f]
            s = np.bincount(doc, v, minlength=n)
            out += 0.5 * (s * s - np.bincount(doc, v * v, minlength=n))
        return out

    def score(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        place = self.place[term]
        use = place < len(self.w) - 1
        a, b = self.scale
        return X.logistic(a * np.clip(self.raw(doc[use], place[use], n), -X.MOST_SURE, X.MOST_SURE) + b)


class Rows:
    """Places of the model's bins in labelled rows, one row after another."""

    def __init__(self, model: Machine, doc: np.ndarray, term: np.ndarray, labels: np.ndarray) -> None:
        place = model.place[term]
        use = place < len(model.w) - 1
        self.doc, self.place, self.labels = doc[use], place[use], labels
        self.first = np.searchsorted(self.doc, np.arange(len(labels) + 1))
        up = labels > 0
        # both labels weigh the same while fitting
        self.weight = np.where(up, 0.5 / max(1, up.sum()), 0.5 / max(1, (~up).sum())) * len(labels)

    def batch(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row within the batch, place) of the rows of `part`."""
        size = self.first[part + 1] - self.first[part]
        own = np.repeat(np.arange(len(part)), size)
        pick = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[part], size)
        return own, self.place[pick]


def passes(model: Machine, rows: Rows, train: np.ndarray, epochs: int, rate: float) -> Iterator[None]:
    """Adam on batches with weight decay; yields after each pass over the rows `train`."""
    rng = np.random.default_rng(SEED)
    params = [model.w, model.v]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    bias_m = bias_s = 0.0
    step, n = 0, len(model.w)
    for _ in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            own, place = rows.batch(part)
            v = model.v[place]
            sums = np.stack([np.bincount(own, v[:, f], minlength=len(part)) for f in range(v.shape[1])], axis=1)
            raw = model.bias + np.bincount(own, model.w[place], minlength=len(part)) + 0.5 * ((sums**2).sum(1) - np.bincount(own, (v**2).sum(1), minlength=len(part)))
            err = (X.logistic(raw) - rows.labels[part]) * rows.weight[part] / len(part)
            each = err[own]
            grads = [np.bincount(place, each, minlength=n), np.stack([np.bincount(place, each * (sums[own, f] - v[:, f]), minlength=n) for f in range(v.shape[1])], axis=1)]
            step += 1
            for p, g, mm, ss in zip(params, grads, m, s, strict=True):
                g = g + DECAY * p
                mm += 0.1 * (g - mm)
                ss += 0.001 * (g * g - ss)
                p -= rate * (mm / (1 - 0.9**step)) / (np.sqrt(ss / (1 - 0.999**step)) + 1e-8)
            g = float(err.sum())
            bias_m += 0.1 * (g - bias_m)
            bias_s += 0.001 * (g * g - bias_s)
            model.bias -= rate * (bias_m / (1 - 0.9**step)) / (bias_s**0.5 / (1 - 0.999**step) ** 0.5 + 1e-8)
            model.w[-1] = 0
            model.v[-1] = 0
        yield


def totals(doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sum per bin of the values of the rows that hold it, a stretch at a time."""
    out = np.zeros(BINS)
    for at in range(0, len(term), 1 << 20):
        out += np.bincount(term[at : at + (1 << 20)], value[doc[at : at + (1 << 20)]].astype(float), minlength=BINS)
    return out


def screened(doc: np.ndarray, term: np.ndarray, labels: np.ndarray, train: np.ndarray, factors: int) -> tuple[Machine, np.ndarray]:
    """The first two steps on the rows `train`; and the bins that enough of them hold."""
    up = labels > 0
    fitted = np.zeros(len(labels), bool)
    fitted[train] = True
    t1, t0 = int(up[train].sum()), int((~up[train]).sum())
    in1, in0 = totals(doc, term, fitted & up), totals(doc, term, fitted & ~up)
    p1, p0 = (in1 + 0.5) / (t1 + 1), (in0 + 0.5) / (t0 + 1)
    gap = np.abs(p1 - p0) / np.sqrt((p1 * (1 - p1)) / t1 + (p0 * (1 - p0)) / t0)
    often = in1 + in0 >= LEAST_ROWS
    gap[~often] = 0
    bins = np.argsort(-gap, kind="stable")[:MODEL_TERMS]
    model = Machine(np.sort(bins[gap[bins] > LEAST_GAP]), factors)
    for k in range(MORE_ROUNDS + 1):
        rows = Rows(model, doc, term, labels)
        for _ in passes(model, rows, train, EPOCHS, 0.02):
            pass
        if k == MORE_ROUNDS:
            break
        p = np.clip(X.logistic(model.raw(rows.doc, rows.place, len(labels))), 0.02, 0.98)
        gone, spread = (labels - p) * fitted, p * (1 - p) * rows.weight**2 * fitted
        size = np.abs(totals(doc, term, gone))
        z = np.abs(totals(doc, term, gone * rows.weight)) / np.sqrt(totals(doc, term, spread) + 1e-9)
        z[(size < RESIDUAL_ROWS) | ~often | (model.place < len(model.w) - 1)] = 0
        more = np.argsort(-z, kind="stable")[:MODEL_TERMS]
        more = more[z[more] > RESIDUAL_GAP]
        if not len(more):
            break
        model = model.widened(more)
    return model, np.flatnonzero(often)


def fit(labels: np.ndarray, lists: list[np.ndarray], factors: int = FACTORS) -> Machine:
    """Fit on labels 0 or 1 and a list of distinct bins per text.

    Every fifth row is held back to choose how many passes of the third step there are, none included, and to
    calibrate; the model that is returned is then fitted that way on all rows.
    """
    doc = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    term = np.concatenate(lists).astype(np.int32) if len(lists) else np.zeros(0, np.int32)
    every = np.random.default_rng(SEED).permutation(len(lists))
    back, train = np.sort(every[::5]), np.sort(np.setdiff1d(every, every[::5]))
    up = labels > 0
    if not len(lists) or len({*up[train]}) < 2 or len({*up[back]}) < 2:
        model = Machine(np.zeros(0, np.int64), factors)
        model.bias = float(np.log(max(1, int(up.sum())) / max(1, int((~up).sum()))))
        return model

    def measured(model: Machine, rows: Rows) -> tuple[float, tuple[float, float]]:
        """Loss on the held-back rows, both labels weighing the same, and the scale that gives it."""
        at, place = rows.batch(back)
        raw = model.raw(at, place, len(back))
        a, b = X.calibrate(raw, labels[back])
        p = np.clip(X.logistic(a * np.clip(raw, -X.MOST_SURE, X.MOST_SURE) + b), 1e-6, 1 - 1e-6)
        each = -np.where(up[back], np.log(p), np.log(1 - p))
        return 0.5 * (each[up[back]].mean() + each[~up[back]].mean()), (a, b)

    model, often = screened(doc, term, labels, train, factors)
    loss, scale = measured(model, Rows(model, doc, term, labels))
    wide = model.widened(often)
    rows, chosen = Rows(wide, doc, term, labels), 0
    for k, _ in enumerate(passes(wide, rows, train, WIDE_EPOCHS, 0.02), 1):
        now, at = measured(wide, rows)
        if now < loss:
            loss, scale, chosen = now, at, k
        elif k - chosen >= PATIENCE:
            break
    model, often = screened(doc, term, labels, np.arange(len(lists)), factors)
    if chosen:
        model = model.widened(often)
        for _ in passes(model, Rows(model, doc, term, labels), np.arange(len(lists)), chosen, 0.02):
            pass
    model.scale = scale
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit on labelled rows of `docs`; labels has doc_id and toxic. At most `sample` rows, by a hash of the id.

    Rows and labels with a null doc_id teach nothing; a repeated id has one of its labels, and each of its rows is one.
    The driver gets the bins that LEAST_ROWS rows hold, at most BINS of them, and which of those each row holds.
    """
    marked = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rare = X.bounded_sample(marked.filter("toxic = 1"), sample // 2)
    rest = X.bounded_sample(marked.filter("toxic = 0"), sample - sample // 2)
    chosen = F.broadcast(rare.unionByName(rest))  # at most about `sample` rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.xxhash64("doc_id", "text").alias("place"), F.col("toxic").cast("int").alias("label"), F.col("text").cast("string").alias("text"))
    schema = "place long, label int, terms array<int>"
    terms = cut(rows.mapInArrow(_labelled_terms, schema), "toxic-terms")
    common = terms.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_ROWS).select("t")
    mask = np.zeros(BINS, bool)
    mask[common.toArrow().column("t").to_numpy()] = True
    held = terms.mapInArrow(_only(docs.sparkSession.sparkContext.broadcast(mask)), schema).toArrow().combine_chunks()
    if held.num_rows == 0:
        return Machine(np.zeros(0, np.int64), FACTORS)
    lists = held.column("terms").combine_chunks()
    bounds = lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    order = np.lexsort((np.diff(bounds), held.column("label").to_numpy(), held.column("place").to_numpy()))  # the order rows come in is not fixed
    return fit(held.column("label").to_numpy()[order].astype(float), [values[bounds[i] : bounds[i + 1]] for i in order])


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """(doc_id, score) of every row of `docs`; a null or empty text scores as a text without known terms.

    Rows are scored one by one, so repeated rows score alike and a null doc_id stays null; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most BINS weights and factors, and a table of BINS places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in X.word_runs(batch.column(1)):
                doc, term = distinct_terms(words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(held.value.score(doc, term, b - a))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
