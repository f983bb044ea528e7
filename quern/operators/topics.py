"""Topics over a distributed sparse matrix, and the concepts, evidence and edges that are drawn from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import mining
from quern.plans.local import kept

#: Terms of a vocabulary, by contract: factors of terms are the only ones that the driver holds.
MOST_TERMS = 100_000
SEED = 7
#: Columns besides those asked for in the range finder, its power iterations, and sweeps over a block's columns.
MORE, POWERS, SWEEPS = 8, 3, 25


@dataclass
class Topics:
    """terms by place, their weights in each component (components, terms), loadings (key, component, loading) of the rows,
    and the share of the matrix, by squares, that the factors leave."""

    terms: list[str]
    weights: np.ndarray
    loadings: DataFrame
    residual: float
    rounds: int


def non_negative(a: np.ndarray, gram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Rows x >= 0 that minimise |v - x h| where a = v h' and gram = h h': coordinate descent over the columns."""
    x = np.zeros_like(a)
    for _ in range(sweeps):
        for j in range(len(gram)):
            if gram[j, j] > 1e-12:
                x[:, j] = np.maximum(0.0, x[:, j] + (a[:, j] - x @ gram[:, j]) / gram[j, j])
    return x


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, first entry of each row, columns, values) of batches of (key, entries)."""
    for batch in batches:
        if batch.num_rows:
            entries = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(entries.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = entries.flatten()
            yield batch.column(0), ends, flat.field("t").to_numpy(zero_copy_only=False), flat.field("x").to_numpy(zero_copy_only=False)


def _times(first: np.ndarray, at: np.ndarray, x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The block's rows times a (terms, l) matrix; no row is empty."""
    return np.add.reduceat(x[:, None] * m[at], first[:-1], axis=0)


def _sums(rows: DataFrame, m: np.ndarray, solve) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass over the rows v with y = solve(v m): the sums of v' y by term, of y' y, and of v v'.

    Tasks add up their own rows; sums by term are put together in Spark.
    """
    n, l = m.shape
    held = rows.sparkSession.sparkContext.broadcast((m, solve))
    names = [f"c{j}" for j in range(l)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m_, solve_ = held.value
        total, gram, square = np.zeros((n, l)), np.zeros((l, l)), 0.0
        for _, first, at, x in _blocks(batches):
            y = solve_(_times(first, at, x, m_))
            each = np.repeat(y, np.diff(first), axis=0) * x[:, None]
            for j in range(l):
                total[:, j] += np.bincount(at, each[:, j], minlength=n)
            gram += y.T @ y
            square += float(x @ x)
        some = np.flatnonzero(total.any(axis=1))
        values = np.concatenate([total[some], gram, np.pad([[square]], ((0, 0), (0, l - 1)))])
        places = np.concatenate([some, -1 - np.arange(l), [-1 - l]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(places), *(pa.array(values[:, j]) for j in range(l))], names=["t", *names])

    parts = rows.mapInArrow(run, "t int, " + ", ".join(f"{c} double" for c in names))
    out = parts.groupBy("t").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    places = out.column("t").to_numpy()
    values = np.stack([out.column(c).to_numpy() for c in names], axis=1)
    total, gram = np.zeros((n, l)), np.zeros((l, l))
    total[places[places >= 0]] = values[places >= 0]
    for j in range(l):
        gram[j] = values[places == -1 - j][0]
    return total, gram, float(values[places == -1 - l][0, 0])


def _same(y: np.ndarray) -> np.ndarray:
    return y


class _Rows:
    """Loadings of rows, given the Gram matrix of the terms' factors."""

    def __init__(self, gram: np.ndarray) -> None:
        self.gram = gram

    def __call__(self, a: np.ndarray) -> np.ndarray:
        return non_negative(a, self.gram)


def _start(rows: DataFrame, n_terms: int, k: int, mean: float) -> np.ndarray:
    """Terms' factors to begin with, from the singular vectors of a randomized range finder: the larger of the positive
    and the negative part of each, zeros filled with the mean."""
    rng = np.random.default_rng(SEED)
    q = np.linalg.qr(rng.normal(size=(n_terms, min(k + MORE, n_terms))))[0]
    for _ in range(POWERS):
        q = np.linalg.qr(_sums(rows, q, _same)[0])[0]
    _, gram, _ = _sums(rows, q, _same)
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(-values)[:k]
    right, strength = q @ vectors[:, order], np.sqrt(np.maximum(values[order], 0))
    held = rows.sparkSession.sparkContext.broadcast(right)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = np.zeros(k), np.zeros(k)
        for _, first, at, x in _blocks(batches):
            y = _times(first, at, x, held.value)
            up += (np.maximum(y, 0) ** 2).sum(axis=0)
            down += (np.maximum(-y, 0) ** 2).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.array(up), pa.array(down)], names=["j", "up", "down"])

    norms = {r.j: (r.up**0.5, r.down**0.5) for r in rows.mapInArrow(parts, "j int, up double, down double").groupBy("j").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).collect()}
    h = np.zeros((k, n_terms))
    for j in range(k):
        v = right[:, j]
        sides = [(norms[j][0], np.maximum(v, 0)), (norms[j][1], np.maximum(-v, 0))]
        left, side = max(sides, key=lambda s: s[0] * np.linalg.norm(s[1]))
        size = np.linalg.norm(side)
        if size > 0 and strength[j] > 0:
            h[j] = np.sqrt(left * size) * side / size
    h[h < 1e-12] = max(mean, 1e-9)
    return h


def factorize(weights: DataFrame, key: str, k: int, term: str = "term", value: str = "weight", rounds: int = 60, tolerance: float = 1e-4) -> Topics:
    """Non-negative factors of a sparse matrix (key, term, value > 0), a row of it for each key.

    Each round is one pass over the rows: with the terms' factors of the round before, a row's loadings are solved for
    by themselves, and only sums by term and a k x k matrix are added up; the terms' factors follow from those. What
    the driver holds is `k` numbers a term (at most MOST_TERMS), never rows. Rounds end when the residual falls
    by less than `tolerance` of itself. k is at most the rows less one, and the terms. A key's entries are expected once
    for each term; keys without positive entries have no row. An empty matrix has no components.
    """
    entries = weights.select(F.col(key), F.col(term).alias("_term"), F.col(value).cast("double").alias("x")).filter("x > 0 AND _term IS NOT NULL")
    terms = [r._term for r in entries.select("_term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(terms) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms")
    terms = sorted(terms)
    spark = weights.sparkSession
    places = spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "_term string, t int")
    rows = entries.join(F.broadcast(places), "_term").groupBy(key).agg(F.collect_list(F.struct("t", "x")).alias("entries"))
    return factors(rows, terms, key, k, rounds, tolerance)


def factors(rows: DataFrame, terms: list[str], key: str, k: int, rounds: int = 60, tolerance: float = 1e-4) -> Topics:
    """`factorize` of rows (key, entries (t, x > 0)) as they are, t the place of a term among `terms`; no row is empty."""
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    if len(terms) > MOST_TERMS:
        raise ValueError(f"over {MOST_TERMS} terms")
    # as many tasks as cores: what a pass sends, a row of each term from each task, doesn't grow with the rows
    rows = kept(rows).coalesce(spark.sparkContext.defaultParallelism)
    count, mean = rows.agg(F.count(F.lit(1)), F.sum(F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["x"]))).first()
    k = min(k, max(count - 1, 1), len(terms))
    if not terms or k < 1:
        return Topics([], np.zeros((0, 0)), spark.createDataFrame([], f"`{key}` {kind}, component int, loading double"), 0.0, 0)
    h = _start(rows, len(terms), k, mean / count / len(terms))
    last, done = np.inf, 0
    for done in range(1, rounds + 1):
        gram = h @ h.T
        to_terms, own, square = _sums(rows, h.T.copy(), _Rows(gram))
        residual = max(square - 2 * float((h.T * to_terms).sum()) + float((own * gram).sum()), 0.0) / max(square, 1e-300)
        if last - residual < tolerance * residual:
            break
        last = residual
        h = non_negative(to_terms, own).T.copy()
        h[:, :] = np.where(h.any(axis=1, keepdims=True), h, 1e-9)
    held = spark.sparkContext.broadcast((h.T.copy(), _Rows(h @ h.T)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, solve = held.value
        for keys, first, at, x in _blocks(batches):
            y = solve(_times(first, at, x, m))
            row, component = np.nonzero(y)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(component.astype(np.int32)), pa.array(y[row, component])], names=[key, "component", "loading"])

    return Topics(terms, h, rows.mapInArrow(load, f"`{key}` {kind}, component int, loading double"), residual, done)


def emergent(topics: Topics, most: int) -> list[tuple[int, str, float]]:
    """(component, term, weight) of the terms that name each component, none holding another or held by it."""
    out = []
    for j, w in enumerate(topics.weights):
        named = {t: float(x) for t, x in zip(topics.terms, w, strict=True) if x > 1e-9}
        out += [(j, t, named[t]) for t in mining.labels(named, most)]
    return out


@dataclass
class ConceptMap:
    """concepts (component, concept, origin, weight, df, sources); evidence (concept, place, key, source) of each, at most five,
    and edges (left, right, shared, sources, evidence), each with at most eight keys of different sources."""

    concepts: DataFrame
    evidence: DataFrame
    edges: DataFrame
    topics: Topics


def concept_map(docs: DataFrame, key: str, text: str, source: str, queries: DataFrame, query_text: str, stop: list[str], k: int = 7, per_component: int = 6, min_df: int = 3, min_sources: int = 2, most_edges: int = 30, edge_evidence: int = 8, concept_evidence: int = 5) -> ConceptMap:
    """Concepts of documents: topics of their terms, named by terms of the topic and by phrases of the queries (anchors).

    An anchor goes to the component of its largest mean loading; of each component the first `per_component` - 2 anchors
    and `per_component` terms are candidates, anchors first. A name that holds another, or is held by one, of a component
    before it or of its own is left out. A concept has to occur literally in `min_df` documents of `min_sources` sources.
    Two concepts are linked if they share documents of two sources. Evidence is the best document of each source first.
    Names are at most 2 * `per_component` a component, so the driver holds those alone.
    """
    spark = docs.sparkSession
    topics = factors(*mining.weighed(docs, key, text, stop, min_df=min_df), key, k)
    loadings = kept(topics.loadings)
    phrases = mining.query_anchors(queries, query_text, docs, key, text, source, stop, min_df, min_sources).select("phrase").checkpoint()
    met, listed = mining.held(phrases, docs, key, text, source)
    mean = met.select(key, "grams").join(loadings, key).select("component", "loading", F.inline("grams")).groupBy("h", "n", "component").agg(F.avg("loading").alias("mean"))
    homes = mining.nearest(mining.spelled(mean, listed))
    place = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("mean"), "phrase"))
    anchors = homes.withColumn("_p", place).filter(F.col("_p") <= max(1, per_component - 2)).orderBy("component", "_p").collect()
    claimed: list[tuple[int, str, str, float]] = []
    for j in range(len(topics.weights)):
        names = [(a.phrase, "scope_anchor", float(a["mean"])) for a in anchors if a.component == j]
        names += [(t, "emergent", w) for c, t, w in emergent(topics, per_component) if c == j]
        for name, origin, weight in names:
            if not any(name in held or held in name for _, held, _, _ in claimed):
                claimed.append((j, name, origin, weight))
    named = spark.createDataFrame(claimed, "component int, phrase string, origin string, weight double")
    rows, listed = mining.held(named, docs, key, text, source)
    rows = kept(rows)
    found = mining.spelled(rows.select(key, source, F.inline("grams")), listed)
    per = mining.spread(rows, listed, key, source).filter((F.col("df") >= min_df) & (F.col("sources") >= min_sources))
    concepts = named.join(per, "phrase").select("component", F.col("phrase").alias("concept"), "origin", "weight", "df", "sources").checkpoint()
    own = found.join(F.broadcast(concepts.select(F.col("concept").alias("phrase"), "component")), "phrase").select(F.col("phrase").alias("concept"), "component", key, source)
    scored = own.join(loadings, [key, "component"], "left").select("concept", F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce("loading", F.lit(0.0)).alias("loading"))
    evidence = mining.source_diverse(scored, "concept", "source", "loading", "key", concept_evidence).select("concept", "place", "key", "source")
    met = own.select("concept", F.col(key).alias("fragment"), F.col(source).alias("source"))
    return ConceptMap(concepts, evidence, edges_with_evidence(met, most=most_edges, evidence=edge_evidence), topics)


def edges_with_evidence(occurrences: DataFrame, least_sources: int = 2, most: int = 30, evidence: int = 8) -> DataFrame:
    """`mining.cooccurrence` with `evidence`: the first fragment of each source, in order of fragment, up to so many."""
    met = kept(mining.pairs(occurrences))
    edges = mining.linked(met, least_sources, most).checkpoint()
    few = F.broadcast(edges.select("left", "right"))  # at most `most` edges
    first = met.join(few, ["left", "right"]).select("left", "right", "source", F.col("first").alias("fragment"))
    place = F.row_number().over(Window.partitionBy("left", "right").orderBy("fragment"))
    listed = first.withColumn("_p", place).filter(F.col("_p") <= evidence).groupBy("left", "right").agg(F.array_sort(F.collect_list("fragment")).alias("evidence"))
    return edges.join(listed, ["left", "right"])
