"""Numpy parts that the classifiers share: samples, hashed terms, calibration, held-out splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.shared import cut, small


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def bounded_sample(rows: DataFrame, most: int, by: str = "doc_id") -> DataFrame:
    """At most about `most` rows, spread evenly by a hash of `by`; all of them if there are no more."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(drawn(by) < int(most * (1 << 62) / n))


def drawn(by: str) -> Column:
    """A number from 0 to 2**62 - 1 by a hash of `by`."""
    return F.pmod(F.xxhash64(F.col(by), F.lit(11)), F.lit(1 << 62))


def even_sample(rows: DataFrame, most: int, kind: str, by: str = "doc_id") -> DataFrame:
    """At most about `most` rows, as many of each `kind` as there are, up to an even share; what small kinds leave is reshared.

    Kinds may be many: they are counted in Spark, and the driver gets sums by the size class of their counts.
    """
    counts = cut(rows.groupBy(F.col(kind).alias("_kind")).agg(F.count(F.lit(1)).alias("_n")), "kinds")
    classes = counts.groupBy(F.length(F.bin("_n")).alias("c")).agg(F.count(F.lit(1)).alias("kinds"), F.sum("_n").alias("n")).orderBy("c").collect()  # 63 rows at most
    kinds, below, level = sum(c.kinds for c in classes), 0, 0.0
    for c in classes:
        level = max((most - below) / kinds, 0.0)
        if level < 1 << c.c - 1 or level < (1 << c.c) - 1 and c is not classes[-1]:
            break
        below, kinds = below + c.n, kinds - c.kinds
        if not kinds:
            return rows
    bar = (F.least(F.lit(1.0), F.lit(level) / F.col("_n")) * F.lit(float(1 << 62))).cast("long")
    limits = small(counts.select("_kind", bar.alias("_bar")), counts.count())
    return rows.join(limits, F.col(kind) == F.col("_kind")).filter(drawn(by) <= F.col("_bar")).drop("_bar", "_kind")


def terms(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Bins of words by their hashes."""
    return (hashes >> np.uint64(40)).astype(np.int64) % bins


def word_runs(column: pa.Array):
    """(first row, last row + 1, Words in lower case) of slices of a text column."""
    for a, b, buf, offs in W.slices(column):
        yield a, b, W.cut(buf, offs, lower=True)


def word_stems(words: W.Words, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of words without the punctuation at their edges, whole and cut to each of `lengths` bytes.

    A word's hash is a sum over its bytes, so one running sum over the bytes gives every cut of every word.
    """
    buf, starts, ends = words.buf, words.starts.copy(), words.ends.copy()
    if len(starts) == 0:
        return [words.hashes] * (1 + len(lengths))
    plain = _PLAIN[buf]
    for _ in range(4):
        ends -= (ends - starts > 1) & ~plain[ends - 1]
        starts += (ends - starts > 1) & ~plain[starts]
    inside = np.zeros(len(buf) + 1, np.int32)
    inside[starts] += 1
    inside[ends] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    place = at - np.repeat(starts, ends - starts)
    values = np.zeros(len(buf) + 1, np.uint64)
    values[at + 1] = W._TABLE[((place & (W._POSITIONS - 1)) << 8) | buf[at]]
    total = np.cumsum(values)
    return [W.mix(total[np.minimum(ends, starts + n)] - total[starts] + np.uint64(k)) for k, n in enumerate((1 << 40, *lengths))]


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


#: Scores beyond this are as sure as scores can be.
MOST_SURE = 12.0


def calibrate(scores: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Platt scaling: (a, b) such that logistic(a * score + b) is near the labels, on smoothed targets.

    Newton steps of bounded length, and a held near 1, so that labels which a score splits clean don't
    make it a step function. Scores have to be clipped to MOST_SURE when the scale is applied.
    """
    scores = np.clip(scores, -MOST_SURE, MOST_SURE)
    up, down = float(labels.sum()), float(len(labels) - labels.sum())
    goal = np.where(labels > 0, (up + 1) / (up + 2), 1 / (down + 2))
    at = np.array([1.0, 0.0])
    x = np.stack((scores, np.ones(len(scores))), axis=1)
    for _ in range(rounds):
        p = logistic(x @ at)
        g = x.T @ (p - goal) + np.array([at[0] - 1.0, 1e-6 * at[1]])
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1e-6]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        at -= step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])
