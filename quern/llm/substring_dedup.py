"""Substring dedup: stretches of words that occur more than once, from a compressed FM-index per shard.

A window is `window` consecutive words. Its anchor is the run of GRAM words with the least hash in it, so
equal windows have equal anchors at the same place. The windows of a document that share an anchor form a
segment. Segments are dealt to shards by anchor, so all copies of a window meet in one shard, and no
document has to be held against every shard. Anchors that occur once in the corpus are dropped before any
text moves, and equal segments are merged with a count before they are indexed. In a shard an FM-index of
the distinct segments is built, the segments are streamed through it, and their matching statistics give
the stretches whose occurrences count two or more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.fm_index import FMIndex
from quern.llm.shared import cut, row_key, small

WINDOW = 35
GRAM = 8
#: Repeated anchors (8 bytes each) that may be broadcast; beyond it they are joined to the documents.
ANCHOR_ROWS = 4_000_000
#: Words indexed in a shard, about; and distinct segments of an anchor beyond which its windows are dealt out one by one.
SHARD_WORDS = 300_000
ANCHOR_SEGMENTS = 2048

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64(0xFFFFFFFF)


def _grams(h: np.ndarray) -> np.ndarray:
    """Hashes of the runs of GRAM words, by doubling."""
    span = 1
    while span < GRAM:
        h = W.mix(h[:-span] * np.uint64(3) + h[span:])
        span *= 2
    return h


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours: minima from the left and from the right of each stretch of `width`."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    grid = padded.reshape(-1, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def segments(words: W.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, last window, anchor) of each segment; windows are numbered by their first word."""
    h = words.hashes
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, np.zeros(0, np.uint64)
    grams = _grams(h)
    least = _least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), window - GRAM + 1)
    ends = np.repeat(words.first[1:], np.diff(words.first))
    start = np.flatnonzero(np.arange(len(least)) + window <= ends[: len(least)])
    if len(start) == 0:
        return none, none, none, np.zeros(0, np.uint64)
    place = (least[start] & _LOW).astype(np.int64)
    opens = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    closes = np.concatenate((opens[1:], [len(start)])) - 1
    s0, s1 = start[opens], start[closes]
    return np.searchsorted(words.first, s0, side="right") - 1, s0, s1, grams[place[opens]]


def _spans_hash(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of h[lo:hi], from one running sum."""
    power = np.cumprod(np.full(len(h), _BASE, np.uint64))
    back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(len(h), _BACK, np.uint64))))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power)))
    return W.mix((total[hi] - total[lo]) * back[lo] + (hi - lo).astype(np.uint64))


def _anchor_counts(window: int, by_document: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for a, b, buf, offs in W.slices(batch.column(1)):
                doc, _, _, anchor = segments(W.cut(buf, offs), window)
                if by_document:
                    yield pa.RecordBatch.from_arrays([keys.slice(a, b - a).take(pa.array(doc)), pa.array(anchor.view(np.int64))], names=["k", "anchor"])
                else:
                    found, n = np.unique(anchor, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    return run


KEY = "struct<a:bigint,b:bigint>"
OCCURRENCES = f"anchor long, seg long, k {KEY}, start int, n_words int, words string"


def _occurrences(window: int, known):
    """Segments whose anchor is repeated; `known` broadcasts the sorted anchors, or a third column lists a document's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for a, b, buf, offs in W.slices(batch.column(1)):
                words = W.cut(buf, offs)
                doc, s0, s1, anchor = segments(words, window)
                if known is not None:
                    wanted = known.value
                else:
                    wanted = np.unique(batch.column(2).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                if len(anchor) == 0 or len(wanted) == 0:
                    continue
                at = np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)
                hit = wanted[at] == anchor
                doc, s0, s1, anchor = doc[hit], s0[hit], s1[hit], anchor[hit]
                if len(doc) == 0:
                    continue
                to = s1 + window
                seg = _spans_hash(words.hashes, s0, to)
                text = buf.tobytes()
                parts = [text[x:y].decode() for x, y in zip(words.starts[s0].tolist(), words.ends[to - 1].tolist(), strict=True)]
                columns = [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), keys.slice(a, b - a).take(pa.array(doc)), pa.array((s0 - words.first[doc]).astype(np.int32)), pa.array((to - s0).astype(np.int32)), pa.array(parts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "seg", "k", "start", "n_words", "words"])

    return run


def _windows(window: int):
    """(anchor, seg, n, words) to a row per window: (anchor, seg, at, key, n, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in W.slices(batch.column(3), 1 << 18):
                words = W.cut(buf, offs)
                many = np.maximum(np.diff(words.first) - window + 1, 0)
                owner = np.repeat(np.arange(b - a), many)
                at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
                s = words.first[owner] + at
                text = buf.tobytes()
                parts = [text[x:y].decode() for x, y in zip(words.starts[s].tolist(), words.ends[s + window - 1].tolist(), strict=True)]
                pick = pa.array(owner + a)
                key = _spans_hash(words.hashes, s, s + window)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)), batch.column(2).take(pick), pa.array(parts, pa.string())], names=["anchor", "seg", "at", "key", "n", "words"])

    return run


def _search(window: int):
    """One shard: index its distinct segments, stream them through the index, report the repeated stretches."""

    def run(shard: pa.Table) -> pa.Table:
        column = shard.column("words").combine_chunks()
        data = column.cast(pa.large_string())
        parts = [W.cut(buf, offs) for _, _, buf, offs in W.slices(data, 1 << 62)]
        words = parts[0]
        names, symbols = np.unique(words.hashes, return_inverse=True)
        symbols = symbols.astype(np.int64) + 1
        weights = np.minimum(shard.column("n").to_numpy(), 2).astype(np.int64)
        index = FMIndex(symbols, words.first, weights, int(np.diff(words.first).max(initial=1)) + 1)
        found = index.repeated(symbols, words.first, window)
        which = pa.array([f[0] for f in found], pa.int64())
        return pa.table({"anchor": shard.column("anchor").take(which), "seg": shard.column("seg").take(which), "lo": pa.array([f[1] for f in found], pa.int32()), "hi": pa.array([f[2] for f in found], pa.int32())})

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, spans) to the row with n_words, n_removed and the kept words joined by one space."""
    schema = pa.schema([("k", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            n_words, n_removed, texts = [], [], []
            spans = part.column(2)
            for i in range(part.num_rows):
                value = part.column(1)[i]
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                n_words.append(len(words))
                if spans[i].is_valid and len(spans[i]):
                    cover = np.zeros(len(words) + 1, np.int32)
                    pairs = spans[i].values
                    np.add.at(cover, pairs.field(0).to_numpy(), 1)
                    np.add.at(cover, pairs.field(1).to_numpy(), -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    words = list(compress(words, keep.tolist()))
                n_removed.append(n_words[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], schema=schema)


def repeated_spans(keyed: DataFrame, window: int) -> DataFrame:
    """(k, text) to (k, lo, hi): words covered by windows whose word sequence also starts elsewhere in the rows."""
    spark = keyed.sparkSession
    counts = keyed.mapInArrow(_anchor_counts(window, False), "anchor long, n long")
    repeated = cut(counts.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"), "anchors")
    if repeated.count() <= ANCHOR_ROWS:
        known = spark.sparkContext.broadcast(np.sort(repeated.toPandas()["anchor"].to_numpy(np.int64).view(np.uint64)))
        source = keyed
    else:
        known = None
        own = keyed.mapInArrow(_anchor_counts(window, True), f"k {KEY}, anchor long").distinct()
        own = own.join(repeated, "anchor").groupBy("k").agg(F.collect_list("anchor").alias("anchors"))
        source = keyed.join(own, "k")
    found = cut(source.mapInArrow(_occurrences(window, known), OCCURRENCES), "segments")
    distinct = found.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words"), F.first("n_words").alias("n_words"))
    distinct = cut(distinct, "distinct-segments")
    per_anchor = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("segs"), F.sum("n").alias("all"), F.sum("n_words").alias("w"))
    # an anchor whose windows' segments all occur once and alone has nothing repeated
    per_anchor = per_anchor.filter("all > 1")
    hot = per_anchor.filter(F.col("segs") > ANCHOR_SEGMENTS).select("anchor")
    n_hot, total = per_anchor.agg(F.count_if(F.col("segs") > ANCHOR_SEGMENTS), F.coalesce(F.sum("w"), F.lit(0))).first()
    shards = max(1, -(-int(total) // SHARD_WORDS))
    result = "anchor long, seg long, lo int, hi int"
    cold = distinct.select("anchor", "seg", "n", "words").join(small(hot, n_hot), "anchor", "left_anti") if n_hot else distinct.select("anchor", "seg", "n", "words")
    cold = cold.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    stretches = cold.groupBy("shard").applyInArrow(_search(window), result)
    if n_hot:
        single = distinct.select("anchor", "seg", "n", "words").join(small(hot, n_hot), "anchor", "left_semi")
        single = cut(single.mapInArrow(_windows(window), "anchor long, seg long, at int, key long, n long, words string"), "windows")
        merged = single.groupBy("key").agg(F.sum("n").alias("n"), F.first("words").alias("words"), F.count(F.lit(1)).alias("_"))
        merged = merged.select(F.col("key").alias("anchor"), F.col("key").alias("seg"), "n", "words")
        parts = max(1, -(-single.count() * window // SHARD_WORDS))
        met = merged.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(parts))).groupBy("shard").applyInArrow(_search(window), result)
        met = cut(met.select(F.col("seg").alias("key")).distinct(), "hot-windows")
        more = single.join(met, "key").select("anchor", "seg", F.col("at").alias("lo"), (F.col("at") + window).cast("int").alias("hi"))
        stretches = stretches.unionByName(more)
    stretches = cut(stretches, "stretches")
    return found.select("anchor", "seg", "k", "start").join(stretches, ["anchor", "seg"]).select("k", (F.col("start") + F.col("lo")).cast("int").alias("lo"), (F.col("start") + F.col("hi")).cast("int").alias("hi"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Every row of `docs` with n_words, n_removed and kept_text.

    A word is removed if a window over it has a word sequence that also starts anywhere else, the same
    document included; windows are judged on the input. Words are compared unchanged. A null or empty
    text has no words and an empty kept_text. Repeated rows are occurrences of their own, so both lose
    what they share. Columns named like those added are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "kept_text")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), row_key(*[c for c in ("doc_id", text) if c in docs.columns]).alias("_k"))
    spans = repeated_spans(keyed.select(F.col("_k").alias("k"), F.col("_row")[text].cast("string").alias("text")), window)
    spans = spans.distinct().groupBy("k").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    joined = keyed.join(spans.withColumnRenamed("k", "_k"), "_k", "left")
    others = [c for c in docs.columns if c != text]
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in others) + f", `{text}` string, n_words long, n_removed long, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            n = len(others)
            for part in _kept(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(n), batch.column(n + 1)], names=["k", "t", "s"])])):
                own = batch.slice(at, part.num_rows)
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in range(n + 1)], *part.columns[1:]], names=[*others, text, "n_words", "n_removed", "kept_text"])

    return joined.select(*[F.col("_row")[c].alias(c) for c in others], F.col("_row")[text].cast("string").alias(text), F.col("_spans").alias("_found_spans")).mapInArrow(run, schema)


