"""Line dedup: a sharded minimal perfect hash over line hashes, with fingerprint and holder arrays that documents probe.

1. One pass over the texts hashes the key of each line (128 bits) and counts the documents of each key, with
   the largest doc_id that holds it. Keys of fewer code points than `LEAST_LENGTH` are not hashed.
2. The keys found in enough documents are dealt into shards. A shard is a minimal perfect hash (a few bits a
   key: levels of bit vectors with rank counts) from the first half of a line hash to a place in arrays: the
   second half as fingerprint, the count, and the document that keeps its lines. A line that is no key fails
   its fingerprint, all 64 bits of it.
3. Documents probe the arrays. If those are within `HELD_KEYS` keys they are sent to the executors once and
   no line is shuffled. Beyond it each block of documents sends the distinct hashes of its lines to the
   shards, a row of packed hashes per block and shard, and gets back those that hit: a line of a third of all
   documents is asked for once per block. The block's answers then meet its documents again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.shared import cut

LEAST_LENGTH = 40
LEAST_DOCS = 5
#: Keys that executors hold at once (28 bytes each); with more, probes go to the shards.
HELD_KEYS = 2_000_000
SHARD_KEYS = 100_000
#: Where probes go to the shards: bytes of text of a block of documents, and of text a shard, about.
BLOCK_BYTES = 4 << 20
SHARD_TEXT = 256 << 20
#: Bits of a level for each key left: fewer give a smaller index, more give fewer levels.
GAMMA = 2

#: A document without an id comes before all others.
NO_ID = -(1 << 63)
_SECOND = np.random.default_rng(0x11E5).integers(0, 1 << 64, size=64 * 256, dtype=np.uint64)
_SEED = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Lines:
    """Lines of a run of documents: bounds in bytes, where each document's lines begin, and key hashes of the long ones."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(documents) + 1
    long: np.ndarray  # indices of lines whose key is long enough
    a: np.ndarray
    b: np.ndarray


def lines_of(buf: np.ndarray, offs: np.ndarray, least: int = LEAST_LENGTH) -> Lines:
    """Cut the bytes of several documents into lines and hash their keys (stripped, A-Z lower-cased)."""
    n, docs = len(buf), len(offs) - 1
    breaks = np.flatnonzero(buf == 10)
    # a document ends its last line at its own end, a line break ends any other
    ends = np.sort(np.concatenate([breaks, offs[1:]]), kind="stable")
    counts = np.searchsorted(breaks, offs[1:]) - np.searchsorted(breaks, offs[:-1]) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    # ties of a break at a document's end: the break is inside the document, so it sorts at most at offs[k + 1] - 1
    starts = np.empty(len(ends), np.int64)
    starts[1:] = ends[:-1] + 1
    starts[first[:-1]] = offs[:-1]
    solid = W._IS_WORD[buf] if n else np.zeros(0, bool)
    at = np.flatnonzero(solid)
    lo, hi = np.searchsorted(at, starts), np.searchsorted(at, ends)
    some = np.flatnonzero(hi > lo)
    left, right = at[lo[some]], at[hi[some] - 1] + 1
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)]) if n else np.zeros(1, np.int64)
    enough = points[right] - points[left] >= least
    some, left, right = some[enough], left[enough], right[enough]
    if not len(some):
        none = np.zeros(0, np.uint64)
        return Lines(starts, ends, first, some, none, none)
    return Lines(starts, ends, first, some, *_hashes(buf, left, right))


def _hashes(buf: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each line by sums over (place, byte); a long line is summed a stretch at a time."""
    sums = np.zeros((2, len(left)), np.uint64)
    line, at = 0, left[0]
    while line < len(left):
        to = max(line + 1, int(np.searchsorted(np.cumsum(right[line:] - left[line:]), W.CHUNK_BYTES, side="right")) + line) if at == left[line] else line + 1
        lo, hi = left[line:to].copy(), right[line:to].copy()
        lo[0] = at
        hi[-1] = min(hi[-1], lo[-1] + W.CHUNK_BYTES)
        lengths = hi - lo
        begins = np.cumsum(lengths) - lengths
        step = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(begins, lengths)
        byte = W.LOWER_ASCII[buf[np.repeat(lo, lengths) + step]].astype(np.int64)
        place = step + np.repeat(lo - left[line:to], lengths)
        slot, far = ((place & 63) << 8) | byte, place >= 64
        beyond = W._FAR * (place[far] // 64).astype(np.uint64)
        for k, table in enumerate((W._TABLE, _SECOND)):
            values = table[slot]
            values[far] = W.mix(values[far] + beyond)
            sums[k, line:to] += np.add.reduceat(values, begins)
        if hi[-1] < right[to - 1]:
            line, at = to - 1, hi[-1]
        else:
            line, at = to, left[to] if to < len(left) else 0
    size = (right - left).astype(np.uint64)
    return W.mix(sums[0] + size), W.mix(sums[1] + size)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of bit vectors; a key's place is the rank of its bit."""

    def __init__(self, keys: np.ndarray | None = None) -> None:
        self.bits: list[np.ndarray] = []
        left, level = keys, 0
        while left is not None and len(left):
            size = max(64, -(-GAMMA * len(left) // 64) * 64)
            at = self._at(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left = left[~alone[at]]
            level += 1
        self._rank()

    def _rank(self) -> None:
        self.offsets = np.concatenate([[0], np.cumsum([int(b.sum()) for b in self.bits])]).astype(np.int64)
        self.ranks = [np.concatenate([[0], np.cumsum(b.reshape(-1, 64).sum(axis=1))]) for b in self.bits]
        self.packed = [np.packbits(b.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel() for b in self.bits]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * int(_SEED) & (1 << 64) - 1)
        return (W.mix(keys ^ seed) % np.uint64(size)).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; of a key that was not indexed any place, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.packed):
            if not len(open_):
                break
            at = self._at(keys[open_], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[open_[hit]] = self.offsets[level] + self.ranks[level][at[hit] >> 6] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.packed), *(len(w) for w in self.packed)], np.int64)
        return head.tobytes() + b"".join(w.tobytes() for w in self.packed)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1)
        out = cls()
        for size in sizes:
            words = np.frombuffer(data, np.uint64, int(size), at)
            out.bits.append(np.unpackbits(words.view(np.uint8), bitorder="little").astype(bool))
            at += 8 * int(size)
        out._rank()
        out.bits = []  # the packed form serves from here on
        return out


class Shard:
    """A perfect hash with its arrays: fingerprint, count of documents, and the document that keeps its lines."""

    def __init__(self, index: bytes, prints: bytes, counts: bytes, holders: bytes) -> None:
        self.index = PerfectHash.unpack(index)
        self.prints, self.counts, self.holders = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int32), np.frombuffer(holders, np.int64)

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each line hash is a key, and the document that keeps it."""
        at = self.index.places(a)
        found = at >= 0
        found[found] = self.prints[at[found]] == b[found]
        return found, self.holders[np.where(found, at, 0)] if len(self.holders) else np.zeros(len(a), np.int64)


def _shard_of(a: np.ndarray, shards: int) -> np.ndarray:
    return ((a >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def line_keys(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """doc_id, a, b: the distinct long keys of each row of documents, as hashes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for at, to, buf, offs in W.slices(batch.column(1)):
                found = lines_of(buf, offs, least_length)
                if not len(found.long):
                    continue
                doc = np.searchsorted(found.first, found.long, side="right") - 1
                rows = np.unique(np.rec.fromarrays([doc, found.a, found.b], names="d,a,b"))
                yield pa.record_batch([pa.array(ids[at:to][rows.d]), pa.array(_signed(np.ascontiguousarray(rows.a))), pa.array(_signed(np.ascontiguousarray(rows.b)))], names=["doc_id", "a", "b"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, a long, b long")


def repeated_keys(docs: DataFrame, least_docs: int = LEAST_DOCS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """a, b, n, holder: keys found in at least so many documents, and the largest doc_id with it."""
    held = line_keys(docs, least_length).groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one"))
    return held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder")).filter(F.col("n") >= least_docs)


def build(keys: DataFrame, shards: int) -> DataFrame:
    """shard, index, prints, counts, holders: one row a shard."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        # two keys with equal first halves (once in 2**64 / n pairs) can't share a perfect hash: fail, never drop one
        a = np.ascontiguousarray(rows["a"].to_numpy()).view(np.uint64)
        if len(np.unique(a)) != len(a):
            raise ValueError("two line hashes of a shard agree in their first 64 bits")
        index = PerfectHash(a)
        order = np.empty(len(a), np.int64)
        order[index.places(a)] = np.arange(len(a))
        return pd.DataFrame({
            "shard": [int(rows["shard"].iloc[0])], "index": [index.pack()], "prints": [rows["b"].to_numpy()[order].tobytes()],
            "counts": [rows["n"].to_numpy()[order].clip(max=2**31 - 1).astype(np.int32).tobytes()], "holders": [rows["holder"].to_numpy()[order].tobytes()],
        })

    shard = F.pmod(F.shiftrightunsigned("a", 33), F.lit(shards))
    return keys.withColumn("shard", shard).groupBy("shard").applyInPandas(one, "shard long, index binary, prints binary, counts binary, holders binary")


def _kept(batch: pa.RecordBatch, least: int, probe) -> pa.RecordBatch:
    """The rows of a batch (id, text, ...) with their lines counted and dropped."""
    ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    counts, dropped, texts = [], [], []
    for at, to, buf, offs in W.slices(batch.column(1)):
        found = lines_of(buf, offs, least)
        doc = np.searchsorted(found.first, found.long, side="right") - 1
        hit, holder = probe(found.a, found.b)
        gone = np.zeros(len(found.starts), bool)
        gone[found.long[hit & (holder != ids[at:to][doc])]] = True
        total = np.concatenate([[0], np.cumsum(gone)])
        n = total[found.first[1:]] - total[found.first[:-1]]
        counts.append(np.diff(found.first))
        dropped.append(n)
        data = buf.tobytes()
        for k in range(to - at):
            if n[k]:
                own = range(found.first[k], found.first[k + 1])
                texts.append(b"\n".join(data[found.starts[i] : found.ends[i]] for i in own if not gone[i]))
            else:
                texts.append(data[offs[k] : offs[k + 1]])
    empty = np.zeros(0, np.int64)
    kept = pa.array(texts, pa.binary()).cast(pa.string()) if sum(map(len, texts)) < 1 << 30 else pa.array(texts, pa.large_binary()).cast(pa.large_string())
    return pa.record_batch([batch.column(0), pa.array(np.concatenate([*counts, empty])), pa.array(np.concatenate([*dropped, empty])), kept], names=["doc_id", "n_lines", "n_dropped", "kept_text"])


_SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_text string"


def _held(docs: DataFrame, shards: list, n: int, least: int) -> DataFrame:
    """Probe arrays that every executor holds."""
    sent = docs.sparkSession.sparkContext.broadcast([(s["shard"], bytes(s["index"]), bytes(s["prints"]), bytes(s["counts"]), bytes(s["holders"])) for s in shards])

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {s: Shard(*arrays) for s, *arrays in sent.value}

        def probe(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            hit, holder, own = np.zeros(len(a), bool), np.zeros(len(a), np.int64), _shard_of(a, n)
            for s, shard in held.items():
                if len(at := np.flatnonzero(own == s)):
                    hit[at], holder[at] = shard.probe(a[at], b[at])
            return hit, holder

        for batch in batches:
            yield _kept(batch, least, probe)

    return docs.mapInArrow(drop, _SCHEMA)


def _asked(docs: DataFrame, shards: DataFrame, n: int, least: int) -> DataFrame:
    """Probe arrays by shard: blocks of documents send packed hashes and get their hits back."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, to, _, _ in W.slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(at, to - at)
                yield pa.record_batch([*part.columns, pa.array(np.full(to - at, block))], names=["doc_id", "text", "block"])
                block += 1

    placed = cut(docs.mapInArrow(number, "doc_id long, text string, block long"), "blocks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(2).to_numpy(zero_copy_only=False)
            for at, to, buf, offs in W.slices(batch.column(1)):
                found = lines_of(buf, offs, least)
                doc = np.searchsorted(found.first, found.long, side="right") - 1
                rows = np.unique(np.rec.fromarrays([_shard_of(found.a, n), block[at:to][doc], found.a, found.b], names="s,k,a,b"))
                if not len(rows):
                    continue
                edge = np.flatnonzero(np.concatenate([[True], (rows.s[1:] != rows.s[:-1]) | (rows.k[1:] != rows.k[:-1])]))
                a, b = np.ascontiguousarray(rows.a), np.ascontiguousarray(rows.b)
                to_ = [*edge[1:], len(rows)]
                yield pa.record_batch([pa.array(rows.s[edge]), pa.array(rows.k[edge]), pa.array([a[i:j].tobytes() for i, j in zip(edge, to_, strict=True)]), pa.array([b[i:j].tobytes() for i, j in zip(edge, to_, strict=True)])], names=["shard", "block", "a", "b"])

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in held.itertuples():
            shard = Shard(row.index_, row.prints, row.counts, row.holders)
            for q in asked.itertuples():
                a, b = np.frombuffer(q.a, np.uint64), np.frombuffer(q.b, np.uint64)
                hit, holder = shard.probe(a, b)
                if hit.any():
                    out.append((q.block, a[hit].tobytes(), b[hit].tobytes(), holder[hit].tobytes()))
        return pd.DataFrame(out, columns=["block", "a", "b", "holder"])

    def drop(rows: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [np.concatenate([np.zeros(0, k), *(np.frombuffer(x, k) for x in answers.column(c).to_pylist())]) for c, k in (("a", np.uint64), ("b", np.uint64), ("holder", np.int64))]
        order = np.argsort(parts[0])
        a, b, holder = (p[order] for p in parts)

        def probe(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(a):
                return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
            at = np.searchsorted(a, x)
            at[at == len(a)] = 0
            return (a[at] == x) & (b[at] == y), holder[at]

        return pa.Table.from_batches([_kept(batch, least, probe) for batch in rows.select(["doc_id", "text"]).to_batches()] or [], schema=pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())]))

    probes = placed.mapInArrow(ask, "shard long, block long, a binary, b binary")
    answers = probes.groupBy("shard").cogroup(shards.withColumnRenamed("index", "index_").groupBy("shard")).applyInPandas(answer, "block long, a binary, b binary, holder binary")
    return placed.groupBy("block").cogroup(cut(answers, "line-answers").groupBy("block")).applyInArrow(drop, _SCHEMA)


def drop_repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_length: int = LEAST_LENGTH, held_keys: int = HELD_KEYS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text of every row of documents (doc_id, text); other columns are not read.

    Texts are split at line breaks; a null or empty text is one empty line. A line's key is the line without
    spaces, tabs and breaks at either end, A-Z in lower case. Keys of at least `least_length` code points found
    in at least `least_docs` documents lose all their lines but those in the largest doc_id with the key. Rows
    with one doc_id are one document, and rows without a doc_id are one that comes before all others; each row
    is returned, repeated ones too. A text that loses all its lines becomes empty. No rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys = cut(repeated_keys(docs, least_docs, least_length), "line-keys")
    n = keys.count()
    shards = max(1, -(-n // SHARD_KEYS))
    if n <= held_keys:
        return _held(docs, build(keys, shards).collect() if n else [], shards, least_length)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shards, size // SHARD_TEXT)
    return _asked(docs, cut(build(keys, shards), "line-index"), shards, least_length)
