"""MinHash near-duplicates: universal hash minima, banding, signature verification, exact confirmation, components.

1. One pass over the texts makes a row per document: size and digest of its shingle set, a key per band
   of minima, and one byte of each minimum as its signature.
2. Documents with equal sets form a class; only the least id of a class goes on.
3. Representatives that share a band key form a bucket. The member whose band keys are the most common
   (the least id of several) is the bucket's pivot, and each other member is paired with it: never all
   pairs of a bucket.
4. A member whose signature agrees too little with the pivot's is compared by signature with all other
   members of the pivot's group, in blocks of bounded size, and is dropped only if it is like none of
   them. The rest are confirmed on full shingle sets: a block of a group's members is read as a stream
   behind one copy of the pivot's set, so a task holds that set and a batch.
   For a confirmed pivot group the members' sets are kept as differences from the pivot's set, and in
   blocks of bounded size the members that the pivot is not linked with are compared with the others.
   So a link between two members that both miss the pivot is found as well.
5. Links become components by alternating large-star and small-star steps.

With ROWS = 6 and BANDS = 48 two sets with a similarity of 0.8 share no band once in two million cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import words as W
from quern.llm.shared import cut, forget, small, with_group_min

ROWS = 6
BANDS = 48
#: Signatures that agree in less than this share of places are not confirmed; at a similarity of 0.8 that is 8 deviations off.
FLOOR = 0.58
#: Ids of documents whose sets are wanted that may be broadcast; beyond it the texts are joined by a shuffle.
WANTED_ROWS = 1_000_000
#: Members of a pivot group that one task compares with one another, and bytes of what it holds of them.
BLOCK = 512
BLOCK_BYTES = 32 << 20

_rng = np.random.default_rng(20)
_A = (_rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint64).astype(np.uint32)
_BAND = _rng.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_SHORT = np.uint64(0xA24BAED4963EE407)

FEATURES = "doc_id long, n_shingles long, digest_a long, digest_b long, bands array<long>, signature binary"


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-word shingles of a document as sorted 64-bit hashes; fewer words are one shingle of their own."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < n:
        return W.mix(W.pair_up(hashes, len(hashes)) + _SHORT * np.uint64(len(hashes)))
    return np.unique(W.pair_up(hashes, n))


def minima(x: np.ndarray) -> np.ndarray:
    """Least value of each multiply-add hash (mod 2**32) over a set, taken a stretch at a time."""
    x = (x >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 512):
        part = _A[:, None] * x[at : at + 512] + _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _features(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest_a", pa.int64()), ("digest_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])
        for batch in batches:
            ids = batch.column(0)
            for a, b, buf, offs in W.slices(batch.column(1)):
                words = W.cut(buf, offs, lower=True)
                sizes, da, db = np.zeros(b - a, np.int64), np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                bands, marks = np.zeros((b - a, BANDS), np.uint64), []
                for i in range(b - a):
                    s = shingles(words.hashes[words.first[i] : words.first[i + 1]], n)
                    sizes[i] = len(s)
                    if len(s) == 0:
                        marks.append(b"")
                        continue
                    da[i], db[i] = s.sum(dtype=np.uint64), W.mix(s).sum(dtype=np.uint64)
                    least = minima(s)
                    marks.append((least & np.uint32(255)).astype(np.uint8).tobytes())
                    keyed = (W.mix(least.astype(np.uint64) + np.uint64(1)) * _BAND).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)
                    bands[i] = W.mix(keyed + np.arange(BANDS, dtype=np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes), pa.array(da.view(np.int64)), pa.array(db.view(np.int64)), lists, pa.array(marks, pa.binary())], schema=schema)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offs in W.slices(batch.column(1)):
                words = W.cut(buf, offs, lower=True)
                sets = [shingles(words.hashes[words.first[i] : words.first[i + 1]], n) for i in range(b - a)]
                digests = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(digests.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "digest", "members"])

    return run


def _similar(percent: int):
    """Whether 100 * intersection >= percent * union, in whole numbers."""
    return lambda inter, size_a, size_b: 100 * inter >= percent * (size_a + size_b - inter)


def _confirm(percent: int):
    """Rows (pivot, block, id, set), a block's pivot first, to (pivot, id, linked, size, shared, extra) of its members.

    shared holds bits over the pivot's set, extra the other shingles. Only the pivot's set outlives a batch.
    """
    linked = _similar(percent)
    schema = pa.schema([("pivot", pa.int64()), ("id", pa.int64()), ("linked", pa.bool_()), ("size", pa.int64()), ("shared", pa.binary()), ("extra", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, p = None, np.zeros(0, np.uint64)
        for batch in batches:
            pivots, blocks, ids = (batch.column(k).to_pylist() for k in range(3))
            for at in range(0, batch.num_rows, 512):
                out: list[list] = [[], [], [], [], [], []]
                for i in range(at, min(at + 512, batch.num_rows)):
                    x = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                    if ids[i] == pivots[i]:
                        held, p = (pivots[i], blocks[i]), x.copy()
                        continue
                    if held != (pivots[i], blocks[i]):
                        raise ValueError("a block's pivot has to come first")
                    place = np.minimum(np.searchsorted(p, x), len(p) - 1)
                    hit = p[place] == x
                    bits = np.zeros(len(p), bool)
                    bits[place[hit]] = True
                    for column, value in zip(out, (pivots[i], ids[i], bool(linked(int(hit.sum()), len(p), len(x))), len(x), np.packbits(bits).tobytes(), x[~hit].tobytes()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _compare(percent: int):
    """Within a block of a pivot group: links that join parts which the pivot leaves apart."""
    linked = _similar(percent)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("id")
        ids, free = group["id"].to_numpy(), ~group["linked"].to_numpy()
        sizes = group["size"].to_numpy()
        shared = np.frombuffer(b"".join(group["shared"]), np.uint8).reshape(len(group), -1)
        wide = np.zeros((len(group), -(-shared.shape[1] // 8) * 8), np.uint8)
        wide[:, : shared.shape[1]] = shared
        wide = wide.view(np.uint64)
        extra = [np.frombuffer(x, np.uint64) for x in group["extra"]]
        counts = np.array([len(x) for x in extra])
        owner = np.repeat(np.arange(len(group)), counts)
        values = np.concatenate(extra) if len(extra) else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        part = np.where(free, np.arange(len(group)), -1)  # what is linked with the pivot is one part
        pairs: list[tuple[int, int]] = []
        for q in np.flatnonzero(free):
            inter = np.bitwise_count(wide & wide[q]).sum(axis=1, dtype=np.int64)
            if len(extra[q]):
                lo, hi = np.searchsorted(values, extra[q]), np.searchsorted(values, extra[q], side="right")
                for a, b in zip(lo[hi - lo > 1], hi[hi - lo > 1], strict=True):
                    np.add.at(inter, owner[a:b], 1)
            met = np.flatnonzero(linked(inter, sizes[q], sizes) & (part != part[q]))
            for x in met:
                if part[x] != part[q]:
                    pairs.append((ids[q], ids[x]))
                    part[part == part[x]] = part[q]
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return run


def _alike(group: pd.DataFrame) -> pd.DataFrame:
    """Within a block of a pivot group: members that miss the pivot and whose signatures agree with another member's."""
    marks = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
    missed = np.flatnonzero(~group["near"].to_numpy())
    live = [q for q in missed if ((marks == marks[q]).mean(axis=1) >= FLOOR).sum() > 1]  # one is the member itself
    return group.iloc[live][["pivot", "id"]]


def _dealt(rows: DataFrame, reached: str, held: Column) -> DataFrame:
    """Rows of pivot groups in blocks (pivot, r, c) of bounded size in which each row not `reached` meets all others once.

    Callers deal them out by block: a group by pivot, r and c alone would stay where a join on the pivot put it, all
    blocks of a pivot in one task. A block has about BLOCK rows of either kind, or fewer if they hold more than BLOCK_BYTES.
    """
    free = ~F.col(reached)
    blocks = lambda n, of: F.ceil(F.greatest(n / BLOCK, of / BLOCK_BYTES)).cast("int")
    groups = rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.sum(held).alias("of"), F.count_if(free).alias("_n"), F.sum(F.when(free, held).otherwise(0)).alias("_of"))
    groups = groups.filter("_n > 0 AND n > 1").select("pivot", blocks(F.col("_n"), F.col("_of")).alias("fb"), blocks(F.col("n"), F.col("of")).alias("nb"))
    dealt = rows.join(groups, "pivot")
    row = F.pmod(F.xxhash64("id", F.lit(1)), F.col("fb")).cast("int")
    col = F.pmod(F.xxhash64("id", F.lit(2)), F.col("nb")).cast("int")
    asked = dealt.filter(free).withColumn("r", row).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    # a member is asked about in one row of blocks and stands in one column of them for the others to meet
    others = dealt.withColumn("c", col).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("fb") - 1)))
    others = others.filter(F.col(reached) | (F.col("r") != row))
    return asked.select(*rows.columns, "r", "c").unionByName(others.select(*rows.columns, "r", "c"))


def _streams(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, id) pairs to (pivot, block, id, members), dealt by block, each block's pivot before its members."""
    heavy = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select("pivot", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"))
    dealt = pairs.join(small(heavy, heavy.count()), "pivot", "left").select("pivot", F.pmod(F.xxhash64("id"), F.coalesce("nb", F.lit(1))).cast("int").alias("block"), "id")
    every = dealt.unionByName(dealt.select("pivot", "block").distinct().withColumn("id", F.col("pivot")))
    rows = every.join(sets, "id").select("pivot", "block", "id", "members")
    return rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", F.col("id") != F.col("pivot"))


def links(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles and class representative `rep` of each row, links between representatives a > b)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = cut(texts.mapInArrow(_features(n), FEATURES), "minhash")
    usable = features.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    whole_set = ["n_shingles", "digest_a", "digest_b"]
    classes = cut(with_group_min(usable.select("doc_id", *whole_set), whole_set, "doc_id", "rep"), "classes")
    reps = classes.filter("doc_id = rep").select("doc_id", *whole_set)
    repeated = not usable.groupBy("doc_id").count().filter("count > 1").isEmpty()
    chosen = usable.join(reps, ["doc_id", *whole_set], "left_semi")
    chosen = cut(chosen.dropDuplicates(["doc_id"]) if repeated else chosen, "representatives")

    keyed = chosen.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket"))
    buckets = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    members = cut(keyed.join(buckets, "bucket"), "members")
    common = members.groupBy("id").agg(F.sum("held").alias("common"))
    pivots = members.join(common, "id").groupBy("bucket").agg(F.max(F.struct("common", (-F.col("id")).alias("id"))).alias("_p")).select("bucket", (-F.col("_p.id")).alias("pivot"))
    pairs = members.join(pivots, "bucket").filter("id <> pivot").select("pivot", "id").distinct()

    marks = chosen.select(F.col("doc_id").alias("id"), "signature")
    marked = pairs.join(marks, "id").join(marks.select(F.col("id").alias("pivot"), F.col("signature").alias("mark")), "pivot")

    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(len(b), -1)
        return pd.Series((x == y).mean(axis=1) >= FLOOR)

    met = cut(marked.select("pivot", "id", agree("signature", "mark").alias("near")), "met")
    blocks = _dealt(met, "near", F.lit(ROWS * BANDS)).join(marks, "id").repartition("pivot", "r", "c")
    alike = blocks.groupBy("pivot", "r", "c").applyInPandas(_alike, "pivot long, id long").distinct()
    likely = cut(met.filter("near").select("pivot", "id").unionByName(alike), "likely")
    wanted = likely.select(F.explode(F.array("pivot", "id")).alias("id")).distinct()
    held = texts.withColumnRenamed("doc_id", "id").join(small(wanted, wanted.count(), WANTED_ROWS), "id", "left_semi")
    sets = held.mapInArrow(_sets(n), "id long, digest long, members binary")
    if repeated:  # a row that repeats an id may have another set; the one that was chosen stands for the id
        sets = sets.join(chosen.select(F.col("doc_id").alias("id"), F.col("digest_a").alias("digest")), ["id", "digest"], "left_semi").dropDuplicates(["id"])
    sets = cut(sets.drop("digest"), "sets")
    stars = cut(_streams(likely, sets).mapInArrow(_confirm(percent), "pivot long, id long, linked boolean, size long, shared binary, extra binary"), "stars")

    blocks = _dealt(stars, "linked", F.octet_length("shared") + F.octet_length("extra")).repartition("pivot", "r", "c")
    more = blocks.groupBy("pivot", "r", "c").applyInPandas(_compare(percent), "a long, b long")
    found = stars.filter("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b")).unionByName(more)
    found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = features.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("rep"))
    return classes.select("doc_id", "n_shingles", "rep").unionByName(rest), cut(found, "links")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links to (id, root), root the least id reachable; alternating large-star and small-star.

    Every round is written to the shared folder. Ids that no link touches are not returned. A node with
    any number of neighbours is safe: minima are pre-aggregated, and the joins on a node split when skewed.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen = written = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("x"), "m").select(F.col("x").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        now = cut(small_star, "stars-of-round")
        was, seen = seen, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if was == seen:
            return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
        forget(written)
        written = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are not read): doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z; a document's set holds its distinct n-word shingles, or its whole
    sequence where it has fewer words. Documents are linked when 100 * intersection >= percent * union;
    component_id is the least doc_id reachable. A null or empty text, or one without words, has an
    empty set, is linked with nothing and is kept. A row with a null doc_id has a null component_id and
    is kept. Repeated rows with one id are one document and stay so many rows; rows with one id and
    different texts keep their own sizes and classes, and one of them stands for the id where it is compared.
    """
    rows, found = links(docs, n, percent)
    roots = components(found)
    rows = rows.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
    rows = rows.withColumn("component_id", F.coalesce("root", "rep", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
