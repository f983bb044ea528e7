"""Benchmark decontamination in DataFrame functions only: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

1. Windows are as long as some item (in five-word shingles). Where a window can't reach the threshold with
   any item of its length, because the shingles that items of that length hold weigh too little in it, it
   gets no fingerprint: a running sum over the places of such shingles tells. No item is chosen here.
2. The other windows get a 64-bit SimHash of their weighted shingles.
3. Fingerprints are cut in RADIUS + 1 blocks; two within RADIUS bits agree in one block at least, so an
   equality join on (length, block, value) finds all items within RADIUS bits of a window.
4. Candidates are confirmed by exact weighted Jaccard similarity of their shingle sets.

At a similarity of 0.8 two fingerprints differ by about 10 +- 3 of 64 bits, so the radius of 24 lies five deviations
beyond: no window at the threshold is lost in practice. Blocks of two or three bits, which such a radius asks for,
tell few items apart by themselves; length and the count of differing bits do.

Weights are whole numbers, rarer shingles of the benchmark weighing more, so sums don't depend on order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import cut, row_key, small

SHINGLE = 5
PERCENT = 80
RADIUS = 24
_BITS = 64


def tokens(text: str) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(r"([\p{L}\p{M}\p{N}]+)"), F.lit(1))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """A hash per place of the n-word shingles; the whole sequence if there are fewer words; none without words."""
    many = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.xxhash64(F.slice(words, i, n)))
    return F.when(F.size(words) >= n, many).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def _blocks(bits: str) -> Column:
    """(block, value) of the RADIUS + 1 blocks of a fingerprint."""
    cuts = [k * _BITS // (RADIUS + 1) for k in range(RADIUS + 2)]
    each = [F.struct(F.lit(k).alias("b"), F.shiftrightunsigned(F.col(bits), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.array(*each)


def _fingerprint(rows: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """SimHash of (h, wt) rows per key: bit k is set where the weights of hashes with bit k outweigh the others."""
    mixed = F.xxhash64("h")
    rows = rows.withColumn("_x", mixed)
    sums = [F.sum(F.when(F.shiftright("_x", k).bitwiseAND(F.lit(1)) == 1, F.col("wt")).otherwise(-F.col("wt"))).alias(f"_s{k}") for k in range(_BITS)]
    found = rows.groupBy(*keys).agg(*sums, *more)
    bits = F.lit(0).cast("long")
    for k in range(_BITS):
        bits = bits.bitwiseOR(F.shiftleft(F.when(F.col(f"_s{k}") > 0, F.lit(1)).otherwise(F.lit(0)).cast("long"), k))
    return found.withColumn("print", bits).drop(*[f"_s{k}" for k in range(_BITS)])


def index_items(items: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Items by (item, item_id, size, whole weight, print), their (h, item, wt) shingles, and the weight of others.

    An item is an item_id with one text: `item` names both, so texts that share an id are items of their own.
    """
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), shingle_hashes(tokens("text")).alias("sh"))
    rows = rows.filter((F.size("sh") > 0) & F.col("item_id").isNotNull()).withColumn("item", F.xxhash64("item_id", "sh")).dropDuplicates(["item"])
    sizes = rows.select("item", "item_id", F.size("sh").alias("size"))
    each = rows.select("item", F.explode_outer(F.array_distinct("sh")).alias("h"))
    n = sizes.count()
    spread = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).select("h", F.round(F.log(F.lit(1.0) + F.lit(float(n)) / F.col("df")) * 256).cast("long").alias("wt"))
    shingles = cut(each.join(spread, "h").select("h", "item", "wt"), "item-shingles")
    prints = _fingerprint(shingles, ["item"], F.sum("wt").alias("whole"))
    return cut(prints.join(sizes, "item"), "items"), shingles, round(math.log(1.0 + max(n, 1)) * 256)


def matches(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(k, item_id, similarity) for rows (k, text) that hold a window at least `percent` similar to an item."""
    indexed, shingles, other = index_items(items)
    n_shingles = shingles.count()
    sizes = indexed.groupBy("size").agg(F.min("whole").alias("least"))
    known = shingles.join(indexed.select("item", "size"), "item").select("h", "size", "wt").distinct().join(sizes, "size")
    parsed = docs.withColumn("_w", tokens("text")).select("k", shingle_hashes(F.col("_w")).alias("sh"))
    # the outer form: Spark would repeat the whole of `sh` in a filter ahead of the plain one
    placed = parsed.select("k", F.size("sh").alias("n"), F.posexplode_outer("sh").alias("pos", "h"))
    hits = placed.join(small(known, n_shingles), "h").select("k", "n", "pos", "size", "wt", "least")
    # what windows hold changes at two starts for each hit; between changes it stays
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    comes, goes = F.least(F.greatest(F.col("pos") - F.col("size") + 1, F.lit(0)), last), F.least(F.col("pos"), last) + 1
    steps = hits.select("k", "size", "least", F.explode(F.array(F.struct(comes.alias("at"), F.col("wt").alias("d")), F.struct(goes.alias("at"), (-F.col("wt")).alias("d")))).alias("s"))
    steps = steps.groupBy("k", "size", "least", F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    by = Window.partitionBy("k", "size").orderBy("at")
    runs = steps.withColumn("held", F.sum("d").over(by)).withColumn("to", F.lead("at").over(by))
    runs = runs.filter(F.col("held") * 100 >= F.col("least") * percent)
    windows = cut(runs.select("k", "size", F.explode(F.sequence(F.col("at"), F.col("to") - 1)).alias("at")), "windows")
    wanted = windows.select("k").distinct()
    again = docs.join(small(wanted, wanted.count()), "k", "left_semi").dropDuplicates(["k"])  # only these are parsed again
    again = again.withColumn("_w", tokens("text")).select("k", shingle_hashes(F.col("_w")).alias("sh"))
    inside = windows.join(again, "k").select("k", "size", "at", F.explode_outer(F.array_distinct(F.slice("sh", F.col("at") + 1, F.col("size")))).alias("h"))
    weights = shingles.select("h", "wt").distinct()
    inside = cut(inside.join(small(weights, n_shingles), "h", "left").withColumn("wt", F.coalesce("wt", F.lit(other))), "window-shingles")
    prints = _fingerprint(inside, ["k", "size", "at"], F.sum("wt").alias("held")).withColumn("_b", F.explode(_blocks("print")))
    theirs = indexed.select("item", "item_id", F.col("size").alias("_s"), "whole", F.col("print").alias("_p")).withColumn("_c", F.explode(_blocks("_p")))
    near = prints.join(small(theirs, indexed.count() * (RADIUS + 1)), (F.col("size") == F.col("_s")) & (F.col("_b.b") == F.col("_c.b")) & (F.col("_b.v") == F.col("_c.v")))
    near = near.filter(F.bit_count(F.col("print").bitwiseXOR(F.col("_p"))) <= RADIUS).select("k", "size", "at", "held", "item", "item_id", "whole").distinct()
    both = near.join(small(shingles.select("item", "h"), n_shingles), "item").join(inside, ["k", "size", "at", "h"])
    found = both.groupBy("k", "at", "item", "item_id", "held", "whole").agg(F.sum("wt").alias("inter"))
    union = F.col("whole") + F.col("held") - F.col("inter")
    return found.filter(F.col("inter") * 100 >= union * percent).groupBy("k", "item_id").agg(F.max(F.col("inter") / union).alias("similarity"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Every row of `docs` with contaminated, item_ids (sorted) and similarity (of its best window; 0 if clean).

    Texts are compared in lower case by letters and digits; an item or a document with fewer than five words is
    one shingle. A null or empty text, and items without words or with a null id, meet nothing; with no
    items every document is clean. Texts that share an item_id are all looked for; repeated documents are judged each.
    Columns named like those added are replaced.
    """
    docs = docs.drop("contaminated", "item_ids", "similarity")
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), row_key("doc_id", "text").alias("_k"))
    found = matches(keyed.select(F.col("_k").alias("k"), F.col("_row")["text"].alias("text")), items, percent)
    per = cut(found.groupBy(F.col("k").alias("_found")).agg(F.sort_array(F.collect_set("item_id")).alias("_items"), F.max("similarity").alias("_most")), "contaminated")
    joined = keyed.join(small(per, per.count()), F.col("_k") == F.col("_found"), "left")
    none = F.array().cast("array<bigint>")
    return joined.select(*[F.col("_row")[c].alias(c) for c in docs.columns], F.col("_found").isNotNull().alias("contaminated"), F.coalesce("_items", none).alias("item_ids"), F.coalesce("_most", F.lit(0.0)).alias("similarity"))
