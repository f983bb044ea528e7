"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Each document of a source is expected the same number of copies (target / size of the source). Expected
copies are prefix-summed within the source, one offset is added, and a copy is emitted for every integer
that a document's stretch crosses. Documents stand in order of size class, so what is taken keeps near
the target. The prefix sum has three levels: blocks of a size class and classes of a source are counted and
summed first, so no source, however large, lies in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import cut, words_of

#: Weights of the sources in order of code point, repeating.
WEIGHTS = [5, 2, 1]
#: Parameters: all targets together as a share of all sizes; the most a source may be repeated; blocks of a size class.
TOTAL = 1.5
MOST = 2
SPREAD = 1024


def targets(sizes: DataFrame, weights: list[int] = WEIGHTS, total: float = TOTAL, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs) to targets: shares by weight, stopped at `most` times the size, the excess reshared.

    Filling by weight until a source is full is a level L with sum(min(L * weight, cap)) = total; in order
    of cap / weight the full sources come first, so two running sums find L. One row per source is sorted.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_k"))
    every = Window.partitionBy()
    step = sizes.withColumn("_k", (F.row_number().over(by_name) - 1).cast("int"))
    step = step.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_k") % len(weights) + 1))
    step = step.withColumn("_cap", F.col("source_size") * most)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    step = step.withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0))).withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    step = step.withColumn("_level", (F.sum("source_size").over(every) * F.lit(total) - F.col("_full")) / F.col("_open"))
    step = step.withColumn("_fills", F.col("_level") * F.col("_w") >= F.col("_cap"))
    # the level of the first source, by ratio, that does not fill
    level = F.min(F.when(~F.col("_fills"), F.struct(F.col("_cap") / F.col("_w"), F.col("_k"), F.col("_level").alias("level")))).over(every)["level"]
    return step.withColumn("target", F.when(F.col("_fills"), F.col("_cap").cast("double")).otherwise(level * F.col("_w"))).select("source", "source_size", "n_docs", "target")


def number(text: Column) -> Column:
    """32 bits of a text's MD5: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, seed: int = 7, text: str = "text") -> DataFrame:
    """Add size, source_size, target and copies to every row.

    A null or empty text has size 0 and weighs nothing; a null source is a source of its own, the last.
    Rows with equal ids are rows of their own; which of them is repeated follows their order, as they are
    alike. A null id is dealt to blocks by its text. Columns named like those added are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "n_docs")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "source", "doc_id", F.col(text).alias("_text"), F.size(words_of(text)).cast("long").alias("size"))
    rows = rows.withColumn("_bits", F.length(F.bin("size")))
    rows = rows.withColumn("_class", (F.col("_bits") * 8 + F.call_function("shiftright", F.col("size") * 8, F.col("_bits") - 1)).cast("int")).drop("_bits")
    rows = rows.withColumn("_mix", number(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.md5("_text"))))).drop("_text")
    rows = rows.withColumn("_block", (F.col("_mix") % SPREAD).cast("int"))
    per_block = rows.groupBy("source", "_class", "_block").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    per_block = cut(per_block, "blocks")
    per_source = per_block.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_rows").alias("n_docs"))
    goal = targets(per_source)
    # blocks count up within their class, and classes within their source
    before = Window.partitionBy("source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    per_class = per_block.groupBy("source", "_class").agg(F.sum("_rows").alias("_n"))
    per_class = per_class.select(F.col("source").alias("_cs"), F.col("_class").alias("_cc"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = Window.partitionBy("source", "_class").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.withColumn("_in", F.coalesce(F.sum("_rows").over(within), F.lit(0)))
    starts = starts.join(per_class, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("_class") == F.col("_cc")))
    starts = starts.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_block").alias("_b"), (F.col("_from") + F.col("_in")).alias("_start"))
    goal = goal.withColumn("_share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = goal.withColumn("_offset", (number(F.concat_ws(":", F.lit(str(seed)), F.col("source"))) % (1 << 20)) / F.lit(1 << 20))
    starts = starts.join(goal, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "_class", "_block").orderBy("size", "_mix", "doc_id")
    placed = rows.withColumn("_at", F.row_number().over(inside) - 1)
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_block") == F.col("_b")))
    place = F.col("_start") + F.col("_at")
    copies = F.floor(F.col("_offset") + F.col("_share") * (place + 1)) - F.floor(F.col("_offset") + F.col("_share") * place)
    return placed.withColumn("copies", F.least(copies, F.lit(MOST)).cast("long")).select(*[F.col("_row")[c].alias(c) for c in docs.columns], "size", "source_size", "target", "copies")


def emit(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixture itself: each document once per copy, numbered from 0 in `copy`."""
    mixed = mix(docs.drop("copy"), seed)
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).select(*[c for c in docs.columns if c != "copy"], "copy")
