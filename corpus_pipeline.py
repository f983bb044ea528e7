"""The corpus pipeline: quality rules, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, near_dedup, quality_rules, substring_dedup
from quern.llm.shared import cut
from quern.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current quality policy."""
    return quality_rules.passing(quality_rules.ledger(docs), "web-1").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, one with the least id, of each group of near copies (five words, 0.8).

    Every row is a document with a key of its own, so repeated rows and rows with a null id are copies
    like any other; a null id comes after all others. A text without words is no copy and stays.
    """
    rows = cut(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_key")), "keyed")
    found = near_dedup.near_duplicates(rows.select(F.col("_key").alias("doc_id"), F.col("_row")["text"].alias("text"))).withColumnRenamed("doc_id", "_key")
    groups = cut(found.select("_key", "component_id"), "groups")
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    stay = groups.join(rows.select("_key", F.col("_row")["doc_id"].alias("_id")), "_key").groupBy("component_id").agg(F.min(order)["key"].alias("_key"))
    dropped = cut(groups.select("_key").join(stay.select("_key"), "_key", "left_anti"), "copies")
    return rows.join(dropped, "_key", "left_anti").select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur elsewhere; a text that loses nothing stays as it is."""
    rows = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return rows.filter("NOT contaminated").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for; `copy` numbers the repeats."""
    return mixing.emit(docs)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_copies),
    ("substring dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("mixing", mixture),
]

#: SQL can't express MinHash components or repeated passages at this size; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
