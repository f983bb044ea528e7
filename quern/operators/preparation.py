"""Answer preparation over many cases: eligible candidates, a gate, a drilldown where it falls short, a minimal set where it is ready."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import gates


def eligible(candidates: DataFrame, kinds: list[str]) -> DataFrame:
    """Candidates (case_id, candidate_id, rank, reasons, ...) without a reason to withhold: ranks from 1 without gaps, and sorted distinct `tags` of the columns `kinds`."""
    order = Window.partitionBy("case_id").orderBy("rank", "candidate_id")
    tags = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.col(k).cast("string") for k in kinds]))))
    return candidates.filter(F.size("reasons") == 0).withColumn("tags", tags).withColumn("rank", F.row_number().over(order).cast("long")).drop("reasons")


def decisions(cases: DataFrame, requirements: DataFrame, assessed: DataFrame) -> DataFrame:
    """(case_id, in_corpus, min_total) cases to their decision; a requirement (case_id, key, min_groups) without candidates is uncovered.

    assessed: (case_id, key, candidate_id, rank, independence_group, codes), no codes where the candidate counts.
    """
    counted = assessed.filter(F.size("codes") == 0).select("case_id", "key", "independence_group").distinct()
    held = counted.groupBy("case_id", "key").agg(F.count("independence_group").alias("groups"))
    per = requirements.join(held, ["case_id", "key"], "left").withColumn("covered", F.coalesce("groups", F.lit(0)) >= F.col("min_groups"))
    counts = per.groupBy("case_id").agg(F.count(F.lit(1)).alias("requirements"), F.count_if("covered").alias("covered"))
    total = per.filter("covered").select("case_id", "key").join(counted, ["case_id", "key"]).groupBy("case_id").agg(F.count_distinct("independence_group").alias("groups"))
    rows = cases.join(counts, "case_id").join(total, "case_id", "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
    return rows.withColumn("decision", gates.gate_decision(F.col("in_corpus"), F.col("requirements"), F.col("covered"), F.col("groups") >= F.col("min_total")))


def drilled(first: DataFrame, broad: DataFrame, local: DataFrame) -> DataFrame:
    """`broad`, and for cases decided partial or insufficient the candidates of `local` it lacks, ranked behind its own."""
    short = first.filter(F.col("decision").isin("partial", "insufficient")).select("case_id")
    last = broad.groupBy("case_id").agg(F.max("rank").alias("_last"))
    more = local.join(short, "case_id", "left_semi").join(broad.select("case_id", "candidate_id"), ["case_id", "candidate_id"], "left_anti")
    order = Window.partitionBy("case_id").orderBy("_r", "candidate_id")
    place = more.withColumnRenamed("rank", "_r").select("case_id", "candidate_id", "_r").distinct().withColumn("_n", F.row_number().over(order))
    more = more.drop("rank").join(place.drop("_r"), ["case_id", "candidate_id"]).join(last, "case_id", "left")
    return broad.unionByName(more.withColumn("rank", (F.coalesce("_last", F.lit(0)) + F.col("_n")).cast("long")).drop("_last", "_n"))


def compact(ready: DataFrame, requirements: DataFrame, assessed: DataFrame) -> DataFrame:
    """(case_id, min_total) ready cases to the (case_id, candidate_id, rank) left when evidence is dropped from the back while they stay ready.

    A case holds one packet of candidates, of bounded size by contract.
    """
    rows = assessed.filter(F.size("codes") == 0).join(requirements.select("case_id", "key", "min_groups"), ["case_id", "key"]).join(ready.select("case_id", "min_total"), "case_id")

    def smallest(case: pd.DataFrame) -> pd.DataFrame:
        least, total = dict(zip(case["key"], case["min_groups"], strict=True)), int(case["min_total"].iloc[0])

        def enough(kept: list) -> bool:
            now = case[case["candidate_id"].isin(kept)].dropna(subset=["independence_group"])
            have = now.groupby("key")["independence_group"].nunique()
            return all(have.get(k, 0) >= n for k, n in least.items()) and now["independence_group"].nunique() >= total

        each = case[["case_id", "candidate_id", "rank"]].drop_duplicates("candidate_id").sort_values(["rank", "candidate_id"])
        return each[each["candidate_id"].isin(gates.minimal_set(list(each["candidate_id"]), enough))]

    types = {f.name: f.dataType.simpleString() for f in assessed.schema}
    return rows.groupBy("case_id").applyInPandas(smallest, ", ".join(f"{c} {types[c]}" for c in ("case_id", "candidate_id", "rank")))


def prepare(cases: DataFrame, requirements: DataFrame, broad: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases to (decisions with `drilled`, evidence): gate, drilldown of what falls short, gate again, then the least evidence of ready cases.

    `broad` and `local` are assessed candidates of all cases. Cases that aren't ready keep every candidate that counts.
    """
    first = decisions(cases, requirements, broad)
    both = drilled(first, broad, local)
    short = first.select("case_id", F.col("decision").isin("partial", "insufficient").alias("drilled"))
    second = decisions(cases, requirements, both).join(short, "case_id")
    ready = second.filter("decision = 'ready'")
    least = compact(ready, requirements, both)
    others = both.filter(F.size("codes") == 0).join(ready.select("case_id"), "case_id", "left_anti").select("case_id", "candidate_id", "rank").distinct()
    return second, least.unionByName(others)
