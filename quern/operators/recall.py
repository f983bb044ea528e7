"""Recall as one step: requests, what they read, results, packets and receipts are stored together, or not at all."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.canonical import set_manifest
from quern.operators import packets, projections, retrieval
from quern.sources.commits import Versions

#: Fixed value: code points of a question at most.
MOST_QUESTION = 4000


class RecallBackend(Protocol):
    """Anything that answers questions over permitted fragments."""

    def search(self, fragments: DataFrame, questions: DataFrame) -> DataFrame:
        """(query_id, question) over (fragment_id, text, ...) to (query_id, rank, id, score)."""


@dataclass
class Bm25:
    """The library's own search: statistics of the permitted fragments, the first `most` of each question.

    With a `folder`, a path that all executors reach, the fragments of a scope are cut once for all batches. Fragments with the
    same plan are the same, as in Spark's own cache: other files need another backend.
    """

    most: int = 10
    folder: str | None = None
    held: list[tuple[DataFrame, retrieval.Index]] = field(default_factory=list, repr=False, compare=False)

    def search(self, fragments: DataFrame, questions: DataFrame) -> DataFrame:
        return self.index(fragments).search(questions, self.most).select("query_id", "rank", "id", "score")

    def index(self, fragments: DataFrame) -> retrieval.Index:
        if self.folder is None:
            return retrieval.Index(fragments, "fragment_id")
        for rows, index in self.held:
            if rows.sameSemantics(fragments):
                return index
        self.held.append((fragments, retrieval.Index(fragments, "fragment_id").cut(f"{self.folder}/{uuid.uuid4().hex}")))
        return self.held[-1][1]


def request_faults(requests: DataFrame) -> DataFrame:
    """(query_id, fault) of requests: blank or too_long questions, repeated or null ids."""
    per = requests.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    own = requests.select("query_id", F.array_compact(F.array(F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "blank"), F.when(F.char_length("question") > MOST_QUESTION, "too_long"), F.when(F.col("query_id").isNull(), "null_id"))).alias("f"))
    return own.select("query_id", F.explode("f").alias("fault")).unionByName(per.filter("_n > 1 AND query_id IS NOT NULL").select("query_id", F.lit("repeated").alias("fault")))


def recall_batch(store: Versions, fragments: DataFrame, compiled: DataFrame, requests: DataFrame, backend: RecallBackend) -> int:
    """Answer all requests (query_id, question) over one scope and store the batch as one version; returns that version.

    fragments: (fragment_id, text, ...); compiled: `scope.compile_access`. Stored are requests (with request_id, a hash of
    question and read set), read_sets (set_hash, members), items, packets and receipts. A request that is stored already
    keeps its packet and is not run again. A request with a fault, a result from outside of the scope, or any other error
    stores nothing of the batch. All questions share one scan of the fragments.
    """
    faults = request_faults(requests).limit(5).collect()
    if faults:
        raise ValueError(f"requests with faults: {[(r.query_id, r.fault) for r in faults]}")
    allowed = compiled.filter("permitted").select("fragment_id").distinct()
    held = set_manifest(allowed.select(F.lit(1).alias("set"), F.col("fragment_id").cast("string").alias("member")), "set", "member")
    first = held.first()
    set_hash, members = (first["manifest_hash"], first["members"]) if first else ("", 0)
    named = requests.select("query_id", "question", F.sha2(F.concat_ws("\x1f", F.col("query_id").cast("string"), "question", F.lit(set_hash)), 256).alias("request_id"), F.lit(set_hash).alias("set_hash"))
    spark = requests.sparkSession
    with store.begin() as change:
        before = change.read("requests")
        fresh = named if before is None else named.join(before.select("request_id"), "request_id", "left_anti").select(named.columns)
        fresh = fresh.checkpoint()
        sets = change.read("read_sets")
        if sets is None or sets.filter(F.col("set_hash") == set_hash).isEmpty():
            change.append("read_sets", spark.createDataFrame([(set_hash, members)], "set_hash string, members long"))
        if not fresh.isEmpty():
            results, _, receipt = projections.recall(fragments, compiled, lambda rows: backend.search(rows, fresh.select("query_id", "question")))
            results = results.join(F.broadcast(fresh.select("query_id", "request_id")) if fresh.count() <= 100_000 else fresh.select("query_id", "request_id"), "query_id")
            results = results.select("request_id", "query_id", "rank", "id", "score").checkpoint()
            change.append("requests", fresh)
            change.append("items", results)
            change.append("packets", packets.packets(results.drop("query_id").withColumnRenamed("request_id", "query_id")).withColumnRenamed("query_id", "request_id"))
            change.append("receipts", fresh.select("request_id").crossJoin(F.broadcast(receipt)))  # one row about the scope
    return store.latest()


def replayed(store: Versions, version: int | None = None) -> DataFrame:
    """(request_id, state) of packets whose stored items no longer give the hash they were stored under: empty when whole."""
    version = store.latest() if version is None else version
    held, items = store.table("packets", version), store.table("items", version)
    if held is None:
        raise ValueError("nothing is stored as of this version")
    rows = items.drop("query_id").withColumnRenamed("request_id", "query_id")
    return packets.altered(held.withColumnRenamed("request_id", "query_id"), rows).withColumnRenamed("query_id", "request_id")
