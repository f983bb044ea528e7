"""Stored evidence packets: content hashes, integrity checks, permits, replay and scope sessions."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.canonical import set_manifest


def packets(results: DataFrame) -> DataFrame:
    """(query_id, rank, id, score) to a packet per question: items and a hash of its rows in order of rank."""
    line = F.concat_ws("|", F.col("rank").cast("string"), F.col("id").cast("string"), F.format_string("%.6f", "score"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return results.groupBy("query_id").agg(F.count(F.lit(1)).alias("items"), F.sha2(F.array_join(ordered, "\n"), 256).alias("packet_hash"))


def altered(stored: DataFrame, results: DataFrame) -> DataFrame:
    """Packets whose stored hash differs from that of the rows rebuilt now: (query_id, state) changed, lost or new."""
    now = packets(results).select(F.col("query_id").alias("_q"), F.col("packet_hash").alias("_h"))
    both = stored.join(now, F.col("query_id") == F.col("_q"), "full_outer")
    state = F.when(F.col("_q").isNull(), "lost").when(F.col("query_id").isNull(), "new").otherwise("changed")
    return both.filter(~F.col("packet_hash").eqNullSafe(F.col("_h"))).select(F.coalesce("query_id", "_q").alias("query_id"), state.alias("state"))


def load(stored: DataFrame, results: DataFrame) -> DataFrame:
    """The rows of stored packets; an error if any packet isn't what it was when it was stored."""
    if not altered(stored, results).isEmpty():
        raise ValueError("a stored packet differs from its hash")
    return results.join(stored.select("query_id"), "query_id", "left_semi")


def read_sets(reads: DataFrame) -> DataFrame:
    """(request_id, member) reads to their distinct sets: set_hash, members and the requests that share the set.

    A set is hashed in buckets, so no task lists all that a request read.
    """
    each = reads.select("request_id", F.col("member").cast("string").alias("member")).distinct()
    per = set_manifest(each, "request_id", "member")
    return per.groupBy(F.col("manifest_hash").alias("set_hash"), "members").agg(F.count(F.lit(1)).alias("requests"))


def permit(*parts: Column) -> Column:
    """Token of a permit: a hash of its parts, in order, each with its length before it."""
    return F.sha2(F.concat(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")) for p in parts]), 256)


def metadata(fragments: DataFrame, text: str = "text") -> DataFrame:
    """What may be read without a permit: everything but the text."""
    return fragments.drop(text)


def read_text(fragments: DataFrame, permits: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Metadata of all fragments, with the text of those alone that a valid permit (key, token, and its parts) opens."""
    valid = permits.filter(permit(*[F.col(c) for c in permits.columns if c != "token"]) == F.col("token")).select(key).distinct()
    opened = fragments.join(valid, key, "left_semi").select(key, text)
    return metadata(fragments, text).join(opened, key, "left")


def fused(results: DataFrame, most: int = 10) -> DataFrame:
    """Answers to several forms of a question (question, query_id, id, rank) as one list: least rank, then forms that found it, then id."""
    from pyspark.sql import Window

    per = results.groupBy("question", "id").agg(F.min("rank").alias("best"), F.count_distinct("query_id").alias("forms"))
    order = Window.partitionBy("question").orderBy("best", F.desc("forms"), "id")
    return per.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)


class Scopes:
    """Open scope sessions by the hash of what they may read; the least recently used is closed beyond `most`."""

    def __init__(self, most: int = 4) -> None:
        self.most = most
        self.held: OrderedDict[str, object] = OrderedDict()

    def open(self, scope: str, make: Callable[[], object]) -> object:
        if scope not in self.held:
            self.held[scope] = make()
            while len(self.held) > self.most:
                self.held.popitem(last=False)[1].close()
        self.held.move_to_end(scope)
        return self.held[scope]
