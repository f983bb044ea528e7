"""Append-only decisions: what stands, what is resolved, what waits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Actions that end a review.
TERMINAL = ["accept", "reject", "revise"]
#: Fixed value: unresolved candidates from which a run needs an explicit override.
MOST_BACKLOG = 1000


def standing(decisions: DataFrame) -> DataFrame:
    """Decisions (decision_id, supersedes_id) that no later one supersedes."""
    gone = decisions.select(F.col("supersedes_id").alias("decision_id")).filter("decision_id IS NOT NULL").distinct()
    return decisions.join(gone, "decision_id", "left_anti")


def resolved(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """(target_id, use) whose standing terminal decisions together cover all collections of the target.

    decisions: (decision_id, supersedes_id, target_id, use, action, scope array); targets: (target_id, collections array).
    """
    ended = standing(decisions).filter(F.col("action").isin(TERMINAL)).select("target_id", "use", F.explode("scope").alias("c"))
    covered = ended.groupBy("target_id", "use").agg(F.collect_set("c").alias("covered"))
    return covered.join(targets, "target_id").filter(F.size(F.array_except("collections", "covered")) == 0).select("target_id", "use")


def queue(targets: DataFrame, done: DataFrame, most: int) -> DataFrame:
    """Targets (created_at, target_type, target_id) not yet resolved, oldest first."""
    return targets.join(done.select("target_id").distinct(), "target_id", "left_anti").orderBy("created_at", "target_type", "target_id").limit(most)


def admission(decisions: DataFrame, scope: list[str]) -> DataFrame:
    """Relations with exactly one standing acceptance of exactly this scope."""
    exact = standing(decisions).filter((F.col("action") == "accept") & (F.array_sort("scope") == F.array(*map(F.lit, sorted(scope)))))
    return exact.groupBy("target_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("target_id")


def refused(backlog: int, budget: int, override: bool = False, egress: bool = True) -> str | None:
    """Why a run may not add candidates: no egress to its provider, the review budget, or the backlog without an override."""
    if not egress:
        return "egress_not_allowed"
    if backlog >= budget:
        return "review_budget_exhausted"
    return "backlog_needs_override" if backlog >= MOST_BACKLOG and not override else None


def per_version_cap(candidates: DataFrame, cap: int) -> DataFrame:
    """Versions with more distinct candidates than their profile allows."""
    return candidates.groupBy("version_id").agg(F.countDistinct("candidate_id").alias("candidates")).filter(F.col("candidates") > cap)


def stubs(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Candidates of all target types, by (rows, time, id) per type: (created_at, target_type, target_id), oldest first."""
    found = None
    for kind, (rows, time, key) in tables.items():
        part = rows.select(F.col(time).cast("string").alias("created_at"), F.lit(kind).alias("target_type"), F.col(key).cast("string").alias("target_id"))
        found = part if found is None else found.unionByName(part)
    return found.orderBy("created_at", "target_type", "target_id")


def decision_faults(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """(decision_id, fault) of decisions (decision_id, supersedes_id, target_id, target_hash, scope) on targets (target_id, hash, collections).

    stale: the target is not what it was; scope: collections that the target isn't in; second: more than one standing
    decision of one exact scope; forked: a prior that is superseded twice.
    """
    rows = decisions.join(targets.select("target_id", F.col("hash").alias("_h"), F.col("collections").alias("_c")), "target_id", "left")
    own = F.array_compact(F.array(F.when(~F.col("target_hash").eqNullSafe(F.col("_h")), "stale"), F.when(F.size(F.array_except("scope", F.coalesce("_c", F.array().cast("array<string>")))) > 0, "scope")))
    one = rows.select("decision_id", F.explode(own).alias("fault"))
    place = Window.partitionBy("target_id", F.array_join(F.array_sort("scope"), ",")).orderBy("decision_id")
    second = standing(decisions).withColumn("_n", F.row_number().over(place)).filter("_n > 1").select("decision_id", F.lit("second").alias("fault"))
    again = Window.partitionBy("supersedes_id").orderBy("decision_id")
    forked = decisions.filter("supersedes_id IS NOT NULL").withColumn("_n", F.row_number().over(again)).filter("_n > 1").select("decision_id", F.lit("forked").alias("fault"))
    return one.unionByName(second).unionByName(forked)


def proposal_faults(proposals: DataFrame, fragments: DataFrame, cap: int) -> DataFrame:
    """(import_key, version_id, fragment_id, quote, voice) of a meaning import: (import_key, fault).

    unknown_fragment, inexact_quote, no_voice, and over_cap where a version has more than `cap` distinct proposals.
    """
    rows = proposals.join(fragments.select("fragment_id", F.col("text").alias("_t")), "fragment_id", "left")
    over = per_version_cap(proposals.withColumnRenamed("import_key", "candidate_id"), cap).select("version_id", F.lit(True).alias("_over"))
    rows = rows.join(over, "version_id", "left")
    faults = F.array_compact(F.array(F.when(F.col("_t").isNull(), "unknown_fragment"), F.when(~F.contains("_t", "quote"), "inexact_quote"), F.when(F.coalesce("voice", F.lit("")) == "", "no_voice"), F.when(F.col("_over"), "over_cap")))
    return rows.select("import_key", F.explode(faults).alias("fault"))


def packet_decisions(logs: list[DataFrame], packet: str, most: int) -> DataFrame:
    """Decisions (decision_id, packet_id, created_at) on a packet, its items and its fragments: each once, in order of time and id."""
    rows = logs[0]
    for more in logs[1:]:
        rows = rows.unionByName(more)
    return rows.filter(F.col("packet_id") == packet).dropDuplicates(["decision_id"]).orderBy("created_at", "decision_id").limit(most)
