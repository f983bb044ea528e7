"""Validation of answers as data: coverage of a task, entailment by judgment receipts, stages in turn, times and authorised reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.canonical import set_manifest
from quern.operators import gates, packets



def _listed(*cases: Column) -> Column:
    """Codes that hold, sorted."""
    return F.array_sort(F.array_compact(F.array(*cases)))


def answer_coverage(answers: DataFrame, specs: DataFrame, facets: DataFrame, packet: DataFrame, used: DataFrame, cited: DataFrame) -> DataFrame:
    """Whether answers cover their tasks: (answer_id, covered, required, basis_points, cited_sources, violations, decision).

    answers: (answer_id, task_id, packet_hash, status, open_gap); specs: (task_id, packet_hash, allowed_statuses,
    require_open_gap, min_cited_sources), one a task; facets: (task_id, facet_id, min_evidence, evidence_ids_any); packet:
    (packet_hash, evidence_id); used: (answer_id, evidence_id) of its claims; cited: (answer_id, source_id).
    A facet is covered if enough of its evidence is used and all of it is in the packet. Violations: no_spec, not_bound (the
    answer's packet is another), facet_outside_packet:<id>, facet_missing:<id>, status_not_allowed, open_gap_required,
    cited_sources. Complete means none; an answer without required facets has 10,000 basis points.

    The evidence of a packet and of an answer, and an answer's sources, are bounded by its contract: each becomes one row of
    64-bit hashes, so evidence ids are not shuffled, nor a row for each of a facet.
    """
    code = lambda e: F.xxhash64(e.cast("string"))
    empty = F.array().cast("array<bigint>")
    own = F.array_distinct(F.transform(F.array_compact(F.coalesce("evidence_ids_any", F.array())), code))
    listed = facets.groupBy("task_id").agg(F.collect_list(F.struct("facet_id", "min_evidence", own.alias("e"))).alias("_f"))  # a task's facets are few
    bound = specs.select("task_id", F.col("packet_hash").alias("_bound"), "allowed_statuses", "require_open_gap", "min_cited_sources")
    coded = lambda rows, c, name: rows.filter("evidence_id IS NOT NULL").groupBy(c).agg(F.collect_set(code(F.col("evidence_id"))).alias(name))
    held = bound.select("task_id", "_bound").join(coded(packet.withColumnRenamed("packet_hash", "_bound"), "_bound", "_held"), "_bound", "left").select("task_id", F.coalesce("_held", empty).alias("_held"))
    tasks = listed.join(held, "task_id", "left").select("task_id", F.transform("_f", lambda f: F.struct(f["facet_id"].alias("facet_id"), f["min_evidence"].alias("least"), f["e"].alias("e"), (F.col("_held").isNotNull() & (F.size(F.array_except(f["e"], F.coalesce("_held", empty))) > 0)).alias("bad"))).alias("_f"))
    met = answers.select("answer_id", "task_id").join(tasks, "task_id").join(coded(used, "answer_id", "_used"), "answer_id", "left")
    met = met.select("answer_id", F.transform("_f", lambda f: F.struct(f["facet_id"].cast("string").alias("id"), f["bad"].alias("bad"), ((F.size(F.array_intersect(f["e"], F.coalesce("_used", empty))) >= f["least"]) & ~f["bad"]).alias("ok"))).alias("_f"))
    codes = F.transform("_f", lambda f: F.array_compact(F.array(F.when(f["bad"], F.concat(F.lit("facet_outside_packet:"), f["id"])), F.when(~f["ok"], F.concat(F.lit("facet_missing:"), f["id"])))))
    per = met.select("answer_id", F.size(F.filter("_f", lambda f: f["ok"])).alias("covered"), F.size("_f").alias("required"), F.flatten(codes).alias("_codes"))
    sources = cited.groupBy("answer_id").agg(F.size(F.collect_set("source_id")).alias("cited_sources"))
    rows = answers.join(bound, "task_id", "left").join(per, "answer_id", "left").join(sources, "answer_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    own = _listed(
        F.when(F.col("_bound").isNull(), "no_spec"), F.when(F.col("_bound").isNotNull() & ~F.col("packet_hash").eqNullSafe(F.col("_bound")), "not_bound"),
        F.when(F.col("_bound").isNotNull() & ~F.coalesce(F.array_contains("allowed_statuses", F.col("status")), F.lit(False)), "status_not_allowed"),
        F.when(F.coalesce("require_open_gap", F.lit(False)) & F.col("open_gap").isNull(), "open_gap_required"), F.when(n("cited_sources") < n("min_cited_sources"), "cited_sources"),
    )
    violations = F.array_sort(F.concat(own, F.coalesce("_codes", F.array().cast("array<string>"))))
    points = F.when(n("required") > 0, F.floor(n("covered") * 10000 / n("required"))).otherwise(10000).cast("long")
    return rows.select("answer_id", n("covered").alias("covered"), n("required").alias("required"), points.alias("basis_points"), n("cited_sources").alias("cited_sources"), violations.alias("violations"), F.when(F.size(violations) == 0, "complete").otherwise("incomplete").alias("decision"))


def entailment(answers: DataFrame, cases: DataFrame, receipts: DataFrame, judgments: DataFrame, judge: str | None = None) -> DataFrame:
    """(answer_id, decision, reasons) of answers by the judgments of their claims.

    answers: (answer_id, contract_accepted, coverage_complete, case_set_hash); cases: (answer_id, claim_id, status); receipts:
    (answer_id, receipt_id, case_set_hash, judge), at most one an answer; judgments: (receipt_id, claim_id, verdict).
    unchecked: an earlier stage failed, and nothing else is looked at. review_required: no receipt, a stale one (of another
    case set), the wrong judge, a claim without a judgment, with two, or a judgment of no claim; or, with all that in
    order, a claim whose state is uncertain and none that fails. failed: a claim that fails. Else passed.

    Cases and judgments meet by answer in one shuffle, as numbers; what is grouped by claim after that moves no more.
    """
    late = F.when(~F.coalesce("contract_accepted", F.lit(False)), "contract").when(~F.coalesce("coverage_complete", F.lit(False)), "coverage")
    mine = receipts.select(F.col("answer_id").alias("_a"), "receipt_id", F.col("case_set_hash").alias("_held"), F.col("judge").alias("_judge"))
    # a verdict's weight for an inference and for another claim; that of a claim judged twice is not looked at
    weight = lambda status: F.when((s := gates.claim_state(F.lit(status), F.col("verdict"))) == "failed", 2).when(s == "review_required", 1).otherwise(0)
    weighed = judgments.select("receipt_id", "claim_id", weight("inference").alias("_wi"), weight("").alias("_wo")).repartition("receipt_id")
    counted = weighed.groupBy("receipt_id", "claim_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_wi").alias("_wi"), F.max("_wo").alias("_wo"))
    said = counted.join(mine.select("_a", "receipt_id"), "receipt_id").select(F.col("_a").alias("answer_id"), "claim_id", "_n", "_wi", "_wo")
    stated = cases.select("answer_id", "claim_id", (F.col("status").eqNullSafe("inference")).alias("_inference"))
    both = stated.unionByName(said, allowMissingColumns=True).repartition("answer_id")
    claims = both.groupBy("answer_id", "claim_id").agg(F.max("_inference").alias("_any"), F.min("_inference").alias("_all"), F.max("_n").alias("_n"), F.max("_wi").alias("_wi"), F.max("_wo").alias("_wo"))
    whole = F.col("_any").isNotNull() & F.col("_n").isNotNull()
    state = lambda w: (F.col("_any") & (F.col("_wi") == w)) | (~F.col("_all") & (F.col("_wo") == w))
    per = claims.groupBy("answer_id").agg(
        F.count_if(F.col("_n").isNull()).alias("_missing"), F.count_if(F.col("_any").isNull()).alias("_extra"), F.count_if(F.col("_n") > 1).alias("_twice"),
        F.count_if(whole & state(2)).alias("_failed"), F.count_if(whole & state(1)).alias("_unsure"),
    )
    rows = answers.join(mine, F.col("answer_id") == F.col("_a"), "left").join(per, "answer_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    none = F.col("receipt_id").isNull()
    wrong = F.lit(False) if judge is None else ~F.col("_judge").eqNullSafe(F.lit(judge))
    faults = F.when(none, F.array(F.lit("no_receipt"))).otherwise(_listed(F.when(~F.col("_held").eqNullSafe(F.col("case_set_hash")), "stale_receipt"), F.when(wrong, "wrong_judge"), F.when(n("_missing") > 0, "missing_judgment"), F.when(n("_extra") > 0, "extra_judgment"), F.when(n("_twice") > 0, "repeated_judgment")))
    reasons = F.when(late.isNotNull(), F.array(late)).when(F.size(faults) > 0, faults).otherwise(_listed(F.when(n("_failed") > 0, "claim_failed"), F.when(n("_unsure") > 0, "claim_uncertain")))
    decision = F.when(late.isNotNull(), "unchecked").when(F.size(faults) > 0, "review_required").when(n("_failed") > 0, "failed").when(n("_unsure") > 0, "review_required").otherwise("passed")
    return rows.select("answer_id", decision.alias("decision"), reasons.alias("reasons"))


def case_set_hash(cases: DataFrame) -> DataFrame:
    """(answer_id, case_set_hash) over (answer_id, claim_id, status): the same for any order of the claims."""
    rows = cases.select("answer_id", F.concat_ws("\x1f", F.col("claim_id").cast("string"), "status").alias("member"))
    return set_manifest(rows, "answer_id", "member").select("answer_id", F.col("manifest_hash").alias("case_set_hash"))


def candidate_receipts(scores: DataFrame, questions: DataFrame, threshold: float, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores (route_id, channel, question_id, score) of many routes to their candidates and to the faults of what was supplied.

    Semantic candidates reach the threshold; lexical ones have a score above 0. Ranks are contiguous in a channel, by score and
    question, and `place` puts semantic ones first. Faults (route_id, question_id, fault): unknown (no such question),
    repeated (twice, in one channel or in two), not_positive (a lexical score), not_finite. A route with a fault has no
    candidates; one without candidates abstains, which the caller sees by its absence.
    """
    known = questions.select("question_id").distinct().withColumn("_k", F.lit(True))
    rows = scores.join(known, "question_id", "left")
    per = Window.partitionBy("route_id", "question_id")
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    codes = F.array_compact(F.array(F.when(F.col("_k").isNull(), "unknown"), F.when(F.count(F.lit(1)).over(per) > 1, "repeated"), F.when(~finite, "not_finite").when((F.col("channel") == "lexical") & (F.col("score") <= 0), "not_positive")))
    rows = rows.withColumn("_f", codes)
    faults = rows.select("route_id", "question_id", F.explode("_f").alias("fault")).distinct()
    good = rows.join(faults.select("route_id").distinct(), "route_id", "left_anti").filter((F.col("channel") == "lexical") | (F.col("score") >= threshold))
    rank = F.row_number().over(Window.partitionBy("route_id", "channel").orderBy(F.desc("score"), "question_id"))
    place = F.row_number().over(Window.partitionBy("route_id").orderBy(F.col("channel") != "semantic", F.desc("score"), "question_id"))
    out = good.withColumn("rank", rank.cast("long"))
    out = out.filter(F.col("rank") <= most) if most is not None else out
    return out.withColumn("place", place.cast("long")).select("route_id", "channel", "question_id", "score", "rank", "place"), faults


#: Fixed value: the form of a canonical UTC timestamp.
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"


def timestamp_text(at: Column) -> Column:
    """A timestamp in canonical UTC form, to the microsecond; the session's time zone has to be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parsed_timestamp(text: Column) -> Column:
    """The timestamp of a canonical text; null for any other form, and for dates and times that don't exist."""
    at = F.try_to_timestamp(F.when(text.rlike(TIMESTAMP), text), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return F.when(timestamp_text(at) == text, at)


def interval_faults(rows: DataFrame, key: str, start: str, end: str, clocks: list[str] | None = None) -> DataFrame:
    """(`key`, fault) of rows whose times, canonical texts, are wrong: no_clock (all are null), not_canonical:<column>, reversed."""
    every = [start, end, *(clocks or [])]
    wrong = [F.when(F.col(c).isNotNull() & parsed_timestamp(F.col(c)).isNull(), f"not_canonical:{c}") for c in every]
    none = F.when(F.coalesce(*[F.col(c) for c in every]).isNull(), "no_clock")
    back = F.when(parsed_timestamp(F.col(start)) > parsed_timestamp(F.col(end)), "reversed")
    return rows.select(key, F.explode(F.array_compact(F.array(none, *wrong, back))).alias("fault"))


def scope_token(compiled: DataFrame, *parts: str) -> str:
    """The token of a permitted set as of now: a hash of its members and of what else it is bound to, such as library, snapshot and policy."""
    allowed = compiled.filter("permitted").select(F.lit(1).alias("s"), F.col("fragment_id").cast("string").alias("member")).distinct()
    first = set_manifest(allowed, "s", "member").first()
    held = first["manifest_hash"] if first else ""
    return compiled.sparkSession.range(1).select(packets.permit(*[F.lit(p) for p in parts], F.lit(held))).first()[0]


def authorised_read(fragments: DataFrame, compiled: DataFrame, token: str, *parts: str) -> DataFrame:
    """Permitted fragments (fragment_id, ...), if the scope, compiled anew, still gives the token that the read was issued under; else an error."""
    if scope_token(compiled, *parts) != token:
        raise PermissionError("the scope has changed since this read was authorised")
    return fragments.join(compiled.filter("permitted").select("fragment_id").distinct(), "fragment_id", "left_semi")
