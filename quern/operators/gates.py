"""Evidence, claim and reasoning gates as set-oriented queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import numbers, strict


#: Selectors of a requirement, the candidate's column they look at, and the code when it fails.
SELECTORS = [("sources_any", "source_id", "wrong_source"), ("source_kinds_any", "source_kind", "wrong_source_kind"), ("source_families_any", "source_family", "wrong_source_family"), ("authorities_any", "authority", "wrong_authority")]
#: Requirements that may be broadcast.
MOST_REQUIREMENTS = 10_000


def requirement_codes(requirements: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every requirement against every candidate: sorted rejection codes (none: it counts).

    Requirements (key, min_groups, sources_any, source_kinds_any, source_families_any, authorities_any, anchors, tags_all,
    forbidden) are few, by contract: over MOST_REQUIREMENTS is an error. An empty selector is no constraint, anchors are
    groups of which each needs one present. A text is normalised once, whatever the number of requirements.
    """
    n = requirements.count()
    if n > MOST_REQUIREMENTS:
        raise ValueError(f"{n} requirements exceed {MOST_REQUIREMENTS}")
    padded = F.concat(F.lit(" "), F.regexp_replace(strict(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+", " "), F.lit(" "))
    # a generator's output is a value: Spark can't move the pattern into the tests below
    c = candidates.withColumn("_t", F.explode_outer(F.array(padded))).drop("text")
    rows = c.crossJoin(F.broadcast(requirements))
    holds = lambda words: F.exists(words, lambda w: F.contains("_t", F.concat(F.lit(" "), w, F.lit(" "))))
    wrong = [F.when((F.size(s) > 0) & ~F.coalesce(F.array_contains(s, F.col(c)), F.lit(False)), code) for s, c, code in SELECTORS]
    missing = F.transform("anchors", lambda g, i: F.when(~holds(g), F.concat(F.lit("missing_anchor_group_"), i.cast("string"))))
    tags = F.transform(F.array_except("tags_all", F.coalesce("tags", F.array().cast("array<string>"))), lambda t: F.concat(F.lit("missing_tag_"), t))
    codes = F.array_sort(F.array_compact(F.concat(F.array(*wrong, F.when(holds(F.col("forbidden")), "forbidden_anchor_present")), missing, tags)))
    return rows.select("key", "candidate_id", "rank", "independence_group", "min_groups", codes.alias("codes"))


def spec_faults(requirements: DataFrame) -> DataFrame:
    """(key, fault) of a requirement table: keys used twice, and requirements without any positive condition."""
    conditions = [F.size(s) for s, _, _ in SELECTORS] + [F.size("anchors"), F.size("tags_all")]
    per = requirements.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min(sum(conditions[1:], conditions[0])).alias("_c"))
    faults = F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate_key"), F.when(F.col("_c") == 0, "no_positive_condition")))
    return per.select("key", F.explode(faults).alias("fault"))


def lineage_faults(sources: DataFrame) -> DataFrame:
    """(kind, id) of sources with more than one family or group, and of families with more than one group."""
    one = sources.groupBy("source_id").agg(F.count_distinct("source_family").alias("f"), F.count_distinct("independence_group").alias("g"))
    two = sources.groupBy("source_family").agg(F.count_distinct("independence_group").alias("g"))
    bad = one.filter("f > 1 OR g > 1").select(F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("id"))
    return bad.unionByName(two.filter("g > 1").select(F.lit("family").alias("kind"), F.col("source_family").cast("string").alias("id")))


def coverage(assessed: DataFrame) -> DataFrame:
    """Per requirement: distinct independence groups of the candidates that count, and whether they suffice."""
    per = assessed.groupBy("key", "min_groups").agg(F.countDistinct(F.when(F.size("codes") == 0, F.col("independence_group"))).alias("groups"))
    return per.withColumn("covered", F.col("groups") >= F.col("min_groups"))


def decide(cases: DataFrame, assessed: DataFrame) -> DataFrame:
    """(case_id, key, in_corpus, min_total) cases to their decision: each case's requirements, and the distinct groups of all covered ones."""
    per = cases.join(coverage(assessed).select("key", "covered"), "key")
    counts = per.groupBy("case_id", "in_corpus", "min_total").agg(F.count(F.lit(1)).alias("requirements"), F.count_if("covered").alias("covered"))
    counted = assessed.filter(F.size("codes") == 0).select("key", "independence_group").distinct()
    groups = per.filter("covered").join(counted, "key").groupBy("case_id").agg(F.count_distinct("independence_group").alias("groups"))
    rows = counts.join(groups, "case_id", "left").withColumn("groups", F.coalesce("groups", F.lit(0)))
    return rows.withColumn("decision", gate_decision(F.col("in_corpus"), F.col("requirements"), F.col("covered"), F.col("groups") >= F.col("min_total")))


def closest(assessed: DataFrame, most: int = 3) -> DataFrame:
    """Per requirement the rejected candidates with the fewest codes, then by rank and id."""
    order = Window.partitionBy("key").orderBy(F.size("codes"), "rank", "candidate_id")
    return assessed.filter(F.size("codes") > 0).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def gate_decision(in_corpus: Column, n: Column, covered: Column, total_ok: Column) -> Column:
    """ready, partial or insufficient; gap_preserved or gap_challenged where no answer is expected in the corpus."""
    full = (covered == n) & total_ok
    return F.when(~in_corpus, F.when(full, "gap_challenged").otherwise("gap_preserved")).otherwise(F.when(full, "ready").when(covered > 0, "partial").otherwise("insufficient"))


def unquoted_numbers(claims: DataFrame) -> DataFrame:
    """(claim_id, text, quotes) to the numbers of the claim that none of its quotes holds."""
    quoted = F.flatten(F.transform("quotes", numbers))
    return claims.withColumn("unsupported", F.array_sort(F.array_except(numbers(F.col("text")), F.coalesce(quoted, F.array().cast("array<string>")))))


def claim_state(status: Column, verdict: Column) -> Column:
    """passed, failed or review_required of a judged claim; an inference may rest on a supported inference."""
    fails = verdict.isin("partial", "unsupported", "contradicted")
    direct = verdict == "directly_supported"
    return F.when(verdict == "uncertain", "review_required").when(fails, "failed").when(direct | ((status == "inference") & (verdict == "supported_inference")), "passed").otherwise("failed")


def set_state(judged: DataFrame, by: str) -> DataFrame:
    """Of a set of claims: failed if any failed, else review_required if any is, else passed."""
    severity = F.max(F.when(F.col("state") == "failed", 2).when(F.col("state") == "review_required", 1).otherwise(0))
    return judged.groupBy(by).agg(F.when(severity == 2, "failed").when(severity == 1, "review_required").otherwise("passed").alias("state"))


def exact_span(text: Column, start: Column, end: Column, span: Column) -> Column:
    """Whether text[start:end], counted from 0, is the span."""
    return F.substring(text, start + 1, end - start) == span


def proposition_gaps(spans: DataFrame) -> DataFrame:
    """Ordered (answer_id, start, end) spans that don't begin where the one before ends."""
    by = Window.partitionBy("answer_id").orderBy("start")
    return spans.withColumn("expected", F.coalesce(F.lag("end").over(by), F.lit(0))).filter(F.col("start") != F.col("expected"))


def contract_faults(quotes: DataFrame, packet: DataFrame, lines: DataFrame) -> DataFrame:
    """(answer_id, fragment_id, quote, line_from, line_to, lines_hash) of an answer against its packet and the artifacts' texts.

    Faults: not_in_packet, quote_not_in_excerpt, lines_changed (the hash isn't that of these lines of the text).
    """
    held = packet.select("fragment_id", F.col("excerpt").alias("_e")).dropDuplicates(["fragment_id"])
    rows = quotes.join(held, "fragment_id", "left").join(lines.select("fragment_id", F.col("text").alias("_t")), "fragment_id", "left")
    part = F.array_join(F.slice(F.split("_t", "\n"), F.col("line_from"), F.greatest(F.col("line_to") - F.col("line_from") + 1, F.lit(0))), "\n")
    changed = ~F.coalesce(F.sha2(part, 256) == F.col("lines_hash"), F.lit(False))
    faults = F.array_compact(F.array(F.when(F.col("_e").isNull(), "not_in_packet"), F.when(~F.contains("_e", "quote"), "quote_not_in_excerpt"), F.when(changed, "lines_changed")))
    return rows.select("answer_id", "fragment_id", F.explode(faults).alias("fault"))


def validated(stages: DataFrame) -> DataFrame:
    """(answer_id, exact, coverage, semantic) results to each stage's state; what follows a failure is skipped."""
    later = lambda before, own: F.when(~before, "skipped").when(own, "passed").otherwise("failed")
    exact, covered = F.col("exact"), F.col("exact") & F.col("coverage")
    return stages.select("answer_id", F.when(exact, "passed").otherwise("failed").alias("exact"), later(exact, F.col("coverage")).alias("coverage"), later(covered, F.col("semantic")).alias("semantic"), (covered & F.col("semantic")).alias("valid"))


def reasoning_closure(steps: DataFrame, supported: DataFrame) -> DataFrame:
    """(trace_id, step, premise or null) steps against (trace_id, step) supported by evidence: closed if all its grounds are.

    A step without premises is a ground; a step is closed when every ground it leads back to is supported.
    """
    grounds = steps.groupBy("trace_id", "step").agg(F.count("premise").alias("n")).filter("n = 0").select("trace_id", F.col("step").alias("ancestor"))
    own = grounds.select("trace_id", F.col("ancestor").alias("step"), "ancestor")
    reach = premise_closure(steps.filter("premise IS NOT NULL")).select("trace_id", "step", "ancestor").unionByName(own)
    own = reach.join(grounds, ["trace_id", "ancestor"]).join(supported.select("trace_id", F.col("step").alias("ancestor"), F.lit(True).alias("_s")), ["trace_id", "ancestor"], "left")
    return own.groupBy("trace_id", "step").agg(F.bool_and(F.coalesce("_s", F.lit(False))).alias("closed"), F.count(F.lit(1)).alias("grounds"))


def minimal_set(ranked: list[str], ready) -> list[str]:
    """Drop evidence from the back while `ready` holds: inclusion-minimal. Bounded input, on the driver."""
    kept = list(ranked)
    for item in reversed(ranked):
        without = [x for x in kept if x != item]
        if ready(without):
            kept = without
    return kept


def premise_closure(steps: DataFrame) -> DataFrame:
    """(trace_id, step, premise) to every ancestor of each step.

    Every round doubles the length of the paths, and rounds go on until none adds a pair, so no depth is cut off; a
    step that leads back to itself is its own ancestor.
    """
    reach = steps.select("trace_id", "step", F.col("premise").alias("ancestor")).filter("ancestor IS NOT NULL").distinct().checkpoint()
    n, was = reach.count(), -1
    while n != was:
        onward = reach.select("trace_id", F.col("step").alias("ancestor"), F.col("ancestor").alias("_a"))
        more = reach.join(onward, ["trace_id", "ancestor"]).select("trace_id", "step", F.col("_a").alias("ancestor"))
        reach = reach.unionByName(more).distinct().checkpoint()
        was, n = n, reach.count()
    return reach
