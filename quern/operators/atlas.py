"""Research atlases: loading with closure checks, closures of a route, budgets, and connector packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of an atlas object that name other objects, and the kind they name.
REFERENCES = {"questions": {"evidence_ids": "evidence"}, "hypotheses": {"evidence_ids": "evidence", "question_ids": "questions"}, "evidence": {"source_ids": "sources"}, "relations": {"evidence_ids": "evidence"}}


#: Ids that a map of a migration may hold.
MOST_IDS = 100_000


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The objects of an atlas document by kind, each with an `id`; one JSON file, read whole."""
    doc = spark.read.option("multiLine", "true").json(path)
    kinds = [f.name for f in doc.schema.fields if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct"]
    return {k: doc.select(F.inline(k)) for k in kinds}


def dangling(atlas: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, field, missing): references that no object answers; empty when an atlas is closed."""
    found = None
    for kind, fields in REFERENCES.items():
        for field, target in fields.items():
            if kind not in atlas or field not in atlas[kind].columns:
                continue
            refs = atlas[kind].select(F.lit(kind).alias("kind"), "id", F.lit(field).alias("field"), F.explode(field).alias("missing"))
            known = atlas[target].select(F.col("id").alias("missing")) if target in atlas else refs.select("missing").limit(0)
            lost = refs.join(known, "missing", "left_anti").select("kind", "id", "field", "missing")
            found = lost if found is None else found.unionByName(lost)
    if found is None:
        raise ValueError("the atlas has no kind with references")
    return found


def migrate_ids(rows: DataFrame, mapping: DataFrame, columns: list[str], arrays: list[str] = ()) -> DataFrame:
    """Old ids to new ones by a (old, new) table, in columns and in array columns; an unmapped id becomes null.

    The table is one atlas's ids and goes into one map: over MOST_IDS is an error (`imports.migrated` joins instead).
    """
    if mapping.limit(MOST_IDS + 1).count() > MOST_IDS:
        raise ValueError(f"over {MOST_IDS} ids")
    table = mapping.agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("_m"))
    rows = rows.crossJoin(F.broadcast(table))  # one row
    for c in columns:
        rows = rows.withColumn(c, F.try_element_at("_m", F.col(c)))
    for c in arrays:
        rows = rows.withColumn(c, F.transform(c, lambda x: F.try_element_at(F.col("_m"), x)))
    return rows.drop("_m")


def admit(objects: list[dict], evidence_sources: dict[str, list[str]], most_evidence: int, most_sources: int) -> tuple[list[str], list[tuple[str, str]]]:
    """Objects in rank order while the evidence and sources they need fit; what doesn't is omitted with a reason.

    Admission depends on what came before it, so it is a loop over one route's objects: bounded, on the driver.
    """
    evidence: set[str] = set()
    sources: set[str] = set()
    kept: list[str] = []
    omitted: list[tuple[str, str]] = []
    for o in objects:
        need = evidence | set(o["evidence_ids"])
        wide = sources | {s for e in o["evidence_ids"] for s in evidence_sources.get(e, [])}
        if len(need) > most_evidence:
            omitted.append((o["id"], "evidence_budget"))
        elif len(wide) > most_sources:
            omitted.append((o["id"], "source_budget"))
        else:
            evidence, sources = need, wide
            kept.append(o["id"])
    return kept, omitted


def connector_packet(evidence: DataFrame, roles: list[str], most: int) -> tuple[DataFrame, list[str]]:
    """(id, role, rank) rows in order of role and rank, and the required roles without any; over `most` rows is an error."""
    n = evidence.limit(most + 1).count()
    if n > most:
        raise ValueError(f"over the budget of {most} rows")
    order = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    present = {r.role for r in evidence.select("role").distinct().limit(len(roles) + 1).collect()}
    return evidence.orderBy(order, "rank", "id"), [r for r in roles if r not in present]


def connector_packets(evidence: DataFrame, gaps: DataFrame, sources: DataFrame, roles: list[str], budget: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Packets of many requests at once: (packet_id, section, place, id, role) rows and (packet_id, state, missing_roles, faults).

    evidence: (packet_id, id, role, rank, source_id); gaps: (packet_id, id, rank); sources: (id). Sections are evidence in
    order of role and rank, gaps by rank, and the sources that the evidence names, each once, in order of its first
    mention. Budgets (`evidence`, `gaps`, `sources`) are hard: a packet over one is a fault (`over:<section>`) and has no
    rows, it is never cut short; so is evidence of a source that isn't there (`unknown_source`) or of a role that isn't
    known (`unknown_role`). A packet that lacks a required role is partial, else complete; one with a fault is refused.
    """
    order = F.array_position(F.array(*map(F.lit, roles)), F.col("role"))
    known = sources.select(F.col("id").alias("_s"), F.lit(True).alias("_k")).distinct()
    rows = evidence.withColumn("_o", order).join(known, F.col("source_id") == F.col("_s"), "left")
    named = rows.groupBy("packet_id", "source_id").agg(F.min(F.struct("_o", "rank", "id")).alias("_first"))
    per = rows.groupBy("packet_id").agg(F.count(F.lit(1)).alias("_e"), F.count_distinct("source_id").alias("_src"), F.collect_set("role").alias("_roles"), F.bool_or(F.col("_k").isNull()).alias("_lost"), F.bool_or(F.coalesce(F.col("_o"), F.lit(0)) == 0).alias("_odd"))  # roles are few
    open_ = gaps.groupBy("packet_id").agg(F.count(F.lit(1)).alias("_g"))
    both = per.join(open_, "packet_id", "full_outer")
    no = lambda c: F.coalesce(c, F.lit(0))
    faults = F.array_sort(F.array_compact(F.array(
        F.when(no("_e") > budget["evidence"], "over:evidence"), F.when(no("_g") > budget["gaps"], "over:gaps"), F.when(no("_src") > budget["sources"], "over:sources"), F.when(F.coalesce("_lost", F.lit(False)), "unknown_source"), F.when(F.coalesce("_odd", F.lit(False)), "unknown_role"),
    )))
    missing = F.filter(F.array(*map(F.lit, roles)), lambda r: ~F.array_contains(F.coalesce("_roles", F.array().cast("array<string>")), r))
    states = both.select("packet_id", missing.alias("missing_roles"), faults.alias("faults"))
    states = states.select("packet_id", F.when(F.size("faults") > 0, "refused").when(F.size("missing_roles") > 0, "partial").otherwise("complete").alias("state"), "missing_roles", "faults").checkpoint()
    good = states.filter("state <> 'refused'").select("packet_id")
    by = Window.partitionBy("packet_id")
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string").alias("id")
    parts = [
        rows.select("packet_id", F.lit("evidence").alias("section"), F.row_number().over(by.orderBy("_o", "rank", "id")).alias("place"), text("id"), "role"),
        gaps.select("packet_id", F.lit("gaps").alias("section"), F.row_number().over(by.orderBy("rank", "id")).alias("place"), text("id"), none.alias("role")),
        named.select("packet_id", F.lit("sources").alias("section"), F.row_number().over(by.orderBy("_first")).alias("place"), text("source_id"), none.alias("role")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("place", F.col("place").cast("long"))
    return out.join(good, "packet_id", "left_semi"), states


def closed(atlas: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The atlas, if every reference in it is answered; else an error that names some that are not."""
    lost = dangling(atlas).limit(5).collect()
    if lost:
        raise ValueError(f"the atlas is not closed: {[tuple(r) for r in lost]}")
    return atlas


def route_candidates(scores: DataFrame, threshold: float, most: int) -> DataFrame:
    """(channel, question_id, score) to those at or over the threshold, contiguous ranks per channel, each question once."""
    best = scores.groupBy("channel", "question_id").agg(F.max("score").alias("score")).filter(F.col("score") >= threshold)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "question_id")))
    return ranked.filter(F.col("rank") <= most)


def trace_faults(steps: DataFrame, conclusion: DataFrame) -> DataFrame:
    """(trace_id, step_no, operation, premises array) to (trace_id, step_no, fault): later premises, wrong shapes, orphans.

    An extract has no premises, an infer or connect at least one, a compare at least two; every step but the
    conclusion (trace_id, step_no) is a premise of some step.
    """
    n = F.size("premises")
    late = F.exists("premises", lambda p: p >= F.col("step_no"))
    shape = F.when(F.col("operation") == "extract", n != 0).when(F.col("operation") == "compare", n < 2).otherwise(n < 1)
    own = steps.select("trace_id", "step_no", F.array_compact(F.array(F.when(late, "premise_not_earlier"), F.when(shape, "shape"))).alias("f"))
    faults = own.select("trace_id", "step_no", F.explode("f").alias("fault"))
    used = steps.select("trace_id", F.explode("premises").alias("step_no")).distinct()
    orphans = steps.select("trace_id", "step_no").join(used, ["trace_id", "step_no"], "left_anti").join(conclusion, ["trace_id", "step_no"], "left_anti")
    return faults.unionByName(orphans.withColumn("fault", F.lit("orphan")))
