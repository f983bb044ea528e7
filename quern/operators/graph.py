"""Typed, grounded relation graphs: authorised nodes and edges, bounded walks, closures and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def authorised_nodes(grounding: DataFrame, permitted: DataFrame) -> DataFrame:
    """(node_type, node_id, fragment_id) to nodes with at least one grounding fragment and all of them permitted."""
    marked = grounding.join(permitted.select("fragment_id").distinct().withColumn("_p", F.lit(True)), "fragment_id", "left")
    return marked.groupBy("node_type", "node_id").agg(F.bool_and(F.coalesce("_p", F.lit(False))).alias("_all")).filter("_all").select("node_type", "node_id")


def authorised_edges(edges: DataFrame, evidence: DataFrame, permitted: DataFrame, nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges whose ends are authorised and whose evidence is all permitted and as many as the edge states."""
    if types:
        edges = edges.filter(F.col("relation_type").isin(types))
    marked = evidence.join(permitted.select("fragment_id").distinct().withColumn("_p", F.lit(True)), "fragment_id", "left")
    whole = marked.groupBy("relation_id").agg(F.bool_and(F.coalesce("_p", F.lit(False))).alias("_all"), F.count(F.lit(1)).alias("_n")).filter("_all")
    kept = edges.join(whole, "relation_id").filter(F.col("_n") == F.col("evidence_count")).drop("_all", "_n")
    return kept.join(nodes.select(F.col("node_id").alias("subject_id")), "subject_id", "left_semi").join(nodes.select(F.col("node_id").alias("object_id")), "object_id", "left_semi")


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(relation_id, src, dst) for outgoing, incoming or both."""
    out = edges.select("relation_id", F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))
    back = edges.select("relation_id", F.col("object_id").alias("src"), F.col("subject_id").alias("dst"))
    return {"outgoing": out, "incoming": back}.get(direction, out.unionByName(back))


def walk(edges: DataFrame, seeds: DataFrame, most_hops: int, most_paths: int | None = None) -> DataFrame:
    """Simple paths of 1 to `most_hops` edges (relation_id, src, dst) from the seeds (node): no node twice in a path.

    A loop of joins, each one hop. The limit takes paths in order of depth, relations, seed and end: once shorter paths
    fill it, no further hop is run, and of a hop's paths the first that still fit are kept by a bounded heap; then paths
    are in order of `path_hash`, which covers seed, relations and nodes.
    """
    now = seeds.select(F.col("node").alias("seed"), F.col("node").alias("at"), F.array("node").alias("nodes"), F.array().cast("array<string>").alias("relations"))
    found, left = None, most_paths
    for depth in range(1, most_hops + 1):
        step = now.join(edges, now["at"] == edges["src"]).filter(~F.array_contains("nodes", F.col("dst")))
        now = step.select("seed", F.col("dst").alias("at"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("relations", F.array(F.col("relation_id").cast("string"))).alias("relations"))
        here = now.withColumn("depth", F.lit(depth).cast("long")).withColumn("relation_path", F.array_join("relations", ">"))
        if left is not None:
            if depth < most_hops:
                now = now.checkpoint()  # a hop is counted, and taken up again by the next
                here = now.withColumn("depth", F.lit(depth).cast("long")).withColumn("relation_path", F.array_join("relations", ">"))
            here = here.orderBy("relation_path", "seed", "at").limit(left)
        found = here if found is None else found.unionByName(here)
        if left is not None and depth < most_hops:
            left -= here.count()
            if left <= 0:
                break
    body = F.concat_ws("\x1f", F.col("seed").cast("string"), "relation_path", F.array_join("nodes", ">"))
    out = found.select("seed", "at", "depth", "relation_path", F.array_join("nodes", ">").alias("node_path"), F.sha2(body, 256).alias("path_hash"))
    return out.orderBy("path_hash") if most_paths is not None else out


def path_faults(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, relation_path, node_path) paths against edges (relation_id, src, dst): (path_hash, step, fault).

    Faults: unknown_relation, or broken where a relation doesn't lead from its step's node to the next; a path that doesn't
    begin at its seed is broken at step 0, and one with as many nodes as relations, or fewer, at its last step.
    """
    relations, nodes = F.split("relation_path", ">"), F.split("node_path", ">")
    steps = paths.select("path_hash", F.col("seed").cast("string").alias("seed"), relations.alias("r"), nodes.alias("n"))
    start = steps.filter(F.col("seed") != F.get("n", F.lit(0))).select("path_hash", F.lit(0).alias("step"), F.lit("broken").alias("fault"))
    short = steps.filter(F.size("n") != F.size("r") + 1).select("path_hash", F.size("r").alias("step"), F.lit("broken").alias("fault"))
    each = steps.select("path_hash", "n", F.posexplode("r").alias("k", "relation_id")).select("path_hash", (F.col("k") + 1).alias("step"), "relation_id", F.get("n", F.col("k")).alias("a"), F.get("n", F.col("k") + 1).alias("b"))
    known = edges.select(F.col("relation_id").cast("string").alias("relation_id"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    met = each.join(known, "relation_id", "left").groupBy("path_hash", "step").agg(F.max(F.col("src").isNotNull()).alias("known"), F.max(F.coalesce((F.col("src") == F.col("a")) & (F.col("dst") == F.col("b")), F.lit(False))).alias("ok"))
    wrong = met.filter("NOT ok").select("path_hash", "step", F.when(F.col("known"), "broken").otherwise("unknown_relation").alias("fault"))
    return start.unionByName(short).unionByName(wrong).distinct()


#: Tables of new nodes that a closure keeps apart before it puts them together.
MOST_PARTS = 16


def closure(edges: DataFrame, seeds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """What (src, dst) edges lead to from the seeds (`by`..., node), seeds included: each node once for each `by`.

    Many closures at once, and only what is new is joined: a round takes the nodes of the round before to their
    neighbours and leaves out those that are known. It goes on until a round finds nothing, however long the paths
    are; every round is checkpointed. Null nodes lead nowhere.
    """
    key = [*(by or []), "node"]
    fresh = seeds.select(*key).filter("node IS NOT NULL").distinct().checkpoint()
    parts = [fresh]
    known = fresh
    steps = edges.select("src", F.col("dst").alias("_to")).filter("src IS NOT NULL AND _to IS NOT NULL").distinct()
    while not fresh.isEmpty():
        to = fresh.join(steps, fresh["node"] == steps["src"]).select(*(by or []), F.col("_to").alias("node")).distinct()
        fresh = to.join(known, key, "left_anti").checkpoint()
        parts.append(fresh)
        if len(parts) > MOST_PARTS:
            parts = [_together(parts).checkpoint()]
        known = _together(parts)
    return known


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Fixpoint of following (src, dst) edges from the seeds (node)."""
    return closure(edges, seeds)


#: Node types that a walk may start from.
SEED_TYPES = ["statement", "concept_meaning", "structure_unit"]


def seeds(retrieved: DataFrame, grounding: DataFrame) -> DataFrame:
    """Nodes of the seed types that a retrieved fragment grounds: (node_type, node_id), each once."""
    return grounding.filter(F.col("node_type").isin(SEED_TYPES)).join(retrieved.select("fragment_id").distinct(), "fragment_id", "left_semi").select("node_type", "node_id").distinct()


def grounding_of(nodes: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """(node_type, node_id, fragment_id) of nodes over one (node_id, fragment_id) table per node type."""
    found = None
    for kind, table in links.items():
        rows = nodes.filter(F.col("node_type") == kind).join(table.select("node_id", "fragment_id"), "node_id").select("node_type", "node_id", "fragment_id")
        found = rows if found is None else found.unionByName(rows)
    return found.distinct()


def import_relations(held: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations (relation_type, subject_id, object_id) under ids of their content: those that are new, and a receipt.

    The same import a second time adds nothing; the receipt counts what came, what was new and what was there.
    """
    key = F.sha2(F.concat_ws("\x1f", "relation_type", F.col("subject_id").cast("string"), F.col("object_id").cast("string")), 256)
    rows = incoming.withColumn("relation_id", F.concat(F.lit("relation_"), F.substring(key, 1, 32))).dropDuplicates(["relation_id"])
    new = rows.join(held.select("relation_id"), "relation_id", "left_anti")
    came = incoming.agg(F.count(F.lit(1)).alias("received")).crossJoin(rows.agg(F.count(F.lit(1)).alias("distinct")))
    receipt = came.crossJoin(new.agg(F.count(F.lit(1)).alias("inserted"))).withColumn("known", F.col("distinct") - F.col("inserted"))
    return new, receipt


def route_rank(objects: DataFrame, terms, fields: dict[str, int], key: str, most: int) -> DataFrame:
    """Objects by weighted overlap of their fields' terms with a question's; ties by key; zero scores left out."""
    score = sum((F.size(F.array_intersect(F.col(f), terms)) * w for f, w in fields.items()), F.lit(0))
    ranked = objects.withColumn("score", score.cast("long")).filter("score > 0")
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)).cast("long")).filter(F.col("rank") <= most)
