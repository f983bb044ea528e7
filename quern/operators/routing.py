"""Lexical routing of many questions at once: four kinds of objects ranked, capped, linked and closed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.graph import closure
from quern.operators.retrieval import blocks

#: Weights of the fields of each kind, in the order in which its fields are given.
WEIGHTS = {"question": [6, 5, 2, 1], "hypothesis": [5, 2, 1], "timeline": [5, 2, 4], "gap": [5, 2, 2]}
KINDS = list(WEIGHTS)
#: Terms of all questions that may be broadcast.
BROADCAST_TERMS = 500_000
#: Ids that may stand in a filter.
LISTED_IDS = 10_000
#: Sums of objects by questions that a task holds at a time.
CELLS = 1_000_000


def weighed(kind: Column, fields: list[Column]) -> Column:
    """(term, weight) pairs of an object of this kind whose fields, arrays of distinct terms, come in the order of WEIGHTS."""

    def terms(field: Column, weight: int) -> Column:
        return F.transform(field, lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    out = F.array().cast("array<struct<term:string,weight:int>>")
    for k, weights in WEIGHTS.items():
        own = F.concat(*[terms(f, w) for f, w in zip(fields, weights, strict=False)])
        out = F.when(kind == k, own).otherwise(out)
    return out


def ranked(questions: DataFrame, objects: DataFrame) -> DataFrame:
    """(query_id, kind, id, place, score) of (query_id, terms) questions and (kind, id, place, terms: array<(term, weight)>) objects.

    The score sums the weights of the fields in which each term of the question occurs; objects without any are left
    out. Terms meet by equality, so no question is held against all objects.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_TERMS else asked
    held = objects.select("kind", "id", "place", F.inline("terms"))
    return held.join(asked, "term").groupBy("query_id", "kind", "id", "place").agg(F.sum("weight").cast("long").alias("score"))


def best(questions: DataFrame, objects: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The rows of `ranked` that are the first `limits[kind]` of their question and kind, by score and then id.

    Each object is scored whole by the task that reads it, and of a block of objects only the first of a question and kind
    leave it, so no row for a pair of question and object is shuffled or stored.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    of_kind = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "id")
    most = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in limits.items()])
    first = lambda rows: rows.withColumn("_p", F.row_number().over(of_kind)).filter(F.col("_p") <= most).drop("_p")
    if asked.count() > BROADCAST_TERMS:
        return first(ranked(questions, objects))
    held = asked.toArrow().combine_chunks()
    people, terms = (pc.dictionary_encode(held[c].combine_chunks(), null_encoding="encode") for c in ("query_id", "term"))
    of = terms.indices.to_numpy()
    begins = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(terms.dictionary)))]).astype(np.int64)
    asking = people.indices.to_numpy().astype(np.int64)[np.argsort(of, kind="stable")]
    sent = objects.sparkSession.sparkContext.broadcast((terms.dictionary, people.dictionary, begins, asking))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, people, begins, asking = sent.value
        degree, wide = np.diff(begins), max(len(people), 1)
        for batch in batches:
            n = batch.num_rows
            kinds, order = np.array(batch.column(0).to_pylist(), object), np.empty(n, np.int64)
            order[pc.sort_indices(batch.column(1), null_placement="at_start").to_numpy()] = np.arange(n)
            term, weight = batch.column(3).flatten().flatten()
            place = pc.fill_null(pc.index_in(term, value_set=names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            found = place >= 0
            sizes = pc.fill_null(pc.list_value_length(batch.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, place, weight = np.repeat(np.arange(n), sizes)[found], place[found], weight.to_numpy(zero_copy_only=False)[found].astype(np.int64)
            pairs = np.bincount(row, weights=degree[place], minlength=n).astype(np.int64)
            for start, end in blocks(pairs, max(CELLS // wide, 1), CELLS):
                own = slice(*np.searchsorted(row, [start, end]))
                many = degree[place[own]]
                at = np.arange(many.sum()) + np.repeat(begins[place[own]] - (np.cumsum(many) - many), many)
                cell, shape = asking[at] * (end - start) + np.repeat(row[own] - start, many), (wide, end - start)
                hits = np.bincount(cell, minlength=wide * (end - start)).reshape(shape) > 0
                sums = np.bincount(cell, weights=np.repeat(weight[own], many), minlength=wide * (end - start)).reshape(shape).astype(np.int64)
                for kind, most in limits.items():
                    rows = np.flatnonzero(kinds[start:end] == kind)
                    keys = np.where(hits[:, rows], sums[:, rows] * n + (n - 1 - order[start:end][rows]), np.iinfo(np.int64).min)
                    if len(rows) > most:
                        top = np.argpartition(keys, len(rows) - most, axis=1)[:, len(rows) - most :]
                    else:
                        top = np.broadcast_to(np.arange(len(rows)), (wide, len(rows)))
                    who, k = np.nonzero(np.take_along_axis(hits[:, rows], top, 1))
                    chosen = rows[top[who, k]]
                    if len(who):
                        objects = [c.take(pa.array(chosen + start)) for c in batch.columns[:3]]
                        yield pa.record_batch([people.take(pa.array(who)), *objects, pa.array(sums[who, chosen])], names=["query_id", "kind", "id", "place", "score"])

    kind_of = lambda rows, c: rows.schema[c].dataType.simpleString()
    rows = objects.select("kind", "id", "place", F.col("terms").cast("array<struct<term:string,weight:int>>").alias("terms"))
    return first(rows.mapInArrow(score, f"query_id {kind_of(questions, 'query_id')}, kind string, id {kind_of(objects, 'id')}, place {kind_of(objects, 'place')}, score long"))


def scored(pairs: DataFrame, questions: DataFrame, objects: DataFrame) -> DataFrame:
    """(query_id, kind, id, score) of the pairs (query_id, kind, id) that `ranked` would give a score; up to LISTED_IDS objects, no terms of others are cut."""
    wanted = [r.id for r in pairs.filter("id IS NOT NULL").select("id").distinct().limit(LISTED_IDS + 1).collect()]
    held = objects.select("kind", "id", "terms")
    if len(wanted) <= LISTED_IDS:  # a filter goes below the projection that cuts a text; a join would stay above it
        held = held.filter(F.col("id").isin(wanted))
    held = held.join(pairs.select("kind", "id").distinct(), ["kind", "id"], "left_semi").select("kind", "id", F.inline("terms"))
    asked = questions.select("query_id", F.explode(F.array_distinct("terms")).alias("term"))
    return pairs.select("query_id", "kind", "id").distinct().join(held, ["kind", "id"]).join(asked, ["query_id", "term"]).groupBy("query_id", "kind", "id").agg(F.sum("weight").cast("long").alias("score"))


def _capped(rows: DataFrame, most: int) -> DataFrame:
    """The first `most` of each question: scored ones by score, then those only linked by their place."""
    order = [F.col("score").isNull(), F.desc("score"), F.when(F.col("score").isNull(), F.col("place")), "id"]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("_p", place).filter(F.col("_p") <= most).drop("_p")


def _chosen(kind: str, first: DataFrame, questions: DataFrame, links: DataFrame, objects: DataFrame, before: DataFrame, most: int) -> DataFrame:
    """Objects of a kind: scored ones, only linked ones if anything is chosen so far for the question, and linked ones after them."""
    to = links.filter(F.col("kind") == kind).select(F.col("id").alias("_id"), F.col("to_kind").alias("_k"), F.col("to_id").alias("_t"))
    linked = before.join(to, (F.col("kind") == F.col("_k")) & (F.col("id") == F.col("_t"))).select("query_id", F.col("_id").alias("id")).distinct()
    linked = linked.join(objects.filter(F.col("kind") == kind).select("kind", "id", "place"), "id").checkpoint()
    some = before.select("query_id").distinct()
    free = first.filter(F.col("kind") == kind).join(some, "query_id", "left_anti").select("query_id", "kind", "id", "place", "score")
    own = scored(linked, questions, objects).select("query_id", "id", "score")
    tied = linked.join(own, ["query_id", "id"], "left").select("query_id", "kind", "id", "place", "score")
    return _capped(free.unionByName(tied), most)


def task_routes(questions: DataFrame, objects: DataFrame, links: DataFrame, relations: DataFrame, limits: dict[str, int]) -> DataFrame:
    """(query_id, kind, id, score, chosen) of each question's route.

    objects: (kind, id, place, terms) as in `ranked`; links: (kind, id, to_kind, to_id) from hypotheses to questions, and
    from timeline and gaps to questions and hypotheses; relations: (id, source, target) between hypotheses; `limits` by kind.
    The best questions are chosen first; hypotheses that are linked to one of them, scored ones first; then events and
    gaps linked to either. Without a chosen question (or hypothesis) a kind's best are chosen freely. What a
    chosen object names is closed over, whatever the limits, and relations with both ends inside come along. `chosen` is
    ranked, linked or closed; scores of closed objects are given if they have one. Questions without terms have no rows.
    """
    first = best(questions, objects, limits).checkpoint()
    known = objects.select(F.col("kind").alias("to_kind"), F.col("id").alias("to_id"))
    links = links.join(known, ["to_kind", "to_id"], "left_semi").join(objects.select("kind", "id"), ["kind", "id"], "left_semi").distinct().checkpoint()
    chosen = _capped(first.filter("kind = 'question'").select("query_id", "kind", "id", "place", "score"), limits["question"]).checkpoint()
    chosen = chosen.unionByName(_chosen("hypothesis", first, questions, links, objects, chosen, limits["hypothesis"])).checkpoint()
    both = chosen
    for kind in ("timeline", "gap"):
        both = both.unionByName(_chosen(kind, first, questions, links, objects, chosen, limits[kind]))
    both = both.checkpoint()
    node = lambda k, i: F.struct(F.col(k).alias("kind"), F.col(i).alias("id"))
    steps = links.select(node("kind", "id").alias("src"), node("to_kind", "to_id").alias("dst"))
    whole = closure(steps, both.select("query_id", node("kind", "id").alias("node")), ["query_id"]).select("query_id", "node.kind", "node.id")
    picked = both.select("query_id", "kind", "id", F.when(F.col("score").isNull(), "linked").otherwise("ranked").alias("chosen"))
    out = whole.join(picked, ["query_id", "kind", "id"], "left").join(scored(whole, questions, objects), ["query_id", "kind", "id"], "left")
    out = out.select("query_id", "kind", "id", "score", F.coalesce("chosen", F.lit("closed")).alias("chosen"))
    ends = whole.filter("kind = 'hypothesis'").select("query_id", "id")
    first = relations.join(ends.select("query_id", F.col("id").alias("source")), "source")
    inside = first.join(ends.select("query_id", F.col("id").alias("target")), ["query_id", "target"], "left_semi")
    return out.unionByName(inside.select("query_id", F.lit("relation").alias("kind"), "id", F.lit(None).cast("long").alias("score"), F.lit("closed").alias("chosen")))
