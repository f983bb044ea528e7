"""Admission under budgets, many graphs or routes at once: bounded graphs and budgeted routes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.local import kept


def _first(rows: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each group: Spark drops the rest before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= most)


def bounded_graphs(nodes: DataFrame, edges: DataFrame, node_limit: int, edge_limit: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph, node_type, node_id) and edges (graph, edge_type, src, dst, edge_id) that a bounded view of each graph shows.

    Edges are taken in order of (edge_type, src, dst, edge_id), each if its ends, together with those taken before,
    fit `node_limit`, until there are `edge_limit`; then nodes fill up in order of (node_type, node_id). Both ends of an
    edge have to be nodes of its graph; others are left out. Returns (graph, node_type, node_id) and the edges.

    Taking edges one by one has a closed form. Every node has the first edge that names it. Up to the edge with which
    the nodes named would exceed the limit, every edge is taken; `held` is what they name. If `held` is one short of
    the limit, that edge needed two, and the first later edge that needs one node only brings the last. After that an
    edge is taken if both ends are held. So no loop runs over edges: one aggregate by node, the first `node_limit` + 1
    nodes of each graph, and joins by node; a graph may hold any share of all edges.
    """
    known = nodes.select("graph", "node_type", "node_id").distinct()
    ends = known.select(F.col("graph").alias("_g"), F.col("node_id").alias("_n"))
    own = edges.select("graph", "edge_type", "src", "dst", "edge_id")
    for end in ("src", "dst"):
        own = own.join(ends, (F.col("graph") == F.col("_g")) & (F.col(end) == F.col("_n")), "left_semi")
    return bounded_closed(known, kept(own.distinct()), node_limit, edge_limit)


def bounded_closed(nodes: DataFrame, edges: DataFrame, node_limit: int, edge_limit: int) -> tuple[DataFrame, DataFrame]:
    """`bounded_graphs` of nodes and edges that are there once each, the edges with both ends among the nodes; both are read
    several times."""
    known = nodes.select("graph", "node_type", "node_id")
    own = edges.select("graph", F.struct("edge_type", "src", "dst", "edge_id").alias("_at"), "src", "dst")
    named = own.select("graph", "_at", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node_id"))
    first = named.groupBy("graph", "node_id").agg(F.min("_at").alias("_from"))
    # nodes in order of the edge that names them first; one more than the limit shows where it is passed
    early = _first(first, ["graph"], ["_from", "node_id"], node_limit + 1)
    early = early.withColumn("_named", F.count(F.lit(1)).over(Window.partitionBy("graph").orderBy("_from").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    held = early.filter(F.col("_named") <= node_limit).select("graph", "node_id")
    held = kept(held)
    short = held.groupBy("graph").agg(F.count(F.lit(1)).alias("_n"))
    # graphs in which nothing fits yet (a limit of 1) have no held node and are short as well
    graphs = own.select("graph").distinct().join(short, "graph", "left").filter(F.coalesce("_n", F.lit(0)) == node_limit - 1).select("graph")
    marks = held.select(F.col("graph").alias("_g"), F.col("node_id").alias("_h"), F.lit(True).alias("_in"))
    lone = named.join(graphs, "graph", "left_semi").join(marks, (F.col("graph") == F.col("_g")) & (F.col("node_id") == F.col("_h")), "left")
    needs = lone.groupBy("graph", "_at").agg(F.count_if(F.col("_in").isNull()).alias("_needs"), F.min(F.when(F.col("_in").isNull(), F.col("node_id"))).alias("node_id"))
    last = needs.filter("_needs = 1").groupBy("graph").agg(F.min_by("node_id", "_at").alias("node_id"))
    full = kept(held.unionByName(last))
    marks = full.select(F.col("graph").alias("_g"), F.col("node_id").alias("_h"))
    taken = own
    for end in ("src", "dst"):
        taken = taken.join(marks, (F.col("graph") == F.col("_g")) & (F.col(end) == F.col("_h")), "left_semi")
    taken = kept(_first(taken, ["graph"], ["_at"], edge_limit).select("graph", "_at.*"))
    shown = taken.select("graph", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    many = shown.groupBy("graph").agg(F.count(F.lit(1)).alias("_n"))
    rest = known.join(shown, ["graph", "node_id"], "left_anti")
    rest = _first(rest, ["graph"], ["node_type", "node_id"], node_limit).join(many, "graph", "left").filter(F.col("_place") <= node_limit - F.coalesce("_n", F.lit(0)))
    return known.join(shown, ["graph", "node_id"], "left_semi").select("graph", "node_type", "node_id").unionByName(rest.select("graph", "node_type", "node_id")), taken


#: Kinds of a route's objects in the order in which they are admitted, and the reason that a full budget gives.
KINDS = ["question", "hypothesis", "timeline", "gap", "relation"]
REASONS = {"question": "question_budget", "hypothesis": "hypothesis_budget", "relation": "relation_budget", "timeline": "timeline_budget", "gap": "gap_budget", "evidence": "evidence_budget", "source": "source_budget"}

#: Columns of a candidate: its place in the route, what makes it linked, and what it brings with it.
CANDIDATE = ["stage", "place", "kind", "id", "asks", "rests", "questions", "hypotheses", "evidence", "sources"]
ROUTED = "step long, outcome string, parent_kind string, parent_id string, reason string"


class Route:
    """What one route has admitted so far; its sets are bounded by the budget."""

    def __init__(self, budget: dict[str, int]) -> None:
        self.budget = budget
        self.held: dict[str, dict[str, None]] = {k: {} for k in REASONS}
        self.seeds: dict[str, None] = {}
        self.linked: set[str] | None = None
        self.omitted: dict[tuple[str, str], str] = {}
        self.trace: list[tuple[str, str, str, str | None, str | None]] = []

    def _reason(self, more: dict[str, list[str]]) -> str | None:
        for kind, reason in REASONS.items():
            held = self.held[kind]
            if len(held) + len({x for x in more.get(kind, ()) if x not in held}) > self.budget[kind]:
                return reason
        return None

    def _put(self, kind: str, ids: list[str], outcome: str, parent: tuple[str | None, str | None]) -> None:
        for i in ids:
            if i not in self.held[kind]:
                self.held[kind][i] = None
                self.omitted.pop((kind, i), None)
                self.trace.append((kind, i, outcome, *parent))

    def _parent(self, asks: list[str], rests: list[str], linked: set[str] | dict) -> tuple[str, str] | None:
        for q in self.seeds:
            if q in asks:
                return "question", q
        for h in self.held["hypothesis"]:
            if h in rests and h in linked:
                return "hypothesis", h
        return None

    def see(self, stage: str, kind: str, i: str, asks: list[str], rests: list[str], brings: Callable[[], tuple[list[str], ...]]) -> None:
        """Admit a candidate, omit it with a reason, or pass it by if nothing admitted leads to it; only what may be
        admitted is asked for the questions, hypotheses, evidence and sources that it brings."""
        if kind == "question":
            _, _, evidence, sources = brings()
            if (reason := self._reason({"question": [i], "evidence": evidence, "source": sources})) is None:
                self._put("question", [i], "seed", (stage, None))
                self.seeds[i] = None
                self._bring(evidence, sources)
            else:
                self.omitted.setdefault((kind, i), reason)
            return
        if not self.seeds:
            return
        if kind == "relation":
            ends = [h in self.held["hypothesis"] for h in rests]
            if not any(ends):
                return
            if not all(ends):
                self.omitted.setdefault((kind, i), "reference_budget")
                return
            parent: tuple[str, str] | None = ("hypothesis", rests[0])
        elif kind == "hypothesis":
            parent = self._parent(asks, [], ())
            if parent is None or i in self.held["hypothesis"]:
                return
        else:
            if self.linked is None:  # hypotheses that seeds lead to; what later objects bring links nothing
                self.linked = set(self.held["hypothesis"])
            parent = self._parent(asks, rests, self.linked)
            if parent is None:
                return
        questions, hypotheses, evidence, sources = brings()
        more = {"question": questions, "hypothesis": hypotheses, "evidence": evidence, "source": sources}
        more[kind] = [*more.get(kind, []), i]
        if (reason := self._reason(more)) is not None:
            self.omitted.setdefault((kind, i), reason)
            return
        self._put("question", questions, "expansion", parent)
        self._put("hypothesis", [h for h in hypotheses if h != i or kind != "hypothesis"], "expansion", parent)
        self._put(kind, [i], "expansion", parent)
        self._bring(evidence, sources)

    def _bring(self, evidence: list[str], sources: list[str]) -> None:
        self.held["evidence"].update(dict.fromkeys(evidence))
        self.held["source"].update(dict.fromkeys(sources))

    def rows(self) -> Iterator[tuple]:
        for step, (kind, i, outcome, a, b) in enumerate(self.trace, 1):
            yield kind, i, step, outcome, a, b, None
        for (kind, i), reason in self.omitted.items():
            yield kind, i, None, "omitted", None, None, reason


def routes(candidates: DataFrame, budget: dict[str, int], by: str = "route_id") -> DataFrame:
    """Budgeted routes: (`by`, kind, id, step, outcome, parent_kind, parent_id, reason) of candidates, many routes at once.

    A candidate (`by`, stage, place, kind, id, asks, rests, questions, hypotheses, evidence, sources) is seen in order of
    kind (questions, hypotheses, timeline, gaps, relations), then `place`, id, and what it holds. Questions are seeds, semantic ones placed
    before lexical ones. Another object is looked at if a seed that was admitted is among `asks`, or a hypothesis that
    seeds led to among `rests` (of a relation: its two ends); it is admitted with all it brings, if every budget
    holds that, and else omitted with the first budget that doesn't. What an earlier object brought clears its omission.
    `step` numbers what was admitted; for a seed parent_kind is its stage. Budgets name every key of REASONS.

    What is admitted depends on what was, so each route is folded in order: rows are dealt by route and sorted within
    tasks, and stream through with one route's sets held at a time, which the budgets bound. Nulls in lists are left out.
    """
    if missing := set(REASONS) - set(budget):
        raise ValueError(f"no budget for {sorted(missing)}")
    key = candidates.schema[by].dataType.simpleString()
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    lists = [F.transform(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))), lambda x: x.cast("string")).alias(c) for c in CANDIDATE[4:]]
    rows = candidates.select(F.col(by), F.col("stage").cast("string").alias("stage"), F.col("place").cast("long").alias("place"), F.col("kind"), F.col("id").cast("string").alias("id"), *lists, order.alias("_order"))
    dealt = rows.repartition(by).sortWithinPartitions(by, "_order", "place", "id", "stage", *CANDIDATE[4:])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, route, out = None, None, []

        def close() -> None:
            if route is not None:
                out.extend((now, *r) for r in route.rows())

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[by, "kind", "id", "step", "outcome", "parent_kind", "parent_id", "reason"])

        types = []
        for b in batches:
            types = [b.schema.field(by).type, pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            ids = b.column(0).to_pylist()
            stage, kind, own = (b.column(c).to_pylist() for c in ("stage", "kind", "id"))
            (asks, asked), (rests, rested) = ((b.column(c).values.to_pylist(), b.column(c).offsets.to_pylist()) for c in ("asks", "rests"))
            lists = [b.column(c) for c in CANDIDATE[6:]]
            for k, i in enumerate(ids):
                if route is None or i != now:
                    close()
                    now, route = i, Route(budget)
                    if len(out) >= 5000:
                        yield batch()
                        out.clear()
                route.see(stage[k], kind[k], own[k], asks[asked[k] : asked[k + 1]], rests[rested[k] : rested[k + 1]], lambda k=k, lists=lists: tuple(c[k].as_py() for c in lists))
        close()
        if out:
            yield batch()

    return dealt.mapInArrow(fold, f"`{by}` {key}, kind string, id string, {ROUTED}")
