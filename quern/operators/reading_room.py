"""Reading rooms: graphs of processing runs, closed and merged, with the reviews that stand and a bounded view of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.admission import bounded_closed
from quern.operators.chains import chains
from quern.plans.local import kept

#: States in which a review is at rest, and the state of what nobody has reviewed.
TERMINAL = ["accept", "reject", "revise"]
CANDIDATE = "candidate"
#: Nodes, edges and decisions of a room that one task holds; a room of more goes through joins.
ROOM_ROWS = 100_000
COUNTS = ["visible_nodes", "visible_edges", "unresolved", "accepted"]
OMISSIONS = ["closure_omission", "review_omission"]


@dataclass
class Rooms:
    """nodes (room, node_type, node_id, content_hash, collections, created, runs, review_state), edges (room, edge_type, src,
    dst, edge_id) as merged; shown_nodes and shown_edges of the bounded view; queue (room, place, node_type, node_id) of
    what awaits review; summary, a row a room; and views, the same row with the bounded lists: shown_nodes by id, shown_edges
    as taken, queue by place."""

    nodes: DataFrame
    edges: DataFrame
    shown_nodes: DataFrame
    shown_edges: DataFrame
    queue: DataFrame
    summary: DataFrame
    views: DataFrame


def closed_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (room, run, edge_type, src, dst, edge_id) with `closed`: whether both ends are nodes of the run."""
    ends = nodes.select("room", "run", "node_id").distinct()
    out = edges
    for end in ("src", "dst"):
        known = ends.select(F.col("room").alias("_r"), F.col("run").alias("_u"), F.col("node_id").alias("_i"), F.lit(True).alias(f"_{end}"))
        out = out.join(known, (F.col("room") == F.col("_r")) & (F.col("run") == F.col("_u")) & (F.col(end) == F.col("_i")), "left").drop("_r", "_u", "_i")
    return out.withColumn("closed", F.col("_src").isNotNull() & F.col("_dst").isNotNull()).drop("_src", "_dst")


def merged(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all runs of a room, each once; an error where runs disagree on an edge, or on a node's type or hash."""
    both = F.col("node_type").isNotNull() & F.col("content_hash").isNotNull()
    listed = F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set("collections")))))
    differs = lambda c: F.coalesce(F.min(F.when(both, F.col(c))) != F.max(F.when(both, F.col(c))), F.lit(False))
    one = kept(nodes.groupBy("room", "node_id").agg(F.min("node_type").alias("node_type"), F.min("content_hash").alias("content_hash"), F.min("created").alias("created"), F.count_distinct("run").alias("runs"), listed.alias("collections"), (differs("node_type") | differs("content_hash")).alias("_d")))
    links = kept(edges.groupBy("room", "edge_id").agg(F.min(F.struct("edge_type", "src", "dst")).alias("e"), F.count_distinct("edge_type", "src", "dst").alias("_d")).select("room", "e.*", "edge_id", "_d"))
    if not one.filter("_d").isEmpty() or not links.filter("_d > 1").isEmpty():
        raise ValueError("runs disagree on a node or an edge")
    return one.drop("_d"), links.drop("_d")


def valid_decisions(decisions: DataFrame, nodes: DataFrame, reviewable: list[str], permitted: list[str], purpose: str) -> DataFrame:
    """Decisions with `valid`: their target is a reviewable node of the room, of the type and hash stated, and their scope is
    some of the node's and of the permitted collections, for this purpose; a replacement is such a node as well."""
    targets = nodes.filter(F.col("node_type").isin(reviewable)).select(F.col("room").alias("_r"), F.col("node_id").alias("_i"), F.col("node_type").alias("_t"), F.col("content_hash").alias("_h"), F.col("collections").alias("_c"))
    others = targets.select(F.col("_r").alias("_r2"), F.col("_i").alias("_i2"))
    rows = decisions.join(targets, (F.col("room") == F.col("_r")) & (F.col("target") == F.col("_i")), "left")
    rows = rows.join(others, (F.col("room") == F.col("_r2")) & (F.col("replacement") == F.col("_i2")), "left")
    allowed = F.array(*map(F.lit, permitted)) if permitted else F.array().cast("array<string>")
    within = (F.size("scope") > 0) & (F.size(F.array_except("scope", allowed)) == 0) & (F.size(F.array_except("scope", F.col("_c"))) == 0)
    same = (F.col("target_type") == F.col("_t")) & (F.col("target_hash") == F.col("_h")) & (F.col("use") == purpose)
    ok = F.col("_i").isNotNull() & same & within & (F.col("replacement").isNull() | F.col("_i2").isNotNull())
    return rows.withColumn("valid", F.coalesce(ok, F.lit(False))).drop("_r", "_i", "_t", "_h", "_c", "_r2", "_i2")


def _wide(nodes: DataFrame, edges: DataFrame, decisions: DataFrame, reviewable: list[str], permitted: list[str], purpose: str, node_limit: int, edge_limit: int, queue_limit: int) -> Rooms:
    """`reading_rooms` by joins: a room may hold any share of all rows, and a chain may lead through several."""
    inside = kept(closed_edges(nodes, edges))
    whole, links = merged(nodes, inside.filter("closed"))
    judged = kept(valid_decisions(decisions, whole, reviewable, permitted, purpose).select("room", "id", "prior", "target", "action", "at", "valid"))
    seen = chains(judged, "valid").filter("visible").select("id")  # an id that is there again counts if one of it does
    latest = judged.join(seen, "id", "left_semi").groupBy("room", F.col("target").alias("node_id")).agg(F.max_by("action", F.struct("at", "id")).alias("action"))
    can = F.col("node_type").isin(reviewable)
    whole = whole.join(latest, ["room", "node_id"], "left").withColumn("review_state", F.when(can, F.coalesce("action", F.lit(CANDIDATE)))).drop("action")
    whole = kept(whole)
    open_ = F.col("review_state").isNotNull() & ~F.col("review_state").isin(TERMINAL)
    place = F.row_number().over(Window.partitionBy("room").orderBy("created", "node_type", "node_id"))
    queue = whole.filter(open_).withColumn("place", place.cast("long")).filter(F.col("place") <= queue_limit).select("room", "place", "node_type", "node_id")
    shown, taken = bounded_closed(whole.withColumnRenamed("room", "graph"), links.withColumnRenamed("room", "graph"), node_limit, edge_limit)
    per = whole.groupBy("room").agg(F.count(F.lit(1)).alias("visible_nodes"), F.count_if(open_).alias("unresolved"), F.count_if(F.col("review_state") == "accept").alias("accepted"))
    open_ends = inside.groupBy("room").agg(F.bool_or(~F.col("closed")).alias("closure_omission"))
    dropped = open_ends.join(links.groupBy("room").agg(F.count("edge_id").alias("visible_edges")), "room", "left")
    refused = judged.groupBy("room").agg(F.bool_or(~F.col("valid")).alias("review_omission"))
    summary = per.join(dropped, "room", "left").join(refused, "room", "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    summary = summary.select("room", "visible_nodes", F.coalesce("visible_edges", F.lit(0)).alias("visible_edges"), "unresolved", "accepted", no("closure_omission"), no("review_omission"))
    shown, taken = shown.withColumnRenamed("graph", "room"), taken.withColumnRenamed("graph", "room")
    views = summary
    for name, rows, order in (("shown_nodes", shown, ["node_id", "node_type"]), ("shown_edges", taken, ["edge_type", "src", "dst", "edge_id"]), ("queue", queue, ["place", "node_type", "node_id"])):
        views = views.join(rows.groupBy("room").agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name)), "room", "left")
        views = views.withColumn(name, F.coalesce(name, F.array().cast(views.schema[name].dataType)))
    return Rooms(whole, links, shown, taken, queue, summary, views)


def _low(x: object) -> tuple:
    """A key by which nulls come first."""
    return x is not None, x


class _Room:
    """One room, merged and reviewed, of rows as `_together` makes them."""

    def __init__(self, rows: list[tuple], reviewable: list[str]) -> None:
        ends: set[tuple] = set()
        edges, asked = [], []
        self.fault = False
        self.nodes: dict[str | None, list] = {}  # type, hash, created, runs, collections, first type and hash stated together
        for row in rows:
            part, run, kind, i, code, _, _, held, created, _, _, _, _ = row
            if part:
                (edges if part == 1 else asked).append(row)
                continue
            if run is not None and i is not None:
                ends.add((run, i))
            node = self.nodes.get(i)
            if node is None:
                node = self.nodes[i] = [kind, code, created, set(), set(), None]
            else:
                for k, value in ((0, kind), (1, code), (2, created)):
                    if value is not None and (node[k] is None or value < node[k]):
                        node[k] = value
            if run is not None:
                node[3].add(run)
            node[4].update(held)
            if kind is not None and code is not None:
                if node[5] is None:
                    node[5] = (kind, code)
                elif node[5] != (kind, code):
                    self.fault = True
        self.links: dict[str | None, list] = {}  # least type and ends, first of those with a type
        self.open_ends = False
        for _, run, kind, src, dst, i, _, _, _, _, _, _, _ in edges:
            if (run, src) not in ends or (run, dst) not in ends:
                self.open_ends = True
                continue
            key = ((kind is not None, kind), src, dst)
            link = self.links.get(i)
            if link is None:
                self.links[i] = [key, None if kind is None else key]
                continue
            link[0] = min(link[0], key)
            if kind is not None:
                if link[1] is None:
                    link[1] = key
                elif link[1] != key:
                    self.fault = True
        self._review(asked, set(reviewable))

    def _review(self, asked: list[tuple], reviewable: set[str]) -> None:
        can = {i: x for i, x in self.nodes.items() if x[0] in reviewable}
        known = can.keys() - {None}
        ways: dict[object, list] = {}
        self.refused = False
        for _, _, kind, target, code, _, other, scope, _, i, prior, _, ok in asked:
            if ok and target in known and [kind, code] == can[target][:2] and None not in scope and can[target][4].issuperset(scope) and (other is None or other in known):
                ways.setdefault(prior, []).append(i)
            else:
                self.refused = True
        seen, under = set(), list(ways.get(None, ()))  # ids whose chain is valid back to the first
        while under:
            i = under.pop()
            if i is not None and i not in seen:
                seen.add(i)
                under.extend(ways.get(i, ()))
        last: dict[str, tuple] = {}
        for _, _, _, target, _, action, _, _, _, i, _, at, _ in asked:
            if i in seen and target is not None:
                key = (_low(at), _low(i), _low(action))
                if target not in last or key > last[target]:
                    last[target] = key
        action = {i: key[2][1] for i, key in last.items()}
        self.states = {i: CANDIDATE if action.get(i) is None else action[i] for i in can}

    def view(self, node_limit: int, edge_limit: int, queue_limit: int) -> tuple:
        waits = [i for i, s in self.states.items() if s not in TERMINAL]
        queue = sorted((_low(self.nodes[i][2]), _low(self.nodes[i][0]), _low(i)) for i in waits)[:queue_limit]
        chosen: set[str] = set()
        taken = []
        for (kind, src, dst), i in sorted((x[0], _low(i)) for i, x in self.links.items()):
            if len(taken) >= edge_limit:
                break
            if len(chosen | {src, dst}) <= node_limit:
                chosen |= {src, dst}
                taken.append((kind[1], src, dst, i[1]))
        rest = sorted((_low(x[0]), _low(i)) for i, x in self.nodes.items() if i not in chosen)[: node_limit - len(chosen)]
        shown = sorted([_low(i) for i in chosen] + [i for _, i in rest])
        counts = (len(self.nodes), sum(i is not None for i in self.links), len(waits), sum(s == "accept" for s in self.states.values()))
        return (*counts, self.open_ends, self.refused, [(i, self.nodes[i][0]) for _, i in shown], taken, [(k, kind[1], i[1]) for k, (_, kind, i) in enumerate(queue, 1)])


def _together(nodes: DataFrame, edges: DataFrame, decisions: DataFrame, permitted: list[str], purpose: str) -> DataFrame:
    """Nodes (part 0), edges (1) and decisions (2) as rows of one shape, dealt and sorted by room."""
    allowed = F.array(*map(F.lit, permitted)) if permitted else F.array().cast("array<string>")
    ok = F.coalesce((F.size("scope") > 0) & (F.size(F.array_except("scope", allowed)) == 0) & (F.col("use") == purpose), F.lit(False))
    part = lambda k: F.lit(k).cast("byte").alias("part")
    a = nodes.select("room", part(0), "run", F.col("node_type").alias("a"), F.col("node_id").alias("b"), F.col("content_hash").alias("c"), F.col("collections").alias("held"), "created")
    b = edges.select("room", part(1), "run", F.col("edge_type").alias("a"), F.col("src").alias("b"), F.col("dst").alias("c"), F.col("edge_id").alias("d"))
    c = decisions.select("room", part(2), F.col("target_type").alias("a"), F.col("target").alias("b"), F.col("target_hash").alias("c"), F.col("action").alias("d"), F.col("replacement").alias("e"), F.col("scope").alias("held"), "id", F.col("prior").cast(decisions.schema["id"].dataType).alias("prior"), "at", ok.alias("ok"))
    every = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    columns = ["room", "part", "run", "a", "b", "c", "d", "e", "held", "created", "id", "prior", "at", "ok"]
    return every.select(*columns).repartition("room").sortWithinPartitions("room")


def _values(column: pa.Array) -> list:
    """The values of a column of `_together`, lists without nulls of their own; quicker than one scalar at a time."""
    kind, n = column.type, len(column)
    if column.null_count == n:
        return [() if pa.types.is_list(kind) else None] * n
    if pa.types.is_list(kind):
        ends, flat = column.offsets.to_numpy().tolist(), _values(column.values)
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    if pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    values = column.fill_null(0 if pa.types.is_integer(kind) else False).to_numpy(zero_copy_only=False)
    if column.null_count:
        values = values.astype(object)
        values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


def _by_room(rows: DataFrame, schema: str, make: Callable[[list[tuple]], list[tuple]], most: int, marks: bool = False) -> DataFrame:
    """`make` of the rows of each room; a room of over `most` rows, or null, is left out, or has a row of nulls if `marks`."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, over, any_, out = None, [], False, False, []

        def close() -> None:
            if over or (any_ and now is None):
                out.extend([(now,)] if marks else [])
            elif held:
                out.extend((now, *r) for r in make(held))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] if k < len(r) else None for r in out], t) for k, t in enumerate(types)], names=names)

        for b in batches:
            kinds = {f.name: f.type for f in b.schema}
            names, types = _typed(schema, kinds)
            columns = [_values(c.cast(pa.int32()) if f.name == "at" and pa.types.is_date32(f.type) else c) for f, c in zip(b.schema, b.columns, strict=True)]
            for room, row in zip(columns[0], zip(*columns[1:], strict=True), strict=True):
                if room != now or not any_:
                    close()
                    now, held, over, any_ = room, [], False, True
                    if len(out) >= 2_000:
                        yield batch()
                        out.clear()
                if over or room is None:
                    continue
                held.append(row)
                if len(held) > most:
                    held, over = [], True
        close()
        if out:
            yield batch()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(fold, schema.format(**kinds))


#: Types of what leaves a task, by those of the rows.
VIEW = "room {room}, fault boolean, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", " + ", ".join(f"{c} boolean" for c in OMISSIONS) + ", shown_nodes array<struct<node_id:{b},node_type:{a}>>, shown_edges array<struct<edge_type:{a},src:{b},dst:{c},edge_id:{d}>>, queue array<struct<place:bigint,node_type:{a},node_id:{b}>>"
NODE = "room {room}, node_type {a}, node_id {b}, content_hash {c}, collections {held}, created {created}, runs bigint, review_state {d}"
EDGE = "room {room}, edge_type {a}, src {b}, dst {c}, edge_id {d}"


def _typed(schema: str, kinds: dict[str, pa.DataType]) -> tuple[list[str], list[pa.DataType]]:
    """Names and Arrow types of VIEW, NODE or EDGE."""
    of = lambda *named: pa.list_(pa.struct([(n, kinds.get(k, pa.int64())) for n, k in named]))
    lists = {"shown_nodes": of(("node_id", "b"), ("node_type", "a")), "shown_edges": of(("edge_type", "a"), ("src", "b"), ("dst", "c"), ("edge_id", "d")), "queue": of(("place", ""), ("node_type", "a"), ("node_id", "b"))}
    names, types = [], []
    for name, kind in (c.split(" ") for c in schema.split(", ")):
        names.append(name)
        types.append(lists.get(name) or (kinds[kind[1:-1]] if kind.startswith("{") else pa.int64() if kind == "bigint" else pa.bool_()))
    return names, types


def _crossing(decisions: DataFrame) -> bool:
    """Whether decisions of two rooms have one id, or one names the other as its prior."""
    code = lambda c: F.when(c.isNotNull(), F.xxhash64(c))
    prior = F.col("prior").cast(decisions.schema["id"].dataType)
    named = decisions.select(F.xxhash64("room").alias("_r"), F.explode(F.array_compact(F.array(code(F.col("id")), code(prior)))).alias("_k"))
    return not named.groupBy("_k").agg(F.min("_r").alias("_a"), F.max("_r").alias("_z")).filter("_a <> _z").isEmpty()


def reading_rooms(nodes: DataFrame, edges: DataFrame, decisions: DataFrame, reviewable: list[str], permitted: list[str], purpose: str, node_limit: int, edge_limit: int, queue_limit: int) -> Rooms:
    """Rooms of runs' nodes (room, run, node_type, node_id, content_hash, collections, created) and edges (room, run, edge_type,
    src, dst, edge_id), with decisions (room, id, prior, target, target_type, target_hash, action, scope, use, replacement, at).

    An edge whose ends its own run lacks is left out and noted in the summary; runs are merged; of the valid decisions on a
    node, with valid ones before them back to the first, the latest gives its state (ties: the largest id); what is not
    at rest queues in order of (created, node_type, node_id). The view is bounded as in `bounded_graphs`.

    A room is dealt to one task in one shuffle and made whole there. Rooms of over ROOM_ROWS rows go through joins instead, and
    all do where a chain of decisions leads through several rooms.
    """
    limits = (node_limit, edge_limit, queue_limit)
    by_joins = lambda *rows: _wide(*rows, reviewable, permitted, purpose, *limits)
    if _crossing(decisions):
        return by_joins(nodes, edges, decisions)
    rows, most = _together(nodes, edges, decisions, permitted, purpose), ROOM_ROWS

    def view(held: list[tuple]) -> list[tuple]:
        room = _Room(held, reviewable)
        return [(room.fault, *room.view(*limits))] if room.nodes else []

    def whole(held: list[tuple]) -> list[tuple]:
        room = _Room(held, reviewable)
        return [(x[0], i, x[1], sorted(x[4] - {None}), x[2], len(x[3]), room.states.get(i)) for i, x in room.nodes.items()]

    def links(held: list[tuple]) -> list[tuple]:
        return [(kind[1], src, dst, i) for i, ((kind, src, dst), _) in _Room(held, reviewable).links.items()]

    made = kept(_by_room(rows, VIEW, view, most, marks=True))
    if not made.filter("fault").isEmpty():
        raise ValueError("runs disagree on a node or an edge")
    views = made.filter("fault IS NOT NULL").drop("fault")
    of = lambda c: views.select("room", F.explode(c).alias("_x")).select("room", "_x.*")
    rooms = Rooms(
        _by_room(rows, NODE, whole, most), _by_room(rows, EDGE, links, most), of("shown_nodes").select("room", "node_type", "node_id"), of("shown_edges"), of("queue"),
        views.select("room", *COUNTS, *OMISSIONS), views,
    )
    large = made.filter("fault IS NULL").select(F.col("room").alias("_w"))  # few: each has over ROOM_ROWS rows, or is null
    if large.isEmpty():
        return rooms
    more = by_joins(*(x.join(F.broadcast(large), F.col("room").eqNullSafe(F.col("_w")), "left_semi") for x in (nodes, edges, decisions)))
    return Rooms(*(getattr(rooms, f.name).unionByName(getattr(more, f.name)) for f in fields(Rooms)))
