"""Imports of objects that name one another by local keys: content ids made level by level, and what can't be resolved."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.local import kept

#: Tables of resolved objects that are kept apart before they are put together.
MOST_PARTS = 16
#: New ids of a round that may be broadcast.
BROADCAST_ROWS = 100_000


def object_id(kind: Column, payload: Column, refs: Column) -> Column:
    """Id of an object: its kind, and a hash of its payload and of the ids that it names, in order."""
    body = F.concat_ws("\x1f", kind, F.coalesce(payload, F.lit("")), F.array_join(refs, "\x1e"))
    return F.concat(kind, F.lit("_"), F.substring(F.sha2(body, 256), 1, 32))


def resolved(objects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(`by`..., kind, key, payload, refs) objects, with refs the keys of others of the same import, to id, level and fault.

    An id covers the ids of what an object names, so it is made from the bottom up: objects without references first
    (level 0), then those all of whose references have ids. Only what a round resolved is joined with what still
    waits. What has no id in the end is a fault, and never a null reference: `unresolved` (names a key
    that isn't there), `cycle` (leads back to itself, or lies between two cycles) or `blocked` (leads to one of
    those). A key used twice in an import is `repeated` and takes no part. Rounds are as many as the longest chain.
    Null keys name nothing and are `unresolved` where they are named; an object with a null key is `repeated`.
    """
    by = by or []
    none = F.array().cast("array<string>")
    every = objects.select(*by, "kind", "key", "payload", F.coalesce("refs", none).alias("refs"))
    # each key and each name once, with the objects that have it: one shuffle tells what is repeated and what is missing
    names = every.select(*by, F.col("key").alias("name"), F.lit(1).alias("_n")).unionByName(every.select(*by, F.explode("refs").alias("name"), F.lit(0).alias("_n")))
    odd = kept(names.groupBy(*by, "name").agg(F.sum("_n").alias("_n")).filter("_n <> 1 OR name IS NULL"))
    held = lambda c: [F.col(f"x.{x}").eqNullSafe(F.col(f"o.{y}")) for x, y in [*[(z, z) for z in by], (c, "name")]]
    bad = odd.filter("_n > 0").alias("o")
    repeated = every.alias("x").join(bad, held("key"), "left_semi").withColumn("fault", F.lit("repeated"))
    rows = kept(every.alias("x").join(bad, held("key"), "left_anti"))
    heads = rows.filter(F.size("refs") > 1)
    # an object that names one other is made from that one's id alone; only others gather what came for them
    single = rows.filter(F.size("refs") == 1).withColumn("ref", F.get("refs", F.lit(0))).drop("refs")
    lost = odd.alias("o")
    nowhere = reduce(or_, [F.col(c).isNull() for c in by], F.lit(False))
    missing = single.alias("x").join(lost, held("ref"), "left_semi").unionByName(single.filter(nowhere).alias("x").join(lost, held("ref"), "left_anti")).select(*by, "kind", "key")
    waits = single.filter(~nowhere).alias("x").join(lost, held("ref"), "left_anti")
    many = _Many(heads, lost, by) if not heads.isEmpty() else None
    fresh = kept(rows.filter(F.size("refs") == 0).select(*by, "kind", "key", object_id(F.col("kind"), F.col("payload"), none).alias("id"), F.lit(0).cast("long").alias("level")))
    done, level, stacked = [fresh], 0, 0
    while not fresh.isEmpty():
        level += 1
        named = fresh.select(*by, F.col("key").alias("ref"), F.col("id").alias("ref_id"))
        if fresh.count() <= BROADCAST_ROWS:
            met = waits.join(F.broadcast(named), [*by, "ref"])
            waits, stacked = waits.join(F.broadcast(named), [*by, "ref"], "left_anti"), stacked + 1
        else:  # one shuffle tells those that are met from those that go on waiting
            both = kept(waits.join(named, [*by, "ref"], "left"))
            met, waits, stacked = both.filter("ref_id IS NOT NULL"), both.filter("ref_id IS NULL").drop("ref_id"), 0
        met = met.select(*by, "kind", "key", object_id(F.col("kind"), F.col("payload"), F.array("ref_id")).alias("id"), F.lit(level).cast("long").alias("level"))
        fresh = kept(met if many is None else met.unionByName(many.ready(named, level)))
        done.append(fresh)
        if len(done) > MOST_PARTS:
            done = [kept(_together(done))]
        if stacked > MOST_PARTS:
            waits, stacked = kept(waits), 0
    left, edges = waits.select(*by, "kind", "key"), waits.select(*by, "key", "ref")
    if many is not None:
        missing = missing.unionByName(many.missing)
        rest = kept(many.heads.join(_together(done).select(*by, "key"), [*by, "key"], "left_anti"))
        left, edges = left.unionByName(rest.select(*by, "kind", "key")), edges.unionByName(rest.select(*by, "key", F.explode("refs").alias("ref")))
    loops = _looped(edges, by).withColumn("_l", F.lit("cycle"))
    blocked = left.join(loops, [*by, "key"], "left").withColumn("fault", F.coalesce("_l", F.lit("blocked")))
    faults = blocked.select(*by, "kind", "key", "fault").unionByName(missing.withColumn("fault", F.lit("unresolved"))).unionByName(repeated.select(*by, "kind", "key", "fault"))
    found = _together(done).withColumn("fault", F.lit(None).cast("string"))
    return found.unionByName(faults.select(*by, "kind", "key", F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("level"), "fault"))


class _Many:
    """Objects that name several others: what has come for each, until it is whole."""

    def __init__(self, heads: DataFrame, lost: DataFrame, by: list[str]) -> None:
        self.by, key = by, [*by, "key"]
        edges = heads.select(*key, F.posexplode("refs").alias("at", "ref"))
        gone = [*[F.col(f"x.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by], F.col("x.ref").eqNullSafe(F.col("o.name"))]
        nowhere = reduce(or_, [F.col(c).isNull() for c in by], F.lit(False))
        without = kept(edges.alias("x").join(lost, gone, "left_semi").select(*key).distinct())
        same = [F.col(f"h.{c}").eqNullSafe(F.col(f"m.{c}")) for c in key]
        whole = heads.filter(~nowhere).alias("h").join(without.alias("m"), same, "left_anti")
        self.missing = heads.alias("h").join(without.alias("m"), same, "left_semi").unionByName(heads.filter(nowhere).alias("h").join(without.alias("m"), same, "left_anti")).select(*by, "kind", "key")
        self.heads = kept(whole)
        self.waits = self.heads.select(*key, F.posexplode("refs").alias("at", "ref"))
        self.got: list[DataFrame] = []

    def ready(self, named: DataFrame, level: int) -> DataFrame:
        """Objects that what came now makes whole."""
        key = [*self.by, "key"]
        came = kept(self.waits.join(named, [*self.by, "ref"]).select(*key, "at", "ref_id"))
        self.got.append(came)
        touched = came.select(*key).distinct()
        have = _together(self.got).join(touched, key, "left_semi").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "ref_id"))).alias("got"))
        if len(self.got) > MOST_PARTS:
            self.got = [kept(_together(self.got))]
        ready = have.join(self.heads, key).filter(F.size("got") == F.size("refs"))
        return ready.select(*self.by, "kind", "key", object_id(F.col("kind"), F.col("payload"), F.col("got.ref_id")).alias("id"), F.lit(level).cast("long").alias("level"))


def _looped(edges: DataFrame, by: list[str]) -> DataFrame:
    """Keys on a cycle or between two: those of the (`by`..., key, ref) edges that stay when edges to what names none of the
    rest, or from what none of the rest names, go. Each round reads the edges that are left."""
    now = kept(edges.distinct())
    n, was = now.count(), -1
    while n != was and n:
        names = now.select(*by, F.col("key").alias("ref")).distinct()
        inner = now.join(names, [*by, "ref"], "left_semi")
        now = kept(inner.join(inner.select(*by, F.col("ref").alias("key")).distinct(), [*by, "key"], "left_semi"))
        was, n = n, now.count()
    return now.select(*by, "key").distinct()


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def migrated(rows: DataFrame, mapping: DataFrame, key: str, refs: list[str], states: dict[str, str], state: str = "state") -> tuple[DataFrame, DataFrame]:
    """Rows of an older form under new ids: `key` and the ids in the array columns `refs` mapped by (old_id, new_id), states by name.

    Returns the rows that map whole, and faults (id, field, value) of the others: an id or a state without a counterpart
    is a fault, never a null. An old id with two new ones is a fault of each row that has it. The mapping joins by id.
    """
    one = mapping.groupBy("old_id").agg(F.count_distinct("new_id").alias("_n"), F.min("new_id").alias("_new"))
    to = one.select(F.col("old_id").alias("_old"), F.when(F.col("_n") == 1, F.col("_new")).alias("_to"))
    fields = [key, *refs]

    def named(c: str) -> Column:
        values = F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")) if c in refs else F.array(F.col(c).cast("string"))
        return F.transform(values, lambda x, at: F.struct(F.lit(c).alias("field"), at.alias("at"), x.alias("value")))

    each = F.explode(F.concat(*map(named, fields)))
    asked = rows.select(F.col(key).cast("string").alias("_id"), each.alias("x")).select("_id", "x.*").join(to, F.col("value") == F.col("_old"), "left")
    new_state = F.create_map(*[F.lit(x) for pair in states.items() for x in pair])[F.col(state)]
    lost = asked.filter("_to IS NULL").select(F.col("_id").alias("id"), "field", "value").distinct()
    lost = lost.unionByName(rows.filter(new_state.isNull()).select(F.col(key).cast("string").alias("id"), F.lit(state).alias("field"), F.col(state).cast("string").alias("value"))).checkpoint()
    good = rows.join(lost.select(F.col("id").alias("_lost")).distinct(), F.col(key).cast("string") == F.col("_lost"), "left_anti")
    per = asked.groupBy("_id").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("at", "_to")))), lambda x: x["_to"]).alias(f"_f{k}") for k, c in enumerate(fields)])
    joined = good.join(per, F.col(key).cast("string") == F.col("_id"))
    new = [F.element_at("_f0", 1).alias(key), *[F.col(f"_f{k}").alias(c) for k, c in enumerate(fields) if k], new_state.alias(state)]
    return joined.select(*new, *[c for c in rows.columns if c not in {*fields, state}]), lost
