"""Chains of records that supersede one another: heads, depths and visibility by contraction and pointer jumping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.local import kept

#: Records that a task holds at a time.
BLOCK = 1 << 19


def _contracted(rows: pa.Table) -> pa.RecordBatch:
    """Each record's way within the rows, sorted by id: `last` record of it, `links` to that, and `to`, the prior of that.

    A way goes through ids that are here once, and neither first nor last, as another block may have those as well.
    """
    ids, prior = rows.column("id").combine_chunks(), rows.column("prior").combine_chunks()
    counts = ids.value_counts()
    sure = pc.and_(pc.equal(counts.field("counts"), 1), pc.invert(pc.is_in(counts.field("values"), value_set=pa.concat_arrays([ids[:1], ids[-1:]]))))
    once = counts.field("values").filter(sure)
    place = pc.index_in(once, value_set=ids)
    at = pc.fill_null(place.take(pc.index_in(prior, value_set=once, skip_nulls=True)), -1).to_numpy(zero_copy_only=False)
    visible = rows.column("visible").to_numpy()
    end = at < 0
    now, links, seen = np.where(end, np.arange(len(at)), at), (~end).astype(np.int64), visible | end
    ended = -1
    while ended < (ended := int(end[now].sum())) < len(at):  # what is left when a round ends no way goes round
        links, seen, now = links + links[now], seen & seen[now], now[now]
    loop = ~end[now]
    last = ids.take(pa.array(now, mask=loop))
    to = prior.take(pa.array(now, mask=loop))
    return rows.drop_columns(["prior", "visible"]).append_column("to", to).append_column("last", last).append_column("links", pa.array(links)).append_column("visible", pa.array(seen & visible[now])).append_column("loop", pa.array(loop)).combine_chunks()


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= size:
                yield from _contracted(pa.Table.from_batches(held)).to_batches(10_000)
                held = []
        if held:
            yield from _contracted(pa.Table.from_batches(held)).to_batches(10_000)

    return run


def _resolved(gates: DataFrame) -> DataFrame:
    """(id, to, last, links, visible, loop) whose `to` are among them or missing, to (id, root, depth, visible, lost, loop).

    Each round a record jumps to where the record it points to points; only those still under way are written again.
    A chain that ends has records at every depth, so each round ends some: when none ends, the rest go round.
    """
    known = gates.select(F.col("id").alias("_k")).distinct()
    heads = gates.join(known, F.col("to") == F.col("_k"), "left").withColumn("lost", F.col("to").isNotNull() & F.col("_k").isNull())
    on = F.col("to").isNotNull() & ~F.col("lost")
    columns = ["id", "root", "depth", "visible", "lost", "loop"]
    now = kept(heads.select("id", F.when(on, F.col("to")).alias("to"), F.when(~on, F.col("last")).alias("root"), (F.col("links") + F.when(on, 1).otherwise(0)).alias("depth"), "visible", "lost", "loop"))
    done, under = now.filter("to IS NULL").select(*columns), now.filter("to IS NOT NULL")
    ended, left = True, not under.isEmpty()
    while ended and left:
        there = under.unionByName(done, allowMissingColumns=True).select(F.col("id").alias("_i"), F.col("to").alias("_to"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("visible").alias("_v"), F.col("lost").alias("_l"), F.col("loop").alias("_o"))
        met = under.join(there, F.col("to") == F.col("_i")).select("id", F.col("_to").alias("to"), F.col("_r").alias("root"), (F.col("depth") + F.col("_d")).alias("depth"), (F.col("visible") & F.col("_v")).alias("visible"), (F.col("lost") | F.col("_l")).alias("lost"), (F.col("loop") | F.col("_o")).alias("loop"))
        now = kept(met)
        done, under = done.unionByName(now.filter("to IS NULL").select(*columns)), now.filter("to IS NOT NULL")
        ended, left = not now.filter("to IS NULL").isEmpty(), not under.isEmpty()
    return done.unionByName(under.withColumn("loop", F.lit(True)).select(*columns)) if left else done


def chains(records: DataFrame, visible: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(id, prior) records to (id, root, depth, visible, fault): `root` is the first of its chain, `depth` the links to it.

    A record is visible if it is and all that it supersedes, back to the root, are (`visible` names a boolean column;
    null counts as false; without it all are). Faults: `missing` (the chain leads to a prior that isn't there) and `cycle`
    (it never ends); such records are invisible, and root and depth are null in a cycle. Ids are expected once each
    (an id that is there again has a row for each way that leads on); several records may name one prior (`forks` lists them).
    `also` names columns to keep.

    Records are dealt by ranges of ids, and ways are followed within blocks of them first; only records that another
    block points to meet in pointer jumping, so a chain over n of those takes log2(n) + 1 rounds of them.
    """
    shown = F.coalesce(F.col(visible), F.lit(False)) if visible else F.lit(True)
    rows = records.select("id", F.col("prior").cast(records.schema["id"].dataType).alias("prior"), shown.alias("visible"), *also)
    kind = records.schema["id"].dataType.simpleString()
    more = "".join(f", `{c}` {records.schema[c].dataType.simpleString()}" for c in also)
    near = kept(rows.repartitionByRange("id").sortWithinPartitions("id").mapInArrow(_blocks(BLOCK), f"id {kind}{more}, to {kind}, last {kind}, links long, visible boolean, loop boolean"))
    wanted = near.filter("to IS NOT NULL").select(F.col("to").alias("_w")).distinct()
    gates = near.join(wanted, F.col("id") == F.col("_w"), "left_semi").select("id", "to", "last", "links", "visible", "loop")
    there = _resolved(kept(gates)).select(F.col("id").alias("_i"), F.col("root").alias("_r"), F.col("depth").alias("_d"), F.col("visible").alias("_v"), F.col("lost").alias("_l"), F.col("loop").alias("_o"))
    found = near.join(there, F.col("to") == F.col("_i"), "left")
    met = F.col("_i").isNotNull()
    cycle = F.col("loop") | F.coalesce("_o", F.lit(False))
    lost = F.col("to").isNotNull() & (~met | F.coalesce("_l", F.lit(False)))
    fault = F.when(cycle, "cycle").when(lost, "missing")
    root, depth = F.when(met, F.col("_r")).otherwise(F.col("last")), F.col("links") + F.when(met, F.col("_d") + 1).otherwise(0)
    return found.select("id", F.when(~cycle, root).alias("root"), F.when(~cycle, depth).alias("depth"), (F.col("visible") & fault.isNull() & F.coalesce("_v", F.lit(True))).alias("visible"), fault.alias("fault"), *also)


def forks(records: DataFrame) -> DataFrame:
    """(prior, successors) of priors that more than one record supersedes."""
    return records.filter("prior IS NOT NULL").groupBy("prior").agg(F.count(F.lit(1)).alias("successors")).filter("successors > 1")


def standing(decisions: DataFrame, visible: str) -> DataFrame:
    """(id, prior, target, at) decisions to the one that stands for each target: the latest visible, ties by the largest id.

    A decision that supersedes another counts only if that one, and all before it, are visible as well.
    """
    seen = chains(decisions, visible).filter("visible").select("id")
    return decisions.join(seen, "id", "left_semi").groupBy("target").agg(F.max(F.struct("at", "id")).alias("_d")).select("target", F.col("_d.id").alias("id"), F.col("_d.at").alias("at"))
