"""Append-only journals: batch replay and checks, and the streaming forms of the same folds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

GENESIS = "0" * 64
#: Fixed value: the kind of event that closes a session.
CLOSES = "closed"


def event_hash(session: Column, sequence: Column, payload: Column, previous: Column) -> Column:
    """Hash of an event over its place, its payload and the hash before it."""
    return F.sha2(F.concat_ws("|", session.cast("string"), sequence.cast("string"), F.coalesce(payload, F.lit("")), previous), 256)


def _folded(rows: pd.DataFrame, session: str, sequence: str, payload: str, kind: str | None, state: tuple[int, str, bool]) -> tuple[pd.DataFrame, tuple[int, str, bool]]:
    """Events of one session in order, each hashed onto the chain; what comes after a closing event is rejected."""
    last, previous, closed = state
    out: list[tuple] = []
    for r in rows.sort_values(sequence, kind="stable").to_dict("records"):
        if closed:
            out.append((None, None, None, "closed"))
            continue
        last += 1
        text = r[payload] if isinstance(r[payload], str) else ""
        digest = hashlib.sha256(f"{r[session]}|{last}|{text}|{previous}".encode()).hexdigest()
        out.append((last, digest, previous, "accepted"))
        previous, closed = digest, kind is not None and r[kind] == CLOSES
    rows = rows.sort_values(sequence, kind="stable").reset_index(drop=True)
    rows[["chain_sequence", "event_hash", "previous_hash", "status"]] = pd.DataFrame(out, columns=["a", "b", "c", "d"], dtype=object)
    return rows, (last, previous, closed)


ADDED = "chain_sequence long, event_hash string, previous_hash string, status string"


def _schema(events: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", " + ADDED


def chained(events: DataFrame, session: str, sequence: str, payload: str, kind: str | None = None) -> DataFrame:
    """Each event with its number, its hash over the hash before it, and its status.

    A hash needs the one before it, so a session is one fold, in order; its rows stream through a task, which holds
    one session's last hash and a batch, whatever the session's length. Ties of `sequence` are in order of payload.
    """
    dealt = events.repartition(session).sortWithinPartitions(session, sequence, payload)
    names = events.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, last, previous, closed = None, False, -1, GENESIS, False
        sha = hashlib.sha256
        for batch in batches:
            ids, texts = (batch.column(names.index(c)).to_pylist() for c in (session, payload))
            kinds = batch.column(names.index(kind)).to_pylist() if kind is not None else None
            numbers, hashes, befores, states = [], [], [], []
            for k, (own, text) in enumerate(zip(ids, texts, strict=True)):
                if not begun or own != now:
                    now, begun, last, previous, closed = own, True, -1, GENESIS, False
                if closed:
                    numbers.append(None), hashes.append(None), befores.append(None), states.append("closed")
                    continue
                last += 1
                digest = sha(f"{own}|{last}|{text or ''}|{previous}".encode()).hexdigest()
                numbers.append(last), hashes.append(digest), befores.append(previous), states.append("accepted")
                previous, closed = digest, kinds is not None and kinds[k] == CLOSES
            added = [pa.array(numbers, pa.int64()), *(pa.array(x, pa.string()) for x in (hashes, befores, states))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, "chain_sequence", "event_hash", "previous_hash", "status"])

    return dealt.mapInArrow(run, _schema(events))


def append_stream(events: DataFrame, session: str, sequence: str, payload: str, kind: str) -> DataFrame:
    """`chained` over a stream: a session's state is its last number, last hash and whether it is closed."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (-1, GENESIS, False)
        rows = pd.concat(list(batches))
        rows, held = _folded(rows, session, sequence, payload, kind, held)
        state.update(held)
        yield rows

    return events.groupBy(session).applyInPandasWithState(run, _schema(events), "last long, previous string, closed boolean", "append", "NoTimeout")


def violations(events: DataFrame, session: str, sequence: str, payload: str, first: int = 0) -> DataFrame:
    """(session, sequence, fault): events out of sequence, off the chain, or whose hash isn't that of what they hold."""
    by = Window.partitionBy(session).orderBy(sequence)
    place = F.row_number().over(by) - 1 + first
    before = F.coalesce(F.lag("event_hash").over(by), F.lit(GENESIS))
    own = event_hash(F.col(session), F.col(sequence), F.col(payload), F.col("previous_hash"))
    faults = F.array_compact(F.array(F.when(F.col(sequence) != place, "sequence"), F.when(F.col("previous_hash") != before, "chain"), F.when(F.col("event_hash") != own, "hash")))
    return events.withColumn("_f", faults).select(session, sequence, F.explode("_f").alias("fault"))


def replayed(events: DataFrame, session: str, sequence: str, kind: str) -> DataFrame:
    """State of each session: events, events by kind, last number and kind, and whether it is closed."""
    per = events.groupBy(session, kind).agg(F.count(F.lit(1)).alias("n"), F.max(sequence).alias("last"))
    state = per.groupBy(session).agg(F.sum("n").alias("events"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"), F.max("last").alias("last_sequence"), F.max(F.struct("last", kind))[kind].alias("last_kind"))
    return state.withColumn("closed", F.map_contains_key("kinds", F.lit(CLOSES)))


def commands(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """Each command (by its key) once, with the event that started it, the one that completed it, and how often it was sent again."""
    return events.groupBy(*key).agg(F.min(order).alias("started"), F.when(F.count(F.lit(1)) > 1, F.max(order)).alias("completed"), (F.count(F.lit(1)) - 1).alias("repeats"))


def dedup_stream(events: DataFrame, key: str, time: str, lateness: str = "1 hour") -> DataFrame:
    """Each key once, on a stream or a batch; on a stream, state is kept for the watermark only."""
    if events.isStreaming:
        return events.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def windowed_counts(events: DataFrame, time: str, width: str, by: str, lateness: str = "1 hour") -> DataFrame:
    """Events per window and kind; a stream emits a window when the watermark has passed it."""
    rows = events.withWatermark(time, lateness) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def recent(events: DataFrame, session: str, kind: str, sequence: str, most: int) -> DataFrame:
    """The last `most` events of each kind in a session, and how many were left out."""
    by = Window.partitionBy(session, kind)
    place = F.row_number().over(by.orderBy(F.desc(sequence)))
    return events.withColumn("_p", place).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(by) - most, F.lit(0))).filter(F.col("_p") <= most).drop("_p")
