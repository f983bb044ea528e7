"""Research sessions as state: requests to append events, commands that may be sent again, and what a session holds.

The same fold serves a batch (`answered`) and a stream (`answer_stream`, on transformWithState with typed value, map and
list state, and sessions of an earlier run as its initial state), so a stream that was stopped and started again gives
what a replay of all its requests gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.journal import GENESIS

#: Kinds of events. The first group records texts, the second references, each once.
TEXTS = {"question_asked": "questions", "answer_drafted": "answer_drafts", "gap_recorded": "gaps", "path_rejected": "rejected_paths", "decision_recorded": "decisions"}
REFERENCES = {"evidence_attached": "evidence_refs", "candidate_linked": "candidate_refs"}
CLOSES = "session_closed"
KINDS = [*TEXTS, *REFERENCES, CLOSES]
#: A request that records nothing and is answered with the session's state; and the events that start and complete a command.
ASKS = "state"
STARTS, COMPLETES = "question_asked", "evidence_attached"

ANSWER = "outcome string, sequence long, event_hash string, command_sequence long, state string"


class Held:
    """A session's state in memory, for a batch."""

    def __init__(self) -> None:
        self._head = (0, GENESIS, False)
        self._commands: dict[str, tuple[str, int, int | None]] = {}
        self._refs: dict[tuple[str, str], int] = {}
        self._entries: list[tuple[int, str, str]] = []

    def head(self) -> tuple[int, str, bool]:
        return self._head

    def move(self, sequence: int, digest: str, closed: bool) -> None:
        self._head = (sequence, digest, closed)

    def command(self, name: str) -> tuple[str, int, int | None] | None:
        return self._commands.get(name)

    def note(self, name: str, digest: str, started: int, completed: int | None) -> None:
        self._commands[name] = (digest, started, completed)

    def refer(self, kind: str, ref: str, sequence: int) -> None:
        self._refs.setdefault((kind, ref), sequence)

    def write(self, sequence: int, kind: str, text: str) -> None:
        self._entries.append((sequence, kind, text))

    def refs(self) -> list[tuple[int, str, str]]:
        return [(n, k, r) for (k, r), n in self._refs.items()]

    def entries(self) -> list[tuple[int, str, str]]:
        return self._entries


class Stored:
    """The same state in a stream's state store: only what a request touches is read."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self._head = handle.getValueState("head", "sequence long, hash string, closed boolean")
        self._commands = handle.getMapState("commands", "command string", "hash string, started long, completed long")
        self._refs = handle.getMapState("refs", "kind string, ref string", "sequence long")
        self._entries = handle.getListState("entries", "sequence long, kind string, text string")

    def head(self) -> tuple[int, str, bool]:
        return tuple(self._head.get()) if self._head.exists() else (0, GENESIS, False)

    def move(self, sequence: int, digest: str, closed: bool) -> None:
        self._head.update((sequence, digest, closed))

    def command(self, name: str) -> tuple[str, int, int | None] | None:
        return tuple(self._commands.getValue((name,))) if self._commands.containsKey((name,)) else None

    def note(self, name: str, digest: str, started: int, completed: int | None) -> None:
        self._commands.updateValue((name,), (digest, started, completed))

    def refer(self, kind: str, ref: str, sequence: int) -> None:
        if not self._refs.containsKey((kind, ref)):
            self._refs.updateValue((kind, ref), (sequence,))

    def write(self, sequence: int, kind: str, text: str) -> None:
        self._entries.appendValue((sequence, kind, text))

    def refs(self) -> list[tuple[int, str, str]]:
        return [(v[0], k[0], k[1]) for k, v in self._refs.iterator()]

    def entries(self) -> list[tuple[int, str, str]]:
        return [tuple(e) for e in self._entries.get()]


def state_json(held: Held | Stored) -> str:
    """What a session holds: texts by kind in order, references by kind in order of first mention, count, last hash, status."""
    sequence, digest, closed = held.head()
    out: dict[str, Any] = {"event_count": sequence, "latest_event_hash": digest, "status": "closed" if closed else "open"}
    for kind, name in TEXTS.items():
        out[name] = [t for _, k, t in sorted(held.entries()) if k == kind]
    for kind, name in REFERENCES.items():
        out[name] = [r for _, k, r in sorted(held.refs()) if k == kind]
    return json.dumps(out, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def answer(held: Held | Stored, session: Any, kind: str, text: str | None, refs: list[str] | None, command: str | None, command_hash: str | None) -> tuple[str, int | None, str | None, int | None, str | None]:
    """One request: its outcome, the event's number and hash, the number at which its command stands, and the state asked for."""
    if kind == ASKS:
        return "state", None, None, None, state_json(held)
    if kind not in KINDS:
        return "unknown_kind", None, None, None, None
    known = held.command(command) if command is not None else None
    if command is not None and kind == STARTS and known is not None:
        return ("repeated" if known[0] == command_hash else "conflict"), None, None, known[1], None
    if command is not None and kind == COMPLETES:
        if known is None:
            return "not_started", None, None, None, None
        if known[0] != command_hash:
            return "conflict", None, None, known[1], None
        if known[2] is not None:
            return "repeated", None, None, known[2], None
    sequence, previous, closed = held.head()
    if closed:
        return "closed", None, None, None, None
    sequence += 1
    listed = [r for r in refs or [] if r is not None]
    body = json.dumps([str(session), sequence, kind, text or "", listed, previous], ensure_ascii=False, separators=(",", ":"))
    digest = hashlib.sha256(body.encode()).hexdigest()
    if kind in TEXTS:
        held.write(sequence, kind, text or "")
    elif kind in REFERENCES:
        for r in listed:
            held.refer(kind, r, sequence)
    if command is not None and kind == STARTS:
        held.note(command, command_hash or "", sequence, None)
    if command is not None and kind == COMPLETES:
        held.note(command, command_hash or "", known[1], sequence)
    held.move(sequence, digest, kind == CLOSES)
    return "accepted", sequence, digest, sequence if command is not None else None, None


ANSWERED = ["session_id", "place", "outcome", "sequence", "event_hash", "command_sequence", "state"]
ASKED = ["session_id", "place", "kind", "text", "refs", "command_id", "command_hash"]


def _asked(requests: DataFrame) -> DataFrame:
    return requests.select("session_id", F.col("place").cast("long").alias("place"), F.col("kind"), F.col("text"), F.col("refs").cast("array<string>").alias("refs"), F.col("command_id").cast("string").alias("command_id"), F.coalesce(F.col("command_hash").cast("string"), F.lit("")).alias("command_hash"))


def answered(requests: DataFrame) -> DataFrame:
    """Requests (session_id, place, kind, text, refs, command_id, command_hash) with their answers, in order of place.

    Outcomes: accepted; closed (the session takes no events any more); repeated (a command that was sent before: nothing
    is recorded twice, and command_sequence is where it stands); conflict (a command sent before with another hash);
    not_started (completes a command that the session doesn't know); unknown_kind; state (asked for, records nothing).
    A session streams through one task, which holds its state; a null session is one of its own.
    """
    rows = _asked(requests)
    kind = rows.schema["session_id"].dataType.simpleString()
    dealt = rows.repartition("session_id").sortWithinPartitions("session_id", "place", "kind", "text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        for batch in batches:
            columns = batch.to_pydict()
            out = []
            for k in range(batch.num_rows):
                if held is None or columns["session_id"][k] != now:
                    now, held = columns["session_id"][k], Held()
                out.append(answer(held, now, *(columns[c][k] for c in ASKED[2:])))
            parts = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *parts], names=ANSWERED)

    return dealt.mapInArrow(fold, f"session_id {kind}, place long, {ANSWER}")


class _Sessions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = Stored(handle)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:  # noqa: N802, N803  Spark's names
        self.held.move(initialState["sequence"], initialState["event_hash"], initialState["closed"])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: (r["place"], r["kind"] or "", r["text"] or "")):  # those of one batch
            told = answer(self.held, key[0], *(r[c] for c in ASKED[2:]))
            yield Row(**dict(zip(ANSWERED, (key[0], r["place"], *told), strict=True)))

    def close(self) -> None:
        return None


def answer_stream(requests: DataFrame, opened: DataFrame | None = None) -> DataFrame:
    """`answered` over a stream. `opened` has sessions of before (session_id, sequence, event_hash, closed), taken up on the first run.

    A batch's requests of one session are put in order of place; later batches come after earlier ones. The session
    needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass.
    """
    rows = _asked(requests)
    kind = rows.schema["session_id"].dataType.simpleString()
    first = None if opened is None else opened.select("session_id", F.col("sequence").cast("long").alias("sequence"), "event_hash", "closed").groupBy("session_id")
    return rows.groupBy("session_id").transformWithState(_Sessions(), f"session_id {kind}, place long, {ANSWER}", "Append", "None", first)


#: The provider that `answer_stream` asks for.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def opened(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(session_id, sequence, event_hash, closed) of each session with an accepted event: what a list of sessions shows, and a later stream takes up."""
    took = answers.filter("outcome = 'accepted'").join(requests.select("session_id", F.col("place").cast("long").alias("place"), "kind"), ["session_id", "place"])
    return took.groupBy("session_id").agg(F.max("sequence").alias("sequence"), F.max_by("event_hash", "sequence").alias("event_hash"), F.max_by(F.col("kind") == CLOSES, "sequence").alias("closed"))
