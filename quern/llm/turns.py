"""Repair of conversation structure: cost layers of grammar states as bitsets, and the least audit by a bit-trace.

A repaired conversation has role initials of the grammar (s?(ua)+)?. Its automaton has four states: 0 begun,
1 after s, 2 after u, 3 after a; 0 and 3 accept. Going from the last row to the first, a word of 64 bits holds
for the place before each row the states from which the end is reached at each cost: four bits a layer, one
layer a unit of cost, sixteen layers above a base. An edit is a shift: of states within layers by the letter
that is written, of layers by what it costs. From any state the end costs at most 12 more than from the best
one (two insertions, or a deletion and two), and a row moves the base by at most 2, so what falls off the top
layer is never the best of its state. The lowest layer with state 0 before the first row is the cost. The audit
is read forwards: at each place the first letter in ASCII order whose layer has the bit.

Rows are range-partitioned by conversation and turn, so a conversation of any length is spread over tasks. A
stretch of a conversation in one task is a 4 x 4 table of costs (its layers from each state that may follow);
only the first and the last conversation of a task can go on in another one, so at most two tables a task meet
on the driver, which gives every stretch the layers that follow it and the state that it begins in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import NO_WORD, cut, with_group_min

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NONE = 1 << 40
_ALL = (1 << 64) - 1
_LOW = int("1" * 16, 16)  # state 0 of every layer
#: Bytes of repaired text in a row that goes from one task to the next.
PIECE = 16 << 10

# kinds of rows: initial (0 other, 1 s, 2 u, 3 a) + 4 * fault (0 none, 1 blank, 2 duplicate, 3 truncated)
_NEXT = {1: {0: 1}, 2: {0: 2, 1: 2, 3: 2}, 3: {2: 3}}


def _before(letter: int, layers: int) -> int:
    """States from which the letter leads into the states of each layer."""
    if letter == 1:
        return (layers >> 1) & _LOW
    if letter == 2:
        at = (layers >> 2) & _LOW
        return at | at << 1 | at << 3
    return ((layers >> 3) & _LOW) << 2


def _inserted(layers: int) -> int:
    for _ in range(2):
        layers |= (_before(2, layers) | _before(3, layers)) << 4 * INSERT
        layers &= _ALL
    return layers


def _based(layers: int) -> tuple[int, int]:
    """Layers moved down to the lowest that has a state, and by how many."""
    by = ((layers & -layers).bit_length() - 1) // 4
    return layers >> 4 * by, by


def _row(kind: int, layers: int) -> tuple[int, int]:
    """Layers before a row of this kind, given those behind it."""
    initial, fault = kind & 3, kind >> 2
    out = layers << 4 * DELETE
    if fault not in (1, 2):
        more = TRUNCATED if fault == 3 else 0
        if initial:
            out |= _before(initial, layers) << 4 * (KEEP + more)
        out |= (_before(2, layers) | _before(3, layers)) << 4 * (REROLE + more)
    return _based(_inserted(out & _ALL))


_steps: dict[tuple[int, int], tuple[int, int]] = {}


def layers_of(kinds: bytes, end: tuple[int, int]) -> tuple[list[int], list[int]]:
    """Layers and base before each row, and at last those behind all."""
    words, bases = [0] * (len(kinds) + 1), [0] * (len(kinds) + 1)
    layers, base = end
    words[-1], bases[-1] = layers, base
    steps = _steps
    for i in range(len(kinds) - 1, -1, -1):
        key = kinds[i], layers
        found = steps.get(key)
        if found is None:
            found = steps[key] = _row(*key)
        layers = found[0]
        base += found[1]
        words[i], bases[i] = layers, base
    return words, bases


def costs_of(layers: int, base: int) -> list[int]:
    """The cost from each state."""
    out = [NONE] * 4
    for q in range(4):
        if own := (layers >> q) & _LOW:
            out[q] = base + ((own & -own).bit_length() - 1) // 4
    return out


def of_costs(costs: list[int]) -> tuple[int, int]:
    """Layers and base of a cost for each state; a cost beyond the layers is never the best."""
    base = min(costs)
    return sum(1 << 4 * (c - base) + q for q, c in enumerate(costs) if c - base < 16), base


#: Behind the last row: the end is reached from states 0 and 3.
END = _based(_inserted(0b1001))


def table_of(kinds: bytes) -> list[list[int]]:
    """Cost from each state before the rows to each state behind them."""
    columns = []
    for t in range(4):
        words, bases = layers_of(kinds, (1 << t, 0))
        columns.append(costs_of(words[0], bases[0]))
    return [[columns[t][q] for t in range(4)] for q in range(4)]


def trace(kinds: bytes, words: list[int], bases: list[int], state: int, last: bool) -> tuple[str, int, int]:
    """The least audit of the cheapest edits from a state on, the state it ends in, and its cost."""
    audit = []
    left = bases[0] + _lowest(words[0], state)
    whole = left
    for i, kind in enumerate(kinds):
        initial, fault = kind & 3, kind >> 2
        more = TRUNCATED if fault == 3 else 0
        words_i, base_i, words_n, base_n = words[i], bases[i], words[i + 1], bases[i + 1]
        while True:
            if _has(words_n, left - DELETE - base_n, state):
                audit.append("D")
                left -= DELETE
                break
            written = 3 if state == 2 else 2
            if _has(words_i, left - INSERT - base_i, written):
                audit.append("I")
                left -= INSERT
                state = written
                continue
            kept = _NEXT[initial].get(state) if initial else None
            if kept is not None and fault not in (1, 2) and _has(words_n, left - more - base_n, kept):
                audit.append("K")
                left -= more
                state = kept
            else:
                audit.append("R")
                left -= REROLE + more
                state = written
            break
    while last and not (left == 0 and state in (0, 3)):
        audit.append("I")
        left -= INSERT
        state = 3 if state == 2 else 2
    return "".join(audit), state, whole - left


def _lowest(layers: int, state: int) -> int:
    own = (layers >> state) & _LOW
    return ((own & -own).bit_length() - 1) // 4


def _has(layers: int, layer: int, state: int) -> bool:
    """Whether a state's cheapest way to the end is in this layer."""
    return 0 <= layer < 16 and layers >> 4 * layer + state & 1 == 1 and _lowest(layers, state) == layer


@dataclass
class Stretch:
    """Rows of one conversation in one task."""

    conv: Any
    parts: list[pa.RecordBatch] = field(default_factory=list)

    def kinds(self) -> bytes:
        return b"".join(p.column("kind").cast(pa.uint8()).to_numpy().tobytes() for p in self.parts)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stretch, bool]]:
    """Stretches in order, and whether each is the task's last."""
    now: Stretch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = pc.run_end_encode(batch.column("conv_id"))
        at = 0
        for end, conv in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            part = batch.slice(at, end - at)
            at = end
            if now is not None and now.conv == conv and type(now.conv) is type(conv):
                now.parts.append(part)
                continue
            if now is not None:
                yield now, False
            now = Stretch(conv, [part])
    if now is not None:
        yield now, True


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, kind and row of each row: its role's initial and its first fault.

    Nulls in role and text are one space. A row is blank if its text has no character besides spaces, tabs and
    breaks; a duplicate if role and text were seen earlier in the conversation; truncated if the last such
    character is not one of `.!?`. Rows are in order of turn (nulls first), then role, then text.
    """
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row"))
    place = F.struct(F.coalesce(F.col("turn").cast("decimal(20,0)"), F.lit(Decimal(-(10**19))).cast("decimal(20,0)")).alias("turn"), F.col("row").alias("row"))
    rows = cut(rows, "turns").select("*", place.alias("_place"), F.xxhash64("conv_id", F.lit(0)).alias("_conv"), F.md5(F.concat_ws("\n", F.length("role"), "role", "text")).alias("_said"))
    rows = with_group_min(rows, ["_conv", "_said"], "_place", "_first")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1)
    fault = F.when(~F.col("text").rlike(NO_WORD), 1).when(F.col("_place.row") != F.col("_first.row"), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", (initial + 4 * fault).cast("tinyint").alias("kind"), "row")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn over all tasks, kept as they are dealt."""
    by = ["conv_id", "turn", "role"]
    return rows.repartitionByRange(*by, F.substring("text", 1, 64), "row").sortWithinPartitions(*by, "text", "row").drop("row").checkpoint()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, Stretch]]:
    """A task's stretches with their number, 0 for the first, 1 for the last if it is another, -1 for others."""
    first = True
    for stretch, last in _stretches(batches):
        yield (0 if first else 1 if last else -1), last, stretch
        first = False


@dataclass
class Link:
    """A stretch of a conversation that goes on in other tasks."""

    costs: list[list[int]]
    end: tuple[int, int] = END
    state: int = 0
    last: bool = True


def _links(rows: DataFrame) -> dict[tuple[int, int], Link]:
    """By task and place: the stretches of conversations that several tasks hold, with what follows and precedes them.

    At most two tables of 16 numbers a task meet on the driver, whatever the conversations' sizes.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for place, last, s in _edges(batches):
            if place >= 0:
                costs = [c for row in table_of(s.kinds()) for c in row]
                yield pa.record_batch([pa.array([task], pa.int32()), pa.array([place], pa.int32()), pa.array([last]), s.parts[0].column("conv_id").slice(0, 1), pa.array([costs], pa.list_(pa.int64()))], names=["task", "place", "last", "conv_id", "costs"])

    found = sorted(rows.mapInArrow(tables, f"task int, place int, last boolean, conv_id {kind}, costs array<long>").collect(), key=lambda r: (r["task"], r["place"]))
    chains: list[list] = []
    for k, r in enumerate(found):
        before = found[k - 1] if k else None
        if before is not None and before["last"] and r["place"] == 0 and before["conv_id"] == r["conv_id"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    links = {}
    for chain in (c for c in chains if len(c) > 1):
        end, last = END, True
        for r in reversed(chain):
            table = [r["costs"][4 * q : 4 * q + 4] for q in range(4)]
            links[r["task"], r["place"]] = Link(table, end, last=last)
            behind = costs_of(*end)
            end, last = of_costs([min(table[q][t] + behind[t] for t in range(4)) for q in range(4)]), False
    if not links:
        return links

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for place, _, s in _edges(batches):
            if link := links.get((task, place)):
                kinds = s.kinds()
                words, bases = layers_of(kinds, link.end)
                to = [trace(kinds, words, bases, q, link.last)[1] for q in range(4)]
                yield pa.record_batch([pa.array([task], pa.int32()), pa.array([place], pa.int32()), pa.array([to], pa.list_(pa.int32()))], names=["task", "place", "states"])

    to = {(r["task"], r["place"]): r["states"] for r in rows.mapInArrow(states, "task int, place int, states array<int>").collect()}
    for chain in (c for c in chains if len(c) > 1):
        state = 0
        for r in chain:
            links[r["task"], r["place"]].state = state
            state = to[r["task"], r["place"]][state]
    return links


_COUNTS = ["n", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURNS = ["distinct_turns", "min_turn", "max_turn"]


def _counts(kinds: bytes) -> dict[str, int]:
    k = np.frombuffer(kinds, np.uint8)
    fault, initial = k >> 2, k & 3
    return {"n": len(k), "blank": int((fault == 1).sum()), "duplicate": int((fault == 2).sum()), "truncated": int((fault == 3).sum()), "illegal": int((~_legal(initial[:-1], initial[1:])).sum())}


def _legal(a, b):
    return ((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))


def _turns(s: Stretch) -> dict[str, int | None]:
    turns = np.concatenate([p.column("turn").drop_null().to_numpy() for p in s.parts])
    if not len(turns):
        return {"distinct_turns": 0, "min_turn": None, "max_turn": None}
    return {"distinct_turns": int((np.diff(turns) != 0).sum()) + 1, "min_turn": int(turns[0]), "max_turn": int(turns[-1])}


def repaired_rows(s: Stretch, audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired stretch."""
    edits = iter(audit)
    for part in s.parts:
        for role, text, kind in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), part.column("kind").to_pylist(), strict=True):
            while (edit := next(edits)) == "I":
                state = 3 if state == 2 else 2
                yield ("user" if state == 2 else "assistant"), ""
            if edit == "K":
                state = _NEXT[kind & 3][state]
                yield role, text
            elif edit == "R":
                state = 3 if state == 2 else 2
                yield ("user" if state == 2 else "assistant"), text
    for _ in edits:
        state = 3 if state == 2 else 2
        yield ("user" if state == 2 else "assistant"), ""


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, n, blank, duplicate, truncated, illegal, gaps, cost, audit, repaired_sha256 of each conversation with rows.

    `turns` has conv_id, turn, role and text; other columns are not read. Edits: Keep costs 0, Rerole to user or
    assistant 1, Delete 2 (blank and duplicate rows have to go), Insert an empty turn of user or assistant 5; a
    truncated row that stays costs 5. `audit` has the initials of the cheapest edits in order, the least in ASCII
    order of several. `gaps` is the largest turn less the smallest, plus 1, less the distinct turns; 0 without any.
    Rows without a conv_id are one conversation. Nulls in role and text are one space. Rows of one turn are in
    order of role, then text; repeated rows are duplicates but for the first. An empty table gives no rows.
    """
    rows = ordered(faults(turns))
    links = _links(rows)
    kind = rows.schema["conv_id"].dataType.simpleString()
    numbers = [*_COUNTS, *_TURNS, "first_initial", "last_initial", "kept"]
    schema = f"conv_id {kind}, task int, piece long, {', '.join(f'{c} long' for c in numbers)}, audit string, sha string, body binary"

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        out: list[tuple] = []
        for place, _, s in _edges(batches):
            link = links.get((task, place))
            kinds = s.kinds()
            words, bases = layers_of(kinds, link.end if link else END)
            state, last = (link.state, link.last) if link else (0, True)
            audit, _, cost = trace(kinds, words, bases, state, last)
            have = _counts(kinds) | _turns(s) | {"cost": cost, "first_initial": kinds[0] & 3, "last_initial": kinds[-1] & 3}
            sha, body, kept, piece = hashlib.sha256(), bytearray(), 0, 0
            conv = s.parts[0].column("conv_id").slice(0, 1)
            for role, text in repaired_rows(s, audit, state):
                said = (b"\n" if kept else b"") + f"{role}:{text}".encode()
                kept += 1
                if link is None:
                    sha.update(said)
                    continue
                body += said
                while len(body) >= PIECE:
                    piece += 1
                    out.append((conv, piece, {}, None, None, bytes(body[:PIECE])))
                    del body[:PIECE]
            # piece 0 has the counts, and comes first when the pieces are put in order again
            out.append((conv, 0, have | {"kept": kept}, audit, sha.hexdigest() if link is None else None, None))
            if link is not None and body:
                out.append((conv, piece + 1, {}, None, None, bytes(body)))
            if len(out) >= 2000:
                yield _batch(out, task, numbers)
                out = []
        if out:
            yield _batch(out, task, numbers)

    found = cut(rows.mapInArrow(edit, schema), "repaired")
    shown = ["conv_id", *_COUNTS, *_TURNS, "audit", F.col("sha").alias("repaired_sha256")]
    if links:
        parts = found.filter("sha IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", "task", "piece")
        done = found.filter("sha IS NOT NULL").unionByName(parts.mapInArrow(lambda b: _joined(b, numbers), schema))
    else:
        done = found
    gaps = F.when(F.col("min_turn").isNull(), 0).otherwise(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns")).cast("long").alias("gaps")
    return done.select(*shown).select("conv_id", "n", "blank", "duplicate", "truncated", "illegal", gaps, "cost", "audit", "repaired_sha256")


def _batch(rows: list[tuple], task: int, numbers: list[str]) -> pa.RecordBatch:
    convs = pa.concat_arrays([r[0] for r in rows])
    columns = [pa.array([r[2].get(c) for r in rows], pa.int64()) for c in numbers]
    return pa.record_batch(
        [convs, pa.array([task] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.int64()), *columns, pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string()), pa.array([r[5] for r in rows], pa.binary())],
        names=["conv_id", "task", "piece", *numbers, "audit", "sha", "body"],
    )


def _joined(batches: Iterator[pa.RecordBatch], numbers: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of several stretches: counts added, audits joined, text hashed as it passes."""
    conv, have, audits, sha, some, at_start = None, None, [], None, False, False

    def row() -> pa.RecordBatch:
        return _batch([(conv, 0, have, "".join(audits), sha.hexdigest(), None)], 0, numbers)

    for batch in batches:
        ids = batch.column("conv_id")
        for k, r in enumerate(batch.to_pylist()):
            if r["n"] is not None:  # a stretch begins
                if have is None or conv[0].as_py() != r["conv_id"]:
                    if have is not None:
                        yield row()
                    conv, have, audits, sha, some = ids.slice(k, 1), {c: r[c] for c in numbers}, [], hashlib.sha256(), False
                else:
                    seam = have["last_initial"], r["first_initial"]
                    have["illegal"] += not _legal(*seam)
                    have["distinct_turns"] -= have["max_turn"] is not None and have["max_turn"] == r["min_turn"]
                    for c in [*_COUNTS, "distinct_turns"]:
                        have[c] += r[c]
                    have["min_turn"] = have["min_turn"] if have["min_turn"] is not None else r["min_turn"]
                    have["max_turn"] = r["max_turn"] if r["max_turn"] is not None else have["max_turn"]
                    have["last_initial"] = r["last_initial"]
                audits.append(r["audit"])
                at_start = r["kept"] > 0
            else:
                if at_start and some:
                    sha.update(b"\n")
                at_start, some = False, True
                sha.update(r["body"])
    if have is not None:
        yield row()
