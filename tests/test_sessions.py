import datetime as dt
import json
import os
import random
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

from quern.streaming import outbox, sessions

REQUESTS = "session_id string, place long, kind string, text string, refs array<string>, command_id string, command_hash string"


def requests(seed=1, n=6, most=14):
    rng = random.Random(seed)
    rows = []
    for s in range(n):
        for place in range(rng.randint(3, most)):
            kind = rng.choice([*sessions.KINDS[:7], sessions.STARTS, sessions.COMPLETES, sessions.ASKS, "nonsense"] + ([sessions.CLOSES] if place > 8 else []))
            command = rng.choice([None, "c1", "c2"]) if kind in (sessions.STARTS, sessions.COMPLETES) else None
            rows.append((f"s{s}", place, kind, rng.choice([f"text {place}", None]), rng.choice([None, ["r1"], ["r2", "r1", None]]), command, rng.choice(["h1", "h1", "h2"]) if command else None))
    return rows


def test_commands_and_closing(spark):
    rows = [
        ("s", 1, "question_asked", "Why?", None, "c", "h"), ("s", 2, "question_asked", "Why?", None, "c", "h"), ("s", 3, "question_asked", "How?", None, "c", "other"), ("s", 4, "evidence_attached", None, ["b", "a", "b"], "d", "h"),
        ("s", 5, "evidence_attached", None, ["b", "a"], "c", "h"), ("s", 6, "evidence_attached", None, ["z"], "c", "h"), ("s", 7, "evidence_attached", None, ["a", "q"], None, None), ("s", 8, "decision_recorded", "Yes", None, None, None),
        ("s", 9, "session_closed", None, None, None, None), ("s", 10, "gap_recorded", "late", None, None, None), ("s", 11, "state", None, None, None, None), ("t", 1, "state", None, None, None, None), (None, 1, "gap_recorded", None, None, None, None),
    ]
    found = {(r.session_id, r.place): r for r in sessions.answered(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert [(found["s", k].outcome, found["s", k].sequence, found["s", k].command_sequence) for k in range(1, 11)] == [
        ("accepted", 1, 1), ("repeated", None, 1), ("conflict", None, 1), ("not_started", None, None), ("accepted", 2, 2), ("repeated", None, 2), ("accepted", 3, None), ("accepted", 4, None), ("accepted", 5, None), ("closed", None, None)
    ]
    state = json.loads(found["s", 11].state)
    assert state["status"] == "closed" and state["event_count"] == 5 and state["questions"] == ["Why?"] and state["evidence_refs"] == ["a", "b", "q"] and state["latest_event_hash"] == found["s", 9].event_hash
    assert json.loads(found["t", 1].state)["status"] == "open" and found[None, 1].outcome == "accepted"


def test_a_stream_stopped_twice_answers_like_a_replay(spark, tmp_path):
    rows = requests()
    for k, v in sessions.ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        for part in range(3):  # each run finds one more file; state comes from the checkpoint
            own = [r for r in rows if r[1] // 5 == min(part, 2) or (part == 2 and r[1] >= 15)]
            spark.createDataFrame(own, REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "in"))
            query = sessions.answer_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
        got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
        want = sorted(map(str, sessions.answered(spark.createDataFrame(rows, REQUESTS)).collect()))
        assert got == want and len(got) == len(rows)
        # another stream takes up where the sessions were left
        answers = sessions.answered(spark.createDataFrame(rows, REQUESTS))
        heads = sessions.opened(spark.createDataFrame(rows, REQUESTS), answers)
        more = [(f"s{k}", 100, "gap_recorded", "later", None, None, None) for k in range(6)]
        spark.createDataFrame(more, REQUESTS).write.parquet(str(tmp_path / "more"))
        later = sessions.answer_stream(spark.readStream.schema(REQUESTS).parquet(str(tmp_path / "more")), heads)
        later.writeStream.format("parquet").option("path", str(tmp_path / "later")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination()
        whole = {r.session_id: r for r in sessions.answered(spark.createDataFrame(rows + more, REQUESTS)).filter("place = 100").collect()}
        for r in spark.read.parquet(str(tmp_path / "later")).collect():
            assert (r.outcome, r.sequence, r.event_hash) == (whole[r.session_id].outcome, whole[r.session_id].sequence, whole[r.session_id].event_hash)
    finally:
        for k in sessions.ROCKSDB:
            spark.conf.unset(k)


EVENTS = "event_id long, occurred_at timestamp, kind string"


def some_events(spark, lo, hi):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k % 30, t + dt.timedelta(seconds=(k * 7) % 50), "é\n" if k % 2 else None) for k in range(lo, hi)], EVENTS)


def test_outbox_holds_each_event_once_in_order(spark, tmp_path):
    sink, source, check = (str(tmp_path / x) for x in ("sink", "in", "ck"))
    schema = some_events(spark, 0, 1).schema
    for lo, hi in ((0, 20), (10, 40)):  # the second run repeats ids of the first
        some_events(spark, lo, hi).coalesce(1).write.mode("append").parquet(source)
        outbox.export(spark.readStream.schema(schema).parquet(source), sink, check).awaitTermination()
    rows = outbox.exported(spark, sink, schema).collect()
    assert sorted(r.event_id for r in rows) == list(range(30)) and {r.kind for r in rows} == {"é\n", None}
    keys = [(r.epoch, r.occurred_at, r.event_id) for r in rows]
    assert keys == sorted(keys) and len({r.epoch for r in rows}) == 2
    for f in Path(sink).glob("*.jsonl"):
        lines = [json.loads(x) for x in f.read_text().splitlines()]
        assert [(x["occurred_at"], x["event_id"]) for x in lines] == sorted((x["occurred_at"], x["event_id"]) for x in lines)


def test_outbox_killed_before_the_commit_and_after_it(spark, tmp_path):
    sink, source, check = (str(tmp_path / x) for x in ("sink", "in", "ck"))
    schema = some_events(spark, 0, 1).schema
    some_events(spark, 0, 25).coalesce(2).write.parquet(source)
    run = lambda: outbox.export(spark.readStream.schema(schema).parquet(source), sink, check).awaitTermination()
    os.mkdir(sink)
    Path(sink, outbox.EPOCHS).write_text("a file, so that no manifest can be put below it")
    with pytest.raises(StreamingQueryException):
        run()
    os.unlink(Path(sink, outbox.EPOCHS))
    assert outbox.exported(spark, sink, schema).count() == 0  # written, not committed
    run()
    assert sorted(r.event_id for r in outbox.exported(spark, sink, schema).collect()) == list(range(25))
    # the sink has committed, Spark's own log of the epoch is lost: the epoch runs again
    for f in Path(check, "commits").glob("[0-9]*"):
        f.unlink()
    for f in Path(check, "commits").glob(".[0-9]*"):
        f.unlink()
    run()
    assert sorted(r.event_id for r in outbox.exported(spark, sink, schema).collect()) == list(range(25))
    assert len(os.listdir(f"{sink}/{outbox.EPOCHS}")) >= 1


def test_an_epoch_committed_twice_keeps_the_first(tmp_path):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("event_id", LongType()), StructField("occurred_at", LongType())])
    writer = outbox.OutboxWriter(schema, {"path": str(tmp_path)})
    first, second = ([writer.write(iter([{"event_id": 2, "occurred_at": 5}, {"event_id": 1, "occurred_at": None}])), writer.write(iter([]))] for _ in range(2))
    writer.commit(first, 0)
    writer.commit(second, 0)
    files = list(Path(tmp_path).glob("*.jsonl"))
    assert [f.name for f in files] == [first[0].name] and [json.loads(x)["event_id"] for x in files[0].read_text().splitlines()] == [1, 2]
